"""Search queries over the model's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vector import int8, norm, normalized
from lodestone.operators import fts, fusion, graph, vectors
from lodestone.plans.registry import query
from lodestone.session import shared_folder
from lodestone.sources import tables

TERMS = ("the", "elle")
K = 10

NODES = """nodes AS (
  SELECT doc_id::VARCHAR AS id, CASE WHEN lang = 'de' THEN 'fact' ELSE 'document' END AS node_type, text AS body, ['lang:' || lang, 'project:' || source] AS tags,
    coalesce(0.5 + 0.5 * quality - 0.25 * toxic, 1.0) AS confidence,
    TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS tx_time,
    CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE + INTERVAL 1 DAY END AS valid_time
  FROM documents LEFT JOIN labels USING (doc_id)
)"""
INDEXED = NODES + r""", texts AS (
  SELECT id, 'body' AS field, body AS t FROM nodes UNION ALL SELECT id, 'tags', array_to_string(tags, ' ') FROM nodes
), indexed AS (
  SELECT * FROM (SELECT id, field, list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda x: strlen(x) <= 40) AS tokens FROM texts) WHERE len(tokens) > 0
)"""
BM25 = """, stats AS (
  SELECT field, count(*) AS n, avg(len(tokens)) AS avgdl FROM indexed GROUP BY field
), found AS (
  SELECT id, field, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, field, len(tokens) AS dl, unnest(tokens) AS term FROM indexed)
  WHERE term IN (SELECT term FROM queries) GROUP BY id, field, term
), weights AS (
  SELECT f.field, f.term, any_value(n) AS n, any_value(avgdl) AS avgdl, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM found f JOIN stats USING (field) GROUP BY f.field, f.term
), scored AS (
  SELECT qid, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM found JOIN weights USING (field, term) JOIN (SELECT DISTINCT qid, term FROM queries) q USING (term) GROUP BY qid, id
)"""


def top_sql(k: int) -> str:
    return f"SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM scored) WHERE rank <= {k}"


TERM_QUERIES = ", queries AS (SELECT 0::BIGINT AS qid, unnest(['the', 'elle']) AS term)"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.field_tokens(tables.texts(spark, sf_dir), fts.body_and_tags())


def _terms(spark: SparkSession, *terms: str) -> DataFrame:
    return spark.createDataFrame([(0, t) for t in terms], "qid bigint, term string")


@query(f"WITH {INDEXED}{TERM_QUERIES}{BM25} {top_sql(K)}")
def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over body and tags, joined to existing nodes."""
    scored = fts.bm25(_indexed(spark, sf_dir), _terms(spark, *TERMS))
    return fts.top(scored, K)


@query(
    f"WITH {INDEXED}, queries AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM benchmark){BM25} {top_sql(5)}"
)
def fts_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query of all its words."""
    asked = tables.table(spark, sf_dir, "benchmark")
    terms = asked.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("term"))
    return fts.top(fts.bm25(_indexed(spark, sf_dir), terms), 5)


@query(f"WITH {INDEXED} SELECT id FROM indexed WHERE field = 'body' AND list_contains(tokens, 'the') AND list_contains(tokens, 'idiot') AND NOT list_contains(tokens, 'clown')")
def fts_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.boolean(_indexed(spark, sf_dir), must=("the", "idiot"), must_not=("clown",))


@query(
    f"""WITH {INDEXED}, places AS (SELECT id, tokens, unnest(range(1, len(tokens))) AS i FROM indexed WHERE field = 'body')
    SELECT id, count(*)::BIGINT AS n FROM places WHERE tokens[i] = 'of' AND tokens[i + 1] = 'the' GROUP BY id"""
)
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.phrase(_indexed(spark, sf_dir), ("of", "the"))


@query(f"WITH {INDEXED} SELECT id FROM indexed WHERE field = 'tags' AND list_contains(tokens, 'fr')")
def fts_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.boolean(_indexed(spark, sf_dir), must=("fr",), field="tags")


@query(f"WITH {INDEXED}{TERM_QUERIES}{BM25.replace('scored AS', 'every AS')}, scored AS (SELECT e.* FROM every e JOIN nodes n USING (id) WHERE node_type = 'document') {top_sql(K)}")
def fts_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type filters, it does not score."""
    typed = tables.nodes(spark, sf_dir).where("node_type = 'document'").select("id")
    return fts.top(fts.bm25(_indexed(spark, sf_dir), _terms(spark, *TERMS)).join(typed, "id", "left_semi"), K)


@query(f"WITH {INDEXED}{TERM_QUERIES}{BM25} {top_sql(K)}")
def fts_stored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over stored postings: the index is written, then only its terms' rows are read."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    fts.stored_postings(_indexed(spark, sf_dir)).write.parquet(f"{folder}/postings")
    stored = spark.read.parquet(f"{folder}/postings")
    fts.stored_lengths(stored).write.parquet(f"{folder}/lengths")
    return fts.top(fts.bm25_of(fts.of_terms(stored, list(TERMS)), fts.statistics_of(spark.read.parquet(f"{folder}/lengths")), _terms(spark, *TERMS)), K)


@query(f"WITH {INDEXED} SELECT field, count(*)::BIGINT AS n, round(avg(len(tokens)), 6) AS avgdl FROM indexed GROUP BY field")
def fts_doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.statistics(_indexed(spark, sf_dir)).select("field", "n", F.round("avgdl", 6).alias("avgdl"))


@query(
    f"WITH {INDEXED}, each AS (SELECT id, unnest(tokens) AS term FROM indexed WHERE field = 'body') SELECT term, count(DISTINCT id)::BIGINT AS df, count(*)::BIGINT AS cf FROM each GROUP BY term HAVING count(DISTINCT id) >= 5"
)
def fts_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of the terms of five documents or more."""
    post = fts.postings(_indexed(spark, sf_dir).where("field = 'body'"))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 5")


VECTORS = "vectors AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
ASKED = ", asked AS (SELECT id AS qid, v AS q FROM vectors WHERE id::BIGINT % 100 = 0)"
COSINE = "round(CASE WHEN sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)) < 1e-10 THEN 0 ELSE list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) END, 6)"


def ranked_sql(source: str, order: str, k: int, columns: str = "qid, id, score, rank") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rank FROM {source}) WHERE rank <= {k}"


def _asked(v: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 100, as a query."""
    return v.where(F.col("id").cast("bigint") % 100 == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"))


@query(f"WITH {VECTORS}, asked AS (SELECT id AS qid, v AS q FROM vectors WHERE id = '7'), s AS (SELECT qid, id, {COSINE} AS score FROM vectors, asked) {ranked_sql('s', 'score DESC', K)}")
def vec_flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    return vectors.batch_top_k(v, v.where("id = '7'").select(F.col("id").alias("qid"), F.col("v").alias("q")), K)


@query(f"WITH {VECTORS}{ASKED}, s AS (SELECT qid, id, {COSINE} AS score FROM vectors, asked) {ranked_sql('s', 'score DESC', K)}")
def vec_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    return vectors.batch_top_k(v, _asked(v), K)


@query(f"WITH {VECTORS} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vectors")
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vectors(spark, sf_dir).select("id", F.round(norm(F.col("v")), 6).alias("norm"))


@query(f"WITH {VECTORS}, u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM vectors) SELECT id, round(u[1], 6) AS first, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS square FROM u")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = tables.vectors(spark, sf_dir).select("id", normalized(F.col("v")).alias("u"))
    square = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return u.select("id", F.round(F.col("u")[0], 6).alias("first"), F.round(square, 6).alias("square"))


@query(f"WITH {VECTORS}, z AS (SELECT id, list_transform(v, lambda x: CASE WHEN id::BIGINT % 5 = 0 THEN 0 ELSE x END) AS v FROM vectors), asked AS (SELECT id AS qid, v AS q FROM vectors WHERE id = '3'), s AS (SELECT qid, id, {COSINE} AS score FROM z, asked) SELECT id, score FROM s")
def vec_zero_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without length score 0, not null."""
    v = tables.vectors(spark, sf_dir)
    zeroed = v.withColumn("v", F.transform("v", lambda x: F.when(F.col("id").cast("bigint") % 5 == 0, 0.0).otherwise(x)))
    return vectors.scored(zeroed, v.where("id = '3'").select(F.col("id").alias("qid"), F.col("v").alias("q"))).select("id", "score")


@query(f"WITH {INDEXED}, t AS (SELECT id, tokens FROM indexed WHERE field = 'body' AND (list_contains(tokens, 'idiot') OR list_contains(tokens, 'moron')) AND NOT list_contains(tokens, 'clown')), queries AS (SELECT 0::BIGINT AS qid, 'idiot' AS term, 2.0 AS w UNION ALL SELECT 0, 'moron', 1.0), stats AS (SELECT field, count(*) AS n, avg(len(tokens)) AS avgdl FROM indexed GROUP BY field), found AS (SELECT id, field, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, field, len(tokens) AS dl, unnest(tokens) AS term FROM indexed) WHERE term IN (SELECT term FROM queries) GROUP BY id, field, term), weights AS (SELECT f.field, f.term, any_value(n) AS n, any_value(avgdl) AS avgdl, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM found f JOIN stats USING (field) GROUP BY f.field, f.term), every AS (SELECT qid, id, sum(w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM found JOIN weights USING (field, term) JOIN queries q USING (term) GROUP BY qid, id), scored AS (SELECT e.* FROM every e JOIN t USING (id)) {top_sql(K)}")
def fts_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idiot^2 OR moron) AND NOT clown, scored."""
    clause = fts.all_of(fts.any_of(fts.word("idiot").boosted(2.0), fts.word("moron")), fts.none_of(fts.word("clown")))
    return fts.search(_indexed(spark, sf_dir), clause, K)


@query(f"WITH {VECTORS} SELECT id, len(v)::INTEGER AS dims FROM vectors WHERE len(v) = 64")
def vec_dim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.of_dimension(tables.vectors(spark, sf_dir), 64).select("id", F.size("v").alias("dims"))


CODE = "list_reduce(list_transform(v, lambda x, i: CASE WHEN x > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b)"
CODES = f"{VECTORS}, codes AS (SELECT id, v, len(v) AS dims, {CODE} AS code FROM vectors)"
NEAR = ", asked AS (SELECT id AS qid, v AS q, code AS q_code FROM codes WHERE id::BIGINT % 100 = 0), near AS (SELECT qid, id, v, q, dims, bit_count(xor(code, q_code))::BIGINT AS distance FROM codes, asked)"


@query(f"WITH {CODES} SELECT id, bit_count(code)::BIGINT AS ones, (code & 65535)::BIGINT AS low FROM codes")
def bin_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")[0]
    return vectors.with_code(tables.vectors(spark, sf_dir)).select("id", F.bit_count(code).cast("bigint").alias("ones"), code.bitwiseAND(F.lit(65535)).alias("low"))


@query(f"WITH {CODES}{NEAR}, s AS (SELECT qid, id, distance, round(1 - distance / dims, 6) AS similarity FROM near) {ranked_sql('s', 'distance', K, 'qid, id, distance, similarity, rank')}")
def bin_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    return vectors.hamming_top_k(v, _asked(v), K)


RESCORED = f"{CODES}{NEAR}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS r FROM near) WHERE r <= 200), s AS (SELECT qid, id, {COSINE} AS score FROM c), got AS ({ranked_sql('s', 'score DESC', K)})"


@query(f"WITH {RESCORED} SELECT * FROM got")
def bin_rescore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    return vectors.rescored_top_k(v, _asked(v), K)


@query(f"WITH {RESCORED}, t AS (SELECT qid, id, {COSINE} AS score FROM vectors, asked), truth AS ({ranked_sql('t', 'score DESC', K)}) SELECT t.qid, round(count(g.id) / 10, 6) AS recall FROM truth t LEFT JOIN got g ON t.qid = g.qid AND t.id = g.id GROUP BY t.qid")
def bin_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    return vectors.recall(vectors.batch_top_k(v, _asked(v), K), vectors.rescored_top_k(v, _asked(v), K), K)


@query(f"WITH {VECTORS} SELECT count(*)::BIGINT AS n, sum(len(v) * 4)::BIGINT AS f32_bytes, sum(len(v))::BIGINT AS i8_bytes, sum(ceil(len(v) / 8))::BIGINT AS code_bytes, (count(*) * 4)::BIGINT AS norm_bytes FROM vectors")
def index_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.index_sizes(tables.vectors(spark, sf_dir))


@query(f"WITH {VECTORS} SELECT id, list_sum(list_transform(v, lambda x: round(x * 127 / list_max(list_transform(v, lambda y: abs(y))))))::BIGINT AS total FROM vectors")
def int8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(int8(F.col("v")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return tables.vectors(spark, sf_dir).select("id", total.alias("total"))


@query(None)
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: recall is tested against the exact search (0.9 or more)."""
    v = tables.vectors(spark, sf_dir)
    return vectors.ivf_top_k(v, _asked(v), K)


@query(f"WITH {CODES}, asked AS (SELECT id AS qid, code AS q_code FROM codes WHERE id = '7') SELECT qid, id, bit_count(xor(code, q_code))::BIGINT AS distance FROM codes, asked")
def bin_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all codes to one query, without a ranking."""
    v = tables.vectors(spark, sf_dir)
    return vectors.distances(v, v.where("id = '7'").select(F.col("id").alias("qid"), F.col("v").alias("q")))


def _rankings(spark: SparkSession, sf_dir: str, k: int) -> list[DataFrame]:
    """A vector ranking (by the vector of document 7) and a keyword ranking of query 0."""
    v = tables.vectors(spark, sf_dir)
    asked = v.where("id = '7'").select(F.lit(0).cast("bigint").alias("qid"), F.col("v").alias("q"))
    by_vector = vectors.batch_top_k(v, asked, 3 * k)
    by_words = fts.top(fts.bm25(_indexed(spark, sf_dir), _terms(spark, *TERMS)), 3 * k)
    return [by_vector.select("qid", "id", "rank"), by_words.select("qid", "id", "rank")]


FUSED = f"""{INDEXED}{TERM_QUERIES}{BM25}, {VECTORS}, asked AS (SELECT 0::BIGINT AS qid, v AS q FROM vectors WHERE id = '7'),
  s AS (SELECT qid, id, {COSINE} AS score FROM vectors, asked),
  rankings AS (SELECT qid, id, rank FROM ({ranked_sql('s', 'score DESC', 3 * K)}) UNION ALL SELECT qid, id, rank FROM ({top_sql(3 * K)})),
  rrf AS (SELECT qid, id, round(sum(1 / (60 + rank)), 6) AS score FROM rankings GROUP BY qid, id)"""


def hybrid_sql(where: str = "true", pre: str = "true", post: str = "true", k: int = K) -> str:
    kept = f"kept AS (SELECT r.* FROM rrf r JOIN nodes n USING (id) WHERE {pre})" if pre != "true" else "kept AS (SELECT * FROM rrf)"
    return f"""WITH {FUSED}, {kept}, first AS ({ranked_sql('kept', 'score DESC', 2 * k)}),
      joined AS (SELECT f.qid, f.id, f.score, n.confidence, n.tags FROM first f JOIN nodes n USING (id) WHERE {where}),
      cut AS ({ranked_sql('joined', 'score DESC', k, 'qid, id, score, rank, tags')}) SELECT qid, id, score, rank FROM cut WHERE {post}"""


@query(f"WITH {FUSED} SELECT * FROM rrf")
def rrf_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_rankings(spark, sf_dir, K))


def _fused(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    nodes = tables.nodes(spark, sf_dir).select("id", "confidence", "tags")
    return fusion.fused(_rankings(spark, sf_dir, K), nodes, K, **how).select("qid", "id", "score", "rank")


@query(hybrid_sql())
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


@query(hybrid_sql("confidence >= 0.9"))
def hybrid_min_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, min_confidence=0.9)


@query(hybrid_sql(post="list_contains(tags, 'project:src7')"))
def hybrid_project_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, post=F.array_contains("tags", "project:src7"))


@query(hybrid_sql(pre="list_contains(n.tags, 'project:src7')"))
def hybrid_project_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, pre=F.array_contains("tags", "project:src7"))


@query(
    f"""WITH {FUSED}, places AS ({ranked_sql('rrf', 'score DESC', 2**31)}),
    again AS (SELECT p.qid, p.id, CASE WHEN p.rank <= 20 AND s.id IS NOT NULL THEN s.score ELSE p.score END AS score FROM places p LEFT JOIN s ON p.id = s.id)
    {ranked_sql('again', 'score DESC', K)}"""
)
def rerank_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 fused rows by cosine to the query vector; both scales sort together."""
    v = tables.vectors(spark, sf_dir)
    fused = fusion.rrf(_rankings(spark, sf_dir, K))
    asked = v.where("id = '7'").select(F.lit(0).cast("bigint").alias("qid"), F.col("v").alias("q"))
    near = vectors.scored(v.join(fused.select("id").distinct(), "id", "left_semi"), asked)
    return fusion.reranked(fused, near, 20, K)


GRAPH = f"""{VECTORS}, asked AS (SELECT 0::BIGINT AS qid, v AS q FROM vectors WHERE id = '7'), s AS (SELECT qid, id, {COSINE} AS score FROM vectors, asked),
  seeds AS (SELECT id AS seed, rank AS seed_rank FROM ({ranked_sql('s', 'score DESC', 3)})),
  links AS (SELECT DISTINCT * FROM (SELECT conv_id::VARCHAR AS a, (turn + 1000)::VARCHAR AS b FROM conversations UNION ALL SELECT (turn + 1000)::VARCHAR, conv_id::VARCHAR FROM conversations)),
  reach(seed, id, depth) AS (SELECT seed, seed, 0::BIGINT FROM seeds UNION SELECT seed, b, depth + 1 FROM reach JOIN links ON a = id WHERE depth < 2),
  near AS (SELECT id, min(seed_rank * 10 + depth) AS spot FROM (SELECT seed, id, min(depth) AS depth FROM reach GROUP BY seed, id) JOIN seeds USING (seed) GROUP BY id),
  by_graph AS (SELECT 0::BIGINT AS qid, id, row_number() OVER (ORDER BY spot, id) AS rank FROM near)"""


def _by_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two hops of the three nearest vectors; conversations are linked to their turns' numbers."""
    c = tables.table(spark, sf_dir, "conversations")
    edges = c.select(F.col("conv_id").cast("string").alias("source"), (F.col("turn") + 1000).cast("string").alias("target")).distinct()
    v = tables.vectors(spark, sf_dir)
    asked = v.where("id = '7'").select(F.lit(0).cast("bigint").alias("qid"), F.col("v").alias("q"))
    seeds = vectors.batch_top_k(v, asked, 3).select("qid", F.col("id").alias("seed"), F.col("rank").alias("seed_rank"))
    return graph.ranked_near(edges, seeds, 2)


@query(f"WITH RECURSIVE {GRAPH} SELECT * FROM by_graph")
def graph_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's ranking alone: by seed, depth and id."""
    return _by_graph(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {INDEXED}{TERM_QUERIES}{BM25}, {GRAPH},
  rankings AS (SELECT qid, id, rank FROM ({ranked_sql('s', 'score DESC', 3 * K)}) UNION ALL SELECT qid, id, rank FROM ({top_sql(3 * K)}) UNION ALL SELECT qid, id, rank FROM by_graph),
  rrf AS (SELECT qid, id, round(sum(1 / (60 + rank)), 6) AS score FROM rankings GROUP BY qid, id), first AS ({ranked_sql('rrf', 'score DESC', 2 * K)}),
  joined AS (SELECT f.qid, f.id, f.score FROM first f JOIN nodes n USING (id) WHERE confidence >= 0) {ranked_sql('joined', 'score DESC', K)}"""
)
def hybrid_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword, vector and graph rankings fused."""
    nodes = tables.nodes(spark, sf_dir).select("id", "confidence", "tags")
    return fusion.fused([*_rankings(spark, sf_dir, K), _by_graph(spark, sf_dir)], nodes, K).select("qid", "id", "score", "rank")
