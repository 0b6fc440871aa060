"""Graph, time, lifecycle, workspace, chunk, store and watch queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import content_type_of_extension, content_type_of_text, strip, utf8_prefix
from lodestone.operators import chunks, graph, lifecycle, store, temporal, watch, workspaces
from lodestone.plans.registry import query
from lodestone.plans.retrieval import NODES
from lodestone.sources import pages, tables

# --- graph -----------------------------------------------------------------------------

EDGES = """edges AS (
  SELECT source || '/' || edge_type || '/' || target AS id, * FROM (
    SELECT 'has_part' AS edge_type, 'n' || c_nationkey AS source, 'c' || c_custkey AS target, 1.0::DOUBLE AS weight FROM customer
    UNION ALL SELECT 'has_part', 'c' || o_custkey, 'o' || o_orderkey, 1.0 FROM orders
    UNION ALL SELECT 'references', 'o' || l_orderkey, 's' || l_suppkey, sum(l_quantity) FROM lineitem GROUP BY l_orderkey, l_suppkey
    UNION ALL SELECT 'is_a', 's' || s_suppkey, 'n' || s_nationkey, 1.0 FROM supplier)
), links AS (
  SELECT DISTINCT * FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges)
)"""
TURNS = """turns AS (SELECT DISTINCT conv_id, turn FROM conversations), links AS (
  SELECT a.conv_id || ':' || a.turn AS a, b.conv_id || ':' || b.turn AS b FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1
)"""


def reach_sql(depth: int) -> str:
    return f"reach(seed, id, depth) AS (SELECT 'c1', 'c1', 0::BIGINT UNION SELECT seed, b, depth + 1 FROM reach JOIN links ON a = id WHERE depth < {depth}), seen AS (SELECT seed, id, min(depth) AS depth FROM reach GROUP BY seed, id)"


def _seeds(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "seed string")


@query(f"WITH RECURSIVE {EDGES}, {reach_sql(2)} SELECT * FROM seen")
def graph_bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(tables.links(spark, sf_dir), _seeds(spark, "c1"), 2)


@query(f"WITH RECURSIVE {EDGES}, {reach_sql(2)} SELECT id FROM seen WHERE id LIKE 'o%' OR id LIKE 'c%'")
def graph_subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reached ids that exist in a node table: here customers and orders."""
    seen = graph.bfs(tables.links(spark, sf_dir), _seeds(spark, "c1"), 2)
    customers = tables.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    stored = customers.union(tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id")))
    return seen.join(stored, "id", "left_semi").select("id")


@query(f"WITH RECURSIVE {EDGES}, {reach_sql(2)} SELECT DISTINCT e.id, edge_type, source, target, weight FROM edges e JOIN seen s ON (e.source = s.id OR e.target = s.id) WHERE depth < 2")
def graph_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.edges(spark, sf_dir)
    return graph.subgraph_edges(edges, graph.bfs(tables.links(spark, sf_dir), _seeds(spark, "c1"), 2), 2).drop("seed")


@query(f"WITH RECURSIVE {EDGES}, {reach_sql(1)} SELECT id, depth FROM seen")
def graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(tables.links(spark, sf_dir), _seeds(spark, "c1"), 1).select("id", "depth")


@query(
    f"""WITH RECURSIVE {TURNS}, pairs AS (SELECT conv_id || ':' || min(turn) AS f, conv_id || ':' || max(turn) AS t FROM turns GROUP BY conv_id),
    walk(f, id, path) AS (SELECT f, f, [f] FROM pairs UNION ALL SELECT f, b, list_append(path, b) FROM walk JOIN links ON a = id WHERE NOT list_contains(path, b) AND len(path) <= 8)
    SELECT f AS from_id, t AS to_id, (len(path) - 1)::BIGINT AS hops, array_to_string(path, ' ') AS route FROM walk JOIN pairs USING (f) WHERE id = t"""
)
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first turn of each conversation to the last, within 8 hops."""
    turns = tables.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    pairs = turns.select(F.concat_ws(":", "conv_id", "a").alias("from_id"), F.concat_ws(":", "conv_id", "b").alias("to_id"))
    return graph.shortest_path(tables.turns(spark, sf_dir), pairs, 8).select("from_id", "to_id", "hops", F.array_join("path", " ").alias("route"))


def rank_sql(rounds: int = 10, p: float = 0.15) -> str:
    parts = [EDGES, "steps AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS p FROM edges)", "r0 AS (SELECT 'c1' AS id, 1.0::DOUBLE AS score)"]
    for i in range(1, rounds + 1):
        parts.append(f"u{i} AS MATERIALIZED (SELECT id, sum(score) AS score FROM (SELECT target AS id, score * p * {p} AS score FROM r{i - 1} JOIN steps ON id = source UNION ALL SELECT 'c1', {1 - p}) GROUP BY id)")
        parts.append(f"r{i} AS MATERIALIZED (SELECT id, score / (SELECT sum(score) FROM u{i}) AS score FROM u{i})")
    return "WITH " + ", ".join(parts)


@query(f"{rank_sql()} SELECT id, round(score, 6) AS score FROM r10 WHERE round(score, 6) > 0")
def graph_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("q", "c1")], "seed_set string, seed string")
    return graph.pagerank(tables.edges(spark, sf_dir), seeds).select("id", F.round("score", 6).alias("score")).where("score > 0")


@query(f"{rank_sql()} SELECT id, round(score, 6) AS score FROM (SELECT * FROM r10 ORDER BY round(score, 6) DESC, id LIMIT 10) WHERE id LIKE 'o%'")
def graph_ppr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best, then those that exist among orders: fewer may be left."""
    seeds = spark.createDataFrame([("q", "c1")], "seed_set string, seed string")
    best = graph.pagerank(tables.edges(spark, sf_dir), seeds).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)
    return best.join(tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id")), "id", "left_semi")


@query(f"WITH {EDGES} SELECT id, target, weight FROM edges WHERE source = 'o1' AND edge_type = 'references'")
def edges_from_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.edges_from(tables.edges(spark, sf_dir), "o1", "references").select("id", "target", "weight")


@query(f"WITH {EDGES} SELECT id, source, edge_type FROM edges WHERE target = 's1'")
def edges_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.edges_to(tables.edges(spark, sf_dir), "s1").select("id", "source", "edge_type")


@query(f"WITH {EDGES} SELECT source AS id, edge_type, count(*)::BIGINT AS degree, round(sum(weight), 6) AS weight FROM edges GROUP BY source, edge_type")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.degrees(spark, sf_dir).withColumn("weight", F.round("weight", 6))


# --- time ------------------------------------------------------------------------------

DELTAS = """deltas AS (
  SELECT user_id::VARCHAR AS node_id, ts, event_id AS seq, o AS op,
    CASE WHEN o IN ('insert', 'update_body') THEN props END AS body, CASE WHEN o IN ('insert', 'update_confidence') THEN value END AS confidence,
    CASE WHEN o = 'invalidate' THEN ts END AS valid_time
  FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'update_body' WHEN 'click' THEN 'update_confidence' WHEN 'purchase' THEN 'invalidate' WHEN 'error' THEN 'delete' END AS o FROM events)
)"""
CUTOFF = "2024-01-15"


def as_of_sql(at: str) -> str:
    return f"""{DELTAS}, marked AS (
      SELECT *, sum(CASE WHEN op IN ('insert', 'delete') THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY ts, seq) AS epoch
      FROM deltas WHERE ts <= TIMESTAMP '{at}' AND op IS NOT NULL
    ), epochs AS (
      SELECT node_id, epoch, first(op ORDER BY ts, seq) AS begun, last(body ORDER BY ts, seq) FILTER (WHERE body IS NOT NULL) AS body,
        last(confidence ORDER BY ts, seq) FILTER (WHERE confidence IS NOT NULL) AS confidence, last(valid_time ORDER BY ts, seq) FILTER (WHERE valid_time IS NOT NULL) AS valid_time, max(ts) AS changed_at
      FROM marked GROUP BY node_id, epoch
    ), state AS (
      SELECT node_id, body, round(confidence, 6) AS confidence, epoch_us(valid_time) AS valid_micros, epoch_us(changed_at) AS changed_micros
      FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY epoch DESC) AS r FROM epochs) WHERE r = 1 AND begun = 'insert'
    )"""


def _state(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    state = temporal.as_of(tables.deltas(spark, sf_dir), F.lit(at).cast("timestamp"))
    return state.select("node_id", "body", F.round("confidence", 6).alias("confidence"), F.unix_micros("valid_time").alias("valid_micros"), F.unix_micros("changed_at").alias("changed_micros"))


@query(f"WITH {as_of_sql(CUTOFF)} SELECT * FROM state")
def asof_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, CUTOFF)


@query(f"WITH {as_of_sql('2024-01-20')} SELECT * FROM state")
def asof_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's state at another time."""
    state = temporal.as_of(tables.deltas(spark, sf_dir), F.lit("2024-01-20").cast("timestamp"))
    return state.select("node_id", "body", F.round("confidence", 6).alias("confidence"), F.unix_micros("valid_time").alias("valid_micros"), F.unix_micros("changed_at").alias("changed_micros"))


@query(f"WITH {NODES} SELECT id FROM nodes WHERE tx_time <= TIMESTAMP '2024-01-01 10:00:00' AND (valid_time IS NULL OR valid_time > TIMESTAMP '2024-01-02 02:00:00' - INTERVAL 16 HOUR)")
def valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.valid_at(tables.nodes(spark, sf_dir), F.lit("2024-01-01 10:00:00").cast("timestamp")).select("id")


@query(f"WITH {NODES} SELECT id, epoch_us(tx_time) AS micros FROM nodes WHERE tx_time BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 03:00:00'")
def changed_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = temporal.changed_between(tables.nodes(spark, sf_dir), F.lit("2024-01-01 01:00:00").cast("timestamp"), F.lit("2024-01-01 03:00:00").cast("timestamp"))
    return changed.select("id", F.unix_micros("tx_time").alias("micros"))


@query(f"WITH {DELTAS} SELECT node_id, seq, op, row_number() OVER (PARTITION BY node_id ORDER BY ts, seq) AS version FROM deltas WHERE op IS NOT NULL")
def node_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.history(tables.deltas(spark, sf_dir)).select("node_id", "seq", "op", "version")


NOW = "2024-01-01 12:00:00"
DECAYED = f"least(1.0, greatest(0.0, confidence + greatest(1 - confidence, 0) * exp(-0.0001 * greatest(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(tx_time)) / 1000000), 0))))"


@query(f"WITH {NODES} SELECT id, round({DECAYED}, 6) AS decayed FROM nodes")
def decayed_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    decayed = temporal.decayed(F.col("confidence"), F.col("tx_time"), F.lit(NOW).cast("timestamp"))
    return tables.nodes(spark, sf_dir).select("id", F.round(decayed, 6).alias("decayed"))


@query(f"WITH {NODES} SELECT id FROM nodes WHERE {DECAYED} < 0.55")
def stale_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.stale(tables.nodes(spark, sf_dir), F.lit(NOW).cast("timestamp"), 0.55).select("id")


# --- lifecycle -------------------------------------------------------------------------

LATER = "2024-01-02 06:00:00"
LIFE = f"""{NODES}, log AS (
  SELECT user_id::VARCHAR AS id, ts, CASE event_type WHEN 'view' THEN 'access' WHEN 'click' THEN 'connect' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'reinforce' END AS kind FROM events
), touched AS (
  SELECT id, count_if(kind = 'access') AS a, count_if(kind = 'connect') AS c, count_if(kind = 'edit') AS e, least(sum(CASE WHEN kind = 'reinforce' THEN 0.3 ELSE 0 END)::DOUBLE, 1.0) AS b,
    coalesce(greatest(max(ts) FILTER (WHERE kind IN ('access', 'edit')), min(ts)), min(ts)) AS last_accessed
  FROM log WHERE kind IS NOT NULL GROUP BY id
), life AS (
  SELECT n.id, n.tx_time, n.confidence, coalesce(t.a, 0) AS a,
    CASE WHEN last_accessed IS NULL THEN 0 ELSE exp(-0.0001 * greatest(floor((epoch_us(TIMESTAMP '{LATER}') - epoch_us(last_accessed)) / 1000000), 0)) END AS recency,
    coalesce(least(1.0, greatest(0.0, 0.4 * ln(1 + t.a) / 5 + 0.3 * sqrt(t.c) / 10 + 0.2 * ln(1 + t.e) / 3 + 0.1 * t.b)), 0) AS importance
  FROM nodes n LEFT JOIN touched t USING (id)
), scored AS (
  SELECT *, least(1.0, greatest(0.0, 0.3 * recency + 0.4 * importance + 0.3 * confidence)) AS strength FROM life
), stated AS (
  SELECT *, CASE WHEN epoch_us(TIMESTAMP '{LATER}') - epoch_us(tx_time) < 86400000000 THEN 'active' WHEN strength < 0.05 THEN 'forgotten' WHEN strength < 0.2 THEN 'archived' ELSE 'consolidated' END AS state FROM scored
)"""


def _life(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.nodes(spark, sf_dir).select("id", "confidence", "tx_time")
    return lifecycle.scored(nodes, lifecycle.factors(tables.access_log(spark, sf_dir)), F.lit(LATER).cast("timestamp"))


@query(f"WITH {LIFE} SELECT id, round(recency, 6) AS recency, round(importance, 6) AS importance, round(strength, 6) AS strength FROM stated")
def lifecycle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _life(spark, sf_dir).select("id", *[F.round(c, 6).alias(c) for c in ("recency", "importance", "strength")])


@query(f"WITH {LIFE} SELECT id, state FROM stated")
def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _life(spark, sf_dir).select("id", "state")


@query(
    f"""WITH {LIFE} SELECT count(*)::BIGINT AS total, count_if(state = 'active')::BIGINT AS active, count_if(state = 'consolidated')::BIGINT AS consolidated, count_if(state = 'archived')::BIGINT AS archived,
    count_if(state = 'forgotten')::BIGINT AS forgotten, round(count_if(state = 'active') / count(*), 6) AS active_ratio, round(count_if(state = 'consolidated') / count(*), 6) AS consolidated_ratio,
    round(count_if(state = 'archived') / count(*), 6) AS archived_ratio, round(count_if(state = 'forgotten') / count(*), 6) AS forgotten_ratio FROM stated"""
)
def lifecycle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.statistics(_life(spark, sf_dir))


@query(f"WITH {LIFE} SELECT id, round(strength, 6) AS strength FROM stated ORDER BY round(strength, 6) DESC, id LIMIT 50")
def rank_by_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _life(spark, sf_dir).select("id", F.round("strength", 6).alias("strength")).orderBy(F.desc("strength"), "id").limit(50)


@query(f"WITH {LIFE} SELECT id, (epoch_us(TIMESTAMP '{LATER}') + least(24 * power(2, least(a, 6)), 2160) * 3600000000)::BIGINT AS review_micros FROM stated")
def next_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = lifecycle.next_review(F.col("accesses"), F.lit(LATER).cast("timestamp"))
    return _life(spark, sf_dir).select("id", F.unix_micros(review).alias("review_micros"))


# --- workspaces ------------------------------------------------------------------------

SPACES = """spaces AS (
  SELECT n_nationkey::VARCHAR AS ws_id, CASE WHEN n_nationkey < 24 THEN (n_nationkey + 1)::VARCHAR END AS parent, n_nationkey % 2 = 1 AS allow, n_nationkey % 4 <> 0 AS promote,
    (n_nationkey % 3)::VARCHAR AS grp, TIMESTAMP '2024-01-01' + n_nationkey * INTERVAL 1 HOUR AS last_accessed FROM nation
), members AS (
  SELECT c_nationkey::VARCHAR AS ws_id, c_custkey::VARCHAR AS node_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'shared' WHEN 'MACHINERY' THEN 'group' ELSE 'private' END AS access,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN (c_custkey % 3)::VARCHAR END AS grp, TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 1 SECOND AS added_at FROM customer
), asked AS (SELECT DISTINCT s.ws_id, node_id FROM spaces s, members)"""


def _spaces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Workspaces, members, and all nodes as asked for by every workspace (of which there are few)."""
    spaces, members = tables.workspaces(spark, sf_dir), tables.ws_nodes(spark, sf_dir)
    every = F.broadcast(spaces.agg(F.collect_set("ws_id").alias("all")))
    asked = members.select("node_id").distinct().join(every).select("node_id", F.explode("all").alias("ws_id"))
    return spaces, members, asked


@query(
    f"""WITH {SPACES} SELECT ws_id, node_id FROM asked JOIN spaces USING (ws_id) WHERE (allow AND node_id IN (SELECT node_id FROM members WHERE access = 'shared'))
    OR EXISTS (SELECT 1 FROM members m WHERE m.ws_id = asked.ws_id AND m.node_id = asked.node_id) OR EXISTS (SELECT 1 FROM members m WHERE m.ws_id = spaces.parent AND m.node_id = asked.node_id)"""
)
def ws_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.visible(*_spaces(spark, sf_dir))


@query(
    f"""WITH {SPACES} SELECT DISTINCT a.ws_id, a.node_id FROM asked a JOIN spaces s USING (ws_id) JOIN members m ON m.node_id = a.node_id
    WHERE m.ws_id = a.ws_id OR (m.access = 'shared' AND s.allow) OR (m.access = 'group' AND m.grp = s.grp)"""
)
def ws_group_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.group_visible(*_spaces(spark, sf_dir))


@query(f"WITH {SPACES} SELECT m.node_id FROM members m WHERE m.ws_id IN ('5', '6') OR m.access = 'shared'")
def ws_filter_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What workspace 5 sees: its own, its parent's, and what is shared."""
    spaces, members, asked = _spaces(spark, sf_dir)
    return workspaces.visible(spaces, members, asked.where("ws_id = '5'")).select("node_id")


@query(f"WITH {SPACES} SELECT ws_id, count(*)::BIGINT AS total, count_if(access = 'private')::BIGINT AS private, count_if(access = 'shared')::BIGINT AS shared, count_if(access = 'group')::BIGINT AS \"group\" FROM members GROUP BY ws_id")
def ws_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.statistics(tables.ws_nodes(spark, sf_dir))


@query(f"WITH {SPACES} SELECT CASE WHEN ws_id = '1' THEN '2' ELSE ws_id END AS ws_id, node_id, access FROM members")
def ws_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.merged(tables.ws_nodes(spark, sf_dir), "1", "2", F.lit(LATER).cast("timestamp")).select("ws_id", "node_id", "access")


@query(f"WITH {SPACES} SELECT ws_id, node_id FROM members WHERE ws_id NOT IN (SELECT ws_id FROM spaces WHERE last_accessed < TIMESTAMP '{LATER}' - INTERVAL 24 HOUR)")
def ws_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.collected(tables.ws_nodes(spark, sf_dir), tables.workspaces(spark, sf_dir), F.lit(LATER).cast("timestamp")).select("ws_id", "node_id")


@query(f"WITH {SPACES} SELECT ws_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY ws_id ORDER BY added_at, node_id) AS r FROM members) WHERE r <= 50")
def ws_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.within_capacity(tables.ws_nodes(spark, sf_dir), tables.workspaces(spark, sf_dir)).select("ws_id", "node_id")


@query(f"WITH {SPACES} SELECT node_id, CASE WHEN promote AND node_id::BIGINT % 2 = 0 THEN 'shared' ELSE access END AS access FROM members JOIN spaces USING (ws_id)")
def ws_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every even node is asked to be shared."""
    spaces, members = tables.workspaces(spark, sf_dir), tables.ws_nodes(spark, sf_dir)
    asked = members.where(F.col("node_id").cast("bigint") % 2 == 0).select("ws_id", "node_id")
    return workspaces.promoted(members, spaces, asked).select("node_id", "access")


# --- chunks, detection, late interaction ------------------------------------------------

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def pieces_sql(source: str, text: str = "body", keep: str = "id") -> str:
    content = STRIP.format(f"substring({text}, s + 1, 512)")
    return f"SELECT {keep}, s, {content} AS content FROM (SELECT *, unnest(range(0, length({text}), 448)) AS s FROM {source}) WHERE strlen({content}) >= 32"


@query(f"WITH {NODES}, p AS ({pieces_sql('nodes')}) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::BIGINT AS chunk_index, s AS char_offset, sha256(content) AS digest FROM p")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fixed(tables.nodes(spark, sf_dir)).select("id", "chunk_index", "char_offset", F.sha2("content", 256).alias("digest"))


PARAGRAPHS = f"""{NODES}, spread AS (SELECT id, replace(body, chr(10), chr(10) || chr(10)) AS body FROM nodes),
parts AS (SELECT id, string_split(body, chr(10) || chr(10)) AS p FROM spread),
placed AS (SELECT id, (i - 1)::BIGINT AS ordinal, {STRIP.format('p[i]')} AS content, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: strlen(x) + 2)), 0)::BIGINT AS b FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts)),
kept AS (SELECT * FROM placed WHERE strlen(content) >= 32),
pieces AS (SELECT id, ordinal, b AS o, content, false AS sub FROM kept WHERE strlen(content) <= 1024
  UNION ALL SELECT id, ordinal, b + s, piece, true FROM (SELECT id, ordinal, b, s, {STRIP.format('substring(content, s + 1, 512)')} AS piece FROM (SELECT *, unnest(range(0, length(content), 448)) AS s FROM kept WHERE strlen(content) > 1024)) WHERE strlen(piece) >= 32),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal, o) - 1 AS n FROM pieces)"""


@query(f"WITH {PARAGRAPHS} SELECT id, (CASE WHEN sub THEN n ELSE ordinal END)::BIGINT AS chunk_index, o AS char_offset, sha256(content) AS digest FROM numbered")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with each line made a paragraph."""
    spread = tables.nodes(spark, sf_dir).withColumn("body", F.replace("body", F.lit("\n"), F.lit("\n\n")))
    return chunks.paragraphs(spread).select("id", "chunk_index", "char_offset", F.sha2("content", 256).alias("digest"))


@query(
    rf"""WITH {NODES}, headed AS (SELECT id, '# ' || id || chr(10) || replace(regexp_replace(body, '\n$', ''), chr(10), chr(10) || '## part' || chr(10)) AS body FROM nodes),
    lines AS (SELECT id, i, l[i] AS line, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: strlen(x) + 1)), 0)::BIGINT AS b FROM (SELECT id, string_split(body, chr(10)) AS l, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM headed)),
    marked AS (SELECT *, starts_with({STRIP.format('line')}, '#') AS head FROM lines),
    grouped AS (SELECT *, sum(head::INT) OVER (PARTITION BY id ORDER BY i) AS g FROM marked),
    sections AS (SELECT id, g, max(CASE WHEN head THEN {STRIP.format("regexp_replace(" + STRIP.format('line') + ", '^#+', '')")} END) AS section, min(b) AS b, coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (WHERE NOT head), '') AS content FROM grouped GROUP BY id, g),
    kept AS (SELECT * FROM sections WHERE strlen({STRIP.format('content')}) >= 32),
    pieces AS (SELECT id, section, b AS o, {STRIP.format('content')} AS content FROM kept WHERE strlen(content) <= 1024
      UNION ALL SELECT id, section, b + s, piece FROM (SELECT id, section, b, s, {STRIP.format('substring(content, s + 1, 512)')} AS piece FROM (SELECT *, unnest(range(0, length(content), 448)) AS s FROM kept WHERE strlen(content) > 1024)) WHERE strlen(piece) >= 32)
    SELECT id, section, o AS char_offset, sha256(content) AS digest FROM pieces"""
)
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a header put before them and between their lines."""
    body = F.concat(F.lit("# "), "id", F.lit("\n"), F.replace(F.regexp_replace("body", "\n$", ""), F.lit("\n"), F.lit("\n## part\n")))
    return chunks.sections(tables.nodes(spark, sf_dir).withColumn("body", body)).select("id", "section", "char_offset", F.sha2("content", 256).alias("digest"))


@query(None)
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running fold over each text; tested against a letter-by-letter version."""
    return chunks.sentences(tables.nodes(spark, sf_dir)).select("id", "chunk_index", "char_offset", F.sha2("content", 256).alias("digest"))


@query("SELECT page_id, CASE WHEN e = 'html' THEN 'code' ELSE 'text' END AS kind FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^[^?#]*'), '\\.([a-z0-9]+)$', 1) AS e FROM pages)")
def detect_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.regexp_extract(F.regexp_extract("url", "^[^?#]*", 0), r"\.([a-z0-9]+)$", 1)
    return tables.table(spark, sf_dir, "pages").select("page_id", content_type_of_extension(extension).alias("kind"))


def code_sql(text: str) -> str:
    from lodestone.functions.text import CODE_MARKS

    bare = STRIP.format("l")
    marks = " OR ".join(f"contains(l, '{m}')" for m in CODE_MARKS)
    return f"CASE WHEN length({text}) > 0 AND len(list_filter(string_split({text}, chr(10))[1:20], lambda l: ends_with({bare}, '{{') OR ends_with({bare}, ';') OR starts_with({bare}, '}}') OR {marks})) > 0.3 * len(string_split({text}, chr(10))[1:20]) THEN 'code' ELSE 'text' END"


@query(f"SELECT 'page' AS origin, page_id AS id, {code_sql('html')} AS kind FROM pages UNION ALL SELECT 'document', doc_id, {code_sql('text')} FROM documents")
def detect_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = tables.table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), content_type_of_text(F.col("html")).alias("kind"))
    return html.union(tables.table(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", content_type_of_text(F.col("text"))))


@query(f"SELECT kind, CASE WHEN kind = 'text' THEN 384 ELSE 768 END AS dims, count(*)::BIGINT AS n FROM (SELECT {code_sql('html')} AS kind FROM pages UNION ALL SELECT {code_sql('text')} FROM documents) GROUP BY kind")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = detect_content(spark, sf_dir)
    return kinds.groupBy("kind").agg(F.count("*").alias("n")).withColumn("dims", F.when(F.col("kind") == "text", 384).otherwise(768))


PAIRS = """v AS (SELECT vec_id, label AS doc, embedding::DOUBLE[] AS v FROM embeddings), asked AS (SELECT vec_id AS qid, v AS q FROM v WHERE vec_id % 100 = 0),
pairs AS (SELECT qid, doc, vec_id AS chunk, list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) AS score FROM v, asked),
best AS (SELECT qid, doc, max(score) AS score, arg_min(chunk, (-round(score, 9), chunk)) AS best_chunk FROM pairs GROUP BY qid, doc)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as the chunks of a document; every vector whose id is divisible by 100 asks."""
    v = tables.vectors(spark, sf_dir).select(F.col("id").cast("bigint").alias("chunk"), F.col("label").alias("doc"), "v")
    return chunks.pair_scores(v, v.where("chunk % 100 = 0").select(F.col("chunk").alias("qid"), F.col("v").alias("q")))


@query(f"WITH {PAIRS} SELECT qid, doc, round(score, 6) AS score, best_chunk FROM best")
def maxsim_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.max_sim(_pairs(spark, sf_dir)).select("qid", "doc", F.round("score", 6).alias("score"), "best_chunk")


@query(f"WITH {PAIRS} SELECT doc, round(avg(score), 6) AS score FROM best GROUP BY doc")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.late_interaction(_pairs(spark, sf_dir)).select("doc", F.round("score", 6).alias("score"))


# --- store -----------------------------------------------------------------------------


@query("SELECT DISTINCT sha256(text) AS object_id, strlen(text)::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL")
def object_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.objects(tables.table(spark, sf_dir, "documents").select("text"), "text").select("object_id", F.octet_length("data").cast("bigint").alias("n_bytes"))


@query("SELECT label::VARCHAR AS cluster_id, vec_id::VARCHAR AS node_id FROM embeddings")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = tables.vectors(spark, sf_dir).groupBy(F.col("label").cast("string").alias("id")).agg(F.collect_list("id").alias("members"))
    return store.members(clusters)


@query("SELECT d.doc_id::VARCHAR AS id, coalesce(n, 0)::BIGINT AS n_supports FROM documents d LEFT JOIN (SELECT vec_id, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY vec_id) e ON e.vec_id = d.doc_id")
def justifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the even vectors of their id as supports; none: an empty list."""
    supports = tables.vectors(spark, sf_dir).where(F.col("id").cast("bigint") % 2 == 0).groupBy(F.col("id").alias("node_id")).agg(F.collect_list(F.concat(F.lit("v"), "id")).alias("supports"))
    return store.justifications(tables.nodes(spark, sf_dir).select("id"), supports).select("id", F.size("supports").cast("bigint").alias("n_supports"))


@query(f"WITH {EDGES} SELECT 'nodes' AS what, (SELECT count(*) FROM documents)::BIGINT AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM edges) UNION ALL SELECT 'object_bytes', (SELECT sum(strlen(t)) FROM (SELECT DISTINCT text AS t FROM documents))::BIGINT UNION ALL SELECT 'clusters', (SELECT count(DISTINCT label) FROM embeddings)")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = store.objects(tables.table(spark, sf_dir, "documents").select("text"), "text")
    clusters = tables.vectors(spark, sf_dir).select("label").distinct()
    return store.statistics(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), blobs, clusters)


@query(f"WITH {NODES} SELECT id, node_type, strftime(tx_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS tx_time, confidence FROM nodes")
def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as they are shown, times in RFC 3339."""
    return store.records(tables.nodes(spark, sf_dir)).select("id", "node_type", "tx_time", "confidence")


@query(f"WITH {SPACES}, held AS (SELECT ws_id, count(*) AS held FROM members WHERE access = 'shared' GROUP BY ws_id), fresh AS (SELECT ws_id, node_id, row_number() OVER (PARTITION BY ws_id ORDER BY node_id) AS r FROM members WHERE access <> 'shared') SELECT ws_id, node_id, coalesce(held, 0) + r - 1 < 50 AS ok FROM fresh LEFT JOIN held USING (ws_id)")
def ws_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are not shared asked to join those that are, up to each workspace's capacity."""
    members = tables.ws_nodes(spark, sf_dir)
    return workspaces.added(members.where("access = 'shared'"), tables.workspaces(spark, sf_dir), members.where("access <> 'shared'"), F.lit(LATER).cast("timestamp"))[1]


@query(f"WITH {SPACES} SELECT ws_id, node_id FROM members WHERE access <> 'group'")
def ws_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = tables.ws_nodes(spark, sf_dir)
    return workspaces.removed(members, members.where("access = 'group'")).select("ws_id", "node_id")


@query(f"WITH {PAIRS} SELECT * FROM (SELECT qid, doc, round(score, 6) AS score, best_chunk, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc) AS rank FROM best) WHERE rank <= 3")
def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.vectors(spark, sf_dir).select(F.col("id").cast("bigint").alias("chunk"), F.col("label").alias("doc"), "v")
    return chunks.rank_documents(v, v.where("chunk % 100 = 0").select(F.col("chunk").alias("qid"), F.col("v").alias("q")), 3)


@query(f"WITH {NODES} SELECT id FROM (SELECT * FROM nodes WHERE node_type = 'document' ORDER BY id LIMIT 80) WHERE list_contains(tags, 'project:src3') ORDER BY id LIMIT 20")
def list_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listed(tables.nodes(spark, sf_dir), "document", 20, "src3").select("id")


@query("WITH r AS (SELECT doc_id, text, strlen(text) AS n FROM documents) SELECT doc_id::VARCHAR AS id, length(text) AS chars, strlen(text) <= 200 AS whole FROM r")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a 200-byte preview holds the whole body."""
    nodes = tables.nodes(spark, sf_dir)
    return nodes.select("id", F.length("body").cast("bigint").alias("chars"), (utf8_prefix(F.col("body"), 200) == F.col("body")).alias("whole"))


# --- watching and pages ----------------------------------------------------------------


def _file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events(spark, sf_dir)
    return e.select("event_id", F.col("user_id").alias("path"), "ts", F.sha2("props", 256).alias("hash"))


@query("SELECT event_id, user_id AS path FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 1 HOUR")
def watch_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.debounced(_file_events(spark, sf_dir), 3_600_000_000).select("event_id", "path")


@query("SELECT event_id, user_id AS path FROM (SELECT *, lag(sha256(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> sha256(props)")
def watch_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.changed(_file_events(spark, sf_dir)).select("event_id", "path")


@query(r"SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages) WHERE regexp_extract(path, '([^/]+)$', 1) LIKE '%_.html' AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'target', 'de'])")
def watch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths as file paths: html only, and nothing under `de`."""
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return tables.table(spark, sf_dir, "pages").where(watch.watched(path, ("html",), (".git", "node_modules", "target", "de"))).select("page_id")


@query(rf"SELECT page_id, {STRIP.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")
def url_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.read(tables.table(spark, sf_dir, "pages")).select("page_id", "title")


@query(None)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes made from pages: title and text without markup."""
    made = pages.as_nodes(pages.read(tables.table(spark, sf_dir, "pages")))
    return made.select("id", "node_type", F.length(strip(F.col("body"))).alias("chars"), F.sha2("body", 256).alias("digest"))
