"""Full-text search: BM25 over postings.

A query is a table (`qid`, `term`) or a clause: terms, phrases, ranges and tags of a field, put
together with `all_of`, `any_of` and `none_of`, each with a boost of its own. Terms join postings,
so only matching postings are shuffled and scored; the corpus statistics are two numbers and one
row for each term. Postings can be stored (`stored_postings`): a search then reads the pages of
its terms alone and no text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

K1, B = 1.2, 0.75
#: Terms whose weights are broadcast.
FEW = 100_000


def field_tokens(nodes: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """`id`, `field`, `tokens`: the token list of each field that has any."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), tokens(text).alias("tokens")) for name, text in fields.items()])
    return nodes.select("id", F.inline(parts)).where(F.size("tokens") > 0)


def body_and_tags() -> dict[str, Column]:
    return {"body": F.col("body"), "tags": F.concat_ws(" ", "tags")}


def postings(indexed: DataFrame) -> DataFrame:
    """`id`, `field`, `term`, `tf`, `dl` and the sorted `positions` of each term in each field."""
    each = indexed.select("id", "field", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))
    return each.groupBy("id", "field", "term", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def statistics(indexed: DataFrame) -> DataFrame:
    """`field`, `n` and `avgdl`. Documents without tokens in a field are not counted for it."""
    return indexed.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def if_few(df: DataFrame, terms: DataFrame) -> DataFrame:
    """df, to be broadcast if the terms are few: rows with a frequent term then stay where they lie."""
    return F.broadcast(df) if terms.select("term").distinct().limit(FEW + 1).count() <= FEW else df


def matching(indexed: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the asked terms only: the filter comes before the shuffle."""
    each = indexed.select("id", "field", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    asked = if_few(terms.select("term").distinct(), terms)
    # Dealt by document, so that its postings and its scores for all queries are made where they lie.
    return each.join(asked, "term", "left_semi").repartition("id").groupBy("id", "field", "term", "dl").agg(F.count("*").alias("tf"))


def bm25_of(found: DataFrame, statistics: DataFrame, queries: DataFrame) -> DataFrame:
    """`qid`, `id`, `score` from the postings of the asked terms and the fields' statistics; fields' scores add up.

    Queries may have a `weight` for each term. Statistics have one row a field, so they are broadcast.
    """
    asked = queries.select("qid", "term", (F.col("weight") if "weight" in queries.columns else F.lit(1.0)).alias("weight"))
    asked = asked.groupBy("qid", "term").agg(F.max("weight").alias("weight"))
    frequency = found.groupBy("field", "term").agg(F.count("*").alias("df"))
    weights = frequency.join(F.broadcast(statistics), "field").withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # One row a term with all its queries.
    asking = asked.groupBy("term").agg(F.collect_list(F.struct("qid", "weight")).alias("asking"))
    weights = weights.select("field", "term", "idf", "avgdl").join(asking, "term")
    tf, dl = F.col("tf"), F.col("dl")
    score = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    scored = found.join(if_few(weights, queries), ["field", "term"]).select("id", score.alias("part"), F.inline("asking"))
    return scored.groupBy("qid", "id").agg(F.sum(F.col("part") * F.col("weight")).alias("score"))


def bm25(indexed: DataFrame, queries: DataFrame) -> DataFrame:
    """`qid`, `id`, `score`: all matches of each query in texts that are tokenised now."""
    return bm25_of(matching(indexed, queries), statistics(indexed), queries)


STORED = "id string, field string, term string, dl int, tf bigint, positions array<int>"
LENGTHS = "id string, field string, dl int"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once and not at each of its places."""
    return F.transform(F.array(value), use)[0]


def terms_of(tokens_of: Column) -> Column:
    """Array of (term, sorted positions) of a token list: tokens are sorted, each run of equal ones is a term."""

    def runs(terms: Column, places: Column) -> Column:
        starts = F.array_compact(F.transform(terms, lambda t, i: F.when((i == 0) | (t != F.get(terms, i - 1)), i)))
        until = lambda ends, j: F.coalesce(F.get(ends, j + 1), F.size(terms))
        return _bound(starts, lambda s: F.transform(s, lambda at, j: F.struct(F.get(terms, at).alias("term"), F.slice(places, at + 1, until(s, j) - at).alias("positions"))))

    placed = F.sort_array(F.transform(tokens_of, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    return _bound(placed, lambda p: _bound(p["term"], lambda terms: _bound(p["pos"], lambda places: runs(terms, places))))


def stored_postings(indexed: DataFrame) -> DataFrame:
    """Postings of each row, made and sorted for writing where its text lies: in each file few pages hold a term.

    Nothing is shuffled, so what lies on disk besides the result is what tasks that run now sort. Rows that share
    id, field and length are put together by `of_terms`.
    """
    # Tokens end here: they would be copied once for each term.
    rows = indexed.where(F.size("tokens") > 0).select("id", "field", F.size("tokens").alias("dl"), terms_of(F.col("tokens")).alias("terms"))
    # Not inline, for which the plan makes the terms twice, first to see whether there are any.
    each = rows.select("id", "field", "dl", F.inline_outer("terms"))
    return each.select("id", "field", "term", "dl", F.size("positions").cast("bigint").alias("tf"), "positions").sortWithinPartitions("term")


def of_terms(stored: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of the asked terms from stored postings, as `matching` makes them from texts."""
    each = stored.where(term_filter(terms)).select("id", "field", "term", "dl", "tf")
    return each.repartition("id").groupBy("id", "field", "term", "dl").agg(F.sum("tf").alias("tf"))


def lengths(indexed: DataFrame) -> DataFrame:
    """`id`, `field`, `dl`: what field statistics are made of."""
    return indexed.select("id", "field", F.size("tokens").alias("dl"))


def stored_lengths(stored: DataFrame) -> DataFrame:
    """The same from stored postings: each text has one that begins it."""
    return stored.where(F.col("positions")[0] == 0).select("id", "field", "dl")


def statistics_of(lengths_of: DataFrame) -> DataFrame:
    return lengths_of.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_filter(terms: list[str]) -> str:
    """A condition on stored postings that reaches the scan."""
    quoted = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms)
    return f"term IN ({quoted})" if terms else "false"


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id, with `rank` from 1."""
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def boolean(indexed: DataFrame, must: tuple[str, ...] = (), should: tuple[str, ...] = (), must_not: tuple[str, ...] = (), field: str = "body") -> DataFrame:
    """Ids of documents that hold all of must, one of should (if must is empty), none of must_not."""
    held = lambda t: F.array_contains("tokens", t)
    keep = F.lit(True)
    for t in must:
        keep = keep & held(t)
    if should and not must:
        keep = keep & F.arrays_overlap("tokens", F.array(*map(F.lit, should)))
    for t in must_not:
        keep = keep & ~held(t)
    return indexed.where((F.col("field") == field) & keep).select("id")


def phrase(indexed: DataFrame, words: tuple[str, ...], field: str = "body") -> DataFrame:
    """`id`, `n`: documents that hold the words one after another, and how often."""
    wanted = F.array(*map(F.lit, words))
    ends = F.sequence(F.lit(1), F.size("tokens") - len(words) + 1)
    starts = F.filter(ends, lambda i: F.slice("tokens", i, F.lit(len(words))) == wanted)
    long_enough = indexed.where((F.col("field") == field) & (F.size("tokens") >= len(words)) & F.array_contains("tokens", words[0]))
    return long_enough.select("id", F.size(starts).cast("bigint").alias("n")).where("n > 0")


class Clause:
    """A query over tokenised fields: which documents match (`holds`), and its terms with their weights.

    `holds(fields)` gives a condition over columns that hold each field's tokens.
    """

    def __init__(self, holds, terms: dict[str, float]):
        self.holds, self.terms = holds, terms

    def boosted(self, factor: float) -> Clause:
        return Clause(self.holds, {t: w * factor for t, w in self.terms.items()})


def _union(clauses: tuple[Clause, ...]) -> dict[str, float]:
    out: dict[str, float] = {}
    for c in clauses:
        for t, w in c.terms.items():
            out[t] = max(w, out.get(t, w))
    return out


def word(term: str, field: str = "body") -> Clause:
    """A term of a field."""
    return Clause(lambda fields: F.array_contains(fields[field], term.lower()), {term.lower(): 1.0})


def words_in_turn(text: str, field: str = "body") -> Clause:
    """A phrase, or a tag of several words."""
    parts = re.findall(r"[^\W_]+", text.lower())
    wanted = F.array(*map(F.lit, parts))
    n = len(parts)

    def holds(fields: dict[str, Column]) -> Column:
        tokens_of = fields[field]
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens_of) - n + 1, F.lit(1)))
        return F.array_contains(tokens_of, parts[0]) & F.exists(starts, lambda i: F.slice(tokens_of, i, F.lit(n)) == wanted) if parts else F.lit(False)

    return Clause(holds, dict.fromkeys(parts, 1.0))


def between(low: str, high: str, field: str = "body") -> Clause:
    """Some term of a field from low to high, both included."""
    return Clause(lambda fields: F.exists(fields[field], lambda t: t.between(low, high)), {})


def all_of(*clauses: Clause) -> Clause:
    return Clause(lambda fields: functools.reduce(lambda a, c: a & c.holds(fields), clauses, F.lit(True)), _union(clauses))


def any_of(*clauses: Clause) -> Clause:
    return Clause(lambda fields: functools.reduce(lambda a, c: a | c.holds(fields), clauses, F.lit(False)), _union(clauses))


def none_of(*clauses: Clause) -> Clause:
    return Clause(lambda fields: ~any_of(*clauses).holds(fields), {})


def search(indexed: DataFrame, clause: Clause, k: int, qid: int = 0) -> DataFrame:
    """The k best documents that match a clause, scored by its terms: `qid`, `id`, `score`, `rank`."""
    names = ("body", "tags")
    by_field = indexed.groupBy("id").agg(*[F.max(F.when(F.col("field") == n, F.col("tokens"))).alias(n) for n in names])
    fields = {n: F.coalesce(F.col(n), F.array().cast("array<string>")) for n in names}
    matched = by_field.where(clause.holds(fields)).select("id")
    terms = indexed.sparkSession.createDataFrame([(qid, t, float(w)) for t, w in clause.terms.items()], "qid bigint, term string, weight double")
    scored = bm25(indexed, terms)
    joined = matched.join(scored, "id", "left").select(F.lit(qid).cast("bigint").alias("qid"), "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return top(joined, k)
