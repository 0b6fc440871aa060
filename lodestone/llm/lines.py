"""Line dedup (operator 1) by winnowing over line hashes, with DataFrame functions only.

A line is trimmed of blanks, tabs and carriage returns and hashed; blank lines take no part
and stay. A run is `min_lines` or more consecutive lines, or fewer that hold `min_words` words
or more (words as parted by single blanks). A line goes if it lies in a run that also occurs
earlier, in a smaller document or further up in the same one; the first occurrence stays.

Winnowing: of every `min_lines` consecutive hashes (and of every shorter run of enough words) the
least, the leftmost on ties, is selected. Equal runs select the same line, so any run that is
shared shares a selected fingerprint. Only selected positions become rows. Fingerprints are
counted (map-side first), and positions whose fingerprint occurs once go no further. From the
others the match is extended to both sides: each run that its line was selected from, to the left
and to the right of it, is joined to the run's first occurrence, all lines compared by their hashes. What is
removed of a longer repeat is the chain of such overlapping matches, so the work is linear in
the lines, however often and in however many places they repeat. No pairs are made: positions
meet their first occurrence, not each other.

Null and empty texts have no lines. Documents with fewer lines than a run lose none. Ties:
occurrences are ordered by id, then text hash, then line; a null id comes first. Rows that
repeat id and text count as one document and get the same result. Texts of any length are worked
on in one pass over their lines; an empty table gives an empty one. Input columns named as
results are (in any case) are replaced.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ID, TH, cut, keyed, table, with_columns_of

MIN_LINES, MIN_WORDS = 3, 50


def _content(lines: Column) -> Column:
    """Non-blank lines: their place among all lines, and the line, trimmed."""
    marked = F.transform(lines, lambda line, i: F.struct(i.cast("int").alias("at"), F.btrim(line, F.lit(" \t\r")).alias("line")))
    return F.filter(marked, lambda x: x["line"] != "")


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Identity columns, `h` (hashes of the lines that are not blank) and `k` (their words)."""
    words = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    both = F.transform(_content(_lines(text)), lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), words(x["line"]).alias("k")))
    rows = docs.select(ID, TH, both.alias("lines")).where(F.size("lines") > 0)
    return cut(rows.select(ID, TH, F.col("lines.h").alias("h"), F.col("lines.k").alias("k")))


def selected(hashes: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """Identity, `print` and `runs` of each selected position: (start, n, w1, w2) of the runs it was selected from."""

    def runs_at(p: Column) -> Column:
        """The runs whose leftmost least hash is at this place."""
        runs = []
        for n in range(1, min_lines + 1):
            for before in range(n):
                at = [p + (j - before) for j in range(n)]
                h = [F.get("h", i) for i in at]
                fits = (p >= before) & (at[-1] < F.size("h"))
                if n < min_lines:
                    fits = fits & (functools.reduce(operator.add, [F.get("k", i) for i in at]) >= min_words)
                for j in range(n):
                    if j != before:
                        fits = fits & (h[j] > h[before] if j < before else h[j] >= h[before])
                runs.append(F.when(fits, F.struct((p - before).alias("start"), F.lit(n).alias("n"), F.xxhash64(*h).alias("w1"), F.xxhash64(F.lit(1), *h).alias("w2"))))
        return F.filter(F.array(*runs), lambda r: r.isNotNull())

    positions = F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda p: F.struct(F.get("h", p).alias("print"), runs_at(p).alias("runs")))
    rows = hashes.select(ID, TH, F.explode(F.filter(positions, lambda x: F.size(x["runs"]) > 0)).alias("p"))
    return rows.select(ID, TH, "p.print", "p.runs")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Identity columns and `gone`: (start, n) of the later repeats, counted in lines that are not blank."""
    positions = cut(selected(line_hashes(docs, text), min_lines, min_words))
    twice = cut(positions.groupBy("print").agg(F.count("*").alias("times")).where("times > 1").select("print"))
    # Written once, as it is read twice: positions would else be shuffled for each reading.
    extended = cut(positions.join(twice, "print").select(ID, TH, F.inline("runs")))
    where = F.struct(ID, TH, "start")
    firsts = cut(extended.groupBy("n", "w1", "w2").agg(F.min(where).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    later = extended.join(firsts, ["n", "w1", "w2"]).where(where > F.col("first"))
    return later.groupBy(ID, TH).agg(F.collect_set(F.struct("start", "n")).alias("gone"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with `n_lines` (not blank), `n_removed` and the kept lines as `kept_text`."""
    rows = keyed(docs, doc_id, text)
    gone = repeated_lines(rows, min_lines, text, min_words)
    a, b = rows.alias("a"), gone.alias("b")
    joined = a.join(b, F.col(f"a.{ID}").eqNullSafe(F.col(f"b.{ID}")) & (F.col(f"a.{TH}") == F.col(f"b.{TH}")), "left")
    joined = joined.select(*[F.col(f"a.`{c}`") for c in docs.columns], F.coalesce("b.gone", F.array().cast("array<struct<start:int,n:int>>")).alias("__gone"))
    # Each is used twice below, so Spark makes it once for a row and not once for each line.
    split = joined.withColumn("__lines", _lines(text))
    placed = split.withColumn("__places", F.transform(_content(F.col("__lines")), lambda x: x["at"]))
    removed = F.array_distinct(F.flatten(F.transform("__gone", lambda r: F.slice(F.col("__places"), r["start"] + 1, r["n"]))))
    worked = placed.withColumn("__removed", removed)
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed"))
    kept = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    kept = F.when(F.size("__removed") == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(kept)
    out = {"n_lines": F.size("__places").cast("long"), "n_removed": F.size("__removed").cast("long"), "kept_text": kept}
    return with_columns_of(worked, out).drop("__gone", "__lines", "__places", "__removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH all_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), content AS (
  SELECT doc_id, place, line, length(line) - length(replace(line, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos
  FROM (SELECT doc_id, place, trim(line, ' ' || chr(9) || chr(13)) AS line FROM all_lines) WHERE line <> ''
), windows AS (
  SELECT a.doc_id, a.pos, 3 AS n, a.line || chr(10) || b.line || chr(10) || c.line AS w
  FROM content a JOIN content b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN content c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2
  UNION ALL SELECT a.doc_id, a.pos, 2, a.line || chr(10) || b.line FROM content a JOIN content b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.words + b.words >= 50
  UNION ALL SELECT doc_id, pos, 1, line FROM content WHERE words >= 50
), later AS (
  SELECT doc_id, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY n, w ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT c.doc_id, c.place FROM later l JOIN content c ON c.doc_id = l.doc_id AND c.pos BETWEEN l.pos AND l.pos + l.n - 1
), kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.place) AS text
  FROM all_lines a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.place = g.place WHERE g.place IS NULL GROUP BY a.doc_id
)
SELECT d.doc_id,
  coalesce((SELECT count(*) FROM content c WHERE c.doc_id = d.doc_id), 0)::BIGINT AS n_lines,
  coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0)::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
