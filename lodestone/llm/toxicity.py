"""Toxicity (operator 7): noisy-channel deobfuscation before scoring.

1. A character model: counts of letter triples over all documents, in a table of fixed size,
   so it follows the corpus whatever its length. Letters of every script have classes.
2. Suspicious spots of a text (digits or signs inside a word, letters of another script that look
   like Latin ones beside Latin ones, three or more equal letters in a row, letters spelled out
   with blanks, dots or dashes, alone or with the short pieces beside them) become lattices: each
   character may stand for itself or for a letter it looks like, repeats may be dropped. A sign that
   looks like a letter may be dropped too, for a fixed cost and what a letter costs on average, so
   that shorter words have no advantage. Viterbi finds the likeliest letters under the character
   model and the channel's costs.
3. Words as written and as restored are scored together. A feature (word, its first 4 and 5
   letters) weighs what its documents say: the lower bound of its log odds between toxic and
   clean labelled documents. A document's two strongest weights go through a logistic curve;
   all features take part in finding them.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, of those a
sample by hash of about `sample` labelled documents (everything else covers all documents).
The sample bounds what is broadcast and what comes to the driver: labels of the sample, its
features of more than e-fold odds, two numbers for each sampled document, and the fixed table.

Null and empty texts get the score of a document without any toxic feature. Null labels are
left out; of several labels of a document the largest holds. Rows are scored one by one, so
repeated rows get equal scores; a null doc_id counts as the empty string in `held_out`. With
no labels of one kind the score is the (smoothed) share of toxic labels. Texts of any length go
through whole; empty tables give an empty result. `scores` takes `doc_id` and `text` only, so other
columns cannot clash; `drop_toxic` keeps all columns as they are.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import arrow_rows, held, holds_nothing, pieces_of
from lodestone.llm.common import table

SAMPLE = 30_000
#: Words and spots of at most LONGEST characters that a worker remembers before it starts anew (about 10 MB).
REMEMBERED, LONGEST = 50_000, 48
#: Features that a task counts before it sends their counts on, and those sent at a time.
COUNTED, SENT = 50_000, 10_000
#: Letters that other characters are written for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e"}
#: Letters of other scripts and the Latin ones they look like.
LIKE = dict(zip("аеорсхуіѕкмтнвԁοαειντυκχρ", "aeopcxyiskmthbdoaeivtukxp"))
WORD = re.compile(r"[^\W\d_]+")
STRAY = re.compile(r"[^\W\d_]|[0-9@$!|+€]")
CLASSES, CODES = 64, 0x20000


def letter_classes() -> np.ndarray:
    """A class for each code point under CODES: 0 for what is no letter, 1 to 63 for letters."""
    return np.array([(c - 96 if 97 <= c <= 122 else 27 + c % 37) if chr(c).isalpha() else 0 for c in range(CODES)], np.int64)


CLASS_OF = letter_classes()
#: 1 for signs that stand for letters before or between letters, 2 for digits, which also do so at a word's end.
SIGN_OF = np.zeros(CODES, np.int8)
SIGN_OF[[ord(c) for c in LOOKS]] = 1
SIGN_OF[48:58] = 2
LIKE_OF = np.zeros(CODES, bool)
LIKE_OF[[ord(c) for c in LIKE]] = True


def codes_of(text: str) -> np.ndarray:
    """Code points of a text, 0 for those from CODES on."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < CODES, codes, 0)


def suspects(low: str) -> set[str]:
    """Suspicious spots: words with signs in them or three equal letters in a row, and letters spelled out."""
    codes = codes_of(f"  {low}  ")
    letter, sign = CLASS_OF[codes] > 0, SIGN_OF[codes]
    here = slice(1, -1)
    odd = (sign[here] > 0) & letter[2:] | (sign[here] > 1) & letter[:-2]
    odd |= letter[here] & (codes[here] == codes[:-2]) & (codes[here] == codes[2:])
    like = LIKE_OF[codes]
    if like.any():
        latin = letter & (codes < 0x250)
        odd |= like[here] & (latin[:-2] | latin[2:])
    found: set[str] = set()
    at = np.flatnonzero(odd) + 1
    if len(at):
        breaks = np.flatnonzero(~(letter | (sign > 0)))
        k = np.searchsorted(breaks, at)
        for begin, end in {*zip((breaks[k - 1] + 1).tolist(), breaks[k].tolist())}:
            found.add(low[begin - 2 : end - 2].rstrip("!|+"))
    alone = np.zeros(len(codes), bool)
    alone[here] = letter[here] & ~letter[:-2] & ~letter[2:]
    spelled = np.flatnonzero(alone[:-4] & alone[2:-2] & alone[4:])
    if len(spelled):
        gaps = np.flatnonzero(np.diff(spelled) != 2)
        for begin, end in zip(spelled[np.concatenate([[0], gaps + 1])].tolist(), spelled[np.append(gaps, len(spelled) - 1)].tolist()):
            found.update(spelled_out(low, begin - 2, end + 5 - 2))
    return found


def piece_beside(low: str, at: int, step: int, blanks: bool) -> int:
    """Where a piece of at most three letters ends that one sign parts from a place; the place itself if there is none."""
    sign = at - 1 if step < 0 else at
    if not 0 < sign < len(low) - 1 or low[sign].isalnum() or (low[sign].isspace() and not blanks):
        return at
    n = 0
    while n < 4 and 0 <= sign + step * (n + 1) < len(low) and low[sign + step * (n + 1)].isalpha():
        n += 1
    return at if not 0 < n < 4 else at - 1 - n if step < 0 else at + 1 + n


def spelled_out(low: str, begin: int, end: int) -> set[str]:
    """A run of letters that stand alone, and the run with the short pieces beside it."""
    first, last = begin, end
    while (further := piece_beside(low, first, -1, False)) != first:
        first = further
    while (further := piece_beside(low, last, 1, False)) != last:
        last = further
    before, after = piece_beside(low, first, -1, True), piece_beside(low, last, 1, True)
    inner = {low[begin + 2 : end], low[begin : end - 2]} if end - begin > 7 else set()  # a word of one letter may stand beside it
    return {low[begin:end], low[first:last], low[before:last], low[first:after], low[before:after]} | inner


def classes_of(text: str) -> np.ndarray:
    return CLASS_OF[codes_of(text)]


def triple_counts(docs: DataFrame) -> DataFrame:
    """`triple`, `n`: how often each triple of letter classes occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_nothing("triples")
        total = np.zeros(CLASSES**3, np.int64)
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            c = np.concatenate([classes_of(f"  {(t or '').lower()}  ") for t in batch.column(0).to_pylist()] or [np.zeros(2, np.int64)])
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["triple", "n"])

    return docs.select("text").mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def triple_costs(counts: list[tuple[int, int]]) -> np.ndarray:
    """-log P(third | first two), smoothed, as a table of CLASSES^3; [0, 0, 0], which no path asks for, is a letter's mean."""
    n = np.full(CLASSES**3, 0.1)
    for triple, k in counts:
        n[triple] += k
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    costs = -np.log(n / n.sum(axis=2, keepdims=True))
    costs[0, 0, 0] = (n[:, :, 1:] * costs[:, :, 1:]).sum() / n[:, :, 1:].sum()
    return costs


#: What the channel costs: a sign for a letter, a letter of another script, a dropped repeat, a dropped sign.
SIGN, ALIKE, REPEAT, LOST = 1.0, 0.5, 0.2, 8.0


def options_of(signs: list[str], at: int, mean: float) -> list[tuple[str, float]]:
    """What a character may stand for (nothing: ''), with the channel's cost; mean: what a letter costs."""
    sign = signs[at]
    if sign.isalpha():
        options = [(sign, 0.0)] + ([(LIKE[sign], ALIKE)] if sign in LIKE else [])
        return options + ([("", REPEAT)] if at and signs[at - 1] == sign else [])
    return [(c, SIGN) for c in LOOKS.get(sign, "")] + [("", LOST + mean if sign in LOOKS else SIGN)]


class Restorer(dict):
    """The likeliest letters of a suspicious spot, remembered by its spelling."""

    def __init__(self, costs: np.ndarray):
        super().__init__()
        self.costs, self.mean = costs.tolist(), float(costs[0, 0, 0])

    def __missing__(self, spot: str) -> str:
        out = self.viterbi(STRAY.findall(spot))[1]
        if len(spot) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[spot] = out
        return out

    def viterbi(self, signs: list[str]) -> tuple[float, str]:
        """Letters of least cost, and their cost; a state is the last two letter classes.

        Each step keeps where its states came from, so that long spots cost no copies of their beginning.
        """
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}
        steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        for at in range(len(signs)):
            after: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            options = options_of(signs, at, self.mean)
            for (a, b), cost in states.items():
                for letter, extra in options:
                    if letter:
                        c = int(CLASS_OF[ord(letter)]) if ord(letter) < CODES else 0
                        key, value = (b, c), cost + extra + (self.costs[a][b][c] if a or b or c else self.mean)
                    else:
                        key, value = (a, b), cost + extra
                    if key not in after or value < after[key]:
                        after[key], came[key] = value, ((a, b), letter)
            states = after
            steps.append(came)
        total, at = min((cost + (self.costs[a][b][0] if a or b else 0.0), (a, b)) for (a, b), cost in states.items())
        letters = []
        for came in reversed(steps):
            at, letter = came[at]
            letters.append(letter)
        return total, "".join(reversed(letters))


def words_of(text: str | None, restorer: Restorer) -> set[str]:
    """Words as written, and as restored where they are suspicious."""
    low = (text or "").lower()
    words = set(WORD.findall(low))
    words.update(map(restorer.__getitem__, suspects(low)))
    return words


def features_of(word: str) -> tuple[str, ...]:
    return ("=" + word, word[:4], word[:5]) if len(word) > 4 else ("=" + word, word)


class Weights(dict):
    """A word's strongest feature weight."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        w = max(self.weights.get(f, 0.0) for f in features_of(word))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = w
        return w

    def evidence(self, words: set[str]) -> tuple[float, float]:
        """The two strongest weights of a document."""
        found = sorted((w for w in map(self.__getitem__, words) if w > 0), reverse=True)
        top = [*found[:2], 0.0, 0.0]
        return top[0], top[1]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About `sample` labelled ids outside the held-out fold, chosen by hash."""
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, usable.count()))
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def logistic(rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve (the first is the constant), with a small penalty."""
    x = np.column_stack([np.ones(len(rows)), rows])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - target) + 0.1 * beta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(beta)), grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Model:
    """What a worker needs to score a text."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], beta: list[float]):
        self.restorer, self.weights, self.beta = Restorer(costs), Weights(weights), beta

    def score(self, text: str | None) -> float:
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], self.weights.evidence(words_of(text, self.restorer))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def model_of(shared: Broadcast) -> Model:
    return held("toxicity", shared.value[0], lambda: Model(*shared.value[1:]))


def feature_counts(batches: Iterator[pa.RecordBatch], restorer: Restorer) -> Iterator[pa.RecordBatch]:
    """`feature`, `toxic`, `clean`: documents (`text`, `toxic`) with a feature, of each label; '' is in all.

    A feature may come more than once, with counts to be added: what a task holds doesn't grow with its texts.
    """
    seen, types = (Counter(), Counter()), {"feature": pa.string(), "toxic": pa.int64(), "clean": pa.int64()}

    def so_far() -> Iterator[pa.RecordBatch]:
        features = [*(seen[0].keys() | seen[1].keys())]
        for at in range(0, len(features), SENT):
            yield arrow_rows([(f, seen[1][f], seen[0][f]) for f in features[at : at + SENT]], types)
        for side in seen:
            side.clear()

    for batch in (piece for whole in batches for piece in pieces_of(whole)):
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            side = seen[int(toxic > 0)]
            side[""] += 1
            side.update({f for w in words_of(text, restorer) for f in features_of(w)})
            if len(seen[0]) + len(seen[1]) > COUNTED:
                yield from so_far()
    yield from so_far()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Broadcast:
    """The character model from all docs and the classifier from the labelled sample."""
    spark = docs.sparkSession
    costs = triple_costs([(r[0], r[1]) for r in triple_counts(docs).collect()])
    shared_costs = spark.sparkContext.broadcast((uuid.uuid4().hex, costs, {}, [0.0] * 3))
    rows = docs.select("doc_id", "text").join(F.broadcast(training_sample(labels, sample)), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return feature_counts(batches, model_of(shared_costs).restorer)

    counts = rows.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0"))
    # Features of one toxic document or none say nothing; the document counts are the feature ''.
    counts = counts.where("n1 > 1 or feature = ''").cache()
    totals = counts.where("feature = ''").first()
    n1, n0 = (totals["n1"], totals["n0"]) if totals else (0, 0)
    odds = F.log((F.col("n1") + 0.5) / (F.col("n0") + 0.5)) - math.log((n1 + 1) / (n0 + 1))
    weight = odds - F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    strong = counts.where("feature <> ''").select("feature", weight.alias("w")).where("w > 1")
    weights = {r[0]: r[1] for r in strong.collect()}
    counts.unpersist()

    beta = [math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -3.0, 0.0, 0.0]
    if n1 and n0:
        unfit = spark.sparkContext.broadcast((uuid.uuid4().hex, costs, weights, beta))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = model_of(unfit)
            for batch in (piece for whole in batches for piece in pieces_of(whole)):
                out = [(*model.weights.evidence(words_of(t, model.restorer)), float(y > 0)) for t, y in zip(*(c.to_pylist() for c in batch.columns))]
                yield arrow_rows(out, {"a": pa.float64(), "b": pa.float64(), "y": pa.float64()})

        points = np.array([tuple(r) for r in rows.mapInArrow(measure, "a double, b double, y double").collect()])
        beta = logistic(points[:, :2], points[:, 2]).tolist()
    return spark.sparkContext.broadcast((uuid.uuid4().hex, costs, weights, beta))


def scores(docs: DataFrame, model: Broadcast) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted`, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model_of(model)
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            out = [scorer.score(t) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return chosen.mapInArrow(run, chosen.drop("text").schema.add("score", "double").add("predicted", "integer"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents that the classifier calls toxic; rows are judged where they lie."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model_of(model)
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
