"""BPE encoding and decoding (operator 3) by backtracking over longest matches.

The encoder never replays merges. An Aho-Corasick automaton over the vocabulary gives
the longest token that starts at each byte of a pre-token. Tokens are appended greedily
and a candidate is accepted only if it may stand beside its left neighbour: the pair is
*compatible* if merging the two tokens' bytes together would have split them at exactly
this border. When no shorter token fits either, the last token is taken back and its end
is marked as unreachable, so every position is tried once per token length and the work
is linear. The first sequence that reaches the end is the one that merging would give.

Decoding gathers each id's bytes through an offset table (start and length of every
token in one byte string), whole documents at a time.

Null texts count as empty: no ids, empty decoded text. Special tokens' strings in a text
become their ids, as the tokenizers library does. Rows are handled one by one, so repeated
rows, null ids and extra columns need no care; texts of any length go through whole. An empty
table gives an empty one. What a worker remembers is bounded in number and length. A tokenizer
file that asks for a normaliser, another split or other token flags is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.llm.arrays import held, pieces_of

#: The split pattern of byte-level BPE, with the white space of Unicode.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same split where a text has only letters and digits that both engines class alike.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u02ff]")
#: Pre-tokens of at most LONGEST characters, and pairs, that a worker remembers before it starts anew (about 20 MB each).
REMEMBERED, LONGEST, PAIRS = 100_000, 48, 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others get the letters from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Pairs(dict):
    """Which tokens may stand side by side, worked out when first asked."""

    def __init__(self, halves: list, merged: dict):
        super().__init__()
        self.halves, self.merged = halves, merged

    def __missing__(self, pair: tuple[int, int]) -> bool:
        """Would merging keep the border between these two tokens?

        Undo the later of the two tokens' merges next to the border again and again; the
        border would have been merged away if, before that merge, the pieces that touched
        it formed a pair of an earlier merge.
        """
        left, right = pair
        before, fits = len(self.halves), True
        while True:
            if (joined := self.merged.get((left, right))) is not None and joined < before:
                fits = False
                break
            if left <= right and self.halves[right]:
                before, right = right + 1, self.halves[right][0]
            elif self.halves[left]:
                before, left = left, self.halves[left][1]
            else:
                break
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = fits
        return fits


def check(model: dict) -> None:
    """Raise where a tokenizer file asks for what is not built in here."""
    before, tokens, kind = model.get("pre_tokenizer") or {}, model.get("added_tokens", []), model["model"]
    plain = not any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    asked = [kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    if model.get("normalizer") or not plain or not split or any(asked) or kind.get("type", "BPE") != "BPE":
        raise ValueError("only byte-level BPE without normaliser, prefix space or token flags is built in")


class Bpe(dict):
    """Encoder and decoder; as a dict, the ids (little-endian uint32 bytes) of pre-tokens."""

    def __init__(self, spec: str):
        super().__init__()
        model = json.loads(spec)
        check(model)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        letter = byte_letters()
        self.letters = dict(enumerate(letter))
        of_letter = {c: b for b, c in enumerate(letter)}
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        # Ranks order tokens by when they come to be: bytes first, then merges.
        parts = [(m.split(" ") if isinstance(m, str) else m) for m in merges]
        names = letter + [a + b for a, b in parts]
        self.rank = {name: r for r, name in reversed(list(enumerate(names)))}
        self.halves = [None] * 256 + [(self.rank[a], self.rank[b]) for a, b in parts]
        self.merged = {pair: r for r, pair in reversed(list(enumerate(self.halves))) if pair}
        self.length = [len(n) for n in names]
        self.shorter = [-1] * len(names)
        for r, name in enumerate(names):
            for n in range(len(name) - 1, 0, -1):
                if name[:n] in self.rank:
                    self.shorter[r] = self.rank[name[:n]]
                    break
        self.automaton = ahocorasick.Automaton()
        for name, r in self.rank.items():
            self.automaton.add_word(name, (r, len(name)))
        self.automaton.make_automaton()
        self.id_bytes = [int(vocab[n]).to_bytes(4, "little") if n in vocab else b"" for n in names]
        self.compatible = Pairs(self.halves, self.merged)
        self.split, self.plain_split = regex.compile(SPLIT), re.compile(PLAIN_SPLIT)
        self.special_id = {k: int(v).to_bytes(4, "little") for k, v in special.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pieces = {int(i): bytes(of_letter[c] for c in n) for n, i in vocab.items() if all(c in of_letter for c in n)}
        pieces |= {int(i): n.encode() for n, i in special.items()}
        self.size = np.zeros(max(pieces) + 1, np.int64)
        for i, piece in pieces.items():
            self.size[i] = len(piece)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(self.size))), np.uint8)

    def __missing__(self, pretoken: str) -> bytes:
        word = pretoken.encode().decode("latin-1").translate(self.letters)
        # Longest matches in a row are what the search tries first; it goes on from where
        # two of them may not stand side by side.
        tokens = [token for _, (token, _) in self.automaton.iter_long(word)]
        fits = list(map(self.compatible.__getitem__, zip(tokens, tokens[1:])))
        if False in fits:
            tokens = self.search(word, tokens[: fits.index(False) + 1])
        ids = b"".join(map(self.id_bytes.__getitem__, tokens))
        if len(pretoken) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[pretoken] = ids
        return ids

    def search(self, word: str, tokens: list[int]) -> list[int]:
        """All tokens of a word that begins with these, by backtracking."""
        size, shorter, compatible = self.length, self.shorter, self.compatible
        n = len(word)
        longest = [0] * n
        for end, match in self.automaton.iter(word):
            longest[end - match[1] + 1] = match[0]  # later ends are longer
        reachable = bytearray(b"\1") * (n + 1)
        at = sum(map(size.__getitem__, tokens))
        token = longest[at]
        while at < n:
            end = at + size[token]
            if reachable[end] and (not tokens or compatible[tokens[-1], token]):
                tokens.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                reachable[at] = 0
                token = tokens.pop()
                at -= size[token]
        return tokens

    def pretokens(self, text: str) -> list[str]:
        return self.split.findall(text) if NOT_PLAIN.search(text) else self.plain_split.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.__getitem__, self.pretokens(text)))
        parts = self.special.split(text)
        return b"".join(self.special_id[p] if i % 2 else b"".join(map(self.__getitem__, self.pretokens(p))) for i, p in enumerate(parts))

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return ""
        gather = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - size), size)
        return self.bytes[gather].tobytes().decode("utf-8", errors="replace")


def vocabulary(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """A tokenizer file's digest and text, to be sent once to each executor.

    A vocabulary is a fixed file of a few MB whatever the corpus, so broadcasting it is safe.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return hashlib.sha256(spec.encode()).hexdigest(), spark.sparkContext.broadcast(spec)


def coder(vocab: tuple[str, Broadcast]) -> Bpe:
    """The coder of a vocabulary; a Python worker keeps it from task to task."""
    return held("coder", vocab[0], lambda: Bpe(vocab[1].value))


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's ids and their decoded text: `doc_id`, kept columns, `ids`, `decoded`."""
    vocab = vocabulary(docs.sparkSession, path)
    chosen = docs.select(doc_id, *keep, text)
    schema = chosen.drop(text).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocab)
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            ids = [np.frombuffer(bpe.encode(t or ""), "<u4") for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            values = pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32))
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, values), pa.array([bpe.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chosen.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: `doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256`.

    The digests are made where the ids are, so that ids do not cross back into the JVM.
    """
    vocab = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocab)
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = (bpe.decode(np.frombuffer(x, "<u4")) for x in ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select("doc_id", "text")
    schema = chosen.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return chosen.mapInArrow(run, schema)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
