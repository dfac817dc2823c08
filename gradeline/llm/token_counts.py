"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in one ragged array of symbols. In each round every sequence finds its lowest-ranked pair of
neighbours and merges all places of that pair at once; sequences without a mergeable pair leave with their number of
symbols. This gives the library's counts, as no merge can make a pair that ranks below the merged one.

Nulls: a null text is an empty one and has no tokens. The special token's string inside a text counts as one token, as
the library has it. Rows and further columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remembered, small_batches, unused
from .tokenize import BLANK_KEPT, BYTES

#: Pre-tokens and pieces that one worker remembers; beyond it the memory starts anew. Results don't depend on it.
REMEMBERED = 700_000
NONE = np.iinfo(np.int32).max


class MergeTable:
    """The merges of a byte-level vocabulary file: for a pair of ids its rank and the id it becomes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte = np.array([vocab[BYTES[b]] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        of, out = np.repeat(np.arange(len(words)), lengths), lengths.copy()
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int32)
            inside = np.flatnonzero(of[1:] == of[:-1])
            rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least, sizes = np.minimum.reduceat(rank, first), np.diff(np.append(first, len(of)))
            out[of[first]] = sizes
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < NONE))
            # of a run of overlapping places, as in "aaaa", every other one from its start is merged
            run = np.concatenate([[True], (np.diff(at) != 1)]) if len(at) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(least < NONE, sizes)
            keep[at + 1] = False
            symbols, of = symbols[keep], of[keep]
        return out


class TokenCounter:
    """Counts of texts, with the counts of pieces between single blanks and of pre-tokens remembered.

    A single blank between visible characters begins a pre-token, so the counts of the pieces add up.
    """

    def __init__(self, path: str) -> None:
        self.table, self.pattern = MergeTable(path), regex.compile(BLANK_KEPT)
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how often special tokens stand in it."""
        parts = [text]
        for s in self.table.special:
            parts = [q for p in parts for q in p.split(s)]
        return [w for p in parts for w in self.pattern.findall(p)], len(parts) - 1

    def direct(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) for t in texts]
        if new := list({w for words, _ in cut for w in words} - self.words.keys()):
            self.words.update(zip(new, self.table.counts([w.encode() for w in new]).tolist()))
        return [sum(map(self.words.__getitem__, words)) + n for words, n in cut]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.pieces) + len(self.words) > REMEMBERED:
            self.pieces.clear()
            self.words.clear()
        cut = [t.split(" ") if t else [] for t in texts]
        rest = [p[1:] for p in cut]
        new = list(set().union(*rest) - self.pieces.keys())
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        self.pieces.update(dict.fromkeys(new, -1))  # at these the text may not be cut
        self.pieces.update(zip(plain, self.direct([" " + p for p in plain])))
        heads = self.direct([p[0] if p else "" for p in cut])
        out = []
        for t, p, own, head in zip(texts, cut, rest, heads):
            n = list(map(self.pieces.__getitem__, own))
            odd = n and (min(n) < 0 or not p[0] or p[0][-1].isspace())
            out.append(self.direct([t])[0] if odd else head + sum(n))
        return out


def counter_of(path: str) -> TokenCounter:
    """This worker's counter for a tokenizers file."""
    return remembered(("counter", path), lambda: TokenCounter(path))


def token_counts(docs: DataFrame, tokenizer: str, limit: int, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. Needs no exchange; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", text_col)]
    schema = docs.select(*kept).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(True)}).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            n = np.array([x for i in range(0, len(texts), 400) for x in counter.counts(texts[i : i + 400])], np.int64)
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, pa.array(n), pa.array(n > limit)], names=[*kept, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(*kept, F.col(text_col).cast("string").alias(unused("__text", kept))).mapInArrow(count, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of byte_bpe_50k tokens of all documents, over the limit above 1,024."""
    import public_tokenizers as P

    return token_counts(documents(spark, sf_dir).select("doc_id", "text"), P.path("byte_bpe_50k.json"), 1024)
