"""Packing of token sequences: bounded-space online best fit.

Each partition holds a fixed number of open windows. A piece goes to the window it fits best. If it fits none, the
fullest is emitted, first filled with the head of the piece where that is worth a cut. What stays open at the end of a
partition is merged until one window is partly full; those last windows of up to PARTITIONS partitions meet in one task
and are merged alike. So no task holds more than its open windows, and no row is shuffled but those of the last windows.

Texts longer than a window are cut into full windows first. Nulls: a null text is an empty one and gives the end id
only; a null id is kept. Repeated rows are packed as often as they come. An empty table gives no pieces. Columns other
than id and text aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, small_batches, written
from .tokenize import encoder

#: Open windows of a partition.
OPEN = 64
#: Free places from which on the fullest window is filled by cutting a piece.
WORTH = 16
#: Partitions whose last windows are merged in one task.
PARTITIONS = 256
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple  # document id, start, ids, tokens of the document


class Packer:
    """Open windows of one task. Full ones go to rows; sequence ids count up from first."""

    def __init__(self, size: int, first: int, n_open: int = OPEN, worth: int = WORTH) -> None:
        self.size, self.next, self.n_open, self.worth = size, first, n_open, worth
        self.windows: list[list[Piece]] = []
        self.free: list[tuple[int, int]] = []  # (free places, index in windows), ascending
        self.rows: list[tuple] = []

    def emit(self, window: list[Piece]) -> None:
        offset = 0
        for doc, start, ids, tokens in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """A whole document."""
        at, tokens = 0, len(ids)
        while tokens - at >= self.size:
            self.emit([(doc, at, ids[at : at + self.size], tokens)])
            at += self.size
        if at < tokens:
            self.place((doc, at, ids[at:].copy(), tokens))

    def place(self, piece: Piece) -> None:
        k = bisect_left(self.free, (len(piece[2]), -1))
        if k < len(self.free):
            self.put(k, piece)
        elif len(self.free) < self.n_open:
            self.windows.append([])
            insort(self.free, (self.size, len(self.windows) - 1))
            self.put(len(self.free) - 1, piece)
        else:
            if self.free[0][0] >= self.worth:
                piece = self.fill(0, piece)
            else:
                self.close(0)
            self.place(piece)

    def put(self, k: int, piece: Piece) -> None:
        """A piece into the k-th fullest window, which has room for it. A window that gets full is emitted."""
        free, w = self.free.pop(k)
        self.windows[w].append(piece)
        insort(self.free, (free - len(piece[2]), w))
        if free == len(piece[2]):
            self.close(0)

    def fill(self, k: int, piece: Piece) -> Piece:
        """Fills a window with the head of a piece; what stays over."""
        doc, start, ids, tokens = piece
        cut = self.free[k][0]
        self.put(k, (doc, start, ids[:cut], tokens))
        return doc, start + cut, ids[cut:], tokens

    def close(self, k: int) -> None:
        """Emits a window; the last one takes its index."""
        _, w = self.free.pop(k)
        window, last = self.windows[w], self.windows.pop()
        self.emit(window)
        if w < len(self.windows):
            self.windows[w] = last
            at = next(i for i, (_, x) in enumerate(self.free) if x == len(self.windows))
            self.free[at] = (self.free[at][0], w)
            self.free.sort()

    def merge(self) -> list[Piece]:
        """Moves the pieces of the emptiest windows into the others, cut where none has room; the pieces of the one that stays."""
        while len(self.free) > 1:
            free, w = self.free.pop()
            rest, last = self.windows[w], self.windows.pop()
            if w < len(self.windows):
                self.windows[w] = last
                self.free = sorted((f, w if x == len(self.windows) else x) for f, x in self.free)
            while rest and self.free:
                piece = rest.pop(0)
                k = bisect_left(self.free, (len(piece[2]), -1))
                if k < len(self.free):
                    self.put(k, piece)
                else:
                    rest.insert(0, self.fill(0, piece))
            if rest:  # all others got full
                self.windows.append(rest)
                insort(self.free, (self.size - sum(len(p[2]) for p in rest), 0))
        return self.windows[0] if self.free else []

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _pack_partition(tokenizer: str, end: int, size: int):
    schema = pa.schema([(c, pa.int64()) for c in COLUMNS] + [("ids", pa.binary()), ("part", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, encode = Packer(size, part << 32), encoder(tokenizer).encode_column

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            ids, counts = encode(batch.column(1), end)
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):
                packer.add(doc, ids[a:b])
            if packer.rows:
                yield batch_of([(*r, None, part) for r in packer.taken()])
        last = packer.merge()
        if rows := [(*r, None, part) for r in packer.taken()] + [(doc, start, len(p), None, tokens, None, i, p.astype("<u4").tobytes(), part) for i, (doc, start, p, tokens) in enumerate(last)]:
            yield batch_of(rows)

    return pack


def _pack_last(size: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(size, (1 << 30 | int(key[0])) << 32, n_open=PARTITIONS + 1)
        docs = pdf.sort_values(["part", "offset"])
        for _, own in docs.groupby("part", sort=True):
            pieces = [(None if pd.isna(d) else int(d), int(s), np.frombuffer(i, "<u4"), int(t)) for d, s, i, t in zip(own["doc_id"], own["start"], own["ids"], own["doc_tokens"])]
            packer.windows.append(pieces)
            insort(packer.free, (size - sum(len(p[2]) for p in pieces), len(packer.windows) - 1))
        if last := packer.merge():
            packer.emit(last)
        return pd.DataFrame(packer.taken(), columns=COLUMNS).astype({"doc_id": "Int64"})

    return pack


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: where each starts in its document, and its sequence and offset there."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = written(source.mapInArrow(released(_pack_partition(tokenizer, end, size)), f"{PIECES}, ids binary, part long"), "pieces")
    last = first.where("ids IS NOT NULL").groupBy((F.col("part") / PARTITIONS).cast("long").alias("few")).applyInPandas(_pack_last(size), PIECES)
    return first.where("ids IS NULL").select(*COLUMNS).unionByName(last)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as word_bpe_49k ids with end id 1 in sequences of at most 2,048 tokens."""
    import public_tokenizers as P

    return pack(documents(spark, sf_dir), P.path("word_bpe_49k.json"), end=1)
