"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

A table becomes shards in ascending order of the document id. A shard is three files of one name in one folder:

- ``.ids``: the token ids of its documents end to end, little-endian, 16 bits where the vocabulary allows, else 32;
- ``.off``: little-endian unsigned 64-bit offsets into ``.ids`` in tokens, one more than there are documents;
- ``.doc``: little-endian signed 64-bit document ids.

The base of a shard is the sum of the tokens of the shards before it, so no file is rewritten once its task ends. Each
attempt of a task writes under a name of its own and returns it, so files of different attempts never mix; those of
attempts that didn't count are removed at the end.

Nulls: a null text is an empty one and gets the end id only; a null document id sorts first and is stored as the
smallest 64-bit number. Repeated ids are kept, each with its own tokens, ordered by hash and text, and may go to more
than one shard. An empty table gives no shards. Columns beside
the id and the text aren't read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, local_path, small_batches
from .tokenize import encoder

NULL_ID = -(2**63)
SHARD = "shard int, name string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write_shard(folder: str, tokenizer: str, end: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard per task."""
        shard = TaskContext.get().partitionId()
        encode, docs, counts = encoder(tokenizer).encode_column, [], []
        name = f"{shard:07d}-{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{name}.ids", "wb") as out:
            for batch in batches:
                ids, n = encode(batch.column(1), end)
                out.write(ids.astype(kind).tobytes())
                docs.append(batch.column(0).fill_null(NULL_ID).to_numpy())
                counts.append(n)
        if not docs or not sum(map(len, docs)):
            os.remove(f"{folder}/{name}.ids")
            return
        n = np.concatenate(counts)
        np.concatenate(docs).astype("<i8").tofile(f"{folder}/{name}.doc")
        np.concatenate([[0], np.cumsum(n)]).astype("<u8").tofile(f"{folder}/{name}.off")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "name", "n_docs", "n_tokens"])

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes docs into folder (a mounted one that all executors share) and returns the shards with their bases.

    Only one row per shard comes to the driver; it also goes into ``shards.json`` beside the files.
    """
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = own.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    rows = sorted(ordered.mapInArrow(_write_shard(folder, tokenizer, end, kind), SHARD).collect())
    bases = accumulate([0, *(r.n_tokens for r in rows)])
    shards = [{"shard": r.name, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "base": b, "dtype": kind} for r, b in zip(rows, bases)]
    os.makedirs(folder, exist_ok=True)
    for file in set(os.listdir(folder)) - {f"{r.name}.{part}" for r in rows for part in ("ids", "off", "doc")}:
        os.remove(f"{folder}/{file}")
    with open(f"{folder}/shards.json", "w") as f:
        json.dump(shards, f)
    return shards


class Shard:
    """A shard, memory-mapped. Document i has the ids self[i]."""

    def __init__(self, folder: str, shard: str, dtype: str) -> None:
        name = f"{folder}/{shard}"
        self.ids = np.memmap(f"{name}.ids", dtype, "r")
        self.offsets = np.memmap(f"{name}.off", "<u8", "r")
        self.docs = np.memmap(f"{name}.doc", "<i8", "r")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[int(self.offsets[i]) : int(self.offsets[i + 1])]


def _read_shards(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["shard"], row["dtype"])
                for at in range(0, len(shard), 10_000):
                    many = range(at, min(at + 10_000, len(shard)))
                    crc = [zlib.crc32(shard[i].astype("<u4").tobytes()) for i in many]
                    off = np.asarray(shard.offsets[at : many.stop + 1]).astype(np.int64)
                    docs = np.asarray(shard.docs[at : many.stop])
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NULL_ID), pa.array(off[:-1] + row["base"]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """A row per document of the files: its first token's place in the whole, its tokens, and their CRC-32 as 32-bit ids."""
    rows = spark.createDataFrame([(s["shard"], s["base"], s["dtype"]) for s in shards], "shard string, base long, dtype string")
    return rows.repartition(max(1, len(shards))).mapInArrow(_read_shards(folder), READ)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte_bpe_50k ids with end id 0, written and read back."""
    import public_tokenizers as P

    folder = local_path(fresh_path(spark, "token-files"))
    shards = write_token_files(documents(spark, sf_dir), folder, P.path("byte_bpe_50k.json"), end=0, vocabulary=50_257)
    return read_token_files(spark, folder, shards)
