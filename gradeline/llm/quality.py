"""Quality by hierarchical empirical Bayes: what a classifier says of a document, what is known of its path and host.

A logistic regression on text statistics gives each document's log-odds, apart from the base rate: its evidence. The
share of good documents of a host is shrunk towards that of all, and that of a path towards its host's, each by a
strength that the spread between groups sets (moments of a beta distribution), so sparse sites follow the prior. The
score of a document is its evidence on top of its path's share, the document itself left out of all sums.

The regression is fitted on at most SAMPLE labelled documents in expectation, by a hash of the id. Shares come from all
documents, through sums only: labels where there are some, else probabilities.

A null or empty text has no words, gives no evidence and isn't kept. Null hosts and paths are groups of their own. Of
several labels of a document the smallest counts. Repeated rows are scored as often as they come. With labels of one
kind only, or none, the evidence is 0. An empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, written
from .outliers import base_statistics, vector

#: Bound of the labelled sample.
SAMPLE = 20_000
#: Score from which on a document is kept.
KEEP = 0.5
#: Bounds of the strength of a prior, in documents, and of the evidence, in nats.
STRENGTH, EVIDENCE = (2.0, 1e4), 12.0
N = 10


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(3).to_pylist():
            *counts, words = base_statistics(text or "")
            out.append([*vector(text, *counts, words), log(counts[0]), (counts[4] / counts[0])] if counts[0] else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], names=["doc_id", "host", "path", "x"])


def features(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path and the statistics x of each document; x is null without words."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_features, f"doc_id {kind}, host string, path string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights of 1, x and x squared, by Newton's method with a small penalty, and the base log-odds."""
    base = log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(set(y.tolist())) < 2:
        return np.zeros(1 + 2 * N), base
    a = np.column_stack([x, x * x])
    mean, spread = a.mean(0), a.std(0)
    # a column that doesn't vary, but for rounding, tells nothing; scaled up it would make the equations singular
    varies = spread > 1e-9 * np.maximum(np.abs(a).max(0), 1e-3)
    a = np.column_stack([np.ones(len(x)), np.where(varies, (a - mean) / np.where(varies, spread, 1), 0)])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (y - p) - 1.0 * w
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)), slope)
    scaled = np.where(varies, w[1:] / np.where(varies, spread, 1), 0)
    return np.concatenate([[w[0] - scaled @ mean], scaled]), base


def _evidence(w: np.ndarray, base: float) -> Column:
    total = F.lit(float(w[0]) - base)
    for i in range(N):
        x = F.col("x")[i]
        total = total + x * F.lit(float(w[1 + i])) + x * x * F.lit(float(w[1 + N + i]))
    return F.when(F.col("x").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(-EVIDENCE), F.least(F.lit(EVIDENCE), total)))


def _strength(groups: DataFrame) -> float:
    """The strength of the beta prior over groups with n documents and s good ones, by moments."""
    r = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss")).first()
    if not r["n"] or r["k"] < 2:
        return STRENGTH[1]
    mean = r["s"] / r["n"]
    within = mean * (1 - mean)
    between = (r["ss"] - r["n"] * mean * mean - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(min(STRENGTH[1], max(STRENGTH[0], within / between - 1))) if between > 0 else STRENGTH[1]


def score(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows: as features() gives them. labels: doc_id and good (0 or 1).

    doc_id, evidence, host_share, path_share (both without the document), score and kept.
    """
    rows = written(rows, "quality-features")
    labels = labels.where("good IS NOT NULL").groupBy("doc_id").agg(F.min("good").cast("double").alias("good"))
    both = rows.join(labels, "doc_id", "left")
    n = labels.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = both.where("good IS NOT NULL AND x IS NOT NULL").where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x", "good").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, N)
    w, base = fit(x, sample["good"].to_numpy(float))
    judged = both.withColumn("evidence", _evidence(w, base)).withColumn("p", F.coalesce("good", 1 / (1 + F.exp(-F.col("evidence") - base))))
    judged = written(judged.select("doc_id", F.coalesce(F.concat(F.lit("="), "host"), F.lit("-")).alias("host"), F.coalesce(F.concat(F.lit("="), "path"), F.lit("-")).alias("path"), F.col("x").isNotNull().alias("some"), "evidence", "p"), "quality-evidence")
    paths = written(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "quality-hosts")
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).first()
    of_hosts, of_paths = _strength(hosts), _strength(paths)
    mean = (F.lit(float(whole["s"])) + 1 - F.col("p")) / (F.lit(float(whole["n"])) + 2 - 1)
    sites = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host").select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "hn", "hs")
    out = judged.join(sites, (F.col("host") == F.col("h")) & (F.col("path") == F.col("q")))
    out = out.withColumn("host_share", (F.lit(of_hosts) * mean + F.col("hs") - F.col("p")) / (of_hosts + F.col("hn") - 1))
    out = out.withColumn("path_share", (F.lit(of_paths) * F.col("host_share") + F.col("s") - F.col("p")) / (of_paths + F.col("n") - 1))
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_share")))
    out = out.withColumn("score", 1 / (1 + F.exp(-F.col("evidence") - F.log(held / (1 - held)))))
    return out.select("doc_id", "evidence", "host_share", "path_share", "score", (F.col("some") & (F.col("score") >= KEEP)).alias("kept"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the source as the host and the language's section of it as the path, with the quality labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    return score(features(documents(spark, sf_dir), F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))), labels)
