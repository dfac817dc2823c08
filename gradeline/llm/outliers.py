"""Quality rules: fixed base rules, then robust multivariate outliers.

Every document becomes a vector of transformed text statistics. For each language and source the centre and covariance
of these vectors are estimated by minimum covariance determinant: of the subsets of (n + P + 1) / 2 of the n vectors
that concentration steps reach from several robust starts, the one whose covariance has the least determinant. So
outliers may be nearly half of a group. A document is rejected if it fails the base rules or if its squared
Mahalanobis distance is over FAR, a quantile of the chi-squared distribution.

Estimates use the distinct vectors of documents that pass the base rules, so copies count once. A source's estimate is
shrunk towards that of its language, and that towards the one of all, by LIKE vectors' worth; with under ENOUGH vectors
it has none of its own. No spread is taken as less than its FLOOR, or constant statistics would reject whatever
differs. Each step counts distances in bins and sums the nearest up, in Arrow batches, so no group meets in a task;
estimates reach tasks as arrays of at most GROUPS groups, and documents by a broadcast of as many rows or a salted join.

A null text is an empty one; it has no words and fails. Null languages and sources are groups of their own. Rows are
kept as they come; an empty table gives an empty result; further columns aren't read. The texts are read once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log1p
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, documents, small_batches, written

#: The statistics, and the least spread of each.
FLOOR = {"word_length": 0.06, "symbols": 0.25, "dup_lines": 0.2, "repeats": 0.2, "capitals": 0.04, "digits": 0.25, "marks": 0.12, "variety": 0.04}
P = len(FLOOR)
LEAST = np.array(list(FLOOR.values()))
#: Fall of a log determinant under which a subset has settled, most steps, and starts.
SETTLED, MOST_STEPS, STARTS = 1e-9, 100, 3
#: Vectors that a group needs, and what its parent's estimate counts beside them.
ENOUGH, LIKE = 5 * P, 20 * P
#: Groups that are estimated at a time, and tasks that a source's rows are dealt to where there are more.
GROUPS, SALT = 4096, 64
#: Bins of a distance, and how many of them for each power of two.
BINS, FINE = 2048, 64


def chi_squared(share: float, degrees: int = P) -> float:
    """A quantile of the chi-squared distribution, by Wilson and Hilferty's approximation."""
    return degrees * (1 - 2 / (9 * degrees) + NormalDist().inv_cdf(share) * (2 / (9 * degrees)) ** 0.5) ** 3


#: The median, and the squared distance over which a document is rejected: of ordinary ones about 1 in 20,000.
MIDDLE, FAR = chi_squared(0.5), chi_squared(1 - 5e-5)
SEPARATORS = " \t\n\x0b\x0c\r"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def base_statistics(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SEPARATORS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    dup = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        at = np.flatnonzero(np.fromiter((times[w] > 1 for w in windows), bool, len(windows)))
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[at + k] = True
        repeated = int(covered.sum())
    return n, chars, symbols, dup, repeated, words


def vector(text: str, n: int, chars: int, symbols: int, dup: int, repeated: int, words: list[bytes]) -> list[float]:
    """The transformed statistics of a text with words."""
    letters = sum(map(text.count, "abcdefghijklmnopqrstuvwxyz")) + 1
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, ".,;:!?"))
    lines = text.count("\n") + 1
    return [log(chars / n), log1p(10 * symbols / n), (dup / lines) ** 0.5, (repeated / n) ** 0.5, (capitals / (letters + capitals)) ** 0.5, log1p(10 * digits / chars), log1p(10 * marks / n), log(1 + len(set(words))) / log(1 + n)]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, vectors = [], []
        for text in batch.column(3).to_pylist():
            *counts, words = base_statistics(text or "")
            failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            base.append((*counts, failed))
            vectors.append(None if failed else vector(text, *counts, words))
        columns = list(zip(*base)) or [()] * 6
        types = [pa.int64()] * 5 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types)), pa.array(vectors, pa.list_(pa.float64()))], names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "v"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base columns, and v: the vector of a document that passes them."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_statistics, f"doc_id {kind}, lang string, source string, {BASE}, v array<double>")


def _named(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def _levels() -> list[Column]:
    """The groups of a document, from the narrowest."""
    return [F.concat(_named("lang"), F.lit("\n"), _named("source")), F.concat(_named("lang"), F.lit("\n*")), F.lit("*")]


def _bins(d: np.ndarray) -> np.ndarray:
    """Bins of squared distances, FINE for each power of two."""
    return np.clip(np.floor(np.log2(np.maximum(d, 1e-30)) * FINE) + BINS // 4, 0, BINS - 1).astype(np.int64)


def _upper(bins: np.ndarray) -> np.ndarray:
    """The upper ends of such bins."""
    return 2.0 ** ((bins + 1 - BINS // 4) / FINE)


def _distances(x: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return np.einsum("ni,nij,nj->n", x, inverse, x)


def _over(rows: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    """make(group, vectors) of each batch of rows (key, v); group is the place of the key in keys. Others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(keys)}
        for batch in batches:
            own = batch.column(0).dictionary_encode()
            group = np.array([place.get(k, -1) for k in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()]
            v = batch.column(1).flatten().to_numpy().reshape(-1, P)
            yield from make(group[group >= 0], v[group >= 0])

    return rows.select("key", "v").mapInArrow(run, schema)


def _quantiles(rows: DataFrame, keys: list[str], cells: int, code, *need: str) -> np.ndarray:
    """For each cell the bins of its need-th smallest values: cells x quantiles. code gives cells and bins of vectors.

    need is SQL over total, the values of a cell. Counts of bins are whole numbers, so neither the order nor the split of
    the rows matters. A cell has BINS rows at most.
    """

    def count(group: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, at = code(group, v)
        codes, n = np.unique(cell * BINS + at, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes // BINS), pa.array(codes % BINS), pa.array(n)], names=["cell", "bin", "n"])

    counted = _over(rows, keys, count, "cell long, bin long, n long").groupBy("cell", "bin").agg(F.sum("n").alias("n"))
    run = W.partitionBy("cell").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = counted.withColumns({"below": F.sum("n").over(run), "total": F.sum("n").over(W.partitionBy("cell"))})
    out = np.zeros((cells, len(need)), np.int64)
    for r in counted.groupBy("cell").agg(*[F.min(F.expr(f"IF(below >= {x}, bin, NULL)")) for x in need]).collect():
        out[r["cell"]] = r[1:]
    return out


def _moments(rows: DataFrame, keys: list[str], starts: int, choose) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, sums and products for each group and start of what choose(start, group, v) gives: chosen rows and their vectors."""
    pairs = np.triu_indices(P)

    def add(group: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(starts):
            chosen, x = choose(s, group, v)
            some, of = np.unique(group[chosen], return_inverse=True)
            x = x[chosen]
            both = np.concatenate([np.ones((len(x), 1)), x, x[:, pairs[0]] * x[:, pairs[1]]], 1)
            sums = np.zeros((len(some), both.shape[1]))
            np.add.at(sums, of, both)
            yield pa.RecordBatch.from_arrays([pa.array(some * starts + s), *(pa.array(c) for c in sums.T)], names=names)

    names = ["cell", *(f"m{i}" for i in range(1 + P + len(pairs[0])))]
    found = _over(rows, keys, add, ", ".join(f"{n} {'double' if n[0] == 'm' else 'long'}" for n in names)).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names[1:]])
    out = np.zeros((len(keys) * starts, len(names) - 1))
    for r in found.collect():
        out[r["cell"]] = r[1:]
    out = out.reshape(len(keys), starts, -1)
    square = np.zeros((len(keys), starts, P, P))
    square[..., pairs[0], pairs[1]] = square[..., pairs[1], pairs[0]] = out[..., 1 + P :]
    return np.maximum(out[..., 0], 1), out[..., 1 : 1 + P], square


def _starts(rows: DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Medians, and STARTS covariances about them: of spreads alone, of signs in space, of squashed deviations."""
    grid, zero = 64, BINS // 2

    def code(group: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (group[:, None] * P + np.arange(P)).ravel(), np.clip(np.floor(v * grid) + zero, 0, BINS - 1).astype(np.int64).ravel()

    bins = _quantiles(rows, keys, len(keys) * P, code, "total * 0.25", "total * 0.5", "total * 0.75")
    low, middle, high = np.moveaxis((bins.reshape(len(keys), P, 3) - zero + 0.5) / grid, 2, 0)
    spread = np.sqrt(((high - low) / 1.349) ** 2 + LEAST**2)

    def choose(s: int, group: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (v - middle[group]) / spread[group]
        return np.ones(len(z), bool), np.tanh(z) if s else z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    _, _, square = _moments(rows, keys, STARTS - 1, choose)
    trace = np.maximum(np.trace(square, axis1=2, axis2=3), 1e-12)[..., None, None]
    shapes = np.concatenate([np.broadcast_to(np.eye(P), (len(keys), 1, P, P)), square / trace * P], 1)
    return middle, shapes * (spread[:, None, :, None] * spread[:, None, None, :])


def minimum_determinant(rows: DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of each key's vectors, of rows (key, v). Arrays of this size are all that tasks hold.

    A step takes, from each start, the half of the vectors that lie nearest, by whole bins of distance, as the next
    subset. A start has settled when its determinant no longer falls; the subset with the least one is kept. Its
    covariance is scaled by how far the median distance of all vectors is from that of the chi-squared distribution.
    """
    middle, covariance = _starts(rows, keys)
    groups, floor = len(keys), np.diag(LEAST**2)
    shift, last = np.zeros((groups, STARTS, P)), np.full((groups, STARTS), np.inf)
    moving = np.ones((groups, STARTS), bool)
    for _ in range(MOST_STEPS):
        inverse = np.linalg.inv(covariance + floor)

        def far(s: int, group: np.ndarray, v: np.ndarray) -> np.ndarray:
            return _bins(_distances(v - middle[group] - shift[group, s], inverse[group, s]))

        def code(group: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            some = [group[moving[group, s]] for s in range(STARTS)]
            return np.concatenate([g * STARTS + s for s, g in enumerate(some)]), np.concatenate([far(s, g, v[moving[group, s]]) for s, g in enumerate(some)])

        limit = _quantiles(rows, keys, groups * STARTS, code, f"least(total, (total + {P + 1}) div 2)").reshape(groups, STARTS)

        def choose(s: int, group: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return moving[group, s] & (far(s, group, v) <= limit[group, s]), v - middle[group]

        size, sums, square = _moments(rows, keys, STARTS, choose)
        means = sums / size[..., None]
        fresh = square / size[..., None, None] - means[..., :, None] * means[..., None, :]
        now = np.linalg.slogdet(fresh + floor)[1]
        moving = moving & (now < last - SETTLED)
        if not moving.any():
            break
        shift[moving], covariance[moving], last[moving] = means[moving], fresh[moving], now[moving]
    best, each = np.argmin(np.round(last, 9), 1), np.arange(groups)
    centre, covariance = middle + shift[each, best], covariance[each, best] + floor
    inverse = np.linalg.inv(covariance)
    half = _quantiles(rows, keys, groups, lambda group, v: (group, _bins(_distances(v - centre[group], inverse[group]))), "total / 2")
    return centre, covariance * np.maximum(1.0, _upper(half[:, 0]) / MIDDLE)[:, None, None]


ESTIMATE = "key string, n long, centre array<double>, covariance array<double>"


def _blended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates shrunk towards that of the language, and that towards the one of all, by LIKE vectors' worth."""

    def mixed(a, b):
        if a is None or a[0] is None:
            return b
        if b is None:
            return a
        weight = a[0] / (a[0] + LIKE)
        return a[0], weight * a[1] + (1 - weight) * b[1], weight * a[2] + (1 - weight) * b[2]

    def taken(n, centre, covariance):
        return None if pd.isna(n) else (n, np.asarray(centre, float), np.asarray(covariance, float).reshape(P, P))

    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            *_, centre, covariance = mixed(taken(r.n, r.centre, r.covariance), mixed(taken(r.n1, r.centre1, r.covariance1), taken(r.n2, r.centre2, r.covariance2)))
            out.append((r.k0, centre.tolist(), np.linalg.inv(covariance).ravel().tolist()))
        yield pd.DataFrame(out, columns=["k0", "centre", "inverse"])


def estimates(stats: DataFrame) -> DataFrame:
    """key, n, centre, covariance: of each group with enough distinct vectors, and of all.

    Groups are taken GROUPS at a time, so that what the driver and a task hold of them is bounded.
    """
    spark = stats.sparkSession
    distinct = stats.where("v IS NOT NULL").select(*(k.alias(f"k{i}") for i, k in enumerate(_levels())), "v").groupBy("k0", "k1", "k2", "v").agg(F.lit(1).alias("one"))
    rows = written(distinct.select(F.explode(F.array("k0", "k1", "k2")).alias("key"), "v"), "vectors")
    groups = written(rows.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") >= ENOUGH) | (F.col("key") == "*")), "groups")
    parts, out = -(-groups.count() // GROUPS), None
    part = F.pmod(F.xxhash64("key"), F.lit(max(parts, 1)))
    dealt = written(rows.withColumn("part", part), "vectors", "part") if parts > 1 else rows.withColumn("part", F.lit(0))
    for i in range(parts):
        own = groups.where(part == i).orderBy("key").collect()
        if not own:
            continue
        keys, n = [r["key"] for r in own], np.array([r["n"] for r in own], np.int64)
        centre, covariance = minimum_determinant(dealt.where(F.col("part") == i), keys)
        found = written(spark.createDataFrame([(k, int(c), a.tolist(), b.ravel().tolist()) for k, c, a, b in zip(keys, n, centre, covariance)], ESTIMATE), "estimate")
        out = found if out is None else out.unionByName(found)
    discard(rows, groups)
    return spark.createDataFrame([], ESTIMATE) if out is None else out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops v, centre and inverse of each row for its distance."""
    for batch in batches:
        n = batch.num_rows
        v, centre, inverse = (batch.column(i) for i in range(batch.num_columns - 3, batch.num_columns))
        have = v.is_valid().to_numpy(zero_copy_only=False) & centre.is_valid().to_numpy(zero_copy_only=False)
        chosen = pa.array(have)
        x, c, m = (a.filter(chosen).flatten().to_numpy().reshape(int(have.sum()), -1) for a in (v, centre, inverse))
        distance = np.zeros(n)
        distance[have] = _distances(x - c, m.reshape(-1, P, P)) if have.any() else 0.0
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(distance, mask=~have)], names=[*batch.schema.names[:-3], "distance"])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, distance (null where the base rules fail) and kept."""
    stats = written(statistics(docs).withColumn("k0", _levels()[0]), "statistics")
    found = estimates(stats)
    level = [found.select(F.col("key").alias(f"k{i}"), *(F.col(c).alias(c + (str(i) if i else "")) for c in ("n", "centre", "covariance"))) for i in range(3)]
    groups = stats.where("v IS NOT NULL").groupBy("k0", "lang").agg(F.lit(1).alias("one")).withColumn("k1", _levels()[1]).join(level[0], "k0", "left").join(level[1], "k1", "left")
    groups = groups.crossJoin(F.broadcast(level[2].where("k2 = '*'")))  # one row
    own = written(groups.select("k0", *(c + i for i in ("", "1", "2") for c in ("n", "centre", "covariance"))).mapInPandas(_blended, "k0 string, centre array<double>, inverse array<double>"), "estimate")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if own.count() <= GROUPS:
        both = stats.join(F.broadcast(own), "k0", "left")
    else:  # a source may hold a third of all rows, so its key is dealt to SALT tasks
        salted = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALT)))
        both = salted.join(own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["k0", "salt"], "left")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.select(*names).schema)
    judged = both.select(*names, "v", "centre", "inverse").mapInArrow(_judged, f"{shape}, distance double")
    return judged.select(*names, (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= FAR)).alias("kept"), "distance")


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on all documents."""
    return judge(documents(spark, sf_dir))
