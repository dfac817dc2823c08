"""Windows of variable length along a track, scored against a target: the computational core of a search.

The scores run as a batched kernel under mapInPandas: all windows of one length share their grids, so sampling, binning,
warping and quantiles are matrix operations over windows. Predicates stand before the kernel, as none moves through it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FOOT_PER_M, MatchConfig

#: Windows that are scored at a time.
TOGETHER = 4096


@dataclass(frozen=True)
class Target:
    """What windows are held against: length, grades in order, and the greater of climb and descent."""

    length_m: float
    grades: tuple[float, ...]
    vert_m: float


def _cell(x: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The knot before each place of a unit grid with knots 0 to last, and how far behind it the place lies."""
    k = np.clip(np.floor(x).astype(np.int64), 0, max(last - 1, 0))
    return k, x - k


def bin_count(length: float, bin_m: float) -> int:
    return max(2, round(length / bin_m))


def resample(dist: np.ndarray, ele: np.ndarray, bin_m: float) -> np.ndarray | None:
    """Percent grades of equal bins of about bin_m; None for a profile without length."""
    total = float(dist[-1])
    if not total > 0:
        return None
    n = bin_count(total, bin_m)
    edges = np.linspace(0, total, n + 1)
    last = np.searchsorted(dist, edges, "right") - 1  # of several knots at one distance the last counts
    a = np.clip(last, 0, len(dist) - 1)
    b = np.minimum(a + 1, len(dist) - 1)
    span = np.where(dist[b] > dist[a], dist[b] - dist[a], 1.0)
    return np.diff(ele[a] + (ele[b] - ele[a]) * np.where(b > a, (edges - dist[a]) / span, 0.0)) / (total / n) * 100


def make_target(dist: list[float], ele: list[float], bin_m: float) -> Target:
    """The target of a track. One without length, or with a missing elevation, can't be matched."""
    d, e = np.asarray(dist, float), np.asarray(ele, float)
    grades = resample(d, e, bin_m) if len(d) and np.isfinite(e).all() else None
    if grades is None:
        raise ValueError("the target needs a length and an elevation at every point")
    diff = np.diff(e)
    return Target(float(d[-1]), tuple(grades.tolist()), float(max(diff[diff > 0].sum(), -diff[diff < 0].sum())))


def warp(target: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Dynamic time warping of the target with each row of grades, over the longer length."""
    n, m = len(target), grades.shape[1]
    row = np.full((len(grades), m + 1), np.inf)
    row[:, 0] = 0
    for x in target:
        cost, new = np.abs(grades - x), np.empty_like(row)
        new[:, 0] = np.inf
        for j in range(m):
            new[:, j + 1] = cost[:, j] + np.minimum(np.minimum(row[:, j], row[:, j + 1]), new[:, j])
        row = new
    return row[:, -1] / max(n, m)


def quantiles(ordered: np.ndarray, n: int) -> np.ndarray:
    k, f = _cell(np.arange(n) * (ordered.shape[1] - 1) / (n - 1), ordered.shape[1] - 1)
    if ordered.shape[1] == 1:
        return np.repeat(ordered, n, 1)
    return ordered[:, k] + f * (ordered[:, k + 1] - ordered[:, k])


def windows(total: float, target_m: float, c: MatchConfig) -> Iterator[tuple[int, float, np.ndarray]]:
    """Length index, length and starts of all windows that fit into a track."""
    step = c.start_step_m(target_m)
    for li, frac in enumerate(c.length_fracs):
        length = target_m * frac
        if length <= total:
            n = max(1, int(np.ceil((total - length + 1e-9) / step)))
            yield li, length, np.arange(n) * step


def sampled(dist: np.ndarray, ele: np.ndarray, t: Target, c: MatchConfig) -> Iterator[dict[str, np.ndarray]]:
    """Vertical travel and grades of the windows of a track, a batch of one length at a time."""
    samples = max(4 * len(t.grades), 100)
    for li, length, all_starts in windows(float(dist[-1]), t.length_m, c):
        n = bin_count(length, c.bin_m)
        k, f = _cell(np.arange(n + 1) * (samples - 1) / n, samples - 1)
        for at in range(0, len(all_starts), TOGETHER):
            starts = all_starts[at : at + TOGETHER]
            x = starts[:, None] + np.arange(samples) * (length / (samples - 1))
            x[:, -1] = starts + length
            e = np.interp(x.ravel(), dist, ele).reshape(x.shape)
            edges = e[:, k] + f * (e[:, k + 1] - e[:, k])
            diff = np.diff(e, axis=1)
            yield {"li": li, "si": np.arange(at, at + len(starts)), "start": starts, "length": length, "gain": np.maximum(diff, 0).sum(1), "loss": np.maximum(-diff, 0).sum(1), "grades": np.diff(edges, axis=1) / (length / n) * 100}


def scored(dist: np.ndarray, ele: np.ndarray, t: Target, c: MatchConfig) -> Iterator[dict[str, np.ndarray]]:
    """The same with scores; direction is the last axis."""
    target = np.asarray(t.grades)
    wanted = quantiles(np.sort(target)[None], c.emd_points)
    for w in sampled(dist, ele, t, c):
        forward, vert = w["grades"], np.maximum(w["gain"], w["loss"])
        dev = np.abs(vert - t.vert_m) / t.vert_m if t.vert_m > 0 else np.zeros_like(vert)
        ways = [forward, -forward[:, ::-1]] if c.reversible else [forward]
        shape = np.stack([warp(target, g) for g in ways], 1)
        spread = np.stack([np.abs(quantiles(np.sort(g, 1), c.emd_points) - wanted).mean(1) for g in ways], 1)
        score = c.weight_shape * shape + c.weight_distribution * spread + c.weight_gain * dev[:, None]
        yield w | {"dev": dev, "shape": shape, "dist": spread, "score": score}


def warp_to(rows: DataFrame, target: list[float], key: str = "profile_id", col: str = "g") -> DataFrame:
    """key and dtw: the warping of each row's sequence with the target, all sequences of a length at once; null for an empty one."""
    wanted = np.asarray(target, float)

    def warped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pd.Series(np.nan, pdf.index, dtype=float)
            sizes = pdf[col].map(len, na_action="ignore")
            for n, own in pdf[col].groupby(sizes):
                if n > 0:
                    out[own.index] = warp(wanted, np.stack(own.to_list()))
            yield pd.DataFrame({key: pdf[key], "dtw": out.astype(object).where(out.notna(), None)})

    return rows.select(key, col).mapInPandas(warped, f"{key} {rows.schema[key].dataType.simpleString()}, dtw double")


BEST = (
    "score double, li int, si int, start_m double, end_m double, gain_ft double, loss_ft double, direction string, "
    "start_lat double, start_lon double, shape_score double, dist_score double, gain_dev double, grade_seq array<double>"
)


def _best(dist: np.ndarray, ele: np.ndarray, lat, lon, t: Target, c: MatchConfig) -> tuple | None:
    """The best window; of equal scores (to nine places) the first by length, start and direction."""
    best, key = None, np.inf
    for b in scored(dist, ele, t, c):
        rounded = np.round(b["score"], 9)
        i, way = np.unravel_index(int(np.argmin(rounded)), rounded.shape)
        if rounded[i, way] < key:
            key, best = rounded[i, way], (b, i, way)
    if best is None:
        return None
    b, i, way = best
    start, end = float(b["start"][i]), float(b["start"][i] + b["length"])
    gain, loss = (b["gain"][i], b["loss"][i]) if way == 0 else (b["loss"][i], b["gain"][i])
    begin = end if way else start
    place = [float(np.interp(begin, dist, np.asarray(v, float))) if v is not None and len(v) == len(dist) else None for v in (lat, lon)]
    grades = b["grades"][i] if way == 0 else -b["grades"][i][::-1]
    return (
        float(b["score"][i, way]), b["li"], int(b["si"][i]), start, end, float(gain) * FOOT_PER_M, float(loss) * FOOT_PER_M, "reverse" if way else "forward",
        *place, float(b["shape"][i, way]), float(b["dist"][i, way]), float(b["dev"][i]), (grades + 0.0).tolist(),
    )


def usable(streams: DataFrame, t: Target, c: MatchConfig) -> DataFrame:
    """Streams long enough for a window, with as many elevations as distances and none missing."""
    return streams.where(
        (F.size("dist") > 0) & (F.size("dist") == F.size("ele")) & (F.element_at("dist", -1) >= c.min_window_frac * t.length_m)
    ).where(~F.exists("ele", lambda e: e.isNull() | F.isnan(e)) & ~F.exists("dist", lambda d: d.isNull() | F.isnan(d)))


def best_window(streams: DataFrame, t: Target, c: MatchConfig) -> DataFrame:
    """streams (segment_id, dist, ele, lat, lon; lat and lon may be null) with the best window of each."""
    source = usable(streams, t, c).select("segment_id", "dist", "ele", "lat", "lon")

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in BEST.split(", ")]
        for pdf in parts:
            rows = [(s, r) for s, d, e, la, lo in pdf.itertuples(index=False) if (r := _best(np.asarray(d, float), np.asarray(e, float), la, lo, t, c))]
            yield pd.DataFrame([(s, *r) for s, r in rows], columns=["segment_id", *names]).astype({"li": "int32", "si": "int32", "start_lat": "float64", "start_lon": "float64"})

    return source.mapInPandas(match, f"segment_id {source.schema['segment_id'].dataType.simpleString()}, {BEST}")


def enumerate_windows(lengths: DataFrame, t: Target, c: MatchConfig) -> DataFrame:
    """profile_id, li, si, start_m, win_len of every window that fits into a profile of length total."""
    step = c.start_step_m(t.length_m)
    fracs = F.array(*[F.struct(F.lit(i).alias("li"), F.lit(t.length_m * f).alias("win_len")) for i, f in enumerate(c.length_fracs)])
    each = lengths.where(F.col("total") >= c.min_window_frac * t.length_m).select("profile_id", "total", F.explode(fracs).alias("w")).select("profile_id", "total", "w.*").where("win_len <= total")
    n = F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("win_len") + 1e-9) / step).cast("int"))
    return each.select("profile_id", "li", "win_len", F.explode(F.sequence(F.lit(0), n - 1)).alias("si")).select("profile_id", "li", "si", (F.col("si") * F.lit(step)).alias("start_m"), "win_len")


#: Rows of features that are handed on at a time.
FLUSH = 100_000


def _frame(held: list[tuple]) -> pd.DataFrame:
    names = ["segment_id", "li", "si", "gain_m", "loss_m", "first_grade", "last_grade"]
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*held))})


FEATURES = "li int, si int, gain_m double, loss_m double, first_grade double, last_grade double"


def window_features(streams: DataFrame, t: Target, c: MatchConfig) -> DataFrame:
    """Vertical travel and outer grades of every window of every stream, run forward."""
    source = usable(streams, t, c).select("segment_id", "dist", "ele")

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in parts:
            for s, d, e in pdf.itertuples(index=False):
                for b in sampled(np.asarray(d, float), np.asarray(e, float), t, c):
                    g, n = b["grades"], len(b["si"])
                    held.append(([s] * n, np.full(n, b["li"], np.int32), b["si"].astype(np.int32), b["gain"], b["loss"], g[:, 0], g[:, -1]))
                    rows += n
                if rows >= FLUSH:
                    yield _frame(held)
                    held, rows = [], 0
        if held:
            yield _frame(held)

    return source.mapInPandas(features, f"segment_id {source.schema['segment_id'].dataType.simpleString()}, {FEATURES}")
