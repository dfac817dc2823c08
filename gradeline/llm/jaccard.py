"""Grouped prefix join: documents whose sets of word shingles have a Jaccard similarity of at least near percent.

1. Texts become sets of hashed shingles, ordered by how many documents hold them (counted in hash buckets) from the
   rarest. Similar sets share a shingle among the first few of each: their prefixes. Equal sets are one set from here.
2. Sets of one size with one prefix form a group. Groups meet in the lists of documents under each prefix shingle, and
   pairs of groups are filtered by size and by the places of the shingle in both prefixes.
3. In each list all are first held against a pivot, the one that has the shingle furthest in front, and so has the
   fewest shingles of its own: within groups of near copies it links most. Members are held against their group. What
   these links connect needs no more pairs. Then groups are expanded, and every pair of members of a list that lie in
   different components is verified, so no link between components is lost and no pairs within one are made.
4. Pairs are verified on bitmaps of parities, which bound the difference from below, then on the sets themselves. A
   bitmap has at least four bits for each shingle in which linked sets may differ, so it tells at any size.

Counts of buckets and the bits of a bitmap decide what is looked at first and how much is verified, never what links.

A document without words or text has an empty set and links with nothing; with fewer words than a shingle the whole
sequence is its shingle. The component of a document is the smallest id that it reaches. Null ids are kept, and are
nobody's smallest id. Repeated rows come back as often. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, forget, give_back_driver, released, small_batches, written
from .components import components

#: Words of a shingle and the similarity of a link, in percent, where a caller names none: those of op7_grouped_prefix_join.
WORDS, NEAR = 3, 90
#: Hash buckets of shingles that are counted, in blocks of so many; least bits of a bitmap.
BUCKETS, BLOCK, BITS = 1 << 22, 1 << 16, 512
#: Marks of a filter: which shingles, or ids, may be among those sought. Their number is fixed, so a filter that fills up
#: lets more through to the joins behind it and costs time, not results.
MARKS = 1 << 25
#: Bytes of text that are hashed at a time.
TOGETHER = 1 << 18

_U = np.uint64
_rng = np.random.default_rng(7)
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_step = _U(0x9E3779B97F4A7C15)
_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] += 32
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_byte[_white] = 0


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> _U(27)) * _U(0x94D049BB133111EB)
    return h ^ h >> _U(31)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    out: list[np.ndarray] = []
    at, data = 0, [(t or "").encode() for t in texts]
    while at < len(data):
        to, held = at, 0
        while to < len(data) and (to == at or held + len(data[to]) < TOGETHER):
            held, to = held + len(data[to]), to + 1
        out += _sets(data[at:to], words)
        at = to
    return out


def _sets(data: list[bytes], words: int) -> list[np.ndarray]:
    b = _fold[np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    white = _white[b]
    start = np.flatnonzero(~white[1:] & white[:-1]) + 1
    none = np.zeros(0, np.uint64)
    if not len(start):
        return [none] * len(data)
    owner = np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(b))))])
    place = np.arange(len(b)) - owner
    place[white] = 0
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 1, _step))
        word = _mixed(np.add.reduceat(_byte[b] * power[place], start))
        doc = np.searchsorted(ends, start, "right")
        n = np.bincount(doc, minlength=len(data))
        h = np.zeros(max(len(word) - words + 1, 0), np.uint64)
        for k in range(words):
            h = (h + word[k : k + len(h)]) * (_step + _U(2 * k))
        h = _mixed(h)[doc[: len(h)] == doc[words - 1 :]] if len(h) else h
        of = np.maximum(n - words + 1, 0)
        first, at = np.cumsum(n) - n, np.cumsum(of) - of
        sets = []
        for i in range(len(data)):
            if of[i]:
                sets.append(np.unique(h[at[i] : at[i] + of[i]]))
            elif n[i]:
                short = _U(n[i])
                for w in word[first[i] : first[i] + n[i]]:
                    short = (short + w) * (_step + _U(64))
                sets.append(_mixed(np.array([short], np.uint64)))
            else:
                sets.append(none)
    return sets


def _need(n: int, near: int) -> int:
    """The least overlap of a set of n with any that it links with."""
    return -(-n * near // 100)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(40)).astype(np.int64) & (BUCKETS - 1)


def _bits(n: int, near: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, so that one of a size folds into one of half as many."""
    return max(BITS, 1 << (8 * n * (100 - near) // (100 + near)).bit_length())


def _bitmap(h: np.ndarray, near: int) -> np.ndarray:
    bits = _bits(len(h), near)
    odd = (np.bincount((h & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def _count(words: int):
    """Counts of one task, where one byte tells them: from 255 on they are alike."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            if sets:
                np.add.at(total, _bucket(np.concatenate(sets)), np.uint32(1))
        if total.any():
            blocks = np.minimum(total, 255).astype(np.uint8).reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([zlib.compress(r, 1) for r in blocks], pa.binary())], names=["block", "counts"])

    return make


def _summed(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of one block; a sum is kept to the places that an order needs."""
    total = np.zeros(BLOCK, np.int64)
    for pdf in parts:
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint8)
    yield pd.DataFrame({"block": [key[0]], "counts": [_rank(total).tobytes()]})


def _rank(total: np.ndarray) -> np.ndarray:
    """A count as one byte that keeps the order: small ones as they are, larger ones by eighths of a power of two."""
    exponent = np.maximum(np.floor(np.log2(np.maximum(total, 1))).astype(np.int64) - 3, 0)
    return np.minimum(exponent * 8 + (total >> exponent), 255).astype(np.uint8)


def _bucket_counts(docs: DataFrame, words: int) -> np.ndarray:
    """Ranks of the hash buckets by their shingles in all documents: BUCKETS bytes, however large the input."""
    parts = docs.select("text").mapInArrow(released(_count(words)), "block int, counts binary")
    rows = parts.groupBy("block").applyInPandas(_summed, "block int, counts binary").collect()
    counts = np.zeros(BUCKETS, np.uint8)
    for r in rows:
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return counts


def _prefixed(counts: np.ndarray, words: int, near: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            n, digest, group, prefix, bitmap = [], [], [], [], []
            for h in sets:
                n.append(len(h))
                if not len(h):
                    digest.append(None), group.append(None), prefix.append(None), bitmap.append(None)
                    continue
                own = h[np.lexsort((h, counts[_bucket(h)]))[: len(h) - _need(len(h), near) + 1]].view(np.int64)
                digest.append(hashlib.md5(h.tobytes()).digest())
                group.append(hashlib.md5(len(h).to_bytes(8, "little") + own.tobytes()).digest())
                prefix.append(own)
                bitmap.append(_bitmap(h, near))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(group, pa.binary()), pa.array(prefix, longs), pa.array(bitmap, longs)], names=["doc_id", "n", "digest", "grp", "prefix", "bitmap"])

    return make


def _marks(df: DataFrame, col: str) -> np.ndarray:
    """MARKS bits, of which those at the values of a column are set. At most MARKS bits reach the driver."""
    place = F.pmod(F.col(col), F.lit(MARKS)) + 1
    rows = df.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("b")).collect()
    out = np.zeros(MARKS // 8, np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["b"], np.uint8)
    return out


def _marked(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.mod(values, MARKS)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _sets_of(left: np.ndarray, right: np.ndarray, words: int):
    """The sets of ids that may stand on the left or the right of a pair, and on which side."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            is_u, is_v = _marked(left, ids), _marked(right, ids)
            any_side = is_u | is_v
            batch = batch.filter(pa.array(any_side))
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(is_u[any_side]), pa.array(is_v[any_side])], names=["rep", "s", "is_u", "is_v"])

    return make


def _entries(marks: np.ndarray):
    """The prefix shingles of groups that may be in a list."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy()
            token = batch.column(2).flatten().to_numpy()
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            on = _marked(marks, token)
            of = pa.array(of[on])
            yield pa.RecordBatch.from_arrays([pa.array(token[on]), pa.array(place[on].astype(np.int32)), batch.column(0).take(of), batch.column(1).take(of)], names=["token", "p", "gid", "n"])

    return make


def _overlap(a: str, b: str, near: int) -> str:
    """SQL of the least overlap with which sets of these sizes link."""
    return f"(({near} * ({a} + {b}) + {near + 99}) div {near + 100})"


def _plausible(a: str, b: str, near: int) -> str:
    """Filter of a pair by sizes n and by the places p of a shingle that both prefixes hold."""
    return f"least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * {near} AND least({a}.n - {a}.p, {b}.n - {b}.p) >= {_overlap(f'{a}.n', f'{b}.n', near)}"


def _folded(a: str, b: str) -> str:
    """SQL of bitmap a, folded to the size of b where it is twice as large; more can't pass the size filter."""
    return f"IF(size({a}) > size({b}), zip_with(slice({a}, 1, size({b})), slice({a}, size({b}) + 1, size({b})), (x, y) -> x ^ y), {a})"


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, near: int) -> DataFrame:
    """The pairs (u, v) of representatives that link. Sets and bitmaps are merged in by key at any size: both sides grow.

    Each set goes once to the side on which its id stands; only those of v are copied for each of their pairs.
    """
    left, right = (sets.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"b{c}")) for c in ("u", "v"))
    differ = f"aggregate(zip_with({_folded('bu', 'bv')}, {_folded('bv', 'bu')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    close = pairs.distinct().join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(f"{differ} <= nu + nv - 2 * {_overlap('nu', 'nv', near)}").select("u", "v", "nu", "nv")
    close = written(close, "close-pairs")
    sides = _sets_of(_marks(close, "u"), _marks(close, "v"), words)
    found = written(docs.where("doc_id IS NOT NULL").mapInArrow(released(sides), "rep long, s array<long>, is_u boolean, is_v boolean"), "verify-sets")
    a, b = (found.where(f"is_{c}").select(F.col("rep").alias(c), F.col("s").alias(f"s{c}")) for c in ("u", "v"))
    both = F.size(F.array_intersect("su", "sv"))
    links = close.join(b.hint("merge"), "v").join(a.hint("merge"), "u").where((near + 100) * both >= near * (F.col("nu") + F.col("nv"))).select("u", "v")
    links = written(links, "links")
    discard(close, found)
    give_back_driver(docs.sparkSession)
    return links


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles and component_id of each document: shingles of so many words, links from near percent on."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = _bucket_counts(docs, words)
    every = written(docs.mapInArrow(released(_prefixed(counts, words, near)), "doc_id long, n long, digest binary, grp binary, prefix array<long>, bitmap array<long>"), "prefixes")

    # equal sets, and groups of one size and prefix; both are named by their smallest id
    classes = written(every.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "grp", "n").agg(F.min("doc_id").alias("rep")), "classes")
    groups = written(classes.groupBy("grp").agg(F.min("rep").alias("gid"), F.count("*").alias("members")), "groups")
    members = written(classes.join(groups, "grp").select("rep", "gid", "members"), "members")
    firsts = every.select(F.col("doc_id").alias("rep"), "n", "bitmap", "prefix").join(members, "rep")
    firsts = written(firsts.withColumn("prefix", F.when(F.col("rep") == F.col("gid"), F.col("prefix"))), "representatives")
    sets, heads = firsts.select("rep", "n", "bitmap"), firsts.where("rep = gid").select("gid", "n", "members", "prefix")

    give_back_driver(docs.sparkSession)

    # lists under prefix shingles that more than one document has
    entries = heads.select(F.posexplode("prefix").alias("p", "token"), "gid", "n", "members")
    shared = written(entries.groupBy("token").agg(F.sum("members").alias("c")).where("c > 1").select("token"), "lists")
    likely = heads.select("gid", "n", "prefix").mapInArrow(released(_entries(_marks(shared, "token"))), "token long, p int, gid long, n long")
    lists = written(likely.join(shared, "token", "left_semi"), "entries")
    discard(shared)

    pivots = lists.groupBy("token").agg(F.min(F.struct("p", "gid", "n")).alias("x")).select("token", "x.p", "x.gid", "x.n").alias("a")
    first = lists.alias("b").join(pivots, F.expr(f"a.token = b.token AND a.gid <> b.gid AND {_plausible('a', 'b', near)}")).selectExpr("least(a.gid, b.gid) AS u", "greatest(a.gid, b.gid) AS v")
    first = first.unionByName(members.where("rep <> gid").selectExpr("gid AS u", "rep AS v"))
    links = _verified(first, sets, docs, words, near)
    so_far = components(links)

    placed = members.join(so_far.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "gid", F.coalesce("component", "rep").alias("comp"))
    spread = written(lists.join(placed, "gid"), "placed")
    mixed = spread.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    rest = written(spread.join(mixed, "token", "left_semi"), "placed")
    discard(lists, spread)
    second = rest.alias("a").join(rest.alias("b"), F.expr(f"a.token = b.token AND a.comp <> b.comp AND a.rep < b.rep AND {_plausible('a', 'b', near)}")).selectExpr("a.rep AS u", "b.rep AS v")
    more = _verified(second, sets, docs, words, near)
    found = components(links.unionByName(more))
    discard(rest)

    final = written(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "class-components")
    out = every.join(final, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    out = written(out, "near-components")
    discard(every, classes, groups, members, firsts, final, links, more, so_far, found)
    return out


def op7_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents."""
    return near_components(documents(spark, sf_dir), words=WORDS, near=NEAR)
