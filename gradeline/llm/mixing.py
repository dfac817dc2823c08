"""Mixing of sources to target weights by a low-discrepancy schedule.

The words of each source, its documents shuffled by a hash, form one axis that is cut into blocks of equal size. The
mix is a row of slots: slot i takes the point frac((i + 1) / golden ratio), and the source into whose stretch of the
cumulative targets the point falls gets the slot. The k-th slot of a source takes the k-th block of its axis, again
from the start after the last one, and the last slot is cut so that the source ends at its target. Where the points
leave a source short of its last few slots, these are appended.

Nothing collects a source in a task: places on the axis are sums within hash buckets plus the buckets' prefix sums, and
ranks of slots are counts within chunks plus the chunks' prefix sums. Slots meet blocks in a join on (source, block).

Nulls: a null text has size 0; null sources form one source, the last. Documents of size 0 are taken 0 times. Repeated
rows are rows of their own. An empty table gives an empty result. Further columns aren't read.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, written

#: Rows of a hash bucket and slots of a chunk, about; sources with more rows get more buckets. Buckets, or chunks, that are
#: summed up in one task, and whose sums then are.
BUCKET, CHUNK, TOGETHER = 256, 256, 4096
#: Words of a block. It decides how finely sources alternate, at every size alike; targets are met whatever it is.
BLOCK = 1024
#: Cells of [0, 1) over which points meet the sources' stretches.
CELLS = 1024
GOLDEN = (sqrt(5) - 1) / 2


def _point(i: Column) -> Column:
    """frac((i + 1) * GOLDEN), exact enough for any i: the high and the low 20 bits apart."""
    high, low = F.floor((i + 1) / (1 << 20)), (i + 1) % (1 << 20)
    return F.pmod(F.pmod(high * F.lit((GOLDEN * (1 << 20)) % 1), F.lit(1.0)) + low * F.lit(GOLDEN), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """For each source (source, n_rows, source_size) its number in code point order, its weight and its target.

    Sources by cap over weight: those whose part of what is left reaches their cap stop there, the others share the
    rest by weight. A single task sees these rows, one for each source.
    """
    ordered = sizes.withColumn("no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("no") % len(weights) + 1).cast("int"))
    every = W.orderBy("at", "no")
    before = every.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    return (
        ordered.withColumns({"weight": w, "most": F.col("source_size") * F.lit(float(cap))})
        .withColumns({"at": F.col("most") / F.col("weight"), "all": F.sum("source_size").over(whole) * F.lit(share), "all_weight": F.sum("weight").over(whole)})
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("full", F.col("level") >= F.col("at"))
        .withColumn("rest", (F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("rest") * F.col("weight"))))
        .select("source", "no", "n_rows", "source_size", "target")
    )


def _before(sums: DataFrame, place: str, value: str, base: str) -> DataFrame:
    """sums (no, place, value) with base, the sum of the values of a source's earlier places.

    Places are summed up in groups of TOGETHER, and the groups' sums then are, so no task sees all of a source's places.
    """
    group = F.expr(f"{place} div {TOGETHER}")
    inside = F.coalesce(F.sum(value).over(W.partitionBy("no", "group").orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = sums.groupBy("no", group.alias("group")).agg(F.sum(value).alias("all"))
    whole = whole.select("no", "group", F.coalesce(F.sum("all").over(W.partitionBy("no").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return sums.withColumn("group", group).withColumn("inside_group", inside).join(whole, ["no", "group"]).select("no", place, (F.col("inside_group") + F.col("earlier")).alias(base))


def schedule(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 6, block: int = BLOCK) -> DataFrame:
    """docs has row, doc_id, source, size and tie, a hash of the text. Documents are shuffled by id and tie, so where rows
    stand in the input doesn't matter; rows alike in all of these may change places. A row for each document and pass
    through its source (one at least):

    row, doc_id, size, source_size, target, pass, first and last: the words of the document that the pass takes.
    first is null where the mix takes none.
    """
    spark = docs.sparkSession
    base = written(docs.select("row", "doc_id", "source", "size", "tie").withColumn("h", F.xxhash64("doc_id", "tie", F.lit(seed))), "mix-docs")
    plan = targets(base.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), weights, share, cap)
    words = F.col("source_size")
    plan = plan.withColumns(
        {
            "quota": F.round("target").cast("long"),
            "blocks": F.ceil(words / block),
            "bits": F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / BUCKET))).cast("int"),
        }
    )
    need = F.when(words > 0, F.expr("quota div source_size") * F.col("blocks") + F.ceil(F.expr("quota % source_size") / block)).otherwise(0)
    sources = written(plan.withColumn("need", need), "mix-sources")
    n = sources.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n")).first()["n"]

    # stretches of [0, 1), by the cells that they touch
    high = F.sum("need").over(W.orderBy("no").rowsBetween(W.unboundedPreceding, 0))
    stretches = (
        sources.where("need > 0").select("no", "need", ((high - F.col("need")) / F.lit(max(n, 1))).alias("low"), (high / F.lit(max(n, 1))).alias("high"))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    )
    chunk = max(CHUNK, 1 << max(0, (n >> 20).bit_length()))
    points = spark.range(0, n).withColumn("u", _point(F.col("id"))).withColumn("cell", F.floor(F.col("u") * CELLS))
    given = (
        points.join(stretches, "cell").where("u >= low AND u < high")
        .select("no", F.expr(f"id div {chunk}").alias("chunk"), "id")
        .withColumn("k", F.row_number().over(W.partitionBy("no", "chunk").orderBy("id")) - 1)
    )
    given = written(given, "mix-slots")
    bases = _before(given.groupBy("no", "chunk").agg(F.count("*").alias("c")), "chunk", "c", "base")
    ranked = given.join(bases, ["no", "chunk"]).select("no", (F.col("base") + F.col("k")).alias("k"))
    short = (
        sources.where("need > 0").select("no", "need").join(given.groupBy("no").agg(F.count("*").alias("got")), "no", "left")
        .withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
        .select("no", F.explode(F.expr("sequence(got, need - 1)")).alias("k"))
    )
    slots = (
        ranked.unionByName(short)
        .join(sources.select("no", "need", "blocks", "quota", "source_size"), "no").where("k < need")
        .select("no", F.expr("k div blocks").alias("pass"), F.expr("k % blocks").alias("block"), F.expr("quota - (k div blocks) * source_size").alias("limit"))
    )

    # places on the sources' axes
    own = sources.select("source", "no", "source_size", "target", "bits")
    dealt = (
        base.join(own, base["source"].eqNullSafe(own["source"])).select("row", "doc_id", "size", "tie", "h", "no", "source_size", "target", "bits")
        .withColumn("bucket", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)")))
    )
    inner = W.partitionBy("no", "bucket").orderBy("h", "doc_id", "tie", "row").rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sums = base.join(own, base["source"].eqNullSafe(own["source"])).groupBy("no", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)")).alias("bucket")).agg(F.sum("size").alias("s"))
    sums = _before(sums, "bucket", "s", "before")
    placed = dealt.join(sums, ["no", "bucket"]).withColumn("at", F.col("inside") + F.col("before"))
    pieces = placed.select(
        "row", "doc_id", "size", "no", "source_size", "target", "at",
        F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(at div {block}, (at + size - 1) div {block})"))).alias("block"),
    )
    took = pieces.join(slots, ["no", "block"], "left")
    low, high = F.greatest("at", F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block, F.col("limit"))
    took = took.withColumns({"low": low - F.col("at"), "high": high - F.col("at")}).withColumn("some", F.col("limit").isNotNull() & (F.col("high") > F.col("low")))
    return took.groupBy("row", "doc_id", "size", "source_size", "target", F.when(F.col("some"), F.col("pass")).alias("pass")).agg(
        F.min(F.when(F.col("some"), F.col("low"))).alias("first"), F.max(F.when(F.col("some"), F.col("high"))).alias("last")
    )


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row, doc_id, source, size (in words) and tie of each document."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    spans = schedule(numbered(docs), **how)
    return spans.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("taken")).drop("row")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source with weights 3, 1, 2 to 150% of their words, at most twice each source."""
    return mix(documents(spark, sf_dir))
