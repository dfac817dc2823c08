"""A corpus pipeline over the documents: language, near copies, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the docs of the next.
Each begins with the executors' heaps as small as they get, as what one stage took would stay beside the workers of the next.
All but the last return the columns of documents. A null in any column, texts of any length, repeated rows, empty tables
and further columns are as the operators' docstrings say; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm import jaccard, language, mixing, packing, secrets
from gradeline.llm.common import discard, documents, give_back_heap, small_batches, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies of the corpus: words of a shingle and least Jaccard similarity, in percent. op7_grouped_prefix_join has its own.
COPY_WORDS, COPY_NEAR = 5, 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is ambiguous; learns from those that aren't held out."""
    give_back_heap(spark)
    model = language.fit(docs, ~language.held_out())
    return language.identify(docs.select(*COLUMNS), model).where("NOT ambiguous").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies, that with the smallest id, and every row without a word.

    Near copies share COPY_NEAR percent or more of their distinct shingles of COPY_WORDS words, directly or by a chain.
    Rows are told apart by a number, not by id: different texts under one id, or without an id, are documents of their
    own, and copies among them go. A row with an id is kept before one without; rows alike in id are told by number.
    """
    give_back_heap(spark)
    place = F.monotonically_increasing_id()
    # the number of the partition, mixed into the lower half, keeps filters on the number's last bits selective
    number = place.bitwiseXOR((F.shiftright(place, 33) * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << 33) - 1)))
    rows = written(docs.select(*COLUMNS, number.alias("row")), "copy-rows")
    found = jaccard.near_components(rows, id_col="row", words=COPY_WORDS, near=COPY_NEAR).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = rows.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark. n_chars follows the text."""
    give_back_heap(spark)
    small_batches(spark)
    clean = secrets.redact(docs.select(*COLUMNS), secrets.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix through a document, its text cut to the words that the pass takes.

    A pass that takes all words keeps the text as it is; documents that the mix doesn't take go.
    """
    give_back_heap(spark)
    small_batches(spark)
    docs = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "mix-rows")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(mixing.WORD)), F.lit(0)).cast("long")
    spans = mixing.schedule(docs.select("row", "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tie")))
    spans = spans.where("first IS NOT NULL").select("row", "first", "last", "size")
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")), " ")
    whole = (F.col("first") == 0) & (F.col("last") == F.col("size"))
    taken = docs.join(spans, "row").withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    return taken.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2,048 tokens."""
    import public_tokenizers as P

    give_back_heap(spark)
    return packing.pack(docs, P.path("word_bpe_49k.json"), end=1)


STAGES = [("language", by_language), ("near_copies", without_copies), ("secrets", without_secrets), ("mix", mixed), ("pack", packed)]

#: Tokenizers and trained models aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
