"""Secret scans: three fixed patterns, and character Markov models for strings that no pattern names.

Two models of neighbouring characters, one of random strings and one of ordinary identifiers and words, are trained from
labelled samples. A long run of key characters is a secret if the random model explains it better by a clear log
likelihood ratio. If it doesn't as a whole, each stretch of it that does is one, widened to the next sign that joins
words, so what surrounds a key can't outweigh it. Everything runs as DataFrame functions in the JVM; the model is one array of CLASSES squared numbers.

Places are in code points, ends exclusive. They come from the gaps between matches: match i starts where the gaps before
it and the matches before it end. Such running sums go by blocks, and redaction cuts a text into chunks once, so the
work grows with a text and its matches, not with their product. Whole texts are scanned. A null text is an empty one and
has no secrets. Rows and columns are kept as they come, but a column named secrets is replaced by the result; an empty
table gives an empty result and, where nothing can be learned, the ordinary model is uniform.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Fixed: the base patterns, and the least length of what counts: group 2 of an assignment, all of the others.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

#: Runs that the models judge. A shorter one tells too little.
LEAST = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
#: Least log likelihood ratio of a secret, in all and for each pair of characters.
RATIO, RATIO_EACH = 20.0, 0.5
#: Pairs that a class's row of a model is shrunk by.
SHRINK = 20.0
#: Elements of a block of running sums, and code points of a chunk of a text that is redacted.
BLOCK, CHUNK = 256, 1024
#: Bounds of the labelled samples: documents that words are taken from, and random strings of each form.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 1000
#: Words of identifiers, labelled as ordinary beside the sample: a corpus of prose needn't hold any.
IDENTIFIERS = (
    "abstract access account action active adapter add address after agent alias all allow append apply argument array assert async atomic attribute auth "
    "average background backup base batch before begin bind block body boolean boundary branch bridge broker browser buffer build bundle button byte cache "
    "calculate callback cancel capacity category change channel character check child class clean client clock clone close cluster code collection column "
    "command comment commit common compare complete component compress config connect constant construct container content context control convert copy "
    "count create current cursor custom data date debug decode default delegate delete depth describe detail device dialog directory disable display "
    "document domain download driver dynamic edge editor element enable encode engine entity entry enum environment error event exception execute exist "
    "export expression extension factory failure feature fetch field file filter final flag folder format frame function gateway generate global graph "
    "group handler hash header height helper hidden history host identity image implementation import index info init input insert instance integer "
    "interface internal invalid invoke item iterator job join json kernel key label language layer layout length level library limit line link list"
)


def _class(c: Column) -> Column:
    """The number of a character: its place in the alphabet, 0 for any other."""
    return F.call_function("instr", F.lit(ALPHABET), c)


def _array(numbers: list, kind: str) -> str:
    """SQL of a constant array; the optimiser makes it one literal."""
    return f"from_json('{json.dumps(numbers)}', 'array<{kind}>')"


def _counts(strings: DataFrame) -> dict[tuple[int, int], int]:
    """How often each pair of classes stands side by side; at most CLASSES squared rows reach the driver."""
    pairs = strings.where(F.length("s") > 1).select(F.explode(F.expr("zip_with(slice(split(s, ''), 1, length(s) - 1), slice(split(s, ''), 2, length(s) - 1), (a, b) -> concat(a, b))")).alias("p"))
    counted = pairs.groupBy("p").agg(F.count("*").alias("n")).select(F.expr(f"instr('{ALPHABET}', substr(p, 1, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substr(p, 2, 1))").alias("b"), "n")
    return {(r["a"], r["b"]): r["n"] for r in counted.collect()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The log likelihood ratios of all pairs of classes, random over ordinary.

    Random: digests written in base 64, with and without its signs, and as key-like capitals, and the values that the
    base patterns find in the sample, but those in base 16, which have a pattern. Ordinary: all other words of the sample that are
    too short to be judged, and neighbouring ones joined as identifiers are: by signs, in camel case, or not; and, with
    equal weight, IDENTIFIERS joined alike. The sample is at most SAMPLE_DOCS documents in expectation, by a hash of the id.
    """
    spark = docs.sparkSession
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    keys = F.concat(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    found = sample.select(F.explode(keys).alias("s")).where((F.length("s") >= 16) & ~F.col("s").rlike("^[0-9a-f]+$"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    made = spark.range(SAMPLE_STRINGS).select(F.explode(F.array(F.substring(F.base64(F.unhex(digest)), 1, 40), F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")), F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""))).alias("s"))
    clear = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.filter(F.regexp_extract_all(clear, F.lit("[A-Za-z0-9+/_=-]+"), F.lit(0)), lambda w: F.length(w) < 20)
    styles = "element_at(array(concat(a, '_', b), concat(a, '-', b), concat(a, '/', b), concat(a, b), concat(a, initcap(b)), concat(initcap(a), initcap(b))), cast(pmod(hash(a, b), 6) as int) + 1)"
    joined = F.expr(f"zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> {styles})")
    ordinary = sample.select(words.alias("w")).select(F.explode(F.concat(F.col("w"), joined)).alias("s"))
    code = spark.range(24).select("id", F.split(F.lit(IDENTIFIERS), " ").alias("w")).select(F.explode(F.expr(f"zip_with(w, transform(w, (x, i) -> w[pmod(i * (2 * id + 3) + id, size(w))]), (a, b) -> {styles})")).alias("s"))
    random, plain, named = (_probabilities(_counts(s)) for s in (found.unionByName(made), ordinary, code))
    return [round(log(random[i]) - log((plain[i] + named[i]) / 2), 6) for i in range(CLASSES * CLASSES)]


def _probabilities(counts: dict[tuple[int, int], int]) -> list[float]:
    """Of each class after each other, shrunk towards how often the class comes at all."""
    whole = sum(counts.values())
    alone = [(sum(counts.get((a, b), 0) for a in range(CLASSES)) + 0.5) / (whole + 0.5 * CLASSES) for b in range(CLASSES)]
    out = []
    for a in range(CLASSES):
        total = sum(counts.get((a, b), 0) for b in range(CLASSES))
        out += [(counts.get((a, b), 0) + SHRINK * alone[b]) / (total + SHRINK) for b in range(CLASSES)]
    return out


def _private(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has."""
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, most: bool = False) -> Column:
    """For each of an array of numbers from 0 on the sum (or the most) of those before it, by blocks of BLOCK."""
    none = F.expr("cast(array() as array<int>)")

    def joined(a: Column, b: Column) -> Column:
        return F.greatest(a, b) if most else a + b

    def run(block: Column, base: Column) -> Column:
        step = lambda acc, x: F.struct(joined(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, F.struct(base.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
        totals = lambda b: F.transform(b, lambda x: F.aggregate(x, F.lit(0), joined))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, run(totals(b), F.lit(0)), run)))

    return F.when(F.size(values) > 0, _let(values, whole)).otherwise(none)


def _matches(text: str, pattern: str, group: int | None = None) -> Column:
    """The gaps g before a pattern's matches m in a text, with v their group; the last gap has no match. Null without one."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    return F.when(F.col(text).rlike(pattern), F.arrays_zip(F.split(text, pattern, -1).alias("g"), matches.alias("m"), values.alias("v")))


def _spans(no: int, matches: str, ok: str | list[float]) -> Column:
    """The spans (start, kind, end) of matches for which ok holds, or of the stretches that a model finds in them."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    sizes = F.transform(matches, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(no).alias("kind"), end.alias("end"))

    def whole(x: Column) -> Column:
        return span(x["at"], x["at"] + F.length(x["m"]))

    placed = F.zip_with(matches, _before(sizes), lambda x, at: F.struct((at + F.length(x["g"])).alias("at"), x["m"].alias("m"), x["v"].alias("v")))
    if isinstance(ok, list):
        stretches = lambda x: F.transform(_stretches(ok, x["v"]), lambda p: span(x["at"] + p["a"], x["at"] + p["b"]))
        each = F.transform(F.filter(placed, lambda x: x["m"].isNotNull()), lambda x: F.when(_holds(ok, x["v"]), F.array(whole(x))).otherwise(stretches(x)))
        found = F.flatten(each)
    else:
        found = F.transform(F.filter(placed, lambda x: x["m"].isNotNull() & _holds(ok, x["v"])), whole)
    return F.coalesce(found, none)


def _holds(ok: str | list[float], value: Column) -> Column:
    if ok == "true":
        return F.lit(True)
    if ok == "long":
        return F.length(value) >= ASSIGN_LEAST
    n = F.length(value) - 1
    ratio = F.aggregate(_pairs(ok, value), F.lit(0.0), lambda s, x: s + x)
    return (ratio >= RATIO) & (ratio >= RATIO_EACH * n)


def _pairs(model: list[float], value: Column) -> Column:
    """The log likelihood ratio of each pair of neighbouring characters."""
    table = F.expr(_array(model, "double"))
    classes = F.transform(F.split(value, ""), _class)
    n = F.length(value) - 1
    return F.zip_with(F.slice(classes, 1, n), F.slice(classes, 2, n), lambda a, b: F.get(table, a * CLASSES + b))


def _stretches(model: list[float], value: Column) -> Column:
    """All stretches (a, b) of a run that are secrets by themselves, of RUN's least length or more when widened.

    A running sum of what each pair has over RATIO_EACH starts anew at zero, and where it fell by RATIO.
    """
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("a"), F.lit(0.0).alias("best"), F.lit(0).alias("b"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at, total = acc["at"] + 1, acc["sum"] + x - RATIO_EACH
        over = (total <= 0) | (total <= acc["best"] - RATIO)
        good = over & (acc["best"] + RATIO_EACH * (acc["b"] - acc["a"]) >= RATIO)
        one = F.array(F.struct(acc["a"].alias("a"), (acc["b"] + 1).alias("b")))
        return F.struct(
            at.alias("at"), F.when(over, 0.0).otherwise(total).alias("sum"), F.when(over, at).otherwise(acc["a"]).alias("a"),
            F.when(over, 0.0).otherwise(F.greatest(acc["best"], total)).alias("best"),
            F.when(over, at).when(total > acc["best"], at).otherwise(acc["b"]).alias("b"), F.when(good, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"),
        )

    found = F.aggregate(F.concat(_pairs(model, value), F.array(F.lit(-1e9))), zero, step)["found"]
    before = lambda p: F.length(F.regexp_extract(F.substring(value, F.lit(1), p["a"]), "[A-Za-z0-9+]*$", 0))
    after = lambda p: F.length(F.regexp_extract(F.substring(value, p["b"] + 1, F.length(value)), "^[A-Za-z0-9+]*", 0))
    wide = F.transform(found, lambda p: F.struct((p["a"] - before(p)).alias("a"), (p["b"] + after(p)).alias("b")))
    return F.array_distinct(F.filter(wide, lambda p: p["b"] - p["a"] >= LEAST))


def _apart(base: str, more: str) -> Column:
    """The spans of more that overlap none of base.

    All stand in one row, base spans by their start and the others by their end, before a base span there. Of base spans
    that stand before one of more, the furthest end tells whether any reaches into it.
    """
    events = F.array_sort(F.concat(F.transform(more, lambda s: F.struct(s["end"].alias("place"), F.lit(0).alias("of"), s.alias("s"))), F.transform(base, lambda s: F.struct(s["start"].alias("place"), F.lit(1).alias("of"), s.alias("s")))))

    def free(row: Column) -> Column:
        reach = _before(F.transform(row, lambda e: F.when(e["of"] == 1, e["s"]["end"]).otherwise(F.lit(0))), most=True)
        clear = F.filter(F.zip_with(row, reach, lambda e, r: F.struct(e["s"].alias("s"), ((e["of"] == 0) & (r <= e["s"]["start"])).alias("ok"))), lambda e: e["ok"])
        return F.transform(clear, lambda e: e["s"])

    return F.when((F.size(more) > 0) & (F.size(base) > 0), _let(events, free)).otherwise(F.col(more))


def scan(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """docs with secrets: all spans (start, kind, end), by start and then kind. Kinds count as in KINDS."""
    text, base, more, *found = _private(docs, "text", "base", "more", "assign", "access", "hex", "run")
    out = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumns(dict(zip(found, (_matches(text, ASSIGN, 2), _matches(text, ACCESS), _matches(text, HEX), _matches(text, RUN)))))
    out = out.withColumns({base: F.concat(_spans(0, found[0], "long"), _spans(1, found[1], "true"), _spans(2, found[2], "true")), more: _spans(3, found[3], model)})
    return out.withColumn("secrets", F.array_sort(F.concat(base, _apart(base, more)))).drop(text, base, more, *found)


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in the text replaced by a mark, overlapping ones by one."""
    chunks, = _private(docs, "chunks")
    found = scan(docs, model, text_col).withColumn(text_col, F.col(text_col).cast("string"))
    found = found.withColumn(chunks, F.when(F.size("secrets") > 0, F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def piece(a: Column, b: Column) -> Column:
        """The text from a to b, which lies in one chunk or reaches from one to another."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        head = lambda n: F.substring(F.coalesce(F.get(chunks, i), F.lit("")), a % CHUNK + 1, n)
        tail = F.substring(F.coalesce(F.get(chunks, j), F.lit("")), F.lit(1), b % CHUNK)
        return F.when(i == j, head(b - a)).otherwise(F.concat(head(F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), tail))

    ends = F.transform("secrets", lambda s: s["end"])
    fresh = F.filter(F.zip_with("secrets", _before(ends, most=True), lambda s, at: F.struct(at.alias("a"), s["start"].alias("b"))), lambda x: x["b"] >= x["a"])
    cut = F.concat(F.array_join(F.transform(fresh, lambda x: F.concat(piece(x["a"], x["b"]), F.lit(mark))), ""), piece(F.array_max(ends), F.length(text_col)))
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, cut).otherwise(F.col(text_col))).drop("secrets", chunks)


def _written(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, train(docs))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    counts = {f"n_{k}": F.expr(f"cast(size(filter(secrets, s -> s.kind = {i})) as long)") for i, k in enumerate(KINDS)}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("secrets")).alias("spans"))
