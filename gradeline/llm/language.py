"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a naive Bayes classifier over hashed byte n-grams tells the languages with
that bit from those without; a scale fitted by logistic regression turns its evidence into log-odds. Decoding takes the
codeword with the least logistic loss, bits weighted by how well they separate the sample, and flags a document as
ambiguous where the two nearest codewords are close.

Fitting uses a bounded sample, by a hash of id and text: in expectation at most PER_LANGUAGE labelled documents of a
language, SAMPLE in all and COUNTED bytes of counts. Of more than LANGUAGES labels the most frequent are learned, ties by
code point. Predicting reads every whole text and nothing but it.

A null text, or one without a letter, is "und" with score 0. With a single learned language every other text is it,
with none every text is "und". Ties go to the language first by code point. Rows are kept as they come, repeated or not;
other columns stay, and those named like the results are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, released, small_batches, unused

#: Bounds of the sample that the classifiers are fitted on, in documents, labels, and bytes of counts on the driver.
PER_LANGUAGE, SAMPLE, LANGUAGES, COUNTED = 1000, 20_000, 200, 1 << 27
#: Buckets for pairs and for triples of bytes.
PAIRS, TRIPLES = 1 << 12, 1 << 15
FEATURES = PAIRS + TRIPLES
UNKNOWN = "und"
#: Score under which a document is ambiguous.
SURE = 0.7
#: Bytes of text whose features are made at a time.
TOGETHER = 1 << 18

_fold = np.full(256, 32, np.uint8)
_fold[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_fold[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_fold[128:] = np.arange(128, 256)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed pairs and triples at each byte of all texts, and where each text begins.

    Two blanks stand before each text and one behind, so what looks ahead from its end sees the next one's blanks only.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    b = _fold[np.frombuffer(b"  " + b"   ".join(texts) + b"   ", np.uint8)].astype(np.uint32)
    two = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77)
    three = two + b[2:] * np.uint32(0xC2B2AE3D)
    three ^= three >> np.uint32(15)
    pairs = ((two ^ two >> np.uint32(13)) * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    triples = (three * np.uint32(0x165667B1)) >> np.uint32(17)
    return pairs.astype(np.int64), triples.astype(np.int64) + PAIRS, np.cumsum(sizes) - sizes


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) < TOGETHER):
            held, to = held + len(texts[to]), to + 1
        yield at, to
        at = to


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language, bit: 1 or -1
    weights: np.ndarray  # feature, bit
    scale: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Text, bit: summed weights over the root of the number of features."""
        out = np.zeros((len(texts), self.codes.shape[1]))
        for a, b in _groups(texts):
            pairs, triples, begin = features(texts[a:b])
            sums = np.add.reduceat(self.weights[pairs] + self.weights[triples], begin, axis=0, dtype=np.float64)
            out[a:b] = sums / np.sqrt(np.maximum([[len(t)] for t in texts[a:b]], 1))
        return out

    def decode(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest language of each row and its share among all."""
        odds = evidence * self.scale + self.bias
        loss = np.stack([np.logaddexp(0, -odds * c) @ self.trust for c in self.codes], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), (share / share.sum(1, keepdims=True)).max(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        data = [(t or "").encode() for t in texts]
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            lettered[:] = False
        score, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if len(self.languages) == 1:
            score[lettered] = 1.0
        elif lettered.any():
            lang, score = self.decode(self.evidence(data))
            score[~lettered] = 0.0
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(lang.tolist(), lettered.tolist())], score


def codewords(n: int) -> np.ndarray:
    """Language, bit: all two-sided splits of up to six languages, else ten bits per doubling drawn with a fixed seed."""
    if n < 2:
        return np.ones((n, 1), np.int64)
    if n <= 6:
        bits = [[1 if i == 0 or not m >> (i - 1) & 1 else -1 for i in range(n)] for m in range(1, 1 << max(n - 1, 0))]
        return np.array(bits, np.int64).reshape(-1, n).T
    rng = np.random.default_rng(4)
    size = 10 * int(np.ceil(np.log2(n)))
    drawn = [rng.choice([-1, 1], (n, size)) for _ in range(50)]
    drawn = [d[:, np.abs(d.sum(0)) < n] for d in drawn]
    nearest = [min(int((d != np.roll(d, k, 0)).sum(1).min()) for k in range(1, n)) for d in drawn]
    return drawn[int(np.argmax(nearest))]


def _fit(languages: list[str], label: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """docs: for each the places and counts of its features."""
    codes = codewords(len(languages))
    bits = codes.shape[1]
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((FEATURES, bits)), np.ones(bits), np.zeros(bits), np.ones(bits))
    row = np.repeat(np.arange(len(docs)), [len(p) for p, _ in docs])
    place, count = np.concatenate([p for p, _ in docs]), np.concatenate([c for _, c in docs]).astype(np.float64)
    total = np.maximum(np.bincount(row, count, len(docs)) / 2, 1)
    keep = np.ones(len(docs), bool)
    for _ in range(2):  # the second time without documents that the first fit puts elsewhere than their label
        used = keep[row]
        per = np.bincount(label[row[used]] * FEATURES + place[used], count[used], len(languages) * FEATURES).reshape(len(languages), FEATURES)
        shared = per.sum(0) + 1
        shared /= shared.sum()
        p = (per + 2000 * shared) / (per.sum(1, keepdims=True) + 2000)
        weights = np.stack([np.log(p[c > 0].mean(0)) - np.log(p[c < 0].mean(0)) for c in codes.T], 1)
        evidence = np.stack([np.bincount(row, count * weights[place, j], len(docs)) for j in range(bits)], 1) / np.sqrt(total)[:, None]
        truth = codes[label]
        scale, bias = np.full(bits, 1.0), np.zeros(bits)
        for _ in range(300):
            pull = truth / (1 + np.exp(np.clip(truth * (evidence * scale + bias), -50, 50))) * keep[:, None]
            scale += 0.5 * ((pull * evidence).sum(0) / keep.sum() - 1e-3 * scale)
            bias += 0.5 * pull.sum(0) / keep.sum()
        good = ((evidence * scale + bias) * truth > 0)[keep].mean(0)
        trust = np.maximum(2 * good - 1, 0.05)
        model = Model(languages, codes, weights.astype(np.float32), scale, bias, trust / trust.mean() * 3 / max(bits, 3))
        keep = model.decode(evidence)[0] == label
        if not all((keep & (label == i)).any() for i in range(len(languages))):
            break
    return model


def fit(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model from the rows of docs that may be learned from and have a language."""
    small_batches(docs.sparkSession)
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    # a text has two features a byte, each counted once in six bytes
    counted_bytes = F.least(F.octet_length(text) * 2 + 3, F.lit(FEATURES)).cast("double") * 6
    sizes = rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n"), F.sum(counted_bytes).alias("bytes")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return _fit([], np.zeros(0, np.int64), [])
    bound, part = max(1, min(PER_LANGUAGE, SAMPLE // len(sizes))), COUNTED / len(sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, bound / r["n"], part / r["bytes"]))])
    place = F.pmod(F.xxhash64(F.col(id_col), text, F.lit(4)), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.where(place < F.coalesce(F.try_element_at(share, lang), F.lit(0.0)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts, out = [t.encode() for t in batch.column(1).to_pylist()], []
            for text in texts:
                pairs, triples, _ = features([text])
                place, count = np.unique(np.concatenate([pairs, triples]), return_counts=True)
                out.append(place.astype("<u2").tobytes() + count.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "counts"])

    sample = chosen.select(lang.alias("lang"), text.alias("text")).mapInArrow(released(counted), "lang string, counts binary").toPandas()
    if sample.empty:
        return _fit([], np.zeros(0, np.int64), [])
    languages = sorted(set(sample["lang"]))
    sample = sample.sort_values(["lang", "counts"], kind="stable")
    found = []
    for raw in sample["counts"]:
        n = len(raw) // 6
        found.append((np.frombuffer(raw, "<u2", n).astype(np.int64), np.frombuffer(raw, "<u4", n, 2 * n)))
    return _fit(languages, np.searchsorted(languages, sample["lang"].to_numpy(str)), found)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous. Needs no exchange."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = docs.select(*kept).withColumns({"lang_pred": F.lit("x"), "score": F.lit(0.0), "ambiguous": F.lit(True)}).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            lang, score = model.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score), pa.array(score < SURE)], names=[*kept, "lang_pred", "score", "ambiguous"])

    return docs.select(*kept, F.col(text_col).cast("string").alias(unused("__text", kept))).mapInArrow(released(predict), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 4 == 2


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = documents(spark, sf_dir)
    model = fit(docs, ~held_out())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
