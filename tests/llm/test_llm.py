"""The operators against brute force, round trips and held-out rows, with nulls, empty and long texts, ties and repeats."""

import gc
import hashlib
import os
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import avi, common, jaccard, language, media, mixing, outliers, packing, quality, secrets, token_counts, token_files
from gradeline.llm.components import components
from gradeline.llm.tokenize import PieceEncoder

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, secrets string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=120):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(n)) + "."


BASE = prose(0)
ROWS = [
    (0, BASE, "en", "a"), (1, BASE.replace("a", "A"), "en", "a"), (2, BASE + " extra", "en", "b"), (3, prose(3), "de", None), (4, None, None, "b"), (5, "", "de", "b"),
    (6, "  double  blanks \n and\tlines \n\n", "en", "a"), (7, "one two", "en", "c"), (8, "One\ttwo", "de", "c"), (9, prose(9, 9000), "en", "b"), (10, prose(10), "en", "a"), (10, prose(10), "en", "a"),
    (11, "token = 'Ab3dE6gH9' and password:short and AKIA" + "Z9" * 10 + " " + "0123456789abcdef" * 2, "en", "a"),
    (12, "<|endoftext|> don't  x\x1c Ünïcode İ 日本語 !!!! aaaaaaaa", "fr", ""), (13, "12 34 !", None, "d"), (None, prose(14), "en", "a"),
    (15, "key zX9qWv7RkT2pLm8NbY4cHd6JfGs1 ends", "en", "a"),
]
IDS = [r[0] for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return (x is not None, x if x is not None else 0)


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_as_the_library_does(path):
    ids, counts = PieceEncoder(path).encode([r[1] for r in ROWS])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library(path)


def test_token_counts(docs, empty):
    got = token_counts.token_counts(docs, BYTE, 100)
    assert "secrets" in got.columns and got.columns.count("n_tokens") == 1
    want = sorted((key(r[0]), len((r[1] or "").encode()), len(ids), len(ids) > 100) for r, ids in zip(ROWS, library(BYTE)))
    assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want
    assert token_counts.token_counts(empty, BYTE, 1).count() == 0


def test_merges_of_repeats():
    t = token_counts.TokenCounter(BYTE)
    texts = ["a" * n for n in range(1, 60)] + ["ab" * 700, "!?" * 99]
    e = PieceEncoder(BYTE)
    assert t.counts(texts) == [len(x) for x in e.whole(texts)]


def test_token_files(spark, docs, empty):
    def run(df):
        folder = common.local_path(common.fresh_path(spark, "t"))
        shards = token_files.write_token_files(df, folder, BYTE, 0, 50257)
        return folder, shards, token_files.read_token_files(spark, folder, shards).collect()

    folder, shards, rows = run(docs)
    order = sorted(range(len(ROWS)), key=lambda i: key(IDS[i]))
    ids, start = library(BYTE), 0
    want = []
    for i in order:
        own = ids[i] + [0]
        want.append((IDS[i], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert token_files.Shard(folder, shards[0]["shard"], shards[0]["dtype"])[0].tolist() == ids[order[0]] + [0]
    assert run(empty)[2] == []


def sequences(rows, want):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in want)
    return by_doc, by_sequence


def test_packing(docs, empty):
    want = library(WORD)
    by_doc, by_sequence = sequences(packing.pack(docs, WORD, 1).collect(), want)
    for doc, ids in zip(IDS, want):
        if IDS.count(doc) == 1:
            ids, at = np.array(ids + [1], "<u4"), 0
            for r in sorted(by_doc[doc], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
            assert at == len(ids)
    assert sum(sum(r["length"] for r in s) < 2048 for s in by_sequence.values()) <= 1
    assert packing.pack(empty, WORD, 1).count() == 0


def test_packer_bounds():
    r, p = np.random.default_rng(0), packing.Packer(100, 0, 4, 10)
    sizes = r.integers(1, 250, 500)
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype=np.uint32))
        assert len(p.windows) <= 4
    last = p.merge()
    assert len(p.windows) <= 1
    fill = defaultdict(int)
    for row in p.rows:
        fill[row[5]] += row[2]
    assert sum(fill.values()) + sum(len(x[2]) for x in last) == sizes.sum()
    assert all(90 < n <= 100 for n in fill.values())


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    size = {i: len(WORDS.findall(r[1] or "")) for i, r in enumerate(ROWS)}
    assert sorted((key(r["doc_id"]), r["size"]) for r in got) == sorted((key(r[0]), size[i]) for i, r in enumerate(ROWS))
    names = sorted({r[3] for r in ROWS if r[3] is not None}) + [None]
    total = {s: sum(size[i] for i, r in enumerate(ROWS) if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(total.values())
    while True:
        rest = budget - sum(2 * total[s] for s in full)
        unit = rest / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and unit * weight[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * total[s] if s in full else unit * weight[s] for s in names}
    source = {r[0]: r[3] for r in ROWS}
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == total[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.5
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(empty).count() == 0


def shingles(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return {i: top(i) for i in parent}, {i: len(s) for i, s in sets}


def test_jaccard_edges(docs, empty):
    got = jaccard.near_components(docs).collect()
    assert len(got) == len(ROWS)
    want, n = brute_components([(r[0], r[1]) for r in ROWS if r[0] is not None])
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (n[r["doc_id"]], want[r["doc_id"]])
    assert jaccard.near_components(empty).count() == 0


def test_jaccard_near_copies(spark):
    r, rows = np.random.default_rng(5), []
    for g in range(6):
        base = prose(100 + g, int(r.integers(20, 200))).split()
        for _ in range(25):
            w = list(base)
            for _ in range(int(r.integers(0, 5))):
                w[int(r.integers(0, len(w)))] = f"w{r.integers(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want, n = brute_components(rows)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (want[i], n[i]) for i in want}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(100, i) for i in range(101, 130)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 21)}, **{i: 100 for i in range(101, 130)}}


ASSIGN = re.compile("((?:%s))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark, docs, empty):
    model = secrets.train(docs)
    tricky = ["token=token:abcdefgh", "日本 API_KEY : \"zzzzzz\" é Secret=ab", "AKIAAKIA" + "Q" * 16 + " x", "a" * 24 + "g" + "f" * 23, "PASSWD=''======", "", None]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    for df, texts in ((docs.select("doc_id", "text"), {r[0]: r[1] for r in ROWS}), (more, {100 + i: t for i, t in enumerate(tricky)})):
        for r in secrets.scan(df, model).collect():
            found = [(s["start"], s["kind"], s["end"]) for s in r["secrets"]]
            assert [s for s in found if s[1] < 3] == base_spans(texts[r["doc_id"]] or "")
            if r["doc_id"] == 15:
                assert [s[1] for s in found] == [3]
            elif r["doc_id"] is not None and r["doc_id"] < 11:
                assert not found
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).select("doc_id", "text").collect()}
    assert clean[15] == "key [SECRET] ends" and clean[3] == ROWS[3][1] and clean[4] is None
    assert clean[11].count("[SECRET]") == 3 and "AKIA" not in clean[11]
    assert secrets.scan(empty, secrets.train(empty)).count() == 0


def test_language(spark, docs, empty):
    r = np.random.default_rng(8)
    parts = {"aa": list("abcdefgh"), "bb": list("ijklmnop"), "cc": list("qrstuvéü")}
    rows = [(i, " ".join("".join(r.choice(parts[lang], 5)) for _ in range(30)), lang) for i in range(240) for lang in [list(parts)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, ~language.held_out())
    held = [x for x in language.identify(df.withColumn("held", language.held_out()), model).collect() if x["held"]]
    assert held and all(x["lang_pred"] == x["lang"] and not x["ambiguous"] for x in held)
    got = {x["doc_id"]: x for x in language.identify(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 13))
    assert all(0 <= x["score"] <= 1 for x in got.values())
    none = language.fit(empty, F.lit(True))
    assert {x["lang_pred"] for x in language.identify(docs, none).collect()} == {"und"} and language.identify(empty, none).count() == 0
    single = language.fit(df.where("lang = 'aa'"), F.lit(True))
    assert {x["lang_pred"] for x in language.identify(df, single).collect()} == {"aa"}
    for n in (2, 4, 9, 40):
        codes = language.codewords(n)
        assert codes.shape[0] == n and len({tuple(c) for c in codes}) == n


def base_counts(text):
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_outliers(spark, docs, empty):
    for text in ("a b c a b c a b c", "x\n\n x\nx\n x\n", "#|<>", "", "a\x1cb c", prose(1)):
        assert outliers.base_statistics(text)[:5] == base_counts(text)
    got = outliers.judge(docs).collect()
    assert len(got) == len(ROWS) and all(not r["kept"] for r in got if r["base_failed"])
    good = [(i, prose(200 + i), "en", f"s{i % 2}") for i in range(600)]
    bad = [(1000 + i, "".join(w + "### " for w in prose(900 + i).split()), "en", "s0") for i in range(20)]
    rows = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(good + bad + good[:50], "doc_id long, text string, lang string, source string")).collect()}
    assert sum(rows[i] for i in range(600)) >= 598 and not any(rows[1000 + i] for i in range(20))
    assert outliers.judge(empty).count() == 0


def test_quality(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, good int")
    assert quality.score(quality.features(empty, F.col("source"), F.col("lang")), none).count() == 0
    got = quality.score(quality.features(docs, F.col("source"), F.col("lang")), none).collect()
    assert len(got) == len(ROWS) and not any(r["kept"] for r in got if r["doc_id"] in (4, 5))
    rows = [(i, prose(i) if i % 5 else prose(i).upper(), f"h{i % 7}", f"h{i % 7}/{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 400, 2)], "doc_id long, good int")
    out = {r["doc_id"]: r["kept"] for r in quality.score(quality.features(df, F.col("host"), F.col("path")), labels).collect()}
    assert all(out[i] == bool(i % 5) for i in range(1, 400, 2))


def test_avi_keeps_every_byte():
    r = np.random.default_rng(0)
    p = r.integers(0, 256, (60, 576)).astype(np.uint8)
    p[:10], p[10:20] = 128, np.where(r.random((10, 576)) < 0.95, 128, p[10:20])
    frames = avi.encode_frames(p)
    layout = avi.parse_head(frames[0])
    assert (avi.decode_frames(layout, frames).reshape(60, 576) + 128 == p).all()
    assert avi.read_avi(avi.write_avi(frames)) == (25.0, frames)
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFF")
    with pytest.raises(ValueError):
        avi.decode_frames(layout, [frames[30][: len(avi.HEAD) + 20]])


def test_shots():
    hist = np.zeros((30, 32), np.int64)
    hist[:12, 3], hist[12:, 20] = 576, 576
    begins = avi.cuts(hist, np.zeros(30, np.int64))
    assert np.flatnonzero(begins).tolist() == [0, 12]


def test_media(spark, docs, empty):
    texts = [r[1] for r in sorted(ROWS, key=lambda r: key(r[0]))]
    for r, text in zip(sorted(media.media_digests(docs).collect(), key=lambda r: key(r["doc_id"])), texts):
        data = (text or "").encode()
        full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert media.media_digests(empty).count() == 0
    flat = np.full((20, 576), 128, np.uint8)
    flat[:, ::64] = 228
    flat[10:, ::64] = 28
    files = spark.createDataFrame([(1, bytearray(avi.write_avi(avi.encode_frames(flat)))), (2, bytearray(b"junk")), (3, None), (4, bytearray(avi.write_avi([])))], "id int, media binary")
    rows = media.clips(files, "id", "media").orderBy("clip").collect()
    assert [(r["id"], r["start_s"], r["end_s"], r["n_frames"]) for r in rows] == [(1, 0.0, 0.4, 10), (1, 0.4, 0.8, 10)]
    assert [r["id"] for r in media.clips(files, "id", "media", keep_broken=True).where("error IS NOT NULL").collect()] == [2]


def test_pipeline_stages(spark, docs, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_copies", "secrets", "mix", "pack"]
    for start in (docs, empty):
        now = common.written(start, "t")
        for name, stage in pipeline.STAGES[:-1]:
            now = common.written(stage(spark, now, ""), "t")
            assert now.columns == pipeline.COLUMNS
            if name == "near_copies" and start is docs:
                assert sorted(r["doc_id"] for r in now.where("doc_id IS NOT NULL").collect()) == [0, 3, 6, 7, 9, 10, 11, 12, 15]
            if name == "secrets" and start is docs:
                assert now.where("text LIKE '%AKIA%'").count() == 0
        assert (pipeline.STAGES[-1][1](spark, now, "").count() > 0) == (start is docs)


def test_pipeline_drops_copies_from_four_fifths_on(spark):
    pipeline = pytest.importorskip("corpus_pipeline")

    def fives(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows, kept = [], []
    for g, n in enumerate((104, 64, 40, 24)):
        base = [f"w{g}x{i}" for i in range(n)]
        for put in range(0, n, 7):
            other = base[:put] + ["new"] * (1 + n // 40) + base[put + 1 + n // 40 :]
            a, b = fives(" ".join(base)), fives(" ".join(other))
            tag = f"v{g}p{put}"
            i = len(rows)
            rows += [(i, " ".join(tag + x for x in base)), (i + 1, " ".join(tag + x if x != "new" else x for x in other))]
            kept += [i] if 5 * len(a & b) >= 4 * len(a | b) else [i, i + 1]
    sim = [len(shingles(a[1]) & shingles(b[1])) / len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows[::2], rows[1::2]) if b[0] not in kept]
    assert min(sim) < 0.9 and len(kept) > len(rows) // 2
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r["doc_id"] for r in pipeline.without_copies(spark, docs, "").collect()) == kept
    got = jaccard.near_components(docs, words=5, near=80).collect()
    assert all(r["n_shingles"] == len(fives(rows[r["doc_id"]][1])) for r in got)


def test_outliers_of_a_source_that_is_two_fifths_junk(spark):
    good = [(i, prose(2000 + i), "en", "hot") for i in range(360)]
    bad = [(1000 + i, "".join(w + "### " for w in prose(4000 + i).split()), "en", "hot") for i in range(240)]
    rows = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(rows[i] for i, *_ in bad) and sum(rows[i] for i, *_ in good) >= 355


def test_secrets_within_longer_runs(spark, docs):
    model = secrets.train(docs)
    path = "/".join(prose(70, 40).strip(".").split())
    key, other = "zX9qWv7RkT2pLm8NbY4cHd6JfGs1", "Qw3Er5Ty7Ui9Op1As2Df4Gh6Jk8L"
    texts = [f"see {path}/{key} end", f"é {path}/{key}/{path}/{other}/{path}", f"see {path} end", f"key {key} ends"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df, model).collect():
        text, found = texts[r["doc_id"]], [(s["start"], s["end"]) for s in r["secrets"]]
        keys = [k for k in (key, other) if k in text]
        assert len(found) == len(keys)
        for (start, end), k in zip(found, keys):
            assert k in text[start:end] and end - start <= len(k) + 20
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df, model).collect()}
    assert all(key not in t and other not in t for t in clean.values()) and clean[2] == texts[2] and clean[3] == "key [SECRET] ends"


def test_language_decoding_against_plain_sums():
    texts = ["Der Hund läuft", "the dog runs", "zz 9 ünï", "a", "日本語"]
    r = np.random.default_rng(1)
    codes = language.codewords(4)
    bits = codes.shape[1]
    model = language.Model(list("abcd"), codes, r.normal(size=(language.FEATURES, bits)), r.normal(size=bits), r.normal(size=bits), r.random(bits))
    got = model.evidence([t.encode() for t in texts])
    lang, score = model.decode(got)
    for i, text in enumerate(texts):
        pairs, triples, _ = language.features([text.encode()])
        assert len(pairs) == len(triples) == len(text.encode()) + 3 and pairs.max() < language.PAIRS <= triples.min()
        plain = [sum(model.weights[p, j] + model.weights[t, j] for p, t in zip(pairs, triples)) / len(text.encode()) ** 0.5 for j in range(bits)]
        assert got[i] == pytest.approx(plain)
        loss = [sum(model.trust[j] * np.log1p(np.exp(-c[j] * (plain[j] * model.scale[j] + model.bias[j]))) for j in range(bits)) for c in codes]
        assert lang[i] == int(np.argmin(loss)) and score[i] == pytest.approx(np.exp(-min(loss)) / sum(np.exp(-x) for x in loss))


def test_language_of_many_labels_and_clashing_names(spark):
    rows = [(None if i % 2 else i, f"{'abcdefgh'[i % 8] * 9} x", f"l{i % 230:03d}") for i in range(460)] + [(1, "zzzz yyyy", "l229")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    assert len(model.languages) == language.LANGUAGES and "l229" in model.languages and "l228" not in model.languages
    got = language.identify(df.withColumns({"__text": F.lit("mine"), "_text": F.lit("too")}), model).collect()
    assert len(got) == len(rows) and all(r["__text"] == "mine" and r["lang_pred"] in model.languages for r in got)
    assert all(r["__text"] == "mine" and r["n_bytes"] > 0 for r in token_counts.token_counts(df.withColumn("__text", F.lit("mine")), BYTE, 9).collect())


def test_copies_without_ids_or_with_repeated_ones(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, prose(50)), (1, prose(51)), (None, prose(52)), (None, prose(52) + " more"), (None, prose(50)), (2, prose(51)), (7, prose(53)), (3, prose(53)), (4, None), (4, ""), (None, " ")]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = [(r["doc_id"], r["text"]) for r in pipeline.without_copies(spark, df, "").collect()]
    assert sorted((i or -1, t or "") for i, t in got if t and t.strip() and i) == sorted([(1, prose(50)), (1, prose(51)), (3, prose(53))])
    assert sum(i is None and prose(52) in t for i, t in got) == 1 and len(got) == 7


def test_site_quality_against_plain_posteriors(spark):
    r = np.random.default_rng(5)
    sites = [(f"h{h}", f"h{h}/{p}", r.random()) for h in range(6) for p in range(3)]
    rows, labels = [], []
    for i in range(600):
        h, p, share = sites[min(int(r.integers(0, 18)), int(r.integers(0, 18)))]
        rows.append((i, prose(7000 + i, 60), h if h != "h5" else None, p))
        if i % 3:
            labels.append((i, int(r.random() < share)))
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").repartition(3)
    good = dict(labels)
    got = {x["doc_id"]: x for x in quality.score(quality.features(df, F.col("host"), F.col("path")), spark.createDataFrame(labels, "doc_id long, good int")).collect()}
    base = np.log((sum(good.values()) + 1) / (len(good) - sum(good.values()) + 1))
    p = {i: good.get(i, 1 / (1 + np.exp(-x["evidence"] - base))) for i, x in got.items()}

    def strength(groups):
        n, s = (np.array([f(g) for g in groups], float) for f in (len, sum))
        mean, k = s.sum() / n.sum(), len(n)
        between = ((n * (s / n - mean) ** 2).sum() - (k - 1) * mean * (1 - mean)) / (n.sum() - (n * n).sum() / n.sum())
        return min(1e4, max(2.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e4

    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, h, q in rows:
        hosts[h].append(p[i]), paths[h, q].append(p[i])
    a, b = strength(hosts.values()), strength(paths.values())
    for i, _, h, q in rows:
        mean = (sum(p.values()) + 1 - p[i]) / (len(p) + 1)
        of_host = (a * mean + sum(hosts[h]) - p[i]) / (a + len(hosts[h]) - 1)
        of_path = (b * of_host + sum(paths[h, q]) - p[i]) / (b + len(paths[h, q]) - 1)
        odds = got[i]["evidence"] + np.log(of_path / (1 - of_path))
        assert got[i]["host_share"] == pytest.approx(of_host) and got[i]["path_share"] == pytest.approx(of_path)
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-odds))) and got[i]["kept"] == (got[i]["score"] >= 0.5)


def test_quality_fit_with_statistics_that_do_not_vary():
    """Texts of one length: the words' logarithm differs by rounding only. The fit doesn't depend on such columns."""
    r = np.random.default_rng(1)
    y = (r.random(400) < 0.4).astype(float)
    plain = np.zeros((400, quality.N))
    plain[:, 2] = y + r.normal(size=400)
    for value in (np.log(60), 1e3, 1e6):
        x = plain.copy()
        x[:, 4:8] = value * (1 + 1e-16 * r.integers(0, 3, (400, 4)))
        (w, base), (v, _) = quality.fit(x, y), quality.fit(plain, y)
        said = [np.column_stack([np.ones(400), z, z * z]) @ u - base for z, u in ((x, w), (plain, v))]
        assert np.allclose(*said) and np.corrcoef(said[0], y)[0, 1] > 0.3


def test_stages_give_heap_back(spark, monkeypatch):
    import corpus_pipeline
    from gradeline.llm import common

    heap = spark._jvm.java.lang.Runtime.getRuntime()
    spark.range(0, 2000000, 1, 4).selectExpr("id % 1000 AS k", "repeat(cast(id AS string), 20) AS s").groupBy("k").agg(F.collect_list("s")).write.format("noop").mode("overwrite").save()
    before = heap.totalMemory()
    common.give_back_heap(spark)
    assert heap.totalMemory() < before * 0.7
    docs = spark.createDataFrame([(i, prose(i, 30), "en", "a", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    called = []
    monkeypatch.setattr(corpus_pipeline, "give_back_heap", called.append)
    corpus_pipeline.without_secrets(spark, docs, "")
    assert called == [spark]


def test_workers_give_back_when_a_task_ends(monkeypatch):
    from gradeline.llm import common

    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append("given back"))
    run = common.released(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(run) == 2 and not done
    assert list(run) == [3] and done == ["given back"]
    monkeypatch.undo()
    common.give_back()


def test_the_driver_gives_back_what_its_jvm_has_freed(spark, monkeypatch):
    """Buffers too small for pages of their own, of which one in 50 stays: malloc keeps the gaps until it is told."""

    jvm, kept = spark._jvm, spark._jvm.java.util.ArrayDeque()

    def resident():
        with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    every = jvm.java.util.ArrayDeque()
    for i in range(4500):
        (every if i % 50 else kept).add(jvm.java.nio.ByteBuffer.allocateDirect(60_000))
    every.clear()
    gc.collect()
    jvm.System.gc()
    time.sleep(1)
    jvm.System.gc()
    time.sleep(1)
    before = resident()
    common.give_back_heap(spark)
    assert resident() < before - 75

    called = []
    monkeypatch.setattr(jaccard, "give_back_driver", called.append)
    docs = spark.createDataFrame([(i, prose(i // 2, 30)) for i in range(20)], "doc_id long, text string")
    assert len({r["component_id"] for r in jaccard.near_components(docs).collect()}) == 10 and called == [spark] * 3
