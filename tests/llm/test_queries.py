"""The registered queries on whole tables of sf0.001 against brute force over their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import mixing, outliers, secrets
from gradeline.llm.queries import queries
from gradeline.llm.tokenize import PieceEncoder

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def get(name):
        if name not in done:
            done[name] = queries()[name](spark, SF).collect()
        return done[name]

    return get


def ids_of(table, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return {i: np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + ([] if end is None else [end]), "<u4") for i, r in table.items()}


def test_packing_query(table, result):
    ids, covered, sequences = ids_of(table, "word_bpe_49k.json", 1), defaultdict(list), defaultdict(list)
    for r in result("op1_packing"):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, all_ids in ids.items():
        at = 0
        for start, n in sorted(covered[i]):
            assert start == at
            at += n
        assert at == len(all_ids)
    for pieces in sequences.values():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at <= 2048
    assert sum(map(len, ids.values())) > 0.98 * 2048 * (len(sequences) - 1)


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secret_query(table, result):
    kinds = ["assign", "access", "hex"]
    for r in result("op2_secret_scan"):
        text = table[r["doc_id"]]["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        said = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(said) <= set(r["spans"].split(",")) | {""}


def test_outlier_query(table, result):
    for r in result("op3_robust_outliers"):
        text = table[r["doc_id"]]["text"] or ""
        words = WORDS.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])


def plain_determinant(v, starts=60):
    """Minimum covariance determinant by concentration steps from many random starts, with exact subsets."""
    rng, n, p = np.random.default_rng(0), *v.shape
    floor, h, best = np.diag(outliers.LEAST**2), (v.shape[0] + v.shape[1] + 1) // 2, None
    for _ in range(starts):
        own = rng.choice(n, p + 1, replace=False)
        last = np.inf
        while True:
            centre, cov = v[own].mean(0), np.cov(v[own].T, bias=True) + floor
            now = np.linalg.slogdet(cov)[1]
            if len(own) == h and now >= last - 1e-12:
                break
            last = now if len(own) == h else np.inf
            d = np.einsum("ni,ij,nj->n", v - centre, np.linalg.inv(cov), v - centre)
            own = np.argsort(d, kind="stable")[:h]
        if best is None or last < best[0]:
            best = last, centre, cov
    return best


@pytest.mark.parametrize("bad", [0, 30, 58])
def test_least_determinant_against_random_starts(spark, bad):
    rng = np.random.default_rng(bad)
    mixed = rng.normal(size=(outliers.P, outliers.P))
    good = rng.normal(size=(150 - bad, outliers.P)) @ mixed
    far = rng.normal(size=(bad, outliers.P)) @ mixed + 25
    v = np.concatenate([good, far])
    rows = spark.createDataFrame([("k", x.tolist()) for x in v] + [("other", (x * 2 + 1).tolist()) for x in good], "key string, v array<double>").repartition(3)
    centre, covariance = outliers.minimum_determinant(rows, ["k", "other"])
    least, plain_centre, plain_cov = plain_determinant(v)
    ours = np.einsum("ni,ij,nj->n", v - centre[0], np.linalg.inv(covariance[0]), v - centre[0])
    plain = np.einsum("ni,ij,nj->n", v - plain_centre, np.linalg.inv(plain_cov), v - plain_centre)
    plain /= max(1.0, np.sort(plain)[len(v) // 2 - 1] / outliers.MIDDLE)
    half = np.argsort(ours)[: (len(v) + outliers.P + 1) // 2]
    found = np.linalg.slogdet(np.cov(v[half].T, bias=True) + np.diag(outliers.LEAST**2))[1]
    assert found < least + 0.8
    assert (ours[len(good) :] > outliers.FAR).all() and (plain[len(good) :] > outliers.FAR).all()
    assert np.mean(ours[: len(good)] <= 2 * outliers.FAR) > 0.95


def test_language_query(table, result):
    right = held = 0
    langs = {r["lang"] for r in table.values()} - {None}
    for r in result("op4_language_codes"):
        row = table[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        lettered = any(c.isalpha() for c in row["text"] or "")
        assert (r["lang_pred"] in langs) if lettered else r["lang_pred"] == "und"
        if r["held_out"] and lettered and row["lang"]:
            held, right = held + 1, right + (r["lang_pred"] == row["lang"])
    assert right >= 0.95 * held > 0


def test_token_file_query(table, result):
    ids, at = ids_of(table, "byte_bpe_50k.json", 0), 0
    got = {r["doc_id"]: r for r in result("op5_token_files")}
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    assert len(got) == len(ids)


def test_mixing_query(spark, table, result):
    sizes = {i: len(WORDS.findall(r["text"] or "")) for i, r in table.items()}
    sources = sorted({r["source"] for r in table.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(sizes[i] for i, r in table.items() if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    full, rest = set(), 1.5 * sum(total.values())
    while True:
        left = rest - sum(2 * total[s] for s in full)
        share = {s: 2.0 * total[s] if s in full else left * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources}
        over = {s for s in sources if s not in full and share[s] >= 2 * total[s]}
        if not over:
            break
        full |= over
    got = {r["doc_id"]: r for r in result("op6_mixing")}
    order = mixing.numbered(spark.read.parquet(f"{SF}/documents.parquet")).withColumn("h", F.xxhash64("doc_id", "tie", F.lit(6))).collect()
    assert len(got) == len(table) == len(order)
    for s in sources:
        own = sorted((r for r in order if r["source"] == s), key=lambda r: (r["h"] % 2**64, r["doc_id"], r["tie"]))
        quota, at = round(share[s]), 0
        passes, last = divmod(quota, max(total[s], 1))
        for r in own:
            g = got[r["doc_id"]]
            assert (g["size"], g["source_size"]) == (sizes[r["doc_id"]], total[s]) and g["target"] == pytest.approx(share[s])
            assert g["taken"] <= 2 * g["size"]
            at += g["size"]
        assert abs(sum(got[r["doc_id"]]["taken"] for r in own) - share[s]) <= 1
        # whole passes take every word; the last one takes a stretch of the shuffled words from their start
        extra = [got[r["doc_id"]]["taken"] - passes * got[r["doc_id"]]["size"] for r in own]
        assert sum(extra) == last and all(0 <= e <= got[r["doc_id"]]["size"] for e, r in zip(extra, own))
        assert sum(0 < e < got[r["doc_id"]]["size"] for e, r in zip(extra, own)) <= 1


def test_mix_does_not_depend_on_splits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5).alias("doc_id"), "text", "source")
    a, b = (sorted(map(tuple, mixing.mix(x, block=64).fillna(-1).collect())) for x in (rows.repartition(2), rows.orderBy("text").repartition(7)))
    assert a == b


def test_join_query(table, result):
    sets = {}
    for i, r in table.items():
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 90 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result("op7_grouped_prefix_join")} == {i: (len(s), root(i)) for i, s in sets.items()}


def test_count_query(table, result):
    ids = ids_of(table, "byte_bpe_50k.json", None)
    for r in result("op8_token_counts"):
        n = len(ids[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((table[r["doc_id"]]["text"] or "").encode()), n, n > 1024)
    assert len(result("op8_token_counts")) == len(table)


def test_site_query(table, result):
    assert sorted(r["doc_id"] for r in result("op9_site_quality")) == sorted(table)


def test_media_query(table, result):
    seen = defaultdict(set)
    for r in result("op10_avi_clips"):
        data = (table[r["doc_id"]]["text"] or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        seen[data].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in seen.values()) and len(result("op10_avi_clips")) == len(table)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("together", [1 << 20, 300])
def test_hostile_texts_encode_as_the_library_does(monkeypatch, name, together):
    from tokenizers import Tokenizer

    from gradeline.llm import tokenize

    monkeypatch.setattr(tokenize, "TOGETHER", together)
    r = random.Random(together)
    high = [chr(c) for c in range(0x80, 0x250)] + list("İıΣσς日本“”’…—\u0085 　 ́̇﻿😀👍مرحباͅ ")
    odd = ["'s", "'", "'re", "'LL", "don't", "<|endoftext|>", "<|startoftext|>", "<|", "<", "|>", "</w>", "<|endoftext"]

    def text(n):
        kinds = [
            lambda: r.choice([" "] * 6 + ["  ", "\n", "\t", "\r\n", " \n", "\n ", "   "]), lambda: "".join(r.choices("abcdeETHQxyz", k=r.randint(1, 8))), lambda: r.choice("0123456789") * r.randint(1, 3),
            lambda: r.choice(odd), lambda: chr(r.randrange(128)), lambda: r.choice(high), lambda: r.choice(".,;!?#$%&*-_éüñß¿¡«»") * r.randint(1, 3), lambda: "x" * r.randint(40, 70),
        ]
        return "".join(r.choices(kinds, [30, 30, 8, 8, 8, 8, 8, 1])[0]() for _ in range(n))

    texts = [None, "", *(text(r.choice([0, 1, 2, 3, 5, 10, 40, 400])) for _ in range(600))]
    library, own = Tokenizer.from_file(P.path(name)), PieceEncoder(P.path(name))
    for at in range(0, len(texts), 50):
        ids, counts = own.encode(texts[at : at + 50], end=7)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts[at : at + 50]]


def test_secrets_keep_columns_and_tell_identifiers_from_keys(spark):
    model = secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))
    r = random.Random(4)
    names = ["AbstractSingletonProxyFactoryBean", "HttpServletRequestWrapperFactoryImpl", "org/apache/commons/lang/builder/equals", "this_is_a_long_snake_case_identifier", "documentation-of-the-project", "SimpleBeanFactoryAwareAspectInstance"]
    keys = ["".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n)) for n in (20, 24, 32, 40) for _ in range(25)]
    df = spark.createDataFrame([(i, x, "t", "base", "more", "_text", "mine") for i, x in enumerate(names + keys)], "doc_id long, text string, t string, base string, more string, _text string, secrets string")
    got = {x["doc_id"]: x for x in secrets.scan(df, model).collect()}
    assert [len(got[i]["secrets"]) for i in range(len(names))] == [0] * len(names)
    assert sum(len(got[i]["secrets"]) > 0 for i in range(len(names), len(got))) >= 0.98 * len(keys)
    assert all((x["t"], x["base"], x["more"], x["_text"]) == ("t", "base", "more", "_text") for x in got.values())
    assert secrets.scan(df, model).columns.count("secrets") == 1


def test_redaction_of_many_and_overlapping_secrets(spark):
    model = secrets.train(spark.createDataFrame([], "doc_id long, text string"))
    key = "0123456789abcdef" * 2
    n = 3000
    texts = [" é ".join(["x", *[f"日{i} {key}" for i in range(n)]]), f"token={key} {key}", "zy " * 341 + key + " wx" * 1000, key * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df, model).collect()}
    assert got[0] == texts[0].replace(key, "[SECRET]") and got[1] == "[SECRET] [SECRET]"
    assert got[2] == texts[2].replace(key, "[SECRET]") and got[3] == "[SECRET]" and got[4] is None


def test_running_sums_by_blocks(spark):
    for n in (0, 1, 255, 256, 257, 1500):
        values = [(i * 37) % 11 for i in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(secrets._before(F.col("v")).alias("s"), secrets._before(F.col("v"), most=True).alias("m")).first()
        assert row["s"] == [sum(values[:i]) for i in range(n)] and row["m"] == [max(values[:i], default=0) for i in range(n)]
