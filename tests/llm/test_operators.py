import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logsentinel.llm import decontam, jpeg, licenses, lm, media, neardup, packing, quality, tokens, toxicity, urls
from logsentinel.llm import textkit as K
from logsentinel.llm.graph import components

DATA = "/root/testdata/sf0.001"
TRICKY = ["", None, " ", "a  b", "  lead", "x\n\ny \t", "é è\u00a0 z\u3000w", "<|endoftext|> a <|startoftext|>b", "it's don't 'S.", "ſ İ ß ẞ", "a" * 300 + " " + "b" * 70, "One two three four", "word " * 5000]
NEW = "doc_id long, text string, score string, label int, row long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 1, 2) for i, t in enumerate(texts)], NEW)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sample_texts(n=120):
    return [r[0] for r in duckdb.sql(f"select text from '{DATA}/documents.parquet' order by doc_id limit {n}").fetchall()]


@pytest.mark.parametrize("op", ["op1", "op2", "op7", "op8"])
def test_equals_sql(spark, op):
    module, query = {"op1": (licenses, "op1_license_scan"), "op2": (neardup, "op2_near_duplicates"), "op7": (decontam, "op7_decontamination"), "op8": (urls, "op8_url_filter")}[op]
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = getattr(module, query)(spark, DATA).toPandas(), c.sql(module.SQL).df()
    key = got.columns[0]
    a, b = (x[list(got.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for col in got.columns:
        assert not ((a[col] != b[col]) & ~(a[col].isna() & b[col].isna())).any(), col


def test_token_counts_equal_whole_texts(spark):
    texts = TRICKY + sample_texts()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(tokens.count_tokens(docs(spark, texts)))
    for i, x in enumerate(texts):
        assert got[i]["n_tokens"] == len(t.encode(x or "", add_special_tokens=False)), x
        assert got[i]["n_bytes"] == len((x or "").encode())


def test_packing_pieces_and_places(spark):
    texts = TRICKY + sample_texts()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs(spark, texts)).collect()
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.05 * -(-sum(r["length"] for r in got) // 2048) + 1


def jaccard_links(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets, [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_near_duplicates_of_a_large_group_equal_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w))
    texts += ["a b", "A  b", "", None, "a b c", " ".join(base), "p q r s t", "p q r s t u"]
    sets, pairs = jaccard_links(texts)
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = by_id(neardup.near_duplicates(docs(spark, texts)))
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root[i], root[i] == i), texts[i]


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    got = neardup.near_duplicates(docs(spark, [text, text, text, "other words that stand quite alone here"], [7, None, 7, 3])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (3, 3, True), (7, 7, True), (7, 7, True)]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (12, 12), (20, 19), (19, 21), (21, 1)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10, 1: 1, 19: 1, 20: 1, 21: 1}


def test_densified_small_sets_collide_like_large_ones():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        s = rng.integers(0, 2**63, 4, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(s), np.sort(s[:3])
        h = neardup.band_hashes(np.concatenate([a, b]), np.array([0, 4, 7]))
        hits += (h[0] == h[1]).any()
    assert hits >= 199


def test_decontamination_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = ["x " + item.upper() + "! y", "one two three", "", None, "short item", "Short, ITEM"]
    bench = spark.createDataFrame([("i1", item), ("i2", "short item"), ("i3", None), ("i4", "short item")], "item_id string, text string")
    got = by_id(decontam.decontaminate(docs(spark, texts), bench))
    assert [got[i]["n_hit"] for i in range(6)] == [11, 0, 0, 0, 2, 2]
    assert [got[i]["n_items"] for i in range(6)] == [1, 0, 0, 0, 2, 2]
    assert got[0]["n_words"] == 13 and got[3]["n_words"] == 0
    none = decontam.decontaminate(docs(spark, texts), bench.limit(0)).collect()
    assert len(none) == 6 and not any(r["contaminated"] for r in none)


def test_filter_is_shipped_once(spark):
    assert urls.build_filter(spark, urls.RULES) == urls.build_filter(spark, urls.RULES)


def test_url_parts():
    assert urls.split_url("HTTP://A.Example.COM/en/x?y#z") == ("a.example.com", "/en/x")
    assert urls.split_url("no scheme") == urls.split_url(None) == ("", "")
    assert urls.split_url("x://h?q=/a") == ("h", "")


def test_jpeg_round_trip_and_media(spark):
    rng = np.random.default_rng(1)
    for n in (192, 384, 576, 64 * 6 * 4097):
        p = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        image = jpeg.read_coefficients(jpeg.encode_payload(p))
        assert jpeg.read_payload(image) == p
        assert jpeg.to_rgb(image).shape == (image["height"], image["width"], 3)
    got = by_id(media.read_media(media.store_texts(docs(spark, TRICKY))))
    for i, x in enumerate(TRICKY):
        raw = (x or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert bytes(got[i]["payload"]) == want and got[i]["tail_crc32"] == zlib.crc32(want[-16:]) and got[i]["n_bytes"] == len(raw)
        assert len(got[i]["rgb"]) == got[i]["width"] * got[i]["height"] * 3


def test_broken_media_is_null(spark):
    rows = spark.createDataFrame([(1, 2, bytearray(b"no jpeg")), (2, 2, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["media_sha256"] is None and r["rgb"] is None for r in media.read_media(rows).collect())


def test_damaged_media_never_ends_a_task(spark):
    good = bytes(media.store_texts(docs(spark, ["some text " * 40])).first()["media"])
    rng = random.Random(7)
    odd = [b"\xff\xd8\xff\xc4", b"\xff\xd8", b"", good[:5], good[:90], good[:-40]] + [good[: rng.randrange(len(good))] for _ in range(40)]
    for _ in range(120):
        b = bytearray(good)
        b[rng.randrange(2, len(b))] = rng.randrange(256)
        odd.append(bytes(b))
    at = good.index(b"\xff\xc2")
    odd += [good[: at + 5] + b"\xff\xff\xff\xff" + good[at + 9 :], good.replace(b"payload ", b"payload abc ")[: len(good)]]
    rows = spark.createDataFrame([(i, 0, m) for i, m in enumerate([good, *odd])], "doc_id long, n_bytes long, media binary")
    got = by_id(media.read_media(rows, tensors=True, payloads=True))
    assert len(got) == len(odd) + 1 and got[0]["payload"].startswith(b"some text ") and all(got[i]["media_bytes"] is None for i in range(1, 6))
    assert got[len(odd) - 1]["media_bytes"] is None


def test_stored_tensors_are_read_back(spark, tmp_path):
    stored = by_id(media.store_media(docs(spark, ["a", "b" * 5000, None]), str(tmp_path)))
    assert all(len(r["rgb"]) == 3 * r["width"] * r["height"] > 0 for r in stored.values())
    now = by_id(media.read_media(spark.read.parquet(f"{tmp_path}/media"), tensors=True))
    assert all(now[i]["rgb"] == r["rgb"] and now[i]["media_sha256"] == r["media_sha256"] for i, r in stored.items())


def test_filters_without_rules_and_with_many(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/x/y"), (2, None), (3, "http://w3.org/")], "page_id long, url string")
    none = by_id(urls.judge_urls(pages, urls.build_filter(spark, [])), "page_id")
    assert all(r["rule"] is None and r["verdict"] == "allow" for r in none.values())
    many = [(f"h{i}.org", f"/p{i % 7}/", "block") for i in range(3000)] + [("b.com", "/x/", "block"), ("a.b.com", "/x/", "keep")]
    got = by_id(urls.judge_urls(pages.union(spark.createDataFrame([(4, "http://z.h5.org/p5/q")], pages.schema)), urls.build_filter(spark, many)), "page_id")
    assert (got[1]["verdict"], got[4]["rule"], got[4]["verdict"], got[2]["rule"]) == ("keep", "h5.org/p5/", "block", None)


def test_every_known_license_is_found(spark):
    known, notices = spark.createDataFrame(licenses.LICENSES, "license string, text string"), spark.createDataFrame(licenses.NOTICES, "license string, text string")
    wrapped = lambda t: "Copyright (c) 1999 Some One\n\n" + "\n".join(textwrap.fill(line.upper(), 60, break_on_hyphens=False) for line in t.split("\n"))
    got = by_id(licenses.scan_licenses(docs(spark, [wrapped(t) for _, t in licenses.LICENSES]), known, notices))
    assert [got[i]["license"] for i in range(len(got))] == [n for n, _ in licenses.LICENSES] and len({n for n, _ in licenses.LICENSES}) == 10


def test_lm_base_scores_and_normalisation(spark):
    texts = TRICKY + sample_texts(60)
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter(w for i, t in enumerate(texts) if not held[i] for w in split(t))
    n, v = sum(count.values()), len(count)
    got = by_id(lm.score_texts(docs(spark, texts)))
    for i, t in enumerate(texts):
        w = split(t)
        assert got[i]["held_out"] == held[i] and got[i]["train_tokens"] == n and got[i]["n_tokens"] == len(w)
        assert got[i]["n_known"] == sum(count[x] > 0 for x in w)
        assert math.isclose(got[i]["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-6)
        assert got[i]["score"] <= 0


def test_lm_probabilities_add_up_to_one():
    rng = np.random.default_rng(4)
    model = lm.Model(rng.normal(size=(lm.UNITS, 3 * lm.DIM + 1)))
    two, one, target = (rng.integers(0, lm.UNITS, 500) for _ in range(3))
    p = model.log_probabilities(two, one)
    assert np.allclose((10.0**p).sum(axis=1), 1, atol=1e-4)
    for _ in range(2):  # the second time from the normalisers that were kept
        assert np.allclose(model.score(two, one, target), p[np.arange(500), target], atol=1e-4)


def test_lm_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(6)
    t = lm.Trainer(rng.normal(0, 0.3, (lm.UNITS, 3 * lm.DIM + 1)), np.ones(lm.UNITS), 0.0, 3)
    two, one, target = (rng.integers(0, lm.UNITS, 40) for _ in range(3))
    noise = np.minimum(np.searchsorted(t.cum, np.random.default_rng(3).random(lm.NOISE)), lm.UNITS - 1)
    d = lm.DIM

    def loss(w):
        h = w[two, :d] + w[one, d : 2 * d]
        good = (h * w[target, 2 * d : 3 * d]).sum(axis=1) + w[target, -1] - t.shift[target]
        bad = h @ w[noise, 2 * d : 3 * d].T + w[noise, -1] - t.shift[noise]
        return (np.logaddexp(0, -good).sum() + np.logaddexp(0, bad).sum()) / len(target)

    w = t.w.astype(np.float64)
    t.step(two, one, target)
    grad = t.mean * 10
    for i, j in ((two[0], 2), (one[5], d + 1), (target[9], 2 * d + 3), (noise[0], 2 * d), (noise[7], 3 * d), (target[3], 3 * d)):
        e = np.zeros_like(w)
        e[i, j] = 1e-4
        assert math.isclose(grad[i, j], (loss(w + e) - loss(w - e)) / 2e-4, rel_tol=2e-2, abs_tol=1e-4)


def test_lm_beats_counts_and_class_trigrams_on_held_out_texts(spark):
    table = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
    scored = {r["doc_id"]: r for r in lm.op5_lm_scores(spark, "/root/testdata/sf0.01").collect()}
    held = np.array([scored[i]["held_out"] for i, _ in table])
    k, c, first = lm._tokens(pa.RecordBatch.from_arrays([pa.array([t for _, t in table], pa.string())], names=["text"]))
    out = np.repeat(held, np.diff(first))
    two, one = lm.contexts(c, first)
    tri = np.zeros((lm.CLASSES,) * 3)
    np.add.at(tri, (two[~out], one[~out], c[~out]), 1)
    uni = (tri.sum(axis=(0, 1)) + 1) / (tri.sum() + lm.CLASSES)
    p = (tri + 5 * uni) / (tri.sum(axis=2, keepdims=True) + 5)
    words, count = np.unique(k[~out], return_counts=True)
    of, size = K.lookup(words, count, k), np.bincount(c[~out], minlength=lm.CLASSES)
    kinds = np.bincount(c[~out][np.unique(k[~out], return_index=True)[1]], minlength=lm.CLASSES)
    trigram = np.log10(p[two, one, c]) + np.where(c > 0, np.log10((of + 1) / (size[c] + kinds[c] + 1)), 0)
    n = out.sum()
    mean = lambda name: sum(scored[i][name] for (i, _), h in zip(table, held, strict=True) if h) / n
    assert mean("score") > trigram[out].mean() + 0.02 and mean("score") > mean("base_score") + 0.1


def test_toxicity_learns_and_catches_misspellings():
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ran", "tol", "mip", "sed") for b in ("der", "ko", "ling", "est", "un")]
    text = lambda bad: " ".join(rng.choice(plain) for _ in range(40)) + (" " + " ".join(rng.choice(["idiot", "moron", "stupid"]) for _ in range(2)) if bad else "")
    y = np.array([i % 2 for i in range(400)])
    model = toxicity.train(toxicity.parts_of(pa.array([text(b) for b in y])), y)
    bias = model["bias"][1] - model["bias"][0]
    bags = toxicity.Bags([K.utf8(pa.array([text(False), text(True), text(False) + " idiott", ""]))])
    z = bags.texts(bags.of_words(toxicity.bucket_scores(model))) + bias
    assert z[0] < 0 < z[1] and z[3] == bias
    assert z[2] > z[0] + 0.5  # one unseen misspelling among 40 words


def test_toxicity_scores_equal_a_plain_scorer(spark):
    rng = np.random.default_rng(8)
    model = {"used": np.arange(toxicity.BUCKETS), "vectors": rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), "soft": rng.normal(size=(toxicity.DIM, 2)), "bias": np.array([0.1, 0.4])}

    def bucket(gram):
        return int((K.mix(np.array([int.from_bytes(gram, "little") + (len(gram) << 56)], np.uint64)) % np.uint64(toxicity.BUCKETS))[0])

    def word(w):
        edged = b"<" + w + b">"
        ids = [bucket(edged[i : i + n]) for n in toxicity.GRAMS for i in range(len(edged) - n + 1)]
        ids.append(int((K.hashes(np.frombuffer(edged, np.uint8), np.array([0]), np.array([len(edged)]), seed=3) % np.uint64(toxicity.BUCKETS))[0]))
        return model["vectors"][ids].mean(axis=0)

    def score(text):
        v = [word(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())]
        n = toxicity.WINDOW
        logit = lambda a: float((a @ (model["soft"][:, 1] - model["soft"][:, 0])) + model["bias"][1] - model["bias"][0])
        if not v:
            return 1 / (1 + math.exp(-0.3))
        runs = [sum(v[i : i + n]) / n for i in range(len(v) - n + 1)] if len(v) >= n else [sum(v) / max(len(v), n // 4)]
        return 1 / (1 + math.exp(-max(map(logit, runs))))

    texts = [*TRICKY[:12], "one two three four five six seven eight nine ten eleven", "Straße ÀB c", "x" * 300, None]
    got = by_id(toxicity.predict(docs(spark, texts), model))
    assert all(math.isclose(got[i]["score"], score(t), abs_tol=1e-4) for i, t in enumerate(texts))


def test_quality_rules_and_empty_tables(spark):
    rng = np.random.default_rng(3)
    x = rng.random((2000, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.train(x, y)
    margin = model["bias"] + sum(w * quality._holds(x, r) for w, r in model["rules"])
    assert (((margin > 0) == (y > 0)).mean()) > 0.97 and len(model["rules"]) < 100
    assert json.loads(quality.describe(model))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = by_id(quality.score_quality(docs(spark, TRICKY), labels))
    assert len(scored) == len(TRICKY) and all(r["score"] == 0.5 for r in scored.values())
    assert toxicity.score_toxicity(docs(spark, TRICKY), labels).count() == len(TRICKY)
    for df in (quality.score_quality(docs(spark, []), labels), toxicity.score_toxicity(docs(spark, []), labels), lm.score_texts(docs(spark, [])), packing.pack_documents(docs(spark, [])), tokens.count_tokens(docs(spark, []))):
        assert df.count() == 0


def test_license_texts(spark):
    known, notices = spark.createDataFrame(licenses.LICENSES, "license string, text string"), spark.createDataFrame(licenses.NOTICES, "license string, text string")
    mit = licenses.LICENSES[0][1]
    texts = ["MIT LICENSE\n\nCopyright (c) 2020 Some One\n\n" + mit.replace(", ", ",\n"), "Some prose.\nreleased under the MIT Licence!", None, "", mit[:200]]
    got = by_id(licenses.scan_licenses(docs(spark, texts), known, notices))
    assert [got[i]["license"] for i in range(5)] == ["MIT", None, None, None, None]
    assert [got[i]["notices"] for i in range(5)] == ["", "MIT", "", "", ""]


def test_held_out_accuracy(spark):
    truth = {r[0]: r[1:] for r in duckdb.sql("select doc_id, quality, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall()}
    q = [r for r in quality.op4_quality_rules(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in truth]
    t = [r for r in toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in q]) > 0.98
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in t]) > 0.92
