"""Kernels against plain forms of themselves, and rows that are odd in every operator."""

import math
import random
import re

import numpy as np

from logsentinel.llm import licenses, lm, media, packing, quality, tokens, urls
from logsentinel.llm import textkit as K

TEXTS = ["", " ", "Aa bb\nAa bb\n\ncc!", "x", "ONE two, Three: four | five", "a b a b a b a b a b a b", "é ß ¡ z\t\x0b\x0cq", "no\nno\nno", "w" * 1500 + " end?", "1 2 3 {x} <y>"]


def plain_statistics(text):
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.STATS)
    share = [sum(b in set(m.tolist()) for b in raw) / len(raw) for m in quality._CLASSES.values()]
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x]
    n = max(len(words), 1)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    runs = [tuple(low[i : i + 5]) for i in range(len(low) - 4)] if len(low) >= 5 else [tuple(low)] * bool(low)
    again = lambda items: (len(items) - len(set(items))) / max(len(items), 1)
    edges = set(b"!?|") | set(quality._CLASSES["symbol"].tolist())
    return share + [
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        1 - again(low),
        again(lines),
        again(runs),
        sum(a == b for a, b in zip(low, low[1:])) / n,  # noqa: B905
        len(words) / max(len(lines), 1),
        sum(65 <= w[min(1, len(w) - 1)] <= 90 for w in words) / n,
        sum(w[-1] in edges for w in words) / n,
        sum(len(w) <= 2 for w in words) / n,
        min(max(map(len, words), default=0), 1000),
    ]


def test_statistics_equal_plain_ones():
    import pyarrow as pa

    got = quality.statistics(*K.utf8(pa.array(TEXTS)))
    assert got.shape == (len(TEXTS), len(quality.STATS))
    for t, row in zip(TEXTS, got, strict=True):
        assert np.allclose(row, plain_statistics(t), atol=1e-8), t


def test_compiled_rules_equal_plain_ones(spark):
    model = {"bias": -0.3, "rules": [(1.2, ((2, ">", 0.1),)), (-2.0, ((0, "<=", 0.2), (10, ">", 1.5))), (0.7, ((13, ">", 0.0), (13, "<=", 0.9)))]}
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r[0]: r[1] for r in quality.with_statistics(rows).select("doc_id", quality.compile_rules(model)).collect()}
    for i, t in enumerate(TEXTS):
        x = plain_statistics(t)
        z = model["bias"] + sum(w for w, rule in model["rules"] if all(x[f] <= v if op == "<=" else x[f] > v for f, op, v in rule))
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9), t


def test_sum_of_squares_equals_a_plain_search():
    rng = random.Random(3)
    for capacity in (10, 37, 64):
        lengths = [rng.randint(1, capacity) for _ in range(200)]
        bins, offsets = packing.sum_of_squares(np.array(lengths), capacity)
        used: list[int] = []
        for size, b, at in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
            gaps = [capacity - u for u in used]

            def total(changed, gaps=gaps):
                now = [g for g in gaps if 0 < g < capacity]
                for old, new in changed:
                    if old in now:
                        now.remove(old)
                    if 0 < new < capacity:
                        now.append(new)
                return sum(now.count(g) ** 2 for g in set(now))

            choices = {g: total([(g, g - size)]) for g in {*gaps, capacity} if g >= size}
            if b == len(used):
                used.append(0)
            assert at == used[b] and choices[capacity - used[b]] == min(choices.values())
            used[b] += size
        assert max(used) <= capacity


ODD = [(7, "same text"), (7, "same text"), (None, "no id"), (None, None), (2, ""), (3, "word " * 900_000)]


def test_odd_rows_keep_their_place_in_every_operator(spark):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, score string, label int")
    known, notices = spark.createDataFrame(licenses.LICENSES, "license string, text string"), spark.createDataFrame(licenses.NOTICES, "license string, text string")
    labels = spark.createDataFrame([(7, 1, 1), (7, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    want = sorted((i for i, _ in ODD), key=str)
    results = {
        "licenses": licenses.scan_licenses(rows, known, notices),
        "tokens": tokens.count_tokens(rows),
        "quality": quality.score_quality(rows, labels),
        "lm": lm.score_texts(rows),
    }
    for name, df in results.items():
        assert sorted((r.doc_id for r in df.select("doc_id").collect()), key=str) == want, name
    pieces = packing.pack_documents(rows).select("doc_id", "piece").collect()
    assert sorted((r.doc_id for r in pieces if r.piece == 0), key=str) == want
    assert media.read_media(media.store_texts(rows.limit(0))).count() == licenses.scan_licenses(rows.limit(0), known, notices).count() == 0


def test_urls_of_repeated_and_null_pages(spark):
    pages = spark.createDataFrame([(1, "http://b.com/x/y", "v"), (1, "http://b.com/x/y", "v"), (None, None, "v"), (2, "http://other.com/x/y", "v")], "page_id long, url string, verdict string")
    got = urls.judge_urls(pages, urls.build_filter(spark, [("b.com", "/x/", "block")])).select("page_id", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "block"), (1, "block"), (2, "allow"), (None, "allow")]
