"""Scores that depend on the rows alone, shards wherever batches are cut, and long licences by digest."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from logsentinel.llm import licenses, lm

COMMON = Path("/usr/share/common-licenses")


def texts(spark, n=300):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 900)) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "one " * 5000), (None, "no id"), (7, "again"), (7, "again")]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)  # several shards on small texts
    rows = texts(spark)
    schema = "doc_id long, text string"
    runs = []
    for order, parts in ((rows, 1), (rows[::-1], 4), (rows[100:] + rows[:100], 16)):
        got = lm.score_texts(spark.createDataFrame(order, schema).repartition(parts)).collect()
        assert len(got) == len(rows)
        runs.append(sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got))
    for run in runs[1:]:
        for a, b in zip(runs[0], run, strict=True):
            assert a[:3] == b[:3]
            assert a[3] == pytest.approx(b[3], rel=1e-9)
            assert abs(a[4] - b[4]) <= 1e-4 * a[1]


def test_runs_of_a_shard_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(lm, "MIXED", 50)
    rng = np.random.default_rng(1)
    rows = sorted((int(s), rng.integers(0, lm.UNITS, int(n)).astype("<i2").tobytes()) for s, n in zip(rng.integers(0, 4, 80), rng.integers(1, 30, 80), strict=True))

    def run(size):
        batches = (pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows[i : i + size]], pa.int32()), pa.array([u for _, u in rows[i : i + size]], pa.binary())], names=["shard", "units"]) for i in range(0, len(rows), size))
        return [(s, u.tolist(), f.tolist()) for s, u, f in lm._mixed(batches)]

    whole = run(80)
    assert run(1) == whole and run(7) == whole
    assert sum(len(u) for _, u, _ in whole) == sum(len(u) // 2 for _, u in rows)
    assert all(f[0] == 0 and f[-1] == len(u) for _, u, f in whole)
    assert b"".join(np.array(u, "<i2").tobytes() for _, u, _ in whole) == b"".join(u for _, u in rows)


def test_adam_goes_on_from_a_state():
    """Steps from a state equal the steps of a trainer that never stopped, but for the correction of young moments."""
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 100, lm.UNITS).astype(float)
    model = lm.Trainer(lm.begin(counts), counts, 0.01, 1)
    units, first = rng.integers(0, lm.UNITS, 4000), np.array([0, 1500, 4000])
    model.learn(units, first, 16)
    model.learn(units, first, 16)  # 500 steps: the correction is below a hundredth
    state = model.state
    state[0] = model.w
    other = lm.Trainer(state, counts, 0.01, 1)
    other.rng = np.random.default_rng(9)
    model.rng = np.random.default_rng(9)
    two, one = lm.contexts(units, first)
    other.step(two[:64], one[:64], units[:64])
    model.step(two[:64], one[:64], units[:64])
    np.testing.assert_allclose(other.w, model.w, atol=2e-4)


@pytest.mark.skipif(not COMMON.is_dir(), reason="the system ships no licence texts")
def test_long_licences_are_known_by_digest(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for file, name in names.items():
        if not (COMMON / file).exists():
            continue
        text = (COMMON / file).read_text()
        rows.append((name, text))
        rows.append((name, "Copyright 2024 Somebody\n\n" + text.upper().replace('"', "”")))
        rows.append((None, text.replace("software", "hardware", 1).replace("Work", "Wark", 1)))
        mark = "END OF TERMS AND CONDITIONS"
        if mark in text:
            rows.append((name, text[: text.index(mark) + len(mark)]))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    frame = lambda x, of: spark.createDataFrame(x, f"license string, {of} string")
    got = licenses.scan_licenses(docs, frame(licenses.LICENSES, "text"), frame(licenses.NOTICES, "text"), digests=frame(licenses.DIGESTS, "digest")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {i: n for i, (n, _) in enumerate(rows)}
