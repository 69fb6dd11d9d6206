"""Ranges, rule tables, audits, sketches, mappings and model swaps against plain forms."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsentinel.operators import adaptive as D
from logsentinel.operators import forest
from logsentinel.operators import lookups as J
from logsentinel.operators import ranges as R
from logsentinel.operators import state as S
from logsentinel.streaming import state as live


def test_increases_with_gaps_resets_and_ties(spark):
    samples = [("a", 0, 1, 5.0), ("a", 60, 2, 9.0), ("a", 60, 3, 2.0), ("a", 350, 4, 4.0), ("a", 900, 5, None), ("a", 1000, 6, 1.0), ("b", 100, 7, 3.0)]
    table = spark.createDataFrame(samples, "k string, ts_ms long, line_no long, value double")
    got = {(r["k"], r["at_ms"]): (r["increase"], r["samples"]) for r in R.increases(table, ["k"], 100, 300).collect()}
    want = {}
    for k in "ab":
        mine = [s for s in samples if s[0] == k and s[3] is not None]
        for t in range(0, 1400, 100):
            inside = [s[3] for s in mine if t - 300 < s[1] <= t]
            if inside:
                growth = sum(y - x if y >= x else y for x, y in zip(inside[:-1], inside[1:], strict=True))
                want[k, t] = (growth if len(inside) > 1 else None, len(inside))
    assert got == want
    assert R.increases(table.limit(0), ["k"], 100, 300).count() == 0


def test_a_table_of_rules_fires_when_a_condition_holds(spark):
    rows = [("requests", "p", t * 1000, 1.0) for t in range(100)] + [("errors", "p", t * 1000, 1.0) for t in range(40, 60)] + [("alerts", f"ip{t % 3}", t * 1000, 1.0) for t in range(30)]
    rows += [("seconds", le, t * 1000, 1.0) for t in range(100) for le in (["+Inf"] if t > 50 else ["1", "+Inf"])]
    table = spark.createDataFrame(rows, "metric string, label string, ts_ms long, value double")
    rule = lambda name, expression, comparison, threshold, hold: {"name": name, "expression": expression, "comparison": comparison, "threshold": threshold, "hold_ms": hold, "severity": "warning", "summary": f"{name} it's {{{{value}}}}"}
    share = ("*", ("/", ("increase", "errors", 10_000), ("increase", "requests", 10_000)), 100)
    rules = [rule("share", share, ">", 50, 5000), rule("long", share, ">", 50, 60_000), rule("sources", ("sources", "alerts", 10_000, 0.25), ">=", 3, 0), rule("slow", ("quantile", 0.5, "seconds", 10_000), ">", 0.9, 0), rule("none", ("/", ("rate", "nothing", 1000), ("rate", "nothing", 1000)), "<", 9, 0)]
    got = {r["name"]: r for r in R.rule_alerts(table, rules, 1000).collect()}
    assert set(got) == {"share", "sources", "slow"}
    hot = [t for t in range(0, 100_000, 1000) if sum(t - 10_000 < x * 1000 <= t for x in range(40, 60)) * 2 > sum(t - 10_000 < x * 1000 <= t for x in range(100))]
    assert (got["share"]["since_ms"], got["share"]["until_ms"]) == (hot[0], hot[-1]) and got["share"]["summary"] == "share it's 60.00"
    assert R.rule_alerts(table.limit(0), rules, 1000).count() == 0


@pytest.mark.parametrize("ranks", [16, 4096])
def test_every_move_of_a_percentile(spark, ranks, monkeypatch):
    monkeypatch.setattr(D, "RANKS", ranks)
    rng = random.Random(6)
    rows = [(f"k{i % 2}", i, rng.randrange(40) * 1000, rng.choice([1.0, 2.0, 5.0, rng.random() * 9])) for i in range(300)]
    got = {r["line_no"]: (round(r["old_threshold"], 9), round(r["new_threshold"], 9)) for r in D.sample_audit(spark.createDataFrame(rows, "k string, line_no long, ts_ms long, value double"), "k", last=10, least=5, span_ms=7000).collect()}
    want = {}
    for k in ("k0", "k1"):
        values = sorted(((t, i, v) for kk, i, t, v in rows if kk == k))
        p = [np.percentile([v for _, _, v in values[max(0, n - 9) : n + 1]], 95) for n in range(len(values))]
        for n in range(4, len(values)):
            if abs(p[n] - p[n - 1]) > 0.01 * max(abs(p[n - 1]), 1):
                want[values[n][1]] = (round(p[n - 1], 9), round(p[n], 9))
    assert got == want and len(got) > 50


def test_cleared_and_current_overrides(spark):
    ledger = spark.createDataFrame([("a", 1, 5.0, "ann"), ("a", 2, None, "bob"), ("b", 1, 5.0, "ann"), ("b", 3, 6.0, "ann"), ("c", 1, None, "x")], "k string, ts_ms long, threshold double, operator_id string")
    assert [(r["k"], r["threshold"]) for r in D.current_overrides(ledger, ["k"]).collect()] == [("b", 6.0)]
    p95 = spark.createDataFrame([("a", 2.5)], "k string, p95 double")
    assert [tuple(r) for r in D.cleared(ledger, p95, ["k"]).collect()] == [("a", 2, 5.0, 2.5, "bob")]


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    rows = spark.range(40_000).selectExpr("concat('ip', id % 2) AS ip", "concat('/p', id % 5000) AS path", "concat('u', id % 7) AS user_agent", "CAST(id % 1000 AS DOUBLE) AS request_time_s")
    merged = S.sketched(S.merge_sketches(*[S.sketches(rows.where(f"hash(path) % 3 = {i}"), "ip", "ip") for i in (-2, -1, 0, 1, 2)])).collect()
    assert len(merged) == 2
    for r in merged:
        assert r["n"] == 20_000 and abs(r["paths"] - 2500) < 125 and r["agents"] == 7 and abs(r["p50"] - 500) < 20 and abs(r["p95"] - 950) < 20


def test_mappings_hold_for_their_own_time(spark):
    rng = random.Random(12)
    names = [(f"10.0.0.{i % 2}", f"h{i}", rng.randrange(10**7), rng.choice([-5, 0, 1000, 60_000, 61_000, 3_600_000, 9 * 10**6])) for i in range(60)]
    rows = [(i, f"10.0.0.{rng.randrange(3)}", rng.choice([rng.randrange(2 * 10**7), rng.choice(names)[2]])) for i in range(300)]
    m = spark.createDataFrame([(a, n, t, t + life) for a, n, t, life in names], "ip string, name string, cached_ms long, expires_ms long")
    got = {r["line_no"]: r["name"] for r in J.valid_interval(spark.createDataFrame(rows, "line_no long, ip string, ts_ms long"), m).collect()}
    want = {i: max(((c, n) for a, n, c, life in names if a == ip and c <= ts <= c + life), default=(0, None))[1] for i, ip, ts in rows}
    assert got == want
    assert J.valid_interval(spark.createDataFrame(rows[:3], "line_no long, ip string, ts_ms long"), m.limit(0)).where("name IS NULL").count() == 3


def test_a_stream_takes_the_model_that_is_in_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    table = pd.DataFrame(rng.random((400, len(forest.FEATURES))), columns=forest.FEATURES)
    table.insert(0, "line_no", range(400))
    rows = spark.createDataFrame(table)
    models = [forest.fit_forest(rows, n, 64) for n in (5, 7)]
    at, inputs = str(tmp_path / "m"), str(tmp_path / "in")
    assert forest.publish_model(spark, models[0], at, 1, rows)
    sink = lambda batch, number: batch.write.mode("append").parquet(str(tmp_path / "out"))
    for part in (0, 1):
        rows.where(f"line_no % 2 = {part}").coalesce(1).write.mode("append").parquet(inputs)
        live.live_scores(spark.readStream.schema(rows.schema).parquet(inputs), at, sink, str(tmp_path / "check")).awaitTermination(120)
        if part == 0:
            assert forest.publish_model(spark, models[1], at, 2, rows, most_drift=0.5)
            wild = models[1].assign(depth=models[1].depth * 50 + 1)
            assert not forest.publish_model(spark, wild, at, 3, rows, most_drift=0.1)  # scores of another kind
            assert not forest.publish_model(spark, models[1].assign(low=-1), at, 4, rows)  # broken
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["line_no"] % 2, r["version"]) for r in got.select("line_no", "version").collect()} == {(0, 1), (1, 2)} and got.count() == 400


def test_a_forest_of_trees_gives_the_mean(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 0.95), (3, 0.0, 0.0)], "line_no long, ua_bad double, ip_bytes_z double")
    other = lambda r: r.select("line_no", F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("factors"))
    got = {r["line_no"]: (r["score"], r["factors"]) for r in forest.forest_score(rows, [forest.tree_score, other]).collect()}
    assert got == {1: (0.75, "known bad user agent"), 2: (0.7, "large answers"), 3: (0.3, None)}
