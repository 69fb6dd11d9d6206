import os

import duckdb
import numpy as np
import pytest

from logsentinel.operators import forest
from logsentinel.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [c for c in columns if not str(got[c].dtype).startswith("float")]
    a, b = (x[columns].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert not ((a[c] != b[c]) & ~(a[c].isna() & b[c].isna())).any(), c


def test_forest_finds_the_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.05, (600, len(forest.FEATURES)))
    x[:5] = 1.0
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "line_no long, " + ", ".join(f"{f} double" for f in forest.FEATURES))
    model = forest.fit_forest(rows, trees=20, sample=64)
    got = forest.score_forest(rows, model).toPandas().sort_values("score", ascending=False)
    assert set(got.line_no.head(5)) == set(range(5))
    assert got.score.between(0, 1).all()


def test_alert_forms_and_throttle_report(spark):
    every = registry.queries()
    alerts = registry.alerts(spark, DATA).count()
    assert every["alert_json"](spark, DATA).where("get_json_object(json, '$.ip') IS NOT NULL").count() == alerts
    assert every["alert_text"](spark, DATA).where("text LIKE 'ALERT: % | IP: % | Tier: tier_ | Score: %'").count() == alerts
    report = every["throttle_stats"](spark, DATA).toPandas()
    assert report.alerts.sum() - report.suppressed.sum() == every["alert_throttle"](spark, DATA).count()
    assert every["dominant_freq"](spark, DATA).where("rank > 3 OR k < 1 OR k > 11").count() == 0
