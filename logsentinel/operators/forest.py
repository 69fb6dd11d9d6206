"""Feature vectors and an isolation forest."""

from __future__ import annotations

from collections.abc import Callable

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FLAGS = ["ua_missing", "ua_headless", "ua_bad", "ua_cycling", "is_path_new"]
SCORES = ["ip_time_z", "ip_bytes_z", "ip_error_z", "ip_vol_z", "path_time_z", "path_bytes_z", "path_error_z"]
SESSION = ["session_duration_s", "session_requests", "session_paths", "session_4xx", "session_5xx", "session_failed", "session_gap_s", "session_post_get", "session_agents", "session_bytes_mean", "session_time_mean"]
FEATURES = ["request_time", "bytes", "is_4xx", "is_5xx", *FLAGS, *SCORES, *SESSION]
#: Features of request times, the only ones that may be no number: all others come from flags, counts, instants and whole bytes, whose means, deviations
#: (over a floor) and ratios (over a count that isn't 0) are finite, and ``features`` leaves neither null nor infinity.
OF_TIMES = ["request_time", "ip_time_z", "path_time_z", "session_time_mean"]


def features(enriched: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """line_no and 27 features (or the named ones), each the hyperbolic tangent of its value; null is 0."""
    c = F.col
    raw = {"request_time": c("request_time_s"), "bytes": c("bytes_sent"), "is_4xx": c("status").between(400, 499), "is_5xx": c("status").between(500, 599)}
    raw |= {n: c(n) for n in FEATURES[4:]}
    return enriched.select("line_no", *[F.tanh(F.coalesce(raw[n].cast("double"), F.lit(0.0))).alias(n) for n in names])


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, seed: int, depth: int) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes (node, feature or -1, cut, left, right, depth that a row reaches here)."""
    rng, nodes = np.random.default_rng(seed), []

    def grow(rows: np.ndarray, at: int) -> int:
        node = len(nodes)
        nodes.append((node, -1, 0.0, -1, -1, at + _path(len(rows))))
        spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        if at < depth and (usable := np.flatnonzero(spread > 0)).size:
            f = int(rng.choice(usable))
            cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
            left = x[rows, f] <= cut
            a, b = grow(rows[left], at + 1), grow(rows[~left], at + 1)
            nodes[node] = (node, f, cut, a, b, 0.0)
        return node

    grow(np.arange(len(x)), 0)
    return nodes


def fit_forest(rows: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> pd.DataFrame:
    """Trees over ``FEATURES``, each on its own ``sample`` rows; the bounded sample (trees * sample rows, the smallest hashes of line_no)
    is dealt out to the trees, which are grown in tasks. Fewer rows make smaller or fewer trees."""
    picked = rows.withColumn("__h", F.xxhash64("line_no", F.lit(seed))).orderBy("__h", "line_no").limit(trees * sample)
    dealt = picked.withColumn("tree", F.floor((F.row_number().over(W.orderBy("__h", "line_no")) - 1) / sample).cast("int"))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__h", "line_no"])
        x = part[FEATURES].to_numpy()
        out = pd.DataFrame(_tree(x, seed + int(key[0]), math.ceil(math.log2(max(len(x), 2)))), columns=["node", "feature", "cut", "low", "high", "depth"])
        out.insert(0, "tree", key[0])
        return out.assign(size=len(x))

    return dealt.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double, low int, high int, depth double, size int").toPandas()


def score_forest(rows: DataFrame, model: pd.DataFrame) -> DataFrame:
    """(line_no, score): 2 to the power of minus the mean depth over the usual depth; 0.5 without trees."""
    grown = [t.sort_values("node") for _, t in model.sort_values("tree").groupby("tree")]
    arrays = [(t.feature.to_numpy(), t.cut.to_numpy(), t.low.to_numpy(), t.high.to_numpy(), t.depth.to_numpy()) for t in grown]
    usual = float(np.mean([_path(int(t["size"].iloc[0])) for t in grown])) if grown else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, total = batch[FEATURES].to_numpy(), np.zeros(len(batch))
            for feature, cut, low, high, depth in arrays:
                at = np.zeros(len(x), np.int64)
                while (inner := np.flatnonzero(feature[at] >= 0)).size:
                    here = at[inner]
                    at[inner] = np.where(x[inner, feature[here]] <= cut[here], low[here], high[here])
                total += depth[at]
            yield pd.DataFrame({"line_no": batch["line_no"], "score": 2 ** (-(total / len(arrays)) / usual) if usual else np.full(len(batch), 0.5)})

    return rows.mapInPandas(run, "line_no long, score double")


def importance(rows: DataFrame) -> DataFrame:
    """(feature, importance): the deviation of each feature."""
    one = rows.agg(*[F.stddev_pop(f).alias(f) for f in FEATURES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 5).alias("importance")) for f in FEATURES])).alias("e")).select("e.*")


def training_set(rows: DataFrame, share: float = 0.7, seed: int = 42, names: list[str] = FEATURES) -> DataFrame:
    """Rows with all features finite, and ``train``: whether a hash of line_no puts it into the first ``share``.

    For rows of ``features``, ``OF_TIMES`` as ``names`` gives the same rows, and the others need not be made.
    """
    good = [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf")) for f in names]
    place = F.conv(F.substring(F.md5(F.concat(F.col("line_no").cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    return rows.where(reduce(lambda a, b: a & b, good)).withColumn("train", place < share)


def write_features_csv(rows: DataFrame, path: str) -> None:
    """The features of each row as headless CSV, in their fixed order."""
    rows.select(*FEATURES).write.mode("append").csv(path, header=False)


def tree_score(rows: DataFrame) -> DataFrame:
    """(line_no, score, factors) of a fixed tree: a known-bad agent is 1, else 0.9 for very large answers, else 0.1; factors from 0.5 on."""
    bad, large = F.col("ua_bad") >= 0.5, F.col("ip_bytes_z") >= 0.9
    return rows.select("line_no", F.when(bad, 1.0).when(large, 0.9).otherwise(0.1).alias("score"), F.when(bad, "known bad user agent").when(large, "large answers").alias("factors"))


def model_meta(scores: DataFrame, model: pd.DataFrame, at_ms: int) -> DataFrame:
    """One row about a model: rows it scored, features, trees, nodes, mean score, time."""
    one = scores.agg(F.count("*").alias("samples"), F.round(F.avg("score"), 6).alias("mean_score"))
    return one.select("samples", F.lit(len(FEATURES)).alias("features"), F.lit(int(model["tree"].nunique())).alias("trees"), F.lit(len(model)).alias("nodes"), "mean_score", F.lit(at_ms).alias("trained_ms"))


def score_drift(rows: DataFrame, model: pd.DataFrame, other: pd.DataFrame) -> float:
    """Mean absolute difference of the scores that two models give to the same rows; 0 without rows."""
    a, b = (score_forest(rows, m).select("line_no", F.col("score").alias(n)) for m, n in ((model, "a"), (other, "b")))
    return a.join(b, "line_no").agg(F.avg(F.abs(F.col("a") - F.col("b")))).first()[0] or 0.0


def publish_model(spark: SparkSession, model: pd.DataFrame, path: str, version: int, validation: DataFrame | None = None, most_drift: float = 0.1) -> bool:
    """Writes a model as a new version and points to it, if it is sound; else the old one stays in force.

    Sound is a model with trees whose every inner node leads to two nodes of its tree and whose leaves have a depth, and, with a
    ``validation`` table of features, whose scores differ from those of the model in force by ``most_drift`` in the mean at most.
    """
    inner = model[model.feature >= 0] if len(model) else model
    size = model.groupby("tree").node.transform("size") if len(model) else None
    ok = len(model) > 0 and bool(np.isfinite(model[["cut", "depth"]].to_numpy()).all()) and bool(((inner.low > inner.node) & (inner.high > inner.node)).all()) and bool((inner[["low", "high"]].max(axis=1) < size[inner.index]).all())
    if ok and validation is not None and has_model(spark, path):
        ok = score_drift(validation, model, current_model(spark, path)) <= most_drift
    if ok:
        spark.createDataFrame(model).write.mode("errorifexists").parquet(f"{path}/model/version={version}")
        spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{path}/current")
    return ok


def current_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/current").agg(F.max("version")).first()[0]


def current_model(spark: SparkSession, path: str) -> pd.DataFrame:
    return spark.read.parquet(f"{path}/model/version={current_version(spark, path)}").toPandas()


def has_model(spark: SparkSession, path: str) -> bool:
    """Whether any model is in force."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def forest_score(rows: DataFrame, models: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(line_no, score, factors): the mean score of several trees (each gives line_no, score, factors), and what the trees over 0.5 name."""
    scores = [m(rows).select("line_no", "score", "factors", F.lit(i).alias("tree")) for i, m in enumerate(models)]
    every = scores[0]
    for s in scores[1:]:
        every = every.unionByName(s)
    named = F.array_join(F.array_sort(F.collect_set(F.when(F.col("score") > 0.5, F.col("factors")))), ", ")
    return every.groupBy("line_no").agg(F.avg("score").alias("score"), F.nullif(named, F.lit("")).alias("factors"))
