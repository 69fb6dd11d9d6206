"""State of addresses, paths and sessions as versioned snapshots, and figures about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.operators.enrich import is_error


def state(df: DataFrame, kind: str, key: str) -> DataFrame:
    """(kind, id, n, first_ms, last_ms, errors, mean, m2): a mergeable state of each address, path or session."""
    x = F.col("request_time_s").cast("double")
    return df.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("id")).agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.sum(is_error()).cast("long").alias("errors"), F.count(x).alias("times"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state for each kind and id; moments are merged about the common mean, in one grouping."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    parts = F.collect_list(F.struct("times", "mean", "m2"))  # one for each snapshot
    merged = both.groupBy("kind", "id").agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("errors").alias("errors"), F.sum("times").alias("times"), F.coalesce(F.sum(F.col("times") * F.col("mean")) / F.sum("times"), F.lit(0.0)).alias("mean"), parts.alias("parts"))
    m2 = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["times"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return merged.withColumn("m2", m2).drop("parts")


def save_state(states: DataFrame, path: str, version: int) -> None:
    """Writes a snapshot as a new version; versions are folders that appear when they are whole."""
    states.write.mode("errorifexists").parquet(f"{path}/version={version}")


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The newest whole version below ``path``, None without one. A folder without ``_SUCCESS`` was not finished."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    return max((int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and fs.exists(jvm.Path(p, "_SUCCESS"))), default=None)


def load_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the state, the newest whole one by default."""
    if version is None:
        version = newest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no whole version in {path}")
    return spark.read.parquet(f"{path}/version={version}")


def state_sizes(states: DataFrame) -> DataFrame:
    """(kind, states, rows): how many states there are of each kind, and of how many rows."""
    return states.groupBy("kind").agg(F.count("*").alias("states"), F.sum("n").alias("rows"))


def expire(states: DataFrame, now_ms: int, ttl_ms: dict[str, int]) -> DataFrame:
    """States that were seen within the time of their kind; kinds without one stay."""
    gone = F.lit(False)
    for kind, ttl in ttl_ms.items():
        gone = gone | ((F.col("kind") == kind) & (now_ms - F.col("last_ms") > ttl))
    return states.where(~gone)


def approximate_distinct(df: DataFrame, key: str, rsd: float = 0.01) -> DataFrame:
    """(key, paths, agents): distinct paths and user agents to within ``rsd``, in constant memory for each key.

    Repeated values are gone before the shuffle. The keys of a task come one after the other, so it holds two sketches (13 KB each) and not two for each key.
    """
    values = df.select(key, F.explode(F.array(F.struct(F.col("path").alias("p"), F.lit(None).cast("string").alias("a")), F.struct(F.lit(None).cast("string").alias("p"), F.col("user_agent").alias("a")))).alias("v")).select(key, "v.*").distinct()
    mine = W.partitionBy(key)
    sketched = values.select(key, F.approx_count_distinct("p", rsd).over(mine).alias("paths"), F.approx_count_distinct("a", rsd).over(mine).alias("agents"), F.row_number().over(mine.orderBy("p", "a")).alias("__nth"))
    return sketched.where("__nth = 1").select(key, "paths", "agents")


def dashboard(df: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: rows a second, alerts a minute, p90 of the time (nearest rank), numbers of addresses, paths and user agents."""
    span = F.greatest(F.max("ts_ms") - F.min("ts_ms"), F.lit(1)) / 1000.0
    one = df.agg(F.count("*").alias("n"), span.alias("s"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY request_time_s)").alias("p90"), F.countDistinct("ip").alias("ips"), F.countDistinct("path").alias("paths"), F.countDistinct("user_agent").alias("agents"))
    both = one.crossJoin(alerts.agg(F.count("*").alias("alerts")))
    return both.select(F.round(F.col("n") / F.col("s"), 6).alias("rows_per_s"), F.round(F.col("alerts") / F.col("s") * 60, 6).alias("alerts_per_min"), "p90", "ips", "paths", "agents")


def sketches(df: DataFrame, kind: str, key: str) -> DataFrame:
    """(kind, id, n, paths, agents, times): mergeable sketches of each address, path or session, as binary columns of a snapshot.

    paths and agents count distinct values (HyperLogLog, relative error about 1.6 %), times has quantiles of the request time (KLL, rank error about 1.3 %).
    """
    x = F.col("request_time_s").cast("double")
    return df.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("id")).agg(F.count("*").alias("n"), F.hll_sketch_agg("path").alias("paths"), F.hll_sketch_agg("user_agent").alias("agents"), F.kll_sketch_agg_double(x).alias("times"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """One row for each kind and id of several snapshots: what sketches of all their rows would say."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("kind", "id").agg(F.sum("n").alias("n"), F.hll_union_agg("paths").alias("paths"), F.hll_union_agg("agents").alias("agents"), F.kll_merge_agg_double("times").alias("times"))


def sketched(parts: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(kind, id, n, paths, agents, p50, p95): estimates of sketches."""
    quantiles = [F.kll_sketch_get_quantile_double("times", F.lit(r)).alias(f"p{round(r * 100)}") for r in ranks]
    return parts.select("kind", "id", "n", F.hll_sketch_estimate("paths").alias("paths"), F.hll_sketch_estimate("agents").alias("agents"), *quantiles)
