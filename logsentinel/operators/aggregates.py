"""Profiles, percentiles, mergeable moments, rankings and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.operators.enrich import is_error


def profile(df: DataFrame, key: str) -> DataFrame:
    """Activity of each address or path: counts, first and last time, means and deviations."""
    other = "path" if key == "ip" else "ip"
    sd = lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6)
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.countDistinct(other).alias("others"), F.countDistinct("user_agent").alias("agents"),
        F.round(F.avg("request_time_s"), 6).alias("time_mean"), sd(F.col("request_time_s")).alias("time_sd"), F.round(F.avg("bytes_sent"), 3).alias("bytes_mean"), F.round(F.avg(is_error()), 6).alias("error_mean"),
    )


def moments(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Mergeable (n, mean, m2)."""
    x = F.col(col).cast("double")
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merge_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merges states of a key: the squared distances of the parts' means from the common mean are added."""
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    with_mean = states.groupBy(*keys).agg(total.alias("big_n"), mean.alias("big_mean"))
    joined = states.join(with_mean, keys)
    return joined.groupBy(*keys).agg(F.max("big_n").alias("n"), F.max("big_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("big_mean"), 2)).alias("m2"))


def recent_percentile(df: DataFrame, key: str, col: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), last: int = 1000) -> DataFrame:
    """Interpolated percentiles of each key's last values."""
    newest = df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("ts_ms"), F.desc("line_no")))).where(f"__r <= {last}")
    return newest.groupBy(key).agg(F.count("*").alias("n"), *[F.round(F.percentile(col, p), 6).alias(f"p{round(p * 100)}") for p in ps])


def nearest_rank(df: DataFrame, key: str, col: str, ps: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """The value at place n * p / 100 of each key's sorted values."""
    w = W.partitionBy(key)
    ranked = df.select(key, F.col(col).alias("v"), (F.row_number().over(w.orderBy(col)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("r") == F.floor(F.col("n") * p / 100), F.col("v"))).alias(f"p{p}") for p in ps])


def window_rates(df: DataFrame, ms: int, failed: tuple[int, ...] = (401, 403)) -> DataFrame:
    """Requests and failed logins a second and percent of errors of each address in the window that ends at the newest row."""
    newest = df.agg(F.max("ts_ms").alias("now"))
    recent = df.crossJoin(F.broadcast(newest)).where(F.col("ts_ms") >= F.col("now") - ms)
    s = ms / 1000.0
    return recent.groupBy("ip").agg(
        F.round(F.count("*") / s, 9).alias("request_rate"), F.round(F.count_if(F.col("status").isin(*failed)) / s, 9).alias("failed_rate"), F.round(F.avg(is_error()) * 100, 6).alias("error_percent"))


def window_counts(df: DataFrame, spans_ms: dict[str, int]) -> DataFrame:
    """Rows of each span that ends at the newest row, and all rows; one row."""
    newest = df.agg(F.max("ts_ms").alias("now"))
    joined = df.crossJoin(F.broadcast(newest))
    return joined.agg(*[F.count_if(F.col("ts_ms") > F.col("now") - ms).alias(n) for n, ms in spans_ms.items()], F.count("*").alias("total"))


def top(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(n)


def top_per_group(df: DataFrame, group: str, by: str, key: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(by), key))).where(F.col("rank") <= k)


def activity_bitmap(df: DataFrame) -> DataFrame:
    """The hours of the day (UTC) in which an address was active, as bits."""
    hour = F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24)).cast("int")
    return df.groupBy("ip").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), hour)).alias("hours"))


def path_recent(df: DataFrame, last: int = 16) -> DataFrame:
    """The newest status codes of each path, oldest of them first, with counts of all rows and errors."""
    w = W.partitionBy("path")
    r = df.withColumn("__r", F.row_number().over(w.orderBy(F.desc("ts_ms"), F.desc("line_no"))))
    newest = F.array_sort(F.collect_list(F.when(F.col("__r") <= last, F.struct("ts_ms", "line_no", "status"))))
    return r.groupBy("path").agg(F.array_join(F.transform(newest, lambda x: x["status"].cast("string")), ",").alias("recent"), F.count("*").alias("n"), F.sum(is_error()).cast("long").alias("errors"))


def prune(profiles: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    return profiles.where(F.lit(now_ms) - F.col("last_ms") <= ttl_ms)
