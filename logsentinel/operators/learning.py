"""Learned baselines: events by entity, exponential averages, thresholds, seasonal patterns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.operators.enrich import is_error


def baseline_events(enriched: DataFrame) -> DataFrame:
    """(entity_type, entity_id, ts_ms, line_no, value): each row fans out into the values that baselines learn."""
    c = F.col
    one = lambda kind, key, value: F.struct(F.lit(kind).alias("entity_type"), c(key).alias("entity_id"), value.cast("double").alias("value"))
    items = [
        one("ip_request_time", "ip", c("request_time_s")), one("ip_bytes", "ip", c("bytes_sent")), one("ip_error_rate", "ip", is_error()), one("ip_request_volume", "ip", c("ip_req_window")), one("ip_request_count", "ip", c("ip_req_window")),
        one("ip_failed_logins", "ip", c("ip_failed_window")), one("path_request_time", "path", c("request_time_s")), one("path_bytes", "path", c("bytes_sent")), one("path_error_rate", "path", is_error()),
    ]
    return enriched.select("ts_ms", "line_no", F.explode(F.array(*items)).alias("e")).select("e.entity_type", "e.entity_id", "ts_ms", "line_no", "e.value")


#: Share of the weight below which an older value can't change a double.
NOTHING = 1e-17


def ewma(events: DataFrame, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """Exponential mean and variance of each key's values in arrival order, and the number of values; the first starts with variance 0.

    The fold begins where all older values together have less weight than a double can hold (372 values back for 0.1), so
    it equals the fold over all of them. Each task hands on at most so many rows of a key; ``n`` counts all.
    """
    last = 2 if alpha >= 1 else math.ceil(math.log(NOTHING) / math.log(1 - alpha)) + 1
    r = events.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ts_ms"), F.desc("line_no")))).where(f"__r <= {last}")
    items = F.array_sort(F.collect_list(F.struct("ts_ms", "line_no", "value")))
    values = r.groupBy(*keys).agg(F.transform(items, lambda x: x["value"]).alias("v"))
    zero = F.struct(F.get("v", F.lit(0)).alias("m"), F.lit(0.0).alias("s"))
    step = lambda a, x: F.struct((a["m"] + alpha * (x - a["m"])).alias("m"), ((1 - alpha) * a["s"] + alpha * (x - a["m"]) * (x - a["m"])).alias("s"))
    folded = F.aggregate(F.slice("v", 2, F.greatest(F.size("v"), F.lit(1))), zero, step)
    counts = events.groupBy(*keys).agg(F.count("*").alias("n"))
    return values.withColumn("f", folded).join(counts, keys).select(*keys, "n", F.round("f.m", 6).alias("ewma_mean"), F.round("f.s", 6).alias("ewma_var"))


def established(events: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Number of values of each entity, whether it is established, and since when."""
    r = events.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("ts_ms", "line_no")))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") >= least).alias("established"), F.max(F.when(F.col("__r") == least, F.col("ts_ms"))).alias("established_ms"))


def bucket(dim: str) -> F.Column:
    """Hour of the day, day of the week (0 is Sunday) or week of the month of ts_ms, in UTC."""
    days = F.floor(F.col("ts_ms") / 86_400_000)
    if dim == "hour":
        return F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24)).cast("int")
    if dim == "day":
        return F.pmod(days + 4, F.lit(7)).cast("int")
    return F.floor(F.dayofmonth(F.date_from_unix_date(days.cast("int"))) / 7).cast("int")


BUCKETS = {"hour": 24, "day": 7, "week": 4}


def seasonal_pattern(events: DataFrame, key: str, dim: str, least: int = 100, last: int | None = None, digits: int | None = 6) -> DataFrame:
    """Mean of each bucket over the mean of all buckets' values, 1 for an empty one, with confidence and count; rounded unless ``digits`` is None."""
    last = last or 2 * least
    r = events.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("ts_ms"), F.desc("line_no")))).where(f"__r <= {last}").withColumn("bucket", bucket(dim)).where(F.col("bucket") < BUCKETS[dim])
    whole = r.groupBy(key).agg(F.avg("value").alias("all_mean"), F.count("*").alias("all_n")).where(f"all_n >= {least}")
    grid = whole.select(key, "all_mean", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS[dim] - 1))).alias("bucket"))
    own = r.groupBy(key, "bucket").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    joined = grid.join(own, [key, "bucket"], "left")
    share = F.least(F.lit(1.0), F.col("n") / (least / BUCKETS[dim]))
    steady = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.exp(-F.col("sd") / F.greatest(F.lit(0.1), F.abs("mean")))).otherwise(1.0)
    rounded = lambda c: c if digits is None else F.round(c, digits)
    return joined.select(key, "bucket", rounded(F.coalesce(F.when(F.col("all_mean") != 0, F.col("mean") / F.col("all_mean")), F.lit(1.0))).alias("pattern"), rounded(F.coalesce(share * steady, F.lit(0.0))).alias("confidence"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def anomalies(events: DataFrame, baselines: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Events whose distance from the learned mean is over ``sigmas`` learned deviations."""
    sd = F.when(F.sqrt("ewma_var") < 1e-6, 1.0).otherwise(F.sqrt("ewma_var"))
    keys = ["entity_type", "entity_id"]
    ratio = F.abs(F.col("value") - F.col("ewma_mean")) / sd
    return events.join(baselines.where("n >= 30"), keys).withColumn("ratio", F.round(ratio, 6)).where(ratio > sigmas).select(*keys, "ts_ms", "line_no", "value", "ratio")
