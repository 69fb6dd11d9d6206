"""Thresholds of learned entities: percentiles, overrides, security-critical entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsentinel.operators.aggregates import recent_percentile

KEYS = ["entity_type", "entity_id"]
#: Largest change of a threshold in percent: of any entity, of a security-critical one.
MAX_CHANGE, MAX_CRITICAL = 50.0, 10.0


def accepts(old: Column, new: Column, most: Column) -> Column:
    """Whether the move is within ``most`` percent of the old threshold; anything is accepted if there is none."""
    return F.when(old.isNull() | F.isnan(old) | (old == 0), True).otherwise(F.abs(new - old) / F.abs(old) * 100 <= most)


def critical_entities(enriched: DataFrame, least_failed: int = 5, percent: float = MAX_CRITICAL) -> DataFrame:
    """(entity_type, entity_id, max_change_pct) of login and administration paths, and of addresses with many failed logins."""
    path = F.col("path")
    sensitive = path.contains("/login") | path.contains("/auth") | path.contains("/admin")
    one = lambda kind, key, p: F.struct(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), F.lit(p).alias("max_change_pct"))
    by_path = F.when(sensitive, F.array(one("path_request_time", "path", percent), one("path_error_rate", "path", percent / 2)))
    by_ip = F.when(F.col("ip_failed_window") >= least_failed, F.array(one("ip_failed_logins", "ip", percent), one("ip_request_count", "ip", percent * 2)))
    none = F.array().cast("array<struct<entity_type:string,entity_id:string,max_change_pct:double>>")
    return enriched.select(F.explode(F.concat(F.coalesce(by_path, none), F.coalesce(by_ip, none))).alias("e")).select("e.*").distinct()


def entity_thresholds(events: DataFrame, overrides: DataFrame, least: int = 30) -> DataFrame:
    """p95 and p99 of each entity's last values and its threshold: an override, else p95 once established, else null."""
    learned = recent_percentile(events, KEYS, "value", (0.95, 0.99))
    joined = learned.join(overrides.select(*KEYS, F.col("threshold").alias("manual")), KEYS, "left")
    return joined.select(*KEYS, "n", "p95", "p99", F.coalesce("manual", F.when(F.col("n") >= least, F.col("p95"))).alias("threshold"))


def validate_overrides(overrides: DataFrame, thresholds: DataFrame, critical: DataFrame, least: int = 30) -> DataFrame:
    """Each override with a status: 'accepted', or why not: threshold, operator, or a change too large for a critical entity."""
    old = thresholds.where(F.col("n") >= least).select(*KEYS, F.col("p95").alias("old"))
    o = overrides.join(old, KEYS, "left").join(critical, KEYS, "left")
    large = F.col("max_change_pct").isNotNull() & ~accepts(F.col("old"), F.col("threshold"), F.col("max_change_pct"))
    status = F.when(F.coalesce(F.col("threshold") <= 0, F.lit(True)), "invalid threshold").when(F.coalesce(F.col("operator_id"), F.lit("")) == "", "no operator").when(large, "change too large").otherwise("accepted")
    return o.select(*KEYS, "threshold", "operator_id", status.alias("status"))
