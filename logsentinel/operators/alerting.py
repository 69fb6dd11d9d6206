"""The alert table: pre-checks, all sources of alerts in one table, and its document and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsentinel.config import Config
from logsentinel.functions.scalars import fixed
from logsentinel.operators.lookups import in_blocks
from logsentinel.operators.reports import contexts, printable
from logsentinel.operators.rules import candidates, raised, reason_of

COLUMNS = ["line_no", "ts_ms", "ip", "rule", "tier", "action", "score", "reason", "key"]


def precheck(rows: DataFrame, threats: DataFrame, allowed: DataFrame) -> DataFrame:
    """Adds ``checked``: 'threat' for addresses in a listed block (network, prefix), else 'allowed' for allowed ones, else 'rules'."""
    rows = in_blocks(in_blocks(rows, threats).withColumnRenamed("listed", "__threat"), allowed)
    return rows.withColumn("checked", F.when(F.col("__threat"), "threat").when(F.col("listed"), "allowed").otherwise("rules")).drop("__threat", "listed")


def model_alerts(scores: DataFrame, rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """An alert for each row whose model score (line_no, score) is over ``threshold``."""
    hit = scores.where(F.col("score") > threshold).join(rows.select("line_no", "ts_ms", "ip"), "line_no")
    return hit.select("line_no", "ts_ms", "ip", F.lit("ml_score").alias("rule"), F.lit("tier3").alias("tier"), F.lit("BLOCK").alias("action"), "score", F.concat(F.lit("High ML Anomaly Score detected: "), F.expr(fixed("score"))).alias("reason"), F.col("ip").alias("key"))


def metric_rule_alerts(results: DataFrame, at_ms: Column) -> DataFrame:
    """An alert for each triggered metric rule (name, value, triggered, score): no line and no address, the key is the rule."""
    text = F.concat(F.lit("Tier 4 PromQL anomaly: "), "name", F.lit(" (value="), F.expr(fixed("value")), F.lit(", score="), F.expr(fixed("score")), F.lit(")"))
    none = F.lit(None)
    return results.where("triggered").select(none.cast("long").alias("line_no"), at_ms.alias("ts_ms"), none.cast("string").alias("ip"), F.lit("metric_rule").alias("rule"), F.lit("tier4").alias("tier"), F.lit("ALERT").alias("action"), "score", text.alias("reason"), F.col("name").alias("key"))


def alert_table(enriched: DataFrame, cfg: Config, threats: DataFrame, allowed: DataFrame, *more: DataFrame, tiers: tuple[int, ...] = (1, 2), context: list[str] | None = None) -> DataFrame:
    """All alerts of enriched rows with running sessions: listed addresses, rules and session rules in one pass, and other alert tables.

    Rows of allowed addresses raise nothing. Windows and statistics were taken over all rows before. Columns of the row that are named in
    ``context`` go along with its alerts.
    """
    listed = F.array(F.struct(F.lit("threat_list").alias("rule"), F.lit("tier1").alias("tier"), F.lit("BLOCK").alias("action"), F.lit(100.0).alias("score"), F.col("ip").alias("key")))
    found = F.when(F.col("checked") == "threat", listed).when(F.col("checked") == "rules", candidates(cfg, tiers, sessions=True, exact="ip_time_over" in enriched.columns, reasons=False))
    along = [c for c in context or [] if c not in COLUMNS]
    reason = reason_of("a.rule", cfg, tiers, sessions=True, more={"threat_list": "IP is on external threat intelligence blacklist"})
    out = raised(precheck(enriched, threats, allowed), found, reason, along)
    for m in more:
        out = out.unionByName(m, allowMissingColumns=True)
    return out.select(*COLUMNS, *along)


def alert_documents(alerts: DataFrame) -> DataFrame:
    """(line_no, rule, json): the full nested document of each alert, with the row's log and analysis context.

    Missing numbers are 0, strings keep only printable ASCII; a row without a running session has a null session_context.
    ``alerts`` carry the columns of their row (``context`` of the rules); alerts without a line get no document.
    """
    log, analysis, raw = contexts(alerts)
    document = F.struct(
        F.col("ts_ms").alias("timestamp_ms"), printable(F.col("reason")).alias("alert_reason"), F.col("tier").alias("detection_tier"), F.col("action").alias("suggested_action"), F.col("action").alias("action_code"),
        F.round("score", 6).alias("anomaly_score"), printable(F.col("key")).alias("offending_key"), F.lit("").alias("ml_contributing_factors"), log.alias("log_context"), analysis.alias("analysis_context"), raw.alias("raw_log_line"),
    )
    return alerts.where("line_no IS NOT NULL").select("line_no", "rule", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def render_alerts(alerts: DataFrame) -> DataFrame:
    """(line_no, rule, text): a readable block for each alert; times in UTC, a sample is cut to 100 characters."""
    c = F.col
    line = lambda name, value: F.concat(F.lit(f"  {name}"), value, F.lit("\n"))
    when = F.concat(F.date_format(F.timestamp_millis((F.floor(c("ts_ms") / 1000) * 1000).cast("long")), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.pmod(c("ts_ms"), F.lit(1000)).cast("string"))
    parts = [line("Timestamp: ", when), line("Tier:      ", c("tier")), line("Source IP: ", F.coalesce("ip", F.lit(""))), line("Reason:    ", c("reason")), F.when(~c("key").eqNullSafe(c("ip")) & (c("key") != ""), line("Key ID:    ", c("key"))), line("Score:     ", F.expr(fixed("score"))), line("Action:    ", c("action")), F.when(c("line_no") > 0, line("Log Line:  ", c("line_no").cast("string")))]
    if "raw" in alerts.columns:
        parts.append(F.when(c("raw") != "", line("Sample:    ", F.concat(F.substring("raw", 1, 100), F.when(F.length("raw") > 100, "...").otherwise("")))))
    return alerts.select("line_no", "rule", F.concat(F.lit("ALERT DETECTED:\n"), *[F.coalesce(p, F.lit("")) for p in parts], F.lit("-" * 40)).alias("text"))


def priority_sample(rows: DataFrame, key: str, priority: str, percent: float) -> DataFrame:
    """Drops about ``percent`` of the rows, half as many of HIGH and half more of LOW priority, none of CRITICAL; which is decided by the md5 of the key."""
    share = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    weight = F.when(F.col(priority) == "CRITICAL", 0.0).when(F.col(priority) == "HIGH", 0.5).when(F.col(priority) == "LOW", 1.5).otherwise(1.0)
    return rows.where(share >= weight * percent / 100.0)
