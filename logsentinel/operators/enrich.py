"""Enrichment of log rows: windows, running statistics, z-scores, user agents, sessions.

Windows and running values of an address are taken in blocks of time (``blocks``), those of a path likewise. Event time ties
are the normal case; line_no is the arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.config import Config
from logsentinel.functions import scalars as S
from logsentinel.operators.blocks import HOUR, address_features, block_length, present, running_stats


def seq(*keys: str) -> W:
    return W.partitionBy(*keys).orderBy("ts_ms", "line_no").rowsBetween(W.unboundedPreceding, W.currentRow)


def window_count(key: str, ms: int, flag: Column | None = None, cap: int | None = None, held: bool = False) -> Column:
    """Rows (with ``flag``) of the last ``ms`` up to the current arrival.

    The range window also counts later arrivals of the same instant; these are taken off. ``held`` keeps the value
    of the last flagged row.
    """
    one = F.lit(1) if flag is None else flag.cast("int")
    ranged = W.partitionBy(key).orderBy("ts_ms").rangeBetween(-ms, 0)
    tied = W.partitionBy(key, "ts_ms")
    n = F.sum(one).over(ranged) - F.sum(one).over(tied) + F.sum(one).over(tied.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    if cap is not None:
        n = F.least(n, F.lit(cap))
    return F.coalesce(n, F.lit(0)).cast("long") if not held else n


def ip_windows(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Request, failed-login, page and asset counts of the address, and the ratio of assets to pages."""
    return address_features(df, cfg, parts=("windows",))


def seen(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """First request of an address, and paths new to it (once ``max_paths`` are stored, an unstored path stays new)."""
    return address_features(df, cfg, parts=("seen",))


def is_error() -> Column:
    return ((F.col("status") >= 400) & (F.col("status") < 600)).cast("double")


#: Smallest deviation that counts, by statistic.
FLOORS = {"time": 1e-6, "bytes": 1.0, "error": 0.01, "vol": 0.5}


def stats_columns(key: str) -> dict[str, str]:
    """SQL of the values whose moments are kept for an address or a path."""
    out = {f"{key}_time": "request_time_s", f"{key}_bytes": "bytes_sent", f"{key}_error": "CASE WHEN status >= 400 AND status < 600 THEN 1.0D ELSE 0.0D END"}
    return out | ({"ip_vol": "ip_req_window"} if key == "ip" else {})


def zscores(df: DataFrame, key: str, cfg: Config = Config()) -> DataFrame:
    """z of each running statistic that the rows have, null below ``min_samples`` rows or the least deviation."""
    now = stats_columns(key) | {f"{key}_error": "CASE WHEN status >= 400 THEN 1.0D ELSE 0.0D END"}
    now = {n: c for n, c in now.items() if f"{n}_mean" in df.columns}
    floor = {n: FLOORS[n.split("_")[1]] for n in now}
    return df.selectExpr("*", *[f"CASE WHEN {n}_n >= {cfg.min_samples} AND {n}_sd > {floor[n]}D THEN (CAST({c} AS DOUBLE) - {n}_mean) / {n}_sd END AS {n}_z" for n, c in now.items()])


def ua_flags(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Missing, headless, known-bad, outdated and inconsistent user agents, and the outdated browser; a missing one ends the tests."""
    ua = F.col("user_agent")
    there = present(ua)
    chrome, firefox = S.major_version(ua, "Chrome"), S.major_version(ua, "Firefox")
    old_chrome, old_firefox = F.coalesce(chrome < cfg.least_chrome, F.lit(False)), F.coalesce(firefox < cfg.least_firefox, F.lit(False))
    browser = F.when(old_chrome, F.concat(F.lit("Chrome/"), chrome.cast("string"))).when(old_firefox, F.concat(F.lit("Firefox/"), firefox.cast("string")))
    return df.withColumns(
        {
            "ua_missing": ~there,
            "ua_headless": there & S.contains_any(ua, cfg.headless),
            "ua_bad": there & S.contains_any(ua, cfg.known_bad),
            "ua_outdated": there & (old_chrome | old_firefox),
            "ua_inconsistent": there & S.contains_any(ua, cfg.desktop) & S.contains_any(ua, cfg.mobile),
            "browser": F.when(there, browser),
        }
    )


def ua_cycling(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Changed user agents, agents stored in the window, and whether there are too many.

    An agent is stored at its first request and again only once that has left the window, so one that never stops is counted from its
    last storing on. Rows without an agent store nothing and raise nothing.
    """
    return address_features(df, cfg, parts=("agents",))


def sessionize(df: DataFrame, cfg: Config = Config(), keys: tuple[str, ...] = ("ip", "user_agent")) -> DataFrame:
    """session_no counts the key's sessions from 1; a gap of over ``session_gap_s`` begins a new one.

    A key's rows are cut into blocks of time. A pass over keys and times alone gives one row for each block, with the time before it and the sessions
    so far; these rows are mixed into their blocks as markers in front of the first row, so that no task sees more than a block of a key.
    """
    gap_ms = cfg.session_gap_s * 1000
    length = max(4 * gap_ms, HOUR)
    rows = df.withColumn("__block", F.floor(F.col("ts_ms") / length))
    fresh = lambda order: F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(order) > gap_ms, F.lit(True)).cast("long")
    each = rows.select(*keys, "__block", "ts_ms").withColumn("__new", fresh(W.partitionBy(*keys, "__block").orderBy("ts_ms")))
    blocks = each.groupBy(*keys, "__block").agg(F.min("ts_ms").alias("__first"), F.max("ts_ms").alias("ts_ms"), F.sum("__new").alias("__new"))
    far = W.partitionBy(*keys).orderBy("__block")
    goes_on = F.coalesce(F.col("__first") - F.lag("ts_ms").over(far) <= gap_ms, F.lit(False)).cast("long")
    blocks = blocks.withColumns({"__before": F.lag("ts_ms").over(far), "__nth": F.row_number().over(far), "__sessions": F.col("__new") - goes_on})
    markers = blocks.withColumn("__carry", F.sum("__sessions").over(far.rowsBetween(W.unboundedPreceding, -1))).where("__nth > 1")
    mixed = rows.unionByName(markers.select(*keys, "__block", F.col("__before").alias("ts_ms"), "__carry"), allowMissingColumns=True)
    order = W.partitionBy(*keys, "__block").orderBy(F.col("__carry").isNull(), "ts_ms", "line_no")
    mixed = mixed.withColumn("__new", F.coalesce("__carry", fresh(order)))
    counted = mixed.withColumn("session_no", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return counted.where("__carry IS NULL").select(*df.columns, "session_no")


def session_summary(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each session with its counts, means and length."""
    s = sessionize(df, cfg)
    return s.groupBy("ip", "user_agent", "session_no").agg(
        F.count("*").alias("requests"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.countDistinct("path").alias("paths"),
        F.count_if(F.col("status").between(400, 499)).alias("errors_4xx"), F.count_if(F.col("status").between(500, 599)).alias("errors_5xx"),
        F.count_if(F.col("status").isin(*cfg.failed_codes)).alias("failed_logins"), F.count_if(F.col("method") == "POST").alias("posts"), F.count_if(F.col("method") == "GET").alias("gets"),
        F.round(F.avg("request_time_s"), 6).alias("mean_time"), F.round(F.avg("bytes_sent"), 3).alias("mean_bytes"),
    )


def enrich(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All columns that the rules need: what depends on the address first, then what depends on the path."""
    rows = zscores(address_features(ua_flags(df, cfg), cfg, stats_columns("ip"), base=df, over={"ip_time": cfg.slow_factor}), "ip", cfg)
    return zscores(running_stats(rows, "path", stats_columns("path"), base=df), "path", cfg)


def time_scores(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``ip_time_z`` and ``path_time_z`` as ``enrich`` has them, and none of its other columns."""
    for key, length in (("ip", block_length(cfg)), ("path", HOUR)):
        name = f"{key}_time"
        rows = zscores(running_stats(df, key, {name: stats_columns(key)[name]}, length), key, cfg)
        df = rows.drop(f"{name}_mean", f"{name}_sd", f"{name}_n")
    return df
