"""Running session attributes, session rules and features of the session so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.config import Config
from logsentinel.operators.enrich import seq, sessionize, window_count
from logsentinel.operators.rules import session_rules, together

#: Gaps are averaged over so many of a session's last requests.
LAST = 50


def running_sessions(df: DataFrame, cfg: Config = Config(), keys: tuple[str, ...] = ("ip", "user_agent")) -> DataFrame:
    """Attributes of the session up to and including each row, as columns ``session_*``.

    A session of one request has no mean gap; without a GET the ratio of POST to GET is 0.
    """
    df = sessionize(df, cfg, keys).withColumn("session_id", F.concat_ws("|", *keys, "session_no"))
    w, c = seq("session_id"), F.col
    fresh = lambda col: (F.row_number().over(W.partitionBy("session_id", col).orderBy("ts_ms", "line_no")) == 1).cast("int")
    count = lambda flag: F.sum(flag.cast("int")).over(w)
    df = df.withColumns({"__path": fresh("path"), "__agent": fresh("user_agent"), "session_req_window": window_count("session_id", cfg.window_ms)})
    recent = W.partitionBy("session_id").orderBy("ts_ms", "line_no").rowsBetween(-LAST + 1, 0)
    gets = count(c("method") == "GET")
    return df.withColumns(
        {
            "session_requests": F.count("*").over(w),
            "session_duration_s": (c("ts_ms") - F.min("ts_ms").over(w)) / 1000.0,
            "session_paths": F.sum("__path").over(w),
            "session_agents": F.sum("__agent").over(w),
            "session_4xx": count(c("status").between(400, 499)),
            "session_5xx": count(c("status").between(500, 599)),
            "session_failed": count(c("status").isin(*cfg.failed_codes)),
            "session_gap_s": F.when(F.count("*").over(recent) > 1, (c("ts_ms") - F.first("ts_ms").over(recent)) / 1000.0 / (F.count("*").over(recent) - 1)),
            "session_post_get": F.when(gets > 0, count(c("method") == "POST") / gets).otherwise(0.0),
            "session_bytes_mean": F.avg("bytes_sent").over(w),
            "session_time_mean": F.avg("request_time_s").over(w),
        }
    ).drop("__path", "__agent")


def running_means(df: DataFrame, means: dict[str, str], cfg: Config = Config(), keys: tuple[str, ...] = ("ip", "user_agent")) -> DataFrame:
    """Adds means of columns over the session up to and including each row, for callers that need none of the other attributes."""
    w = seq(*keys, "session_no")
    return sessionize(df, cfg, keys).withColumns({n: F.avg(c).over(w) for n, c in means.items()}).drop("session_no")


def session_alerts(running: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(line_no, ts_ms, ip, session_id, rule, action, score, reason): failed logins, request rate and user agents of a session."""
    found = F.explode(together(session_rules(cfg))).alias("a")
    return running.select("line_no", "ts_ms", "ip", "session_id", found).select("line_no", "ts_ms", "ip", "session_id", "a.rule", "a.action", "a.score", "a.reason")


def session_events(running: DataFrame) -> DataFrame:
    """(entity_type, entity_id, ts_ms, line_no, value): what baselines learn from the session so far, under its address.

    The frequency counts every request of the session. Failed logins are learned from the first one on.
    """
    c = F.col
    one = lambda kind, value: F.struct(F.lit(kind).alias("entity_type"), value.cast("double").alias("value"))
    items = [
        one("session_request_count", c("session_requests")), one("session_unique_paths", c("session_paths")), one("session_error_rate", (c("session_4xx") + c("session_5xx")) / c("session_requests")),
        F.when(c("session_failed") > 0, one("session_failed_logins", c("session_failed"))), one("session_request_frequency", c("session_requests")),
    ]
    return running.select("ip", "ts_ms", "line_no", F.explode(F.array_compact(F.array(*items))).alias("e")).select("e.entity_type", F.col("ip").alias("entity_id"), "ts_ms", "line_no", "e.value")


#: Request methods that are counted by name; all others together.
METHODS = ["GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH"]


def session_details(running: DataFrame) -> DataFrame:
    """One row for each session (``session_id``) with all that is kept of it: what ``running_sessions`` says at its last request (so requests of the
    window that ends there), requests by method (``GET:3,POST:1,other:1``), number, mean and deviation of times and sizes, and the last ``LAST`` paths in order.

    A figure over no or (deviation) one value is null or 0; requests without a method are in none of the method counts. No more than ``LAST`` paths of a session are gathered.
    """
    c = F.col
    state = {
        "requests": "session_requests", "requests_window": "session_req_window", "duration_s": "session_duration_s", "paths": "session_paths", "agents": "session_agents", "errors_4xx": "session_4xx",
        "errors_5xx": "session_5xx", "failed_logins": "session_failed", "gap_s": "session_gap_s", "post_get": "session_post_get",
    }
    latest = W.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("line_no"))
    rows = running.withColumn("__back", F.row_number().over(latest))
    named = lambda name, n: F.when(n > 0, F.concat(F.lit(f"{name}:"), n.cast("string")))
    methods = [named(m, F.count_if(c("method") == m)) for m in METHODS] + [named("other", F.count_if(c("method").isNotNull() & ~c("method").isin(METHODS)))]
    spread = lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))
    one = rows.groupBy("session_id").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.max(F.when(c("__back") == 1, F.struct(*[c(v).alias(k) for k, v in state.items()]))).alias("s"), F.concat_ws(",", *methods).alias("methods"),
        F.count("request_time_s").alias("time_n"), F.avg("request_time_s").alias("time_mean"), spread("request_time_s").alias("time_sd"), F.count("bytes_sent").alias("bytes_n"), F.avg("bytes_sent").alias("bytes_mean"), spread("bytes_sent").alias("bytes_sd"),
        F.array_sort(F.collect_list(F.when(c("__back") <= LAST, F.struct("ts_ms", "line_no", "path")))).alias("p"),
    )
    return one.select("session_id", "start_ms", "end_ms", "s.*", "methods", "time_n", "time_mean", "time_sd", "bytes_n", "bytes_mean", "bytes_sd", F.array_join(c("p.path"), " ").alias("last_paths"))
