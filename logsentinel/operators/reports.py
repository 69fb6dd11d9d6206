"""Reports over logs and alerts: recorded series, health, service levels, rule hit rates, text and JSON forms, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.functions import scalars as S
from logsentinel.functions.scalars import fixed
from logsentinel.operators.state import load_state, newest_version


def recorded(df: DataFrame, ms: int = 30_000) -> DataFrame:
    """Requests, errors and mean time of every span of ``ms`` with any rows."""
    return df.groupBy((F.floor(F.col("ts_ms") / ms) * ms).cast("long").alias("start_ms")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.round(F.avg("request_time_s"), 6).alias("mean_time"))


def service_level(df: DataFrame, label: str, bound_s: float) -> DataFrame:
    """Percent of requests within ``bound_s`` and percent without a server error, for each label."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("request_time_s") <= bound_s) * 100 / F.count("*"), 4).alias("fast_pct"), F.round(F.count_if(F.col("status") < 500) * 100 / F.count("*"), 4).alias("up_pct"))


def health(alerts: DataFrame, ms: int, weight: float = 10.0) -> DataFrame:
    """100 less ``weight`` for each alert an hour, at least 0, for each span of ``ms`` with alerts."""
    rate = F.count("*") / (ms / 3_600_000)
    return alerts.groupBy((F.floor(F.col("ts_ms") / ms) * ms).cast("long").alias("start_ms")).agg(F.count("*").alias("alerts"), F.round(F.greatest(F.lit(0.0), 100 - weight * rate), 4).alias("health"))


def hit_rates(alerts: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits of each rule, the rows it was evaluated on, and the share of hits."""
    n = rows.agg(F.count("*").alias("evaluations"))
    return alerts.groupBy("rule").agg(F.count("*").alias("hits")).crossJoin(F.broadcast(n)).select("rule", "hits", "evaluations", F.round(F.col("hits") / F.col("evaluations"), 8).alias("hit_rate"))


def throttle_report(alerts: DataFrame, kept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Alerts and suppressed alerts of each rule (or of the columns ``by``), and the share that was suppressed."""
    by = by or ["rule"]
    after = kept.groupBy(*by).agg(F.count("*").alias("kept"))
    return alerts.groupBy(*by).agg(F.count("*").alias("alerts")).join(after, by, "left").select(*by, "alerts", (F.col("alerts") - F.coalesce("kept", F.lit(0))).alias("suppressed"), F.round(1 - F.coalesce("kept", F.lit(0)) / F.col("alerts"), 6).alias("ratio"))


def weigh_rules(df: DataFrame, rules: list[tuple[str, str, float]], threshold: float = 100.0) -> DataFrame:
    """Rows whose rules (name, SQL condition, weight) add up to at least ``threshold``: total and the names that hold."""
    held = [F.coalesce(F.expr(condition), F.lit(False)) for _, condition, _ in rules]
    total: Column = F.lit(0.0)
    for h, (_, _, weight) in zip(held, rules, strict=True):
        total = total + F.when(h, float(weight)).otherwise(0.0)
    names = F.concat_ws(",", *[F.when(h, F.lit(name)) for h, (name, _, _) in zip(held, rules, strict=True)])
    return df.select("line_no", "ip", total.alias("total"), names.alias("rules")).where(F.col("total") >= threshold)


def weigh_tiers(df: DataFrame, tiers: list[list[tuple[str, str, float]]], threshold: float = 100.0, stop: float = 100.0) -> DataFrame:
    """Like ``weigh_rules``, in tiers: the rules of a tier count only where the tiers before it add up to less than ``stop``."""
    rows = df.withColumns({"__total": F.lit(0.0), "__rules": F.array().cast("array<string>")})
    for rules in tiers:
        reached = F.col("__total") < stop
        held = [(name, reached & F.coalesce(F.expr(condition), F.lit(False)), float(weight)) for name, condition, weight in rules]
        more = F.array_compact(F.array(*[F.when(h, F.lit(name)) for name, h, _ in held])) if held else F.array().cast("array<string>")
        total = F.col("__total")
        for _, h, weight in held:
            total = total + F.when(h, weight).otherwise(0.0)
        rows = rows.withColumns({"__total": total, "__rules": F.concat("__rules", more)})
    return rows.where(F.col("__total") >= threshold).select("line_no", "ip", F.col("__total").alias("total"), F.array_join("__rules", ",").alias("rules"))


def printable(text: Column) -> Column:
    """Only ASCII 32 to 126."""
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def contexts(alerts: DataFrame) -> tuple[Column, Column, Column]:
    """Log context, analysis context and raw line of alerts that carry the columns of their row; what they lack is 0, false or empty, a session null."""
    there = set(alerts.columns)
    text = lambda c: printable(F.coalesce(F.col(c), F.lit(""))) if c in there else F.lit("")
    number = lambda c, kind="double": F.coalesce(F.col(c), F.lit(0)).cast(kind) if c in there else F.lit(0).cast(kind)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in there else F.lit(False)
    part = lambda make, names: F.struct(*[make(c).alias(n) for n, c in names.items()])
    log = F.struct(
        text("ip").alias("source_ip"), F.col("line_no").alias("line_number"), text("host").alias("host"), text("ts_str").alias("timestamp_str"), text("method").alias("request_method"), text("path").alias("request_path"),
        text("protocol").alias("request_protocol"), number("status", "int").alias("status_code"), number("bytes_sent", "long").alias("bytes_sent"), number("request_time_s").alias("request_time_s"), text("user_agent").alias("user_agent"),
        text("referer").alias("referer"), text("country").alias("country_code"), text("request_id").alias("x_request_id"),
    )
    flags = part(flag, {"is_first_request_from_ip": "is_first", "is_path_new_for_ip": "is_path_new", "is_ua_missing": "ua_missing", "is_ua_changed_for_ip": "ua_changed", "is_ua_known_bad": "ua_bad", "is_ua_outdated": "ua_outdated", "is_ua_headless": "ua_headless", "is_ua_inconsistent": "ua_inconsistent", "is_ua_cycling": "ua_cycling", "found_suspicious_path_str": "bad_path", "found_suspicious_ua_str": "bad_agent"})
    counts = part(lambda c: number(c, "long"), {"ip_request_count": "ip_req_window", "ip_failed_login_count": "ip_failed_window", "ip_html_requests": "html_window", "ip_asset_requests": "asset_window"})
    windowed = F.struct(counts["ip_request_count"].alias("ip_request_count"), counts["ip_failed_login_count"].alias("ip_failed_login_count"), counts["ip_html_requests"].alias("ip_html_requests"), counts["ip_asset_requests"].alias("ip_asset_requests"), number("asset_ratio").alias("ip_assets_per_html_ratio"))
    z = part(number, {"ip_req_time": "ip_time_z", "ip_bytes_sent": "ip_bytes_z", "ip_error_event": "ip_error_z", "ip_req_volume": "ip_vol_z", "path_req_time": "path_time_z", "path_bytes_sent": "path_bytes_z", "path_error_event": "path_error_z"})
    began = F.col("ts_ms") - F.round(F.col("session_duration_s") * 1000).cast("long") if "session_duration_s" in there else F.lit(None).cast("long")
    session = F.struct(began.alias("start_time_ms"), F.col("ts_ms").alias("last_seen_ms"), *[number(c).alias(n) for n, c in {"request_count": "session_requests", "unique_paths": "session_paths", "unique_uas": "session_agents", "failed_logins": "session_failed", "errors_4xx": "session_4xx", "errors_5xx": "session_5xx", "avg_time_between_reqs_s": "session_gap_s", "post_to_get_ratio": "session_post_get"}.items()])
    session = F.when(F.col("session_requests").isNotNull(), session) if "session_requests" in there else F.lit(None).cast("struct<request_count:double>")
    analysis = F.struct(flags.alias("flags"), windowed.alias("windowed_stats"), z.alias("z_scores"), session.alias("session_context"))
    return log, analysis, text("raw")


def alerts_json(alerts: DataFrame) -> DataFrame:
    """(line_no, rule, json): one JSON document for each alert, with its key and the log and analysis context of its row (``contexts``)."""
    log, analysis, raw = contexts(alerts)
    core = ["ts_ms", "ip", "rule", "tier", "action", "score", printable(F.col("reason")).alias("reason"), printable(F.col("key")).alias("key")]
    document = F.struct(*core, log.alias("log_context"), analysis.alias("analysis_context"), raw.alias("raw_log_line"))
    return alerts.select("line_no", "rule", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def alerts_text(alerts: DataFrame) -> DataFrame:
    """(line_no, rule, text): one line for each alert, as a log collector takes it."""
    return alerts.select("line_no", "rule", F.concat(F.lit("ALERT: "), printable(F.col("reason")), F.lit(" | IP: "), "ip", F.lit(" | Tier: "), "tier", F.lit(" | Score: "), F.expr(fixed("score"))).alias("text"))


def merge_feed(old: DataFrame, new: DataFrame, generation: int, keep: int = 2) -> DataFrame:
    """(entry, generation): the newest generation of each entry; entries older than ``generation`` - ``keep`` go."""
    both = old.select("entry", "generation").unionByName(new.select("entry", F.lit(generation).cast("long").alias("generation")))
    return both.groupBy("entry").agg(F.max("generation").alias("generation")).where(F.col("generation") >= generation - keep)


#: Type bits of a listed address and of a listed domain, and the confidence of an entry whose feed states none.
MALICIOUS_IP, MALICIOUS_DOMAIN, CONFIDENCE = 1, 2, 80


def feed_entries(lines: DataFrame, *keep: str) -> DataFrame:
    """(entry, kind, types, confidence, source_id, and ``keep``) of feed lines (value, source_id): addresses (kind ``ip``) first, else domains (3 to 253
    characters with a dot). Blank lines, comments (``#``) and whatever is neither are left out.

    Where lines have a column ``stated`` that isn't null, it is the kind of the entry, as of addresses out of a log, whose numbers may go over 255.
    """
    entry = F.btrim("value", F.lit(" \t\r\n\x0b\f"))
    kind = F.when(S.ip_number(entry) > 0, "ip").when(entry.contains(".") & F.length(entry).between(3, 253), "domain")
    kind = F.coalesce(F.when(entry != "", F.col("stated")), kind) if "stated" in lines.columns else kind
    types = F.when(kind == "ip", MALICIOUS_IP).otherwise(MALICIOUS_DOMAIN)
    out = lines.where(~entry.startswith("#")).select(entry.alias("entry"), kind.alias("kind"), types.alias("types"), F.lit(CONFIDENCE).alias("confidence"), "source_id", *keep)
    return out.where("kind IS NOT NULL")


def newest_infos(entries: DataFrame) -> DataFrame:
    """(kind, entry, types, confidence, source_id, generation): of each entry what the newest generation says, there the last source."""
    info = F.max(F.struct("generation", "source_id", "types", "confidence")).alias("i")
    return entries.groupBy("kind", "entry").agg(info).select("kind", "entry", "i.types", "i.confidence", "i.source_id", F.col("i.generation").cast("long").alias("generation"))


def merge_feed_infos(current: DataFrame, new: DataFrame, generation: int, keep: int = 2) -> DataFrame:
    """``current`` with the entries of a new load as ``generation``; entries older than ``generation`` - ``keep`` go."""
    stamped = new.withColumn("generation", F.lit(generation).cast("long")).select("kind", "entry", "types", "confidence", "source_id", "generation")
    return newest_infos(current.unionByName(stamped)).where(F.col("generation") >= generation - keep)


def refresh_feed(spark: SparkSession, path: str, lines: DataFrame) -> int:
    """Loads feed lines as the next generation and stores the merged table as ``path/version=N``; returns N.

    A load that fails leaves a folder without ``_SUCCESS``: readers (``state.load_state``) keep the generation before, and the next load takes
    the same number again. The first load is generation 1.
    """
    version = newest_version(spark, path)
    fresh = feed_entries(lines)
    if version is None:
        merged = newest_infos(fresh.withColumn("generation", F.lit(1)))
    else:
        merged = merge_feed_infos(load_state(spark, path, version), fresh, version + 1)
    version = (version or 0) + 1
    merged.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def dominant(spectrum: DataFrame, key: str, size: int, most: int = 3) -> DataFrame:
    """The strongest frequencies of each key between 1 and size / 2, with their share of all magnitudes."""
    w = W.partitionBy(key)
    s = spectrum.withColumn("all", F.sum("magnitude").over(w)).where(F.col("k").between(1, size // 2 - 1))
    ranked = s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("magnitude"), "k"))).where(F.col("rank") <= most)
    return ranked.select(key, "k", "rank", "magnitude", F.round(F.col("magnitude") / F.col("all"), 5).alias("share"))


def roll_back_feed(feed: DataFrame, generation: int) -> DataFrame:
    """The feed without what ``generation`` loaded: a failed load leaves no trace."""
    return feed.where(F.col("generation") < generation)


def reliability(df: DataFrame, ms: int) -> DataFrame:
    """(start_ms, index): the mean of the shares of requests without a server error and within a second, in percent."""
    good = (F.count_if(F.col("status") < 500) + F.count_if(F.col("request_time_s") <= 1)) / (2 * F.count("*"))
    return df.groupBy((F.floor(F.col("ts_ms") / ms) * ms).cast("long").alias("start_ms")).agg(F.round(good * 100, 4).alias("index"))


def delivery_failures(deliveries: DataFrame) -> DataFrame:
    """(sink, attempts, failed_pct) of delivery rows (sink, attempted, delivered)."""
    failed = F.sum("attempted") - F.sum("delivered")
    return deliveries.groupBy("sink").agg(F.sum("attempted").alias("attempts"), F.round(F.when(F.sum("attempted") > 0, failed * 100 / F.sum("attempted")), 4).alias("failed_pct"))


def targeted_paths(alerts: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(path, alerts): the paths with most alerts."""
    return alerts.join(rows.select("line_no", "path"), "line_no").groupBy("path").agg(F.count("*").alias("alerts")).orderBy(F.desc("alerts"), "path").limit(k)
