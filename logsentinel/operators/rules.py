"""Detection rules: one pass over enriched rows gives an array of candidate alerts, which is exploded.

Rules are SQL text, which the driver hands over as one expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.config import Config
from logsentinel.functions import scalars as S
from logsentinel.functions.scalars import figure, literal


class Rule(NamedTuple):
    """An alert where ``when`` holds and the score is over 0; a reason is a literal, or parts of SQL that are put together."""

    when: str
    name: str
    tier: int
    action: str
    score: str | float
    reason: list[str] | str
    key: str = "ip"

    @property
    def text(self) -> str:
        return literal(self.reason) if isinstance(self.reason, str) else f"concat({', '.join(self.reason)})"

    def struct(self, reasons: bool) -> str:
        text = f"'reason', {self.text}, " if reasons else ""
        return f"CASE WHEN {self.when} AND {self.score} > 0 THEN named_struct('rule', '{self.name}', 'tier', 'tier{self.tier}', 'action', '{self.action}', 'score', CAST({self.score} AS DOUBLE), {text}'key', {self.key}) END"


# fixed values: names of the statistics in reasons
NAMES = {"time": "request_time", "bytes": "bytes_sent", "error": "error_rate", "vol": "request_volume"}


def tier1(cfg: Config) -> list[Rule]:
    bad_path, bad_agent, sensitive = S.first_match("path", cfg.bad_paths), S.first_match("user_agent", cfg.bad_agents), S.first_listed("path", cfg.sensitive)
    end = literal(f" in last {cfg.window_ms // 1000}s.")
    r, f = "CAST(ip_req_window AS DOUBLE)", "CAST(ip_failed_window AS DOUBLE)"
    thin = [literal("Low Asset-to-HTML request ratio detected. Ratio: "), figure("asset_ratio"), literal(f" (Expected minimum: >{cfg.least_asset_ratio:.6f}). HTML: "), "html_window", literal(", Assets: "), "asset_window", literal(" in window.")]
    return [
        Rule(f"{r} > {cfg.max_requests}", "requests_per_ip", 1, "RATE_LIMIT", S.score_threshold(r, cfg.max_requests, 10 * cfg.max_requests, 60.0), [literal("High request rate from IP. Count: "), "ip_req_window", end]),
        Rule(f"{f} > {cfg.max_failed_logins}", "failed_logins", 1, "BLOCK", S.score_threshold(f, cfg.max_failed_logins, 5 * cfg.max_failed_logins, 70.0, 99.0), [literal("Multiple failed login attempts from IP. Count: "), "ip_failed_window", end]),
        Rule(f"{bad_path} IS NOT NULL", "suspicious_path", 1, "BLOCK", 95.0, [literal("Request path contains a suspicious pattern: "), bad_path]),
        Rule(f"{bad_agent} IS NOT NULL", "suspicious_ua", 1, "BLOCK", 75.0, [literal("User-Agent contains a suspicious pattern: "), bad_agent]),
        Rule("ua_missing", "ua_missing", 1, "LOG", 5.0, "Request with missing User-Agent"),
        Rule("ua_bad", "ua_known_bad", 1, "BLOCK", 75.0, "Request from a known malicious User-Agent signature"),
        Rule("ua_headless", "ua_headless", 1, "CHALLENGE", 40.0, "Request from a known headless browser signature"),
        Rule("ua_outdated", "ua_outdated", 1, "LOG", 10.0, [literal("Request from outdated browser: "), "coalesce(browser, '')"]),
        Rule("ua_cycling", "ua_cycling", 1, "BLOCK", 85.0, "IP rapidly cycling through different User-Agents"),
        Rule(f"html_window >= {cfg.least_html} AND asset_ratio < {cfg.least_asset_ratio}", "asset_ratio", 1, "CHALLENGE", "CASE WHEN asset_ratio >= 0.1D THEN 50.0D ELSE 95.0D END", thin),
        Rule(f"is_first AND {sensitive} IS NOT NULL", "sensitive_new_ip", 1, "BLOCK", 80.0, [literal("Newly seen IP immediately accessed a sensitive path containing '"), sensitive, literal("'.")]),
    ]


def tier2(cfg: Config, exact: bool = False) -> list[Rule]:
    """``exact``: rows have ``ip_time_over``, whose sign says whether the request time is over the threshold of ``slowdown``."""
    out = [Rule("is_path_new AND ip_error_z > 2.5", "new_path_errors", 2, "CHALLENGE", S.score_z("ip_error_z", 2.5, 70.0), [literal("IP began generating a high error rate (Z-score: "), figure("ip_error_z"), literal(") while accessing a new path for the first time")])]
    for key in ("ip", "path"):
        for stat in ("time", "bytes", "error", "vol")[: 4 if key == "ip" else 3]:
            z = f"{key}_{stat}_z"
            head = [literal(f"Anomalous IP {NAMES[stat]} (Z-score: ")] if key == "ip" else [literal(f"Anomalous {NAMES[stat]} for path '"), "path", literal("' (Z-score: ")]
            out.append(Rule(f"abs({z}) > {cfg.z_threshold}", z, 2, "LOG", S.score_z(z, cfg.z_threshold), [*head, figure(z), literal(")")], key))
    slow, most = f"({cfg.slow_factor}D * ip_time_mean)", f"({5 * cfg.slow_factor}D * ip_time_mean)"
    text = [literal("Sudden performance degradation for IP. Request time "), figure("request_time_s"), literal(f"s is >{cfg.slow_factor:.6f}x the historical average of "), figure("ip_time_mean"), literal("s")]
    over, score = f"request_time_s > {slow}", S.score_threshold("request_time_s", slow, most, 50.0)
    if exact:
        # a value that is over by less than the mean's own digits has the least score, whatever the order of adding
        over, score = "ip_time_over > 0", f"(CASE WHEN request_time_s <= {slow} OR ip_time_over <= {2.0**-50}D * ip_time_n * {slow} THEN 50.0D ELSE {score} END)"
    out.append(Rule(f"ip_time_n >= {cfg.min_samples} AND ip_time_mean > 0 AND {over}", "slowdown", 2, "LOG", score, text))
    return out


def session_rules(cfg: Config) -> list[Rule]:
    """Failed logins, request rate and user agents of the session so far (columns ``session_*``)."""
    return [
        Rule(f"session_failed > {cfg.session_failed_logins}", "session_failed_logins", 1, "BLOCK", 85.0, [literal("High number of failed logins within a single session: "), "session_failed"]),
        Rule(f"session_req_window > {cfg.session_requests}", "session_requests", 1, "CHALLENGE", 70.0, [literal("Anomalously high request rate within a single session: "), "session_req_window", literal(" reqs in window.")]),
        Rule(f"session_agents > {cfg.max_session_agents}", "session_agents", 1, "BLOCK", 90.0, [literal("User-Agent changed "), "session_agents", literal(" times within a single session.")]),
    ]


def _rules(cfg: Config, tiers: tuple[int, ...], sessions: bool, exact: bool) -> list[Rule]:
    """Rules of the tiers; tiers that are left out never enter the plan."""
    return (tier1(cfg) if 1 in tiers else []) + (tier2(cfg, exact) if 2 in tiers else []) + (session_rules(cfg) if sessions and 1 in tiers else [])


def together(rules: list[Rule], reasons: bool = True) -> Column:
    """The array of the alerts that are not null."""
    kinds = f"array<struct<rule:string,tier:string,action:string,score:double,{'reason:string,' if reasons else ''}key:string>>"
    return F.expr(f"array_compact(array({', '.join(r.struct(reasons) for r in rules)}))") if rules else F.array().cast(kinds)


def candidates(cfg: Config, tiers: tuple[int, ...] = (1, 2), sessions: bool = False, exact: bool = False, reasons: bool = True) -> Column:
    """The array of alerts that a row raises; without ``reasons`` its structs have no reason (``reason_of`` gives it later)."""
    return together(_rules(cfg, tiers, sessions, exact), reasons)


def reason_of(rule: str, cfg: Config, tiers: tuple[int, ...] = (1, 2), sessions: bool = False, more: dict[str, str] | None = None) -> Column:
    """The reason of an alert whose rule is in the column ``rule``, beside the columns of its row: only texts that are read are made.

    ``more`` has the reasons of other rules.
    """
    texts = {r.name: r.text for r in _rules(cfg, tiers, sessions, False)} | {n: literal(t) for n, t in (more or {}).items()}
    return F.expr(f"CASE {rule} {' '.join(f'WHEN {literal(n)} THEN {t}' for n, t in texts.items())} END") if texts else F.lit(None).cast("string")


def raised(rows: DataFrame, found: Column, reason: Column, context: list[str]) -> DataFrame:
    """One row for each alert in the array ``found``, with its reason and the columns of its row that ``context`` names."""
    out = rows.select("*", F.explode(found).alias("a"))
    return out.select("line_no", "ts_ms", "ip", *context, "a.rule", "a.tier", "a.action", "a.score", reason.alias("reason"), "a.key")


def evaluate_rules(enriched: DataFrame, cfg: Config = Config(), tiers: tuple[int, ...] = (1, 2), context: tuple[str, ...] = ()) -> DataFrame:
    """Alerts (line_no, ts_ms, ip, rule, tier, action, score, reason, key), and the columns of their row that ``context`` names."""
    found = candidates(cfg, tiers, exact="ip_time_over" in enriched.columns, reasons=False)
    return raised(enriched, found, reason_of("a.rule", cfg, tiers), list(context))


def throttle(alerts: DataFrame, seconds: float = 300, most_between: int = 0, key: str = "reason") -> DataFrame:
    """Drops an alert that follows a recorded one of the same address and ``key`` by less than ``seconds``.

    Only recorded alerts move the anchor. With ``most_between`` an alert is recorded again once so many other alerts of its
    address were recorded since. Order of an address: ts_ms, line_no, rule. An address is cut where no alert comes for
    ``seconds``, as nothing is remembered beyond such a gap; each piece is read as a stream that remembers only
    the keys of its last ``seconds``. Null times are recorded always. All columns stay as they are.
    """
    span, names = round(seconds * 1000), alerts.columns
    order = W.partitionBy("ip").orderBy("ts_ms", "line_no", "rule")
    gap = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(order) >= span, F.lit(True)).cast("int")
    pieces = alerts.withColumn("__g", gap).withColumn("__piece", F.sum("__g").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__g")
    place = [pieces.columns.index(c) for c in ("ip", "__piece", "ts_ms", key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, recorded = None, {}, 0
        for batch in batches:
            keep = []
            for ip, piece, ts, name in zip(*(batch.column(i).to_pylist() for i in place), strict=True):
                if (ip, piece) != at:
                    at, known, recorded = (ip, piece), {}, 0
                last = known.get(name)
                again = ts is None or last is None or ts >= last[0] + span or bool(most_between) and recorded - last[1] >= most_between
                keep.append(again)
                if again and ts is not None:
                    recorded += 1
                    known.pop(name, None)
                    known[name] = (ts, recorded)
                    while known and known[oldest := next(iter(known))][0] + span <= ts:
                        del known[oldest]
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = pieces.repartition("ip", "__piece").sortWithinPartitions("ip", "__piece", "ts_ms", "line_no", "rule")
    return dealt.mapInArrow(run, pieces.schema).select(*names)
