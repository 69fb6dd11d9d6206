"""Windows and running values of an address in blocks of time, so that an address with most of the rows is spread over tasks.

An address's rows are cut into blocks of at least the window's length. The rows of a block's last ``window_ms`` are copied into the next
block (a halo), which then counts its windows by itself. What reaches further back (held counts, moments, the last user agent) is added
up or looked up in a table with one row for each block, and joined to the block's rows, which are dealt out by block already.

Facts that need a view of another key are computed on few columns first and mixed into the block as markers in front of their
row: the first row of each path of an address, and the rows at which a user agent is stored. All windows of a block share one
sort: a count is what came up to the row less what left the window before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.config import Config
from logsentinel.functions import scalars as S

HOUR = 3_600_000
PARTS = ("windows", "seen", "agents", "stats")


def block_length(cfg: Config) -> int:
    """Four windows, an hour at least: a halo is a quarter of the rows or less."""
    return max(4 * cfg.window_ms, HOUR)


def present(agent: Column) -> Column:
    return agent.isNotNull() & ~agent.isin("", "-")


def first_visits(df: DataFrame, most: int) -> DataFrame:
    """(ip, ts_ms, line_no, __visit): the first row of each path of an address, numbered up to 2; where an address has more than ``most``
    paths, also every row of a path behind these (such paths are never stored and stay new)."""
    first = df.groupBy("ip", "path").agg(F.min(F.struct("ts_ms", "line_no")).alias("m"))
    rank = F.row_number().over(W.partitionBy("ip").orderBy("m")).alias("rank")
    ranked = first.select("ip", "path", "m.ts_ms", "m.line_no", rank)
    again = df.join(ranked.where(F.col("rank") > most).select("ip", "path"), ["ip", "path"], "left_semi").select("ip", "ts_ms", "line_no", F.lit(2).alias("__visit"))
    return ranked.where(F.col("rank") <= most).select("ip", "ts_ms", "line_no", F.least("rank", F.lit(2)).cast("int").alias("__visit")).unionByName(again)


def stored_agents(df: DataFrame, ms: int) -> DataFrame:
    """(ip, ts_ms, line_no): the rows at which a user agent of an address is stored: its first, and then the first one
    after the stored one has left the window (more than ``ms`` later).

    Only the first row of each instant of an agent can be stored, so the rest is gone before the shuffle. An agent's instants are cut where
    none comes for over ``ms``; each piece is read as a stream.
    """
    instants = df.where(present(F.col("user_agent"))).groupBy("ip", "user_agent", "ts_ms").agg(F.min("line_no").alias("line_no"))
    order = W.partitionBy("ip", "user_agent").orderBy("ts_ms")
    gap = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(order) > ms, F.lit(True))
    pieces = instants.withColumn("__piece", F.sum(gap.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    keys = ["ip", "user_agent", "__piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 0
        for batch in batches:
            keep = []
            for *key, ts in zip(*(batch.column(c).to_pylist() for c in (*keys, "ts_ms")), strict=True):
                fresh = key != at or ts > last + ms
                keep.append(fresh)
                if fresh:
                    at, last = key, ts
            yield batch.filter(pa.array(keep, pa.bool_())).select(["ip", "ts_ms", "line_no"])

    return pieces.repartition(*keys).sortWithinPartitions(*keys, "ts_ms").mapInArrow(run, "ip string, ts_ms long, line_no long")


def _moments(stats: dict[str, str]) -> list[Column]:
    return [F.expr(e) for n, c in stats.items() for e in (f"count({c}) AS __n_{n}", f"avg(CAST({c} AS DOUBLE)) AS __m_{n}", f"coalesce(var_pop(CAST({c} AS DOUBLE)) * count({c}), 0.0D) AS __s_{n}")]


def _halves(x: str) -> tuple[str, str]:
    """SQL of a double as two that add up to it: multiples of 2**-30, and what is left. Sums of either are exact up to 2**23 and 2**18 rows."""
    # a value of 2**60 or more is such a multiple as it is, and the product could overflow
    high = f"(CASE WHEN abs(CAST({x} AS DOUBLE)) < {2.0**60}D THEN rint(CAST({x} AS DOUBLE) * {2.0**30}D) / {2.0**30}D ELSE CAST({x} AS DOUBLE) END)"
    return high, f"(CAST({x} AS DOUBLE) - {high})"


def running_moments(rows: DataFrame, per: DataFrame, key: str, stats: dict[str, str], order: str, more: dict[str, str], over: dict[str, float] | None = None) -> DataFrame:
    """Adds mean, sample deviation (0 for one value) and count of each statistic (SQL) up to and including the row.

    For the statistics named in ``over``, with a factor, also ``_over``: value less factor times mean, times the count. It comes from exact sums, so its
    sign doesn't depend on the order of adding, not even where a value lies on the threshold. Their mean is the exact sum, rounded once, by the count.

    ``per`` has the moments of each block (``__n_``, ``__m_``, ``__s_``) and other columns; ``more`` (SQL) are windows over its blocks that
    are joined along. Moments are about the key's own mean, which keeps the sums small.
    """
    before, whole = f"OVER (PARTITION BY {key} ORDER BY __block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"OVER (PARTITION BY {key})"
    centred = per.selectExpr("*", *[f"coalesce(sum(__n_{n} * coalesce(__m_{n}, 0.0D)) {whole} / nullif(sum(__n_{n}) {whole}, 0), 0.0D) AS __c_{n}" for n in stats])
    off = {n: f"(CASE WHEN __n_{n} > 0 THEN __m_{n} - __c_{n} ELSE 0.0D END)" for n in stats}
    carried = [f"{e} AS {n}" for n, e in more.items()]
    for n in stats:
        carried += [f"coalesce(sum(__n_{n}) {before}, 0) AS __b_{n}", f"coalesce(sum(__n_{n} * {off[n]}) {before}, 0.0D) AS __f_{n}", f"coalesce(sum(__s_{n} + __n_{n} * {off[n]} * {off[n]}) {before}, 0.0D) AS __q_{n}", f"__c_{n}"]
    for n in over or {}:
        carried += [f"coalesce(sum(__{h}_{n}) {before}, 0.0D) AS __b{h}_{n}" for h in ("high", "low")]
    rows = rows.join(centred.selectExpr(key, "__block", *carried), [key, "__block"])
    if not stats:
        return rows
    upto = f"OVER (PARTITION BY {key}, __block ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    halves = {n: dict(zip(("high", "low"), _halves(stats[n]), strict=True)) for n in over or {}}
    rows = rows.selectExpr("*", *[f"CAST({c} AS DOUBLE) - __c_{n} AS __d_{n}" for n, c in stats.items()])
    rows = rows.selectExpr("*", *[e for n in stats for e in (f"__b_{n} + count(__d_{n}) {upto} AS {n}_n", f"__f_{n} + coalesce(sum(__d_{n}) {upto}, 0.0D) AS __v_{n}", f"__q_{n} + coalesce(sum(__d_{n} * __d_{n}) {upto}, 0.0D) AS __w_{n}")], *[f"__b{h}_{n} + coalesce(sum({x}) {upto}, 0.0D) AS __t{h}_{n}" for n, parts in halves.items() for h, x in parts.items()])
    mean = {n: f"__v_{n} / nullif({n}_n, 0)" for n in stats}
    shown = {n: f"(__thigh_{n} + __tlow_{n}) / nullif({n}_n, 0)" if n in halves else f"{mean[n]} + __c_{n}" for n in stats}
    return rows.selectExpr("*", *[e for n in stats for e in (f"{shown[n]} AS {n}_mean", f"CASE WHEN {n}_n > 1 THEN sqrt(greatest(__w_{n} - {mean[n]} * __v_{n}, 0.0D) / ({n}_n - 1)) ELSE 0.0D END AS {n}_sd")], *[" + ".join(f"({n}_n * {x} - {over[n]}D * __t{h}_{n})" for h, x in parts.items()) + f" AS {n}_over" for n, parts in halves.items()])


def running_stats(df: DataFrame, key: str, stats: dict[str, str], length: int = HOUR, base: DataFrame | None = None) -> DataFrame:
    """Running moments of a key's rows in order of (ts_ms, line_no), in blocks of time: a hot key is spread over as many tasks as it has blocks.

    ``base`` has the same rows with fewer columns, from which the table of blocks is made without what ``df`` adds.
    """
    names, block = df.columns, f"floor(ts_ms / {length}) AS __block"
    source = (df if base is None else base).selectExpr("*", block)
    per = source.groupBy(key, "__block").agg(*_moments(stats))
    rows = running_moments(df.selectExpr("*", block), per, key, stats, "ts_ms, line_no", {})
    return rows.select(*names, *[f"{n}_{x}" for n in stats for x in ("mean", "sd", "n")])


def _dealt(rows: DataFrame, length: int, ms: int) -> DataFrame:
    """Rows with their block, and copies of a block's last rows (``__own`` false) in the next one."""
    places = f"array_compact(array(named_struct('__block', floor(ts_ms / {length}), '__own', true), CASE WHEN pmod(ts_ms, {length}) >= {length - ms} THEN named_struct('__block', floor(ts_ms / {length}) + 1, '__own', false) END))"
    return rows.selectExpr("*", f"inline({places})")


def _counted(dealt: DataFrame, cfg: Config, counts: list[str]) -> DataFrame:
    """Adds ``__n_*``: the flags in the window that ends with the row; cap and ties as the log says."""
    part = "OVER (PARTITION BY ip, __block ORDER BY ts_ms"
    upto, gone = f"{part}, line_no, __row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"{part} RANGE BETWEEN UNBOUNDED PRECEDING AND {cfg.window_ms + 1} PRECEDING)"
    cap = lambda n, x: f"least({x}, {cfg.window_cap})" if cfg.window_cap is not None and n != "stored" else x
    dealt = dealt.selectExpr("*", *[f"sum(CAST(coalesce(__{n}, false) AS INT)) {upto} AS __u_{n}" for n in counts])
    dealt = dealt.selectExpr("*", *[f"coalesce(sum(CAST(coalesce(__{n}, false) AS INT)) {gone}, 0) AS __g_{n}" for n in counts])
    return dealt.selectExpr("*", *[f"CAST({cap(n, f'__u_{n} - __g_{n}')} AS BIGINT) AS __n_{n}" for n in counts])


PRESENT = "(user_agent IS NOT NULL AND user_agent NOT IN ('', '-'))"


def address_features(df: DataFrame, cfg: Config = Config(), stats: dict[str, str] | None = None, parts: tuple[str, ...] = PARTS, length: int | None = None, base: DataFrame | None = None, over: dict[str, float] | None = None) -> DataFrame:
    """Adds the columns of the named parts, each up to and including the row, in order of (ts_ms, line_no); line_no is unique, ip is not null.

    windows: request_type, ip_req_window, ip_failed_window, html_window, asset_window (the last three move on flagged rows only), asset_ratio.
    seen: is_first, is_path_new. agents: ua_changed, agents_window (user agents stored and not yet out of the window), ua_cycling.
    stats: mean, sd and n of each of ``stats`` (SQL, which may use the windows), and ``_over`` of those in ``over`` (``running_moments``). ``base`` has the same rows with the log's columns alone.
    """
    base = df if base is None else base
    length = length or block_length(cfg)
    if length < cfg.window_ms:
        raise ValueError("a block must be at least as long as the window")
    names, agents, seen, stats = df.columns, "agents" in parts, "seen" in parts, (stats or {}) if "stats" in parts else {}
    over = {n: f for n, f in (over or {}).items() if n in stats}
    held = {"ip_failed_window": "failed", "html_window": "html", "asset_window": "asset"}
    codes = ", ".join(map(str, cfg.failed_codes))

    counted = ["req", *held.values()] if "windows" in parts or stats else []

    def flagged(x: DataFrame) -> DataFrame:
        if not counted:
            return x.selectExpr("*", "true AS __row")
        typed = x.withColumn("request_type", S.request_type(F.col("path"), cfg))
        return typed.selectExpr("*", "true AS __row", "true AS __req", f"status IN ({codes}) AS __failed", "request_type = 'HTML' AS __html", "request_type = 'ASSET' AS __asset")

    # what the windows don't read goes along as one value, which keeps their rows and generated code small
    read = {"ip", "ts_ms", "line_no", "path", "status", "user_agent"} | {n for n in names if any(n in text for text in stats.values())}
    along = [n for n in names if n not in read]
    packed = df.select(*[n for n in names if n in read], F.struct(*along).alias("__along")) if along else df
    marked = flagged(packed)
    if seen:
        marked = marked.unionByName(first_visits(base, cfg.max_paths).selectExpr("*", "false AS __row"), allowMissingColumns=True)
    if agents:
        marked = marked.unionByName(stored_agents(base, cfg.window_ms).selectExpr("*", "false AS __row", "true AS __stored"), allowMissingColumns=True)
    rows = _counted(_dealt(marked, length, cfg.window_ms), cfg, [*counted, *(["stored"] if agents else [])])
    # the table of blocks
    narrow = _counted(_dealt(flagged(base), length, cfg.window_ms), cfg, counted).where("__own").withColumnRenamed("__n_req", "ip_req_window")
    last = {n: f"max(CASE WHEN __{f} THEN named_struct('t', ts_ms, 'l', line_no, 'x', __n_{f}) END) AS __l_{n}" for n, f in held.items() if counted}
    if agents:
        last["agent"] = f"max(CASE WHEN {PRESENT} THEN named_struct('t', ts_ms, 'l', line_no, 'x', user_agent) END) AS __l_agent"
    per = narrow.groupBy("ip", "__block").agg(F.count("*").alias("__rows"), *[F.expr(e) for e in last.values()], *_moments(stats), *[F.expr(f"sum({x}) AS __{h}_{n}") for n in over for h, x in zip(("high", "low"), _halves(stats[n]), strict=True)])
    more = {f"__l_{n}": f"last(__l_{n}, true) OVER (PARTITION BY ip ORDER BY __block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).x" for n in last}
    # the rows
    part = "OVER (PARTITION BY ip, __block ORDER BY ts_ms, line_no, __row ROWS BETWEEN UNBOUNDED PRECEDING AND"
    fresh = [f"last(CASE WHEN __row AND __own AND __{f} THEN __n_{f} END, true) {part} CURRENT ROW) AS __h_{n}" for n, f in held.items() if counted]
    if agents:
        fresh.append(f"last(CASE WHEN __row AND __own AND {PRESENT} THEN user_agent END, true) {part} 1 PRECEDING) AS __h_agent")
    if seen:
        fresh.append(f"last(CASE WHEN __own AND __visit IS NOT NULL THEN named_struct('line', line_no, 'visit', __visit) END, true) {part} CURRENT ROW) AS __visited")
    rows = rows.selectExpr("*", *fresh).where("__row AND __own").withColumnRenamed("__n_req", "ip_req_window")
    if last or stats:
        rows = running_moments(rows, per, "ip", stats, "ts_ms, line_no", more, over)
    out = []
    if "windows" in parts:
        out += ["request_type", "ip_req_window", *[f"coalesce(__h_{n}, __l_{n}, 0L) AS {n}" for n in held], "CASE WHEN coalesce(__h_html_window, __l_html_window, 0L) > 0 THEN coalesce(__h_asset_window, __l_asset_window, 0L) / coalesce(__h_html_window, __l_html_window) END AS asset_ratio"]
    if seen:
        out += ["coalesce(__visited.line = line_no, false) AS is_path_new", "coalesce(__visited.line = line_no AND __visited.visit = 1, false) AS is_first"]
    if agents:
        out += [f"{PRESENT} AND coalesce(coalesce(__h_agent, __l_agent) <> user_agent, false) AS ua_changed", "__n_stored AS agents_window", f"{PRESENT} AND __n_stored > {cfg.max_agents} AS ua_cycling"]
    return rows.selectExpr(*[f"__along.`{n}`" if n in along else f"`{n}`" for n in names], *out, *[f"{n}_{x}" for n in stats for x in ("mean", "sd", "n")], *[f"{n}_over" for n in over])
