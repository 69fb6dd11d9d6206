"""Detection on a stream: the enrichment and rules of the tables, with the state of addresses and paths kept between batches.

Rows may come late. An address holds its rows until the watermark has passed them and then takes them in order of (ts_ms, line_no), so what
comes out is what the tables give, whatever the order of arrival within the watermark's delay; a row that comes later than that is
dropped by Spark and counted (``dropped_rows``); Spark drops by the watermark of the batch before, which has emitted nothing newer.

State of an address: what is pending, its windows, held counts and moments, the paths seen, the user agents stored, and its open
sessions. A timer closes a session when its gap has passed and forgets the address when nothing came for ``ttl_ms``
of event time. State of a path: its moments. The state store must have column families (the RocksDB provider).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logsentinel.config import Config
from logsentinel.functions import scalars as S
from logsentinel.operators.enrich import ua_flags, zscores
from logsentinel.operators.rules import candidates
from logsentinel.operators.sessions import LAST

READ = ["line_no", "ts_ms", "ip", "path", "method", "status", "request_time_s", "bytes_sent", "user_agent"]
STATS = ("time", "bytes", "error", "vol")
COUNTS = ("failed", "html", "asset")
LONGS = ["ip_req_window", "ip_failed_window", "html_window", "asset_window", "agents_window"]
FLAGS = ["is_first", "is_path_new", "ua_changed", "ua_cycling"]
SESSION = ["session_req_window", "session_requests", "session_paths", "session_agents", "session_4xx", "session_5xx", "session_failed"]
SESSION_MEANS = ["session_duration_s", "session_gap_s", "session_post_get", "session_bytes_mean", "session_time_mean"]


class Moments:
    """Count, mean and sum of squares of deviations of values that come one by one."""

    def __init__(self, n: int = 0, mean: float = 0.0, square: float = 0.0):
        self.n, self.mean, self.square = n, mean, square

    def add(self, x: float | None) -> tuple[float | None, float, int]:
        if x is not None:
            self.n += 1
            off = x - self.mean
            self.mean += off / self.n
            self.square += off * (x - self.mean)
        return (self.mean if self.n else None, (self.square / (self.n - 1)) ** 0.5 if self.n > 1 else 0.0, self.n)


def _plain(x):
    """A value of a pandas row as Python has it; what is missing is None."""
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x


class _Address(StatefulProcessor):
    def __init__(self, cfg: Config, schema: T.StructType, names: list[str], ttl_ms: int):
        self.cfg, self.schema, self.names, self.ttl = cfg, schema, names, ttl_ms
        self.at = {n: i for i, n in enumerate(f.name for f in schema.fields)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)
        self.core = handle.getValueState("core", "newest long, failed long, html long, asset long, agent string, paths long, " + ", ".join(f"n{i} long, m{i} double, s{i} double" for i in range(len(STATS))))
        self.recent = handle.getListState("recent", "ts long, failed boolean, html boolean, asset boolean")
        self.agents = handle.getMapState("agents", "agent string", "ts long")
        self.paths = handle.getMapState("paths", "path string", "seen boolean")
        self.sessions = handle.getMapState("sessions", "agent string", "no long, start long, last long, requests long, paths long, c4 long, c5 long, failed long, gets long, posts long, bytes double, sized long, seconds double, timed long, times string")
        self.visited = handle.getMapState("visited", "agent string, no long, path string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            got = [tuple(_plain(x) for x in r) for r in part[list(self.at)].itertuples(index=False, name=None)]
            if got:
                self.pending.appendList(got)
                least = min(r[self.at["ts_ms"]] for r in got)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentWatermarkInMs(), self.at
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        due = sorted((r for r in held if r[at["ts_ms"]] < now), key=lambda r: (r[at["ts_ms"]], r[at["line_no"]]))
        rest = [r for r in held if r[at["ts_ms"]] >= now]
        if due:
            if rest:
                self.pending.put(rest)
                self.handle.registerTimer(min(r[at["ts_ms"]] for r in rest) + 1)
            else:
                self.pending.clear()
            yield pd.DataFrame(list(self._taken(due)), columns=self.names)
        self._close(now, bool(rest))

    def _taken(self, due: list[tuple]) -> Iterator[tuple]:
        """The rows with what the state says at each of them."""
        cfg, at = self.cfg, self.at
        fresh = not self.core.exists()
        core = list(self.core.get()) if not fresh else [0, 0, 0, 0, None, 0] + [0, 0.0, 0.0] * len(STATS)
        held, agent, stored_paths = dict(zip(COUNTS, core[1:4], strict=True)), core[4], core[5]
        moments = [Moments(*core[6 + 3 * i : 9 + 3 * i]) for i in range(len(STATS))]
        recent = deque(tuple(r) for r in self.recent.get()) if self.recent.exists() else deque()
        counts = {"failed": sum(r[1] for r in recent), "html": sum(r[2] for r in recent), "asset": sum(r[3] for r in recent)}
        agents = {k[0]: v[0] for k, v in self.agents.iterator()}
        before, newest = dict(agents), core[0]
        for r in due:
            line, ts, path, method, status, seconds, sent, ua, kind = (r[at[c]] for c in ("line_no", "ts_ms", "path", "method", "status", "request_time_s", "bytes_sent", "user_agent", "request_type"))
            newest = max(newest, ts)
            while recent and recent[0][0] < ts - cfg.window_ms:
                old = recent.popleft()
                for i, c in enumerate(COUNTS):
                    counts[c] -= old[i + 1]
            flags = (status in cfg.failed_codes, kind == "HTML", kind == "ASSET")
            recent.append((ts, *flags))
            for c, f in zip(COUNTS, flags, strict=True):
                counts[c] += f
                if f:
                    held[c] = self._capped(counts[c])
            requests = self._capped(len(recent))
            new = not self.paths.containsKey((path,))
            if new and stored_paths < cfg.max_paths:
                self.paths.updateValue((path,), (True,))
                stored_paths += 1
            there = ua not in (None, "", "-")
            changed = there and agent is not None and agent != ua
            agents = {a: t for a, t in agents.items() if t >= ts - cfg.window_ms}
            if there:
                agent = ua
                agents.setdefault(ua, ts)
            error = 1.0 if status is not None and 400 <= status < 600 else 0.0
            stats = [x for m, v in zip(moments, (seconds, sent, error, requests), strict=True) for x in m.add(None if v is None else float(v))]
            ratio = held["asset"] / held["html"] if held["html"] else None
            session = self._session(ua or "", ts, path, method, status, seconds, sent)
            yield (*r, requests, held["failed"], held["html"], held["asset"], len(agents), fresh, new, changed, there and len(agents) > cfg.max_agents, ratio, *stats, *session)
            fresh = False
        self.core.update((newest, held["failed"], held["html"], held["asset"], agent, stored_paths, *[x for m in moments for x in (m.n, m.mean, m.square)]))
        self.recent.put(list(recent))
        for a in before.keys() - agents.keys():
            self.agents.removeKey((a,))
        for a, t in agents.items():
            if before.get(a) != t:
                self.agents.updateValue((a,), (t,))

    def _capped(self, n: int) -> int:
        return n if self.cfg.window_cap is None else min(n, self.cfg.window_cap)

    def _session(self, agent: str, ts: int, path, method, status, seconds, sent) -> tuple:
        cfg = self.cfg
        old = tuple(self.sessions.getValue((agent,))) if self.sessions.containsKey((agent,)) else None
        if old is None or ts - old[2] > cfg.session_gap_s * 1000:
            if old is not None:
                self._forget(agent, old[0])
            old = ((old[0] if old else 0) + 1, ts, ts, 0, 0, 0, 0, 0, 0, 0, 0.0, 0, 0.0, 0, "")
        no, start, last, requests, paths, c4, c5, failed, gets, posts, size, sized, time, timed, times = old
        if not self.visited.containsKey((agent, no, path)):
            self.visited.updateValue((agent, no, path), (True,))
            paths += 1
        all_times = [int(t) for t in times.split(",") if t] + [ts]
        inside = sum(t >= ts - cfg.window_ms for t in all_times)
        keep = max(LAST, inside)
        requests, last = requests + 1, max(last, ts)
        c4, c5, failed = c4 + (status is not None and 400 <= status <= 499), c5 + (status is not None and 500 <= status <= 599), failed + (status in cfg.failed_codes)
        gets, posts = gets + (method == "GET"), posts + (method == "POST")
        size, sized = (size + sent, sized + 1) if sent is not None else (size, sized)
        time, timed = (time + seconds, timed + 1) if seconds is not None else (time, timed)
        gaps = all_times[-LAST:]
        self.sessions.updateValue((agent,), (no, start, last, requests, paths, c4, c5, failed, gets, posts, float(size), sized, float(time), timed, ",".join(map(str, all_times[-keep:]))))
        self.handle.registerTimer(last + cfg.session_gap_s * 1000 + 1)
        return (no, inside, requests, paths, 1, c4, c5, failed, (ts - start) / 1000.0, (ts - gaps[0]) / 1000.0 / (len(gaps) - 1) if len(gaps) > 1 else None, posts / gets if gets else 0.0, size / sized if sized else None, time / timed if timed else None)

    def _forget(self, agent: str, no: int) -> None:
        """A session's paths, once it is over."""
        for k in [tuple(k) for k, _ in self.visited.iterator()]:
            if k[0] == agent and k[1] == no:
                self.visited.removeKey(k)

    def _close(self, now: int, waiting: bool) -> None:
        """Empties sessions that are over (their number stays), and everything once the address is forgotten."""
        if not self.core.exists():
            return
        newest = self.core.get()[0]
        if newest + self.ttl < now and not waiting:
            for state in (self.core, self.recent, self.agents, self.paths, self.sessions, self.visited, self.pending):
                state.clear()
            return
        for k, v in [(tuple(k), tuple(v)) for k, v in self.sessions.iterator()]:
            if v[2] + self.cfg.session_gap_s * 1000 < now and v[14]:
                self._forget(k[0], v[0])
                self.sessions.updateValue(k, (*v[:14], ""))
        self.handle.registerTimer(max(newest + self.ttl, now) + 1)

    def close(self) -> None:
        pass


class _Path(StatefulProcessor):
    """Running moments of a path. A batch has the rows of one span of event time, so they are taken in order."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.core = handle.getValueState("core", ", ".join(f"n{i} long, m{i} double, s{i} double" for i in range(3)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        core = list(self.core.get()) if self.core.exists() else [0, 0.0, 0.0] * 3
        moments = [Moments(*core[3 * i : 3 * i + 3]) for i in range(3)]
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "line_no"], kind="stable")
        stats = []
        for seconds, sent, status in zip(batch["request_time_s"], batch["bytes_sent"], batch["status"], strict=True):
            values = (_plain(seconds), _plain(sent), 1.0 if 400 <= status < 600 else 0.0)
            stats.append([x for m, v in zip(moments, values, strict=True) for x in m.add(None if v is None else float(v))])
        self.core.update(tuple(x for m in moments for x in (m.n, m.mean, m.square)))
        for i, name in enumerate(f"path_{s}_{x}" for s in STATS[:3] for x in ("mean", "sd", "n")):
            batch[name] = [s[i] for s in stats]
        yield batch[self.names]

    def close(self) -> None:
        pass


def _stats_fields(key: str, stats: tuple[str, ...]) -> list[T.StructField]:
    return [T.StructField(f"{key}_{s}_{x}", T.LongType() if x == "n" else T.DoubleType()) for s in stats for x in ("mean", "sd", "n")]


def live_enrich(rows: DataFrame, cfg: Config = Config(), ttl_ms: int = 604_800_000) -> DataFrame:
    """The columns of ``enrich.enrich`` and of ``sessions.running_sessions`` (key: address and user agent) for a stream of log rows.

    ``rows`` have a watermark on a timestamp column; line_no is unique, and ts_ms, ip, path and status are not null.
    """
    typed = ua_flags(rows.withColumn("request_type", S.request_type(F.col("path"), cfg)), cfg)
    kept = typed.select(*READ, *[c for c in typed.columns if c not in READ and typed.schema[c].dataType != T.TimestampType()], *[c for c in typed.columns if typed.schema[c].dataType == T.TimestampType()])
    own = T.StructType([T.StructField(f.name, f.dataType) for f in kept.schema.fields if f.dataType != T.TimestampType()])
    more = [*[T.StructField(n, T.LongType()) for n in LONGS], *[T.StructField(n, T.BooleanType()) for n in FLAGS], T.StructField("asset_ratio", T.DoubleType()), *_stats_fields("ip", STATS), T.StructField("session_no", T.LongType()), *[T.StructField(n, T.LongType()) for n in SESSION], *[T.StructField(n, T.DoubleType()) for n in SESSION_MEANS]]
    schema = T.StructType([*own.fields, *more])
    first = kept.groupBy("ip").transformWithStateInPandas(_Address(cfg, own, schema.names, ttl_ms), schema, "Append", "EventTime")
    scored = zscores(first, "ip", cfg)
    full = T.StructType([*scored.schema.fields, *_stats_fields("path", STATS[:3])])
    return zscores(scored.groupBy("path").transformWithStateInPandas(_Path(full.names), full, "Append", "None"), "path", cfg)


def live_alerts(rows: DataFrame, cfg: Config = Config(), tiers: tuple[int, ...] = (1, 2), ttl_ms: int = 604_800_000) -> DataFrame:
    """(line_no, ts_ms, ip, rule, tier, action, score, reason, key): the alerts of all rules and session rules for a stream of log rows."""
    found = F.explode(candidates(cfg, tiers, sessions=True)).alias("a")
    return live_enrich(rows, cfg, ttl_ms).select("line_no", "ts_ms", "ip", found).select("line_no", "ts_ms", "ip", "a.*")


def dropped_rows(query) -> int:
    """Rows that a query has dropped as later than its watermark, as far as its recent progress goes back."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
