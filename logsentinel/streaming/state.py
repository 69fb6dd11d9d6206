"""Stateful stream operators: windows of an address, throttling, and lists that are read anew for each batch.

They need a state store with column families (``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider). Rows of a
batch are taken in order of (ts_ms, line_no); a row older than what the state has seen counts at its own time, and is
out of the windows that have passed it. State that wasn't touched for ``ttl_ms`` goes; such a stream goes on looking for state to drop
until it is stopped, so a run over the available rows alone takes ``ttl_ms=None``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logsentinel.config import Config
from logsentinel.operators import forest


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["ts_ms", "line_no"], kind="stable")


class _Windows(StatefulProcessor):
    def __init__(self, cfg: Config, ttl_ms: int | None):
        self.cfg, self.ttl = cfg, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "ts_ms long, failed boolean", ttlDurationMs=self.ttl)
        self.held = handle.getValueState("held", "failed long, newest long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = [tuple(r) for r in self.recent.get()]
        failed, newest = tuple(self.held.get()) if self.held.exists() else (0, 0)
        out = []
        batch = _ordered(rows)
        for line, ts, status in zip(batch["line_no"], batch["ts_ms"], batch["status"], strict=True):
            newest = max(newest, int(ts))
            bad = int(status) in self.cfg.failed_codes
            recent = [r for r in recent if r[0] >= newest - self.cfg.window_ms] + [(int(ts), bad)]
            if bad:
                failed = sum(r[1] for r in recent)
            out.append((key[0], int(line), int(ts), len(recent), failed))
        self.recent.put(recent)
        self.held.update((failed, newest))
        yield pd.DataFrame(out, columns=["ip", "line_no", "ts_ms", "ip_req_window", "ip_failed_window"])

    def close(self) -> None:
        pass


def live_windows(rows: DataFrame, cfg: Config = Config(), ttl_ms: int | None = 604_800_000) -> DataFrame:
    """(ip, line_no, ts_ms, ip_req_window, ip_failed_window) of a stream of rows (line_no, ts_ms, ip, status).

    The state of an address is its requests of the last ``window_ms``.
    """
    schema = "ip string, line_no long, ts_ms long, ip_req_window long, ip_failed_window long"
    return rows.select("ip", "line_no", "ts_ms", "status").groupBy("ip").transformWithStateInPandas(_Windows(cfg, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")


class _Throttle(StatefulProcessor):
    def __init__(self, span_ms: int, most_between: int, ttl_ms: int | None):
        self.span, self.most, self.ttl = span_ms, most_between, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "reason string", "ts_ms long, recorded long", ttlDurationMs=self.ttl)
        self.recorded = handle.getValueState("recorded", "n long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recorded = self.recorded.get()[0] if self.recorded.exists() else 0
        known, changed, keep = {k[0]: tuple(v) for k, v in self.known.iterator()}, {}, []
        batch = _ordered(rows)
        for ts, reason in zip(batch["ts_ms"], batch["reason"], strict=True):
            last = known.get(reason)
            again = last is None or ts >= last[0] + self.span or bool(self.most) and recorded - last[1] >= self.most
            keep.append(again)
            if again:
                recorded += 1
                known[reason] = changed[reason] = (int(ts), recorded)
        for reason, value in changed.items():
            self.known.updateValue((reason,), value)
        self.recorded.update((recorded,))
        yield batch[keep]

    def close(self) -> None:
        pass


def live_throttle(alerts: DataFrame, seconds: int = 300, most_between: int = 0, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """The recorded alerts of a stream (ts_ms, line_no, ip, reason and others), like ``rules.throttle`` on a table."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alerts.schema.fields)
    return alerts.groupBy("ip").transformWithStateInPandas(_Throttle(seconds * 1000, most_between, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")


def with_lists(stream: DataFrame, read: Callable[[], dict[str, DataFrame]], work: Callable[..., None], checkpoint: str):
    """Starts a query that hands each micro-batch and lists read anew for it (rules, threats, allowed addresses) to ``work``."""

    def each(batch: DataFrame, _: int) -> None:
        work(batch, **read())

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_scores(features: DataFrame, models: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that scores each micro-batch of feature vectors with the model that is in force when the batch begins.

    ``sink`` gets (line_no, score, version) rows and the batch's number. A model that is published while the stream runs scores from the next batch
    on; one that was refused (``forest.publish_model``) is never pointed to, so the one before goes on.
    """

    def each(batch: DataFrame, number: int) -> None:
        version = forest.current_version(batch.sparkSession, models)
        sink(forest.score_forest(batch, forest.current_model(batch.sparkSession, models)).withColumn("version", F.lit(version).cast("long")), number)

    return features.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
