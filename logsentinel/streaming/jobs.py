"""Structured Streaming jobs: parsing, tumbling counts, sessions, and a sink that fans out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsentinel.sources.logs import parse_access_log, stream_logs


def parsed_stream(spark: SparkSession, folder: str, delay: str = "10 minutes") -> DataFrame:
    """Good rows of a folder of growing logs, with an event-time watermark."""
    lines = stream_logs(spark, folder).select(F.lit(None).cast("long").alias("line_no"), "value")
    good, _ = parse_access_log(lines)
    return good.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def tumbling_counts(rows: DataFrame, width: str = "1 minute") -> DataFrame:
    return rows.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors")).select("w.start", "w.end", "requests", "errors")


def live_sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "ip", "user_agent").agg(F.count("*").alias("requests")).select("w.start", "w.end", "ip", "user_agent", "requests")


def dispatch(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], checkpoint: str, counts: str | None = None):
    """Starts a query that hands each micro-batch to every sink; a failing sink doesn't keep rows from the others,
    but fails the batch at the end, so that it is repeated. With ``counts`` a row (batch, sink, attempted, delivered) for
    each sink and attempt is added to that parquet folder."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        errors, rows, n = [], [], batch.count() if counts else 0
        for name, sink in sinks.items():
            try:
                sink(batch)
                rows.append((number, name, n, n))
            except Exception as e:  # noqa: BLE001
                errors.append(f"{name}: {e}")
                rows.append((number, name, n, 0))
        if counts:
            batch.sparkSession.createDataFrame(rows, "batch long, sink string, attempted long, delivered long").coalesce(1).write.mode("append").parquet(counts)
        batch.unpersist()
        if errors:
            raise RuntimeError("; ".join(errors))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def webhook(post: Callable[[str], None]) -> Callable[[DataFrame], None]:
    """A sink that calls ``post`` with each row as JSON, in the tasks that hold the rows."""

    def sink(batch: DataFrame) -> None:
        def send(rows) -> None:
            for r in rows:
                post(r["json"])

        batch.select(F.to_json(F.struct(*batch.columns)).alias("json")).foreachPartition(send)

    return sink
