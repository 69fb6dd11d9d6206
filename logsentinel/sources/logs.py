"""Log sources: text lines, streams, JSON documents, lists, and the view of the events table as an access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.functions import scalars as S

FIELDS = ["ip", "remote_user", "ts_str", "request_time", "upstream_time", "request", "status", "bytes", "referer", "user_agent", "host", "country", "upstream_addr", "request_id", "accept_encoding"]


def read_logs(spark: SparkSession, path: str, dense: bool = False) -> DataFrame:
    """Lines of text files, blank ones left out; ``line_no`` follows files and places in them.

    Numbers have gaps unless ``dense``: then they run from 1, by the counts of the partitions before (a small table), without a
    sort of the lines.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("id"), "value")
    if not dense:
        return lines.select(F.col("id").alias("line_no"), "value")
    part = F.shiftright("id", 33)
    counts = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("part").orderBy("id"))
    return lines.withColumn("part", part).join(F.broadcast(before.select("part", "before")), "part").select((F.col("before") + inside).alias("line_no"), "value")


def stream_logs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).where("trim(value) <> ''")


def read_json_logs(spark: SparkSession, path: str, since_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Documents of a keyed log as lines of the 15 fields, of those after ``since_ms``; with ``limit`` the oldest ones, in order of time."""
    # fixed values: the documents' keys in the order of the fields
    keys = ["host", "user", "time", "req", "ups", "url", "st", "bytes", "pr", "c", "domain", "country", "upstream", "requestid"]
    schema = ", ".join(f"`{k}` string" for k in keys)
    docs = spark.read.schema(schema).json(path)
    lines = docs.select(F.monotonically_increasing_id().alias("line_no"), F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`"), F.lit("-")) for k in keys], F.lit("-")).alias("value"), S.log_time_ms(F.col("time")).alias("ts_ms"))
    later = lines if since_ms is None else lines.where(F.col("ts_ms") > since_ms)
    return (later if limit is None else later.orderBy("ts_ms", "line_no").limit(limit)).drop("ts_ms")


def parse_access_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected lines with a reason. Both come from one expression over the lines."""
    f = {name: F.get("f", i) for i, name in enumerate(FIELDS)}
    method, path, protocol = S.request_parts(f["request"])
    rows = S.once(lines, F.col("line_no"), F.col("value"), F.split("value", r"\|", -1).alias("f"))
    rows = S.once(
        rows,
        F.col("line_no"), F.col("value").alias("raw"), F.size("f").alias("n_fields"), f["ip"].alias("ip"), f["remote_user"].alias("remote_user"), f["ts_str"].alias("ts_str"),
        S.log_time_ms(f["ts_str"]).alias("ts_ms"), method.alias("method"), S.url_decode(path).alias("path"), protocol.alias("protocol"),
        S.number(f["status"], "int").alias("status"), S.number(f["request_time"], "double").alias("request_time_s"), S.number(f["upstream_time"], "double").alias("upstream_time_s"),
        S.number(f["bytes"], "long").alias("bytes_sent"), *[f[k].alias(k) for k in FIELDS[8:]],
    )
    reason = F.when(F.col("n_fields") != 15, "field count").when(F.col("ts_ms").isNull(), "timestamp").when(F.col("status").isNull(), "status")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason", "n_fields"), rows.where("reason IS NOT NULL").select("line_no", "raw", "reason")


def read_cidr_list(spark: SparkSession, path: str) -> DataFrame:
    """(network, prefix) of a list with ``#`` comments; bad entries are left out."""
    return cidr_table(spark.read.text(path))


def load_threat_feeds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(network, prefix) of all entries of plain-text feeds, each once; a bare address is a block of one."""
    return cidr_table(spark.read.text(paths))


def cidr_table(lines: DataFrame, col: str = "value") -> DataFrame:
    text = F.trim(F.substring_index(col, "#", 1))
    network, prefix = S.cidr(text)
    return lines.where(text != "").select(network.alias("network"), prefix.alias("prefix")).where("network IS NOT NULL").distinct()


def events_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an access log."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    return e.select(
        F.col("event_id").alias("line_no"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts_ms"),
        F.concat(F.lit("10.20."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("ip"),
        F.when(kind == "click", F.concat(F.lit("/static/app"), (k % 7).cast("string"), F.lit(".js"))).when(kind == "view", F.concat(F.lit("/page"), (k % 10).cast("string"), F.lit(".html"))).when(kind == "purchase", "/api/data").when(kind == "signup", "/login").when(k % 5 == 0, "/../etc/passwd").otherwise("/admin/config").alias("path"),
        F.when(kind.isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
        F.when(kind == "error", F.when(k % 4 == 0, 500).when(k % 4 == 1, 404).when(k % 4 == 2, 401).otherwise(403)).when((kind == "signup") & (k % 3 == 0), 401).otherwise(200).alias("status"),
        (F.col("value") / 100.0).alias("request_time_s"),
        F.floor(F.col("value") * 1000).cast("long").alias("bytes_sent"),
        F.when(k % 10 == 0, "-").when(k % 10 == 1, "sqlmap/1.5").when(k % 10 == 2, "Mozilla/5.0 HeadlessChrome/99").when(k % 10 == 3, "Mozilla/5.0 (Windows) Chrome/80.0").when(k % 10 == 4, "Mozilla/5.0 (X11; Linux) Firefox/70.0").when(k % 10 == 5, "Mozilla/5.0 (Windows; Android) Chrome/120.0").otherwise("Mozilla/5.0 (Macintosh) Chrome/120.0").alias("user_agent"),
    )


def log_lines(log: DataFrame, broken_every: int = 50) -> DataFrame:
    """A log as raw lines of 15 fields; of every so many lines one is cut short."""
    when = F.date_format(F.timestamp_millis((F.floor(F.col("ts_ms") / 1000) * 1000).cast("long")), "dd/MMM/yyyy:HH:mm:ss")
    dash = F.lit("-")
    full = F.concat_ws("|", "ip", dash, F.concat(when, F.lit(" +0000")), F.col("request_time_s").cast("string"), dash, F.concat_ws(" ", "method", "path", F.lit("HTTP/1.1")), F.col("status").cast("string"), F.col("bytes_sent").cast("string"), dash, "user_agent", F.lit("example.com"), F.lit("US"), dash, F.concat(F.lit("r"), F.col("line_no").cast("string")), dash)
    return S.once(log, F.col("line_no"), F.when(F.col("line_no") % broken_every == 0, F.substring_index(full, "|", 4)).otherwise(full).alias("value"))
