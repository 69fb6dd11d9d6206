"""Thresholds that follow time and season, their changes, and the audit of changes."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.operators import seasonal
from logsentinel.operators.aggregates import recent_percentile
from logsentinel.operators.learning import bucket
from logsentinel.operators.thresholds import MAX_CHANGE, accepts

#: Largest step of a threshold, and the confidence from which a blended threshold is taken as it is.
STEP, SURE, SENSITIVITY = 0.1, 0.95, 0.8
DAY = 86_400_000


def step_towards(old: Column, new: Column, step: Column | float) -> Column:
    """``new``, but at most ``step`` of ``old`` away from it; from 0 any step is allowed."""
    most = F.abs(old) * step
    return F.when(old == 0, new).otherwise(old + F.greatest(-most, F.least(most, new - old)))


def contextual_baselines(events: DataFrame, key: str, dim: str, least: int = 1) -> DataFrame:
    """(key, bucket, n, p95, p99, established) of each hour of the day or day of the week, over its last values."""
    rows = events.withColumn("bucket", bucket(dim))
    counts = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    return recent_percentile(rows, [key, "bucket"], "value", (0.95, 0.99)).drop("n").join(counts, [key, "bucket"]).withColumn("established", F.col("n") >= least)


def thresholds_at(events: DataFrame, at: DataFrame, key: str, overrides: DataFrame, critical: DataFrame, least: int = 30, season: int = seasonal.LEAST) -> DataFrame:
    """``at`` (key, at_ms) with ``time_threshold``, ``adaptive_threshold`` and ``dynamic_threshold``; null before ``least`` values.

    time: global and hourly p95 blended by the larger of sample and season confidence, moved by the season, one step at most.
    adaptive: an override, else the time threshold, drawn to p99 while its confidence is low, a tenth lower for a critical key.
    dynamic: an override, else p95 one step towards the hour's, times the season; half of that and half of p95 if the pattern is unsure.
    ``overrides`` has (key, threshold), ``critical`` (key); one row of a key each.
    """
    counts = events.groupBy(key).agg(F.count("*").alias("n"))
    whole = recent_percentile(events, key, "value", (0.95, 0.99)).drop("n").join(counts, key)
    hours = contextual_baselines(events, key, "hour").select(key, F.col("bucket").alias("hour"), F.col("n").alias("hour_n"), F.col("p95").alias("hour_p95"))
    rows = seasonal.at_times(events, at, key, season).withColumn("ts_ms", F.col("at_ms")).withColumn("hour", bucket("hour"))
    rows = rows.join(whole, key).join(hours, [key, "hour"], "left").join(overrides.select(key, F.col("threshold").alias("manual")), key, "left").join(critical.select(key, F.lit(True).alias("critical")), key, "left")
    c, ready = F.col, F.col("n") >= least
    own = F.coalesce("hour_p95", "p95")
    samples = F.when(c("hour_n").isNotNull(), F.least(F.lit(1.0), c("hour_n") / 2)).otherwise(0.0)
    weight = F.greatest(samples, c("time_confidence"))
    blended = ((1 - weight) * c("p95") + weight * own) * F.when(c("seasonal"), 1 + c("time_confidence") * (c("factor") - 1)).otherwise(1.0)
    rows = rows.withColumn("time_threshold", F.when(ready, step_towards(c("p95"), blended, STEP)))
    trust = 0.3 * c("confidence") + 0.7 * c("time_confidence")
    drawn = trust / SURE * SENSITIVITY
    adjusted = F.when(~c("seasonal") | (trust >= SURE), c("time_threshold")).otherwise(drawn * c("time_threshold") + (1 - drawn) * c("p99"))
    adaptive = F.coalesce("manual", adjusted * F.when(c("critical"), 0.9).otherwise(1.0))
    moved = F.when(c("hour_n").isNotNull(), step_towards(c("p95"), own, STEP)).otherwise(c("p95")) * F.when(c("seasonal"), c("factor")).otherwise(1.0)
    dynamic = F.coalesce("manual", F.when(c("confidence") < 0.5, 0.5 * moved + 0.5 * c("p95")).otherwise(moved))
    return rows.select(key, "at_ms", "n", "p95", "confidence", F.coalesce("critical", F.lit(False)).alias("critical"), "seasonal", "time_threshold", F.when(ready, adaptive).alias("adaptive_threshold"), F.when(ready, dynamic).alias("dynamic_threshold"))


def adaptations(thresholds: DataFrame, established: DataFrame, key: str, window_ms: int = DAY, least: int = 100, critical_step: float = 0.1) -> DataFrame:
    """(key, at_ms, old_threshold, new_threshold): changes of the thresholds that are due and worth an audit row.

    Due are critical keys; others once established for ``window_ms``, if their pattern is unsure or at every 2 * ``least`` values.
    """
    c = F.col
    t = thresholds.join(established.select(key, "established_ms"), key).where(c("established_ms").isNotNull())
    late = c("at_ms") - c("established_ms") >= window_ms
    due = c("critical") | (late & ((c("seasonal") & (c("confidence") < SURE * 0.8)) | ((c("n") > least) & (c("n") % (2 * least) == 0))))
    new = step_towards(c("p95"), c("time_threshold"), F.when(c("critical"), critical_step).otherwise(STEP))
    return t.where(due).select(key, "at_ms", c("p95").alias("old_threshold"), new.alias("new_threshold")).where(worth_noting(c("old_threshold"), c("new_threshold")))


def worth_noting(old: Column, new: Column) -> Column:
    return F.abs(new - old) > 0.01 * F.greatest(F.abs(old), F.lit(1.0))


def audit(events: DataFrame, key: str, span_ms: int = DAY, last: int = 1000, most: int = 100, max_change: float = MAX_CHANGE) -> DataFrame:
    """(key, ts_ms, old_threshold, new_threshold, accepted): moves of p95 over the last ``last`` values from one span to the next.

    ts_ms is the end of the span. Moves too small to note are left out, the newest ``most`` of a key stay; ``accepted`` says whether
    the move is within ``max_change`` percent (the values count either way). Values meet their spans by blocks of
    ``last`` ranks, so each span is joined with two blocks.
    """
    ranked = events.select(key, "ts_ms", "value", F.row_number().over(W.partitionBy(key).orderBy("ts_ms", "line_no")).alias("r"))
    ranked = ranked.withColumns({"span": F.floor(F.col("ts_ms") / span_ms), "block": F.floor((F.col("r") - 1) / last)})
    ends = ranked.groupBy(key, "span").agg(F.max("r").alias("upto"))
    ends = ends.withColumn("block", F.explode(F.array_distinct(F.array(F.floor((F.col("upto") - 1) / last), F.greatest(F.floor((F.col("upto") - 1) / last) - 1, F.lit(0))))))
    held = ends.join(ranked.select(key, "block", "r", "value"), [key, "block"]).where((F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - last))
    p95 = held.groupBy(key, "span").agg(F.round(F.percentile("value", 0.95), 6).alias("new_threshold"))
    moves = p95.withColumn("old_threshold", F.lag("new_threshold").over(W.partitionBy(key).orderBy("span"))).where(worth_noting(F.col("old_threshold"), F.col("new_threshold")))
    newest = moves.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("span")))).where(f"__r <= {most}")
    return newest.select(key, ((F.col("span") + 1) * span_ms).alias("ts_ms"), "old_threshold", "new_threshold", accepts(F.col("old_threshold"), F.col("new_threshold"), F.lit(max_change)).alias("accepted"))


#: Values whose percentiles a task computes at once.
RANKS = 4096


def sample_audit(events: DataFrame, key: str, last: int = 1000, least: int = 30, p: float = 0.95, max_change: float = MAX_CHANGE, span_ms: int = DAY) -> DataFrame:
    """(key, line_no, ts_ms, old_threshold, new_threshold, accepted): every single value that moves a key's p95 over its last ``last`` values.

    A move is noted if it is over a hundredth of the old value (0.01 at least) and the key had ``least`` values by then. Values are ranked in order of
    (ts_ms, line_no) by spans of time and counts of the spans before, and cut into blocks of RANKS ranks, which take along the ``last`` values before; a task slides over a block
    with a sorted window, into which it inserts a value and from which it removes the oldest.
    """
    rows = events.select(key, "ts_ms", "line_no", F.col("value").cast("double").alias("value"), F.floor(F.col("ts_ms") / span_ms).alias("__span"))
    per = rows.groupBy(key, "__span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.row_number().over(W.partitionBy(key, "__span").orderBy("ts_ms", "line_no")) - 1
    ranked = rows.join(per.select(key, "__span", before.alias("before")), [key, "__span"]).withColumn("r", rank)
    block = F.floor(F.col("r") / RANKS)
    if last > RANKS:
        raise ValueError("a block must be at least as long as the values kept")
    near = F.pmod("r", F.lit(RANKS)) >= RANKS - last
    places = F.array(block, F.when(near, block + 1))
    dealt = ranked.select(key, "ts_ms", "line_no", "value", "r", F.explode(F.array_compact(places)).alias("__block"))
    schema = f"{key} {events.schema[key].dataType.simpleString()}, line_no long, ts_ms long, old_threshold double, new_threshold double"

    def slide(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        ranks, values = table["r"].to_numpy(), table["value"].to_numpy().tolist()
        window, at, old, new, before_now = [], [], [], [], 0.0
        begin = group[1].as_py() * RANKS
        for i, x in enumerate(values):
            if len(window) >= last:
                del window[bisect_left(window, values[i - last])]
            insort(window, x)
            place = p * (len(window) - 1)
            low = int(place)
            now = window[low] + (place - low) * (window[min(low + 1, len(window) - 1)] - window[low])
            if ranks[i] >= begin and ranks[i] + 1 >= max(least, 2) and abs(now - before_now) > max(0.01 * abs(before_now), 0.01):
                at.append(i)
                old.append(before_now)
                new.append(now)
            before_now = now
        return table.take(pa.array(at, pa.int64())).select([key, "line_no", "ts_ms"]).append_column("old_threshold", pa.array(old, pa.float64())).append_column("new_threshold", pa.array(new, pa.float64()))

    moves = dealt.where("value IS NOT NULL").groupBy(key, "__block").applyInArrow(slide, schema)
    return moves.withColumn("accepted", accepts(F.col("old_threshold"), F.col("new_threshold"), F.lit(max_change)))


def audit_since(rows: DataFrame, since_ms: int) -> DataFrame:
    return rows.where(F.col("ts_ms") >= since_ms)


def current_overrides(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Overrides in force: of each key's entries (…, ts_ms, threshold, operator_id) the newest, gone if its threshold is null (cleared)."""
    newest = ledger.groupBy(*keys).agg(F.max_by(F.struct("threshold", "operator_id", "ts_ms"), "ts_ms").alias("o"))
    return newest.select(*keys, "o.*").where("threshold IS NOT NULL")


def cleared(ledger: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts_ms, old_threshold, new_threshold, operator_id): an audit row for each cleared override: from it to the learned p95."""
    before = F.lag("threshold").over(W.partitionBy(*keys).orderBy("ts_ms"))
    gone = ledger.withColumn("old_threshold", before).where("threshold IS NULL AND old_threshold IS NOT NULL")
    return gone.join(thresholds.select(*keys, F.col("p95").alias("new_threshold")), keys, "left").select(*keys, "ts_ms", "old_threshold", "new_threshold", "operator_id")


def confidence_interval(baselines: DataFrame, confidence: float = 0.95, kept: int = 1000) -> DataFrame:
    """Adds ``low`` and ``high`` around ``ewma_mean``: three deviations below three values, else a critical value times the standard error.

    The critical value is Student's up to 30 values (a coarse table) and the normal one beyond.
    """
    k = F.least(F.col("n"), F.lit(kept))
    # fixed values: critical values of the normal and of Student's distribution
    normal = next((v for c, v in ((0.99, 2.576), (0.95, 1.96), (0.90, 1.645), (0.80, 1.282)) if confidence >= c), 1.0)
    table = next((t for c, t in ((0.95, (2.228, 2.086, 2.042)), (0.90, (1.812, 1.725, 1.697))) if confidence >= c), (1.0, 1.0, 1.0))
    student = F.when(k - 1 <= 10, table[0]).when(k - 1 <= 20, table[1]).otherwise(table[2])
    sd = F.sqrt("ewma_var")
    margin = F.when(F.col("n") < 3, 3 * sd).otherwise(F.when(k > 30, normal).otherwise(student) * sd / F.sqrt(k))
    return baselines.withColumns({"low": F.col("ewma_mean") - margin, "high": F.col("ewma_mean") + margin})
