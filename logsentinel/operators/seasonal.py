"""Seasonal patterns as tables: spectra, stability, confidence, expected values and factors at given times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.operators.learning import BUCKETS, bucket, seasonal_pattern

#: Dominant frequencies of each dimension, and the dimension's part of the confidence.
DOMINANT, SHARE = {"hour": 3, "day": 2, "week": 2}, {"hour": 0.6, "day": 0.3, "week": 0.1}
LEAST = 100


def spectrum(pattern: DataFrame, key: str, size: int) -> DataFrame:
    """Mean real and imaginary part, magnitude and phase of each frequency; where the magnitude is next to 0 the phase is 0."""
    angle = F.lit(2 * math.pi / size) * F.col("k") * F.col("bucket")
    long = pattern.select(key, "bucket", "pattern", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    s = long.groupBy(key, "k").agg((F.sum(F.col("pattern") * F.cos(angle)) / size).alias("re"), (F.sum(-F.col("pattern") * F.sin(angle)) / size).alias("im"))
    size_of = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return s.select(key, "k", "re", "im", size_of.alias("magnitude"), F.when(size_of < 1e-9, 0.0).otherwise(F.atan2("im", "re")).alias("phase"))


def stability(spectra: DataFrame, key: str, size: int, most: int) -> DataFrame:
    """Of each key the share of the dominant frequencies' magnitudes in all magnitudes (the constant included)."""
    able = F.col("k").between(1, size // 2 - 1)
    ranked = spectra.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.when(able, F.round("magnitude", 9))), "k")))
    total, strong = F.sum("magnitude"), F.sum(F.when(able & (F.col("__r") <= most), F.col("magnitude")).otherwise(0.0))
    return ranked.groupBy(key).agg(F.when(total > 0, strong / total).otherwise(0.0).alias("stability"))


def patterns(events: DataFrame, key: str, least: int = LEAST) -> dict[str, DataFrame]:
    return {dim: seasonal_pattern(events, key, dim, least) for dim in BUCKETS}


def confidence(events: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """(key, n, hour_stability, day_stability, week_stability, confidence) of the keys that have a pattern."""
    out = events.groupBy(key).agg(F.least(F.count("value"), F.lit(2 * least)).alias("n")).where(F.col("n") >= least)
    blend: Column = F.lit(0.0)
    for dim, pattern in patterns(events, key, least).items():
        of = stability(spectrum(pattern, key, BUCKETS[dim]), key, BUCKETS[dim], DOMINANT[dim])
        out = out.join(of.withColumnRenamed("stability", f"{dim}_stability"), key)
        blend = blend + SHARE[dim] * F.col(f"{dim}_stability")
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / (2.0 * least)) * (0.7 + 0.3 * blend))


def expected(events: DataFrame, at: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """(key, at_ms, expected): the hourly pattern rebuilt from its constant and first four frequencies, at least 0.1; 1 without a pattern.

    Frequencies of a tenth of the constant or less are left out.
    """
    s = spectrum(seasonal_pattern(events, key, "hour", least), key, 24).where("k < 5")
    base = F.max(F.when(F.col("k") == 0, F.col("magnitude"))).over(W.partitionBy(key))
    rows = at.withColumn("ts_ms", F.col("at_ms")).select(key, "at_ms", bucket("hour").alias("hour")).join(s.withColumn("base", base), key, "left")
    wave = F.when((F.col("k") > 0) & (F.col("magnitude") > 0.1 * F.col("base")), 2 * F.col("magnitude") * F.cos(2 * math.pi / 24 * F.col("k") * F.col("hour") + F.col("phase")))
    total = F.sum(F.when(F.col("k") == 0, F.col("re")).otherwise(F.coalesce(wave, F.lit(0.0))))
    return rows.groupBy(key, "at_ms").agg(F.coalesce(F.greatest(F.lit(0.1), total), F.lit(1.0)).alias("expected"))


def at_times(events: DataFrame, at: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """``at`` (key, at_ms) with ``seasonal`` (has a pattern), ``factor``, ``time_confidence`` and ``confidence``.

    The factor blends the buckets of the hour, day and week by the stability of each dimension; hour and day count by
    the confidence of their bucket. Without a pattern the factor is 1 and both confidences are 0.
    """
    rows = at.withColumn("ts_ms", F.col("at_ms")).select(key, "at_ms", *[bucket(d).alias(d) for d in BUCKETS])
    for dim, pattern in patterns(events, key, least).items():
        mean = F.avg("pattern").over(W.partitionBy(key)) if dim != "hour" else F.lit(1.0)
        p = pattern.select(key, F.col("bucket").alias(dim), F.when(mean > 0, F.col("pattern") / mean).otherwise(1.0).alias(f"{dim}_value"), F.col("confidence").alias(f"{dim}_sure"))
        rows = rows.join(p, [key, dim], "left")
    rows = rows.join(confidence(events, key, least), key, "left")
    c, there = F.col, F.col("confidence").isNotNull()
    blended = {d: c(f"{d}_sure") * c(f"{d}_value") + (1 - c(f"{d}_sure")) for d in ("hour", "day")} | {"week": F.coalesce(c("week_value"), F.lit(1.0))}
    total = sum((c(f"{d}_stability") for d in BUCKETS), F.lit(0.0))
    usual = {"hour": 0.7, "day": 0.2, "week": 0.1}
    factor = sum((F.when(total < 0.1, usual[d]).otherwise(c(f"{d}_stability") / total) * blended[d] for d in BUCKETS), F.lit(0.0))
    sure = (0.7 * c("hour_sure") + 0.3 * c("day_sure")) * c("confidence")
    return rows.select(key, "at_ms", there.alias("seasonal"), F.when(there, factor).otherwise(1.0).alias("factor"), F.when(there, sure).otherwise(0.0).alias("time_confidence"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def simple_seasonal(events: DataFrame, key: str, dim: str, rate: float = 0.05, sensitivity: float = 0.1) -> DataFrame:
    """(key, bucket, n, mean, sd, threshold, confidence) of an average that begins at 0, for hours, days or weeks of the year.

    The fold begins where older values have less weight than a double can hold.
    """
    last = math.ceil(math.log(1e-17) / math.log(1 - rate)) + 1
    days = F.date_from_unix_date(F.floor(F.col("ts_ms") / 86_400_000).cast("int"))
    of = F.floor((F.dayofyear(days) - 1) / 7).cast("int") if dim == "year_week" else bucket(dim)
    rows = events.withColumn("bucket", of)
    r = rows.withColumn("__r", F.row_number().over(W.partitionBy(key, "bucket").orderBy(F.desc("ts_ms"), F.desc("line_no")))).where(f"__r <= {last}")
    values = r.groupBy(key, "bucket").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "line_no", "value"))).alias("v"))
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))
    step = lambda a, x: F.struct((a["m"] + rate * (x["value"] - a["m"])).alias("m"), ((1 - rate) * a["s"] + rate * (x["value"] - a["m"]) * (x["value"] - a["m"])).alias("s"))
    counts = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    f = values.select(key, "bucket", F.aggregate("v", zero, step).alias("f")).join(counts, [key, "bucket"])
    return f.select(key, "bucket", "n", F.col("f.m").alias("mean"), F.sqrt("f.s").alias("sd"), (F.col("f.m") + sensitivity * F.sqrt("f.s")).alias("threshold"), F.least(F.lit(1.0), F.col("n") / 10).alias("confidence"))
