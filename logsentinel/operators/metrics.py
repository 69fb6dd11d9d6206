"""Metric series: counters, gauges, histograms, rates, quantiles, trends and alert rules with a hold time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.functions.scalars import fixed

HOUR = 3_600_000


def hourly_counter(df: DataFrame, label: str) -> DataFrame:
    """(label, bucket, value): a counter that grows by the rows of each hour that has any."""
    per = df.groupBy(label, F.floor(F.col("ts_ms") / HOUR).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    w = W.partitionBy(label).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per.select(label, "bucket", F.sum("n").over(w).alias("value"))


def increase(counter: DataFrame, label: str, buckets: int) -> DataFrame:
    """Growth of a counter over the last ``buckets`` hours; a fall counts as a reset to 0."""
    w = W.partitionBy(label).orderBy("bucket")
    step = F.col("value") - F.lag("value").over(w)
    grown = counter.withColumn("step", F.coalesce(F.when(step < 0, F.col("value")).otherwise(step), F.lit(0)))
    return grown.select(label, "bucket", F.sum("step").over(w.rangeBetween(-buckets + 1, 0)).cast("long").alias("increase"))


def histogram(df: DataFrame, label: str, col: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets (value <= bound), the last one for all values; le as text."""
    les = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f"{b:g}").alias("le"), F.count_if(F.col(col) <= b).alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(len(bounds)).alias("pos"), F.lit("+Inf").alias("le"), F.count(col).alias("n")))
    return df.groupBy(label).agg(les.alias("h")).select(label, F.explode("h").alias("b")).select(label, "b.pos", "b.le", "b.n")


def histogram_quantile(hist: DataFrame, label: str, q: float) -> DataFrame:
    """The quantile, linear inside its bucket; the last finite bound if it lies beyond."""
    w = W.partitionBy(label)
    h = hist.withColumn("total", F.max("n").over(w)).withColumn("bound", F.col("le").try_cast("double")).withColumn("low_n", F.coalesce(F.lag("n").over(w.orderBy("pos")), F.lit(0))).withColumn("low", F.coalesce(F.lag(F.col("le").try_cast("double")).over(w.orderBy("pos")), F.lit(0.0)))
    rank = F.lit(q) * F.col("total")
    value = F.when(F.col("le") == "+Inf", F.col("low")).when(F.col("n") == F.col("low_n"), F.col("bound")).otherwise(F.col("low") + (F.col("bound") - F.col("low")) * (rank - F.col("low_n")) / (F.col("n") - F.col("low_n")))
    first = h.where(F.col("n") >= rank).withColumn("__r", F.row_number().over(w.orderBy("pos"))).where("__r = 1")
    return first.select(label, F.round(value, 6).alias("quantile"))


def trend(df: DataFrame, label: str, y: str, x: Column, ahead: float = 0.0) -> DataFrame:
    """Slope, intercept and fit of a line through a series, and its value ``ahead`` of the last point (at least 0)."""
    fit = df.groupBy(label).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.max(x).alias("last"))
    predicted = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("last") + ahead))
    return fit.select(label, F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), F.round(predicted, 4).alias("predicted"))


def changes(df: DataFrame, label: str, col: str) -> DataFrame:
    """How often a series changes its value from one row to the next."""
    w = W.partitionBy(label).orderBy("ts_ms", "line_no")
    moved = F.lag(col).over(w)
    return df.select(label, (moved.isNotNull() & (F.col(col) != moved)).alias("m")).groupBy(label).agg(F.count_if("m").alias("changes"))


def with_offset(series: DataFrame, label: str, buckets: int) -> DataFrame:
    """A series with its own value ``buckets`` ago, where there was one."""
    before = series.select(label, (F.col("bucket") + buckets).alias("bucket"), F.col("n").alias("before"))
    return series.join(before, [label, "bucket"]).select(label, "bucket", "n", "before", F.round(F.col("n") / F.col("before"), 6).alias("ratio"))


def firing(series: DataFrame, label: str, condition: Column, hold: int) -> DataFrame:
    """Runs of consecutive buckets in which ``condition`` holds, of at least ``hold`` buckets."""
    hot = series.where(condition)
    runs = hot.withColumn("run", F.col("bucket") - F.row_number().over(W.partitionBy(label).orderBy("bucket")))
    return runs.groupBy(label, "run").agg(F.min("bucket").alias("since"), F.max("bucket").alias("until"), F.count("*").alias("length")).where(F.col("length") >= hold).drop("run")


def gauge(df: DataFrame, label: str, col: str) -> DataFrame:
    """(label, value): the newest value of each label."""
    return df.groupBy(label).agg(F.max_by(col, F.struct("ts_ms", "line_no")).alias("value"))


def sum_by(df: DataFrame, labels: list[str], col: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(col).alias("total"), F.count(col).alias("n"), F.avg(col).alias("mean"))


def ratio(df: DataFrame, label: str, part: Column, whole: Column, percent: float = 100.0) -> DataFrame:
    """(label, ratio): rows with ``part`` for ``percent`` rows with ``whole``; null without such rows."""
    n = F.count_if(whole)
    return df.groupBy(label).agg(F.round(F.when(n > 0, F.count_if(part & whole) * percent / n), 6).alias("ratio"))


def active_sources(df: DataFrame, group: str, source: str, least: int = 1) -> DataFrame:
    """(group, active): sources with at least ``least`` rows in the group."""
    return df.groupBy(group, source).agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy(group).agg(F.count("*").alias("active"))


def where_labels(samples: DataFrame, **tests: str) -> DataFrame:
    """Samples (labels is a map) whose labels are equal to the given values, or match them whole if they begin with ``~``; ``!`` before either negates."""
    for name, test in tests.items():
        value, no = F.coalesce(F.col("labels")[name], F.lit("")), test.startswith("!")
        test = test.removeprefix("!")
        ok = value.rlike(f"^(?:{test[1:]})$") if test.startswith("~") else value == test
        samples = samples.where(~ok if no else ok)
    return samples


def series_and(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Samples of the left series at whose labels and time the right one has any."""
    return left.join(right.select(*on).distinct(), on, "left_semi")


def series_or(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The left series, and of the right one what the left has nothing of."""
    return left.unionByName(right.join(left.select(*on).distinct(), on, "left_anti"))


def substitute(template: Column, variables: Column) -> Column:
    """``{{name}}`` in a template replaced by a map's values."""
    return F.aggregate(F.map_entries(variables), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def alert_rules(series: DataFrame, rules: list[dict], label: str) -> DataFrame:
    """Alerts of threshold rules over a series (label, bucket, and one column for each metric).

    A rule has name, metric, comparison (``>``, ``<``), threshold, hold (buckets), severity and summary; in its text
    ``{{label}}`` and ``{{value}}`` (the worst value of the run) are replaced. One row for each run of buckets that is long enough.
    """
    found = [F.struct(F.lit(r["name"]).alias("name"), F.lit(r["severity"]).alias("severity"), F.lit(r["summary"]).alias("summary"), F.lit(r["hold"]).alias("hold"), F.lit(r["comparison"] == ">").alias("up"), F.col(r["metric"]).cast("double").alias("v"), (F.col(r["metric"]) > r["threshold"] if r["comparison"] == ">" else F.col(r["metric"]) < r["threshold"]).alias("hot")) for r in rules]
    hot = series.select(label, "bucket", F.explode(F.array(*found)).alias("r")).select(label, "bucket", "r.*").where("hot")
    runs = hot.withColumn("run", F.col("bucket") - F.row_number().over(W.partitionBy(label, "name").orderBy("bucket")))
    fired = runs.groupBy(label, "name", "run").agg(F.first("severity").alias("severity"), F.first("summary").alias("summary"), F.first("hold").alias("hold"), F.min("bucket").alias("since"), F.count("*").alias("length"), F.when(F.first("up"), F.max("v")).otherwise(F.min("v")).alias("value")).where(F.col("length") >= F.col("hold"))
    text = substitute(F.col("summary"), F.create_map(F.lit("label"), F.col(label), F.lit("value"), F.expr(fixed("value", 2))))
    return fired.select(label, "name", "severity", "since", "length", text.alias("summary"))


def trends(df: DataFrame, label: str, y: str, x: Column, spans: dict[str, float], ahead: float, steep: float = 0.0, sure: float = 0.8) -> DataFrame:
    """The best fitting trend of each label over several spans up to its newest point.

    (label, span, slope, intercept, r2, predicted, growing, direction): the span with the largest r2; growing where the slope is
    over ``steep`` and r2 over ``sure``; direction 1, 0 or -1 by the slope.
    """
    rows = df.select(label, F.col(y).cast("double").alias("y"), x.cast("double").alias("x"))
    last = rows.groupBy(label).agg(F.max("x").alias("last"))
    near = rows.join(last, label).select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.lit(float(w)).alias("width")) for n, w in spans.items()])).alias("s")).where("x > last - s.width")
    fit = near.groupBy(label, "s.span").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.max("last").alias("last")).where("r2 IS NOT NULL")
    best = fit.withColumn("__r", F.row_number().over(W.partitionBy(label).orderBy(F.desc(F.round("r2", 6)), "span"))).where("__r = 1")
    c = F.col
    return best.select(label, "span", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), F.round(F.greatest(F.lit(0.0), c("intercept") + c("slope") * (c("last") + ahead)), 4).alias("predicted"), ((c("slope") > steep) & (c("r2") > sure)).alias("growing"), F.signum(F.round("slope", 6)).cast("int").alias("direction"))


def render(counters: DataFrame, histograms: DataFrame, help_texts: dict[str, str]) -> DataFrame:
    """(metric, line_no, line): the text form of counters (metric, label, text, value) and of cumulative histograms (metric, label, text, pos, le, n, total).

    A histogram ends with its sum and count; numbers have six digits. Lines of a metric are in order of labels.
    """
    c = F.col
    labels = lambda *more: F.concat(F.lit("{"), "label", F.lit('="'), "text", F.lit('"'), *more, F.lit("}"))
    plain = counters.select("metric", F.lit("counter").alias("kind"), "text", F.lit(0).alias("pos"), F.concat("metric", labels(), F.lit(" "), F.expr(fixed("value"))).alias("line"))
    bucket = histograms.select("metric", F.lit("histogram").alias("kind"), "text", "pos", F.concat("metric", F.lit("_bucket"), labels(F.lit(',le="'), c("le"), F.lit('"')), F.lit(" "), c("n").cast("string")).alias("line"))
    ends = histograms.where("le = '+Inf'").select("metric", F.lit("histogram").alias("kind"), "text", F.explode(F.array(F.struct((c("pos") + 1).alias("pos"), F.concat("metric", F.lit("_sum"), labels(), F.lit(" "), F.expr(fixed("total"))).alias("line")), F.struct((c("pos") + 2).alias("pos"), F.concat("metric", F.lit("_count"), labels(), F.lit(" "), c("n").cast("string")).alias("line")))).alias("e")).select("metric", "kind", "text", "e.pos", "e.line")
    body = plain.unionByName(bucket).unionByName(ends)
    known = F.create_map(*[F.lit(x) for kv in help_texts.items() for x in kv]) if help_texts else F.lit(None).cast("map<string,string>")
    heads = body.select("metric", "kind").distinct().select("metric", "kind", F.lit("").alias("text"), F.explode(F.array(F.struct(F.lit(-2).alias("pos"), F.concat(F.lit("# HELP "), "metric", F.lit(" "), F.coalesce(known[c("metric")], F.lit(""))).alias("line")), F.struct(F.lit(-1).alias("pos"), F.concat(F.lit("# TYPE "), "metric", F.lit(" "), "kind").alias("line")))).alias("e")).select("metric", "kind", "text", "e.pos", "e.line")
    ordered = F.row_number().over(W.partitionBy("metric").orderBy(F.when(c("pos") < 0, 0).otherwise(1), "text", "pos"))
    return heads.unionByName(body).select("metric", ordered.cast("long").alias("line_no"), "line")


def checked_rules(rules: DataFrame) -> DataFrame:
    """Each metric rule with ``problem``: an empty name, a repeated one, an unknown comparison, or null."""
    times = F.count("*").over(W.partitionBy("name"))
    problem = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "empty name").when(times > 1, "duplicate name").when(~F.col("comparison").isin(">", ">=", "<", "<=", "==", "!="), "Invalid comparison operator")
    return rules.withColumn("problem", problem)


def evaluate_metric_rules(values: DataFrame, rules: DataFrame, context: dict[str, str] | None = None) -> DataFrame:
    """Each rule (name, label, threshold, comparison) against the value of its label: status, triggered, score.

    With a column ``variables`` (a map) ``label`` is a template; values of ``context`` win over a rule's own.
    """
    if "variables" in rules.columns:
        given = F.create_map(*[F.lit(x) for kv in (context or {}).items() for x in kv]) if context else F.create_map().cast("map<string,string>")
        own = F.map_filter("variables", lambda k, _: ~F.map_contains_key(given, k))
        rules = rules.withColumn("label", substitute(F.col("label"), F.map_concat(own, given)))
    joined = rules.join(values, "label", "left")
    v, t = F.col("value"), F.col("threshold")
    held = F.when(F.col("comparison") == ">", v > t).when(F.col("comparison") == ">=", v >= t).when(F.col("comparison") == "<", v < t).when(F.col("comparison") == "<=", v <= t).when(F.col("comparison") == "==", v == t).when(F.col("comparison") == "!=", v != t)
    known = F.col("comparison").isin(">", ">=", "<", "<=", "==", "!=")
    status = F.when(~known, "Invalid comparison operator").when(v.isNull(), "No data").otherwise("OK")
    return joined.select("name", "label", status.alias("status"), F.coalesce(known & held, F.lit(False)).alias("triggered"), F.round(F.when(known & held, F.abs(v - t)), 6).alias("score"))
