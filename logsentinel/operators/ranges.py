"""Range vectors over irregular samples, and alert rules that are rows of a table.

A range vector is taken at aligned times (multiples of ``step_ms``): what happened in the ``range_ms`` up to and including that time. Each
sample is dealt to the times whose range holds it, so a vector is one grouping with partial sums, for any number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.functions.scalars import fixed, literal


def at_times(step_ms: int, range_ms: int, ts: str = "ts_ms") -> Column:
    """The aligned times t with t - range_ms < ts <= t."""
    first = f"(ceil({ts} / {step_ms}) * {step_ms})"
    return F.expr(f"CASE WHEN {ts} + {range_ms} > {first} THEN sequence({first}, (ceil(({ts} + {range_ms}) / {step_ms}) - 1) * {step_ms}, {step_ms}L) ELSE CAST(array() AS ARRAY<BIGINT>) END")


def increases(samples: DataFrame, keys: list[str], step_ms: int, range_ms: int, order: str = "line_no") -> DataFrame:
    """(keys, at_ms, increase, rate, samples): growth of counters over ranges, from samples (keys, ts_ms, ``order``, value) that may come at any time.

    Growth is counted between samples that both lie in the range, as a counter knows nothing of what was before; a fall is a reset to 0.
    Samples of an instant come in order of ``order``. Ranges with one sample have no increase (null). Samples without a value or a time are left out.
    """
    # a path's samples are cut into blocks of time; the last one of a block is mixed into the next as a marker in front of its rows
    there = samples.where("value IS NOT NULL AND ts_ms IS NOT NULL").withColumn("__block", F.floor(F.col("ts_ms") / max(range_ms, step_ms)))
    last = there.groupBy(*keys, "__block").agg(F.max_by("value", F.struct("ts_ms", order)).alias("value"))
    markers = last.withColumn("__block", F.lead("__block").over(W.partitionBy(*keys).orderBy("__block"))).where("__block IS NOT NULL")
    mixed = there.select(*keys, "__block", "ts_ms", order, "value").unionByName(markers, allowMissingColumns=True)
    before = F.lag("value").over(W.partitionBy(*keys, "__block").orderBy("ts_ms", order))
    step = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    steps = mixed.select(*keys, "ts_ms", order, F.coalesce(step, F.lit(0)).cast("double").alias("step")).where("ts_ms IS NOT NULL")
    # samples that lie in the same ranges become one row before they are dealt out
    ends = [F.ceil(F.col("ts_ms") / step_ms).alias("__from"), F.ceil((F.col("ts_ms") + range_ms) / step_ms).alias("__to")]
    cells = steps.select("*", *ends).groupBy(*keys, "__from", "__to").agg(F.count("*").alias("n"), F.sum("step").alias("all"), F.min(F.struct("ts_ms", order, "step")).alias("first"))
    grown = cells.select("*", F.explode(at_times(step_ms, range_ms, "first.ts_ms")).alias("at_ms"))
    inside = F.sum("all") - F.min("first")["step"]  # the first sample's growth began outside
    out = grown.groupBy(*keys, "at_ms").agg(F.sum("n").alias("samples"), F.when(F.sum("n") > 1, inside).alias("increase"))
    return out.select(*keys, "at_ms", "increase", (F.col("increase") / (range_ms / 1000.0)).alias("rate"), "samples")


# --- rules
#
# An expression is a number, or a tuple: ("rate" | "increase", metric, range_ms) over all labels, ("sources", metric, range_ms, least rate) counts the labels
# whose rate is over the least one, ("quantile", q, metric, range_ms) of a metric whose label is the upper bound of a bucket, each event in all
# buckets that hold it, and ("+" | "-" | "*" | "/", left, right).
LEAVES = {"rate": 2, "increase": 2, "sources": 2, "quantile": 3}


def leaves(expression) -> list[tuple]:
    if not isinstance(expression, tuple):
        return []
    return [expression] if expression[0] in LEAVES else [x for e in expression[1:] for x in leaves(e)]


def _leaf(leaf: tuple) -> str:
    """SQL aggregate of a leaf over the rows (metric, label, range_ms, inc) of one time."""
    span, metric = (leaf[2], leaf[1]) if leaf[0] != "quantile" else (leaf[3], leaf[2])
    mine = f"range_ms = {span} AND metric = {literal(metric)}"
    if leaf[0] == "sources":
        return f"count_if({mine} AND inc / {span / 1000.0}D > {leaf[3]}D)"
    if leaf[0] == "quantile":
        buckets = f"array_sort(collect_list(CASE WHEN {mine} THEN named_struct('le', CAST(replace(label, '+Inf', 'Infinity') AS DOUBLE), 'n', inc) END))"
        ranked = f"transform({buckets}, (b, i) -> named_struct('b', b, 'low', CASE WHEN i > 0 THEN {buckets}[i - 1].le ELSE 0.0D END, 'before', CASE WHEN i > 0 THEN {buckets}[i - 1].n ELSE 0.0D END))"
        wanted = f"({leaf[1]}D * array_max(transform({buckets}, b -> b.n)))"
        hit = f"filter({ranked}, x -> x.b.n >= {wanted} AND x.b.n > 0)[0]"
        return f"transform(array({hit}), x -> CASE WHEN x.b.le = double('Infinity') THEN x.low ELSE x.low + (x.b.le - x.low) * ({wanted} - x.before) / (x.b.n - x.before) END)[0]"
    total = f"sum(CASE WHEN {mine} THEN inc ELSE 0.0D END)"
    return f"{total} / {span / 1000.0}D" if leaf[0] == "rate" else total


def _sql(expression, names: dict[tuple, str]) -> str:
    if not isinstance(expression, tuple):
        return f"{float(expression)}D"
    if expression in names:
        return names[expression]
    left, right = (_sql(e, names) for e in expression[1:])
    return f"({left} {expression[0]} {right})" if expression[0] != "/" else f"({left} / nullif({right}, 0.0D))"


def rule_alerts(increments: DataFrame, rules: list[dict], step_ms: int, label: str = "label") -> DataFrame:
    """(name, severity, since_ms, until_ms, value, summary): what a table of rules fires over increments (metric, label, ts_ms, value) of counters.

    A rule has name, expression, comparison, threshold, hold_ms, severity and summary, in whose text ``{{value}}`` (the value at the last time of the
    run) is replaced. All expressions are compiled to one plan: increments are dealt once to the times of each range in use, grouped once by metric
    and label, and once by time. Rules are looked at at every time from the first to the last increment; a rule fires for each run of times in which it holds, if the run
    lasts ``hold_ms``. A value that can't be computed (a division by 0, an empty quantile) holds for no rule.
    """
    every = sorted({x for r in rules for x in leaves(r["expression"])}, key=repr)
    names = {x: f"__leaf{i}" for i, x in enumerate(every)}
    spans = sorted({x[LEAVES[x[0]]] for x in every})
    dealt = [increments.select("metric", F.col(label).alias("label"), F.lit(s).alias("range_ms"), F.col("value").cast("double").alias("value"), at_times(step_ms, s).alias("times")) for s in spans]
    rows = dealt[0]
    for d in dealt[1:]:
        rows = rows.unionByName(d)
    vectors = rows.select("metric", "label", "range_ms", "value", F.explode("times").alias("at_ms")).groupBy("at_ms", "metric", "label", "range_ms").agg(F.sum("value").alias("inc"))
    ends = increments.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).where("a IS NOT NULL")
    grid = ends.select(F.explode(F.expr(f"sequence(CAST(ceil(a / {step_ms}) * {step_ms} AS BIGINT), CAST(ceil(b / {step_ms}) * {step_ms} AS BIGINT), {step_ms}L)")).alias("at_ms"))
    wide = grid.join(vectors, "at_ms", "left").groupBy("at_ms").agg(*[F.expr(f"{_leaf(x)} AS {n}") for x, n in names.items()])
    tests = [f"named_struct('name', {literal(r['name'])}, 'severity', {literal(r['severity'])}, 'hold_ms', {r['hold_ms']}L, 'summary', {literal(r['summary'])}, 'value', {_sql(r['expression'], names)}, 'hot', coalesce({_sql(r['expression'], names)} {r['comparison']} {float(r['threshold'])}D, false))" for r in rules]
    hot = wide.select("at_ms", F.expr(f"inline(array({', '.join(tests)}))")).where("hot")
    runs = hot.withColumn("run", F.col("at_ms") - F.lit(step_ms).cast("long") * F.row_number().over(W.partitionBy("name").orderBy("at_ms")))
    fired = runs.groupBy("name", "severity", "hold_ms", "summary", "run").agg(F.min("at_ms").alias("since_ms"), F.max("at_ms").alias("until_ms"), F.max_by("value", "at_ms").alias("value")).where("until_ms - since_ms >= hold_ms")
    return fired.select("name", "severity", "since_ms", "until_ms", "value", F.replace("summary", F.lit("{{value}}"), F.expr(fixed("round(value, 9)", 2))).alias("summary"))
