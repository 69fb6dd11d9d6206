"""Registered queries: seasons, contextual and adaptive thresholds, audits, throttling and averages, with the SQL of each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from logsentinel.operators import adaptive as D
from logsentinel.operators import learning as L
from logsentinel.operators import reports as P
from logsentinel.operators import rules as R
from logsentinel.operators import seasonal as S
from logsentinel.plans import registry as Q
from logsentinel.plans.registry import ALERTS, BASE, DAY, query, with_log

HOURS = "CAST(({0} // 3600000) % 24 AS INT)"
BUCKET = {"hour": HOURS, "day": "CAST(({0} // 86400000 + 4) % 7 AS INT)", "week": "CAST(day(epoch_ms({0})) // 7 AS INT)"}


def _dim(dim: str) -> str:
    """Pattern, spectrum and stability of a dimension in SQL."""
    n, most = L.BUCKETS[dim], S.DOMINANT[dim]
    angle = f"{2 * math.pi / n!r} * k * bucket"
    return f"""q_{dim} AS (SELECT path, request_time_s AS v, {BUCKET[dim].format('ts_ms')} AS b FROM q0 WHERE {BUCKET[dim].format('ts_ms')} < {n}),
    pat_{dim} AS (SELECT w.path, CAST(g.b AS INT) AS bucket, round(coalesce(mean / all_mean, 1.0), 6) AS pattern, round(coalesce(least(1.0, n / ({S.LEAST / n})) * CASE WHEN n > 1 AND sd > 0 THEN exp(-sd / greatest(0.1, abs(mean))) ELSE 1.0 END, 0.0), 6) AS confidence, coalesce(n, 0) AS n
      FROM (SELECT path, avg(v) AS all_mean FROM q_{dim} GROUP BY path HAVING count(*) >= {S.LEAST}) w CROSS JOIN (SELECT unnest(range({n})) AS b) g LEFT JOIN (SELECT path, b, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n FROM q_{dim} GROUP BY ALL) o ON o.path = w.path AND o.b = g.b),
    sp_{dim} AS (SELECT *, sqrt(re * re + im * im) AS magnitude, CASE WHEN sqrt(re * re + im * im) < 1e-9 THEN 0.0 ELSE atan2(im, re) END AS phase
      FROM (SELECT path, k, sum(pattern * cos({angle})) / {n} AS re, sum(-pattern * sin({angle})) / {n} AS im FROM pat_{dim}, (SELECT unnest(range({n})) AS k) GROUP BY path, k)),
    rk_{dim} AS (SELECT *, k BETWEEN 1 AND {n // 2 - 1} AS able, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN k BETWEEN 1 AND {n // 2 - 1} THEN round(magnitude, 9) END DESC NULLS LAST, k) AS r FROM sp_{dim}),
    st_{dim} AS (SELECT path, CASE WHEN sum(magnitude) > 0 THEN sum(CASE WHEN able AND r <= {most} THEN magnitude ELSE 0 END) / sum(magnitude) ELSE 0.0 END AS stability FROM rk_{dim} GROUP BY path)"""


SEASONS = f"""q0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts_ms DESC, line_no DESC) AS r FROM al) WHERE r <= {2 * S.LEAST}), {', '.join(map(_dim, L.BUCKETS))},
  cf AS (SELECT c.path, c.n, h.stability AS hour_stability, d.stability AS day_stability, w.stability AS week_stability, least(1.0, c.n / {2.0 * S.LEAST}) * (0.7 + 0.3 * (0.6 * h.stability + 0.3 * d.stability + 0.1 * w.stability)) AS confidence
    FROM (SELECT path, least(count(*), {2 * S.LEAST}) AS n FROM al GROUP BY path HAVING count(*) >= {S.LEAST}) c JOIN st_hour h USING (path) JOIN st_day d USING (path) JOIN st_week w USING (path)),
  att AS (SELECT path, m - unnest([0, 18000000, 259200000]) AS at_ms FROM (SELECT path, max(ts_ms) AS m FROM al GROUP BY path)),
  a1 AS (SELECT *, {BUCKET['hour'].format('at_ms')} AS hour, {BUCKET['day'].format('at_ms')} AS day, {BUCKET['week'].format('at_ms')} AS week FROM att)"""
FACTORS = """f0 AS (SELECT a1.*, cf.confidence, hour_stability AS hs, day_stability AS ds, week_stability AS ws, ph.confidence AS hc, pd.confidence AS dc, ph.confidence * ph.pattern + (1 - ph.confidence) AS hf,
    pd.confidence * CASE WHEN pd.mean > 0 THEN pd.pattern / pd.mean ELSE 1.0 END + (1 - pd.confidence) AS df, coalesce(CASE WHEN pw.mean > 0 THEN pw.pattern / pw.mean ELSE 1.0 END, 1.0) AS wf
    FROM a1 LEFT JOIN cf USING (path) LEFT JOIN pat_hour ph ON ph.path = a1.path AND ph.bucket = hour
    LEFT JOIN (SELECT *, avg(pattern) OVER (PARTITION BY path) AS mean FROM pat_day) pd ON pd.path = a1.path AND pd.bucket = day LEFT JOIN (SELECT *, avg(pattern) OVER (PARTITION BY path) AS mean FROM pat_week) pw ON pw.path = a1.path AND pw.bucket = week),
  fa AS (SELECT path, at_ms, hour, confidence IS NOT NULL AS seasonal, CASE WHEN confidence IS NULL THEN 1.0 WHEN hs + ds + ws < 0.1 THEN 0.7 * hf + 0.2 * df + 0.1 * wf ELSE (hs * hf + ds * df + ws * wf) / (hs + ds + ws) END AS factor,
    CASE WHEN confidence IS NULL THEN 0.0 ELSE (0.7 * hc + 0.3 * dc) * confidence END AS time_confidence, coalesce(confidence, 0.0) AS confidence FROM f0)"""


def _values(spark, d):
    return Q.log(spark, d).withColumn("value", F.col("request_time_s"))


def _at(spark, d):
    newest = Q.log(spark, d).groupBy("path").agg(F.max("ts_ms").alias("m"))
    return newest.select("path", F.explode(F.array(*[F.col("m") - x for x in (0, 18_000_000, 259_200_000)])).alias("at_ms"))


def _six(df, *cols):
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in cols})


def _five(*cols: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in cols)


@query("seasonal_week", with_log("SELECT path, bucket, pattern, confidence, n FROM pat_week", SEASONS))
def _(spark, d):
    return L.seasonal_pattern(_values(spark, d), "path", "week")


@query("seasonal_spectrum", with_log(f"SELECT path, k, {_five('re', 'im', 'magnitude')}, CASE WHEN magnitude < 0.0001 THEN 0.0 ELSE round(cos(phase), 3) END AS cos_phase FROM sp_hour", SEASONS))
def _(spark, d):
    s = S.spectrum(L.seasonal_pattern(_values(spark, d), "path", "hour"), "path", 24)
    return _six(s.select("path", F.col("k").cast("long").alias("k"), "re", "im", "magnitude", F.when(F.col("magnitude") < 0.0001, 0.0).otherwise(F.round(F.cos("phase"), 3)).alias("cos_phase")), "re", "im", "magnitude")


@query("pattern_confidence", with_log(f"SELECT path, n, {_five('hour_stability', 'day_stability', 'week_stability', 'confidence')} FROM cf", SEASONS))
def _(spark, d):
    return _six(S.confidence(_values(spark, d), "path"), "hour_stability", "day_stability", "week_stability", "confidence").withColumn("n", F.col("n").cast("long"))


@query("seasonal_expected", with_log(f"""SELECT path, at_ms, round(coalesce(greatest(0.1, sum(CASE WHEN k = 0 THEN re WHEN magnitude > 0.1 * base THEN 2 * magnitude * cos({2 * math.pi / 24!r} * k * hour + phase) ELSE 0.0 END)), 1.0) + 1e-9, 5) AS expected
  FROM a1 LEFT JOIN (SELECT *, max(CASE WHEN k = 0 THEN magnitude END) OVER (PARTITION BY path) AS base FROM sp_hour WHERE k < 5) USING (path) GROUP BY path, at_ms""", SEASONS))  # fmt: skip
def _(spark, d):
    return _six(S.expected(_values(spark, d), _at(spark, d), "path"), "expected")


@query("seasonal_factor", with_log(f"SELECT path, at_ms, seasonal, {_five('factor', 'time_confidence', 'confidence')} FROM fa", f"{SEASONS}, {FACTORS}"))
def _(spark, d):
    return _six(S.at_times(_values(spark, d), _at(spark, d), "path"), "factor", "time_confidence", "confidence")


CONTEXT = "cx AS (SELECT path, b AS bucket, max(n) AS n, round(quantile_cont(request_time_s, 0.95), 6) AS p95, round(quantile_cont(request_time_s, 0.99), 6) AS p99 FROM (SELECT *, count(*) OVER (PARTITION BY path, b) AS n, row_number() OVER (PARTITION BY path, b ORDER BY ts_ms DESC, line_no DESC) AS r FROM (SELECT *, {} AS b FROM al)) WHERE r <= 1000 GROUP BY path, b)"


def _context(dim: str) -> str:
    return f"SELECT * FROM ({with_log(f"SELECT '{dim}' AS dim, path, bucket, n, p95, p99, n >= 1 AS established FROM cx", CONTEXT.format(BUCKET[dim].format('ts_ms')))})"


@query("contextual_baseline", f"{_context('hour')} UNION ALL {_context('day')}")
def _(spark, d):
    e = _values(spark, d)
    hour, day = (D.contextual_baselines(e, "path", k).withColumn("dim", F.lit(k)) for k in ("hour", "day"))
    return hour.unionByName(day).select("dim", "path", "bucket", "n", "p95", "p99", "established")


MANUAL = [("/login", 2.0), ("/page3.html", 0.75)]
CRITICAL = "(contains(path, '/login') OR contains(path, '/auth') OR contains(path, '/admin'))"
STEP = "CASE WHEN {0} = 0 THEN {1} ELSE {0} + greatest(-abs({0}) * {2}, least(abs({0}) * {2}, {1} - {0})) END"
AT = f"""{SEASONS}, {FACTORS}, {CONTEXT.format(BUCKET['hour'].format('ts_ms'))},
  ov AS (SELECT * FROM (VALUES {', '.join(f"('{p}', CAST({t} AS DOUBLE))" for p, t in MANUAL)}) o(path, manual)),
  gl AS (SELECT path, max(n) AS n, round(quantile_cont(request_time_s, 0.95), 6) AS p95, round(quantile_cont(request_time_s, 0.99), 6) AS p99 FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY ts_ms DESC, line_no DESC) AS r FROM al) WHERE r <= 1000 GROUP BY path),
  t0 AS (SELECT fa.*, gl.n, gl.p95, gl.p99, cx.n AS hn, coalesce(cx.p95, gl.p95) AS own, manual, {CRITICAL.replace('path', 'fa.path')} AS critical FROM fa JOIN gl USING (path) LEFT JOIN cx ON cx.path = fa.path AND cx.bucket = fa.hour LEFT JOIN ov ON ov.path = fa.path),
  t1 AS (SELECT *, greatest(CASE WHEN hn IS NULL THEN 0.0 ELSE least(1.0, hn / 2) END, time_confidence) AS wt FROM t0),
  t2 AS (SELECT *, ((1 - wt) * p95 + wt * own) * CASE WHEN seasonal THEN 1 + time_confidence * (factor - 1) ELSE 1.0 END AS blended, CASE WHEN hn IS NULL THEN p95 ELSE {STEP.format('p95', 'own', D.STEP)} END * CASE WHEN seasonal THEN factor ELSE 1.0 END AS moved, 0.3 * confidence + 0.7 * time_confidence AS trust FROM t1),
  t3 AS (SELECT *, CASE WHEN n >= 30 THEN {STEP.format('p95', 'blended', D.STEP)} END AS time_threshold FROM t2),
  th AS (SELECT *, CASE WHEN n >= 30 THEN coalesce(manual, CASE WHEN NOT seasonal OR trust >= {D.SURE} THEN time_threshold ELSE trust / {D.SURE} * {D.SENSITIVITY} * time_threshold + (1 - trust / {D.SURE} * {D.SENSITIVITY}) * p99 END * CASE WHEN critical THEN 0.9 ELSE 1.0 END) END AS adaptive_threshold,
    CASE WHEN n >= 30 THEN coalesce(manual, CASE WHEN confidence < 0.5 THEN 0.5 * moved + 0.5 * p95 ELSE moved END) END AS dynamic_threshold FROM t3)"""


def _thresholds(spark, d):
    e = _values(spark, d)
    overrides = spark.createDataFrame(MANUAL, "path string, threshold double")
    critical = e.where(F.col("path").contains("/login") | F.col("path").contains("/auth") | F.col("path").contains("/admin")).select("path").distinct()
    return D.thresholds_at(e, _at(spark, d), "path", overrides, critical)


for _name in ("time_threshold", "adaptive_threshold", "dynamic_threshold"):
    query(_name, with_log(f"SELECT path, at_ms, {_five(_name)} FROM th", AT))(lambda spark, d, c=_name: _six(_thresholds(spark, d).select("path", "at_ms", c), c))


@query("adaptation", with_log(f"""SELECT path, at_ms, {_five('old_threshold', 'new_threshold')} FROM (SELECT path, at_ms, p95 AS old_threshold, {STEP.format('p95', 'time_threshold', 0.1)} AS new_threshold FROM th
  JOIN (SELECT path, max(CASE WHEN r = 30 THEN ts_ms END) AS since FROM (SELECT path, ts_ms, row_number() OVER (PARTITION BY path ORDER BY ts_ms, line_no) AS r FROM al) GROUP BY path) USING (path)
  WHERE since IS NOT NULL AND (critical OR (at_ms - since >= {DAY} AND ((seasonal AND confidence < {D.SURE * 0.8!r}) OR (n > 100 AND n % 200 = 0))))) WHERE abs(new_threshold - old_threshold) > 0.01 * greatest(abs(old_threshold), 1.0)""", AT))  # fmt: skip
def _(spark, d):
    since = L.established(_values(spark, d), ["path"])
    return _six(D.adaptations(_thresholds(spark, d), since, "path"), "old_threshold", "new_threshold")


AUDIT = f"""nr AS (SELECT path, request_time_s AS v, ts_ms // {DAY} AS span, row_number() OVER (PARTITION BY path ORDER BY ts_ms, line_no) AS r FROM al),
  en AS (SELECT path, span, max(r) AS upto FROM nr GROUP BY path, span),
  pv AS (SELECT en.path, en.span, round(quantile_cont(v, 0.95), 6) AS nt FROM en JOIN nr ON nr.path = en.path AND nr.r <= upto AND nr.r > upto - 1000 GROUP BY en.path, en.span),
  au AS (SELECT path, (span + 1) * {DAY} AS ts_ms, ot AS old_threshold, nt AS new_threshold, CASE WHEN ot = 0 THEN TRUE ELSE abs(nt - ot) / abs(ot) * 100 <= 50.0 END AS accepted FROM (SELECT *, lag(nt) OVER (PARTITION BY path ORDER BY span) AS ot FROM pv) WHERE abs(nt - ot) > 0.01 * greatest(abs(ot), 1.0))"""


@query("threshold_audit", with_log("SELECT * FROM au", AUDIT))
def _(spark, d):
    return D.audit(_values(spark, d), "path")


@query("threshold_rejects", with_log("SELECT path, ts_ms, old_threshold, new_threshold FROM au WHERE NOT accepted", AUDIT))
def _(spark, d):
    return D.audit(_values(spark, d), "path").where("NOT accepted").drop("accepted")


@query("audit_since", with_log("SELECT path, ts_ms, old_threshold, new_threshold, accepted FROM au WHERE ts_ms >= 1705363200000", AUDIT))
def _(spark, d):
    return D.audit_since(D.audit(_values(spark, d), "path"), 1_705_363_200_000)


def _fold(keys: str, source: str, value: str, rate: float, first: str, rest: str) -> str:
    """An ordered exponential average of all values by a list fold: struct (m, s)."""
    x = "x.m"
    return f"""SELECT {keys}, n, list_reduce({first}, lambda a, x: {{'m': a.m + {rate} * ({x} - a.m), 's': (1 - {rate}) * a.s + {rate} * ({x} - a.m) * ({x} - a.m)}}) AS f
      FROM (SELECT {keys}, count(*) AS n, list({{'m': CAST({value} AS DOUBLE), 's': 0.0::DOUBLE}} ORDER BY ts_ms, line_no) AS v FROM {source} GROUP BY {keys}){rest}"""


EWMA = f"ew AS (SELECT entity_type, entity_id, n, round(f.m, 6) AS ewma_mean, round(f.s, 6) AS ewma_var FROM ({_fold('entity_type, entity_id', 'ev', 'value', 0.1, 'v', '')}))"
KEYS = ["entity_type", "entity_id"]
SD = "CASE WHEN sqrt(ewma_var) < 1e-6 THEN 1.0 ELSE sqrt(ewma_var) END"
Q.ORACLES["ewma_baseline"] = with_log("SELECT * REPLACE (round(ewma_var + 1e-9, 2) AS ewma_var) FROM ew", f"{BASE}, {EWMA}")
Q.ORACLES["baseline_anomalies"] = with_log(f"SELECT entity_type, entity_id, ts_ms, line_no, value, round(abs(value - ewma_mean) / {SD}, 6) AS ratio FROM ev JOIN ew USING (entity_type, entity_id) WHERE n >= 30 AND abs(value - ewma_mean) / {SD} > 3.0", f"{BASE}, {EWMA}")


@query("baseline_join", with_log("SELECT entity_type, entity_id, line_no, round(value, 6) AS value, n, ewma_mean FROM ev LEFT JOIN ew USING (entity_type, entity_id)", f"{BASE}, {EWMA}"))
def _(spark, d):
    e = Q._events(spark, d)
    return e.join(L.ewma(e, KEYS), KEYS, "left").select(*KEYS, "line_no", F.round("value", 6).alias("value"), "n", "ewma_mean")


@query("confidence_interval", with_log("""SELECT entity_type, entity_id, n, round(ewma_mean - m + 1e-9, 4) AS low, round(ewma_mean + m + 1e-9, 4) AS high FROM (SELECT *, CASE WHEN n < 3 THEN 3 * sqrt(ewma_var)
  ELSE CASE WHEN n > 30 THEN 1.96 WHEN n - 1 <= 10 THEN 2.228 WHEN n - 1 <= 20 THEN 2.086 ELSE 2.042 END * sqrt(ewma_var) / sqrt(least(n, 1000)) END AS m FROM ew)""", f"{BASE}, {EWMA}"))  # fmt: skip
def _(spark, d):
    return D.confidence_interval(L.ewma(Q._events(spark, d), KEYS)).select(*KEYS, "n", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("low", "high")])


@query("simple_seasonal", with_log(f"SELECT path, bucket, n, round(f.m + 1e-9, 5) AS mean, round(sqrt(f.s) + 1e-9, 5) AS sd, round(f.m + 0.1 * sqrt(f.s) + 1e-9, 5) AS threshold, least(1.0, n / 10) AS confidence FROM ({_fold('path, bucket', '(SELECT *, ' + HOURS.format('ts_ms') + ' AS bucket FROM al)', 'request_time_s', 0.05, "list_concat([{'m': 0.0::DOUBLE, 's': 0.0::DOUBLE}], v)", '')})"))
def _(spark, d):
    return _six(S.simple_seasonal(_values(spark, d), "path", "hour"), "mean", "sd", "threshold")


#: The spectrum of a pattern that isn't rounded.
SPECTRUM = f"""SELECT path, k, round(re + 1e-9, 5) AS re, round(im + 1e-9, 5) AS im, round(sqrt(re * re + im * im) / 24 + 1e-9, 5) AS magnitude
  FROM (SELECT path, k, sum(pattern * cos({2 * math.pi / 24!r} * k * bucket)) AS re, sum(-pattern * sin({2 * math.pi / 24!r} * k * bucket)) AS im
    FROM (SELECT w.path, g.b AS bucket, coalesce(mean / all_mean, 1.0) AS pattern FROM (SELECT path, avg(v) AS all_mean FROM q_hour GROUP BY path HAVING count(*) >= {S.LEAST}) w CROSS JOIN (SELECT unnest(range(24)) AS b) g
      LEFT JOIN (SELECT path, b, avg(v) AS mean FROM q_hour GROUP BY ALL) o ON o.path = w.path AND o.b = g.b), (SELECT unnest(range(24)) AS k) GROUP BY path, k)"""
Q.ORACLES["seasonal_dft"] = with_log(f"SELECT path, CAST(k AS INT) AS k, re, im, magnitude FROM ({SPECTRUM})", SEASONS)
Q.ORACLES["dominant_freq"] = with_log(f"SELECT path, CAST(k AS INT) AS k, CAST(r AS INT) AS rank, magnitude, round(magnitude / a, 5) AS share FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY magnitude DESC, k) AS r FROM (SELECT *, sum(magnitude) OVER (PARTITION BY path) AS a FROM ({SPECTRUM})) WHERE k BETWEEN 1 AND 11) WHERE r <= 3", SEASONS)

# fixed values: the texts of the rules, as the survey's Appendix B gives them
_figure = lambda x: f"printf('%.6f', round({x}, 9))"
_METRIC = {"time": "request_time", "bytes": "bytes_sent", "error": "error_rate", "vol": "request_volume"}
_Z = " ".join([f"WHEN 'ip_{s}_z' THEN concat('Anomalous IP {m} (Z-score: ', {_figure(f'ip_{s}_z')}, ')')" for s, m in _METRIC.items()] + [f"WHEN 'path_{s}_z' THEN concat('Anomalous {m} for path ''', path, ''' (Z-score: ', {_figure(f'path_{s}_z')}, ')')" for s, m in _METRIC.items() if s != "vol"])
REASON = f"""CASE rule WHEN 'requests_per_ip' THEN concat('High request rate from IP. Count: ', ip_req_window, ' in last {Q.C.window_ms // 1000}s.') WHEN 'failed_logins' THEN concat('Multiple failed login attempts from IP. Count: ', ip_failed_window, ' in last {Q.C.window_ms // 1000}s.')
  WHEN 'suspicious_path' THEN concat('Request path contains a suspicious pattern: ', CASE WHEN contains(path, '../') THEN '../' WHEN contains(path, '/etc/passwd') THEN '/etc/passwd' ELSE 'script' END) WHEN 'suspicious_ua' THEN concat('User-Agent contains a suspicious pattern: ', 'sqlmap')
  WHEN 'ua_missing' THEN 'Request with missing User-Agent' WHEN 'ua_known_bad' THEN 'Request from a known malicious User-Agent signature' WHEN 'ua_headless' THEN 'Request from a known headless browser signature'
  WHEN 'ua_outdated' THEN concat('Request from outdated browser: ', CASE WHEN contains(user_agent, 'Chrome/') THEN 'Chrome/80' ELSE 'Firefox/70' END) WHEN 'ua_cycling' THEN 'IP rapidly cycling through different User-Agents'
  WHEN 'asset_ratio' THEN concat('Low Asset-to-HTML request ratio detected. Ratio: ', {_figure('asset_ratio')}, ' (Expected minimum: >{Q.C.least_asset_ratio:.6f}). HTML: ', html_window, ', Assets: ', asset_window, ' in window.')
  WHEN 'sensitive_new_ip' THEN concat('Newly seen IP immediately accessed a sensitive path containing ''', {' '.join(['CASE'] + [f"WHEN contains(path, '{p}') THEN '{p}'" for p in Q.C.sensitive] + ['END'])}, '''.')
  WHEN 'new_path_errors' THEN concat('IP began generating a high error rate (Z-score: ', {_figure('ip_error_z')}, ') while accessing a new path for the first time')
  WHEN 'slowdown' THEN concat('Sudden performance degradation for IP. Request time ', {_figure('request_time_s')}, 's is >{Q.C.slow_factor:.6f}x the historical average of ', {_figure('ip_time_mean')}, 's') {_Z} END"""
REASONED = f"{ALERTS}, rs AS (SELECT a.*, {REASON} AS reason FROM alerts a JOIN z_path z ON z.line_no = a.line_no)".replace("AS (SELECT a.*, CASE rule", "AS (SELECT a.*, CASE a.rule")


def _throttled(key: str) -> str:
    return f"""{REASONED}, tf AS (SELECT ip, {key} AS key, list_reduce(list({{'last': ts_ms, 'kept': [{{'l': line_no, 'r': rule, 't': ts_ms, 'x': reason}}]}} ORDER BY ts_ms, line_no, rule), lambda a, x: CASE WHEN x.last < a.last + {DAY} THEN a ELSE {{'last': x.last, 'kept': list_concat(a.kept, x.kept)}} END) AS f FROM rs GROUP BY ip, {key}),
  kp AS (SELECT ip, k.l AS line_no, k.r AS rule, k.t AS ts_ms, k.x AS reason FROM (SELECT ip, unnest(f.kept) AS k FROM tf))"""


THROTTLED = _throttled("reason")


@query("alert_throttle", f"{THROTTLED} SELECT line_no, ts_ms, ip, rule, reason FROM kp")
def _(spark, d):
    return R.throttle(Q.alerts(spark, d), seconds=DAY // 1000).select("line_no", "ts_ms", "ip", "rule", "reason")


@query("alert_throttle_rule", f"{_throttled('rule')} SELECT line_no, ts_ms, ip, rule, reason FROM kp")
def _(spark, d):
    return R.throttle(Q.alerts(spark, d), seconds=DAY // 1000, key="rule").select("line_no", "ts_ms", "ip", "rule", "reason")


@query("throttle_stats", f"{THROTTLED} SELECT rule, tier, alerts, alerts - coalesce(kept, 0) AS suppressed, round(1 - coalesce(kept, 0) / alerts, 6) AS ratio FROM (SELECT rule, tier, count(*) AS alerts FROM alerts GROUP BY rule, tier) LEFT JOIN (SELECT rule, count(*) AS kept FROM kp GROUP BY rule) USING (rule)")
def _(spark, d):
    found = Q.alerts(spark, d)
    return P.throttle_report(found, R.throttle(found, seconds=DAY // 1000), ["rule", "tier"])


Q.ORACLES["alert_text"] = f"{REASONED} SELECT line_no, rule, concat('ALERT: ', reason, ' | IP: ', ip, ' | Tier: ', tier, ' | Score: ', printf('%.6f', score)) AS text FROM rs"
