"""Queries over counters, gateway calls and adoption, and the batch twins of the streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import telemetry as T
from .registry import query

COUNT = "CASE WHEN {0} = 0 THEN 'zero' WHEN {0} = 1 THEN 'one' WHEN {0} <= 5 THEN '2_to_5' WHEN {0} <= 20 THEN '6_to_20' WHEN {0} <= 100 THEN '21_to_100' ELSE 'gt_100' END"
BYTES = "CASE WHEN {0} < 4096 THEN 'lt_4k' WHEN {0} < 16384 THEN '4_to_16k' WHEN {0} < 65536 THEN '16_to_64k' WHEN {0} < 262144 THEN '64_to_256k' WHEN {0} < 1048576 THEN '256k_to_1m' ELSE 'gte_1m' END"
LATENCY = "CASE WHEN latency_ms < 10 THEN 'lt_10ms' WHEN latency_ms < 100 THEN '10_to_100ms' WHEN latency_ms < 1000 THEN '100_to_1000ms' ELSE 'gte_1000ms' END"
RESULTS = "CASE WHEN result_count IS NULL THEN 'unknown' WHEN result_count = 0 THEN 'zero' WHEN result_count = 1 THEN 'one' WHEN result_count <= 5 THEN '2_to_5' WHEN result_count <= 20 THEN '6_to_20' ELSE 'gt_20' END"
SHARE = "CASE WHEN {0} = 0 OR {1} = 0 THEN 'zero' WHEN 100 * {0} < {1} THEN 'lt_1pct' WHEN 10 * {0} < {1} THEN '1_to_10pct' WHEN 2 * {0} < {1} THEN '10_to_50pct' WHEN 10 * {0} < 9 * {1} THEN '50_to_90pct' ELSE 'gt_90pct' END"


@query("mth1_buckets", "v_counters", sql=f"SELECT event_id, {COUNT.format('(latency_ms % 150)')} AS counts, {BYTES.format('(latency_ms * 300)')} AS bytes, {LATENCY} AS latency, {RESULTS} AS results, {SHARE.format('(latency_ms % 100)', '100')} AS share FROM v_counters")
def buckets(df: DataFrame) -> DataFrame:
    x = F.col("latency_ms")
    return df.select("event_id", N.count_bucket(x % 150).alias("counts"), N.byte_bucket(x * 300).alias("bytes"), N.latency_bucket(x).alias("latency"), N.result_bucket(F.col("result_count")).alias("results"), N.coverage_bucket(x % 100, F.lit(100)).alias("share"))


@query("agg16_daily_summary", "v_counters", sql=f"""SELECT day_utc, version, host, {COUNT.format('n')} AS calls, {COUNT.format('t')} AS transformed, {BYTES.format('b')} AS bytes FROM (SELECT day_utc, version, host, count(*) AS n, count(*) FILTER (transformed) AS t, sum(latency_ms) AS b
  FROM v_counters WHERE day_utc < DATE '2024-01-25' GROUP BY ALL)""")
def daily(df: DataFrame) -> DataFrame:
    return T.daily_summary(df, "2024-01-25")


_BUCKET = "CASE WHEN {0} = 0 THEN 'zero' WHEN {0} = 1 THEN 'one' WHEN {0} <= 5 THEN '2_to_5' WHEN {0} <= 20 THEN '6_to_20' WHEN {0} <= 100 THEN '21_to_100' ELSE 'gt_100' END"


@query("agg16_close_days", "v_counters", sql=f"""WITH d AS (SELECT *, CASE event_id % 10 WHEN 0 THEN 'hook_failure_summary' WHEN 1 THEN 'proxy_failure_summary' WHEN 2 THEN 'proxy_summary' ELSE 'hook_summary' END AS event, CASE WHEN event_id % 3 > 0 THEN reason END AS m FROM v_counters WHERE day_utc < DATE '2024-01-20'),
  g AS (SELECT day_utc, version, event, host AS dimension, CASE WHEN event_id % 10 > 1 THEN m END AS mode, CASE WHEN event_id % 10 < 2 THEN reason END AS failure_stage, count(*) AS n, count_if(transformed) AS t, sum(latency_ms)::BIGINT AS b FROM d GROUP BY ALL)
  SELECT day_utc, version, event, dimension, mode, failure_stage, CASE WHEN failure_stage IS NULL THEN {_BUCKET.format('n')} END AS calls, CASE WHEN failure_stage IS NULL THEN {_BUCKET.format('t')} END AS transformed,
  CASE WHEN failure_stage IS NULL THEN CASE WHEN b < 4096 THEN 'lt_4k' WHEN b < 16384 THEN '4_to_16k' WHEN b < 65536 THEN '16_to_64k' WHEN b < 262144 THEN '64_to_256k' WHEN b < 1048576 THEN '256k_to_1m' ELSE 'gte_1m' END END AS bytes FROM g""")
def closed_days(df: DataFrame) -> DataFrame:
    """Two kinds of counters by mode and two of failures by stage."""
    k = F.col("event_id") % 10
    event = F.when(k == 0, "hook_failure_summary").when(k == 1, "proxy_failure_summary").when(k == 2, "proxy_summary").otherwise("hook_summary")
    d = df.select("day_utc", "version", event.alias("event"), F.col("host").alias("dimension"), F.when(F.col("event_id") % 3 > 0, F.col("reason")).alias("mode"), F.col("reason").alias("failure_stage"), "transformed", F.col("latency_ms").alias("bytes"))
    return T.close_days(d, "2024-01-20")


@query("agg17_coverage_summary", "v_counters", sql=f"""WITH r AS (SELECT day_utc, host, CASE WHEN NOT routed THEN CASE WHEN reason = 'reason6' THEN 'other' ELSE reason END END AS r, count(*) AS n FROM v_counters GROUP BY ALL),
  g AS (SELECT day_utc, host, coalesce(sum(n) FILTER (r IS NULL), 0)::BIGINT AS routed, coalesce(sum(n) FILTER (r IS NOT NULL), 0)::BIGINT AS bypassed, arg_min(r, (-n, r)) FILTER (r IS NOT NULL) AS top_reason FROM r GROUP BY ALL)
  SELECT *, {SHARE.format('routed', '(routed + bypassed)')} AS share FROM g""")
def coverage(df: DataFrame) -> DataFrame:
    return T.coverage_summary(df)


@query("agg18_coverage_buckets", "v_counters", sql="""SELECT host, bucket, count(*) AS n FROM (SELECT host, unnest(list_distinct(['eligible', CASE WHEN routed THEN 'routed' ELSE 'bypassed' END, CASE WHEN transformed THEN 'transformed' ELSE 'eligible' END, CASE WHEN NOT routed THEN reason ELSE 'routed' END])) AS bucket FROM v_counters) GROUP BY ALL""")
def in_buckets(df: DataFrame) -> DataFrame:
    b = F.array(F.lit("eligible"), F.when(F.col("routed"), "routed").otherwise("bypassed"), F.when(F.col("transformed"), "transformed").otherwise("eligible"), F.when(~F.col("routed"), F.col("reason")).otherwise("routed"))
    return T.coverage_buckets(df.select("host", b.alias("buckets")))


@query("agg21_gateway_stats", "v_counters", sql=f"SELECT day_utc, host, outcome, {LATENCY} AS latency, {RESULTS} AS results, count(*) AS calls FROM v_counters GROUP BY ALL")
def gateway(df: DataFrame) -> DataFrame:
    return T.gateway_stats(df)


_MARKERS = "SELECT install_id, day_utc, version, host, at FROM (SELECT *, lag(day_utc || version) OVER (PARTITION BY install_id ORDER BY at, event_id) AS b FROM (SELECT * REPLACE ('1.' || (event_id % 2) AS version) FROM v_counters)) WHERE b IS DISTINCT FROM day_utc || version"


@query("win14_adoption_transitions", "v_counters", sql=_MARKERS)
def transitions(df: DataFrame) -> DataFrame:
    return T.adoption_transitions(df.withColumn("version", F.concat(F.lit("1."), (F.col("event_id") % 2).cast("string"))))


@query("agg23_active_installs", "v_counters", sql=f"SELECT day_utc, version, host, count(DISTINCT install_id) AS installs FROM ({_MARKERS}) GROUP BY ALL HAVING count(DISTINCT install_id) >= 5")
def active(df: DataFrame) -> DataFrame:
    return T.active_installs(transitions(df))


@query("set4_dedupe_daily_rows", "v_counters", sql="SELECT DISTINCT day_utc, version, host, outcome FROM v_counters")
def daily_rows(df: DataFrame) -> DataFrame:
    return T.dedupe_daily_rows(df)


@query("agg24_semantic_gate_stats", "v_counters", sql="SELECT count(result_count) AS judged, count(*) FILTER (result_count / 40 >= 0.7) AS losses, count(*) FILTER (result_count / 40 < 0.7) AS preserved, count(*) FILTER (result_count IS NULL) AS skipped FROM v_counters")
def gate_stats(df: DataFrame) -> DataFrame:
    return T.semantic_gate_stats(df.select((F.col("result_count") / 40).alias("probability")))


@query("top5_latest_n", "v_counters", sql="SELECT event_id, host FROM v_counters ORDER BY at DESC, event_id DESC LIMIT 4096")
def newest(df: DataFrame) -> DataFrame:
    return T.latest_n(df, 4096).select("event_id", "host")


@query("str5_idle_sessions", "v_metrics", sql="""WITH g AS (SELECT *, at - lag(at) OVER w >= INTERVAL 65 MINUTE OR lag(at) OVER w IS NULL AS new FROM v_metrics WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY at)),
  i AS (SELECT *, sum(new::INT) OVER (PARTITION BY session_id ORDER BY at) AS k FROM g) SELECT session_id, min(at) AS first_at, count(*) AS requests, sum(input_tokens)::BIGINT AS tokens FROM i GROUP BY session_id, k""")
def idle_sessions(df: DataFrame) -> DataFrame:
    """Bursts of a session that no gap of 65 minutes divides: the batch form of the session window."""
    d = df.where("session_id is not null").groupBy("session_id", F.session_window(F.col("at"), "65 minutes").alias("w")).agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("tokens"))
    return d.select("session_id", F.col("w.start").alias("first_at"), "requests", "tokens")


@query("str7_proxy_rollup", "v_metrics", sql="""SELECT window_start, host, count(*) AS requests, sum(input_tokens - inline_tokens)::BIGINT AS saved FROM (SELECT *, unnest(generate_series(date_trunc('hour', at) - INTERVAL 23 HOUR, date_trunc('hour', at), INTERVAL 1 HOUR)) AS window_start FROM v_metrics) GROUP BY ALL""")
def rollup(df: DataFrame) -> DataFrame:
    """Sliding one-day windows every hour: the batch form of the stream."""
    d = df.groupBy(F.window(F.col("at"), "1 day", "1 hour").alias("w"), "host").agg(F.count("*").alias("requests"), F.sum(F.col("input_tokens") - F.col("inline_tokens")).alias("saved"))
    return d.select(F.col("w.start").alias("window_start"), "host", "requests", "saved")
