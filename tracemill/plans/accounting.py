"""Queries over usage ledgers, prices, metrics and experiment arms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import period_key, strict_sum
from ..operators import metrics as M
from ..operators import usage as U
from .registry import query

ENTRIES = """SELECT *, prompt - cached AS effective_input, prompt + output AS total FROM v_usage
  WHERE prompt >= 0 AND output >= 0 AND cached >= 0 AND cache_write >= 0 AND cached + cache_write <= prompt"""
WEIGHTED = """SELECT *, prompt - cached - cache_write AS fresh, (prompt - cached - cache_write) * 1000 + cached * 100 + cache_write * 1250 + (output - reasoning) * 1000 + reasoning * 1000 AS cost_units
  FROM v_usage WHERE prompt - cached - cache_write >= 0 AND output >= reasoning"""


@query("prj5_ledger_entry", "v_usage", sql=f"SELECT session_id, turn_no, effective_input, total FROM ({ENTRIES})")
def ledger_entry(df: DataFrame) -> DataFrame:
    return U.ledger_entries(df).select("session_id", "turn_no", "effective_input", "total")


@query("prj6_weighted_usage", "v_usage", sql=f"SELECT session_id, turn_no, fresh, cost_units FROM ({WEIGHTED})")
def weighted_usage(df: DataFrame) -> DataFrame:
    return U.weighted_usage(df).select("session_id", "turn_no", "fresh", "cost_units")


@query("agg4_ledger_by_period", "v_usage", sql=f"""WITH e AS ({ENTRIES}), k AS (
  SELECT 'session' AS period, session_id::VARCHAR AS key, * FROM e UNION ALL SELECT 'day', strftime(at, '%Y-%m-%d'), * FROM e
  UNION ALL SELECT 'week', strftime(at, '%G-W%V'), * FROM e UNION ALL SELECT 'month', strftime(at, '%Y-%m'), * FROM e)
  SELECT period, key, count(*) AS entries, sum(prompt)::BIGINT AS prompt, sum(output)::BIGINT AS output, sum(cached)::BIGINT AS cached, sum(cache_write)::BIGINT AS cache_write,
  sum(effective_input)::BIGINT AS effective_input, sum(total)::BIGINT AS total FROM k GROUP BY period, key""")
def ledger_by_period(df: DataFrame) -> DataFrame:
    return U.ledger_by_period(df)


@query("dat1_period_key", "v_usage", sql="""SELECT session_id, turn_no, strftime(l, '%Y-%m-%d') AS day, strftime(l, '%G-W%V') AS week, strftime(l, '%Y-%m') AS month
  FROM (SELECT *, (at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS l FROM v_usage)""")
def period_keys(df: DataFrame) -> DataFrame:
    return df.select("session_id", "turn_no", *[period_key(F.col("at"), p, "America/Los_Angeles").alias(p) for p in ("day", "week", "month")])


@query("agg5_usage_report", "v_usage", sql=f"""SELECT host, count(*) AS events, {", ".join(f"sum({c})::BIGINT AS {c}" for c in ("prompt", "cached", "cache_write", "fresh", "output", "reasoning", "cost_units"))},
  count(DISTINCT CASE WHEN session_id % 50 <> 0 THEN session_id::VARCHAR ELSE 'row:' || session_id || '/' || turn_no END) AS sessions, count(DISTINCT (session_id, turn_no)) AS turns FROM ({WEIGHTED}) GROUP BY host""")
def usage_report(df: DataFrame) -> DataFrame:
    row = F.concat_ws("/", F.col("session_id").cast("string"), F.col("turn_no").cast("string"))
    return U.usage_report(df.withColumn("row_id", row).withColumn("session_id", F.when(F.col("session_id") % 50 != 0, F.col("session_id"))), ["host"])


@query("agg6_reported_cost", "v_usage", sql="""WITH s AS (SELECT host, session_id, sum(cost_micro)::BIGINT AS cost, count(cost_micro) = count(*) AS f FROM v_usage GROUP BY ALL)
  SELECT host, count(*) AS sessions, count(*) FILTER (f) AS complete_sessions, CASE WHEN bool_and(f) THEN sum(cost)::BIGINT END AS cost_micro,
  CASE WHEN bool_and(f) THEN 'complete' WHEN bool_or(f) THEN 'partial' ELSE 'unavailable' END AS coverage FROM s GROUP BY host""")
def reported_cost(df: DataFrame) -> DataFrame:
    return U.reported_cost(df)


@query("agg7_paired_sessions", "v_usage", sql=f"""SELECT arm, session_id, count(DISTINCT turn_no) AS turns, sum(prompt)::BIGINT AS prompt, sum(output)::BIGINT AS output, sum(cost_units)::BIGINT AS cost_units,
  CASE WHEN count(tool_calls) = count(*) THEN sum(tool_calls)::BIGINT END AS tool_calls FROM ({WEIGHTED}) GROUP BY arm, session_id""")
def paired_sessions(df: DataFrame) -> DataFrame:
    return U.paired_sessions(df)


@query("agg12_strict_sum", "v_usage", sql="SELECT session_id, CASE WHEN count(tool_calls) = count(*) THEN sum(tool_calls)::BIGINT END AS tool_calls FROM v_usage GROUP BY session_id")
def strict_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id").agg(strict_sum(F.col("tool_calls")).alias("tool_calls"))


@query("agg13_metrics_by_arm_turn", "v_usage", sql="""SELECT arm, turn_no, count(*) AS n, sum(prompt)::BIGINT AS prompt, sum(output)::BIGINT AS output,
  CASE WHEN count(tool_calls) = count(*) THEN sum(tool_calls)::BIGINT END AS tool_calls, grouping_id(arm, turn_no)::INT AS level FROM v_usage GROUP BY CUBE (arm, turn_no)""")
def by_arm_turn(df: DataFrame) -> DataFrame:
    return M.metrics_by_arm_turn(df)


@query("jn5_prefer_session_totals", "v_usage", sql="""SELECT host, session_id, turn_no, turn_no = 1 AND session_id % 4 = 0 AS is_total FROM v_usage u WHERE (turn_no = 1 AND session_id % 4 = 0)
  OR NOT EXISTS (SELECT 1 FROM v_usage t WHERE t.turn_no = 1 AND t.session_id % 4 = 0 AND t.host = u.host AND t.session_id = u.session_id)""")
def prefer_totals(df: DataFrame) -> DataFrame:
    return U.prefer_session_totals(df.select("host", "session_id", "turn_no", ((F.col("turn_no") == 1) & (F.col("session_id") % 4 == 0)).alias("is_total")))


@query("jn9_quarantine_revisions", "v_usage", sql="SELECT host, count(*) FILTER (session_id % 23 <> 0) AS valid_rows, count(*) AS n FROM v_usage GROUP BY host")
def quarantine(df: DataFrame) -> DataFrame:
    out = U.quarantine_revisions(df, df.where("session_id % 23 = 0").select("session_id"), "session_id")
    return out.groupBy("host").agg(F.count_if("valid").alias("valid_rows"), F.count("*").alias("n"))


@query("win13_upsert_session_total", "v_usage", sql="SELECT host, session_id, seq, prompt FROM (SELECT *, turn_no * 1000000 + prompt AS seq, row_number() OVER (PARTITION BY host, session_id ORDER BY turn_no * 1000000 + prompt DESC) AS k FROM v_usage) WHERE k = 1")
def latest_totals(df: DataFrame) -> DataFrame:
    return U.latest_session_totals(df.withColumn("seq", F.col("turn_no") * 1000000 + F.col("prompt"))).select("host", "session_id", "seq", "prompt")


@query("win6_cumulative_delta", "v_usage", sql="""SELECT session_id, turn_no, CASE WHEN d >= 0 THEN d END AS delta FROM (SELECT session_id, turn_no, prompt - CASE WHEN row_number() OVER w = 1 THEN 0 ELSE lag(prompt) OVER w END AS d
  FROM v_usage WINDOW w AS (PARTITION BY session_id ORDER BY turn_no, prompt))""")
def deltas(df: DataFrame) -> DataFrame:
    return U.cumulative_delta(df, "session_id", ["turn_no", "prompt"], "prompt").select("session_id", "turn_no", "delta")


_REVISIONS = """SELECT request_key, arg_min(session_id, seq) AS session_id, arg_min(arm, seq) AS arm, arg_min(provider, seq) AS provider, arg_min(model, seq) AS model, arg_min(service, seq) AS service,
  bool_or(regional IS NOT NULL) AS stated, arg_min(input, seq) AS input, arg_min(cached, seq) AS cached, arg_min(cache_write, seq) AS cache_write, arg_min(output, seq) AS output, arg_min(reasoning, seq) AS reasoning,
  arg_min(quality, seq) AS quality, count(*) - 1 AS duplicates, count(DISTINCT (input, cached, cache_write, output, reasoning, quality)) > 1 AS conflict FROM v_requests GROUP BY request_key"""


@query("set2_dedupe_revisions", "v_requests", sql=f"SELECT request_key, output, duplicates, conflict FROM ({_REVISIONS})")
def dedupe(df: DataFrame) -> DataFrame:
    return U.dedupe_revisions(df, "request_key", ["input", "cached", "cache_write", "output", "reasoning", "quality"], "seq").select("request_key", "output", "duplicates", "conflict")


_PRICED = f"""SELECT r.*, p.profile_id, r.input > p.threshold AS long, CASE WHEN p.profile_id IS NULL THEN 'unsupported-billing-context'
  WHEN r.quality <> 'complete' OR r.input - r.cached - r.cache_write < 0 OR r.reasoning > r.output THEN 'incomplete-or-invalid-counters' END AS reason,
  (r.input - r.cached - r.cache_write) * CASE WHEN r.input > p.threshold THEN p.long_fresh ELSE p.short_fresh END + r.cached * CASE WHEN r.input > p.threshold THEN p.long_read ELSE p.short_read END
  + r.cache_write * CASE WHEN r.input > p.threshold THEN p.long_write ELSE p.short_write END + r.output * CASE WHEN r.input > p.threshold THEN p.long_output ELSE p.short_output END AS nano
  FROM ({_REVISIONS}) r LEFT JOIN v_prices p ON r.provider = p.provider AND r.model = p.model AND r.service = p.service AND r.stated AND NOT p.regional"""


@query("jn3_price_requests", "v_requests", "v_prices", sql=f"SELECT request_key, reason, CASE WHEN reason IS NULL THEN CASE WHEN long THEN 'long' ELSE 'short' END END AS tier, CASE WHEN reason IS NULL THEN nano::BIGINT END AS nano_usd FROM ({_PRICED})")
def price(requests: DataFrame, prices: DataFrame) -> DataFrame:
    once = U.dedupe_revisions(requests, "request_key", ["input", "cached", "cache_write", "output", "reasoning", "quality"], "seq")
    return U.price_requests(once, prices).select("request_key", "reason", "tier", F.col("nano_usd").cast("long"))


_REPORT = """count(*) FILTER (ok) AS priced, count(*) FILTER (NOT ok) AS unpriced, sum(duplicates)::BIGINT AS duplicates, count(*) FILTER (conflict) AS conflicts, sum(CASE WHEN ok THEN nano END)::BIGINT AS supported_nano,
  CASE WHEN bool_and(ok) THEN 'complete' WHEN bool_or(ok) THEN 'partial' ELSE 'indeterminate' END AS status, CASE WHEN bool_and(ok) THEN sum(nano)::BIGINT END AS estimated_nano"""


@query("agg8_api_cost_report", "v_requests", "v_prices", sql=f"SELECT model, service, {_REPORT} FROM (SELECT *, reason IS NULL AND NOT conflict AS ok FROM ({_PRICED})) GROUP BY model, service")
def cost_report(requests: DataFrame, prices: DataFrame) -> DataFrame:
    out = U.api_cost_report(requests, prices, ["model", "service"])
    return out.withColumn("supported_nano", F.col("supported_nano").cast("long")).withColumn("estimated_nano", F.col("estimated_nano").cast("long"))


@query("jn4_attach_api_cost", "v_usage", "v_requests", "v_prices", sql=f"""WITH c AS (SELECT session_id, arm, {_REPORT} FROM (SELECT *, reason IS NULL AND NOT conflict AS ok FROM ({_PRICED})) GROUP BY session_id, arm),
  s AS (SELECT arm, session_id, sum(cost_units)::BIGINT AS cost_units FROM ({WEIGHTED}) GROUP BY arm, session_id)
  SELECT s.arm, s.session_id, cost_units, status, estimated_nano FROM s LEFT JOIN c ON s.session_id = c.session_id AND s.arm = c.arm""")
def attach_cost(usage: DataFrame, requests: DataFrame, prices: DataFrame) -> DataFrame:
    sessions = U.paired_sessions(usage).select("arm", "session_id", "cost_units")
    costs = U.api_cost_report(requests, prices, ["session_id", "arm"]).select("arm", "session_id", "status", F.col("estimated_nano").cast("long").alias("estimated_nano"))
    return sessions.join(costs, ["arm", "session_id"], "left")


@query("prj14_reported_cost_nano", "v_usage", sql="SELECT session_id, turn_no, cost_micro * 1000 AS nano, cost_micro IS NOT NULL AS valid FROM v_usage")
def cost_nano(df: DataFrame) -> DataFrame:
    usd = F.col("cost_micro").cast("double") / 1000000
    exact = usd.cast("decimal(38,9)")
    return df.select("session_id", "turn_no", F.when(exact.cast("double") == usd, (exact * 1000000000).cast("long")).alias("nano"), F.coalesce(exact.cast("double") == usd, F.lit(False)).alias("valid"))


@query("prj13_reported_cost", "v_usage", sql="SELECT session_id, turn_no, CASE WHEN turn_no % 2 = 0 THEN cost_micro ELSE coalesce(tool_calls, cost_micro) END AS cost FROM v_usage")
def first_cost(df: DataFrame) -> DataFrame:
    """The first valid amount among several places."""
    places = [F.when(F.col("turn_no") % 2 == 1, F.col("tool_calls")), F.col("cost_micro")]
    return df.select("session_id", "turn_no", F.coalesce(*[F.when(p >= 0, p) for p in places]).alias("cost"))


_METRICS = "SELECT *, input_tokens - inline_tokens AS savings, coalesce(session_id, '<unknown>') AS s FROM v_metrics"
_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY seq) AS k FROM v_metrics) WHERE k = 1"


@query("set1_merge_ledgers", "v_metrics", sql="""SELECT event_key, min(seq) AS seq, count(*) - 1 AS replays,
  count(DISTINCT (host, session_id, client, model, input_tokens, inline_tokens, provider_savings)) > 1 AS conflict FROM v_metrics GROUP BY event_key""")
def merge(df: DataFrame) -> DataFrame:
    return M.merge_ledgers(df).select("event_key", "seq", "replays", "conflict")


@query("agg1_metrics_cumulative", "v_metrics", sql=f"SELECT count(*) AS events, count(DISTINCT (host, s)) AS sessions, sum(savings)::BIGINT AS savings, sum(provider_savings)::BIGINT AS provider_savings FROM ({_METRICS})")
def cumulative(df: DataFrame) -> DataFrame:
    return M.metrics_cumulative(df)


_BY_SESSION = f"SELECT host, s AS session_id, count(*) AS events, sum(savings)::BIGINT AS savings, arg_min(client, (at, seq)) AS client, arg_min(model, (at, seq)) AS model FROM ({_METRICS}) GROUP BY host, s"


@query("agg2_metrics_by_session", "v_metrics", sql=_BY_SESSION)
def by_session(df: DataFrame) -> DataFrame:
    return M.metrics_by_session(df)


@query("agg2_average_by_session", "v_metrics", sql=f"SELECT host, count(*) AS sessions, floor(sum(savings) / count(*))::BIGINT AS average_savings FROM ({_BY_SESSION}) GROUP BY host")
def average(df: DataFrame) -> DataFrame:
    return M.average_by_session(df)


@query("agg3_metrics_by_period", "v_metrics", sql=f"""WITH m AS (SELECT *, (at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS l FROM ({_METRICS})),
  k AS (SELECT 'day' AS period, strftime(l, '%Y-%m-%d') AS key, * FROM m UNION ALL SELECT 'week', strftime(l, '%G-W%V'), * FROM m UNION ALL SELECT 'month', strftime(l, '%Y-%m'), * FROM m)
  SELECT period, key, count(*) AS events, count(DISTINCT (host, s)) AS sessions, sum(savings)::BIGINT AS savings FROM k GROUP BY period, key""")
def by_period(df: DataFrame) -> DataFrame:
    return M.metrics_by_period(df, "America/Los_Angeles")


@query("win12_latest_session", "v_metrics", sql=f"""WITH m AS ({_METRICS}), l AS (SELECT host, arg_max(s, (at, seq)) AS s FROM m GROUP BY host)
  SELECT host, s AS session_id, count(*) AS events, sum(savings)::BIGINT AS savings FROM m JOIN l USING (host, s) GROUP BY host, s""")
def latest(df: DataFrame) -> DataFrame:
    return M.latest_session(df)


@query("agg9_benchmark_summary", "v_attempts", sql="""SELECT benchmark_id, task_id, arm, count(*) AS runs, count(*) FILTER (passed AND verified) AS successes, count(*) FILTER (NOT passed AND verified) AS failures, count(*) FILTER (NOT verified) AS unverified,
  sum(attempts)::BIGINT AS attempts, sum(cost_cents)::BIGINT AS supported_cost, CASE WHEN count(duration_ms) = count(*) THEN sum(duration_ms)::BIGINT END AS duration_ms, count(duration_ms) AS duration_runs, sum(cache_read)::BIGINT AS cache_read,
  CASE WHEN bool_and(verified) THEN sum(cost_cents)::BIGINT END AS cost_cents, CASE WHEN count(*) FILTER (passed AND verified) > 0 THEN sum(cost_cents) // count(*) FILTER (passed AND verified) END::BIGINT AS cost_per_success
  FROM v_attempts GROUP BY benchmark_id, task_id, arm""")
def summary(df: DataFrame) -> DataFrame:
    return M.benchmark_summary(df)


@query("agg9_duplicate_attempts", "v_attempts", sql="SELECT task_id, arm, repetition // 3 AS repetition, count(*) AS n FROM v_attempts GROUP BY ALL HAVING count(*) > 1")
def duplicates(df: DataFrame) -> DataFrame:
    return M.duplicate_attempts(df.withColumn("repetition", F.expr("repetition div 3")))


@query("agg10_regression_gate", "v_attempts", sql="""SELECT task_id, control, apply, CASE WHEN g = 1 THEN control - apply <= 1 ELSE control - apply < 2 END AS ok FROM (SELECT task_id, count(*) FILTER (passed AND arm = 'control') AS control,
  count(*) FILTER (passed AND arm = 'apply') AS apply, grouping(task_id) AS g FROM v_attempts GROUP BY ROLLUP (task_id))""")
def gate(df: DataFrame) -> DataFrame:
    return M.regression_gate(df)


_PAIRS = """SELECT *, floor((control - apply) * 1000 / control)::BIGINT AS reduction_mille FROM (SELECT scenario, task_id, (sum(cost_cents) FILTER (arm = 'control'))::BIGINT AS control, (sum(cost_cents) FILTER (arm = 'apply'))::BIGINT AS apply
  FROM v_scenarios GROUP BY scenario, task_id) WHERE control > 0 AND apply IS NOT NULL""".replace("v_scenarios", "(SELECT * REPLACE (repetition % 40 AS scenario) FROM v_attempts)")


@query("jn10_pair_arms", "v_attempts", sql=_PAIRS)
def pairs(df: DataFrame) -> DataFrame:
    return M.pair_arms(df.withColumn("scenario", F.col("repetition") % 40))


@query("agg11_screening_decision", "v_attempts", sql=f"""SELECT scenario, pairs, mean_reduction, decision FROM (SELECT scenario, count(*) AS pairs, avg(reduction_mille) AS mean_reduction,
  CASE WHEN count(*) < 2 THEN 'inconclusive' WHEN avg(reduction_mille) < -50 THEN 'failed' WHEN avg(reduction_mille) >= 100 THEN 'passed' ELSE 'inconclusive' END AS decision FROM ({_PAIRS}) GROUP BY scenario)""")
def screening(df: DataFrame) -> DataFrame:
    return M.screening_decision(df.withColumn("scenario", F.col("repetition") % 40)).drop("variance")


@query("top4_upper_median", "v_attempts", sql="SELECT task_id, cost_cents AS median FROM (SELECT task_id, cost_cents, row_number() OVER (PARTITION BY task_id ORDER BY cost_cents) - 1 AS k, count(*) OVER (PARTITION BY task_id) AS n FROM v_attempts) WHERE k = n // 2")
def median(df: DataFrame) -> DataFrame:
    return M.upper_median(df, "task_id", "cost_cents")


@query("agg22_gateway_gate", "v_counters", sql="""WITH e AS (SELECT host || '/' || version AS report, 'latency_ms' AS c, max(latency_ms) AS v FROM v_counters GROUP BY ALL UNION ALL
  SELECT host || '/' || version, 'errors_mille', count(*) FILTER (outcome = 'error') * 1000 // count(*) FROM v_counters GROUP BY ALL UNION ALL
  SELECT host || '/' || version, 'calls', count(*) FROM v_counters WHERE version <> '1.2' GROUP BY ALL),
  r AS (SELECT DISTINCT report FROM e), t AS (SELECT * FROM (VALUES ('latency_ms', 'max', 4990), ('errors_mille', 'max', 120), ('calls', 'min', 500)) AS x(c, k, b)),
  j AS (SELECT r.report, t.c, CASE WHEN e.v IS NULL THEN 'missing' WHEN (k = 'max' AND v <= b) OR (k = 'min' AND v >= b) THEN 'pass' ELSE 'fail' END AS s FROM r CROSS JOIN t LEFT JOIN e ON e.report = r.report AND e.c = t.c)
  SELECT report, CASE WHEN bool_or(s = 'missing') THEN 'insufficient-evidence' WHEN bool_or(s = 'fail') THEN 'no-go' ELSE 'go' END AS decision, coalesce(list_sort(list(c || ':' || s) FILTER (s <> 'pass')), []) AS reasons FROM j GROUP BY report""")
def gateway(df: DataFrame) -> DataFrame:
    report = F.concat_ws("/", "host", "version").alias("report")
    rows = [df.groupBy(report).agg(F.lit("latency_ms").alias("check"), F.max("latency_ms").alias("value")), df.groupBy(report).agg(F.lit("errors_mille").alias("check"), F.expr("count_if(outcome = 'error') * 1000 div count(*)").alias("value")), df.where("version <> '1.2'").groupBy(report).agg(F.lit("calls").alias("check"), F.count("*").alias("value"))]
    bounds = df.sparkSession.createDataFrame([("latency_ms", "max", 4990), ("errors_mille", "max", 120), ("calls", "min", 500)], "check string, kind string, bound long")
    return M.gateway_gate(rows[0].unionByName(rows[1]).unionByName(rows[2]), bounds)
