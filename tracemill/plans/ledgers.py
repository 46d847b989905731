"""Queries over ledgers of two identities, cumulative counters, stated costs, gates and decisions."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import canonical_json, digest
from ..operators import history as H
from ..operators import metrics as M
from ..operators import usage as U
from ..sources import readers as R
from ..sources.shared import shared_folder
from .registry import query

_LEDGER = """SELECT CASE WHEN seq % 3 = 0 THEN 'receipt:' || host || '/' || (seq // 4) ELSE 'event:' || event_key END AS event_key, host, 'r' || (seq // 4) AS receipt_digest, seq % 7 = 0 AS snapshot, seq,
  CASE WHEN seq % 7 = 0 THEN 0 ELSE 1000000000000 END + seq AS place, session_id, client, model, input_tokens FROM v_metrics"""


@query("set1_merge_receipts", "v_metrics", sql=f"""WITH d AS ({_LEDGER}),
  e AS (SELECT event_key, arg_min(host, place) AS host, arg_min(receipt_digest, place) AS receipt_digest, min(place) AS place, arg_min(seq, place) AS seq, count(*) - 1 AS replays, count(DISTINCT (host, receipt_digest, session_id, client, model, input_tokens)) > 1 AS conflict FROM d WHERE event_key LIKE 'event:%' GROUP BY event_key),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, receipt_digest ORDER BY place) AS k FROM d WHERE event_key NOT LIKE 'event:%') WHERE k = 1),
  f AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.host = o.host AND e.receipt_digest = o.receipt_digest AND e.place < o.place))
  SELECT event_key, seq, replays, conflict FROM e UNION ALL SELECT event_key, arg_min(seq, place), count(*) - 1, count(DISTINCT (host, receipt_digest, session_id, client, model, input_tokens)) > 1 FROM f GROUP BY event_key""")
def merged(df: DataFrame) -> DataFrame:
    receipt = F.expr("seq div 4").cast("string")
    key = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("receipt:"), "host", F.lit("/"), receipt)).otherwise(F.concat(F.lit("event:"), "event_key"))
    d = df.select(key.alias("event_key"), "host", F.concat(F.lit("r"), receipt).alias("receipt_digest"), (F.col("seq") % 7 == 0).alias("snapshot"), "seq", "session_id", "client", "model", "input_tokens")
    return M.merge_receipts(d).select("event_key", "seq", "replays", "conflict")


@query("agg3_current_period", "v_metrics", sql="""WITH m AS (SELECT *, input_tokens - inline_tokens AS savings, coalesce(session_id, '<unknown>') AS s, (at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS l FROM v_metrics),
  k AS (SELECT 'day' AS period, strftime(l, '%Y-%m-%d') AS key, * FROM m UNION ALL SELECT 'week', strftime(l, '%G-W%V'), * FROM m UNION ALL SELECT 'month', strftime(l, '%Y-%m'), * FROM m)
  SELECT period, key, count(*) AS events, count(DISTINCT (host, s)) AS sessions, sum(savings)::BIGINT AS savings, false AS current FROM k GROUP BY period, key UNION ALL
  SELECT unnest(['day', 'week', 'month']), unnest(['2031-01-04', '2031-W01', '2031-01']), 0, 0, 0, true""")
def with_current(df: DataFrame) -> DataFrame:
    """A day on which nothing happened yet, past midnight in UTC but not in the zone."""
    return M.metrics_by_period(df, "America/Los_Angeles", "2031-01-05 03:00:00")


_COUNTED = """SELECT *, prompt + output AS total, session_id % 7 = 0 AND turn >= 3 AS again FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no, line_key) AS turn FROM v_usage)"""
_SUMS = ", ".join(f"sum({c}) OVER (PARTITION BY session_id, again ORDER BY turn)::BIGINT AS s_{c}" for c in ("prompt", "cached", "cache_write", "output", "reasoning", "total"))
_RISES = ", ".join(f"s_{c} - coalesce(lag(s_{c}) OVER (PARTITION BY session_id ORDER BY turn), 0) AS r_{c}" for c in ("prompt", "cached", "cache_write", "output", "reasoning", "total"))


@query("win6_turn_usage", "v_usage", sql=f"""WITH c AS ({_COUNTED}), s AS (SELECT *, {_SUMS} FROM c), r AS (SELECT *, {_RISES} FROM s)
  SELECT session_id, turn, 2::BIGINT AS requests, s_total AS total_total, CASE WHEN r_prompt >= 0 THEN r_prompt END AS delta_input, CASE WHEN r_output >= 0 THEN r_output END AS delta_output,
  CASE WHEN least(r_prompt, r_cached, r_cache_write, r_output, r_reasoning, r_total) >= 0 THEN 'complete' ELSE 'incomplete' END AS status,
  turn % 5 <> 0 AND (r_prompt, r_cached, r_cache_write, r_output, r_reasoning, r_total) = (prompt, cached, cache_write, output, reasoning, total) AS reconciled FROM r""")
def turns(df: DataFrame) -> DataFrame:
    """Each turn as two requests, the second told twice; counters of some sessions start anew, some requests have no context window."""
    names = dict(zip(("prompt", "cached", "cache_write", "output", "reasoning", "total"), U.COUNTERS, strict=True))
    d = df.withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_no", "line_key")).cast("long")).withColumn("total", F.col("prompt") + F.col("output")).withColumn("again", (F.col("session_id") % 7 == 0) & (F.col("turn") >= 3))
    w = Window.partitionBy("session_id", "again").orderBy("turn")
    sums = {c: F.sum(c).over(w) for c in names}
    half = {c: F.expr(f"{c} div 2") for c in names}
    told = lambda total, last: F.struct(F.struct(*[total(c).alias(n) for c, n in names.items()]).alias("total"), F.struct(*[last(c).alias(n) for c, n in names.items()]).alias("last"))
    first, second = told(lambda c: F.col(f"s_{c}") - F.col(c) + half[c], lambda c: half[c]), told(lambda c: F.col(f"s_{c}"), lambda c: F.col(c) - half[c])
    d = d.withColumns({f"s_{c}": s for c, s in sums.items()}).select("session_id", "turn", F.posexplode(F.array(first, second, second)).alias("seq", "u"))
    d = d.select("session_id", "turn", "seq", "u.total", "u.last", F.when(F.col("turn") % 5 != 0, 1000).alias("context_window"))
    return U.turn_usage(d, "session_id", "turn").select("session_id", "turn", "requests", "total_total", "delta_input", "delta_output", "status", "reconciled")


@query("prj13_stated_cost", "v_usage", sql="""SELECT line_key, CASE WHEN cost_micro IS NOT NULL THEN p + 1 END::INT AS place, cost_micro::DOUBLE / 1000000 AS usd, cost_micro * 1000 AS nano FROM (SELECT *, (session_id + turn_no) % 11 AS p FROM v_usage)""")
def stated(df: DataFrame) -> DataFrame:
    """A body for each row that states its cost in one of the places, after others that hold no amount."""
    amount = (F.col("cost_micro").cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)").cast("string")
    body = F.lit("{}")
    for k, path in enumerate(U.COST_PATHS):
        opened = "".join(f'"{p}":{{' for p in path.split(".")[:-1])
        decoys = "".join(f'"{p}":{v},' for p, v in zip(U.COST_PATHS[: min(k, 4)], ('"7"', "-1", "null", "[5]"))) + ('"usage":{"total_cost_usd":-0.5},' if k > 5 else "")
        told = F.concat(F.lit("{" + decoys + opened + f'"{path.split(".")[-1]}":'), F.coalesce(amount, F.lit("null")), F.lit("}" * (path.count(".") + 1)))
        body = F.when((F.col("session_id") + F.col("turn_no")) % 11 == k, told).otherwise(body)
    d = df.select("line_key", U.stated_cost(F.parse_json(body)).alias("c"))
    return d.select("line_key", "c.place", "c.usd", "c.nano")


@query("agg6_cost_summary", "v_usage", sql="""WITH d AS (SELECT host, CASE WHEN session_id % 29 = 0 THEN 'row:' || line_key ELSE 's:' || session_id END AS k, at, turn_no, cost_micro * 1000 AS c, session_id % 3 = 0 AND turn_no % 2 = 1 AS whole, CASE session_id % 4 WHEN 0 THEN 'host' WHEN 1 THEN 'log' ELSE 'unknown' END AS src, prompt + output AS tokens FROM v_usage),
  s AS (SELECT host, k, arg_max(c, (at, turn_no)) FILTER (whole AND c IS NOT NULL) AS latest, arg_max(src, (at, turn_no)) FILTER (whole AND c IS NOT NULL) AS latest_src, sum(c)::BIGINT AS total, count(c) = count(*) AS every, list(DISTINCT src) AS srcs, sum(tokens)::BIGINT AS tokens FROM d GROUP BY host, k),
  t AS (SELECT host, k, tokens, CASE WHEN latest IS NOT NULL THEN latest WHEN every THEN total END AS cost, CASE WHEN latest IS NOT NULL THEN [latest_src] WHEN every THEN srcs ELSE [] END AS told FROM s),
  g AS (SELECT host, count(*) AS sessions, count(cost) AS priced_sessions, sum(cost)::HUGEINT AS known, sum(tokens)::HUGEINT AS tokens, list_distinct(flatten(list(told))) AS told FROM t GROUP BY host)
  SELECT host, sessions, priced_sessions, CASE WHEN sessions = priced_sessions THEN known::BIGINT END AS nano, CASE WHEN sessions = priced_sessions THEN 'complete' WHEN priced_sessions > 0 THEN 'partial' ELSE 'unavailable' END AS coverage,
  CASE WHEN len(told) = 1 THEN told[1] WHEN len(told) > 1 THEN 'mixed' ELSE 'unknown' END AS source, CASE WHEN sessions = priced_sessions AND tokens > 0 THEN (known * 1000000 // tokens)::BIGINT END AS nano_per_million FROM g""")
def costs(df: DataFrame) -> DataFrame:
    source = F.when(F.col("session_id") % 4 == 0, "host").when(F.col("session_id") % 4 == 1, "log")
    scope = F.when((F.col("session_id") % 3 == 0) & (F.col("turn_no") % 2 == 1), "session").otherwise("turn")
    d = df.select("host", F.when(F.col("session_id") % 29 != 0, F.col("session_id")).alias("session_id"), F.col("line_key").alias("event_key"), "at", F.col("turn_no").alias("seq"), (F.col("cost_micro") * 1000).alias("cost_nano"), scope.alias("cost_scope"), source.alias("cost_source"), (F.col("prompt") + F.col("output")).alias("total_tokens"))
    return U.reported_cost_summary(d)


def _share_lost(original: pd.Series, preview: pd.Series) -> pd.Series:
    """A judge that raises for some texts and answers nonsense for others."""
    size = original.str.len()
    if (size % 11 == 0).any():
        raise RuntimeError("no answer")
    return (1 - preview.str.len() / size.clip(lower=1)).where(size % 7 != 0, 2.0)


@query("udf2_judge_budget", "conversations", sql="""WITH p AS (SELECT conv_id, turn, text, CASE WHEN turn = 7 THEN 'current-result' WHEN strlen(text) <= 80 THEN 'below-threshold' END AS skip FROM conversations),
  k AS (SELECT text, row_number() OVER (ORDER BY min((conv_id, turn))) AS n FROM p WHERE skip IS NULL GROUP BY text)
  SELECT conv_id, turn, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN n <= 200 AND length(text) % 11 <> 0 AND length(text) % 7 <> 0 THEN 'judged' ELSE 'fallback' END AS status,
  CASE WHEN skip IS NOT NULL THEN skip WHEN n > 200 THEN 'budget' WHEN length(text) % 11 = 0 THEN 'judge-error' WHEN length(text) % 7 = 0 THEN 'invalid-response' END AS reason,
  CASE WHEN skip IS NULL AND n <= 200 AND length(text) % 11 <> 0 AND length(text) % 7 <> 0 THEN CASE WHEN length(text) - least(length(text), 100) >= 0.7 * length(text) THEN 'loss' ELSE 'preserved' END END AS verdict FROM p LEFT JOIN k USING (text)""")
def judged(df: DataFrame) -> DataFrame:
    """Every text against its first 100 characters, with calls for the first 200 pairs."""
    pairs = df.select("conv_id", "turn", F.col("text").alias("original"), F.left("text", F.lit(100)).alias("preview"), (F.col("turn") == 7).alias("is_current"), F.lit(False).alias("is_error"))
    return H.judge_within_budget(pairs, _share_lost, ["conv_id", "turn"], budget=200, least_tokens=21).select("conv_id", "turn", "status", "reason", "verdict")


_HOSTS = ("click", "purchase", "view")
_CHECKS = ", ".join(f"({k}, '{c}', '{kind}', {float(b)})" for k, (c, kind, b) in enumerate(M.GATE_CHECKS))


@query("agg22_gateway_report", "v_counters", sql=f"""WITH n AS (SELECT install_id || '/' || version AS report, host, count(*) AS n FROM v_counters GROUP BY ALL), t AS (SELECT * FROM (VALUES {_CHECKS}) AS x(k, c, kind, b)),
  r AS (SELECT report, c, CASE WHEN (n + k) % 13 = 0 THEN 'missing' WHEN (kind = 'max' AND (n + k) % 5 * 25 - 25 <= b) OR (kind = 'min' AND (n + k) % 5 * 25 >= b) THEN 'pass' ELSE 'fail' END AS s FROM n CROSS JOIN t UNION ALL
    SELECT report, 'all-hosts', CASE WHEN list_sort(list(DISTINCT host)) = {list(_HOSTS)} THEN 'pass' ELSE 'missing' END FROM n GROUP BY report)
  SELECT report, count_if(s = 'pass') AS passed, count_if(s = 'fail') AS failed, count_if(s = 'missing') AS missing, coalesce(list_sort(list(DISTINCT c) FILTER (s <> 'pass')), []) AS reasons,
  CASE WHEN count_if(s = 'missing') > 0 THEN 'insufficient-evidence' WHEN count_if(s = 'fail') > 0 THEN 'no-go' ELSE 'go' END AS decision FROM r GROUP BY report""")
def gate(df: DataFrame) -> DataFrame:
    """A report for each install and version, whose hosts have values that follow from how often they were seen."""
    n = df.groupBy(F.concat_ws("/", "install_id", "version").alias("report"), "host").agg(F.count("*").alias("n"))
    checks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("check"), F.lit(kind == "max").alias("most")) for k, (c, kind, _) in enumerate(M.GATE_CHECKS)])
    rows = n.withColumn("t", F.explode(checks)).withColumn("m", F.col("n") + F.col("t.k"))
    value = F.when(F.col("m") % 13 != 0, F.col("m") % 5 * 25 - F.when(F.col("t.most"), 25).otherwise(0)).cast("double")
    return M.gateway_report(rows.select("report", "host", "t.check", value.alias("value")), _HOSTS)


@query("agg11_screening_report", "v_attempts", sql="""WITH s AS (SELECT task_id AS scenario, scenario % 10 AS repetition, arm, CASE WHEN task_id <> '1-URGENT' OR scenario % 10 <> 3 THEN sum(cost_cents)::BIGINT END AS cost, count_if(passed) * 2 > count(*) AS passed FROM v_attempts GROUP BY task_id, scenario % 10, arm),
  p AS (SELECT scenario, repetition, max(cost) FILTER (arm = 'control') AS c, max(cost) FILTER (arm = 'apply') AS a, max(passed::INT) FILTER (arm = 'control') AS cp, max(passed::INT) FILTER (arm = 'apply') AS ap FROM s GROUP BY ALL),
  g AS (SELECT scenario, count(c + a) FILTER (c > 0) AS pairs, count(c + a) = 10 AS complete, sum(c)::BIGINT AS control, sum(a)::BIGINT AS apply, coalesce(sum(cp), 0)::BIGINT AS control_passed, coalesce(sum(ap), 0)::BIGINT AS apply_passed FROM p GROUP BY scenario),
  h AS (SELECT *, CASE WHEN NOT complete OR control <= 0 THEN 'incomplete' WHEN apply_passed < control_passed THEN 'worse' WHEN 100 * (control - apply) < -5 * control THEN 'dearer' ELSE 'ok' END AS status FROM g),
  z AS (SELECT NULL AS scenario, sum(pairs)::BIGINT AS pairs, bool_and(complete AND pairs = 10) AS complete, sum(control)::BIGINT AS control, sum(apply)::BIGINT AS apply, sum(control_passed)::BIGINT AS control_passed, sum(apply_passed)::BIGINT AS apply_passed, bool_and(status = 'ok') AS fine FROM h)
  SELECT *, CASE WHEN complete AND control > 0 THEN floor((control - apply) * 1000 / control)::BIGINT END AS reduction_mille FROM (SELECT * FROM h UNION ALL
    SELECT * EXCLUDE (fine), CASE WHEN NOT complete THEN 'inconclusive' WHEN fine AND 100 * (control - apply) >= 10 * control THEN 'passed' ELSE 'failed' END FROM z)""")
def screened(df: DataFrame) -> DataFrame:
    """Ten repetitions of each task; the cost of one is unknown."""
    n = F.count("*")
    s = df.groupBy(F.col("task_id").alias("scenario"), (F.col("scenario") % 10).alias("repetition"), "arm").agg(F.sum("cost_cents").alias("sum"), (F.count_if("passed") * 2 > n).alias("passed"))
    s = s.withColumn("cost", F.when((F.col("scenario") != "1-URGENT") | (F.col("repetition") != 3), F.col("sum")))
    return M.screening_report(s.drop("sum"), 10).drop("mean_reduction", "variance")


@query("src4_checked_profiles", "part", sql="SELECT 'part' || p_partkey AS profile_id, p_size * 1000 AS threshold FROM part")
def checked(df: DataFrame) -> DataFrame:
    """Profiles written with keys in another order and with white space, loaded against the digests of their canonical form."""
    folder = shared_folder(df.sparkSession)
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    rates = lambda n: F.struct(*[(cents * n / 100).cast("decimal(18,2)").alias(p) for p in ("write", "output", "fresh", "read")])
    profile = F.struct(rates(2).alias("long"), (F.col("p_size") * 1000).cast("long").alias("threshold"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("profile_id"), rates(1).alias("short"), F.lit(False).alias("regional"), F.lit("standard").alias("service"), F.col("p_type").alias("model"), F.col("p_brand").alias("provider"))
    d = df.select(F.expr("p_partkey div 500").alias("file"), profile.alias("p"))
    d.groupBy("file").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json("p")), " ,\n"), F.lit("\n]")).alias("value")).write.partitionBy("file").text(folder)
    digests = d.select("p.profile_id", digest(canonical_json(F.to_json("p"))).alias("digest"))
    return R.load_pricing(df.sparkSession, f"{folder}/*/*", digests).select("profile_id", "threshold")
