"""Log-shaped views derived from the given tables, in SQL that Spark and DuckDB share.

Integer arithmetic only, so both engines agree bit for bit. In the shared text, DIV is integer division, sha2(x, 256) the SHA-256 in
hex and ARRAY_RANGE(n) the numbers 1..n.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_USAGE = """SELECT l_orderkey AS session_id, l_linenumber AS turn_no, l_returnflag AS host, l_shipdate AS at, l_linestatus AS model, concat(cast(l_orderkey AS string), '|', cast(l_linenumber AS string), '|', cast(l_partkey AS string), '|', cast(l_suppkey AS string), '|', l_linestatus, '|', cast(cast(floor(l_extendedprice) AS bigint) AS string),
  '|', cast(cast(round(l_discount * 100) AS int) AS string), '|', cast(cast(round(l_tax * 100) AS int) AS string), '|', cast(cast(l_quantity AS bigint) AS string)) AS line_key,
  cast(floor(l_extendedprice) AS bigint) AS prompt,
  cast(floor(l_extendedprice) AS bigint) * cast(round(l_discount * 100) AS int) DIV 100 AS cached,
  cast(floor(l_extendedprice) AS bigint) * cast(round(l_tax * 100) AS int) DIV 100 AS cache_write,
  cast(l_quantity AS bigint) * 10 AS output, cast(l_quantity AS bigint) * 10 DIV 4 AS reasoning,
  CASE WHEN l_suppkey % 2 = 0 THEN 'control' ELSE 'apply' END AS arm,
  CASE WHEN l_partkey % 9 <> 0 THEN l_partkey % 5 END AS tool_calls,
  CASE WHEN l_partkey % 4 <> 0 THEN (l_partkey % 100) * 10000 END AS cost_micro
  FROM lineitem"""
VIEWS = {
    "v_usage": _USAGE,
    "v_requests": f"""SELECT sha2(line_key, 256) AS request_key, session_id, arm, turn_no * 10 + copy AS seq,
  'openai' AS provider, CASE WHEN model = 'O' THEN 'large' ELSE 'small' END AS model, CASE WHEN session_id % 13 = 0 THEN 'batch' ELSE 'standard' END AS service,
  CASE WHEN session_id % 11 = 0 THEN NULL ELSE false END AS regional, prompt * 8 AS input, cached * 8 AS cached, cache_write * 8 AS cache_write,
  output + CASE WHEN copy = 2 AND session_id % 17 = 0 THEN 1 ELSE 0 END AS output, reasoning, CASE WHEN session_id % 19 = 0 THEN 'incomplete' ELSE 'complete' END AS quality
  FROM ({_USAGE}) u JOIN (SELECT 1 AS copy UNION ALL SELECT 2 AS copy) c ON copy = 1 OR session_id % 10 = 0 OR session_id % 17 = 0""",
    "v_prices": """SELECT * FROM (VALUES
  ('large-2026', 'openai', 'large', 'standard', false, 272000, 2000, 200, 2500, 10000, 4000, 400, 5000, 15000),
  ('small-2026', 'openai', 'small', 'standard', false, 272000, 400, 40, 500, 1600, 800, 80, 1000, 2400)) AS t(
  profile_id, provider, model, service, regional, threshold, short_fresh, short_read, short_write, short_output, long_fresh, long_read, long_write, long_output)""",
    "v_metrics": """SELECT cast(event_id - CASE WHEN event_id % 20 = 19 THEN 1 ELSE 0 END AS string) AS event_key, event_id AS seq, ts AS at, event_type AS host,
  CASE WHEN event_id % 50 <> 0 THEN cast(user_id AS string) END AS session_id, concat('client', cast(user_id % 3 AS string)) AS client, concat('m', cast(event_id % 4 AS string)) AS model,
  cast(floor(abs(value) * 100) AS bigint) AS input_tokens, least(cast(floor(abs(value) * 100) AS bigint), 4096 + event_id % 7) AS inline_tokens,
  CASE WHEN user_id % 5 = 0 THEN event_id % 10 END AS provider_savings FROM events""",
    "v_counters": """SELECT ts AS at, cast(ts AS date) AS day_utc, concat('1.', cast(user_id % 3 AS string)) AS version, event_type AS host, event_id % 3 = 0 AS routed,
  concat('reason', cast((event_id * 7) DIV 3 % 7 AS string)) AS reason, concat('install', cast(user_id AS string)) AS install_id, event_id,
  cast(floor(abs(value) * 100) AS bigint) % 5000 AS latency_ms, CASE WHEN event_id % 6 <> 0 THEN event_id % 40 END AS result_count,
  CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'ok' END AS outcome, event_id % 2 = 0 AS transformed FROM events""",
    "v_attempts": """SELECT 'b1' AS benchmark_id, o_orderpriority AS task_id, CASE WHEN o_custkey % 2 = 0 THEN 'control' ELSE 'apply' END AS arm, o_orderkey AS repetition,
  o_custkey % 97 AS scenario, o_orderstatus <> 'F' AS passed, o_orderkey % 37 <> 0 AS verified, 1 + o_orderkey % 3 AS attempts, cast(floor(o_totalprice) AS bigint) AS cost_cents,
  CASE WHEN o_orderkey % 41 <> 0 THEN o_custkey % 1000 END AS duration_ms, CASE WHEN o_orderkey % 4 <> 3 THEN o_custkey % 7 END AS cache_read FROM orders""",
    "v_results": """SELECT doc_id AS result_id, CASE doc_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'grep' WHEN 2 THEN 'bash' ELSE 'other' END AS tool,
  concat(source, CASE doc_id % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.py' ELSE '.json' END) AS path, text AS output, source AS workspace,
  CASE doc_id % 5 WHEN 0 THEN concat('cat ', source, '.py') WHEN 1 THEN concat('sed -n 1,20p ', source, '.json') WHEN 2 THEN concat('cat ', source, '.log | wc -l')
    WHEN 3 THEN 'npm test' ELSE concat('head -5 "', source, '.py"') END AS command FROM documents""",
    "v_history": """SELECT conv_id AS request_id, turn AS position, 0 AS ordinal, concat(cast(conv_id AS string), '-', cast(turn - CASE WHEN conv_id % 7 = 0 AND turn = 3 THEN 1 ELSE 0 END AS string)) AS call_id,
  CASE WHEN turn % 5 = 4 THEN 'bash' WHEN conv_id % 3 = 0 THEN 'grep' ELSE 'read' END AS tool, concat('src/f', cast(turn % 2 AS string), '.py') AS path,
  CASE WHEN turn % 3 <> 2 THEN turn * 10 % 40 END AS lo, CASE WHEN turn % 3 <> 2 THEN turn * 10 % 40 + 20 + turn END AS hi,
  CASE WHEN turn % 4 = 1 THEN 'No output.' WHEN conv_id % 5 = 0 THEN role ELSE text END AS output, turn % 11 = 10 AS is_error,
  turn = max(turn) OVER (PARTITION BY conv_id) AS is_current FROM conversations""",
    "v_turns": """SELECT user_id AS session_id, turn, ts AS at, CASE WHEN k % 4 = 0 THEN 0 ELSE k * 10 END AS cached, CASE WHEN k % 5 = 0 THEN k * 20 ELSE 0 END AS cache_write,
  k * 30 AS prompt, cast(k DIV 60 AS string) AS tools_digest, cast(k DIV 80 AS string) AS system_digest, turn % 6 + k % 3 AS message_count, k DIV 70 AS branch, k % 8 <> 0 AS breakpoint
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, cast(floor(abs(value) * 100) AS bigint) % 100 AS k FROM events) e""",
}


def duck(sql: str) -> str:
    """The shared text as DuckDB reads it."""
    sql = re.sub(r"\bAS at\b", 'AS "at"', sql)
    return re.sub(r"sha2\((.*?), 256\)", r"sha256(\1)", sql.replace(" DIV ", " // "), flags=re.S)


def with_views(sql: str) -> str:
    """A DuckDB query with the views it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    sql = re.sub(r"(?<![\w\".'])at(?![\w\"'])", '"at"', sql)
    head = ", ".join(f"{v} AS ({duck(VIEWS[v])})" for v in used)
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {head}, {sql[5:]}" if head else sql
    return f"WITH {head} {sql}" if head else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a table by its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, tables = VIEWS[name], {}
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b", sql):
            sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **tables)
