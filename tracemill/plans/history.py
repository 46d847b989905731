"""Queries over conversation history, prompt caches, request bytes and stored originals."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import estimate_tokens
from ..operators import artifacts as A
from ..operators import cache as C
from ..operators import compaction as K
from ..operators import history as H
from ..operators.telemetry import footprint_telemetry
from .registry import query

TOKENS = "((strlen(output) + 3) // 4)::BIGINT"


def with_input(df: DataFrame) -> DataFrame:
    """Adds the call's input as a digest of path and range."""
    return df.withColumn("input", F.concat_ws(":", "path", F.col("lo").cast("string"), F.col("hi").cast("string")))


@query("jn1_pair_calls", "v_history", sql="""SELECT request_id, call_id, tool, strlen(output)::BIGINT AS bytes FROM v_history h WHERE (SELECT count(*) FROM v_history x WHERE x.request_id = h.request_id AND x.call_id = h.call_id) = 1""")
def pairs(df: DataFrame) -> DataFrame:
    p = H.pair_calls(df.select("request_id", "call_id", "tool"), df.select("request_id", "call_id", "output"))
    return p.select("request_id", "call_id", "call.tool", F.octet_length("result.output").cast("long").alias("bytes"))


_OLD = """SELECT request_id, path, position, ordinal::INT AS ordinal FROM v_history o WHERE tool = 'read' AND NOT is_error AND NOT is_current AND EXISTS (SELECT 1 FROM v_history n WHERE n.request_id = o.request_id AND n.path = o.path AND n.tool = 'read' AND NOT n.is_error
  AND lower(trim(n.output)) NOT IN ('command completed successfully with no output.', 'no output.', '(no output)') AND n.position > o.position AND (n.lo IS NULL OR (o.lo IS NOT NULL AND n.lo <= o.lo AND n.hi >= o.hi)))"""


@query("jn2_superseded_reads", "v_history", sql=_OLD)
def superseded(df: DataFrame) -> DataFrame:
    return H.superseded_reads(df)


_DUP = """SELECT request_id, position, ordinal::INT AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY request_id, tool, path, lo, hi, output ORDER BY position DESC) AS k FROM v_history WHERE NOT is_error) WHERE k > 1 AND NOT is_current AND strlen(output) > {0}"""


@query("win7_dedupe_history", "v_history", sql=_DUP.format(3).replace("path, lo, hi, ", ""))
def dups(df: DataFrame) -> DataFrame:
    return H.duplicate_results(df.withColumn("input", F.lit("")), 3)


@query("win3_suffix_tokens", "v_history", sql=f"SELECT request_id, position, coalesce(sum({TOKENS}) OVER (PARTITION BY request_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS suffix_tokens FROM v_history")
def suffixes(df: DataFrame) -> DataFrame:
    return H.suffix_tokens(df.withColumn("tokens", estimate_tokens(F.col("output")))).select("request_id", "position", "suffix_tokens")


@query("win4_cache_guard", "v_history", sql=f"""SELECT request_id, position, request_id % 3 <> 0 AND s > 0 AND 100 * t < 51 * s AS held FROM (SELECT request_id, position, {TOKENS} AS t,
  coalesce(sum({TOKENS}) OVER (PARTITION BY request_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS s FROM v_history)""")
def guard(df: DataFrame) -> DataFrame:
    d = H.suffix_tokens(df.withColumn("tokens", estimate_tokens(F.col("output"))))
    return d.select("request_id", "position", H.cache_guard(F.col("tokens"), F.col("suffix_tokens"), F.col("request_id") % 3 != 0, F.lit(60)).alias("held"))


@query("win5_idle_gap", "v_turns", sql="SELECT session_id, turn::INT AS turn, (epoch(date_trunc('second', at)) - epoch(date_trunc('second', lag(at) OVER (PARTITION BY session_id ORDER BY turn))))::BIGINT AS idle_s FROM v_turns")
def gaps(df: DataFrame) -> DataFrame:
    return H.idle_gap(df).select("session_id", "turn", "idle_s")


@query("win8_retain_recent", "v_history", sql="SELECT request_id, position FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY position DESC) AS k FROM v_history) WHERE k > 3")
def recent(df: DataFrame) -> DataFrame:
    return H.retain_recent(df).select("request_id", "position")


@query("prj16_history_candidates", "v_history", sql=f"""SELECT request_id, position, row_number() OVER (PARTITION BY request_id ORDER BY position, t DESC, call_id)::INT AS rank FROM (SELECT *, {TOKENS} AS t, sum({TOKENS}) OVER (PARTITION BY request_id) AS b, count(*) OVER (PARTITION BY request_id, call_id) AS n FROM v_history)
  WHERE b * 5 > 300 * 4 AND NOT is_current AND NOT is_error AND n = 1 AND t > 0""")
def candidates(df: DataFrame) -> DataFrame:
    return H.history_candidates(df.withColumn("tokens", estimate_tokens(F.col("output"))), 300).select("request_id", "position", "rank")


_PREVIEW = "(SELECT *, CASE WHEN position % 3 = 0 THEN left(output, 40) || ' sha256:0123456789abcdef' WHEN position % 3 = 1 THEN left(output, 60) ELSE output END AS preview FROM v_history)"


def previews(df: DataFrame) -> DataFrame:
    short = F.when(F.col("position") % 3 == 0, F.concat(F.left("output", F.lit(40)), F.lit(" sha256:0123456789abcdef"))).when(F.col("position") % 3 == 1, F.left("output", F.lit(60))).otherwise(F.col("output"))
    return H.original_vs_preview(df, df.withColumn("output", short), ["request_id", "position"])


@query("jn6_original_vs_preview", "v_history", sql=f"SELECT request_id, position, regexp_matches(preview, 'sha256:[0-9a-f]{{16}}') AS recoverable FROM {_PREVIEW} WHERE preview <> output")
def changed(df: DataFrame) -> DataFrame:
    return previews(df).select("request_id", "position", "recoverable")


@query("jn7_restore_losses", "v_history", sql=f"SELECT request_id, position, (position % 10) / 10 >= 0.7 AS restored, strlen(CASE WHEN (position % 10) / 10 >= 0.7 THEN output ELSE preview END)::BIGINT AS bytes FROM {_PREVIEW} WHERE preview <> output")
def restored(df: DataFrame) -> DataFrame:
    judged = df.select("request_id", "position", ((F.col("position") % 10) / 10).alias("probability"))
    return H.restore_losses(previews(df), judged, ["request_id", "position"]).select("request_id", "position", "restored", F.octet_length("output").cast("long").alias("bytes"))


@query("pipe_compact_history", "v_history")
def compacted(df: DataFrame) -> DataFrame:
    return H.compact_history(with_input(df), budget=2000).select("request_id", "position", "reason", F.sha2("output", 256).alias("digest"))


@query("agg25_history_stats", "v_history")
def stats(df: DataFrame) -> DataFrame:
    return H.history_stats(H.compact_history(with_input(df), budget=2000))


def _bodies(df: DataFrame, shape: str) -> DataFrame:
    """Request bodies of one shape, one for each conversation."""
    call, result = F.concat(F.lit("c"), F.col("turn").cast("string")), F.col("text")
    if shape == "anthropic":
        parts = F.array(
            F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("tool_use").alias("type"), call.alias("id"), F.lit("Read").alias("name"), F.struct(F.lit("a.py").alias("path")).alias("input"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content"))).alias("content")),
            F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<path:string>").alias("input"), call.alias("tool_use_id"), result.alias("content"))).alias("content")),
        )
    else:
        parts = F.array(F.struct(F.lit("function_call").alias("type"), call.alias("call_id"), F.lit("exec").alias("name"), F.lit("{}").alias("arguments"), F.lit(None).cast("string").alias("output")), F.struct(F.lit("function_call_output").alias("type"), call.alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), result.alias("output")))
    rows = df.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", parts.alias("p")))), lambda s: s.p)).alias("rows"), F.max("role").alias("system"))
    name = "messages" if shape == "anthropic" else "input"
    tools = F.array(F.struct(F.lit("own_find").alias("name")), F.struct(F.lit("mcp__x").alias("name")), F.struct(F.lit("Read").alias("name")))
    return rows.select(F.concat_ws("/", F.lit(shape), F.col("conv_id").cast("string")).alias("request_id"), F.to_json(F.struct(F.col("rows").alias(name), "system", tools.alias("tools"), F.lit("m").alias("model"))).alias("body"))


def bodies(df: DataFrame) -> DataFrame:
    return _bodies(df, "anthropic").unionByName(_bodies(df, "responses"))


@query("prj10_detect_provider", "conversations", sql="SELECT 'anthropic/' || conv_id AS request_id, 'anthropic' AS provider FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'responses/' || conv_id, 'openai-responses' FROM (SELECT DISTINCT conv_id FROM conversations)")
def providers(df: DataFrame) -> DataFrame:
    return bodies(df).select("request_id", H.detect_provider(F.try_parse_json("body")).alias("provider"))


@query("jsn2_collect_items", "conversations", sql="""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT 'anthropic/' AS s UNION ALL SELECT 'responses/')
  SELECT s || conv_id AS request_id, (2 * k)::INT AS position, 'call' AS kind, 'c' || turn AS call_id, NULL::VARCHAR AS output, false AS is_current FROM t, s UNION ALL
  SELECT s || conv_id, (2 * k + 1)::INT, 'result', 'c' || turn, text, k = n - 1 FROM t, s""")
def items(df: DataFrame) -> DataFrame:
    return H.collect_items(bodies(df)).select("request_id", "position", "kind", "call_id", "output", "is_current")


def agent_requests(df: DataFrame) -> DataFrame:
    """A request for each conversation: every turn is a call, of Read (whole files and ranges of two) or Bash, and its result."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    d = df.withColumn("k", k)
    bash, whole, call = F.col("k") % 5 == 4, F.col("k") % 3 == 2, F.concat(F.lit("c"), F.col("k").cast("string"))
    given = F.when(bash, F.struct(F.lit("make").alias("command"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")))
    path = F.concat(F.lit("src/f"), (F.col("k") % 2).cast("string"), F.lit(".py"))
    span = lambda x: F.when(~whole, x).cast("int")
    given = given.otherwise(F.struct(F.lit(None).cast("string").alias("command"), path.alias("path"), span(F.col("k") * 10 % 40).alias("start_line"), span(F.col("k") * 10 % 40 + 20 + F.col("k")).alias("end_line")))
    output = F.when(F.col("k") % 4 == 1, "No output.").when(F.col("conv_id") % 5 == 0, F.concat("role", F.lit(" said nothing that is of any use here"))).otherwise(F.col("text"))
    use = F.struct(F.lit("tool_use").alias("type"), call.alias("id"), F.when(bash, "Bash").otherwise("Read").alias("name"), given.alias("input"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content"))
    result = F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(given_type).alias("input"), call.alias("tool_use_id"), output.alias("content"))
    turn = F.array(F.struct(F.lit("assistant").alias("role"), F.array(use).alias("content")), F.struct(F.lit("user").alias("role"), F.array(result).alias("content")))
    rows = d.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", turn.alias("t")))), lambda s: s.t)).alias("messages"))
    return rows.select(F.col("conv_id").alias("request_id"), F.to_json(F.struct("messages")).alias("body"))


given_type = "struct<command:string,path:string,start_line:int,end_line:int>"
_AGENT = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
  c AS (SELECT conv_id, k, k % 5 = 4 AS bash, k % 2 AS path, CASE WHEN k % 3 <> 2 THEN k * 10 % 40 END AS lo, CASE WHEN k % 3 <> 2 THEN k * 10 % 40 + 20 + k END AS hi, k = n - 1 AS cur,
    CASE WHEN k % 4 = 1 THEN 'No output.' WHEN conv_id % 5 = 0 THEN role || ' said nothing that is of any use here' ELSE text END AS output FROM t),
  e AS (SELECT *, regexp_matches(output, '(?i)^\\s*(error|failed|failure)\\b') AS bad, output = 'No output.' AS useless FROM c),
  s AS (SELECT *, NOT bash AND NOT cur AND NOT bad AND EXISTS (SELECT 1 FROM e x WHERE x.conv_id = e.conv_id AND NOT x.bash AND x.path = e.path AND NOT x.bad AND NOT x.useless AND x.k > e.k AND (x.lo IS NULL OR (e.lo IS NOT NULL AND x.lo <= e.lo AND x.hi >= e.hi))) AS old FROM e),
  u AS (SELECT *, NOT old AND NOT cur AND NOT bad AND useless AS none FROM s),
  v AS (SELECT *, CASE WHEN old THEN '[superseded by a newer read]' WHEN none THEN '[useless success left out]' ELSE output END AS now FROM u),
  w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, bash, CASE WHEN NOT bash THEN path END, CASE WHEN NOT bash THEN lo END, CASE WHEN NOT bash THEN hi END, now, bad ORDER BY k DESC) > 1 AND NOT cur AND NOT bad AND strlen(to_json([now])::VARCHAR) > 28 AS dup FROM v)
  SELECT conv_id AS request_id, count_if(old) AS superseded_read, count_if(none) AS useless_success, count_if(dup) AS duplicate_history,
    (sum(CASE WHEN old OR none THEN strlen(output) ELSE 0 END) + sum(CASE WHEN dup THEN strlen(now) ELSE 0 END))::BIGINT AS told_bytes,
    (sum(CASE WHEN old THEN 28 WHEN none THEN 26 ELSE 0 END) + sum(CASE WHEN dup THEN 24 ELSE 0 END))::BIGINT AS shown_bytes FROM w GROUP BY conv_id"""


@query("agg25_request_stats", "conversations", sql=_AGENT)
def request_stats(df: DataFrame) -> DataFrame:
    """Superseded, empty and duplicate results of whole requests; nothing is cached here, so the guard holds nothing back."""
    policy = K.Policy(stages=frozenset({"superseded-read", "useless-success", "duplicate-history"}), duplicate="[same as a newer answer]")
    stats = K.compaction_stats(K.compact_requests(K.request_results(agent_requests(df)), policy))
    return stats.select("request_id", "superseded_read", "useless_success", "duplicate_history", "told_bytes", "shown_bytes")


@query("pipe_compact_requests", "conversations")
def compacted_requests(df: DataFrame) -> DataFrame:
    """All stages with a budget of tokens and the guard, every other request with a cache mark."""
    marked = F.when(F.col("request_id") % 2 == 0, F.regexp_replace("body", r"\}\]\}\]\}$", ',"cache_control":{"type":"ephemeral"}}]}]}')).otherwise(F.col("body"))
    rows = K.compact_requests(K.request_results(agent_requests(df).withColumn("body", marked)), K.Policy(budget=100, stages=frozenset(K.STAGES), archive_bytes=400, percent=30))
    return K.compaction_stats(rows)


#: The bodies of the test view as SQL: JSON of each message (keys in order), two for each turn, of both shapes.
_MESSAGES = """t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, max(role) OVER (PARTITION BY conv_id) AS system FROM conversations),
  m AS (SELECT 'anthropic/' || conv_id AS request_id, system, 2 * k AS k, '{"content":[{"id":"c' || turn || '","input":{"path":"a.py"},"name":"Read","type":"tool_use"}],"role":"assistant"}' AS j FROM t UNION ALL
    SELECT 'anthropic/' || conv_id, system, 2 * k + 1, '{"content":[{"content":' || to_json(text)::VARCHAR || ',"tool_use_id":"c' || turn || '","type":"tool_result"}],"role":"user"}' FROM t UNION ALL
    SELECT 'responses/' || conv_id, system, 2 * k, '{"arguments":"{}","call_id":"c' || turn || '","name":"exec","type":"function_call"}' FROM t UNION ALL
    SELECT 'responses/' || conv_id, system, 2 * k + 1, '{"call_id":"c' || turn || '","output":' || to_json(text)::VARCHAR || ',"type":"function_call_output"}' FROM t)"""


@query("jsn3_classify_context", "conversations", sql=f"""WITH {_MESSAGES}, r AS (SELECT request_id, any_value(system) AS system, count(*) AS n FROM m GROUP BY request_id)
  SELECT request_id, 0 AS seq, 'host-instructions' AS category, strlen(system)::BIGINT + 2 AS bytes FROM r UNION ALL SELECT request_id, 1, 'own-tools', 19 FROM r UNION ALL SELECT request_id, 2, 'mcp-tools', 17 FROM r UNION ALL
  SELECT request_id, 3, 'builtin-tools', 15 FROM r UNION ALL SELECT request_id, (4 + k)::INT, 'history', strlen(j)::BIGINT FROM m UNION ALL SELECT request_id, (4 + n)::INT, 'provider-overhead', 3 FROM r""")
def segments(df: DataFrame) -> DataFrame:
    return C.classify_context(bodies(df))


@query("jsn5_message_digests", "conversations", sql=f"""WITH {_MESSAGES} SELECT request_id, count(*)::INT AS n, sha256(string_agg(sha256(j), ',' ORDER BY k)) AS messages_digest,
  sha256('[{{"name":"own_find"}},{{"name":"mcp__x"}},{{"name":"Read"}}]') AS tools_digest, sha256('"' || any_value(system) || '"') AS system_digest, false AS breakpoint FROM m GROUP BY request_id""")
def digests(df: DataFrame) -> DataFrame:
    d = C.message_digests(bodies(df))
    return d.select("request_id", F.size("messages").alias("n"), F.sha2(F.concat_ws(",", "messages"), 256).alias("messages_digest"), "tools_digest", "system_digest", "breakpoint")


@query("jsn6_extract_usage", "v_usage", sql="SELECT session_id, turn_no, prompt::VARCHAR AS input_tokens, (output + 1)::VARCHAR AS output_tokens FROM v_usage")
def usage(df: DataFrame) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit('data: {"usage":{"input_tokens":'), s("prompt"), F.lit(',"output_tokens":1}}\n\ndata: {"usage": {"output_tokens":'), (F.col("output") + 1).cast("string"), F.lit("}}\n"))
    d = C.extract_usage(df.withColumn("text", text))
    return d.select("session_id", "turn_no", d.usage["input_tokens"].alias("input_tokens"), d.usage["output_tokens"].alias("output_tokens"))


@query("jsn6_extract_nested_usage", "v_usage", sql="""SELECT session_id, turn_no, prompt::VARCHAR AS input_tokens, output::VARCHAR AS output_tokens,
  '{"cached":' || cached || ',"by":{"kind":"a}b"}}' AS details FROM v_usage""")
def nested_usage(df: DataFrame) -> DataFrame:
    """Objects in objects, braces and quotes in strings, a key that a later event replaces, an event cut off at the end."""
    s = lambda c: F.col(c).cast("string")
    first = F.concat(F.lit('event: start\ndata: {"message":{"note":"say \\"usage\\": {","usage":{"input_tokens":'), s("prompt"), F.lit(',"details":{"cached":0},"output_tokens":1}}}\n\n'))
    last = F.concat(F.lit('data: {"usage" : {"details":{"cached":'), s("cached"), F.lit(',"by":{"kind":"a}b"}},"output_tokens":'), s("output"), F.lit('}}\n\ndata: {"usage":{"output_tokens":"cut'))
    d = C.extract_usage(df.withColumn("text", F.concat(first, last)))
    return d.select("session_id", "turn_no", *[d.usage[k].alias(k) for k in ("input_tokens", "output_tokens", "details")])


_SEGMENTS = "(SELECT conv_id AS request_id, turn AS seq, CASE role WHEN 'user' THEN 'user-prompt' WHEN 'system' THEN 'host-instructions' ELSE 'history' END AS category, strlen(text)::BIGINT AS bytes, sum(strlen(text)) OVER (PARTITION BY conv_id)::BIGINT - conv_id % 5 * 40 + 60 AS body_bytes FROM conversations)"


def role_segments(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("role") == "user", "user-prompt").when(F.col("role") == "system", "host-instructions").otherwise("history")
    size = F.octet_length("text").cast("long")
    body = F.sum(size).over(Window.partitionBy("conv_id")) - F.col("conv_id") % 5 * 40 + 60
    return df.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), kind.alias("category"), size.alias("bytes"), body.alias("body_bytes"))


@query("win10_budget_clip", "conversations", sql=f"SELECT request_id, seq, greatest(0, least(bytes, body_bytes - coalesce(sum(bytes) OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS clipped FROM {_SEGMENTS}")
def clip(df: DataFrame) -> DataFrame:
    return C.budget_clip(role_segments(df)).select("request_id", "seq", "clipped")


_FOOT = f"""SELECT request_id, sum(bytes) FILTER (category = 'user-prompt') AS u, sum(bytes) FILTER (category = 'host-instructions') AS h, sum(bytes) FILTER (category = 'history') AS o, any_value(body_bytes) AS body_bytes, count(*) AS segments, sum(bytes) AS attributed FROM {_SEGMENTS} GROUP BY request_id"""
_ZERO = ", ".join(f"0::BIGINT AS {c}" for c in ("own_tools", "deferred_tools", "mcp_tools", "builtin_tools", "provider_overhead"))


def _foot(df: DataFrame) -> DataFrame:
    s = role_segments(df)
    return C.footprint_by_category(s.drop("body_bytes"), s.select("request_id", "body_bytes").distinct())


@query("agg14_footprint_by_category", "conversations", sql=f"""SELECT request_id, coalesce(h, 0)::BIGINT AS host_instructions, {_ZERO}, coalesce(u, 0)::BIGINT AS user_prompt, coalesce(o, 0)::BIGINT AS history, greatest(0, body_bytes - attributed)::BIGINT AS unknown, segments, body_bytes,
  ((body_bytes + 3) // 4)::BIGINT AS tokens, CASE WHEN body_bytes > attributed THEN 'partial' ELSE 'complete' END AS status FROM ({_FOOT})""")
def footprint(df: DataFrame) -> DataFrame:
    return _foot(df)


@query("agg26_footprint_telemetry", "conversations", sql=f"""SELECT unknown_share, body_size, input_tokens, count(*) AS n FROM (SELECT CASE WHEN x = 0 THEN 'zero' WHEN 100 * x <= body_bytes THEN 'lt_1pct' WHEN 10 * x <= body_bytes THEN '1_to_10pct' ELSE 'gt_10pct' END AS unknown_share,
  CASE WHEN body_bytes < 4096 THEN 'lt_4k' WHEN body_bytes < 16384 THEN '4_to_16k' WHEN body_bytes < 65536 THEN '16_to_64k' WHEN body_bytes < 262144 THEN '64_to_256k' WHEN body_bytes < 1048576 THEN '256k_to_1m' ELSE 'gte_1m' END AS body_size,
  CASE WHEN t = 0 THEN 'zero' WHEN t = 1 THEN 'one' WHEN t <= 5 THEN '2_to_5' WHEN t <= 20 THEN '6_to_20' WHEN t <= 100 THEN '21_to_100' ELSE 'gt_100' END AS input_tokens
  FROM (SELECT *, greatest(0, body_bytes - attributed) AS x, (body_bytes + 3) // 4 AS t FROM ({_FOOT}))) GROUP BY ALL""")
def foot_telemetry(df: DataFrame) -> DataFrame:
    return footprint_telemetry(_foot(df))


def with_messages(df: DataFrame) -> DataFrame:
    seq = F.transform(F.sequence(F.lit(1), F.greatest(F.col("message_count").cast("int"), F.lit(1))), lambda i: F.concat(F.lit("m"), F.col("branch").cast("string"), F.lit("-"), i.cast("string")))
    return df.withColumn("messages", seq)


_TURNS = """SELECT t.*, lag(tools_digest) OVER w AS pt, lag(system_digest) OVER w AS ps, lag(branch) OVER w AS pb, greatest(lag(message_count) OVER w, 1) AS pm, greatest(message_count, 1) AS m, lag(at) OVER w AS pat FROM v_turns t WINDOW w AS (PARTITION BY session_id ORDER BY turn)"""
_SPLIT = "CASE WHEN pb IS NULL THEN NULL WHEN pb <> branch THEN 0 WHEN m < pm THEN m END"
_CAUSE = f"""CASE WHEN cached > 0 THEN NULL WHEN pt IS NULL THEN 'cold-start' WHEN pt <> tools_digest THEN 'tools-changed' WHEN ps <> system_digest THEN 'system-changed' WHEN {_SPLIT} IS NOT NULL THEN 'history-rewritten' WHEN NOT breakpoint THEN 'no-breakpoint'
  WHEN prompt > 0 AND prompt < 1024 THEN 'below-minimum' WHEN epoch(date_trunc('second', at)) - epoch(date_trunc('second', pat)) > 3600 THEN 'ttl-expired' ELSE 'unexplained' END"""


@query("win1_cache_miss_cause", "v_turns", sql=f"SELECT session_id, turn::INT AS turn, cached > 0 AS hit, {_CAUSE} AS cause FROM ({_TURNS})")
def causes(df: DataFrame) -> DataFrame:
    return C.cache_miss_cause(with_messages(df)).select("session_id", "turn", "hit", "cause")


@query("win2_first_divergence", "v_turns", sql=f"SELECT session_id, turn::INT AS turn, ({_SPLIT})::INT AS divergence FROM ({_TURNS})")
def divergence(df: DataFrame) -> DataFrame:
    return C.cache_miss_cause(with_messages(df)).select("session_id", "turn", "divergence")


@query("agg15_cache_session_summary", "v_turns", sql=f"""SELECT session_id, count(*) AS turns, count(*) FILTER (cause IS NULL) AS hits, count(cause) AS misses, {", ".join(f"count(*) FILTER (cause = '{c}') AS {c.replace('-', '_')}" for c in C.CAUSES)}, sum(cached)::BIGINT AS read, sum(cache_write)::BIGINT AS written,
  CASE WHEN sum(cached) > 0 THEN floor(sum(cache_write) * 1000 / sum(cached))::BIGINT END AS ratio_mille FROM (SELECT *, {_CAUSE} AS cause FROM ({_TURNS})) GROUP BY session_id""")
def summary(df: DataFrame) -> DataFrame:
    return C.cache_session_summary(C.cache_miss_cause(with_messages(df)))


@query("set5_distinct_artifacts", "v_results", sql="SELECT DISTINCT sha256(output) AS digest, strlen(output)::BIGINT AS bytes FROM v_results")
def distinct(df: DataFrame) -> DataFrame:
    return A.distinct_artifacts(df, "output").drop("content")


@query("jn12_new_artifacts", "v_results", sql="SELECT DISTINCT sha256(output) AS digest FROM v_results WHERE sha256(output) NOT IN (SELECT sha256(output) FROM v_results WHERE tool = 'bash')")
def fresh(df: DataFrame) -> DataFrame:
    d = df.select(F.sha2("output", 256).alias("digest"), "tool")
    return A.new_artifacts(d, d.where("tool = 'bash'"))


#: The longest whole characters within 65,536 bytes, by sums over the characters of long texts.
_RECOVERED = """WITH t AS (SELECT DISTINCT output FROM v_results), c AS (SELECT output, unnest(string_split(left(output, 65536), '')) AS x, unnest(range(1, length(left(output, 65536)) + 1)) AS i FROM t WHERE strlen(output) > 65536),
  k AS (SELECT output, count(*) AS k FROM (SELECT output, sum(strlen(x)) OVER (PARTITION BY output ORDER BY i) AS run FROM c) WHERE run <= 65536 GROUP BY output)
  SELECT left(sha256(output), 20) AS handle, 'ok' AS status, sha256(CASE WHEN k IS NULL THEN output ELSE left(output, k) END) AS content_digest FROM t LEFT JOIN k USING (output) WHERE output IS NOT NULL"""


@query("jn8_recover_artifact", "v_results", sql=_RECOVERED)
@query("jn8_recover_all_artifacts", "v_results", sql=_RECOVERED)
def recovered_all(df: DataFrame) -> DataFrame:
    """All texts are stored; the operator cuts the long ones."""
    store = A.distinct_artifacts(df, "output")
    handles = store.select(F.left("digest", F.lit(20)).alias("handle"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return A.recover_artifacts(handles, store).select("handle", "status", F.sha2("content", 256).alias("content_digest"))


@query("win11_evict_artifacts", "v_results", sql="""SELECT workspace, name FROM (SELECT workspace, name, sum(bytes) OVER (PARTITION BY workspace ORDER BY created_at DESC, name DESC) AS run FROM (SELECT workspace, lpad(result_id::VARCHAR, 12, '0') AS name, strlen(output) AS bytes,
  TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 HOUR * (result_id % 200) AS created_at FROM v_results) WHERE created_at > TIMESTAMP '2024-01-03 00:00:00') WHERE run <= 50000""")
def evicted(df: DataFrame) -> DataFrame:
    d = df.select("workspace", F.lpad(F.col("result_id").cast("string"), 12, "0").alias("name"), F.octet_length("output").alias("bytes"), F.expr("timestamp_ntz'2024-01-10 00:00:00' - interval 1 hour * (result_id % 200)").alias("created_at"))
    return A.evict_artifacts(d, "2024-01-10 00:00:00", 7, 50000).select("workspace", "name")


@query("jn11_recovery_census", "v_history", sql="""WITH r AS (SELECT request_id AS session_id, path AS ref, position AS turn FROM v_history WHERE tool = 'read'), e AS (SELECT request_id AS session_id, path AS ref, position AS turn FROM v_history WHERE tool = 'grep' OR position % 3 = 0)
  SELECT session_id, ref, turn, elided_turn, elided_turn = turn AS same_turn, ref LIKE '%f1%' AS stored FROM (SELECT r.*, (SELECT max(e.turn) FROM e WHERE e.session_id = r.session_id AND e.ref = r.ref AND e.turn <= r.turn) AS elided_turn FROM r)""")
def census(df: DataFrame) -> DataFrame:
    s = lambda d: d.select(F.col("request_id").alias("session_id"), F.col("path").alias("ref"), F.col("position").alias("turn"))
    return A.recovery_census(s(df.where("tool = 'read'")), s(df.where("tool = 'grep' or position % 3 = 0")), df.where("path like '%f1%'").select(F.col("path").alias("ref")))
