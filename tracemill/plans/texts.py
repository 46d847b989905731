"""Queries over tool results: classes, cuts, redaction, bounding and corpus reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shell import classify_shell_call
from ..functions.structured import redact_structured
from ..functions.numbers import canonical_json, digest, estimate_tokens
from ..operators import bounding as B
from ..operators.summaries import summary_ok
from .registry import query

BUDGET = "CASE c WHEN 'source' THEN {0} WHEN 'structured-data' THEN {1} ELSE {2} END"
_EXT = "CASE WHEN ends_with(p, '.json') THEN 'structured-data' WHEN ends_with(p, '.log') THEN 'bulk' ELSE 'source' END"
_CMD = "regexp_replace(regexp_extract(command, '(\\S+)\\s*$', 1), '^[''\"]|[''\"]$', '', 'g')"
_CLASS = f"""CASE tool WHEN 'grep' THEN 'structured' WHEN 'read' THEN {_EXT.replace('p,', 'path,')} WHEN 'bash' THEN CASE WHEN regexp_matches(command, '^(cat|head|tail|sed)\\b') AND NOT regexp_matches(command, '[|><;]')
  THEN {_EXT.replace('p,', _CMD + ',')} ELSE 'process-output' END ELSE 'generic' END"""


@query("prj2_estimate_tokens", "v_results", sql="SELECT result_id, ((strlen(output) + 3) // 4)::BIGINT AS tokens FROM v_results")
def tokens(df: DataFrame) -> DataFrame:
    return df.select("result_id", estimate_tokens(F.col("output")).alias("tokens"))


@query("prj7_classify_source", "v_results", sql=f"SELECT result_id, {_CLASS} AS class FROM v_results")
def classify(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.classify_source(F.col("tool"), F.col("path"), F.col("command")).alias("class"))


@query("prj8_class_budget", "v_results", sql=f"SELECT result_id, c AS class, ({BUDGET.format(32768, 8192, 4096)})::INT AS budget FROM (SELECT result_id, {_CLASS} AS c FROM v_results)")
def budget(df: DataFrame) -> DataFrame:
    kind = T.classify_source(F.col("tool"), F.col("path"), F.col("command"))
    return df.select("result_id", kind.alias("class"), T.class_budget(kind).alias("budget"))


@query("prj9_plan_route", "v_results", sql="""SELECT result_id, CASE WHEN tool = 'read' AND len(string_split(output, chr(10))) BETWEEN 100 AND 20000 AND strlen(output) BETWEEN 1 AND 2097152 THEN 'summary'
  WHEN tool = 'grep' THEN 'structured' WHEN tool = 'bash' AND strlen(output) > 51200 THEN 'artifact' ELSE 'passthrough' END AS route FROM v_results""")
def route(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.plan_route(F.col("tool"), F.lit(False), F.size(T.lines(F.col("output"))), F.octet_length("output")).alias("route"))


@query("prj11_classify_shell", "v_results", sql="SELECT result_id, CASE result_id % 5 WHEN 2 THEN 'metacharacters' WHEN 3 THEN 'other-program' ELSE 'read' END AS kind FROM v_results")
def shell(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.classify_shell(F.col("command")).alias("kind"))


@query("prj11_shell_routes", "v_results", sql="""SELECT result_id, CASE WHEN k IN (0, 1, 4) THEN 'eligible' ELSE 'bypassed' END AS status, CASE WHEN k IN (0, 1, 4) THEN 'read' END AS route,
  CASE k WHEN 2 THEN 'ambiguous-shell' WHEN 3 THEN 'unsupported-shell' END AS reason, CASE k WHEN 0 THEN workspace || '.py' WHEN 1 THEN workspace || '.json' WHEN 4 THEN workspace || '.py' END AS path,
  (CASE WHEN k IN (1, 4) THEN 1 END)::BIGINT AS start_line, (CASE k WHEN 1 THEN 20 WHEN 4 THEN 5 END)::BIGINT AS end_line FROM (SELECT *, result_id % 5 AS k FROM v_results)""")
def shell_routes(df: DataFrame) -> DataFrame:
    """Each command plainly, or as the text of sh -c, without wrapping."""
    argv = F.when(F.col("result_id") % 2 == 0, F.to_json(F.struct("command"))).otherwise(F.to_json(F.struct(F.array(F.lit("/bin/bash"), F.lit("-lc"), F.col("command")).alias("command"))))
    d = df.select("result_id", classify_shell_call(F.lit("Bash"), argv, F.lit("/work"), wrap=False).alias("d"))
    return d.select("result_id", *[f"d.{c}" for c in ("status", "route", "reason", "path", "start_line", "end_line")])


@query("prj12_readonly_filter", "v_results", sql="SELECT result_id, command FROM v_results WHERE regexp_matches(command, '^(cat|sed -n|head) ')")
def readonly(df: DataFrame) -> DataFrame:
    return df.where(T.readonly_command(F.col("command"))).select("result_id", "command")


_HITS = """SELECT result_id, u.i AS line, u.x AS text, row_number() OVER (PARTITION BY result_id ORDER BY u.i) AS k
  FROM (SELECT result_id, unnest(list_transform(string_split(output, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM v_results) WHERE contains(u.x, 'the')"""
_GREP = f"SELECT result_id, line::INT AS line, CASE WHEN strlen(text) <= 512 THEN text ELSE left(text, list_max(list_filter(range(128, 513), lambda n: strlen(left(text, n)) <= 512))) END AS text FROM ({_HITS}) WHERE k <= 20"


@query("prj15_grep_lines", "v_results", sql=_GREP)
@query("prj15_grep_cut_lines", "v_results", sql=_GREP)
def grep_cut(df: DataFrame) -> DataFrame:
    """With the operator's own width: long lines are cut, none is left out."""
    return B.grep_lines(df.select("result_id", "output"), "the")


@query("prj15_grep_summary", "v_results", sql=f"""SELECT (SELECT count(*) FROM v_results) AS files, 0::BIGINT AS binary, count(*) AS matching, sum(n)::BIGINT AS matches, sum(greatest(n - 20, 0))::BIGINT AS hidden FROM (SELECT result_id, count(*) AS n FROM ({_HITS}) GROUP BY result_id)""")
def grep_counts(df: DataFrame) -> DataFrame:
    return B.grep_summary(df.select("output"), "the")


@query("prj17_slice_lines", "v_results", sql="SELECT result_id, array_to_string(list_slice(string_split(regexp_replace(output, '\\n$', ''), chr(10)), 2, 4), chr(10)) AS text FROM v_results")
def some_lines(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.slice_lines(F.col("output"), 2, 4).alias("text"))


def redact_sql(text: str, key: str | None) -> str:
    """The steps of redaction in SQL. Its patterns cannot look around, so the steps of `authorization` and what is redacted already are left out: the given tables have neither."""
    before = r"((?:^|[^A-Za-z0-9_.-])[\"'']?{}[\"'']?\s*[:=]\s*)"
    bare = r"""([\"'']?(?:api[_-]?key|access[_-]?token|password|secret|private[_-]?key)[\"'']?\s*[:=]\s*)"""
    steps = [(r"-----BEGIN [A-Z ]+ KEY-----[\s\S]*?-----END [A-Z ]+ KEY-----", "[REDACTED PRIVATE KEY]")]
    for start in (bare, before.format(key)) if key else (bare,):
        steps += [("(?i)" + start + r'"(?:\\.|[^"\\])*"', r'\1"[REDACTED]"'), ("(?i)" + start + r"''(?:\\.|[^''\\])*''", r"\1''[REDACTED]''"), ("(?i)" + start + r"""[^\s,"''}\[]+""", r"\1[REDACTED]")]
    steps += [(p, "[REDACTED TOKEN]") for p in (r"\b(?:sk|rk)-[A-Za-z0-9_-]{12,}\b", r"\bgh[pousr]_[A-Za-z0-9_-]{12,}\b", r"\bgithub_pat_[A-Za-z0-9_-]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b")]
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


@query("txt1_redact", "v_results", sql=f"SELECT result_id, {redact_sql('output', 'token')} AS text FROM v_results")
@query("txt1_redact_all", "v_results", sql=f"SELECT result_id, {redact_sql('output', 'token')} AS text FROM v_results")
def redact_all(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.redact(F.col("output"), ("token",)).alias("text"))


_TOLD = "(len(string_split({0}, '[REDACTED')) - len(string_split({1}, '[REDACTED')))::INT"


@query("txt1_redaction_counts", "v_results", sql=f"SELECT result_id, {_TOLD.format('t', 'output')} AS redactions, strlen(t)::INT AS bytes FROM (SELECT *, {redact_sql('output', 'token')} AS t FROM v_results)")
def redaction_counts(df: DataFrame) -> DataFrame:
    done = df.select("result_id", T.redaction(F.col("output"), ("token",)).alias("r"))
    return done.select("result_id", F.col("r.n").alias("redactions"), F.octet_length("r.text").alias("bytes"))


@query("txt2_redact_structured", "v_results")
def redact_records(df: DataFrame) -> DataFrame:
    """Every string leaf of a nested record, keys kept."""
    rec = df.select("result_id", F.struct(F.struct("output", "path").alias("result"), F.array("command", "output").alias("parts"), F.create_map(F.lit("text"), "output").alias("more")).alias("r"))
    clean = lambda c: T.redact(c, ("token",))
    out = F.struct(F.struct(clean(F.col("r.result.output")).alias("output"), clean(F.col("r.result.path")).alias("path")).alias("result"), F.transform("r.parts", clean).alias("parts"), F.transform_values("r.more", lambda k, v: clean(v)).alias("more"))
    return rec.select("result_id", F.sha2(F.to_json(out), 256).alias("digest"))


def _record(output: str, log: str) -> str:
    """The record of txt2_redact_json in SQL."""
    return f"""'{{"tool":' || to_json(tool)::VARCHAR || ',"calls":[{{"token":' || to_json(path)::VARCHAR || ',"by_path":{{' || to_json(path)::VARCHAR || ':[' || to_json({output})::VARCHAR || ',' || to_json(command)::VARCHAR || ']}}}}],"log":' || to_json({log})::VARCHAR || '}}'"""


_LOG = """('{"output":' || to_json(output)::VARCHAR || '}')"""


@query("txt2_redact_json", "v_results", sql=f"""SELECT result_id, {_TOLD.format('now', 'was')} AS redactions, sha256(now) AS digest, strlen(now)::INT AS bytes
  FROM (SELECT result_id, {_record('output', _LOG)} AS was, {_record(redact_sql('output', 'token'), redact_sql(_LOG, 'token'))} AS now FROM v_results)""")
def redact_nested(df: DataFrame) -> DataFrame:
    """Every text of the table as a string deep inside JSON, redacted by a walk that knows nothing of the shape."""
    deep = F.to_json(F.struct("tool", F.array(F.struct(F.col("path").alias("token"), F.map_from_arrays(F.array("path"), F.array(F.array("output", "command"))).alias("by_path"))).alias("calls"), F.to_json(F.struct("output")).alias("log")))
    done = redact_structured(df.select("result_id", deep.alias("record")), "record", ("token",), json=True)
    return done.select("result_id", "redactions", F.sha2("record", 256).alias("digest"), F.octet_length("record").alias("bytes"))


@query("txt3_truncate_utf8", "v_results", sql="""WITH n AS (SELECT result_id, output, list_max(list_filter(range(0, 101), lambda k: strlen(left(output, k)) <= 100)) AS k FROM v_results)
  SELECT result_id, left(output, k) AS head FROM n""")
def truncate(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.truncate_utf8(F.col("output"), 100).alias("head"))


@query("txt3_suffix_and_columns", "v_results", sql="""SELECT result_id, right(output, list_max(list_filter(range(0, 101), lambda k: strlen(right(output, k)) <= 100))) AS tail,
  sha256(array_to_string(list_transform(string_split(output, chr(10)), lambda x: CASE WHEN strlen(x) <= 80 THEN x ELSE left(x, list_max(list_filter(range(19, 80), lambda k: strlen(left(x, k)) <= 79))) || '~' END), chr(10))) AS capped FROM v_results""")
def suffixes(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.suffix_utf8(F.col("output"), 100).alias("tail"), F.sha2(T.cap_columns(F.col("output"), 80), 256).alias("capped"))


@query("txt4_strip_ansi", "v_results", sql="SELECT result_id, sha256(output) AS digest FROM v_results")
def ansi(df: DataFrame) -> DataFrame:
    coloured = F.concat(F.lit("\x1b[31m"), "output", F.lit("\x1b[0m"))
    return df.select("result_id", F.sha2(T.strip_ansi(coloured), 256).alias("digest"))


_NUMBERED = "SELECT result_id, output, u.i AS i, u.x AS x FROM (SELECT result_id, output, unnest(list_transform(string_split(output, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM v_results)"


@query("txt5_structural_outline", "v_results", sql=f"""WITH l AS ({_NUMBERED}), k AS (SELECT result_id, any_value(output) AS output, count(*) AS n, count(*) FILTER (m) AS kept, string_agg(CASE WHEN m THEN i || ':' || x END, chr(10) ORDER BY i) AS body
  FROM (SELECT *, regexp_matches(x, '^\\s*(import|from|export|use|package|def|function|class|interface|trait|impl|struct|enum|namespace|module|type|func|fn)\\b|^\\s*@[A-Za-z_]') AS m FROM l) GROUP BY result_id)
  SELECT result_id, CASE WHEN kept >= 1 AND (n < 100 OR kept >= 2) AND strlen('[outline: ' || kept || '/' || n || ' lines]' || chr(10) || body) + 64 < strlen(output) THEN '[outline: ' || kept || '/' || n || ' lines]' || chr(10) || body END AS outline FROM k""")
def outline(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.structural_outline(F.col("output")).alias("outline"))


_RUNS = f"""WITH l AS ({_NUMBERED}), g AS (SELECT *, i - row_number() OVER (PARTITION BY result_id, x ORDER BY i) AS island FROM l),
  r AS (SELECT result_id, any_value(output) AS output, min(i) AS s, any_value(x) AS x, count(*) AS n FROM g GROUP BY result_id, x, island)"""


@query("txt6_collapse_repeats", "v_results", sql=_RUNS + """, j AS (SELECT result_id, any_value(output) AS output, string_agg(CASE WHEN n >= 3 AND x <> '' THEN x || chr(10) || '[repeated x' || n || ']' ELSE x || repeat(chr(10) || x, (n - 1)::BIGINT) END, chr(10) ORDER BY s) AS t FROM r GROUP BY result_id)
  SELECT result_id, sha256(CASE WHEN strlen(t) + 32 < strlen(output) THEN t ELSE output END) AS digest FROM j""")
def collapse(df: DataFrame) -> DataFrame:
    return df.select("result_id", F.sha2(T.collapse_repeats(F.col("output")), 256).alias("digest"))


@query("win15_repeated_runs", "v_results", sql=_RUNS + " SELECT result_id, s::INT AS first_line, n::INT AS run_length FROM r WHERE n > 1 AND x <> ''")
def runs(df: DataFrame) -> DataFrame:
    """Runs of equal lines, not empty, with their length."""
    l = T.lines(F.col("output"))
    d = df.select("result_id", l.alias("l")).withColumn("s", T.run_starts(F.col("l")))
    d = d.select("result_id", "l", F.size("l").alias("n"), "s", F.posexplode("s").alias("k", "at"))
    return d.select("result_id", (F.col("at") + 1).alias("first_line"), (F.coalesce(F.get("s", F.col("k") + 1), F.col("n")) - F.col("at")).alias("run_length"), F.get("l", "at").alias("x")).where("run_length > 1 and x <> ''").drop("x")


@query("txt7_history_shake", "v_results", sql=f"""WITH l AS (SELECT *, string_split(output, chr(10)) AS l FROM v_results),
  k AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(range(len(l)), lambda i: i < 3 OR i >= len(l) - 3), list_slice(list_filter(range(len(l)), lambda i: regexp_matches(l[i + 1], '{T.SIGNAL}')), 1, 12)))) AS k FROM l),
  s AS (SELECT *, array_to_string(list_transform(range(1, len(k) + 1), lambda p: CASE WHEN k[p] - coalesce(k[p - 1], -1) > 1 THEN '[' || (k[p] - coalesce(k[p - 1], -1) - 1) || ' lines left out]' || chr(10) ELSE '' END || l[k[p] + 1]), chr(10)) AS x FROM k)
  SELECT result_id, sha256(CASE WHEN tool IN ('bash', 'grep') AND strlen(output) > 1596 AND len(k) < len(l) AND strlen(x) < strlen(output) THEN x ELSE output END) AS digest FROM s""")
def shake(df: DataFrame) -> DataFrame:
    return df.select("result_id", F.sha2(T.history_shake(F.col("tool"), F.col("output")), 256).alias("digest"))


@query("txt8_bound_result", "v_results")
def bound(df: DataFrame) -> DataFrame:
    return B.bound_results(df).select(F.col("id").alias("result_id"), F.sha2("inline", 256).alias("inline_sha256"), "artifact_digest", "redacted_bytes", "inline_bytes")


@query("top3_salvage_lines", "v_results")
def salvaged(df: DataFrame) -> DataFrame:
    """Telling lines of what a view of 4,096 bytes leaves out of each output."""
    return B.salvage_lines(df, 2457, 1024)


_SIZES = f"""SELECT result_id, regexp_extract(path, '\\.[a-z]+$') AS ext, ((strlen(output) + 3) // 4)::BIGINT AS before, ((least(strlen(output), {BUDGET.format(32768, 8192, 4096)}) + 3) // 4)::BIGINT AS after FROM (SELECT *, {_CLASS} AS c FROM v_results)"""


def sizes(df: DataFrame) -> DataFrame:
    """Extension, and tokens before and after the class budget."""
    kind = T.classify_source(F.col("tool"), F.col("path"), F.col("command"))
    cut = F.least(F.octet_length("output"), T.class_budget(kind))
    return df.select("result_id", F.regexp_extract("path", r"\.[a-z]+$", 0).alias("ext"), estimate_tokens(F.col("output")).alias("before"), F.ceil(cut / 4).cast("long").alias("after"))


@query("agg19_reduction_by_extension", "v_results", sql=f"""SELECT ext, count(*) AS files, count(*) FILTER (after < before) AS reduced, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, floor((sum(before) - sum(after)) * 1000 / sum(before))::BIGINT AS rho_mille
  FROM ({_SIZES}) GROUP BY ROLLUP (ext)""")
def reduction(df: DataFrame) -> DataFrame:
    return B.reduction_by_extension(sizes(df))


@query("top1_top_extensions", "v_results", sql=f"SELECT ext, count(*) AS files, sum(before)::BIGINT AS before FROM ({_SIZES}) GROUP BY ext ORDER BY before DESC, ext LIMIT 12")
def top(df: DataFrame) -> DataFrame:
    return B.top_extensions(sizes(df))


@query("win9_window_capacity", "v_results", sql=f"""SELECT count(*) FILTER (b <= 200000) AS fit_before, count(*) FILTER (a <= 200000) AS fit_after FROM (SELECT sum(before) OVER (ORDER BY result_id) AS b, sum(after) OVER (ORDER BY result_id) AS a FROM ({_SIZES}))""")
def capacity(df: DataFrame) -> DataFrame:
    return B.window_capacity(sizes(df), "result_id")


@query("agg20_shell_net_reduction", "v_results")
def shell_net(df: DataFrame) -> DataFrame:
    d = df.where("tool = 'bash'")
    return B.shell_net_reduction(d.join(B.bound_results(d).select(F.col("id").alias("result_id"), "inline"), "result_id"))


@query("top2_catalog_search", "documents", sql="""SELECT name, score FROM (SELECT lpad(doc_id::VARCHAR, 12, '0') AS name,
  len(list_intersect(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), ['the', 'tion', 'of', 'license', 'token', '42']))::INT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, name LIMIT 50""")
def search(df: DataFrame) -> DataFrame:
    return B.catalog_search(df.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), "text"), "The tion of LICENSE, token 42")


@query("txt9_useless_success", "v_history", sql="SELECT request_id, position, lower(trim(output)) IN ('command completed successfully with no output.', 'no output.', '(no output)') AS useless FROM v_history")
def useless(df: DataFrame) -> DataFrame:
    return df.select("request_id", "position", T.useless_success(F.col("output")).alias("useless"))


@query("txt10_result_error", "v_history", sql="SELECT request_id, position, is_error OR regexp_matches(output, '(?i)^\\s*(error|failed|failure)\\b') AS error FROM v_history")
def errors(df: DataFrame) -> DataFrame:
    return df.select("request_id", "position", T.result_error(F.col("output"), F.col("is_error"), F.lit("completed")).alias("error"))


@query("txt11_read_identity", "v_history", sql="SELECT request_id, position, path, lo, hi FROM v_history WHERE tool = 'read'")
def identity(df: DataFrame) -> DataFrame:
    with_range = F.to_json(F.struct("path", F.col("lo").alias("line_start"), F.col("hi").alias("line_end")))
    d = df.where("tool = 'read'").select("request_id", "position", T.read_identity(F.col("tool"), with_range).alias("r"))
    return d.select("request_id", "position", "r.path", "r.lo", "r.hi")


@query("txt12_summary_check", "v_results", sql=f"""SELECT result_id, strlen(s) < strlen(output) AND 5 * ((strlen(s) + 3) // 4) <= (strlen(output) + 3) // 4 AND contains(s, 'a') AND {redact_sql('s', None)} = s AS ok
  FROM (SELECT *, string_split(output, chr(10))[1] || chr(10) || string_split(output, chr(10))[-1] AS s FROM v_results)""")
def summaries(df: DataFrame) -> DataFrame:
    """Whether the first and last line of a text would pass as a summary of it: short, ordered, with the facts asked for."""
    l = T.lines(F.col("output"))
    return df.select("result_id", summary_ok(F.col("output"), F.concat_ws("\n", F.get(l, F.lit(0)), F.element_at(l, -1)), F.array(F.lit("a"))).alias("ok"))


@query("txt13_bounded_sample", "v_results", sql="SELECT result_id, CASE WHEN length(output) <= 61 THEN output ELSE output[:28] || ' ... ' || output[-28:] END AS sample FROM v_results")
def sample(df: DataFrame) -> DataFrame:
    return df.select("result_id", T.bounded_sample(F.col("output"), 61).alias("sample"))


@query("txt14_disclosure", "v_results")
def disclosure(df: DataFrame) -> DataFrame:
    """What was shown of a result: bytes, markers, handle and a digest of the record itself."""
    b = B.bound_results(df).withColumn("original", F.col("redacted_bytes"))
    rec = F.struct(F.lit("bounded-result").alias("type"), F.struct("original", F.col("redacted_bytes").alias("redacted"), F.col("inline_bytes").alias("visible")).alias("bytes"), F.array_compact(F.array(F.when(F.contains("inline", F.lit(B.ELIDED)), "elided"), F.when(F.contains("inline", F.lit(T.GONE)), "redacted"))).alias("markers"), F.concat(F.lit("sha256:"), F.left("artifact_digest", F.lit(16))).alias("handle"))
    return b.select(F.col("id").alias("result_id"), rec.alias("d")).select("result_id", "d.*", digest(F.to_json("d")).alias("provenance"))


@query("jsn1_canonical_json", "events", sql="SELECT event_id, 'sha256:' || sha256('{\"a\":' || event_id || ',\"b\":' || user_id || '}') AS digest FROM events")
def canonical(df: DataFrame) -> DataFrame:
    body = F.concat(F.lit('{ "b": '), F.col("user_id").cast("string"), F.lit(', "a":'), F.col("event_id").cast("string"), F.lit("}"))
    return df.select("event_id", digest(canonical_json(body)).alias("digest"))


@query("jsn4_has_breakpoint", "events", sql="SELECT event_id, event_id % 3 = 0 AS marked FROM events")
def breakpoints(df: DataFrame) -> DataFrame:
    body = F.concat(F.lit('{"messages":[{"content":"\\"cache_control\\":"'), F.when(F.col("event_id") % 3 == 0, ',"cache_control" : {"type":"x"}').otherwise(""), F.lit("}]}"))
    return df.select("event_id", T.has_breakpoint(body).alias("marked"))
