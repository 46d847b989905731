"""Queries that write what the tables hold as the files of an agent fleet, and read those."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..operators import history as H
from ..operators import metrics as M
from ..operators import summaries as S
from ..operators import usage as U
from ..sources import readers as R
from ..sources.shared import shared_folder
from .registry import query


def _lines(df: DataFrame) -> DataFrame:
    """A transcript line for each turn: an assistant message with its usage, every third written twice with other numbers; and a broken line."""
    s = lambda c: F.col(c).cast("string")
    line = lambda extra: F.concat(F.lit('{"type":"assistant","message":{"id":"'), s("conv_id"), F.lit("-"), s("turn"), F.lit('","usage":{"input_tokens":'), (F.octet_length("text") + extra).cast("string"), F.lit(',"output_tokens":1}}}'))
    return df.select("conv_id", F.array_join(F.array_compact(F.array(F.when(F.col("turn") % 3 == 0, line(0)), line(5), F.when(F.col("turn") == 0, "{broken"))), "\n").alias("value"))


def transcripts(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    _lines(df).select("value").write.text(folder)
    return R.transcript_usage(R.read_transcripts(df.sparkSession, folder))


@query("src1_read_transcripts", "conversations", sql="SELECT conv_id || '-' || turn AS message_id, 'assistant' AS kind, count(*) AS n FROM conversations, (VALUES (0), (1)) AS v(k) WHERE k = 1 OR turn % 3 = 0 GROUP BY ALL")
def read_transcripts(df: DataFrame) -> DataFrame:
    return transcripts(df).groupBy("message_id", "kind").agg(F.count("*").alias("n"))


@query("set3_dedupe_messages", "conversations", sql="SELECT conv_id || '-' || turn AS message_id, strlen(text)::BIGINT + 5 AS input, (strlen(text) + 6)::BIGINT AS total FROM conversations")
def messages(df: DataFrame) -> DataFrame:
    return U.normalize_anthropic_usage(R.dedupe_messages(transcripts(df))).select("message_id", "input", "total")


@query("src2_read_ledger", "v_usage", sql="SELECT session_id, turn_no, prompt FROM v_usage WHERE session_id % 7 <> 0")
def ledger(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    df.select(F.when(F.col("session_id") % 7 == 0, "other/v1").otherwise("ledger/v1").alias("schema"), "session_id", "turn_no", "prompt").write.json(folder)
    return R.read_ledger(df.sparkSession, folder, "schema string, session_id long, turn_no int, prompt long", "ledger/v1").drop("schema")


_FILES = "SELECT strlen(output)::BIGINT + 1 AS bytes, sha256(output || chr(10)) AS digest FROM v_results WHERE strlen(output) BETWEEN 1023 AND 4194303"


@query("src6_read_text_files", "v_results", sql=_FILES)
@query("src6_read_all_text_files", "v_results", sql=_FILES)
def all_text_files(df: DataFrame) -> DataFrame:
    """A file for each result, many to a folder."""
    folders = R.write_text_files(df, shared_folder(df.sparkSession), "output")
    return R.each_text_file(df.sparkSession, folders, lambda files: files.select("bytes", F.sha2("text", 256).alias("digest")))


@query("snk1_write_artifacts", "v_results", sql="SELECT DISTINCT sha256(output) AS digest, strlen(output)::BIGINT AS bytes FROM v_results")
def store(df: DataFrame) -> DataFrame:
    """Stored twice: the second time adds nothing."""
    folder = shared_folder(df.sparkSession)
    for _ in range(2):
        A.write_artifacts(df, folder, "output")
    return df.sparkSession.read.parquet(folder).select("digest", "bytes")


@query("snk2_write_rollups", "v_counters", sql="SELECT day_utc, host, count(*) AS n FROM v_counters GROUP BY ALL")
def rollups(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    g = df.groupBy("day_utc", "host").agg(F.count("*").alias("n"))
    R.write_rollups(g.withColumn("n", F.lit(0).cast("long")).where("day(day_utc) < 5"), folder)
    R.write_rollups(g, folder)
    return df.sparkSession.read.parquet(folder)


@query("prj1_normalize_event", "conversations", sql="SELECT 'PostToolUse' AS event_name, role AS tool_name, text AS output, conv_id::VARCHAR AS session_id FROM conversations WHERE role <> 'system'")
def events(df: DataFrame) -> DataFrame:
    """Two spellings by turn; system turns have no output."""
    a = F.to_json(F.struct(F.lit("PostToolUse").alias("hook_event_name"), F.col("role").alias("tool_name"), F.col("text").alias("tool_response"), F.col("conv_id").cast("string").alias("session_id")))
    b = F.to_json(F.struct(F.lit("PostToolUse").alias("eventName"), F.col("role").alias("toolName"), F.col("text").alias("output"), F.col("conv_id").cast("string").alias("sessionId")))
    c = F.to_json(F.struct(F.lit("x").alias("eventName"), F.col("role").alias("toolName")))
    body = F.when(F.col("role") == "system", c).when(F.col("turn") % 2 == 0, a).otherwise(b)
    return M.normalize_event(df.select(body.alias("body"))).select("event_name", "tool_name", "output", "session_id")


@query("prj3_normalize_responses_usage", "v_usage", sql="""SELECT line_key, CASE WHEN turn_no % 3 = 2 THEN NULL ELSE prompt END AS input, CASE WHEN turn_no % 3 = 2 THEN NULL ELSE prompt + output END AS total,
  CASE turn_no % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' ELSE 'invalid' END AS status FROM v_usage WHERE cached + cache_write <= prompt""")
def responses(df: DataFrame) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit('{"input_tokens":'), s("prompt"), F.lit(',"output_tokens":'), s("output"))
    full = F.concat(head, F.lit(',"input_tokens_details":{"cached_tokens":'), s("cached"), F.lit(',"cache_write_tokens":'), s("cache_write"), F.lit('},"output_tokens_details":{"reasoning_tokens":'), s("reasoning"), F.lit("}}"))
    bad = F.concat(head, F.lit(',"cached_input_tokens":1,"cache_read_input_tokens":2}'))
    body = F.when(F.col("turn_no") % 3 == 0, full).when(F.col("turn_no") % 3 == 1, F.concat(head, F.lit("}"))).otherwise(bad)
    return U.normalize_responses_usage(df.where("cached + cache_write <= prompt").select("line_key", body.alias("usage"))).select("line_key", "input", "total", "status")


@query("prj4_normalize_anthropic_usage", "v_usage", sql="SELECT line_key, prompt + cached + cache_write AS input, prompt + cached + cache_write + output AS total FROM v_usage WHERE turn_no % 5 <> 0")
def anthropic(df: DataFrame) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    body = F.concat(F.lit('{"input_tokens":'), s("prompt"), F.lit(',"cache_read_input_tokens":'), s("cached"), F.lit(',"cache_creation_input_tokens":'), s("cache_write"), F.lit(',"output_tokens":'), s("output"), F.when(F.col("turn_no") % 5 == 0, ',"total_tokens":1').otherwise(""), F.lit("}"))
    return U.normalize_anthropic_usage(df.select("line_key", body.alias("usage"))).select("line_key", "input", "total")


@query("udf2_judge_pairs", "v_history", sql="""SELECT request_id, position, CASE WHEN strlen(left(output, 60)) * 2 < strlen(output) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS probability, 'judged' AS status FROM v_history WHERE left(output, 60) <> output""")
def judged(df: DataFrame) -> DataFrame:
    """A judge given by the user: here, whether over half of the bytes are gone."""

    @F.pandas_udf("double")
    def judge(original: pd.Series, preview: pd.Series) -> pd.Series:
        return (preview.str.encode("utf-8").str.len() * 2 < original.str.encode("utf-8").str.len()).astype("float64")

    pairs = H.original_vs_preview(df, df.withColumn("output", F.left("output", F.lit(60))), ["request_id", "position"])
    return H.judge_pairs(pairs, judge, ["request_id", "position"])


@query("udf3_compact_with", "v_results")
def compacted(df: DataFrame) -> DataFrame:
    """A summariser given by the user: here, the first line."""

    @F.pandas_udf("string")
    def first(text: pd.Series) -> pd.Series:
        return text.str.split("\n").str[0]

    return S.compact_with(df.select("result_id", "output"), first, F.array(F.lit(" ")), F.lit(3)).select("result_id", "accepted", "saved_tokens")
