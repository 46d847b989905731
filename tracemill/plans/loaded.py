"""Queries over ledgers that are followed, profiles and rules that are loaded from files, and weights that a caller overrides."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import strict_sum
from ..operators import usage as U
from ..sources import readers as R
from ..sources.shared import shared_folder
from ..streaming import jobs as J
from ..streaming.run import drain
from .files import transcripts
from .history import _CAUSE, _TURNS, with_messages
from .registry import query
from .texts import redact_sql


@query("src3_stream_ledger", "v_usage", sql="SELECT session_id, turn_no, prompt FROM v_usage")
def followed(df: DataFrame) -> DataFrame:
    """The ledger's files as a stream, drained."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    df.select("session_id", "turn_no", "prompt").write.json(folder)
    return drain(spark, R.stream_ledger(spark, folder, "session_id long, turn_no int, prompt long"))


@query("src4_load_pricing", "part", sql="""SELECT 'part' || p_partkey AS profile_id, p_brand AS provider, p_size * 1000 AS threshold, (round(p_retailprice * 100)::BIGINT * 10)::BIGINT AS short_fresh, (round(p_retailprice * 100)::BIGINT * 20)::BIGINT AS long_output FROM part""")
def pricing(df: DataFrame) -> DataFrame:
    """A price profile for each part, in arrays of profiles, a file each."""
    folder = shared_folder(df.sparkSession)
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    rates = lambda n: F.struct(*[(cents * n / 100).cast("decimal(18,2)").alias(p) for p in ("fresh", "read", "write", "output")])
    profile = F.struct(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("profile_id"), F.col("p_brand").alias("provider"), F.col("p_type").alias("model"), F.lit("standard").alias("service"), F.lit(False).alias("regional"), (F.col("p_size") * 1000).cast("long").alias("threshold"), rates(1).alias("short"), rates(2).alias("long"))
    files = df.groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(F.to_json(F.collect_list(profile)).alias("value"))
    files.write.partitionBy("file").text(folder)
    return R.load_pricing(df.sparkSession, f"{folder}/*/*").select("profile_id", "provider", "threshold", "short_fresh", "long_output")


def _rules(nations: DataFrame) -> tuple:
    """A rule file with an assignment key for each nation, which is a bounded list, loaded."""
    names = [r[0].lower() for r in nations.select("n_name").distinct().orderBy("n_name").limit(90).collect()]
    return R.load_redaction_rules(json.dumps({"rules": [{"type": "assignment-key", "key": n} for n in names] + [{"type": "token-prefix", "prefix": "acme_", "minLength": 4, "maxLength": 40}]}))


_KEYS = "(SELECT list_sort(list(DISTINCT lower(n_name))) FROM nation)"
_ASSIGNED = r"""'(?i)(?:api[_-]?key|access[_-]?token|password|secret|private[_-]?key|(?:^|[^A-Za-z0-9_.-])[\"'']?(?:' || array_to_string(list_transform(ks, lambda x: regexp_escape(x)), '|') || '))[\"'']?\s*[:=]\s*[^\s]'"""


@query("src5_load_redaction_rules", "nation", "v_results", sql=f"""WITH k AS (SELECT {_KEYS} AS ks) SELECT result_id, len(regexp_extract_all(output, {_ASSIGNED}))::INT AS redactions, 'sha256:' || sha256('[' || to_json(ks)::VARCHAR || ',[["acme_",4,40]]]') AS rules FROM v_results, k""")
def loaded_rules(nations: DataFrame, df: DataFrame) -> DataFrame:
    """How often the loaded rules change a text, and the rules' digest."""
    keys, prefixes, digest = _rules(nations)
    return df.select("result_id", T.count_redactions(F.col("output"), keys, prefixes).alias("redactions"), F.lit(digest).alias("rules"))


@query("udf1_custom_redaction", "nation", "v_results", sql=f"""WITH k AS (SELECT {_KEYS} AS ks), f AS (SELECT result_id, output, ks[(result_id % len(ks)) + 1] || ' = [REDACTED] [REDACTED]' AS first_line FROM v_results, k)
  SELECT result_id, first_line, sha256(first_line || chr(10) || {redact_sql('output', None)}) AS digest FROM f""")
def custom_redaction(nations: DataFrame, df: DataFrame) -> DataFrame:
    """The texts with an assignment to a nation's name put in front, redacted by all loaded rules."""
    keys, prefixes, _ = _rules(nations)
    key = F.array(*[F.lit(k) for k in keys])
    text = F.concat(F.get(key, F.pmod("result_id", F.lit(len(keys))).cast("int")), F.lit(" = hidden acme_12345\n"), F.col("output"))
    out = T.redact(text, keys, prefixes)
    return df.select("result_id", F.regexp_extract(out, "^([^\n]*)", 1).alias("first_line"), F.sha2(out, 256).alias("digest"))


@query("udf4_weight_overrides", "v_usage", sql="""SELECT line_key, ((prompt - cached - cache_write) * 1000 + cached * 50 + cache_write * 1250 + (output - reasoning) * 4000 + reasoning * 1000)::BIGINT AS cost_units FROM v_usage
  WHERE prompt - cached - cache_write >= 0 AND output - reasoning >= 0""")
def overridden(df: DataFrame) -> DataFrame:
    return U.weighted_usage(df, {"cached": 50, "output": 4000}).select("line_key", F.col("cost_units").cast("long").alias("cost_units"))


@query("udaf1_strict_sum", "v_usage", sql="SELECT host, model, sum(prompt)::BIGINT AS prompt, CASE WHEN count(tool_calls) = count(*) THEN sum(tool_calls)::BIGINT END AS tool_calls, CASE WHEN count(reasoning) = count(*) THEN sum(reasoning)::BIGINT END AS reasoning FROM v_usage GROUP BY host, model")
def strict(df: DataFrame) -> DataFrame:
    return df.groupBy("host", "model").agg(strict_sum(F.col("prompt")).alias("prompt"), strict_sum(F.col("tool_calls")).alias("tool_calls"), strict_sum(F.col("reasoning")).alias("reasoning"))


@query("udtf1_transcript_rows", "conversations", sql="SELECT conv_id || '-' || turn AS message_id, (strlen(text) + k * 5)::BIGINT AS input, (strlen(text) + k * 5 + 1)::BIGINT AS total FROM conversations, (VALUES (0), (1)) AS v(k) WHERE k = 1 OR turn % 3 = 0")
def transcript_rows(df: DataFrame) -> DataFrame:
    """A usage row for each line that reports one, none for others."""
    return U.normalize_anthropic_usage(transcripts(df)).select("message_id", "input", "total")


@query("str4_stream_cache_attribution", "v_turns", sql=f"SELECT session_id, turn::BIGINT AS turn, cached > 0 AS hit, {_CAUSE} AS cause FROM ({_TURNS})")
def attributed(df: DataFrame) -> DataFrame:
    """The stream over the turns, as files; its batch twin is win1_cache_miss_cause."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    turns = with_messages(df).withColumn("at", F.col("at").cast("timestamp")).withColumn("turn", F.col("turn").cast("long"))
    turns.write.parquet(folder)
    return drain(spark, J.stream_cache_attribution(spark.readStream.schema(turns.schema).parquet(folder)))
