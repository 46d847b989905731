"""Summaries written elsewhere: which may stand for their source, and what they save."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import estimate_tokens


def summary_ok(source: Column, summary: Column, facts: Column) -> Column:
    """A summary is smaller, at most a fifth of the tokens, has all facts and no secret, and its lines occur in order in the redacted source."""
    line = lambda x: F.concat(F.lit("\n"), x, F.lit("\n"))
    step = lambda a, x: F.struct((a.ok & F.contains(a.left, line(x))).alias("ok"), F.substring(a.left, F.instr(a.left, line(x)) + F.length(x) + 1, F.length(a.left)).alias("left"))
    inside = F.filter(T.lines(summary), lambda x: F.trim(x) != "")
    ordered = F.aggregate(inside, F.struct(F.lit(True).alias("ok"), line(T.redact(source)).alias("left")), step, lambda a: a.ok)
    small = (F.octet_length(summary) < F.octet_length(source)) & (5 * estimate_tokens(summary) <= estimate_tokens(source))
    return small & F.forall(facts, lambda f: F.contains(summary, f)) & (T.redact(summary) == summary) & ordered


def compact_with(df: DataFrame, complete, facts: Column, cost_tokens: Column) -> DataFrame:
    """Adds summary (from a user's iterator pandas_udf over the redacted text), whether it is accepted, and tokens saved less those it cost.

    Each distinct text is asked for once; a null answer is not accepted.
    """
    d = df.withColumn("key_", F.sha2("output", 256))
    once = d.select("key_", T.redact(F.col("output")).alias("clean_")).dropDuplicates(["key_"]).select("key_", complete("clean_").alias("summary"))
    d = d.join(once, "key_").drop("key_")
    d = d.withColumn("accepted", F.coalesce(summary_ok(F.col("output"), F.col("summary"), facts), F.lit(False)))
    saved = estimate_tokens(F.col("output")) - estimate_tokens(F.col("summary")) - cost_tokens
    return d.withColumn("saved_tokens", F.when(F.col("accepted"), saved).otherwise(-cost_tokens))
