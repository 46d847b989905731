"""Daily counters closed into bucketed rows, coverage, gateway calls and adoption."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import byte_bucket, byte_step, count_bucket, count_step, coverage_bucket, latency_bucket, result_bucket, unknown_step

#: Events that a day's counters are kept for.
EVENTS = ("hook_summary", "proxy_summary", "hook_failure_summary", "proxy_failure_summary")


def daily_summary(df: DataFrame, today: str) -> DataFrame:
    """Per closed day, version and host: calls, transformed calls and bytes as bucket labels."""
    g = df.where(F.col("day_utc") < F.lit(today).cast("date")).groupBy("day_utc", "version", "host").agg(F.count("*").alias("n"), F.count_if("transformed").alias("t"), F.sum("latency_ms").alias("b"))
    return g.select("day_utc", "version", "host", count_bucket(F.col("n")).alias("calls"), count_bucket(F.col("t")).alias("transformed"), byte_bucket(F.col("b")).alias("bytes"))


def close_days(df: DataFrame, today: str) -> DataFrame:
    """Rows of closed days by day, version, event, dimension and suffix: counters as buckets, failures as markers.

    df: day_utc, version, event (one of EVENTS), dimension (host or provider), mode, failure_stage, transformed, bytes. Summaries are kept apart by mode (null: none), failures by stage; a failure is one row
    however often it happened, without counts. Other events raise; days from `today` on are still open and stay out. Null days are never closed.
    """
    failed = F.col("event").endswith("_failure_summary")
    event = F.when(F.col("event").isin(*EVENTS), F.col("event")).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce("event", F.lit("null")))).cast("string"))
    d = df.where(F.col("day_utc") < F.lit(today).cast("date")).select("day_utc", "version", event.alias("event"), "dimension", F.when(~failed, F.col("mode")).alias("mode"), F.when(failed, F.col("failure_stage")).alias("failure_stage"), "transformed", "bytes")
    g = d.groupBy("day_utc", "version", "event", "dimension", "mode", "failure_stage").agg(F.count("*").alias("n"), F.count_if("transformed").alias("t"), F.sum("bytes").alias("b"))
    counted = lambda label: F.when(~F.col("event").endswith("_failure_summary"), label)
    return g.select("day_utc", "version", "event", "dimension", "mode", "failure_stage", counted(count_bucket(F.col("n"))).alias("calls"), counted(count_bucket(F.col("t"))).alias("transformed"), counted(byte_bucket(F.coalesce("b", F.lit(0)))).alias("bytes"))


def coverage_summary(df: DataFrame, known: tuple[str, ...] = ("reason0", "reason1", "reason2", "reason3", "reason4", "reason5")) -> DataFrame:
    """Per day and host: routed, bypassed, share bucket, and the most frequent bypass reason (ties by name; unknown reasons are `other`)."""
    reason = F.when(F.col("routed"), None).otherwise(F.when(F.col("reason").isin(*known), F.col("reason")).otherwise("other"))
    counted = df.groupBy("day_utc", "host", reason.alias("r")).agg(F.count("*").alias("n"))
    g = counted.groupBy("day_utc", "host").agg(
        F.coalesce(F.sum(F.when(F.col("r").isNull(), F.col("n"))), F.lit(0)).alias("routed"), F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("n"))), F.lit(0)).alias("bypassed"),
        F.min_by(F.when(F.col("r").isNotNull(), F.col("r")), F.when(F.col("r").isNotNull(), F.struct(-F.col("n"), F.col("r")))).alias("top_reason"),
    )
    return g.withColumn("share", coverage_bucket(F.col("routed"), F.col("routed") + F.col("bypassed")))


def coverage_buckets(df: DataFrame) -> DataFrame:
    """Events by bucket; one event counts in each of its buckets once."""
    return df.select("host", F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("host", "bucket").agg(F.count("*").alias("n"))


def gateway_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("day_utc", "host", "outcome", latency_bucket(F.col("latency_ms")).alias("latency"), result_bucket(F.col("result_count")).alias("results")).agg(F.count("*").alias("calls"))


def footprint_telemetry(df: DataFrame) -> DataFrame:
    """Captures by bucket of unknown share, body size and input tokens, all three estimates: each capture counts, also one whose body is estimated at zero, below it, or not at all."""
    return df.groupBy(unknown_step(F.col("unknown"), F.col("body_bytes")).alias("unknown_share"), byte_step(F.col("body_bytes")).alias("body_size"), count_step(F.col("tokens")).alias("input_tokens")).agg(F.count("*").alias("n"))


def adoption_transitions(df: DataFrame) -> DataFrame:
    """A marker wherever an install's (day, version) differs from its observation before."""
    w = Window.partitionBy("install_id").orderBy("at", "event_id")
    now = F.struct("day_utc", "version")
    return df.withColumn("before_", F.lag(now).over(w)).where(~F.col("before_").eqNullSafe(now)).select("install_id", "day_utc", "version", "host", "at")


def active_installs(markers: DataFrame, least: int = 5, approximate: bool = False) -> DataFrame:
    """Installs by day, version and host; cells of fewer than `least` are left out. approximate trades exact counts for fixed memory."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return markers.groupBy("day_utc", "version", "host").agg(count("install_id").alias("installs")).where(F.col("installs") >= least)


def dedupe_daily_rows(df: DataFrame) -> DataFrame:
    return df.select("day_utc", "version", "host", "outcome").dropDuplicates(["day_utc", "version", "host", "outcome"])


def semantic_gate_stats(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Judged, losses, preserved and skipped, at a threshold."""
    p = F.col("probability")
    return df.agg(F.count(p).alias("judged"), F.count_if(p >= threshold).alias("losses"), F.count_if(p < threshold).alias("preserved"), F.count_if(p.isNull()).alias("skipped"))


def latest_n(df: DataFrame, n: int, order: str = "at", tie: str = "event_id") -> DataFrame:
    """The newest n rows: a top-k, never a full sort."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(n)
