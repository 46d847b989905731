"""Content-addressed originals: storing, finding again, expiring."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def distinct_artifacts(df: DataFrame, content: str = "content") -> DataFrame:
    """digest, bytes and content, once for each distinct content."""
    d = df.select(F.sha2(F.col(content), 256).alias("digest"), F.col(content).alias("content"), F.octet_length(F.col(content)).cast("long").alias("bytes"))
    return d.dropDuplicates(["digest"])


def new_artifacts(now: DataFrame, before: DataFrame) -> DataFrame:
    """Digests there are now and were not before."""
    return now.select("digest").distinct().join(before.select("digest"), "digest", "left_anti")


def write_artifacts(df: DataFrame, path: str, content: str = "content") -> None:
    """Adds what the store does not have; storing again changes nothing."""
    spark = df.sparkSession
    fresh = distinct_artifacts(df, content)
    try:
        fresh = fresh.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.withColumn("shard", F.left("digest", F.lit(2))).write.partitionBy("shard").mode("append").parquet(path)


def recover_artifacts(handles: DataFrame, store: DataFrame, most_bytes: int = 65536) -> DataFrame:
    """handle, content, status for handles of 16 to 64 hex digits with first and last line (null: all).

    Handles meet the store on 16 digits, the rest is compared after; a handle must fit one digest, and the content its digest.
    """
    h = handles.withColumn("short", F.substring("handle", 1, 16))
    s = store.withColumn("short", F.substring("digest", 1, 16))
    j = h.join(s, "short", "left").withColumn("fits", F.coalesce(F.startswith("digest", F.col("handle")), F.lit(False)))
    j = j.withColumn("n", F.count_if("fits").over(Window.partitionBy("handle"))).where("fits or n = 0").dropDuplicates(["handle"])
    part = F.when(F.col("first").isNull(), F.col("content")).otherwise(T.slice_lines(F.col("content"), F.col("first"), F.col("last")))
    good = (F.col("n") == 1) & (F.sha2("content", 256) == F.col("digest"))
    status = F.when(~F.col("handle").rlike("^[0-9a-f]{16,64}$"), "invalid").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(good, "ok").otherwise("corrupt")
    return j.select("handle", F.when(status == "ok", T.truncate_utf8(part, most_bytes)).alias("content"), status.alias("status"))


def evict_artifacts(df: DataFrame, now: str, ttl_days: int = 7, most_bytes: int = 64 << 20) -> DataFrame:
    """The artifacts of each workspace to keep: not too old, and newest first within the byte limit."""
    w = Window.partitionBy("workspace").orderBy(F.desc("created_at"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    fresh = df.where(F.col("created_at") > F.expr(f"timestamp_ntz'{now}' - interval {ttl_days} days"))
    return fresh.withColumn("run", F.sum("bytes").over(w)).where(F.col("run") <= most_bytes).drop("run")


def recovery_census(retrievals: DataFrame, elisions: DataFrame, store: DataFrame) -> DataFrame:
    """Each retrieval (session, ref, turn) with the latest earlier elision of its ref in the session, whether in the same turn, and whether it is still stored."""
    both = retrievals.select("session_id", "ref", "turn", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("elided")).unionByName(elisions.select("session_id", "ref", "turn", F.lit(0).alias("kind"), F.col("turn").cast("long").alias("elided")))
    w = Window.partitionBy("session_id", "ref").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("elided_turn", F.last("elided", ignorenulls=True).over(w)).where("kind = 1")
    kept = store.select("ref").distinct().withColumn("kept_", F.lit(True))
    return j.join(kept, "ref", "left").select("session_id", "ref", "turn", "elided_turn", (F.col("elided_turn") == F.col("turn")).alias("same_turn"), F.coalesce("kept_", F.lit(False)).alias("stored"))
