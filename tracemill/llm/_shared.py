"""Small pieces that several operators share: tables in the shared folder and the word pattern."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls tab to carriage return.
GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lets Spark remove the shuffle files of a job once its table is written.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only a local session gets a new one where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise narrow rows in the shared folder and forget the lineage; a lost executor costs nothing that was cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Parquet tables of one run in the shared folder. A written table has no lineage, so that a lost executor costs nothing that
    is in it; drop() deletes one as soon as the next step has what it needs. What the returned rows still read stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.paths = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame) -> DataFrame:
        path, before = f"{self.top}/{uuid.uuid4().hex}", self.spark.conf.get(TIDY, "false")
        self.spark.conf.set(TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if df in self.paths:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(df))
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def sorted_in(df: DataFrame) -> DataFrame:
    """df as the side of a join that is shuffled and merged, however small it is. Else Spark sends each small table to all executors by way of the driver;
    an operator with dozens of joins, most by node and thus evenly dealt, fills the driver so on little input."""
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """As cut(), for rows with texts: a Parquet table in the shared folder."""
    return Tables(df.sparkSession).put(df)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def versioned(docs: DataFrame, doc_id: str, text: str, keep: bool = False, once: bool = False) -> DataFrame:
    """id, version, t, and with keep the whole row. Only where an id repeats are its rows numbered, equal texts alike; else version is 0.

    With once, rows with the same id and text come back as one."""
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"), *more)
    again = slim.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    if again.isEmpty():
        return slim.withColumn("version", F.lit(0))
    number = F.dense_rank().over(Window.partitionBy("id").orderBy(F.xxhash64("t"), "t")) - 1
    some = slim.join(again, "id", "left_semi").withColumn("version", number)
    some = some.dropDuplicates(["id", "version"]) if once else some
    rest = slim.join(again, "id", "left_anti").withColumn("version", F.lit(0))
    return some.unionByName(rest)
