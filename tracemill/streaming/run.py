"""Running a stream over what is there and reading what it wrote."""

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(spark: SparkSession, stream: DataFrame, timeout_s: int = 600) -> DataFrame:
    """Everything that a stream gives for the input there is now, once all of it has been read.

    State is kept by RocksDB under the checkpoint in the shared folder, so that it survives a lost executor.
    """
    folder = shared_folder(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode("append").start()
        if not q.awaitTermination(timeout_s):
            q.stop()
            raise TimeoutError(f"stream not done in {timeout_s} s")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
