"""A folder that the driver and all executors see."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the session's spark.checkpoint.dir; only a local session has a local one where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-shared-')}/{uuid.uuid4().hex}"
