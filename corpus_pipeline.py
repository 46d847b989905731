"""Documents to training mix: quality rules, line dedup, near-duplicate dedup, decontamination, mixing to weights.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns the mix.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._shared import Tables, sorted_in
from tracemill.llm.decontaminate import drop_contaminated
from tracemill.llm.lines import drop_lines
from tracemill.llm.minhash import near_duplicates
from tracemill.llm.mixing import mix_sources
from tracemill.llm.quality import keep_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur, alike or nearly so, in an earlier place; n_chars follows the text."""
    out = drop_lines(docs).drop("n_removed_lines")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles similar to 0.8 or more; rows without an id stay."""
    dropped = near_duplicates(docs, n=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(sorted_in(dropped), "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: MinHash and alignment have no DuckDB form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage acts on its input several times, so each result is written once, and deleted after the next."""
    tables, docs = Tables(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, tables.put(stage(spark, docs, sf_dir))
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
