"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, Tables
from ._sql import near_duplicates_sql, repeats_sql
from .classifier import classify_quality
from .decontaminate import contaminated
from .language import identify_language
from .lines import drop_lines
from .merkle import CRC_SQL, fold, leaf_digest, merkle_manifest, merkle_sql, siblings
from .minhash import near_duplicates
from .mixing import mix_sources, mixing_sql
from .quality import quality_rules, quality_sql
from .records import write_records
from .repair import repair_conversations, repair_report, repair_sql
from .substring import remove_repeats
from .tokens import count_tokens, read_vocabulary
from .urls import filter_sql, filter_urls, url_path

#: A public vocabulary of pieces with scores, read by the driver. The file is a BPE model: its pieces and scores are taken as a unigram
#: vocabulary, since no public unigram file is at hand and none is trained, so counts are those of that unigram model.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A public byte-level tokenizer.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_tokens(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), read_vocabulary(vocabulary))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), n=3, percent=85)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), n=13, digest=True)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines_left"), "n_removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number its path ends with; it is a bad outcome if that is labelled poor or toxic."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    shown = pages.select("url", F.regexp_extract(url_path(F.col("url")), "/([0-9]+)$", 1).try_cast("long").alias("doc_id"))
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(pages, shown.join(bad, "doc_id").select("url", "bad"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_records(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Documents written as binary records in the shared folder; the rows are those of the index, which is read from the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    index = write_records(_table(spark, sf_dir, "documents"), f"{Tables(spark).top}/records", tokenizer)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fifth of their rows dropped, emptied, cut, repeated or said by the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, lot = F.coalesce("text", F.lit(" ")), F.crc32(key) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(lot == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.explode(F.when(lot == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where(lot != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of damaged conversations; those without rows after the damage are there too."""
    rows = _table(spark, sf_dir, "conversations")
    broken = damaged(rows)
    report = repair_report(repair_conversations(broken))
    turns = broken.groupBy("conv_id", "turn").agg(F.count("*")).groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"), F.count("turn").alias("n"))
    gaps = turns.select(F.col("conv_id").alias("of"), F.coalesce(F.col("last") - F.col("first") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    out = rows.select("conv_id").distinct().join(gaps, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    out = out.join(report.withColumnRenamed("conv_id", "of"), F.col("conv_id").cast("string").eqNullSafe(F.col("of")), "left").drop("of")
    return out.na.fill({**dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, held against a copy in which a third of the texts are lower-cased."""
    docs = _table(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(touched, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = merkle_manifest(docs, keep={"claimed": leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])})
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op2_tokens": op2_tokens, "op7_classifier": op7_classifier, "op6_lines": op6_lines, "op10_decontaminate": op10_decontaminate, "op8_language": op8_language, "op9_urls": op9_urls, "op1_mixing": op1_mixing, "op3_quality": op3_quality, "op4_minhash": op4_minhash, "op5_substring": op5_substring, "op11_records": op11_records, "op12_conversations": op12_conversations, "op13_merkle": op13_merkle}
_OUTCOMES = "SELECT url, quality = 0 OR toxic = 1 AS bad FROM pages JOIN labels ON doc_id = TRY_CAST(regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/([0-9]+)$', 1) AS BIGINT)"
SQL: dict[str, str] = {"op9_urls": filter_sql("SELECT * FROM pages", _OUTCOMES), "op1_mixing": mixing_sql(), "op3_quality": quality_sql(), "op13_merkle": merkle_sql(), "op12_conversations": repair_sql(crc=CRC_SQL), "op5_substring": repeats_sql(), "op4_minhash": near_duplicates_sql()}
