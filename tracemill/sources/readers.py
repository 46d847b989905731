"""Transcripts, ledgers, price profiles, redaction rules and text corpora as DataFrames; rollups as tables."""

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import digest
from .shared import shared_folder

#: Folders that are not a corpus of one's own.
VENDORED = ("node_modules", "vendor", "dist", "build", ".git", "target", "__pycache__")
#: Text files that write_text_files() puts into a folder, and folders that each_text_file() reads at a time: the driver lists no more files than both multiplied.
FOLDER, FOLDERS = 1000, 64
PRICES = "profile_id string, provider string, model string, service string, regional boolean, threshold long, " + ", ".join(f"{t}_{p} decimal(18,3)" for t in ("short", "long") for p in ("fresh", "read", "write", "output"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (unique and rising in a file), value and body (VARIANT) of every JSON object in the files under a folder; other lines are skipped."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    return raw.where("trim(value) <> ''").withColumn("body", F.try_parse_json("value")).where("body is not null and schema_of_variant(body) like 'OBJECT%'")


def transcript_usage(lines: DataFrame) -> DataFrame:
    """file, line_no, message_id, kind and usage (JSON) of the lines that report tokens: assistant messages, results, finished turns."""
    get = lambda p: F.try_variant_get("body", p, "string")
    kind = F.coalesce(get("$.type"), F.lit(""))
    usage = F.when(kind == "assistant", F.to_json(F.try_variant_get("body", "$.message.usage", "variant"))).when(kind.isin("result", "turn.completed"), F.to_json(F.try_variant_get("body", "$.usage", "variant")))
    return lines.select("file", "line_no", get("$.message.id").alias("message_id"), kind.alias("kind"), usage.alias("usage"), get("$.total_cost_usd").try_cast("double").alias("cost_usd")).where("usage is not null")


def dedupe_messages(usage: DataFrame) -> DataFrame:
    """The last line of each message id of a file; lines without an id all stay."""
    key = F.coalesce("message_id", F.concat(F.lit("line:"), F.col("line_no").cast("string")))
    return usage.withColumn("key_", key).groupBy("file", "key_").agg(F.max_by(F.struct(*usage.columns), F.col("line_no")).alias("r")).select("r.*")


def read_ledger(spark: SparkSession, path: str, schema: T.StructType | str, tag: str, snapshot: bool = False) -> DataFrame:
    """Records of a JSON Lines ledger, or of a snapshot {records: [...]}; a malformed file raises, records with another schema tag are left out."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if snapshot:
        whole = T.StructType([T.StructField("records", T.ArrayType(want))])
        df = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("records").alias("r")).select("r.*")
    else:
        df = spark.read.schema(want).option("mode", "FAILFAST").json(path)
    return df.where(F.col("schema") == tag)


def stream_ledger(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """An append-only JSON Lines ledger as a stream of its new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def load_pricing(spark: SparkSession, path: str, digests: DataFrame | None = None) -> DataFrame:
    """Price profiles in USD for a million tokens as whole nano-dollars a token; rates with over three decimals, or negative, and thresholds under 1 raise.

    digests (profile_id, digest): what checked_profiles() holds the files against; a profile that differs raises when it is read.
    A profile: {profile_id, provider, model, service, regional, threshold, short: {fresh, read, write, output}, long: {...}}.
    """
    rate = "struct<fresh:decimal(38,9),read:decimal(38,9),write:decimal(38,9),output:decimal(38,9)>"
    df = spark.read.schema(f"profile_id string, provider string, model string, service string, regional boolean, threshold long, short {rate}, long {rate}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = df.select("profile_id", "provider", "model", "service", "regional", F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(F.raise_error(F.lit("threshold")).cast("long")).alias("threshold"), "short", "long")
    for tier in ("short", "long"):
        for part in ("fresh", "read", "write", "output"):
            x = F.col(f"{tier}.{part}")
            good = (x >= 0) & (F.round(x, 3) == x)
            out = out.withColumn(f"{tier}_{part}", F.when(good, (x * 1000).cast("long")).otherwise(F.raise_error(F.lit(f"bad rate: {tier} {part}")).cast("long")))
    out = out.drop("short", "long")
    return out if digests is None else out.join(checked_profiles(spark, path, digests), "profile_id")


def checked_profiles(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """profile_id, digest of the price profiles under path; reading raises where one has no digest in `digests` (profile_id, digest), or another.

    The digest is the SHA-256 of the profile's canonical JSON: keys sorted at every depth, no white space, whatever the file looks like. A file holds a profile or an array of them.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file"))
    each = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(F.schema_of_variant("v").startswith("OBJECT"), F.array("v"))
    each = F.coalesce(each, F.raise_error(F.concat(F.lit("not a profile: "), F.col("file"))).cast("array<variant>"))
    found = whole.select(F.explode(each).alias("x")).select(F.try_variant_get("x", "$.profile_id", "string").alias("profile_id"), digest(F.to_json("x")).alias("digest"))
    both = found.join(digests.select("profile_id", F.col("digest").alias("want")), "profile_id", "left")
    same = F.col("digest") == F.col("want")
    return both.select("profile_id", F.when(same, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("profile differs from its version: "), F.coalesce("profile_id", F.lit("?"))))).alias("digest"))


def load_redaction_rules(text: str) -> tuple[tuple[str, ...], tuple[tuple[str, int, int | None], ...], str]:
    """(assignment keys, token prefixes, digest) of a JSON rule file {rules: [...]}; rules of an unknown kind, over 100 or twice raise."""
    import hashlib

    rules = json.loads(text)["rules"]
    keys, prefixes = [], []
    for r in rules:
        if r.get("type") == "assignment-key" and set(r) == {"type", "key"}:
            keys.append(r["key"])
        elif r.get("type") == "token-prefix" and {"type", "prefix", "minLength"} <= set(r) <= {"type", "prefix", "minLength", "maxLength"}:
            prefixes.append((r["prefix"], int(r["minLength"]), r.get("maxLength")))
        else:
            raise ValueError(f"not a rule: {r}")
    if len(rules) > 100 or len(set(keys)) < len(keys) or len({p[0] for p in prefixes}) < len(prefixes):
        raise ValueError("at most 100 rules, each once")
    keys, prefixes = sorted(keys), sorted(prefixes, key=lambda p: p[0])
    return tuple(keys), tuple(prefixes), "sha256:" + hashlib.sha256(json.dumps([keys, prefixes], separators=(",", ":")).encode()).hexdigest()


def write_text_files(df: DataFrame, path: str, text: str = "value") -> list[str]:
    """A file for each row's text and a line end (null: just that), of any number of rows; returns the folders made under path, of up to FOLDER files each.

    A try of a task has folders of its own and only those of the tries that ended are returned, so that a task run twice leaves no file twice. Files are written through Arrow (local and shared
    file systems, HDFS, S3 and the like): Spark's writer moves each file to its place one after the other on the driver, and on a file system without Hadoop's native library starts several processes a file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = FileSystem.from_uri(path)
        n = 0
        for batch in batches:
            for value in batch.column(0):
                if n % FOLDER == 0:
                    name = uuid.uuid4().hex
                    store.create_dir(f"{top}/{name}")
                    yield pa.record_batch({"folder": [f"{path}/{name}"]})
                with store.open_output_stream(f"{top}/{name}/{n}.txt") as out:
                    out.write((value.as_py() or b"") + b"\n")
                n += 1

    return [r.folder for r in df.select(F.col(text).cast("string").cast("binary")).mapInArrow(write, "folder string").collect()]


def read_text_files(spark: SparkSession, path: str | list[str], least: int = 1024, most: int = 4 << 20) -> DataFrame:
    """path, text and bytes of files within a size range, outside vendored folders, without a NUL in the first 8 KiB. The driver lists all files; a list of folders is read in a task for each.

    Spark puts few small files into a partition, since it adds a fixed cost to the size of each: a folder of these would be thousands of tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    vendored = "/(" + "|".join(v.replace(".", "\\.") for v in VENDORED) + ")/"
    some = files.where(F.col("length").between(least, most) & ~F.col("path").rlike(vendored))
    some = some.where(~F.contains(F.substring("content", 1, 8192), F.lit(bytearray(b"\0"))))
    some = some.select("path", F.col("content").cast("string").alias("text"), F.col("length").alias("bytes"))
    return some if isinstance(path, str) else some.coalesce(max(1, len(path)))


def each_text_file(spark: SparkSession, folders: list[str], step: Callable[[DataFrame], DataFrame], least: int = 1024, most: int = 4 << 20) -> DataFrame:
    """step(read_text_files()) over any number of folders, where step treats each row by itself. FOLDERS of them are read at a time and what step gives is kept as a table, so that the driver never lists all files."""
    shares = [folders[k : k + FOLDERS] for k in range(0, len(folders), FOLDERS)]
    if not shares:
        return step(spark.createDataFrame([], "path string, text string, bytes long"))
    if len(shares) == 1:
        return step(read_text_files(spark, folders, least, most))
    kept = shared_folder(spark)
    for share in shares:
        rows = step(read_text_files(spark, share, least, most))
        rows.write.mode("append").parquet(kept)
    return spark.read.schema(rows.schema).parquet(kept)


def write_rollups(df: DataFrame, path: str, day: str = "day_utc") -> None:
    """Daily rows, a folder for each day; writing a day again replaces it and leaves others."""
    df.repartition(day).write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def wire_rows(df: DataFrame) -> DataFrame:
    """One JSON text for each row, keys in column order, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
