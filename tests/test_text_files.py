"""Many small text files: written by tasks, read in few tasks, some folders at a time."""

import hashlib

from conftest import SF, same_rows
from pyspark.sql import functions as F

from tracemill.plans.registry import QUERIES, SQL
from tracemill.sources import readers as R

TEXT = "value string"


def test_a_folder_of_small_files_is_read_in_one_task(spark):
    assert QUERIES["src6_read_all_text_files"](spark, SF).rdd.getNumPartitions() <= 2


def test_all_texts_in_shares(spark, duck, monkeypatch):
    """Folders of 7 files, 3 of them at a time, give what one reading gives."""
    monkeypatch.setattr(R, "FOLDER", 7)
    monkeypatch.setattr(R, "FOLDERS", 3)
    same_rows(QUERIES["src6_read_all_text_files"](spark, SF), duck, SQL["src6_read_all_text_files"])


def test_text_files_as_bytes(spark, tmp_path):
    """Each row is a file: equal texts, none, an empty one, line ends and letters of any kind; a path with and without a scheme."""
    texts = ["same", "same", None, "", "a\r\nb\n", "é 😀", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], TEXT).coalesce(1)
    for path in (f"{tmp_path}/a", f"file://{tmp_path}/b", f"file:{tmp_path}/c"):
        folders = R.write_text_files(df, path)
        got = R.read_text_files(spark, folders, least=0).select(F.sha2("text", 256), "bytes").collect()
        want = [((t or "") + "\n").encode() for t in texts]
        assert sorted(tuple(r) for r in got) == sorted((hashlib.sha256(t).hexdigest(), len(t)) for t in want)


def test_no_text_files(spark, tmp_path):
    folders = R.write_text_files(spark.createDataFrame([], TEXT), f"{tmp_path}/none")
    assert folders == []
    assert R.each_text_file(spark, folders, lambda d: d.select("bytes")).collect() == []
