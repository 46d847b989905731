"""Expected rows written by hand for cases that the test tables never reach."""

import pytest

from tracemill.functions import text as T
from tracemill.operators import bounding as B
from tracemill.operators import metrics as M
from tracemill.operators import usage as U


def test_rows_without_identity_never_merge(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 1, 4), ("b", 2, 5)], "request_key string, output long, seq long")
    got = sorted(map(str, ((r.request_key, r.output, r.duplicates, r.conflict) for r in U.dedupe_revisions(df, "request_key", ["output"], "seq").collect())))
    assert got == sorted(map(str, [(None, 1, 0, False), (None, 1, 0, False), ("a", 1, 1, False), ("b", 1, 1, True)]))


def test_missing_evidence_wins_over_failed(spark):
    bounds = spark.createDataFrame([("p50", "max", 10), ("pairs", "min", 5)], "check string, kind string, bound long")
    seen = spark.createDataFrame([("x", "p50", 11), ("y", "p50", 11), ("y", "pairs", 5), ("z", "p50", 10), ("z", "pairs", 6)], "report string, check string, value long")
    got = {r.report: (r.decision, list(r.reasons)) for r in M.gateway_gate(seen, bounds).collect()}
    assert got == {"x": ("insufficient-evidence", ["p50:fail", "pairs:missing"]), "y": ("no-go", ["p50:fail"]), "z": ("go", [])}


@pytest.mark.parametrize("text,useless", [("Command completed successfully with no output.", True), (" no output. ", True), ("(no output)", True), ("done", False), ("no output", False), ("", False)])
def test_useless_success(spark, text, useless):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(T.useless_success(F.col("t"))).first()[0] is useless


def test_salvage_lines(spark):
    lines = ["head", "a warning here", "plain", "error one", "# pass 3", "# todo 1", "Fatal two", "é error three", "tail error"]
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "result_id long, output string")
    got = {r.result_id: list(r.lines) for r in B.salvage_lines(df, 4, 10).collect()}
    assert got == {1: ["# pass 3", "# todo 1", "error one", "Fatal two", "é error three", "a warning here"], 2: [], 3: []}
    many = "\n".join(["x", *(f"# pass {k}" for k in range(6)), *(f"error {k}" for k in range(9)), "y"]).encode()
    assert B.salvage(many, 1, len(many) - 1) == [*(b"# pass %d" % k for k in range(4)), *(b"error %d" % k for k in range(4))]


def test_cleaned_text_is_computed_once(spark):
    rows = [(1, "bash", "p", "make", "x " * 4000, "w")]
    df = spark.createDataFrame(rows, "result_id long, tool string, path string, command string, output string, workspace string")
    plan = B.bound_results(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 120
