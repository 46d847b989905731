"""Known answers for history, caches, artifacts, telemetry and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tracemill.operators import artifacts as A
from tracemill.operators import cache as C
from tracemill.operators import history as H
from tracemill.operators import telemetry as T
from tracemill.plans.registry import QUERIES
from tracemill.streaming import jobs as J

ITEM = "request_id long, position int, ordinal int, tool string, path string, lo long, hi long, output string, is_error boolean, is_current boolean, input string"


def items(spark, *rows):
    return spark.createDataFrame([(1, p, 0, tool, path, lo, hi, out, err, cur, f"{path}:{lo}:{hi}") for p, tool, path, lo, hi, out, err, cur in rows], ITEM)


def test_superseded(spark):
    df = items(spark, (0, "read", "a", 1, 20, "x", False, False), (1, "read", "a", None, None, "y", False, False), (2, "read", "b", 1, 5, "x", False, False), (3, "read", "b", 2, 9, "x", False, False), (4, "read", "c", None, None, "x", False, False), (5, "read", "c", 1, 9, "x", False, False), (6, "read", "d", 3, 4, "z", False, False), (7, "read", "d", 1, 9, "(no output)", False, False))
    assert [r.position for r in H.superseded_reads(df).collect()] == [0]


def test_compact_history_order(spark):
    log = "\n".join(["warning: the same thing"] * 4)
    df = items(spark, (0, "grep", "a", None, None, "match " * 20, False, False), (1, "grep", "a", None, None, "match " * 20, False, False), (2, "bash", "a", None, None, log, False, False), (3, "bash", "b", None, None, log, False, True), (4, "bash", "c", None, None, "(no output)", False, False))
    got = {r.position: r for r in H.compact_history(df).collect()}
    assert got[0].reason == "duplicate" and got[1].reason is None and got[2].reason == "repeated-lines" and got[3].reason is None
    assert got[4].reason is None or len(got[4].output) < len("(no output)")
    assert H.history_stats(H.compact_history(df)).first().rewrites >= 2


def test_budget_trigger(spark):
    row = lambda c, n: (1, c, 0, f"c{c}", n, False, False)
    schema = "request_id long, position int, ordinal int, call_id string, tokens long, is_error boolean, is_current boolean"
    assert H.history_candidates(spark.createDataFrame([row(0, 400), row(1, 400)], schema), 1000).count() == 0
    assert H.history_candidates(spark.createDataFrame([row(0, 400), row(1, 401)], schema), 1000).count() == 2


def test_cache_guard(spark):
    f = lambda r, s, m, i: spark.range(1).select(H.cache_guard(F.lit(r), F.lit(s), F.lit(m), F.lit(i).cast("long"))).first()[0]
    assert f(10, 35000, True, 60) and not f(10, 35000, True, 65 * 60) and not f(10, 35000, False, 60) and not f(10, 0, True, 60) and not f(51, 100, True, 60) and f(50, 100, True, None)


def test_items_of_all_shapes(spark):
    bodies = [
        ("a", {"messages": [{"role": "assistant", "content": [{"type": "tool_use", "id": "1", "name": "Read", "input": {"path": "x"}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]}]}),
        ("c", {"messages": [{"role": "assistant", "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "1", "content": "r"}]}),
        ("r", {"input": [{"type": "function_call", "call_id": "1", "name": "f", "arguments": "{}"}, {"type": "function_call_output", "call_id": "1", "output": "s"}, {"type": "function_call", "call_id": "2", "name": "f", "arguments": "{}"}]}),
        ("n", {"messages": [{"role": "user", "content": "hi"}]}),
    ]
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in bodies], "request_id string, body string")
    got = {(r.request_id, r.kind, r.call_id): r for r in H.collect_items(df).collect()}
    assert got["a", "result", "1"].output == "p\nq" and got["a", "result", "1"].is_current
    assert got["c", "result", "1"].output == "r" and got["c", "result", "1"].is_current and got["c", "call", "1"].tool == "f"
    assert got["r", "result", "1"].output == "s" and not got["r", "result", "1"].is_current
    assert not any(k[0] == "n" for k in got)


TURN = "session_id long, turn int, at timestamp, cached long, cache_write long, prompt long, tools_digest string, system_digest string, messages array<string>, breakpoint boolean"


def turns(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [
        (t0, 0, "t", "s", ["a"], True), (t0, 100, "t", "s", ["a", "b"], True), (t0, 0, "u", "s", ["a", "b"], True), (t0, 0, "u", "v", ["a", "b"], True), (t0, 0, "u", "v", ["a", "c"], True),
        (t0, 0, "u", "v", ["a", "c", "d"], False), (t0, 0, "u", "v", ["a", "c", "d"], True), (t0 + dt.timedelta(hours=2), 0, "u", "v", ["a", "c", "d"], True), (t0 + dt.timedelta(hours=2), 0, "u", "v", ["a", "c", "d"], True),
    ]
    return spark.createDataFrame([(1, k, at, c, 0, 500 if k == 6 else 5000, tools, sys, m, b) for k, (at, c, tools, sys, m, b) in enumerate(rows)], TURN)


CAUSES = ["cold-start", None, "tools-changed", "system-changed", "history-rewritten", "no-breakpoint", "below-minimum", "ttl-expired", "unexplained"]


def test_miss_causes(spark):
    got = C.cache_miss_cause(turns(spark)).orderBy("turn").collect()
    assert [r.cause for r in got] == CAUSES and got[4].divergence == 1
    s = C.cache_session_summary(C.cache_miss_cause(turns(spark))).first()
    assert (s.turns, s.hits, s.misses, s.read) == (9, 1, 8, 100)


def test_first_divergence(spark):
    f = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(C.first_divergence(F.col("a"), F.col("b"))).first()[0]
    assert f(["a", "b"], ["a", "b", "c"]) is None and f(["a", "b"], ["a"]) == 1 and f(["a", "b"], ["a", "c"]) == 1 and f([], ["a"]) is None and f(["a"], []) == 0


def test_context_bytes_add_up(spark):
    body = {"system": "be good", "tools": [{"name": "own_x"}, {"name": "mcp__y"}, {"name": "z"}], "messages": [{"role": "user", "content": "old"}, {"role": "user", "content": "new"}], "model": "m"}
    df = spark.createDataFrame([("q", json.dumps(body)), ("bad", "{")], "request_id string, body string")
    seg = C.classify_context(df)
    assert sorted(r.category for r in seg.collect()) == ["builtin-tools", "history", "host-instructions", "mcp-tools", "own-tools", "provider-overhead", "user-prompt"]
    total = seg.agg(F.sum("bytes")).first()[0]
    foot = C.footprint_by_category(seg, spark.createDataFrame([("q", total + 7), ("bad", 3)], "request_id string, body_bytes long"))
    got = {r.request_id: r for r in foot.collect()}
    assert got["q"].unknown == 7 and got["q"].status == "partial" and got["bad"].status == "unavailable"
    assert sum(got["q"][c.replace("-", "_")] for c in C.CATEGORIES) == total + 7


def test_artifacts(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([("one\ntwo\nthree",), ("one\ntwo\nthree",), ("x",)], "content string")
    A.write_artifacts(df, store)
    A.write_artifacts(df, store)
    kept = spark.read.parquet(store)
    assert kept.count() == 2
    digest = next(r.digest for r in kept.collect() if r.bytes > 1)
    h = spark.createDataFrame([(digest[:16], 2, 2), (digest, None, None), ("f" * 16, None, None), ("zz", None, None)], "handle string, first int, last int")
    got = {r.handle: (r.status, r.content) for r in A.recover_artifacts(h, kept).collect()}
    assert got[digest[:16]] == ("ok", "two") and got[digest] == ("ok", "one\ntwo\nthree") and got["f" * 16] == ("missing", None) and got["zz"] == ("invalid", None)


def test_adoption_returns_count(spark):
    at = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("i", at + dt.timedelta(minutes=k), k, at.date(), v, "h") for k, v in enumerate("ABBA")], "install_id string, at timestamp, event_id int, day_utc date, version string, host string")
    assert [r.version for r in T.adoption_transitions(df).orderBy("at").collect()] == ["A", "B", "A"]
    assert T.active_installs(T.adoption_transitions(df)).count() == 0


def test_coverage(spark):
    rows = [(True, None)] * 3 + [(False, "reason1")] * 60 + [(False, "reason0")] * 20 + [(False, "weird")]
    df = spark.createDataFrame([("2026-01-01", "h", r, x) for r, x in rows], "day_utc string, host string, routed boolean, reason string")
    r = T.coverage_summary(df).first()
    assert (r.routed, r.bypassed, r.share, r.top_reason) == (3, 81, "1_to_10pct", "reason1")


def test_judged_once_and_restored(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def judge(original: pd.Series, preview: pd.Series) -> pd.Series:
        return (original.str.len() - preview.str.len()) / original.str.len()

    o = spark.createDataFrame([(1, "a long original"), (2, "same"), (3, "a long original")], "id long, output string")
    p = spark.createDataFrame([(1, "a"), (2, "same"), (3, "a long origina")], "id long, output string")
    pairs = H.original_vs_preview(o, p, ["id"])
    out = {r.id: r for r in H.restore_losses(pairs, H.judge_pairs(pairs, judge, ["id"]), ["id"]).collect()}
    assert set(out) == {1, 3} and out[1].output == "a long original" and out[3].output == "a long origina"


def test_stream_cache_attribution_is_its_twin(spark, tmp_path):
    turns(spark).repartition(1).write.parquet(str(tmp_path / "in"))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = J.stream_cache_attribution(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("attributed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    spark.conf.unset(name)
    assert [r.cause for r in spark.table("attributed").orderBy("turn").collect()] == CAUSES


def test_price_join_is_broadcast(spark):
    plan = QUERIES["jn3_price_requests"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
