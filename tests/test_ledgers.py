"""Merging, selection, counters, costs, the judge, gates and decisions against plain loops and by cases."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.functions.numbers import canonical_json, digest
from tracemill.operators import history as H
from tracemill.operators import metrics as M
from tracemill.operators import usage as U
from tracemill.sources import readers as R

# --- SET1


def merged(rows):
    """Rows (key, host, receipt, snapshot, seq, content) one after the other."""
    kept, receipts = {}, set()
    for key, host, receipt, snapshot, seq, content in sorted(rows, key=lambda r: (not r[3], r[4])):
        if not key.startswith("event:") and (host, receipt) in receipts:
            continue
        if key in kept:
            kept[key][1] += 1
            kept[key][2] |= kept[key][3] != (host, receipt, content)
            continue
        kept[key] = [seq, 0, False, (host, receipt, content)]
        receipts.add((host, receipt))
    return {k: tuple(v[:3]) for k, v in kept.items()}


@pytest.mark.parametrize("seed", range(4))
def test_merge_receipts_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(400):
        host, receipt = rng.choice(["a", "b", None]), rng.choice([f"r{rng.randrange(60)}", None]) if seed else f"r{rng.randrange(60)}"
        key = f"event:{rng.randrange(150)}" if rng.random() < 0.6 else f"receipt:{host}/{receipt}"
        rows.append((key, host, receipt, rng.random() < 0.2, seq, rng.randrange(2)))
    df = spark.createDataFrame(rows, "event_key string, host string, receipt_digest string, snapshot boolean, seq long, content int")
    got = {r.event_key: (r.seq, r.replays, r.conflict) for r in M.merge_receipts(df).collect()}
    assert got == merged(rows)
    assert M.merge_receipts(df.limit(0)).count() == 0


# --- TOP4


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_upper_median_brute_force(spark, rounds):
    rng = random.Random(rounds)
    rows = [("one", 5), ("two", 9), ("two", 3), ("four", 1), ("four", 2), ("four", 3), ("four", 4), (None, 7), (None, 8), ("empty", None), ("odd", None), ("odd", 2)]
    rows += [("same", 4)] * 500 + [("hot", rng.randrange(10**6)) for _ in range(9001)] + [("steep", int(10 ** (rng.random() * 17))) for _ in range(3000)] + [("edge", 2**62 + k) for k in range(1000)] + [("mass", 0)] * 2000 + [("mass", k) for k in range(1, 2001)]
    rng.shuffle(rows)
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    got = {r.g: r.median for r in M.upper_median(spark.createDataFrame(rows, "g string, v long"), "g", "v", rounds).collect()}
    assert got == {g: sorted(v)[len(v) // 2] for g, v in want.items()}


def test_upper_median_sorts_no_group(spark):
    """Of a group of 200,000 different values only a sliver is put in order, and the window stands on counted values."""
    df = spark.range(200_000).select(F.lit("hot").alias("by_"), (F.col("id") * 7919 % 200_003).alias("value_"))
    one, two = (M._narrowed(df, rounds).first() for rounds in (1, 2))
    assert one.hi - one.lo < 200_000 * 5 / M.QUANTILES and two.hi - two.lo < 200
    plan = M.upper_median(df, "by_", "value_")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate [" in plan[plan.index("Window [") :].split("Join")[0]


# --- WIN6


def turn_rows(rng):
    """Notifications of some threads: (thread, turn, seq, total, last, window)."""
    rows, seq = [], 0
    for thread in range(25):
        total = [0] * 6
        for turn in range(1, rng.randint(2, 7)):
            if rng.random() < 0.1:
                total = [0] * 6
            for _ in range(rng.randint(1, 4)):
                last = [rng.randrange(50) for _ in range(6)]
                total = [a + b for a, b in zip(total, last, strict=True)]
                told = [None if rng.random() < 0.02 else -1 if rng.random() < 0.02 else x for x in total]
                for _ in range(rng.choice([1, 1, 2])):
                    rows.append((thread, turn, seq, tuple(told), tuple(None if rng.random() < 0.02 else x for x in last), rng.choice([1000] * 9 + [0, None])))
                    seq += 1
    return rows


def turn_reports(rows):
    out, before = {}, {}
    for thread, turn in sorted({r[:2] for r in rows}):
        seen, requests, total = set(), [], None
        for _, _, _, told, last, window in sorted([r for r in rows if r[:2] == (thread, turn)], key=lambda r: r[2]):
            told = tuple(x if x is not None and x >= 0 else None for x in told)
            if told not in seen:
                seen.add(told)
                total = told
                requests.append((last, window))
        past = before.get(thread, [0] * 6)
        delta = [a - (b or 0) if a is not None and a >= (b or 0) else None for a, b in zip(total, past, strict=True)]
        fine = all(w and None not in last for last, w in requests) and [sum(x) for x in zip(*[r for r, _ in requests], strict=True)] == delta if all(None not in r for r, _ in requests) else False
        out[thread, turn] = (len(requests), list(total), delta, "complete" if None not in delta else "incomplete", bool(fine))
        before[thread] = total
    return out


@pytest.mark.parametrize("seed", range(3))
def test_turn_usage_brute_force(spark, seed):
    rows = turn_rows(random.Random(seed))
    kind = "struct<" + ",".join(f"{c}:long" for c in U.COUNTERS) + ">"
    df = spark.createDataFrame(rows, f"thread_id int, turn int, seq int, total {kind}, last {kind}, context_window int").repartition(3)
    got = {(r.thread_id, r.turn): (r.requests, [r[f"total_{c}"] for c in U.COUNTERS], [r[f"delta_{c}"] for c in U.COUNTERS], r.status, r.reconciled) for r in U.turn_usage(df).collect()}
    assert got == turn_reports(rows)
    assert U.turn_usage(df.limit(0)).count() == 0


# --- AGG3


def test_current_period(spark):
    """The period of now is there when empty, and marked when it is not; the zone decides which it is."""
    rows = [("e1", 1, "2024-12-30 07:30:00", "h", "s", 100, 40)]
    df = spark.createDataFrame(rows, "event_key string, seq long, at string, host string, session_id string, input_tokens long, inline_tokens long").withColumn("at", F.col("at").cast("timestamp"))
    got = {(r.period, r.key): (r.events, r.sessions, r.savings, r.current) for r in M.metrics_by_period(df, "America/Los_Angeles", "2024-12-30 09:00:00").collect()}
    assert got == {("day", "2024-12-29"): (1, 1, 60, False), ("day", "2024-12-30"): (0, 0, 0, True), ("week", "2024-W52"): (1, 1, 60, False), ("week", "2025-W01"): (0, 0, 0, True), ("month", "2024-12"): (1, 1, 60, True)}
    assert {(r.key, r.events, r.current) for r in M.metrics_by_period(df.limit(0), "UTC", "2024-12-30 09:00:00").collect()} == {("2024-12-30", 0, True), ("2025-W01", 0, True), ("2024-12", 0, True)}


# --- PRJ13, PRJ14, AGG6


def test_stated_cost_cases(spark):
    cases = [(f'{"".join(chr(123) + json.dumps(p) + ":" for p in path.split("."))}0.25{"}" * (path.count(".") + 1)}', (k, 0.25, 250_000_000)) for k, path in enumerate(U.COST_PATHS, 1)]
    cases += [
        ("{}", None), ("null", None), ("[1]", None), ('{"cost_usd":"1"}', None), ('{"cost_usd":-1}', None), ('{"cost_usd":true}', None), ('{"cost_usd":null,"costUsd":2}', (4, 2.0, 2_000_000_000)), ('{"cost":0.5}', None), ('{"cost":{"usd":0}}', (11, 0.0, 0)),
        ('{"cost_usd":1e-9}', (3, 1e-9, 1)), ('{"cost_usd":1e-10}', (3, 1e-10, None)), ('{"cost_usd":0.1234567891}', (3, 0.1234567891, None)), ('{"cost_usd":0.123456789}', (3, 0.123456789, 123_456_789)), ('{"cost":{"usd":3},"usage":{"totalCostUsd":-2}}', (11, 3.0, 3_000_000_000)),
    ]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, body string").select("k", U.stated_cost(F.try_parse_json("body")).alias("c"))
    for (body, want), r in zip(cases, df.orderBy("k").collect(), strict=True):
        assert (tuple(r.c) if r.c else None) == want, body


def test_cost_summary_cases(spark):
    """(host, session, event, at, seq, nano, scope, source, tokens)"""
    rows = [
        ("latest", "s", "1", 5, 1, 900, "session", "x", 10), ("latest", "s", "2", 7, 2, 300, "session", "y", 10), ("latest", "s", "3", 7, 3, 400, "session", "y", 0), ("latest", "s", "4", 9, 4, None, "session", "x", 0), ("latest", "s", "5", 9, 5, 5, "turn", "x", 0),
        ("sum", "s", "1", 1, 1, 10, "turn", "x", 5), ("sum", "s", "2", 2, 2, 20, "turn", "y", 5), ("part", "s", "1", 1, 1, 10, "turn", None, 5), ("part", "t", "2", 1, 1, None, "turn", "x", 5), ("none", "s", "1", 1, 1, -4, "session", "x", 5),
        ("alone", None, "1", 1, 1, 10, "turn", "x", 0), ("alone", None, "2", 1, 1, 20, "turn", "x", 0),
    ]
    df = spark.createDataFrame(rows, "host string, session_id string, event_key string, at int, seq int, cost_nano long, cost_scope string, cost_source string, total_tokens long")
    got = {r.host: tuple(r)[1:] for r in U.reported_cost_summary(df).collect()}
    assert got == {"latest": (1, 1, 400, "complete", "y", 20_000_000), "sum": (1, 1, 30, "complete", "mixed", 3_000_000), "part": (2, 1, None, "partial", "unknown", None), "none": (1, 0, None, "unavailable", "unknown", None), "alone": (2, 2, 30, "complete", "x", None)}


# --- UDF2


def test_judge_fails_open(spark):
    """A judge that raises, lies or answers too little costs only its own pairs; equal pairs are one call, and the budget is for all tasks."""

    def judge(original, preview):
        if (original == "raise").any():
            raise RuntimeError("no")
        answers = {"nan": float("nan"), "text": "x", "big": 1.5, "none": None, "loss": 0.7, "keep": 0.69, "true": True}
        return pd.Series([answers.get(o, 0.1) for o in original], dtype=object)

    names = ["raise", "nan", "text", "big", "none", "loss", "keep", "true", "other"]
    rows = [(k, n, "p", False, False) for k, n in enumerate(names)] + [(50 + k, n, "p", False, False) for k, n in enumerate(names)] + [(90, "loss", "p", True, False), (91, "loss", "p", None, True), (92, None, None, False, False), (99, "last", "p", False, False)]
    df = spark.createDataFrame(rows, "k int, original string, preview string, is_current boolean, is_error boolean").repartition(4)
    got = {r.k: (r.status, r.reason, r.verdict) for r in H.judge_within_budget(df, judge, ["k"], budget=9).collect()}
    bad = ("fallback", "invalid-response", None)
    want = {"raise": ("fallback", "judge-error", None), "nan": bad, "text": bad, "big": bad, "none": bad, "loss": ("judged", None, "loss"), "keep": ("judged", None, "preserved"), "true": bad, "other": ("judged", None, "preserved")}
    for k, n in enumerate(names):
        assert got[k] == got[50 + k] == want[n], n
    assert got[90] == ("skipped", "current-result", None) and got[91] == ("skipped", "error-result", None) and got[92] == got[99] == ("fallback", "budget", None)
    assert H.judge_within_budget(df.limit(0), judge, ["k"]).count() == 0


# --- AGG22, AGG11


def test_gateway_cases(spark):
    good = {c: float(b) for c, _, b in M.GATE_CHECKS}
    cases = {"go": {"a": good, "b": good}, "no-go": {"a": good, "b": good | {"wrong-mutative-calls": 1.0, "weighted-cost": 1.01}}, "one host": {"a": good}, "other host": {"a": good, "c": good}, "missing": {"a": good, "b": good | {"startup-overhead": None, "schema-validation": 0.5}}, "few": {"a": good, "b": {c: v for c, v in good.items() if c != "auth-propagation"}}, "more": {"a": good | {"unknown": 1.0}, "b": good, "c": good}}
    rows = [(r, h, c, v) for r, hosts in cases.items() for h, checks in hosts.items() for c, v in checks.items()]
    got = {r.report: (r.decision, r.failed, r.missing, r.reasons) for r in M.gateway_report(spark.createDataFrame(rows, "report string, host string, check string, value double"), ("b", "a")).collect()}
    assert got == {
        "go": ("go", 0, 0, []), "no-go": ("no-go", 2, 0, ["weighted-cost", "wrong-mutative-calls"]), "one host": ("insufficient-evidence", 0, 1, ["all-hosts"]), "other host": ("insufficient-evidence", 0, 1, ["all-hosts"]),
        "missing": ("insufficient-evidence", 1, 1, ["schema-validation", "startup-overhead"]), "few": ("insufficient-evidence", 0, 1, ["auth-propagation"]), "more": ("insufficient-evidence", 0, 1, ["all-hosts"]),
    }


@pytest.mark.parametrize("change,want", [({}, "passed"), ({("x", 1, "apply"): (95, True)}, "passed"), ({("x", 1, "apply"): (150, True), ("x", 2, "apply"): (100, True)}, "failed"), ({("y", 2, "apply"): (10, False)}, "failed"), ({("y", 2, "control"): (None, True)}, "inconclusive"), ({("y", 2, "control"): (0, True)}, "inconclusive"), ({("y", 1, "apply"): None}, "inconclusive")])
def test_screening_cases(spark, change, want):
    sessions = {(s, r, a): (100 if a == "control" else 60, True) for s in "xy" for r in (1, 2) for a in ("control", "apply")} | change
    rows = [(*k, *v) for k, v in sessions.items() if v]
    got = {r.scenario: r for r in M.screening_report(spark.createDataFrame(rows, "scenario string, repetition int, arm string, cost long, passed boolean"), 2).collect()}
    assert got[None].status == want
    if not change:
        assert got["x"].pairs == 2 and got["x"].reduction_mille == 400 and got["x"].variance == 0 and got[None].reduction_mille == 400
    if ("y", 2, "apply") in change:
        assert got["y"].status == "worse" and got["x"].status == "ok"


# --- SRC4


def test_profile_digests(spark, tmp_path):
    rates = {"fresh": 1.5, "read": 0.1, "write": 2, "output": 8}
    profile = {"profile_id": "p1", "provider": "x", "model": "m", "service": "standard", "regional": False, "threshold": 10, "short": rates, "long": rates}
    (tmp_path / "p1.json").write_text(json.dumps(profile, indent=2))
    want = spark.createDataFrame([(json.dumps(dict(reversed(profile.items()))),)], "v string").select(F.lit("p1").alias("profile_id"), digest(canonical_json(F.col("v"))).alias("digest"))
    assert R.load_pricing(spark, str(tmp_path), want).first().short_fresh == 1500
    (tmp_path / "p1.json").write_text(json.dumps(profile | {"long": rates | {"fresh": 1.6}}))
    with pytest.raises(Exception, match="differs from its version: p1"):
        R.load_pricing(spark, str(tmp_path), want).collect()
    with pytest.raises(Exception, match="differs from its version"):
        R.load_pricing(spark, str(tmp_path), want.withColumn("profile_id", F.lit("p2"))).collect()
    (tmp_path / "p1.json").write_text("no profile")
    with pytest.raises(Exception, match="not a profile"):
        R.checked_profiles(spark, str(tmp_path), want).collect()


# --- AGG16, PRJ15, JSN3, SET2


def test_close_days_cases(spark):
    """Modes and stages are kept apart, failures are markers, open days stay out, unknown events raise."""
    from tracemill.operators.telemetry import close_days

    d = lambda day, event, mode, stage, n=1: [(f"2024-01-{day:02}", "1", event, "h", mode, stage, True, 3000)] * n
    rows = d(1, "hook_summary", "a", "ignored", 3) + d(1, "hook_summary", None, None) + d(1, "hook_failure_summary", "ignored", "parse", 4) + d(1, "hook_failure_summary", None, "write") + d(9, "hook_summary", "a", None)
    df = spark.createDataFrame(rows, "day string, version string, event string, dimension string, mode string, failure_stage string, transformed boolean, bytes long").withColumn("day_utc", F.to_date("day"))
    got = {(r.event, r["mode"], r.failure_stage): (r.calls, r.transformed, r.bytes) for r in close_days(df, "2024-01-09").collect()}
    none = (None, None, None)
    assert got == {("hook_summary", "a", None): ("2_to_5", "2_to_5", "4_to_16k"), ("hook_summary", None, None): ("one", "one", "lt_4k"), ("hook_failure_summary", None, "parse"): none, ("hook_failure_summary", None, "write"): none}
    with pytest.raises(Exception, match="unknown event: other"):
        close_days(df.withColumn("event", F.lit("other")), "2024-01-09").collect()


def test_grep_summary_cases(spark):
    from tracemill.operators.bounding import grep_summary

    rows = [("the\nThe\r\nx the",), ("\x00the",), ("none",), (None,), ("the\n" * 25,)]
    df = spark.createDataFrame(rows, "output string")
    assert tuple(grep_summary(df, "the").first()) == (5, 1, 2, 27, 5) and tuple(grep_summary(df, "THE", ignore_case=True).first()) == (5, 1, 2, 28, 5)
    assert tuple(grep_summary(df.limit(0), "the").first()) == (0, 0, 0, 0, 0)


def test_rows_without_identity_are_read_once(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 1, 7), (None, 1, 7)], "k string, seq int, v int")
    out = U.dedupe_revisions(df, "k", ["v"], "seq")
    assert sorted((r.k or "", r.v, r.duplicates, r.conflict) for r in out.collect()) == [("", 7, 0, False), ("", 7, 0, False), ("a", 5, 1, True)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_segments_need_no_shuffle(spark):
    from tracemill.operators.cache import classify_context

    body = {"system": "s", "tools": [{"name": "own_x"}, {"name": "mcp__y"}, {"function": {"name": "z"}}, {"name": "d", "defer_loading": True}], "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": [{"type": "tool_result"}]}], "model": "m"}
    df = spark.createDataFrame([("1", json.dumps(body)), ("2", "broken"), ("3", "{}"), ("4", None)], "request_id string, body string")
    out = classify_context(df)
    want = ["host-instructions", "own-tools", "mcp-tools", "builtin-tools", "deferred-tools", "user-prompt", "history", "history", "provider-overhead"]
    assert [(r.request_id, r.seq, r.category) for r in out.orderBy("request_id", "seq").collect()] == [("1", k, c) for k, c in enumerate(want)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
