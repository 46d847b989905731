"""Known answers for ledgers, prices, metrics and arms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions.numbers import period_key, strict_sum, unknown_bucket
from tracemill.operators import metrics as M
from tracemill.operators import usage as U
from tracemill.sources import readers as R

LEDGER = "session_id string, at timestamp_ntz, prompt long, output long, cached long, cache_write long"
AT = dt.datetime(2026, 1, 5, 12)


def test_ledger_by_period(spark):
    df = spark.createDataFrame([("s1", AT, 100, 10, 80, 0), ("s1", AT, 50, 5, 0, 50)], LEDGER)
    rows = {(r.period, r.key): r for r in U.ledger_by_period(df).collect()}
    s = rows["session", "s1"]
    assert (s.entries, s.prompt, s.output, s.cached, s.cache_write, s.effective_input, s.total) == (2, 150, 15, 80, 50, 70, 165)
    assert {("day", "2026-01-05"), ("week", "2026-W02"), ("month", "2026-01")} < set(rows)


def test_ledger_rejects(spark):
    bad = [("s", AT, -1, 0, 0, 0), ("s", AT, 10, 0, 11, 0), ("s", AT, 10, 0, 6, 5), ("s", AT, 9007199254740991, 1, 0, 0)]
    assert U.ledger_entries(spark.createDataFrame(bad, LEDGER)).count() == 0


@pytest.mark.parametrize("day,week,month", [("2025-12-31", "2026-W01", "2025-12"), ("2026-01-04", "2026-W01", "2026-01"), ("2026-01-05", "2026-W02", "2026-01")])
def test_iso_weeks(spark, day, week, month):
    r = spark.sql(f"SELECT timestamp_ntz'{day} 10:00:00' AS at").select(*[period_key(F.col("at"), p).alias(p) for p in ("week", "month")]).first()
    assert (r.week, r.month) == (week, month)


def test_named_zone(spark):
    d = spark.sql("SELECT timestamp_ntz'2026-01-01 00:30:00' AS at").select(period_key(F.col("at"), "day", "America/Los_Angeles").alias("d"), period_key(F.col("at"), "week", "America/Los_Angeles").alias("w")).first()
    assert (d.d, d.w) == ("2025-12-31", "2026-W01")


def test_weighted_usage(spark):
    df = spark.createDataFrame([(100, 40, 20, 10, 0), (10, 0, 0, 4, 2), (10, 8, 3, 0, 0)], "prompt long, cached long, cache_write long, output long, reasoning long")
    assert sorted(r.cost_units for r in U.weighted_usage(df).collect()) == [14000, 79000]
    with pytest.raises(ValueError):
        U.weighted_usage(df, {"other": 1})


PRICES = "profile_id string, provider string, model string, service string, regional boolean, threshold long, short_fresh long, short_read long, short_write long, short_output long, long_fresh long, long_read long, long_write long, long_output long"
REQUEST = "request_key string, provider string, model string, service string, regional boolean, input long, cached long, cache_write long, output long, reasoning long, quality string, seq long"


def requests(spark, *rows):
    return spark.createDataFrame([(k, "p", "m", "standard", False, *r, "complete", n) for n, (k, *r) in enumerate(rows)], REQUEST)


def prices(spark):
    return spark.createDataFrame([("x", "p", "m", "standard", False, 272000, 100, 10, 125, 500, 200, 20, 250, 750)], PRICES)


def test_price_tiers_are_exact(spark):
    df = requests(spark, ("a", 272000, 90000, 0, 1000, 250), ("b", 272001, 90000, 0, 1000, 250), ("c", 100000, 80000, 10000, 2000, 1500))
    got = {r.request_key: (int(r.nano_usd), r.tier) for r in U.price_requests(df, prices(spark)).collect()}
    assert got == {"a": (19_600_000, "short"), "b": (38_950_200, "long"), "c": (10000 * 100 + 80000 * 10 + 10000 * 125 + 2000 * 500, "short")}


def test_cost_report_conflicts(spark):
    one, two = (100, 80, 10, 20, 5), (100, 80, 10, 21, 5)
    ok = U.api_cost_report(requests(spark, ("a", *one), ("a", *one), ("b", *one)), prices(spark), ["model"]).first()
    assert (ok.priced, ok.duplicates, ok.status) == (2, 1, "complete")
    bad = U.api_cost_report(requests(spark, ("a", *one), ("a", *two), ("b", *one)), prices(spark), ["model"]).first()
    assert (bad.priced, bad.unpriced, bad.estimated_nano, bad.status) == (1, 1, None, "partial")
    none = U.dedupe_revisions(requests(spark, (None, *one), (None, *two)), "request_key", ["output"], "seq")
    assert none.count() == 2


def test_strict_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, x long")
    assert {r.k: r.s for r in df.groupBy("k").agg(strict_sum(F.col("x")).alias("s")).collect()} == {"a": None, "b": 2}
    with pytest.raises(Exception, match="overflow"):
        spark.createDataFrame([(9007199254740991,), (1,)], "x long").agg(strict_sum(F.col("x"))).collect()


def test_responses_usage(spark):
    nested = {"input_tokens": 100000, "output_tokens": 2000, "input_tokens_details": {"cached_tokens": 80000, "cache_write_tokens": 10000}, "output_tokens_details": {"reasoning_tokens": 1500}}
    rows = [nested, {"input_tokens": 5, "output_tokens": 1}, {"input_tokens": 5, "output_tokens": 1, "cached_input_tokens": 2, "cache_read_input_tokens": 3}, {"output_tokens": 1}, {"input_tokens": 1, "output_tokens": 1, "total_tokens": 3}, {"input_tokens": 1, "output_tokens": 1, "cached_input_tokens": 2}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "usage string")
    got = [(r.status, r.input, r.total) for r in U.normalize_responses_usage(df).collect()]
    assert got == [("complete", 100000, 102000), ("incomplete", 5, 6), ("invalid", None, None), ("invalid", None, None), ("invalid", None, None), ("invalid", None, None)]


def test_anthropic_usage(spark):
    df = spark.createDataFrame([(json.dumps({"input_tokens": 100, "cache_creation_input_tokens": 20, "cache_read_input_tokens": 30, "output_tokens": 7}),)], "usage string")
    r = U.normalize_anthropic_usage(df).first()
    assert (r.input, r.cached, r.cache_write, r.output, r.total) == (150, 30, 20, 7, 157)


def test_metrics(spark):
    rows = [("a", 0, dt.datetime(2026, 1, 31, 23, 59, 59), "h", "s1", "c", "m", 100, 70, None)] * 2 + [("b", 1, dt.datetime(2026, 2, 1), "h", "s1", "c", "m", 100, 80, None), ("c", 2, dt.datetime(2026, 2, 2), "h", "s2", "c", "m", 100, 70, None)]
    df = spark.createDataFrame(rows, "event_key string, seq long, at timestamp_ntz, host string, session_id string, client string, model string, input_tokens long, inline_tokens long, provider_savings long")
    once = M.merge_ledgers(df)
    t = M.metrics_cumulative(once).first()
    assert (t.events, t.sessions, t.savings, t.provider_savings) == (3, 2, 80, None)
    assert M.average_by_session(once).first().average_savings == 40
    last = M.latest_session(once).first()
    assert (last.session_id, last.savings) == ("s2", 30)
    periods = [r.period for r in M.metrics_by_period(once).collect()]
    assert [periods.count(p) for p in ("day", "week", "month")] == [3, 2, 2]


def test_normalize_event(spark):
    df = spark.createDataFrame([('{"hook_event_name":"x","toolName":"Read","tool_response":"t","sessionId":"s"}',), ('{"toolName":"Read"}',), ("no json",)], "body string")
    r = M.normalize_event(df).collect()
    assert [(x.event_name, x.tool_name, x.output, x.session_id) for x in r] == [("x", "Read", "t", "s")]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)], "k string, x long")
    assert M.upper_median(df, "k", "x").first()["median"] == 3


def test_unknown_bucket(spark):
    df = spark.createDataFrame([(7, 100), (0, 5), (None, 5), (1, 100)], "a long, b long")
    assert [r[0] for r in df.select(unknown_bucket(F.col("a"), F.col("b"))).collect()] == ["1_to_10pct", "zero", "unavailable", "lt_1pct"]


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    lines = ['{"type":"assistant","message":{"id":"m1","usage":{"input_tokens":1}}}', "", "broken {", "[1]", '{"type":"assistant","message":{"id":"m1","usage":{"input_tokens":2}}}', '{"type":"result","usage":{"input_tokens":9},"total_cost_usd":0.5}']
    (tmp_path / "t" / "s.jsonl").write_text("\n".join(lines))
    got = R.transcript_usage(R.read_transcripts(spark, str(tmp_path / "t")))
    assert got.count() == 3
    assert sorted(json.loads(r.usage)["input_tokens"] for r in R.dedupe_messages(got).collect()) == [2, 9]
    (tmp_path / "l.jsonl").write_text('{"schema":"x/v1","a":1}\n{"schema":"y","a":2}\n')
    assert [r.a for r in R.read_ledger(spark, str(tmp_path / "l.jsonl"), "schema string, a long", "x/v1").collect()] == [1]
    (tmp_path / "s.json").write_text('{"records":[{"schema":"x/v1","a":1},{"schema":"x/v1","a":3}]}')
    assert R.read_ledger(spark, str(tmp_path / "s.json"), "schema string, a long", "x/v1", snapshot=True).count() == 2
    p = {"profile_id": "x", "provider": "p", "model": "m", "service": "s", "regional": False, "threshold": 10, "short": {"fresh": 2.5, "read": 0.25, "write": 3.125, "output": 10}, "long": {"fresh": 5, "read": 0.5, "write": 6, "output": 15}}
    (tmp_path / "p.json").write_text(json.dumps(p))
    assert R.load_pricing(spark, str(tmp_path / "p.json")).first().short_write == 3125
    (tmp_path / "p.json").write_text(json.dumps(p | {"short": p["short"] | {"read": 0.0001}}))
    with pytest.raises(Exception, match="bad rate"):
        R.load_pricing(spark, str(tmp_path / "p.json")).collect()
    (tmp_path / "c" / "vendor").mkdir(parents=True)
    (tmp_path / "c" / "a.txt").write_text("x" * 2000)
    (tmp_path / "c" / "b.bin").write_bytes(b"x\0" * 2000)
    (tmp_path / "c" / "vendor" / "c.txt").write_text("x" * 2000)
    assert [r.bytes for r in R.read_text_files(spark, str(tmp_path / "c")).collect()] == [2000]
    day = spark.sql("SELECT date'2026-01-01' AS day_utc, 1 AS n")
    for n in (1, 2):
        R.write_rollups(day.withColumn("n", F.lit(n)), str(tmp_path / "r"))
    assert [r.n for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [2]
    keys, prefixes, digest = R.load_redaction_rules('{"rules":[{"type":"token-prefix","prefix":"acme_","minLength":4,"maxLength":8},{"type":"assignment-key","key":"session_code"}]}')
    assert keys == ("session_code",) and prefixes == (("acme_", 4, 8),) and digest.startswith("sha256:")
