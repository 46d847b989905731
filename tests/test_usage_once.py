"""Usage objects are parsed once for each row, and what is read from them does not depend on which columns are asked for."""

import json

from tracemill.operators import usage as U

BODIES = [{"input_tokens": 5, "output_tokens": "1"}, {"input_tokens": 5, "output_tokens": 1, "cached_input_tokens": 6}, {"input_tokens": -1, "output_tokens": {"a": 1}}, {"input_tokens": 9, "output_tokens": 2, "input_tokens_details": {"cached_tokens": 3, "cache_write_tokens": 0}, "cache_read_input_tokens": 4, "output_tokens_details": {"reasoning_tokens": 7}, "total_tokens": 11}]
WANT = [
    ("incomplete", 5, 0, 6, ["cached", "cache_write", "reasoning"], []),
    ("invalid", None, None, None, ["cache_write", "reasoning"], ["cache-exceeds-input"]),
    ("invalid", None, None, None, ["cached", "cache_write", "reasoning"], ["invalid-counter:input", "invalid-counter:output"]),
    ("invalid", None, None, None, [], ["conflicting-aliases:cached", "reasoning-exceeds-output"]),
    ("invalid", None, None, None, ["input", "output", "cached", "cache_write", "reasoning"], ["invalid-usage", "missing-required-counter:input", "missing-required-counter:output"]),
]


def test_usage_is_parsed_once(spark):
    df = spark.createDataFrame([(json.dumps(b),) for b in BODIES] + [("{",)], "usage string").coalesce(1)
    out = U.normalize_responses_usage(df)
    assert out.columns == ["usage", "errors", "missing", "input", "output", "cached", "cache_write", "reasoning", "total", "status"]
    assert [tuple(r) for r in out.select("status", "input", "cached", "total", "missing", "errors").collect()] == WANT
    assert [r.status for r in out.select("status").collect()] == [w[0] for w in WANT]
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("json(") == 1
