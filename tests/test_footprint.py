"""Footprints of requests whose estimated body is below zero, zero or missing, against their SQL."""

import duckdb
import pytest
from conftest import same_rows

from tracemill.plans.registry import SQL, history


@pytest.fixture(scope="module")
def short(spark):
    """Short conversations, bodies of -99 to 200 bytes; texts and roles without a value; a conversation without an id."""
    rows = [(c, t, role, "x" * n) for c in range(1, 60) for t, (role, n) in enumerate((("user", c % 9), ("system", c * 2)))]
    rows += [(None, 0, "user", "abc"), (None, 1, "system", "de"), (104, 0, "user", "y" * 100), (74, 0, "user", None), (75, 0, None, "abc"), (76, 0, "assistant", None), (76, 1, "user", "")]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), con


def test_footprint_of_bodies_below_zero(short):
    same_rows(history.footprint(short[0]), short[1], SQL["agg14_footprint_by_category"])


def test_telemetry_of_bodies_below_zero(short):
    same_rows(history.foot_telemetry(short[0]), short[1], SQL["agg26_footprint_telemetry"])
