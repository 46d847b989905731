"""Conversation repair against a plain search over all rows, and against all edits of short conversations."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tracemill.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
ZERO = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"u": "user", "a": "assistant"}


def faults(rows):
    """Fault of each (turn, role, text)."""
    out, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and what is left, by a search that always takes the cheapest and then least beginning."""
    bad = faults(rows)
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, k, q, left = heapq.heappop(queue)
        if k == len(rows) and q in (0, 3):
            return cost, audit, list(left)
        if (k, q) in done:
            continue
        done.add((k, q))
        for c in "ua":
            if c in STEP[q]:
                heapq.heappush(queue, (cost + 5, audit + "I", k, STEP[q][c], (*left, (FULL[c], ""))))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(queue, (cost + 2, audit + "D", k + 1, q, left))
            if bad[k] not in ("blank", "duplicate"):
                more = 5 * (bad[k] == "truncated")
                if role[:1] in STEP[q]:
                    heapq.heappush(queue, (cost + more, audit + "K", k + 1, STEP[q][role[:1]], (*left, (role, text))))
                for c in "ua":
                    if c in STEP[q]:
                        heapq.heappush(queue, (cost + more + 1, audit + "R", k + 1, STEP[q][c], (*left, (FULL[c], text))))


def every(rows, inserts=4):
    """Cost and audit by trying all texts of edits with up to so many inserts, without any state of the grammar but at the end."""
    bad, best = faults(rows), None
    for n in range(inserts + 1):
        for audit in {x for e in itertools.product("DKR", repeat=len(rows)) for x in with_inserts("".join(e), n)}:
            options, k, cost, good = [""], 0, 0, True
            for c in audit:
                if c == "I":
                    options, cost = [o + x for o in options for x in "ua"], cost + 5
                    continue
                fault, role = bad[k], rows[k][1]
                k += 1
                if c == "D":
                    cost += 2
                    continue
                good = good and fault not in ("blank", "duplicate")
                cost += 5 * (fault == "truncated") + (c == "R")
                options = [o + x for o in options for x in ("ua" if c == "R" else role[:1] or "-")]
            if good and (best is None or (cost, audit) < best) and any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                best = cost, audit
    return best


def with_inserts(edits, n):
    for at in itertools.combinations_with_replacement(range(len(edits) + 1), n):
        out = list(edits)
        for k in reversed(at):
            out.insert(k, "I")
        yield "".join(out)


def report(rows):
    """By brute force, of rows (turn, role, text) in order."""
    if not rows:
        return ZERO
    bad = faults(rows)
    cost, audit, left = cheapest(rows)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(a[1][:1] + b[1][:1]) for a, b in itertools.pairwise(rows)]
    text = "\n".join(f"{r}:{t}" for r, t in left)
    counts = {f: bad.count(f) for f in ("blank", "duplicate", "truncated")}
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def damaged(rows):
    """conv_id: rows in order, by the lot of each row."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out[conv] += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return out


def random_rows(seed, n, most):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "u", "sys", "Assistant"])
                text = rng.choice(["Yes.", "No", "Well!", "so what? ", "", " \n", "Hm.\t", f"Text {turn}.", f"Open {turn}"] + [f"Turn {turn}!"] * 9)
                out.append((conv, turn, role, text))
    return out


def as_rows(df):
    names = list(ZERO)
    return {r.conv_id: {n: r[n] for n in names} for r in df.collect()}


def test_search_is_right():
    """The search itself against all edits of all short conversations of a few kinds of rows."""
    rng = random.Random(1)
    kinds = [("system", "S."), ("user", "U."), ("assistant", "A."), ("user", "open"), ("assistant", "open"), ("tool", "T."), ("user", ""), ("user", "U.")]
    for _ in range(150):
        rows = [(k, *rng.choice(kinds)) for k in range(rng.randint(1, 4))]
        assert cheapest(rows)[:2] == every(rows), rows


def test_block_tables_are_small():
    t = repair.block_tables()
    assert len(t.vectors) < 200 and t.next.shape == (len(t.vectors), repair.SYMBOLS**repair.SIZE)


@pytest.mark.parametrize("page, fan", [(1024, 512), (4, 3), (7, 2)])
def test_repair_brute_force(spark, monkeypatch, page, fan):
    """Also with pages so small that conversations have many, and groups so small that they are combined in several rounds."""
    monkeypatch.setattr(repair, "FAN", fan)
    rows = random_rows(page, 60, 60) + [(1000, k, *random.Random(k).choice([("user", f"u{k}."), ("assistant", f"a{k}."), ("assistant", "same.")])) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pages = repair.repair_conversations(df, page_rows=page)
    got = {int(r.conv_id): r for r in repair.repair_report(pages).collect()}
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    assert set(got) == set(by)
    for c, some in by.items():
        want = report(some)
        assert {n: got[c][n] for n in want if n != "gaps"} == {n: v for n, v in want.items() if n != "gaps"}, some


def test_rows_of_pages(spark):
    """The repaired rows themselves, with turns, faults and inserted rows."""
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "U."), (1, 2, "user", "U."), (1, 3, "user", "V."), (1, 4, "tool", "cut")]
    page = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    _, audit, left = cheapest([r[1:] for r in rows])
    assert page.audit == audit and [(r.role, r.text) for r in page.rows if r.edit != "D"] == left
    assert [r.turn for r in page.rows if r.edit != "I"] == [0, 1, 2, 3, 4]
    assert [r.fault for r in page.rows if r.edit != "I"] == [None, None, "duplicate", None, "truncated"]
    alone = repair.repair_conversations(spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "Why?"), (2, 0, "user", "U.")], SCHEMA)).collect()
    assert {(p.conv_id, p.audit) for p in alone} == {(1, cheapest([(0, "system", "S."), (1, "user", "Why?")])[1]), (2, "D")}


def test_odd_rows(spark):
    """Nulls in any column, equal rows, very long texts, clashing names, no rows at all; through the damage of the query."""
    rows = [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, None, None, None), (1, None, None, "x."), (2, 5, "user", None), (2, 5, "user", None), (3, 0, "system", "é日𝒳. " * 20_000), (3, 1, "user", "q?"), (3, 1, "user", "q?"), (3, 9, "assistant", "ok. "), (4, 0, "", ""), (5, 2**40, "user", "U."), (5, 2**41, "assistant", "A.")]
    rows += [(k, t, "user" if t % 2 else "assistant", f"{t}.") for k in range(10, 40) for t in range(3)]
    rows += [(k, 0, "user", "alone.") for k in range(100, 160)]
    want = {c: report(r) for c, r in damaged(rows).items()}
    assert ZERO in want.values()

    def run(df):
        return as_rows(_query(spark, df))

    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df) == want
    other = df
    for c in ("conv", "h", "k", "page", "pages", "rows", "pos", "same", "mark", "_salt", "_part", "audit", "first", "of"):
        other = other.withColumn(c, F.lit("x"))
    assert run(other) == want
    assert run(df.limit(0)) == {}


def _query(spark, df):
    real = queries._table
    try:
        queries._table = lambda *_: df
        return queries.op12_conversations(spark, "")
    finally:
        queries._table = real


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert as_rows(queries.op12_conversations(spark, SF)) == {c: report(r) for c, r in damaged(rows).items()}
