"""The Merkle manifest against trees built plainly, level by level."""

import hashlib
import random

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F
from test_llm import DOC, ODD, clashing, documents

from tracemill.llm import merkle, queries


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """Root, and of each leaf the (before, after) of each level."""
    paths, level = [[] for _ in leaves], list(leaves)
    at = list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(paths):
            low = at[k] - at[k] % fanout
            p.append(("".join(level[low : at[k]]), "".join(level[at[k] + 1 : low + fanout])))
            at[k] //= fanout
        level = [H("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
    return level[0], paths


def manifest(rows, fanout):
    """(doc_id, lang, pos): leaf, subroot, root, path, by brute force."""
    groups = {}
    for doc, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((doc is not None, doc or 0, leaf((doc, source, lang, n, text)), doc))
    out, subroots, order = {}, [], sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        subroots.append(tree([x[2] for x in groups[g]], fanout))
    root, tops = tree([s[0] for s in subroots], fanout)
    for g, (sub, paths), top in zip(order, subroots, tops, strict=True):
        for pos, (x, p) in enumerate(zip(groups[g], paths, strict=True)):
            out[x[3], g, pos] = (x[2], sub, root, p + top)
    return out


def got(df):
    return {(r.doc_id, r.lang, r.pos): (r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in df.collect()}


@pytest.mark.parametrize("fanout, levels, n", [(8, 4, 60), (2, 1, 75), (3, 1, 100), (2, 2, 33), (8, 1, 600)])
def test_manifest_brute_force(spark, fanout, levels, n):
    """Blocks much smaller than groups, so that many rounds of swaps are needed; one group holds half of the rows."""
    rng = random.Random(fanout * 100 + n)
    rows = [(k, f"Text {k} É", rng.choice(["en"] * 6 + [None, "", "de", "fr", "日", "é", "zz"]), "s", k) for k in range(n)]
    rng.shuffle(rows)
    df = merkle.merkle_manifest(documents(spark, rows), fanout=fanout, levels=levels)
    assert got(df) == manifest(rows, fanout)


def test_manifest_odd_rows(spark):
    """Nulls in any column, repeated and equal rows, very long texts, columns with clashing names, no rows, one row."""
    df = documents(spark, ODD)
    want = manifest(ODD, 8)
    assert got(merkle.merkle_manifest(df)) == want
    other = clashing(df)
    for c in ("grp", "block", "leaf", "path", "root", "pos", "_salt", "_part"):
        other = other.withColumn(c, F.lit("x"))
    assert got(merkle.merkle_manifest(other)) == want
    assert merkle.merkle_manifest(spark.createDataFrame([], DOC)).count() == 0
    one = merkle.merkle_manifest(documents(spark, ODD[:1])).first()
    assert one.leaf == one.subroot == one.root and one.path == []


def test_equal_rows_are_cut_between_ranges(spark):
    """A third and more of all rows alike: every one has its own place."""
    rows = [(7, "same", "en", "s", 1)] * 200 + [(k, "x", "en", "s", k) for k in range(100)]
    assert got(merkle.merkle_manifest(documents(spark, rows), fanout=4, levels=1)) == manifest(rows, 4)


def test_fold_and_tampering(spark):
    rows = [(k, f"Text {k}", "en" if k % 3 else None, "s", k) for k in range(50)]
    m = merkle.merkle_manifest(documents(spark, rows), fanout=3, levels=1)
    m = m.select("doc_id", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("good"), merkle.fold(F.sha2(F.lit("other"), 256), F.col("path")).alias("bad"))
    assert all(r.good == r.root != r.bad for r in m.collect())


def test_query(spark, duck):
    same_rows(queries.op13_merkle(spark, SF), duck, queries.SQL["op13_merkle"])
    rows = queries.op13_merkle(spark, SF).collect()
    assert {r.verified for r in rows} == {True, False} and len({r.root for r in rows}) == 1
