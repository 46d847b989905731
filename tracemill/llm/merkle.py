"""A Merkle manifest of a table: one tree for each group, one over the groups' roots, and the proof of every row.

Leaves are dealt out in aligned blocks. Block roots then meet in rounds, as in a butterfly: in round k a block swaps its ancestor with those
blocks whose number differs in digit k (base fanout) alone, and hashes the next ancestor itself. When the last round ends, each block has
the upper part of its proofs, so nothing is sent down the tree again.
"""

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._order import place
from ._shared import Tables

PATH = "array<struct<before:string,after:string>>"
#: Rows in a range while places are found.
PART_ROWS = 1_000_000


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values in order: each its number of UTF-8 bytes, a colon and itself, or - where null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path in one text, lowest level first, from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _up(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[k : k + fanout]).encode()).hexdigest() for k in range(0, len(nodes), fanout)]


def _sorted_leaves(rows: pa.Table) -> tuple[pa.Table, list[str]]:
    rows = rows.sort_by("pos")
    return rows, rows.column("leaf").to_pylist()


def _topping(fanout: int, levels: int):
    def top(key, rows):
        """The root of a block `levels` above its leaves, and its root if its group has no other block."""
        _, nodes = _sorted_leaves(rows)
        alone, level = None, 0
        while level < levels or alone is None:
            if alone is None and len(nodes) == 1:
                alone = nodes[0]
            if level < levels:
                nodes, level = _up(nodes, fanout), level + 1
        return pa.table({"grp": [key[0].as_py()], "block": [key[1].as_py()], "alone": [alone], "top": nodes})

    return top


def _proving(fanout: int, levels: int):
    def prove(key, rows, upper):
        """Each leaf of a block with its path: inside the block, then the block's own."""
        rows, nodes = _sorted_leaves(rows)
        head = upper.to_pylist()[0]
        steps = []  # before and after of each node, by level
        while len(steps) < levels if head["m"] > 1 else len(nodes) > 1:
            run = [nodes[k - k % fanout : k - k % fanout + fanout] for k in range(len(nodes))]
            steps.append([("".join(r[: k % fanout]), "".join(r[k % fanout + 1 :])) for k, r in enumerate(run)])
            nodes = _up(nodes, fanout)
        above = [(s["before"], s["after"]) for s in head["path"]]
        n, size = rows.num_rows, len(steps) + len(above)
        flat = [x for k in range(n) for x in (*(step[k // fanout**j] for j, step in enumerate(steps)), *above)]
        struct = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], names=["before", "after"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), struct)
        out = rows.select(["grp", "id", "pos", "leaf", "kept"])
        out = out.append_column("subroot", pa.array([head["hash"]] * n, pa.string())).append_column("root", pa.array([head["root"]] * n, pa.string()))
        return out.append_column("path", path)

    return prove


def _swap(state: DataFrame, fanout: int, width: int) -> DataFrame:
    """One round: blocks whose ancestors, each of `width` blocks, have one parent learn these and hash it.

    A block meets those at its own place under the other ancestors. The last ancestor may have fewer blocks: these stand
    in for the missing ones, so that everyone meets each ancestor once. Groups that have their root are left as they are.
    """
    node = F.expr(f"block div {width}")
    state = state.select("*", node.alias("node"), (F.col("block") % width).alias("low"), F.least(F.lit(width), F.col("m") - node * width).alias("blocks"))
    digit, run = F.col("node") % fanout, F.expr(f"node div {fanout}")
    single = (F.col("blocks") == width) | (digit == 0)
    places = F.when(single, F.array("low")).otherwise(F.sequence(F.col("low"), F.when(single, F.col("low")).otherwise(F.lit(width - 1)).cast("long"), F.col("blocks")))
    sent = state.select("grp", run.alias("run"), digit.alias("digit"), "hash", "low", "block", "m", "path", F.explode(places).alias("place"))
    own = F.when(F.col("place") == F.col("low"), F.struct("digit", "hash", "block", "m", "path"))
    met = sent.groupBy("grp", "run", "place").agg(F.array_sort(F.collect_list(F.struct("digit", "hash"))).alias("all"), F.collect_list(own).alias("own"))
    met = met.select("grp", "all", F.explode("own").alias("x")).select("grp", "all", "x.*")
    side = lambda test: F.array_join(F.transform(F.filter("all", test), lambda s: s["hash"]), "")
    met = met.select("*", side(lambda s: s["digit"] < F.col("digit")).alias("before"), side(lambda s: s["digit"] > F.col("digit")).alias("after"))
    done = F.col("m") <= width
    parent = F.when(done, F.col("hash")).otherwise(F.sha2(F.concat("before", "hash", "after"), 256))
    path = F.when(done, F.col("path")).otherwise(F.concat("path", F.array(F.struct("before", "after"))))
    return met.select("grp", "block", "m", parent.alias("hash"), path.alias("path"))


def _trees(leaves: DataFrame, tables: Tables, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (grp, id, leaf, kept) -> these with block and pos; and grp, block, m (blocks of the group), hash (its root), path of the block."""
    size = fanout**levels
    parts = max(1, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), leaves.count() // PART_ROWS)
    placed = place(leaves, "grp", ["id", "leaf"], tables, parts).withColumn("block", F.expr(f"pos div {size}"))
    tops = placed.select("grp", "block", "pos", "leaf").groupBy("grp", "block").applyInArrow(_topping(fanout, levels), "grp string, block long, alone string, top string")
    tops = tables.put(tops)
    state = tops.join(tops.groupBy("grp").agg((F.max("block") + 1).alias("m")), "grp")
    state = state.select("grp", "block", "m", F.when(F.col("m") == 1, F.col("alone")).otherwise(F.col("top")).alias("hash"), F.array().cast(PATH).alias("path"))
    most, width = tops.agg(F.max("block") + 1).first()[0] or 1, 1
    while width < most:
        state, width = _swap(state, fanout, width), width * fanout
    upper = tables.put(state)
    tables.drop(tops)
    return placed, upper


def _paths(placed: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = f"grp string, id {kind['id']}, pos long, leaf string, kept {kind['kept']}, subroot string, root string, path {PATH}"
    return placed.groupBy("grp", "block").cogroup(upper.groupBy("grp", "block")).applyInArrow(_proving(fanout, levels), schema)


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", keep: Mapping[str, Column] | None = None, fanout: int = 8, levels: int = 4) -> DataFrame:
    """One row for each row of docs: order and group columns, pos, leaf, subroot, root, path, and the columns of keep.

    leaf: leaf_digest() of columns. In each group leaves ascend by the order column; while several nodes are left, each fanout
    consecutive ones (the last run may be shorter, even a single one) become the digest of their hex texts. What is left is the subroot.
    Subroots, ordered by group (null first, then by UTF-8 bytes), give the root in the same way. path: from the leaf upwards,
    the siblings before and after, each as one text; fold(leaf, path) is the root.

    Nulls: in a column, as leaf_digest() says; a null group is a group; null order values come first. Rows that repeat an order value
    come in the order of their leaves, equal rows in any; they are leaves of their own. An empty table gives no rows. Other columns
    are not read but for keep, and may have any names.

    Texts are read once and only digests are shuffled. A block has at most fanout ** levels leaves, so a large group is many blocks.
    """
    tables = Tables(docs.sparkSession)
    kept = F.struct(*[v.alias(c) for c, v in (keep or {}).items()]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    name = docs[group].cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("grp"), docs[order].alias("id"), leaf_digest([docs[c] for c in columns]).alias("leaf"), kept.alias("kept"))
    placed, upper = _trees(leaves, tables, fanout, levels)
    roots = upper.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("hash").alias("leaf"), F.struct(F.lit(None).cast("int").alias("none")).alias("kept"))
    top = _trees(roots, tables, fanout, levels)
    top = top[0], top[1].withColumn("root", F.col("hash"))
    above = _paths(*top, fanout, levels).select(F.col("id").alias("grp"), "root", F.col("path").alias("above"))
    upper = tables.put(upper.join(above, "grp").select("grp", "block", "m", "hash", "root", F.concat("path", "above").alias("path")))
    rows = _paths(placed, upper, fanout, levels)
    names = [order, group] if order != group else [order]
    own = [F.col("id").alias(order), F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1)).cast(docs.schema[group].dataType).alias(group)]
    return rows.select(*own[: len(names)], "pos", "leaf", "subroot", "root", "path", *[F.col(f"kept.{c}").alias(c) for c in keep or {}])


#: CRC-32 of a text in DuckDB, as a fold over its bits.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda d: list_transform(range(8), lambda k: (ascii(d) >> k) & 1)))), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def _tree_sql(name: str, leaves: str, keys: str, height: int) -> str:
    """CTEs name_0 .. name_height: the nodes (keys, i, h, n, before, after) of each level; a group's last level is repeated."""
    by = f"{keys}, i // 8 ORDER BY i"
    level = f"SELECT {keys}, i, h, count(*) OVER (PARTITION BY {keys}) AS n, coalesce(string_agg(h, '') OVER (PARTITION BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER (PARTITION BY {by} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"
    out = [f"{name}_0 AS ({level} FROM ({leaves}))"]
    for k in range(1, height + 1):
        up = f"SELECT {keys}, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}_{k - 1} GROUP BY {keys}, i // 8"
        out.append(f"{name}_{k} AS ({level} FROM ({up}))")
    return ", ".join(out)


def merkle_sql(docs: str = "SELECT * FROM documents", height: int = 7) -> str:
    """DuckDB SQL for op13_merkle, for groups of at most 8 ** height rows and as many groups. Ids must not repeat in a language."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lowered = f"CASE WHEN {CRC_SQL.format('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    rows = f"SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, {leaf('lowered')} AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i FROM (SELECT *, {lowered} AS lowered FROM ({docs}))"
    inner = _tree_sql("a", "SELECT g, i, leaf AS h FROM docs", "g", height)
    outer = _tree_sql("b", f"SELECT 0 AS z, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h FROM a_{height}", "z", height)
    places = f"places AS (SELECT g, row_number() OVER (ORDER BY encode(g)) - 1 AS j FROM a_{height})"
    steps = [("a", k, f"a{k}.g = d.g AND a{k}.i = d.i // {8**k}") for k in range(height)] + [("b", k, f"b{k}.i = p.j // {8**k}") for k in range(height)]
    joins = " ".join(f"JOIN {t}_{k} AS {t}{k} ON {on}" for t, k, on in steps)
    proof = " || ".join(f"{t}{k}.before || {t}{k}.after" for t, k, _ in steps)
    folds = ", ".join(f"CASE WHEN {t}{k}.n = 1 THEN f{x} ELSE sha256({t}{k}.before || f{x} || {t}{k}.after) END AS f{x + 1}" for x, (t, k, _) in enumerate(steps))
    last = f"SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256({proof}) AS proof_sha256, d.claimed AS f0, {folds}"
    last += f" FROM docs AS d JOIN places AS p ON p.g = d.g {joins} JOIN a_{height} AS s ON s.g = d.g CROSS JOIN b_{height} AS r"
    return f"WITH docs AS ({rows}), {inner}, {places}, {outer} SELECT doc_id, leaf, subroot, root, proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = root AS verified FROM ({last})"
