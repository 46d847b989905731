"""Places of rows in the order of their group, where one group may hold any share of all rows."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables


def in_ranges(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """df dealt out in ranges of order and sorted by it. The place in the input comes last in the order, so that even equal rows
    can be cut anywhere and no range is much larger than another."""
    by = [*order, "_salt"]
    return df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_salt")


def _numbering(key: int):
    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            code = np.asarray(pc.dictionary_encode(keys).indices)
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            length = np.diff(start, append=len(code))
            at = np.arange(len(code)) - np.repeat(start, length)
            if keys[0].as_py() == last:
                at[: length[0]] += seen
            last, seen = keys[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part, np.int32)), pa.array(at)], names=[*batch.schema.names, "_part", "_at"])

    return number


def place(df: DataFrame, key: str, order: list[str], tables: Tables, parts: int) -> DataFrame:
    """df with pos, the place (from 0) of each row among those of its key, in ascending order; a written table stands behind it.

    key: a string column without nulls. Rows are dealt out in ranges, so a key may lie in many parts. In each of these but
    its first, the key's rows come before all others, so that at most one offset a part is to be added, which is what is broadcast.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = in_ranges(df, [key, *order], parts)
    rows = tables.put(rows.mapInArrow(_numbering(df.columns.index(key)), f"{kinds}, _part int, _at long"))
    held = rows.groupBy(key, "_part").agg(F.count("*").alias("n"))
    before = held.withColumn("_before", F.expr(f"sum(n) over (partition by `{key}` order by _part rows between unbounded preceding and 1 preceding)"))
    before = tables.put(before.where("_before > 0").select(key, "_part", "_before"))
    out = rows.join(F.broadcast(before), [key, "_part"], "left")
    return out.select(*df.columns, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("pos"))
