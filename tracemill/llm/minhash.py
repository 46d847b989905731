"""Near-duplicate documents by MinHash with tensored banding, links confirmed on whole shingle sets."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._links import group, shared_buckets
from ._shared import Tables, sorted_in
from ._words import Words, mix, read_words

#: Parts of a set by the first bits of its hashes, counted apart to bound what two sets have in common; a count up to DEPTH is as many bits.
BLOCKS, DEPTH = 64, 8
LONGS = BLOCKS * DEPTH // 64


def _shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; a text of fewer than n words, but at least one, is one shingle."""
    at, hashes = w.grams(n)
    doc = w.doc[at]
    first = w.first()
    count = np.diff(first)
    for k in range(1, n):  # texts of k words
        one = np.flatnonzero(count == k)
        if len(one):
            total = np.zeros(len(one), np.uint64)
            for j in range(k):
                total = mix(total * np.uint64(31) + w.hash[first[one] + j], 7 * k)
            doc, hashes = np.concatenate([doc, one]), np.concatenate([hashes, total])
    return doc, hashes


def _sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As _shingles, each shingle of a text once, sorted."""
    doc, hashes = _shingles(w, n)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _signer(n: int, rows: int, collections: int):
    """Per text: size of its set, two hashes of the set, and one hash for each collection of `rows` minima."""
    salts = [int(x) for x in mix(np.arange(1, rows * collections + 1, dtype=np.uint64))]

    def sign(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            same = np.zeros((2, batch.num_rows), np.uint64)
            sketch = np.zeros((batch.num_rows, collections), np.uint64)
            for w in read_words(batch.column(1), lower=True):
                doc, hashes = _sets(w, n)
                if not len(doc):
                    continue
                texts, at = np.unique(doc, return_index=True)
                rows_of = texts + w.lo
                size[rows_of] = np.diff(at, append=len(doc))
                same[0, rows_of] = np.add.reduceat(mix(hashes, 3), at)
                same[1, rows_of] = np.add.reduceat(mix(hashes, 5), at)
                for c in range(collections):
                    joined = np.zeros(len(texts), np.uint64)
                    for r in range(rows):
                        joined = mix(joined + np.minimum.reduceat(mix(hashes, salts[c * rows + r]), at))
                    sketch[rows_of, c] = joined
            offsets = np.arange(0, sketch.size + 1, collections, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(same[0].view(np.int64)), pa.array(same[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sketch.ravel().view(np.int64)))],
                names=["id", "n_shingles", "same_1", "same_2", "sketch"],
            )

    return sign


def _counts(hashes: np.ndarray, at: np.ndarray) -> pa.Array:
    """For the sets that start at `at`: LONGS numbers with as many bits for each block as it has hashes, and how many are over DEPTH."""
    of = np.repeat(np.arange(len(at)), np.diff(at, append=len(hashes)))
    part = (hashes >> np.uint64(65 - BLOCKS.bit_length())).astype(np.int64)
    count = np.bincount(of * BLOCKS + part, minlength=len(at) * BLOCKS).reshape(-1, BLOCKS)
    bits = np.packbits(np.arange(DEPTH) < count[:, :, None], axis=2).reshape(len(at), -1).view(np.int64)
    rows = np.column_stack([bits, np.maximum(count - DEPTH, 0).sum(axis=1)])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, LONGS + 1, dtype=np.int32)), pa.array(rows.ravel()))


def _set_rows(n: int):
    """The set of each text as one array, and its _counts()."""

    def rows(batches):
        for batch in batches:
            for w in read_words(batch.column(1), lower=True):
                doc, hashes = _sets(w, n)
                if len(doc):
                    texts, at = np.unique(doc, return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.lo + texts)), lists, _counts(hashes, at)], names=["id", "h", "blocks"])

    return rows


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, rows: int = 2, collections: int = 12) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links, its own included), kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of n-word
    shingles of the text with A-Z lowered; a text of fewer words is one shingle.
    Each of `collections` small collections holds `rows` minima; a table key joins two of them, so
    collections * (collections - 1) / 2 tables cost only rows * collections minima. With the defaults a pair at
    similarity s is met with 1 - (1-q)^12 - 12 q (1-q)^11, q = s^2: 0.99999 at 0.85.
    Documents with equal sets become one node first; candidate pairs are confirmed on the whole sets, which each candidate
    writes once. Ids are whole numbers (or their text).

    Null or empty texts have no shingles and no link. Rows with a null id have no part in links and come
    back with a null component and kept true. Repeated ids with one text count once for links and come
    back as often as they came; of rows that share an id but differ in text, a pair is confirmed if any of their texts is
    similar. An empty table gives an empty result. Other columns are not read.
    """
    tables = Tables(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    signed = tables.put(slim.mapInArrow(_signer(n, rows, collections), "id long, n_shingles long, same_1 long, same_2 long, sketch array<long>"))
    same = ["n_shingles", "same_1", "same_2"]
    real = signed.where("id is not null and n_shingles > 0")
    nodes = tables.put(real.groupBy(*same).agg(F.min("id").alias("node"), F.first("sketch").alias("sketch")))
    numbers = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(collections) for j in range(i)]
    key: Column = F.transform(F.array(*numbers), lambda t: F.struct(F.xxhash64(t.i, t.j, F.get(F.col("sketch"), t.i), F.get(F.col("sketch"), t.j)).alias("key"), (t.i * 256 + t.j).alias("slot")))
    members = shared_buckets(nodes.select("node", F.explode(key).alias("k")).select("k.key", "node", "k.slot"))
    # the sets of all texts of a candidate's id; a pair of candidates needs these and no text
    sets = tables.put(slim.join(sorted_in(members.select(F.col("node").alias("id")).distinct()), "id").select("id", "t").mapInArrow(_set_rows(n), "id long, h array<long>, blocks array<long>"))

    def verify(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sorted_in(sets.select(F.col("id").alias("a"), F.col("h").alias("ha"))), "a")
        pair = left.join(sorted_in(sets.select(F.col("id").alias("b"), F.col("h").alias("hb"))), "b")
        pair = pair.where((100 * F.size("ha") >= percent * F.size("hb")) & (100 * F.size("hb") >= percent * F.size("ha")))
        pair = pair.select("a", "b", (F.size("ha") + F.size("hb")).alias("sum"), F.size(F.array_intersect("ha", "hb")).cast("long").alias("both"))
        return pair.groupBy("a", "b").agg(F.max("both").alias("both"), F.bool_or(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).alias("link"))

    def refine(open_: DataFrame, checked: DataFrame) -> DataFrame:
        own = sets.join(sorted_in(open_.select(F.col("node").alias("id"))), "id")
        once = own.select("id", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
        once = once.groupBy("id").agg(F.count("*").alias("once"))
        size = own.groupBy("id").agg(F.min(F.size("h")).cast("long").alias("low"), F.max(F.size("h")).cast("long").alias("high"), F.count("*").alias("texts"), F.first("blocks").alias("blocks")).join(sorted_in(once), "id", "left")
        size = size.withColumn("shared", F.col("high") - F.when(F.col("texts") == 1, F.coalesce("once", F.lit(0))).otherwise(0))
        # the heaviest node that each was compared with, and how many shingles they have in common
        ends = checked.select(F.col("a").alias("node"), F.col("b").alias("hub"), "both").unionByName(checked.select(F.col("b").alias("node"), F.col("a").alias("hub"), "both"))
        ends = ends.join(sorted_in(open_.select(F.col("node").alias("hub"), "weight")), "hub").groupBy("node").agg(F.max(F.struct("weight", "hub", "both")).alias("hub"))
        sketches = nodes.groupBy("node").agg(F.first("sketch").alias("sketch"), F.count("*").alias("sets"))
        j = open_.join(sorted_in(size.withColumnRenamed("id", "node")), "node").join(sorted_in(ends), "node", "left").join(sorted_in(sketches), "node")
        other = F.coalesce(F.struct("hub.weight", "hub.hub") > F.struct("weight", "node"), F.lit(False)) & (F.col("texts") == 1)
        hub, common = F.when(other, F.col("hub.hub")).otherwise(F.col("node")), F.when(other, F.col("hub.both")).otherwise(F.col("shared"))
        # an id with several sets has no one sketch by which to name the first table of a pair
        return j.select("node", F.struct("low", "shared", hub.alias("hub"), common.alias("common"), F.when(F.col("sets") == 1, F.col("sketch")).alias("sketch"), F.when(F.col("texts") == 1, F.col("blocks")).alias("blocks")).alias("facts"))

    def at_slot(x: Column, slot: Column) -> Column:
        """Facts with the sketch's values of the collections before a table's two, by which a pair can be met in an earlier table."""
        i, j = F.floor(slot / 256).cast("int"), (slot % 256).cast("int")
        return x.withField("sketch", F.concat(F.slice(x.sketch, F.lit(1), j), F.slice(x.sketch, j + 2, i - j - 1)))

    def may_link(x: Column, y: Column, slot: Column) -> Column:
        """A shingle that one node alone has is in no intersection; with a hub in common, those in the hub and the others are bounded apart.
        Nor do two sets have more in common than the smaller count of each block: near copies that differ in other places differ in other blocks.

        Of the tables that a pair shares, the one of the first two collections in which they agree stands for all. Written to be short as
        bytecode: a join with a condition of over 8,000 bytes is not compiled by the JVM.
        """
        apart = F.least(x.common, y.common) + F.least(x.shared - x.common, y.shared - y.common)
        both = F.when(x.hub == y.hub, apart).otherwise(F.least(x.shared, y.shared))
        in_blocks = sum((F.bit_count(F.get(x.blocks, F.lit(k)).bitwiseAND(F.get(y.blocks, F.lit(k)))) for k in range(LONGS)), F.least(F.get(x.blocks, F.lit(LONGS)), F.get(y.blocks, F.lit(LONGS))))
        enough = lambda both: (100 + percent) * both >= percent * (x.low + y.low)
        return enough(both) & F.coalesce(enough(in_blocks), F.lit(True)) & ~F.coalesce(F.arrays_overlap(x.sketch, y.sketch), F.lit(False))

    _, labels = group(members, verify, refine, may_link, at_slot=at_slot)
    joined = tables.put(nodes.select(*same, "node").join(sorted_in(labels), "node", "left").select(*same, F.coalesce("component", "node").alias("component_id")))
    tables.drop(sets, nodes)
    out = signed.drop("sketch").join(sorted_in(joined), same, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
