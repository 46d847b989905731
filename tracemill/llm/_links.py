"""Connected groups of similar rows, from bucket memberships, without listing the pairs of a bucket."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, sorted_in

#: Edges for each task of components(); up to this many, all rounds run in one task each.
TASK_EDGES = 50_000
#: Nodes of a large bucket that are held against as many others of it at a time.
DEALT = 500


def _state(edges: DataFrame) -> tuple:
    """Number and fingerprint of the edges: one row, equal when a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node that has an edge (a, b).

    Each round points every node at the smallest neighbour of its neighbours and then
    short-cuts (large star, small star), so long chains close in logarithmically many rounds.
    Only groupings and equi-joins: a node with very many edges is partially aggregated, and its join
    partition can be split. The number of tasks follows the number of edges.
    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    tables = Tables(edges.sparkSession)
    e = edges.select("a", "b").where("a <> b")
    e = tables.put(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    while state[0]:
        tasks = 1 + state[0] // TASK_EDGES
        few = e.coalesce(tasks)
        both = few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(sorted_in(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().coalesce(tasks)
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        hooked = star.join(sorted_in(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, tables.put(hooked.unionByName(low.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct())
        tables.drop(last)
        before, state = state, _state(e)
        if before == state:
            break
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops).distinct()


def shared_buckets(members: DataFrame) -> DataFrame:
    """key, node, slot, weight: the rows (key, node, slot) whose key has two rows or more; weight adds up the sizes of a node's buckets.

    slot tells which of a node's keys it is, where members has it.
    """
    members = members if "slot" in members.columns else members.withColumn("slot", F.lit(0))
    crowd = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tables = Tables(members.sparkSession)
    rows = tables.put(members.join(crowd, "key").select("key", "node", "slot", "n"))
    weight = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    out = tables.put(rows.select("key", "node", "slot").join(sorted_in(weight), "node"))
    tables.drop(rows)
    return out


def _decided(rows: DataFrame, details: DataFrame, decide: Callable[[str, str], Column], may_link: Callable[[Column, Column, Column], Column], facts: DataFrame, most: int, band: Callable[[Column], Column] | None, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets of at most `most` nodes; and the links (a, b) of all pairs of different components in larger ones.

    A pair is decided inside the join, once, in the first bucket that it shares, so that only links leave it. A node meets those of its own
    band and of the two beside it. A band of a bucket is dealt into parts of about DEALT nodes, and each two parts that may hold a pair, in one band or in bands
    beside each other, are a cell of the join: however large a bucket, no cell holds more than two parts, and their number grows instead.
    Tasks are as many as shuffle partitions, since their work does not follow their bytes.
    """
    size = tables.put(rows.groupBy("key").agg(F.count("*").alias("n")))
    small = rows.join(size.where(F.col("n") <= most), "key").drop("n")
    at = F.lit(0) if band is None else band(F.col("facts"))
    large = rows.join(size.where(F.col("n") > most), "key").join(sorted_in(facts), "node").select("key", "node", "component", "facts", at.cast("long").alias("band"))
    large = tables.put(large)
    if large.isEmpty():
        return small, large.select(F.col("node").alias("a"), F.col("node").alias("b"))
    deals = tables.put(large.groupBy("key", "band").agg(F.ceil(F.count("*") / DEALT).alias("deals")))
    each = deals.select("key", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    beside = each.select("key", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("band_2"), F.col("deal").alias("deal_2"))
    cells = tables.put(each.join(beside, ["key", "band"]).where("band < band_2 or deal <= deal_2"))
    keys = large.groupBy("node").agg(F.collect_list("key").alias("keys"))
    wide = large.join(sorted_in(keys.join(sorted_in(details), "node")), "node").join(deals, ["key", "band"]).withColumn("deal", F.pmod(F.xxhash64("node"), "deals")).drop("deals")
    one = wide.join(cells, ["key", "band", "deal"])
    other = wide.select("key", *[F.col(c).alias(f"{c}_2") for c in wide.columns if c != "key"]).join(cells, ["key", "band_2", "deal_2"])
    within = (F.col("band") != F.col("band_2")) | (F.col("deal") != F.col("deal_2")) | (F.col("node") < F.col("node_2"))
    test = within & (F.col("component") != F.col("component_2")) & may_link(F.col("facts"), F.col("facts_2"), F.lit(0))
    first = F.array_min(F.array_intersect("keys", "keys_2")) == F.col("key")
    on, parts = ["key", "band", "deal", "band_2", "deal_2"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = one.repartition(parts, *on).hint("merge").join(other.repartition(parts, *on), on).where(test & first & decide("details", "details_2"))
    return small, tables.put(pairs.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) by these links too. What is joined already is a star, which fewer rounds close than its links."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def group(members: DataFrame, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, may_link: Callable[[Column, Column, Column], Column] | None = None, facts: DataFrame | None = None, spread: int = 64, details: DataFrame | None = None, decide: Callable[[str, str], Column] | None = None, most: int = 64, at_slot: Callable[[Column, Column], Column] | None = None, band: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of nodes linked by verified pairs among those that share a bucket.

    members: key, node, slot, weight, as shared_buckets() gives them. verify: pairs (a, b) -> those looked at, with link (boolean).
    refine: (node, weight), first round's verify() -> node, facts; may_link: (facts, facts, slot) -> false where two
    nodes cannot be linked, and where they share a bucket of another slot that stands for them; at_slot: (facts, slot) -> facts as may_link gets them.
    Returns (links (a, b); node, component), both only with nodes that have a link.

    In each round a bucket names leaders, the heaviest node of each of its parts, and members are compared with the
    leaders of other components only. The first round has one part, the second `spread` parts, and in the third every
    node leads: then all pairs of different components in the bucket have been compared or ruled out, so no link between
    components is missed. A large bucket whose nodes agree with its heaviest ends after one comparison a node.
    With details (node, details), decide (names of two details -> whether they are linked) and facts, pairs of the last round in buckets of over `most`
    nodes are decided inside their join and not by verify: there may be many of these, for nodes that have something in common
    without being linked, but only links come out. band: facts -> a whole number; where two nodes may be linked, theirs differ by one at most.
    Facts (node, facts) that are at hand hold from the first round; else refine is asked after it, for nodes of
    buckets that still hold several components. A round's tables are deleted when the next has its own.
    """
    tables = Tables(members.sparkSession)
    links, labels, done, checked = None, None, None, None
    for last_round, part in ((False, F.lit(0)), (False, F.pmod(F.xxhash64("node"), F.lit(spread))), (True, F.col("node"))):
        if labels is None:
            rows = members.withColumn("component", F.col("node"))
        else:
            rows = members.join(sorted_in(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
            rows = rows.join(mixed, "key", "left_semi")
        inside = None
        if decide is not None and last_round:
            rows, inside = _decided(tables.put(rows), details, decide, may_link, facts, most, band, tables)
            links = links.unionByName(inside)
        if facts is None and refine is not None and labels is not None:
            rows = tables.put(rows)
            facts = tables.put(refine(rows.select("node", "weight").distinct(), checked))
        open_ = rows.join(sorted_in(facts), "node") if facts is not None else rows.withColumn("facts", F.lit(None).cast("string"))
        if facts is not None and at_slot is not None:
            open_ = open_.withColumn("facts", at_slot(F.col("facts"), F.col("slot")))
        open_ = tables.put(open_)
        tables.drop(rows)
        if open_.isEmpty():
            labels = _joined(labels, inside) if inside is not None else labels
            break
        led = open_.withColumn("part", part).groupBy("key", "part").agg(F.max(F.struct("weight", "node", "component", "facts")).alias("l"), F.count("*").alias("n"))
        heads = led.select("key", F.col("l.node").alias("head"), F.col("l.component").alias("of"), F.col("l.facts").alias("head_facts"))
        test = F.col("component") != F.col("of")
        if facts is not None:
            test = test & may_link(F.col("facts"), F.col("head_facts"), F.col("slot"))
        pairs = open_.join(heads, "key").where(test)
        pairs = pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(sorted_in(done), ["a", "b"], "left_anti")
        pairs = tables.put(pairs)
        last = led.where("n > 1").isEmpty()
        tables.drop(open_, checked)
        checked = tables.put(verify(pairs))
        found = tables.put(checked.where("link").select("a", "b"))
        links = found if links is None else links.unionByName(found)
        done = pairs if done is None else done.unionByName(pairs)
        labels = _joined(labels, found if inside is None else found.unionByName(inside))
        if last:
            break
        labels = tables.put(labels)
    if links is None:
        links = members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        labels = members.select("node", F.col("node").alias("component")).limit(0)
    return links, labels
