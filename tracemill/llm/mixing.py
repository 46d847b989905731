"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the mix takes the point frac(i * golden ratio), and the source whose stretch of the cumulative
weights holds that point. Each source's documents, shuffled by a hash, form one run of tokens cut into equal
blocks; the r-th slot of a source takes its r-th block, starting again after the last.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, words, written

#: The golden ratio's fraction as an odd number over 2^31: multiples of it modulo 2^31 are its low-discrepancy points.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Parts of the unit interval by which slots meet sources, and slots ranked in one group.
CELLS, CHUNK = 4096, 1 << 16


def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """source, number (by code point, null last), weight, source_size, target: one row per source.

    Sources share percent % of all tokens by weight; none gets more than `most` times its size, and what
    is over is shared again by weight. With caps taken in the order of cap / weight, the level of the rest
    follows from running sums, so no loop is needed. The windows here see one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    number = F.row_number().over(by_code) - 1
    table = F.array(*[F.lit(int(x)) for x in weights])
    w = totals.select("source", "source_size", number.alias("number")).withColumn("weight", F.get(table, F.col("number") % len(weights)))
    every = Window.partitionBy(F.lit(0))
    up_to = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    # 100 times the level if all sources before this one are capped and none from here on
    over = F.sum("source_size").over(every) * percent - 100 * most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    under = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = w.withColumn("over", over).withColumn("under", under)
    open_ = F.col("over") * F.col("weight") <= 100 * most * F.col("source_size") * F.col("under")
    w = w.withColumn("k", F.row_number().over(up_to)).withColumn("open", open_)
    w = w.withColumn("at", F.min(F.when(F.col("open"), F.struct("k", "over", "under"))).over(every))
    free = (F.col("weight") * F.col("at.over")).cast("double") / (100 * F.col("at.under")).cast("double")
    capped = F.col("at").isNull() | (F.col("k") < F.col("at.k"))
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(free)
    return w.select("source", "number", "weight", "source_size", target.alias("target"))


def _schedule(sources: DataFrame) -> DataFrame:
    """slot, number, rank: every slot of the mix. sources: number, source_size, quota (tokens it gives), slots."""
    all_ = Window.partitionBy(F.lit(0))
    upto = Window.orderBy("number")
    share = sources.where("slots > 0").select("number", "slots", F.sum("slots").over(upto).alias("hi"), F.sum("slots").over(all_).alias("total"))
    lo = ((F.col("hi") - F.col("slots")).cast("decimal(38,0)") * POINTS / F.col("total")).cast("long")
    hi = (F.col("hi").cast("decimal(38,0)") * POINTS / F.col("total")).cast("long")
    share = cut(share.select("number", "slots", "total", lo.alias("lo"), hi.alias("hi")))
    width = POINTS // CELLS
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    chunks = share.agg(F.max("total").alias("total")).where("total > 0")
    chunks = chunks.select("total", F.explode(F.expr(f"sequence(0L, (total - 1) div {CHUNK})")).alias("chunk")).repartition("chunk")
    slots = chunks.select(F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(total, (chunk + 1) * {CHUNK}) - 1)")).alias("slot"))
    point = (F.col("slot") % POINTS) * GOLDEN % POINTS
    slots = slots.select("slot", point.alias("point"), F.floor(point / width).alias("cell"))
    # Spark takes generated slots for a few bytes and would broadcast them: the cells are the side to build on, and the
    # drawn slots, a few numbers for each block, are written so that later joins know their size
    drawn = slots.join(cells.hint("shuffle_hash"), "cell").where("lo <= point and point < hi").select("slot", "number", F.expr(f"slot div {CHUNK}").alias("chunk"))
    drawn = written(drawn)
    # rank within a source: by chunk, then the slots of the chunks before
    drawn = drawn.withColumn("own", F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1)
    counts = drawn.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("number").orderBy("chunk")) - F.col("n")
    counts = counts.select("number", "chunk", before.alias("before"))
    ranked = drawn.join(counts, ["number", "chunk"]).select("slot", "number", (F.col("own") + F.col("before")).alias("rank"))
    # the few blocks that the points leave out or draw too often: a source gives its quota, no more and no less
    seen = ranked.groupBy("number").agg(F.count("*").alias("seen"))
    short = share.join(seen, "number", "left").withColumn("seen", F.coalesce("seen", F.lit(0))).where("seen < slots")
    tail = short.select((F.col("total") + F.col("number")).alias("slot"), "number", F.explode(F.expr("sequence(seen, slots - 1)")).alias("rank"))
    return ranked.unionByName(tail)


def mix_schedule(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, block: int = 1024, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, takes).

    documents: doc_id, size, source, number, source_size, target, start (its place in the source's shuffled run of tokens).
    takes: slot, number, rank, start, first, length: slot gives `length` words from word `first` of the document at `start`.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text).cast("string"))).cast("long").alias("size"))
    sized = cut(sized)
    sources = cut(source_targets(sized, weights, percent, most))
    quota = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    sources = sources.withColumn("quota", quota)
    blocks = lambda x: F.ceil(x / block)
    turn = F.expr("case when source_size > 0 then quota div source_size else 0 end")
    rest = F.col("quota") - turn * F.col("source_size")
    sources = sources.withColumn("blocks", blocks(F.col("source_size"))).withColumn("slots", turn * F.col("blocks") + blocks(rest))

    # each document's start: totals of hash buckets before its own, then documents before it in the bucket
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(sized["*"], "number", "source_size", "target", "quota", "blocks")
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    placed = placed.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(256)))
    sums = placed.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("number").orderBy("bucket")) - F.col("n")
    sums = sums.select("number", "bucket", ahead.alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy("number", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = placed.withColumn("inside", inside).join(sums, ["number", "bucket"])
    placed = cut(placed.select("doc_id", "size", "source", "number", "source_size", "target", "quota", "blocks", (F.col("ahead") + F.col("inside")).alias("start")))

    pieces = placed.where("size > 0").select("number", "start", "size", "quota", "source_size", "blocks", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    schedule = _schedule(sources)
    schedule = schedule.join(sources.select("number", F.col("blocks").alias("of")), "number")
    schedule = schedule.select("slot", "number", "rank", F.expr("rank % of").alias("block"), F.expr("rank div of").alias("turn"))
    left = F.col("quota") - F.col("turn") * F.col("source_size")
    ends = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, left)
    begins = F.greatest(F.col("start"), F.col("block") * block)
    takes = schedule.join(pieces, ["number", "block"]).select("slot", "number", "rank", "start", (begins - F.col("start")).alias("first"), (ends - begins).alias("length"))
    return placed.drop("quota", "blocks"), takes.where("length > 0")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; settings as in mix_schedule().

    size: words of the text. taken: words that the mix takes of it, repeats counted; at most `most` times its size. A source's taken words
    add up to its rounded target. The order inside a source is a hash of id and size, so runs agree.

    Null texts have size 0 and are taken 0 times; null sources are one source, the last. Repeated rows and null ids are documents of
    their own; equal ones may share their source's words in any order. An empty table gives an empty result. Other columns are not read.
    """
    placed, takes = mix_schedule(docs, doc_id, source, text, **settings)
    taken = takes.groupBy("number", "start").agg(F.sum("length").alias("taken"))
    some = placed.where("size > 0").join(taken, ["number", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none, allowMissingColumns=True).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 7, table: str = "documents") -> str:
    """The rows of mix_sources() in DuckDB SQL: what the schedule gives a document follows from its place in its source."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS o FROM {table}),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
      ([{", ".join(map(str, weights))}])[1 + ((row_number() OVER (ORDER BY source IS NULL, source::BLOB)) - 1) % {len(weights)}] AS weight FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER l AS k, sum(source_size) OVER () * {percent} - {100 * most} * coalesce(sum(source_size) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ov,
      sum(weight) OVER () - coalesce(sum(weight) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS un
      FROM s WINDOW l AS (ORDER BY source_size / weight, source IS NULL, source::BLOB)),
m AS (SELECT *, min(CASE WHEN ov * weight <= {100 * most} * source_size * un THEN k END) OVER () AS first_open FROM k),
f AS (SELECT m.*, x.ov AS fo, x.un AS fu FROM m LEFT JOIN k x ON x.k = m.first_open),
t AS (SELECT source, source_size, CASE WHEN first_open IS NULL OR k < first_open THEN ({most} * source_size)::DOUBLE
      ELSE (weight * fo)::DOUBLE / (100 * fu)::DOUBLE END AS target FROM f),
q AS (SELECT *, least(round(target)::BIGINT, {most} * source_size)::BIGINT AS quota FROM t),
p AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
      (sum(d.size) OVER (PARTITION BY d.source ORDER BY o % 256, o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size
       + greatest(0, least(start + size, quota % source_size) - start) END::BIGINT AS taken FROM p
"""
