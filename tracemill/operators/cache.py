"""Prompt-cache misses turn by turn, and where the bytes of a request go."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import bind

#: Why a turn missed, and what the bytes of a request are.
CAUSES = ("cold-start", "tools-changed", "system-changed", "history-rewritten", "no-breakpoint", "below-minimum", "ttl-expired", "unexplained")
CATEGORIES = ("host-instructions", "own-tools", "deferred-tools", "mcp-tools", "builtin-tools", "user-prompt", "history", "provider-overhead", "unknown")


def first_divergence(before: Column, now: Column) -> Column:
    """Index of the first differing entry; the length of `now` if it is a strict prefix; null if entries were only added."""
    both = F.least(F.size(before), F.size(now))
    same = F.zip_with(F.slice(before, 1, both), F.slice(now, 1, both), lambda a, b: a == b)
    at = F.array_position(same, False)
    return F.when(both == 0, F.when(F.size(now) < F.size(before), 0)).when(at > 0, (at - 1).cast("int")).when(F.size(now) < F.size(before), F.size(now))


def cache_miss_cause(df: DataFrame, least_prompt: int = 1024, ttl_s: int = 3600) -> DataFrame:
    """Adds hit, cause and divergence against the session's previous turn. Rows carry digests, not texts."""
    w = Window.partitionBy("session_id").orderBy("turn")
    d = df.withColumn("prev", F.lag(F.struct("tools_digest", "system_digest", "messages", F.col("at").alias("then"))).over(w))
    split = first_divergence(F.col("prev.messages"), F.col("messages"))
    gap = F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.col("prev.then").cast("timestamp"))
    cause = (
        F.when(F.col("cached") > 0, F.lit(None).cast("string")).when(F.col("prev").isNull(), "cold-start").when(F.col("prev.tools_digest") != F.col("tools_digest"), "tools-changed")
        .when(F.col("prev.system_digest") != F.col("system_digest"), "system-changed").when(split.isNotNull(), "history-rewritten").when(~F.col("breakpoint"), "no-breakpoint")
        .when((F.col("prompt") > 0) & (F.col("prompt") < least_prompt), "below-minimum").when(gap > ttl_s, "ttl-expired").otherwise("unexplained")
    )
    return d.withColumn("hit", F.col("cached") > 0).withColumn("cause", cause).withColumn("divergence", split).drop("prev")


def cache_session_summary(df: DataFrame) -> DataFrame:
    """Per session: turns, hits, misses by cause, tokens read and written, and writes over reads in per mille (null without reads)."""
    g = df.groupBy("session_id").agg(
        F.count("*").alias("turns"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), *[F.count_if(F.col("cause") == c).alias(c.replace("-", "_")) for c in CAUSES],
        F.sum("cached").alias("read"), F.sum("cache_write").alias("written"),
    )
    return g.withColumn("ratio_mille", F.when(F.col("read") > 0, F.floor(F.col("written") * 1000 / F.col("read")).cast("long")))


def message_digests(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds digests of a request body's messages, tools and system text, and whether it has a cache mark."""
    v = F.try_parse_json(F.col(body))
    sha = lambda x: F.sha2(F.to_json(x), 256)
    rows = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.try_variant_get(v, "$.input", "array<variant>"))
    return (
        df.withColumn("messages", F.transform(rows, sha)).withColumn("tools_digest", sha(F.try_variant_get(v, "$.tools", "variant")))
        .withColumn("system_digest", sha(F.try_variant_get(v, "$.system", "variant"))).withColumn("breakpoint", F.col(body).rlike(r'(?<!\\)"cache_control"\s*:'))
    )


SEGMENT = "array<struct<category:string,bytes:long>>"


def classify_context(df: DataFrame, own_prefix: str = "own_", request_id: str = "request_id", body: str = "body") -> DataFrame:
    """request_id, seq, category, bytes: segments of request bodies by what they are, sizes of their JSON.

    In the order host instructions, tools, messages, then the other keys. A body is read once and gives an array of its segments; nothing is shuffled.
    """
    v = df.select(F.col(request_id).alias("request_id"), F.try_parse_json(F.col(body)).alias("v")).where("v is not null")
    size = lambda x: F.octet_length(F.to_json(x)).cast("long")
    s = lambda x, p: F.try_variant_get(x, p, "string")
    top = lambda p: F.try_variant_get("v", p, "variant")
    several = lambda p: F.try_variant_get("v", p, "array<variant>")
    segment = lambda category, x: F.struct((category if isinstance(category, Column) else F.lit(category)).alias("category"), size(x).alias("bytes"))

    def tool(x: Column) -> Column:
        name = F.coalesce(s(x, "$.name"), s(x, "$.function.name"), F.lit(""))
        return segment(F.when(name.startswith(own_prefix), "own-tools").when(s(x, "$.defer_loading") == "true", "deferred-tools").when(name.startswith("mcp__"), "mcp-tools").otherwise("builtin-tools"), x)

    def messages(rows: Column) -> Column:
        plain = lambda x: (s(x, "$.role") == "user") & ~F.to_json(x).contains('"tool_result"')
        last = F.coalesce(F.array_max(F.transform(rows, lambda x, k: F.when(plain(x), k))), F.lit(-1))
        return bind(last, lambda n: F.transform(rows, lambda x, k: segment(F.when(k == n, "user-prompt").otherwise("history"), x)))

    known = ("system", "instructions", "tools", "messages", "input")
    other = F.filter(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: ~e["key"].isin(*known))
    parts = [F.transform(F.array_compact(F.array(top("$.system"), top("$.instructions"))), lambda x: segment("host-instructions", x)), F.transform(several("$.tools"), tool), bind(F.coalesce(several("$.messages"), several("$.input")), messages), F.transform(other, lambda e: segment("provider-overhead", e["value"]))]
    every = F.concat(*[F.coalesce(p, F.array().cast(SEGMENT)) for p in parts])
    return v.select("request_id", F.posexplode(every).alias("seq", "x")).select("request_id", "seq", "x.category", "x.bytes")


def budget_clip(df: DataFrame, total: str = "body_bytes") -> DataFrame:
    """Bytes of ordered segments, clipped where they pass the request's body."""
    before = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("clipped", F.greatest(F.lit(0), F.least(F.col("bytes"), F.col(total) - F.coalesce(F.sum("bytes").over(before), F.lit(0)))))


def footprint_by_category(segments: DataFrame, bodies: DataFrame) -> DataFrame:
    """Per request one row: bytes of each category (0 if none), what is unknown, tokens of the sum, and a status.

    Segments and bodies without a request are one request. Tokens are a quarter of the bytes, rounded up; of an estimate of a body that is below zero, by whole-number division like that of SQL.
    """
    sums = [F.sum(F.when(F.col("category") == c, F.col("bytes"))).alias(c) for c in CATEGORIES]
    g = segments.groupBy(F.col("request_id").alias("of_")).agg(*sums, F.count("*").alias("segments"), F.sum("bytes").alias("attributed"))
    d = bodies.select("request_id", "body_bytes").join(g, F.col("request_id").eqNullSafe(F.col("of_")), "left").drop("of_").na.fill(0, [*CATEGORIES, "segments", "attributed"])
    d = d.withColumn("unknown", F.col("unknown") + F.greatest(F.lit(0), F.col("body_bytes") - F.col("attributed")))
    status = F.when(F.col("segments") == 0, "unavailable").when(F.col("unknown") > 0, "partial").otherwise("complete")
    return d.select("request_id", *[F.col(c).alias(c.replace("-", "_")) for c in CATEGORIES], "segments", "body_bytes", F.expr("(body_bytes + 3) div 4").alias("tokens"), status.alias("status"))


_USAGE_KEY = re.compile(r'"usage"\s*:')
#: A string, to the end of the text if it is not closed, or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.S)


def _usage_objects(text: str | None) -> list[str]:
    """The objects after each key usage, braces balanced outside of strings; those that do not end are left out."""
    out = []
    for key in _USAGE_KEY.finditer(text or ""):
        start, depth = text.find("{", key.end()), 0
        for token in _TOKEN.finditer(text, start) if start >= 0 else ():
            depth += {"{": 1, "}": -1}.get(token[0], 0)
            if depth == 0:
                out.append(text[start : token.end()])
                break
    return out


@F.pandas_udf(ArrayType(StringType()))
def usage_objects(text: pd.Series) -> pd.Series:
    return text.map(_usage_objects)


def extract_usage(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds usage: the "usage": {...} objects of a streamed answer, of any depth, merged key by key; later ones win, nested values stay JSON.

    Broken objects are left out; a text without any has an empty map, and so has null. An object is looked for after each key, also inside another.
    """
    found = F.filter(F.col("_found"), lambda x: F.try_parse_json(x).isNotNull())
    maps = F.transform(found, lambda x: F.from_json(x, "map<string,string>"))
    merged = F.aggregate(maps, F.create_map().cast("map<string,string>"), lambda a, m: F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(m, e.key)), F.map_entries(m))))
    return df.withColumn("_found", usage_objects(F.col(text))).withColumn("usage", merged).drop("_found")
