"""Rewriting the history of whole requests: archive, superseded reads, empty answers, duplicates, repeated lines and shake, under a cache guard.

Requests come as JSON bodies. Their results are dealt out by request once; all that follows are windows inside a request, so that
stages can see each other's outcome without any further exchange.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import estimate_tokens
from .history import RESULT_TOOLS, body_items, cache_guard, detect_provider

#: Stages in the order in which a report names them.
STAGES = ("recoverable-archive", "superseded-read", "useless-success", "duplicate-history", "repeated-lines", "history-shake")
LOGS = ("bash", "exec", "grep", "log")


def archive_marker(text: Column) -> Column:
    """What stands for an archived text: its digest, under which the original is stored, and its size."""
    return F.concat(F.lit("[archived sha256:"), F.sha2(text, 256), F.format_string("; %dB, %d lines]", F.octet_length(text), F.size(T.lines(text))))


@dataclass(frozen=True)
class Policy:
    """What may be rewritten. budget: tokens of history; None: rewriting is not tied to one, and nothing is shaken.

    retain: newest results of a request that are never archived. percent: least share of what follows that a rewrite of a cached request has to
    free; 0: no guard. idle_s: from here on a cache counts as cold; None: never.
    """

    budget: int | None = None
    retain: int = 3
    archive_bytes: int = 3072
    percent: int = 51
    idle_s: int | None = 65 * 60
    stages: frozenset[str] = frozenset(STAGES[1:])
    superseded: str = "[superseded by a newer read]"
    useless: str = "[useless success left out]"
    duplicate: str = "[same as a newer result]"
    repeated: str = "[repeated x%d]"
    shaken: str = "[%d lines left out]"
    marker: Callable[[Column], Column] = field(default=archive_marker)


def request_results(df: DataFrame, request_id: str = "request_id", body: str = "body", idle_s: str | None = None) -> DataFrame:
    """Results of requests with their calls, dealt out by request.

    request_id, provider, body_bytes, marked (a cache mark is somewhere in the body), idle_s, position, ordinal, call_id, output, is_current, failed, ok, suffix (tokens of
    the messages after it), recency (1: the newest), paired, tool, input, call_position, call_ordinal. paired: there is one call and one result of this id, and the
    output is text. Bodies that do not parse or fit no shape have no rows.
    """
    v = df.select(F.col(request_id).alias("request_id"), F.try_parse_json(F.col(body)).alias("v"), T.has_breakpoint(F.col(body)).alias("marked"), (F.col(idle_s) if idle_s else F.lit(None)).cast("double").alias("idle_s"))
    v = v.withColumn("provider", detect_provider(F.col("v"))).where("provider is not null")
    sizes = F.transform(F.try_variant_get("v", "$.messages", "array<variant>"), lambda m: estimate_tokens(F.to_json(m)))

    def with_suffix(s: Column) -> Column:
        after = lambda i: F.aggregate(F.slice(s, i["position"] + 2, F.size(s)), F.lit(0).cast("long"), lambda n, x: n + x)
        return F.transform(body_items(F.col("v"), F.col("provider")), lambda i: F.struct(i.alias("i"), F.coalesce(after(i), F.lit(0)).alias("suffix")))

    rows = v.select("request_id", "provider", "marked", "idle_s", F.octet_length(F.to_json("v")).cast("long").alias("body_bytes"), F.explode(T.bind(sizes, with_suffix)).alias("x"))
    rows = rows.select("request_id", "provider", "marked", "idle_s", "body_bytes", "x.suffix", "x.i.*").repartition("request_id")
    same, kinds = Window.partitionBy("request_id", "call_id"), Window.partitionBy("request_id", "kind").orderBy(F.desc("position"), F.desc("ordinal"))
    is_call = F.col("kind") == "call"
    rows = rows.withColumns({"calls": F.count_if(is_call).over(same), "results": F.count_if(~is_call).over(same), "call": F.max(F.when(is_call, F.struct("position", "ordinal", "tool", "input"))).over(same)})
    rows = rows.withColumn("recency", F.row_number().over(kinds)).where("kind = 'result'")
    paired = (F.col("calls") == 1) & (F.col("results") == 1) & (F.col("call_id") != "") & F.col("output").isNotNull()
    kept = "request_id provider body_bytes marked idle_s position ordinal call_id output is_current failed ok suffix recency".split()
    call = [F.col("call.tool").alias("tool"), F.col("call.input").alias("input"), F.col("call.position").alias("call_position"), F.col("call.ordinal").alias("call_ordinal")]
    return rows.select(*kept, F.coalesce(paired, F.lit(False)).alias("paired"), *call)


def compact_requests(results: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """request_id, position, ordinal, call_id, body_bytes, before, output, reasons, held, skips, told_bytes, shown_bytes for each result of request_results().

    Stages run in the order of STAGES, each on what the last one left: what was archived is not touched again, duplicates are
    looked for after superseded and empty ones are replaced, and so on. reasons: the stages that rewrote it; held: rewrites that the guard held back; skips: why it was not
    archived; told_bytes and shown_bytes: bytes before and after each rewrite but archiving, added up. Current results and errors stay.
    """
    none = F.array().cast("array<string>")
    d = results.withColumns({"before": F.col("output"), "reasons": none, "held": F.lit(0), "told_bytes": F.lit(0).cast("long"), "shown_bytes": F.lit(0).cast("long")})
    log, old = F.lower("tool").isin(*LOGS), ~F.col("is_current")
    gain = lambda new: F.greatest(F.lit(0), estimate_tokens(F.col("output")) - estimate_tokens(new))
    idle = F.col("idle_s") if policy.idle_s is not None else F.lit(None).cast("double")
    guarded = lambda new: cache_guard(gain(new), F.col("suffix"), F.col("marked"), idle, policy.percent, policy.idle_s or 0) if policy.percent else F.lit(False)
    error = F.col("failed") | F.col("output").rlike(rf"(?i)^\s*{T.any_of(T.FAILURES)}\b")
    safe = ~error & F.when(F.col("provider") == "anthropic", F.lit(True)).otherwise(F.col("ok"))
    size = lambda c: F.octet_length(F.to_json(F.array(c)))

    def rewritten(d: DataFrame, stage: str, able: Column, new: Column) -> DataFrame:
        """The outputs of rows that may be rewritten and are not held back, replaced."""
        d = d.withColumn("_new", F.when(able, new)).withColumn("_held", F.coalesce(F.when(F.col("_new").isNotNull(), guarded(F.col("_new"))), F.lit(False)))
        done = F.col("_new").isNotNull() & ~F.col("_held")
        told = F.lit(0) if stage == STAGES[0] else F.octet_length("output")
        shown = F.lit(0) if stage == STAGES[0] else F.octet_length("_new")
        return d.withColumns({
            "held": F.col("held") + F.col("_held").cast("int"), "reasons": F.when(done, F.array_append("reasons", F.lit(stage))).otherwise(F.col("reasons")),
            "told_bytes": F.col("told_bytes") + F.when(done, told).otherwise(0), "shown_bytes": F.col("shown_bytes") + F.when(done, shown).otherwise(0),
            "output": F.when(done, F.col("_new")).otherwise(F.col("output")),
        }).drop("_new", "_held")

    d = d.withColumn("skips", F.lit(None).cast("string"))
    if STAGES[0] in policy.stages:
        marker = policy.marker(F.col("output"))
        able = F.col("paired") & safe & old & (F.col("recency") > policy.retain) & ~F.startswith("output", F.lit("[archived sha256:"))
        skips = F.when(F.octet_length("output") < policy.archive_bytes, "size").when(T.redact(F.col("output")) != F.col("output"), "redaction").when(gain(marker) == 0, "no-savings")
        d = d.withColumn("skips", F.when(able, skips))
        d = rewritten(d, STAGES[0], able & F.col("skips").isNull(), marker)
    d = d.withColumn("archived", F.size("reasons") > 0)
    free = F.col("paired") & old & ~F.col("archived")

    if "superseded-read" in policy.stages:
        d = d.withColumn("read", F.when(F.col("paired") & safe, T.read_identity(F.col("tool"), F.col("input")))).withColumn("seq", F.struct("call_position", "call_ordinal"))
        path = Window.partitionBy("request_id", "read.path")
        useful, ranged = ~T.useless_success(F.col("output")), F.col("read.lo").isNotNull()
        d = d.withColumns({"_whole": F.max(F.when(~ranged & useful, F.col("seq"))).over(path), "_parts": F.collect_list(F.when(ranged & useful, F.struct("seq", "read.lo", "read.hi"))).over(path)})
        covers = lambda r: (r["seq"] > F.col("seq")) & (r["lo"] <= F.col("read.lo")) & (r["hi"] >= F.col("read.hi"))
        covered = F.coalesce(F.col("_whole") > F.col("seq"), F.lit(False)) | (ranged & F.exists("_parts", covers))
        d = rewritten(d, "superseded-read", free & F.col("read").isNotNull() & covered, F.lit(policy.superseded)).drop("read", "seq", "_whole", "_parts")

    if "useless-success" in policy.stages:
        d = rewritten(d, "useless-success", free & (F.col("output") != policy.superseded) & safe & T.useless_success(F.col("output")), F.lit(policy.useless))

    over = F.lit(True) if policy.budget is None else (5 * F.ceil(F.col("body_bytes") / 4) > 4 * policy.budget) & (estimate_tokens(F.col("output")) > 0)
    d = d.withColumn("candidate", free & safe & over)
    if "duplicate-history" in policy.stages:
        known = F.col("paired") & F.lower("tool").isin(*RESULT_TOOLS) & F.col("input").isNotNull() & ~error
        d = d.withColumn("digest", F.when(known, F.sha2(F.concat_ws("\x01", F.lower("tool"), "input", "output"), 256)))
        newest = Window.partitionBy("request_id", "digest").orderBy(F.desc("position"), F.desc("ordinal"))
        d = d.withColumn("_again", F.col("digest").isNotNull() & (F.row_number().over(newest) > 1))
        d = rewritten(d, "duplicate-history", F.col("candidate") & F.col("_again") & (size(F.lit(policy.duplicate)) < size(F.col("output"))), F.lit(policy.duplicate)).drop("digest", "_again")

    changed = lambda new: F.nullif(new, F.col("output"))
    if "repeated-lines" in policy.stages:
        d = rewritten(d, "repeated-lines", F.col("candidate") & log, changed(T.collapse_repeats(F.col("output"), 2, 0, policy.repeated)))
    if "history-shake" in policy.stages and policy.budget is not None:
        d = rewritten(d, "history-shake", F.col("candidate") & log, changed(T.history_shake(F.col("tool"), F.col("output"), mark=policy.shaken)))
    return d.select("request_id", "position", "ordinal", "call_id", "body_bytes", "before", "output", "reasons", "held", "skips", "told_bytes", "shown_bytes")


def compaction_stats(rows: DataFrame) -> DataFrame:
    """One row for each request of compact_requests(): tokens of the body before and after, rewrites of each stage, what was held back or skipped, disclosed bytes, reasons."""
    size = lambda c: F.octet_length(F.to_json(F.array(c)))
    count = lambda s: F.sum(F.array_contains("reasons", s).cast("long"))
    freed = F.sum(F.when(F.size("reasons") > 0, size("before") - size("output")).otherwise(0))
    disclosed = F.sum(F.size(F.array_remove("reasons", STAGES[0])).cast("long"))
    g = rows.groupBy("request_id").agg(
        F.ceil(F.max("body_bytes") / 4).cast("long").alias("before_tokens"), F.ceil((F.max("body_bytes") - freed) / 4).cast("long").alias("after_tokens"), *[count(s).alias(s.replace("-", "_")) for s in STAGES], F.sum("held").cast("long").alias("held"),
        *[F.count_if(F.col("skips") == s).alias(f"skipped_{s.replace('-', '_')}") for s in ("size", "redaction", "no-savings")], disclosed.alias("disclosures"), F.sum("told_bytes").alias("told_bytes"), F.sum("shown_bytes").alias("shown_bytes"),
    )
    reasons = F.array_compact(F.array(*[F.when(F.col(s.replace("-", "_")) > 0, s) for s in STAGES]))
    return g.withColumn("reasons", reasons)
