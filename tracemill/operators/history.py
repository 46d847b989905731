"""Conversation history: calls and results, what later ones make needless, and what a rewrite may touch."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.numbers import estimate_tokens

RESULT_TOOLS = ("read", "exec", "grep", "bash")


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v) == kind


def _text(v: Column, path: str) -> Column:
    """A string, or the text parts of an array one per line."""
    whole = F.try_variant_get(v, path, "variant")
    parts = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string"))
    return F.when(_is(whole, "STRING"), F.try_variant_get(v, path, "string")).when(parts.isNotNull() & ~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, "\n"))


def detect_provider(v: Column) -> Column:
    """Which request shape a parsed body has; null where none or several fit."""
    messages, items = F.try_variant_get(v, "$.messages", "array<variant>"), F.try_variant_get(v, "$.input", "array<variant>")
    kind = lambda x, p: F.coalesce(F.try_variant_get(x, p, "string"), F.lit(""))
    part = lambda m: F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    a = F.coalesce(F.exists(messages, lambda m: F.exists(part(m), lambda x: kind(x, "$.type").isin("tool_use", "tool_result"))), F.lit(False))
    c = F.coalesce(F.exists(messages, lambda m: (kind(m, "$.role") == "tool") | F.try_variant_get(m, "$.tool_calls", "array<variant>").isNotNull()), F.lit(False))
    r = items.isNotNull()
    return F.when(a & ~c & ~r, "anthropic").when(c & ~a & ~r, "openai-chat").when(r & ~a & ~c, "openai-responses")


ITEM = "struct<position:int,ordinal:int,kind:string,call_id:string,tool:string,input:string,output:string,is_error:boolean,status:string,is_current:boolean,failed:boolean,ok:boolean>"


def _string(x: Column, path: str) -> Column:
    return F.try_variant_get(x, path, "string")


def _list(x: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.array().cast("array<variant>"))


def _item(position: Column, ordinal: Column, is_call: Column | bool, call_id: Column, is_current: Column | bool, x: Column, tool: Column | None = None, tool_input: Column | None = None, output: Column | None = None, is_error: Column | None = None) -> Column:
    """One ITEM. failed and ok tell what flags of a result say beside its text; status and the like are looked up in x."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    text = lambda v: F.lit(None).cast("string") if v is None else v
    is_call, status = lit(is_call), _string(x, "$.status")
    error = F.lit(False) if is_error is None else is_error
    failed = error | F.try_variant_get(x, "$.error", "variant").isNotNull() | F.coalesce(status.isin("error", "failed"), F.lit(False))
    ok = F.coalesce(F.try_variant_get(x, "$.ok", "boolean"), F.lit(False)) | F.coalesce(status.isin("completed", "success", "succeeded"), F.lit(False))
    fields = [position, ordinal, F.when(is_call, "call").otherwise("result"), call_id, text(tool), text(tool_input), text(output), error, status, lit(is_current), failed, ok]
    return F.struct(*[f.alias(f"c{k}") for k, f in enumerate(fields)]).cast(ITEM)


def _anthropic_items(messages: Column) -> Column:
    def of_message(m: Column, i: Column) -> Column:
        def of_part(x: Column, k: Column) -> Column:
            kind = _string(x, "$.type")
            error = F.coalesce(F.try_variant_get(x, "$.is_error", "boolean"), F.lit(False))
            item = _item(i, k, kind == "tool_use", F.coalesce(_string(x, "$.tool_use_id"), _string(x, "$.id")), i == F.size(messages) - 1, x, _string(x, "$.name"), F.to_json(F.try_variant_get(x, "$.input", "variant")), _text(x, "$.content"), error)
            return F.when(kind.isin("tool_use", "tool_result"), item)

        return F.array_compact(F.transform(_list(m, "$.content"), of_part))

    return F.flatten(F.transform(messages, of_message))


def _chat_items(messages: Column) -> Column:
    is_result = lambda m: _string(m, "$.role") == "tool"

    def calls(m: Column, i: Column) -> Column:
        return F.transform(_list(m, "$.tool_calls"), lambda x, k: _item(i, k, True, _string(x, "$.id"), False, x, _string(x, "$.function.name"), _string(x, "$.function.arguments")))

    def results(last: Column) -> Column:
        return F.array_compact(F.transform(messages, lambda m, i: F.when(is_result(m), _item(i, F.lit(0), False, _string(m, "$.tool_call_id"), i > last, m, output=_text(m, "$.content")))))

    last = F.coalesce(F.array_max(F.transform(messages, lambda m, i: F.when(~is_result(m), i))), F.lit(-1))
    return F.concat(F.flatten(F.transform(messages, calls)), T.bind(last, results))


def _response_items(items: Column) -> Column:
    is_call = lambda x: _string(x, "$.type").isin("function_call", "custom_tool_call")

    def found(last: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            error = F.coalesce(F.try_variant_get(x, "$.is_error", "boolean"), F.lit(False))
            item = _item(i, F.lit(0), is_call(x), _string(x, "$.call_id"), ~is_call(x) & (i > last), x, _string(x, "$.name"), F.coalesce(_string(x, "$.arguments"), _string(x, "$.input")), _text(x, "$.output"), error)
            return F.when(is_call(x) | _string(x, "$.type").isin("function_call_output", "custom_tool_call_output"), item)

        return F.array_compact(F.transform(items, one))

    return T.bind(F.coalesce(F.array_max(F.transform(items, lambda x, i: F.when(is_call(x), i))), F.lit(-1)), found)


def body_items(v: Column, provider: Column) -> Column:
    """Array of ITEM: the calls and results of a parsed body, whatever its shape. Nothing is shuffled, and the body is read once."""
    found = F.when(provider == "anthropic", T.bind(_list(v, "$.messages"), _anthropic_items)).when(provider == "openai-chat", T.bind(_list(v, "$.messages"), _chat_items))
    return found.when(provider == "openai-responses", T.bind(_list(v, "$.input"), _response_items))


def collect_items(df: DataFrame, request_id: str = "request_id", body: str = "body") -> DataFrame:
    """request_id, provider, and the fields of ITEM: calls and results of all three request shapes, one row each; broken bodies have none."""
    v = df.select(F.col(request_id).alias("request_id"), F.try_parse_json(F.col(body)).alias("v"))
    v = v.withColumn("provider", detect_provider(F.col("v"))).where("provider is not null")
    return v.select("request_id", "provider", F.explode(body_items(F.col("v"), F.col("provider"))).alias("i")).select("request_id", "provider", "i.*")


def pair_calls(calls: DataFrame, results: DataFrame, key: str = "request_id") -> DataFrame:
    """Each result beside its call; ids that are empty or occur twice on either side are left out."""
    once = lambda d: d.where("call_id is not null and call_id <> ''").groupBy(key, "call_id").agg(F.count("*").alias("n"), F.first(F.struct(*[c for c in d.columns if c not in (key, "call_id")])).alias("r")).where("n = 1").drop("n")
    c, r = once(calls).withColumnRenamed("r", "call"), once(results).withColumnRenamed("r", "result")
    return c.join(r, [key, "call_id"])


def superseded_reads(df: DataFrame) -> DataFrame:
    """Reads that are not current and whose lines a later useful read of the same path shows again.

    A later whole-file read covers anything: one maximum a path. Only ranged reads meet in a join, on request and path.
    """
    seq = F.struct("position", "ordinal")
    reads = df.where("tool = 'read' and not is_error").withColumn("seq", seq).withColumn("useless", T.useless_success(F.col("output")))
    whole = F.max(F.when(F.col("lo").isNull() & ~F.col("useless"), F.col("seq"))).over(Window.partitionBy("request_id", "path"))
    reads = reads.withColumn("last_whole", whole)
    old = reads.where("not is_current")
    by_whole = old.where("last_whole > seq").select("request_id", "path", "position", "ordinal")
    newer = reads.where("lo is not null and not useless").select("request_id", "path", F.col("lo").alias("nlo"), F.col("hi").alias("nhi"), F.col("seq").alias("nseq"))
    left = old.where("lo is not null and (last_whole is null or last_whole <= seq)")
    by_range = left.join(newer, (left["request_id"] == newer["request_id"]) & (left["path"] == newer["path"]) & (F.col("nseq") > F.col("seq")) & (F.col("nlo") <= F.col("lo")) & (F.col("nhi") >= F.col("hi")), "left_semi")
    return by_whole.unionByName(by_range.select("request_id", "path", "position", "ordinal"))


def duplicate_results(df: DataFrame, marker_bytes: int = 48) -> DataFrame:
    """Older results whose tool, input and output a later one repeats, where a marker is smaller; errors and current ones stay."""
    w = Window.partitionBy("request_id", "digest").orderBy(F.desc("position"), F.desc("ordinal"))
    d = df.where(F.lower("tool").isin(*RESULT_TOOLS) & ~F.col("is_error"))
    d = d.withColumn("digest", F.sha2(F.concat_ws("\u0001", F.lower("tool"), "input", "output"), 256)).select("request_id", "position", "ordinal", "digest", "is_current", F.octet_length("output").alias("size"))
    return d.withColumn("k", F.row_number().over(w)).where((F.col("k") > 1) & ~F.col("is_current") & (F.col("size") > marker_bytes)).select("request_id", "position", "ordinal")


def suffix_tokens(df: DataFrame) -> DataFrame:
    """Adds the tokens after each message to the end of its request."""
    after = Window.partitionBy("request_id").orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("suffix_tokens", F.coalesce(F.sum("tokens").over(after), F.lit(0)))


def idle_gap(df: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
    """Adds seconds since the session's previous request."""
    return df.withColumn("idle_s", F.unix_timestamp(F.col("at").cast("timestamp")) - F.lag(F.unix_timestamp(F.col("at").cast("timestamp"))).over(Window.partitionBy(session).orderBy(order)))


def cache_guard(reclaimed: Column, suffix: Column, marked: Column, idle_s: Column, percent: int = 51, idle_limit_s: int = 65 * 60) -> Column:
    """Whether a rewrite is held back: the request is cache-marked and warm, and would free too little of what follows."""
    warm = F.coalesce(idle_s < idle_limit_s, F.lit(True))
    return marked & warm & (suffix > 0) & (100 * reclaimed < percent * suffix)


def history_candidates(df: DataFrame, budget: int) -> DataFrame:
    """Once a body passes four fifths of its budget: old, safe rows with tokens and an id of their own, in order of age, then size."""
    whole = Window.partitionBy("request_id")
    d = df.withColumn("body_tokens", F.sum("tokens").over(whole)).withColumn("same", F.count("*").over(Window.partitionBy("request_id", "call_id")))
    ok = (F.col("body_tokens") * 5 > budget * 4) & ~F.col("is_current") & ~F.col("is_error") & (F.col("same") == 1) & (F.col("tokens") > 0)
    return d.where(ok).withColumn("rank", F.row_number().over(whole.orderBy("position", F.desc("tokens"), "call_id")))


def retain_recent(df: DataFrame, keep: int = 3) -> DataFrame:
    """Without the last `keep` results of each request."""
    return df.withColumn("k_", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("position"), F.desc("ordinal")))).where(F.col("k_") > keep).drop("k_")


def original_vs_preview(original: DataFrame, preview: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of the same id whose text changed, with whether the preview names a stored original."""
    o, p = original.select(*on, F.col("output").alias("original")), preview.select(*on, F.col("output").alias("preview"))
    return o.join(p, on).where("original <> preview").withColumn("recoverable", F.col("preview").rlike("sha256:[0-9a-f]{16}"))


def restore_losses(pairs: DataFrame, judgments: DataFrame, on: list[str], threshold: float = 0.7) -> DataFrame:
    """The original back where it was judged lost with `threshold` or more; unjudged previews stay."""
    j = pairs.join(judgments.select(*on, "probability"), on, "left")
    return j.withColumn("restored", F.coalesce(F.col("probability") >= threshold, F.lit(False))).withColumn("output", F.when(F.col("restored"), F.col("original")).otherwise(F.col("preview")))


def judge_pairs(pairs: DataFrame, judge, on: list[str]) -> DataFrame:
    """Applies a user's iterator pandas_udf (original, preview) -> probability to each distinct pair once; failures are nulls."""
    keyed = pairs.withColumn("cache_key", F.sha2(F.concat_ws("\u0001", "original", "preview"), 256))
    once = keyed.dropDuplicates(["cache_key"]).select("cache_key", judge("original", "preview").alias("probability"))
    return keyed.join(once, "cache_key").select(*on, "probability", F.when(F.col("probability").isNull(), "fallback").otherwise("judged").alias("status"))


def guarded_judge(judge: Callable[[pd.Series, pd.Series], pd.Series]):
    """A user's function of originals and previews as a UDF that never fails: struct(probability, reason).

    Where a batch raises, its rows are tried one by one, so that one bad pair does not take others with it. reason: judge-error, or invalid-response for what is no number from 0 to 1.
    """

    def rows(original: pd.Series, preview: pd.Series) -> pd.DataFrame:
        def some(lo: int, hi: int) -> list:
            try:
                out = list(judge(original.iloc[lo:hi], preview.iloc[lo:hi]))
                if len(out) != hi - lo:
                    raise ValueError("one answer a pair")
                return out
            except Exception:  # noqa: BLE001  whatever a user's function raises is a failed answer
                return [_FAILED] if hi - lo == 1 else [x for k in range(lo, hi) for x in some(k, k + 1)]

        def told(x) -> tuple:
            if x is _FAILED:
                return None, "judge-error"
            good = isinstance(x, (int, float, np.number)) and not isinstance(x, bool) and 0 <= x <= 1
            return (float(x), None) if good else (None, "invalid-response")

        return pd.DataFrame([told(x) for x in some(0, len(original))], columns=["probability", "reason"])

    return F.pandas_udf(rows, StructType().add("probability", "double").add("reason", "string"))


_FAILED = object()


def judge_within_budget(pairs: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.Series], on: list[str], budget: int = 20, least_tokens: int = 0, threshold: float = 0.7) -> DataFrame:
    """on, status, reason, probability, verdict for each pair (original, preview, is_current, is_error): a global budget of calls, and no failure of the judge fails the job.

    skipped: current-result, error-result, below-threshold (fewer tokens than least_tokens). Equal pairs are one call; the first `budget` of them, in the order of `on`, are judged: loss from the
    threshold on, else preserved. fallback: budget, judge-error, invalid-response. A null text is judged as an empty one.

    Calls are granted in two steps, the first of each task and then of all, over keys only: texts are joined to those granted.
    """
    skip = F.when(F.col("is_current"), "current-result").when(F.col("is_error"), "error-result").when(estimate_tokens(F.coalesce("original", F.lit(""))) < least_tokens, "below-threshold")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("original", "preview")]
    keyed = pairs.select(*on, *texts, skip.alias("skip"), F.sha2(F.concat(F.length(texts[0]).cast("string"), F.lit(":"), *texts), 256).alias("key_"))
    able = keyed.where("skip is null")
    firsts = able.groupBy("key_").agg(F.min(F.struct(*on)).alias("place_"))
    granted = firsts.orderBy("place_", "key_").limit(budget).select(F.col("key_").alias("of_"), "place_")
    asked = able.join(granted, (F.col("key_") == F.col("of_")) & (F.struct(*on) == F.col("place_"))).select("key_", "original", "preview").dropDuplicates(["key_"])
    answers = asked.select("key_", guarded_judge(judge)("original", "preview").alias("a")).select("key_", "a.*")
    out = keyed.join(answers.withColumn("asked_", F.lit(True)), "key_", "left")
    status = F.when(F.col("skip").isNotNull(), "skipped").when(F.col("probability").isNotNull(), "judged").otherwise("fallback")
    reason = F.coalesce("skip", F.when(F.col("asked_").isNull(), "budget").otherwise(F.col("reason")))
    probability = F.when(F.col("skip").isNull(), F.col("probability"))
    return out.select(*on, status.alias("status"), reason.alias("reason"), probability.alias("probability"), F.when(probability >= threshold, "loss").when(probability < threshold, "preserved").alias("verdict"))


def compact_history(df: DataFrame, budget: int | None = None, superseded: str = "[superseded by a later read]", useless: str = "[no output]", duplicate: str = "[same as a later result]") -> DataFrame:
    """request_id, position, ordinal, output, reason: each result after the stages superseded, useless, duplicate, repeated lines and shake, in this order.

    Later stages see what earlier ones left. Current results and errors stay. Shake runs only where the request is over its budget. Outputs are
    compared by digest. For whole requests, with archive and cache guard, see compaction.compact_requests().
    """
    key = ["request_id", "position", "ordinal"]
    old = superseded_reads(df).select(*key).withColumn("old_", F.lit(True))
    d = df.join(old, key, "left").withColumn("before", F.col("output"))
    free = ~F.col("is_current") & ~F.col("is_error")
    smaller = lambda m: F.octet_length(F.lit(m)) < F.octet_length("output")
    d = d.withColumn("reason", F.when(F.col("old_") & smaller(superseded), "superseded"))
    d = d.withColumn("output", F.when(F.col("reason") == "superseded", superseded).otherwise(F.col("output")))
    gone = F.col("reason").isNull() & free & T.useless_success(F.col("output")) & (F.lower("tool") == "bash") & smaller(useless)
    d = d.withColumn("reason", F.when(gone, "useless").otherwise(F.col("reason"))).withColumn("output", F.when(F.col("reason") == "useless", useless).otherwise(F.col("output")))
    dup = duplicate_results(d.where("reason is null"), len(duplicate)).withColumn("dup_", F.lit(True))
    d = d.join(dup, key, "left").withColumn("reason", F.when(F.col("dup_"), "duplicate").otherwise(F.col("reason")))
    d = d.withColumn("output", F.when(F.col("reason") == "duplicate", duplicate).otherwise(F.col("output")))
    log = F.lower("tool").isin("bash", "exec", "grep", "log") & free & F.col("reason").isNull()
    d = d.withColumn("new_", F.when(log, T.collapse_repeats(F.col("output"), 2, 0)).otherwise(F.col("output")))
    d = d.withColumn("reason", F.when(F.col("new_") != F.col("output"), "repeated-lines").otherwise(F.col("reason"))).withColumn("output", F.col("new_"))
    if budget is not None:
        over = 5 * F.sum(estimate_tokens(F.col("before"))).over(Window.partitionBy("request_id")) > 4 * budget
        d = d.withColumn("new_", F.when(over & free & F.col("reason").isNull(), T.history_shake(F.col("tool"), F.col("output"))).otherwise(F.col("output")))
        d = d.withColumn("reason", F.when(F.col("new_") != F.col("output"), "shake").otherwise(F.col("reason"))).withColumn("output", F.col("new_"))
    return d.select(*key, "before", "output", "reason")


def history_stats(df: DataFrame) -> DataFrame:
    """Per request: tokens before and after, rewrites, and the distinct reasons."""
    return df.groupBy("request_id").agg(F.sum(estimate_tokens(F.col("before"))).alias("before_tokens"), F.sum(estimate_tokens(F.col("output"))).alias("after_tokens"), F.count("reason").alias("rewrites"), F.array_sort(F.collect_set("reason")).alias("reasons"))
