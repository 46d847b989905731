"""Token counters: normalising, de-duplicating, rolling up and pricing."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MOST, period_key, strict_sum

WEIGHTS = {"fresh": 1000, "cached": 100, "cache_write": 1250, "output": 1000, "reasoning": 1000}


def ledger_entries(df: DataFrame) -> DataFrame:
    """Rows with valid counters, with effective_input = prompt - cached and total = prompt + output."""
    ok = (F.col("prompt") >= 0) & (F.col("output") >= 0) & (F.col("cached") >= 0) & (F.col("cache_write") >= 0)
    ok = ok & (F.col("cached") + F.col("cache_write") <= F.col("prompt")) & (F.col("prompt") + F.col("output") <= MOST)
    return df.where(ok).withColumn("effective_input", F.col("prompt") - F.col("cached")).withColumn("total", F.col("prompt") + F.col("output"))


def weighted_usage(df: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Adds fresh tokens and cost_units, in thousandths; weights override the usual ones, unknown names raise."""
    unknown = set(weights or {}) - set(WEIGHTS)
    if unknown:
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    w = WEIGHTS | (weights or {})
    fresh = F.col("prompt") - F.col("cached") - F.col("cache_write")
    visible = F.col("output") - F.col("reasoning")
    units = fresh * w["fresh"] + F.col("cached") * w["cached"] + F.col("cache_write") * w["cache_write"] + visible * w["output"] + F.col("reasoning") * w["reasoning"]
    return df.where((fresh >= 0) & (visible >= 0)).withColumn("fresh", fresh).withColumn("cost_units", units)


def ledger_by_period(df: DataFrame) -> DataFrame:
    """Sums by session, UTC day, ISO week and month, in one pass over the rows."""
    keys = {"session": F.col("session_id").cast("string"), "day": period_key(F.col("at"), "day"), "week": period_key(F.col("at"), "week"), "month": period_key(F.col("at"), "month")}
    sums = [F.count("*").alias("entries"), *(F.sum(c).alias(c) for c in ("prompt", "output", "cached", "cache_write", "effective_input", "total"))]
    pairs = ledger_entries(df).groupBy(*[k.alias(n) for n, k in keys.items()]).agg(*sums)
    names = list(keys)
    grouped = pairs.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.sum("entries").alias("entries"), *(F.sum(c).alias(c) for c in ("prompt", "output", "cached", "cache_write", "effective_input", "total")))
    period = F.when(F.col("session").isNotNull(), "session").when(F.col("day").isNotNull(), "day").when(F.col("week").isNotNull(), "week").otherwise("month")
    return grouped.select(period.alias("period"), F.coalesce(*names).alias("key"), "entries", "prompt", "output", "cached", "cache_write", "effective_input", "total")


def prefer_session_totals(df: DataFrame, is_total: str = "is_total") -> DataFrame:
    """Drops the turns of a (host, session) that has a session total; rows without a session never merge."""
    totals = df.where(F.col(is_total) & F.col("session_id").isNotNull()).select("host", "session_id").distinct()
    return df.where(F.col(is_total)).unionByName(df.where(~F.col(is_total)).join(totals, ["host", "session_id"], "left_anti"))


def latest_session_totals(df: DataFrame) -> DataFrame:
    """The last session total by arrival of each (host, session)."""
    last = Window.partitionBy("host", "session_id").orderBy(F.col("seq").desc())
    return df.withColumn("rank_", F.row_number().over(last)).where("rank_ = 1").drop("rank_")


def usage_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Totals, weighted units, distinct sessions and turns; a row without a session or turn counts as its own."""
    session = F.coalesce(F.concat(F.lit("s:"), F.col("session_id").cast("string")), F.concat(F.lit("row:"), F.col("row_id")))
    turn = F.concat_ws("/", session, F.coalesce(F.col("turn_no").cast("string"), F.col("row_id")))
    sums = [F.sum(c).alias(c) for c in ("prompt", "cached", "cache_write", "fresh", "output", "reasoning", "cost_units")]
    return weighted_usage(df).groupBy(*by).agg(F.count("*").alias("events"), *sums, F.countDistinct(session).alias("sessions"), F.countDistinct(turn).alias("turns"))


def reported_cost(df: DataFrame) -> DataFrame:
    """Per host: sessions, sessions with every cost reported, and the total if all have one."""
    s = df.groupBy("host", "session_id").agg(F.sum("cost_micro").alias("cost"), (F.count("cost_micro") == F.count("*")).alias("full"))
    out = s.groupBy("host").agg(F.count("*").alias("sessions"), F.count_if("full").alias("complete_sessions"), F.bool_and("full").alias("all_full"), F.sum(F.when(F.col("full"), F.col("cost"))).alias("known"))
    return out.select("host", "sessions", "complete_sessions", F.when(F.col("all_full"), F.col("known")).alias("cost_micro"), F.when(F.col("all_full"), "complete").when(F.col("complete_sessions") > 0, "partial").otherwise("unavailable").alias("coverage"))


def paired_sessions(df: DataFrame) -> DataFrame:
    """Per (arm, session): units, turns and tool calls, these null if any row has none."""
    return weighted_usage(df.where("arm is not null")).groupBy("arm", "session_id").agg(F.countDistinct("turn_no").alias("turns"), F.sum("prompt").alias("prompt"), F.sum("output").alias("output"), F.sum("cost_units").alias("cost_units"), strict_sum(F.col("tool_calls")).alias("tool_calls"))


def dedupe_revisions(df: DataFrame, key: str, signature: list[str], order: str) -> DataFrame:
    """One row per identity: the first, its copies counted; `conflict` where revisions differ. Rows without an identity never merge: each
    is a group of its own, so that the input is read once and such rows are spread over all tasks."""
    one = df.withColumn("sig_", F.xxhash64(*signature)).withColumn("row_", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    g = one.groupBy(F.col(key).alias("identity_"), "row_").agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("r"), F.count("*").alias("n"), F.min("sig_").alias("lo"), F.max("sig_").alias("hi"))
    return g.select("r.*", (F.col("n") - 1).alias("duplicates"), (F.col("lo") != F.col("hi")).alias("conflict"))


def quarantine_revisions(df: DataFrame, invalid: DataFrame, key: str) -> DataFrame:
    """Adds valid = false where the row's identity is in the invalid set."""
    bad = invalid.select(key).distinct().withColumn("bad_", F.lit(True))
    return df.join(bad, key, "left").withColumn("valid", F.col("bad_").isNull()).drop("bad_")


def price_requests(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds nano_usd by total-input tier, or the first reason why a request has no price.

    Profiles are a short dimension table of published prices; Spark broadcasts it by its size.
    """
    same = [requests[c] == prices[c] for c in ("provider", "model", "service")] + [requests["regional"] == prices["regional"]]
    cond: Column = same[0]
    for c in same[1:]:
        cond = cond & c
    j = requests.join(prices.select(*[c for c in prices.columns]), cond, "left").drop(prices["provider"], prices["model"], prices["service"], prices["regional"])
    long = F.col("input") > F.col("threshold")
    rate = lambda part: F.when(long, F.col(f"long_{part}")).otherwise(F.col(f"short_{part}")).cast("decimal(18,0)")
    fresh = F.col("input") - F.col("cached") - F.col("cache_write")
    nano = fresh * rate("fresh") + F.col("cached") * rate("read") + F.col("cache_write") * rate("write") + F.col("output") * rate("output")
    valid = (F.col("quality") == "complete") & (fresh >= 0) & (F.col("reasoning") <= F.col("output"))
    reason = F.when(F.col("request_key").isNull(), "missing-request-identity").when(F.col("profile_id").isNull(), "unsupported-billing-context").when(~valid, "incomplete-or-invalid-counters")
    tier = F.when(reason.isNull(), F.when(long, "long").otherwise("short"))
    return j.withColumn("reason", reason).withColumn("tier", tier).withColumn("nano_usd", F.when(reason.isNull(), nano.cast("decimal(38,0)")))


def api_cost_report(requests: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """After dedupe: priced, unpriced and duplicate counts, the supported total, and the full one only if all are priced."""
    once = dedupe_revisions(requests, "request_key", ["input", "cached", "cache_write", "output", "reasoning", "quality"], "seq")
    p = price_requests(once, prices).withColumn("nano_usd", F.when(~F.col("conflict"), F.col("nano_usd")))
    g = p.groupBy(*by).agg(F.count("nano_usd").alias("priced"), (F.count("*") - F.count("nano_usd")).alias("unpriced"), F.sum("duplicates").alias("duplicates"), F.count_if("conflict").alias("conflicts"), F.sum("nano_usd").cast("decimal(38,0)").alias("supported_nano"))
    status = F.when(F.col("unpriced") == 0, "complete").when(F.col("priced") > 0, "partial").otherwise("indeterminate")
    return g.withColumn("status", status).withColumn("estimated_nano", F.when(F.col("unpriced") == 0, F.col("supported_nano")))


def normalize_responses_usage(df: DataFrame, body: str = "usage") -> DataFrame:
    """Five counters of a usage object with nested fields or older flat names, and whether they can be trusted.

    Adds input, cached, cache_write, output, reasoning, total, status, missing and errors; counters are null when invalid.
    """
    paths = {
        "input": ["$.input_tokens"], "output": ["$.output_tokens"],
        "cached": ["$.input_tokens_details.cached_tokens", "$.cached_input_tokens", "$.cache_read_input_tokens"],
        "cache_write": ["$.input_tokens_details.cache_write_tokens", "$.cache_write_input_tokens"],
        "reasoning": ["$.output_tokens_details.reasoning_tokens", "$.reasoning_output_tokens"],
    }
    every = {f"{n}{k}_": p for n, ps in paths.items() for k, p in enumerate(ps)} | {"total_": "$.total_tokens"}
    # a body is parsed once, a text taken from it once and read as a number once: Spark joins these steps into one only where nothing is then computed twice
    parsed = df.withColumn("usage_", F.try_parse_json(F.col(body)))
    texts = parsed.withColumns({c: F.try_variant_get("usage_", p, "string") for c, p in every.items()})
    numbers = texts.withColumns({f"{c}n_": F.when(F.col(c).rlike("^[0-9]{1,16}$"), F.col(c).cast("long")) for c in every})
    text = {n: [f"{n}{k}_" for k in range(len(ps))] for n, ps in paths.items()}
    first = {n: F.coalesce(*cs) for n, cs in text.items()}
    counted = lambda cs: F.coalesce(F.expr("case " + " ".join(f"when {c} is not null then {c}n_" for c in cs) + " end"), F.lit(0))
    values = numbers.withColumns({f"{n}_": counted(cs) for n, cs in text.items()})
    value = {n: F.col(f"{n}_") for n in paths}
    errors = [(F.col("usage_").isNull(), "invalid-usage")]
    for n, cs in text.items():
        errors += [(F.col(c).isNotNull() & F.col(f"{c}n_").isNull(), f"invalid-counter:{n}") for c in cs]
        errors += [(F.col(c).isNotNull() & (F.col(c) != first[n]), f"conflicting-aliases:{n}") for c in cs[1:]]
        if n in ("input", "output"):
            errors.append((first[n].isNull(), f"missing-required-counter:{n}"))
    errors.append((value["cached"] + value["cache_write"] > value["input"], "cache-exceeds-input"))
    errors.append((value["reasoning"] > value["output"], "reasoning-exceeds-output"))
    errors.append((F.col("total_").isNotNull() & ~F.col("total_n_").eqNullSafe(value["input"] + value["output"]), "invalid-total"))
    # not by the size of the arrays, which need not be made where only the status is wanted
    any_of = lambda tests: F.coalesce(reduce(Column.__or__, tests), F.lit(False))
    judged = values.withColumns({"bad_": any_of(e for e, _ in errors), "lacking_": any_of(x.isNull() for x in first.values())})
    out = judged.withColumn("errors", F.array_distinct(F.array_compact(F.array(*[F.when(e, name) for e, name in errors])))).withColumn("missing", F.array_compact(F.array(*[F.when(x.isNull(), n) for n, x in first.items()])))
    out = out.withColumns({n: F.when(~F.col("bad_"), x) for n, x in value.items()}).withColumn("total", F.when(~F.col("bad_"), value["input"] + value["output"]))
    out = out.withColumn("status", F.when(F.col("bad_"), "invalid").when(F.col("lacking_"), "incomplete").otherwise("complete"))
    return out.drop("usage_", "bad_", "lacking_", *every, *[f"{c}n_" for c in every], *[f"{n}_" for n in paths])


def normalize_anthropic_usage(df: DataFrame, body: str = "usage") -> DataFrame:
    """input (with cache reads and writes), cached, cache_write, output, total; rows with a wrong total or a missing count go."""
    v = F.try_parse_json(F.col(body))
    get = lambda n: F.try_variant_get(v, f"$.{n}", "long")
    cached, write = F.coalesce(get("cache_read_input_tokens"), F.lit(0)), F.coalesce(get("cache_creation_input_tokens"), F.lit(0))
    out = df.withColumn("input", get("input_tokens") + cached + write).withColumn("cached", cached).withColumn("cache_write", write).withColumn("output", get("output_tokens"))
    out = out.withColumn("total", F.col("input") + F.col("output")).where("input >= 0 and output >= 0 and cached >= 0 and cache_write >= 0")
    stated = F.try_variant_get(v, "$.total_tokens", "long")
    return out.where(stated.isNull() | (stated == F.col("total")))


def cumulative_delta(df: DataFrame, key: str, order: list[str], counter: str) -> DataFrame:
    """Adds delta: the rise of a cumulative counter since the row before; null at a fall or a gap."""
    w = Window.partitionBy(key).orderBy(*order)
    d = F.col(counter) - F.when(F.row_number().over(w) == 1, 0).otherwise(F.lag(counter).over(w))
    return df.withColumn("delta", F.when(d >= 0, d))


#: Counters of a usage notification.
COUNTERS = ("input", "cached", "cache_write", "output", "reasoning", "total")


def turn_usage(df: DataFrame, thread: str = "thread_id", turn: str = "turn", order: str = "seq") -> DataFrame:
    """Per thread and turn: requests, the rise of each cumulative counter, status, and whether the requests add up to it.

    df: notifications with order, total and last (structs of COUNTERS: cumulative, and of the last request) and context_window. A total that was seen in the turn is no new
    request, wherever it stands. total_*: of the last new one. delta_*: its rise over that of the turn before (0 before the first, and for what was unknown there); null where it fell or is
    unknown. status: complete if no delta is null. reconciled: the requests all have every counter and a context window, and add up to the delta. Counters that are
    negative or beyond what a double holds are unknown.

    Notifications of a thread are first reduced to one row for each total, then to one for each turn; only these are put in order.
    """
    ok = lambda c: F.when((c >= 0) & (c <= MOST), c)
    d = df.select(F.col(thread).alias("t_"), F.col(turn).alias("n_"), F.col(order).alias("o_"), *[ok(F.col(f"total.{c}")).alias(f"total_{c}") for c in COUNTERS], *[ok(F.col(f"last.{c}")).alias(c) for c in COUNTERS], (F.col("context_window") > 0).alias("w_"))
    totals = [f"total_{c}" for c in COUNTERS]
    once = d.groupBy("t_", "n_", *totals).agg(F.min_by(F.struct(*COUNTERS, "w_"), F.struct("o_", *COUNTERS)).alias("r"), F.min("o_").alias("o_"))
    full = lambda c: F.when(F.count(f"r.{c}") == F.count("*"), F.sum(f"r.{c}"))
    turns = once.groupBy("t_", "n_").agg(F.count("*").alias("requests"), F.max_by(F.struct(*totals), F.struct("o_", *totals)).alias("now"), *[full(c).alias(c) for c in COUNTERS], F.bool_and(F.coalesce("r.w_", F.lit(False))).alias("w_"))
    before = F.lag("now").over(Window.partitionBy("t_").orderBy("n_"))
    turns = turns.withColumn("before", before)
    rise = {c: F.col(f"now.total_{c}") - F.coalesce(F.col(f"before.total_{c}"), F.lit(0)) for c in COUNTERS}
    turns = turns.withColumns({f"delta_{c}": F.when(r >= 0, r) for c, r in rise.items()})
    known, same = F.lit(True), F.col("w_")
    for c in COUNTERS:
        known, same = known & F.col(f"delta_{c}").isNotNull(), same & F.coalesce(F.col(c) == F.col(f"delta_{c}"), F.lit(False))
    return turns.select(F.col("t_").alias(thread), F.col("n_").alias(turn), "requests", "now.*", *[f"delta_{c}" for c in COUNTERS], F.when(known, "complete").otherwise("incomplete").alias("status"), same.alias("reconciled"))


#: Where a body may state its cost in USD, the first valid place wins.
COST_PATHS = ("total_cost_usd", "totalCostUsd", "cost_usd", "costUsd", "usage.total_cost_usd", "usage.totalCostUsd", "message.usage.total_cost_usd", "message.usage.totalCostUsd", "cost.total_cost_usd", "cost.totalCostUsd", "cost.usd")


def stated_cost(v: Column) -> Column:
    """struct(place, usd, nano) of a parsed body (VARIANT): the first of COST_PATHS with a number of 0 or more, from 1; null where there is none.

    nano: whole nano-dollars of the number as written, if that is a number of at most nine decimals; else null. Numbers in strings are no numbers.
    """

    def one(k: int, path: str) -> Column:
        x = F.try_variant_get(v, f"$.{path}", "variant")
        text = F.when(F.schema_of_variant(x).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.to_json(x))
        usd, exact = text.try_cast("double"), text.try_cast("decimal(38,9)")
        good = (usd >= 0) & (usd < float("inf"))
        return F.when(good, F.struct(F.lit(k).alias("place"), usd.alias("usd"), F.when(exact.cast("double") == usd, (exact * 1_000_000_000).try_cast("long")).alias("nano")))

    return F.coalesce(*[one(k, p) for k, p in enumerate(COST_PATHS, 1)])


def reported_cost_summary(df: DataFrame, by: str = "host") -> DataFrame:
    """Per host: sessions, those with a cost, nano (null unless all have one), coverage, source, and nano-dollars for a million tokens.

    df: host, session_id, event_key, at, seq, cost_nano, cost_scope (session or turn), cost_source, total_tokens. A session costs what the latest of its session-scoped costs says (by at, then seq); without any,
    the sum if every row has one. A row without a session is its own. source: the only one that counted, mixed, or unknown (also for costs without one). Negative costs are none.
    """
    cost = F.when(F.col("cost_nano") >= 0, F.col("cost_nano"))
    key = F.coalesce(F.concat(F.lit("s:"), F.col("session_id").cast("string")), F.concat(F.lit("row:"), F.col("event_key").cast("string")))
    whole = (F.col("cost_scope") == "session") & cost.isNotNull()
    source = F.coalesce("cost_source", F.lit("unknown"))
    s = df.groupBy(by, key.alias("key_")).agg(
        F.max_by(F.when(whole, F.struct(cost.alias("c"), source.alias("s"))), F.when(whole, F.struct("at", "seq"))).alias("latest"), F.sum(cost).alias("sum_"), (F.count(cost) == F.count("*")).alias("all_"), F.collect_set(source).alias("sources_"), F.sum("total_tokens").alias("tokens"),
    )
    s = s.withColumns({"cost": F.when(F.col("latest").isNotNull(), F.col("latest.c")).when(F.col("all_"), F.col("sum_")), "told": F.when(F.col("latest").isNotNull(), F.array("latest.s")).when(F.col("all_"), F.col("sources_")).otherwise(F.array().cast("array<string>"))})
    g = s.groupBy(by).agg(F.count("*").alias("sessions"), F.count("cost").alias("priced_sessions"), F.sum("cost").alias("known"), F.array_distinct(F.flatten(F.collect_set("told"))).alias("told"), F.sum("tokens").alias("tokens"))
    nano = F.when(F.col("priced_sessions") == F.col("sessions"), F.col("known"))
    named = F.when(F.size("told") == 1, F.get("told", F.lit(0))).when(F.size("told") > 1, "mixed").otherwise("unknown")
    coverage = F.when(nano.isNotNull(), "complete").when(F.col("priced_sessions") > 0, "partial").otherwise("unavailable")
    rate = F.when(F.col("tokens") > 0, F.floor(nano.cast("decimal(38,0)") * 1_000_000 / F.col("tokens")).cast("long"))
    return g.select(by, "sessions", "priced_sessions", nano.alias("nano"), coverage.alias("coverage"), named.alias("source"), rate.alias("nano_per_million"))
