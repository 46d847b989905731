"""Savings metrics: rollups by session and period, merging of ledgers, experiment arms and gates."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import period_key, strict_sum


def merge_ledgers(df: DataFrame) -> DataFrame:
    """First row of each event key, with conflict where rows of the key differ in anything but time and arrival."""
    sig = F.xxhash64(*[c for c in df.columns if c not in ("at", "seq", "event_key")])
    g = df.withColumn("sig_", sig).groupBy("event_key").agg(F.min_by(F.struct(*df.columns), F.col("seq")).alias("r"), F.count("*").alias("n"), F.min("sig_").alias("lo"), F.max("sig_").alias("hi"))
    return g.select("r.*", (F.col("n") - 1).alias("replays"), (F.col("lo") != F.col("hi")).alias("conflict"))


def merge_receipts(df: DataFrame) -> DataFrame:
    """A ledger of two identities, merged in order: snapshot rows, then the journal by seq. Kept rows, with replays and conflict.

    Rows: event_key, host, receipt_digest, snapshot, seq and any others. A row whose key starts with event: is kept if its key is new. Any other is left out once a kept row of
    its (host, receipt_digest) has come, whatever its key; else it is kept if its key is new. replays: later rows of the key that were not left out for their receipt;
    conflict: one of them differs in more than at, seq and snapshot. Null hosts and receipts are values like others; equal seq are taken by content.

    Both identities are reduced to their first rows before they meet, so that a key with very many rows is one row in the join.
    """
    content = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in ("at", "seq", "snapshot")]), {"ignoreNullFields": "false"}), 256)
    d = df.withColumn("sig_", content).withColumn("place_", F.struct((~F.col("snapshot")).alias("journal"), "seq", "sig_"))

    def firsts(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.col("place_")).alias("r"), F.count("*").alias("n"), F.min("sig_").alias("lo"), F.max("sig_").alias("hi"))

    events = firsts(d.where(F.col("event_key").startswith("event:")), "event_key")
    seen = events.groupBy(F.col("r.host").alias("h_"), F.col("r.receipt_digest").alias("d_")).agg(F.min("r.place_").alias("seen_"))
    others = firsts(d.where(~F.col("event_key").startswith("event:")), "host", "receipt_digest").select("r.*")
    others = others.join(seen, F.col("host").eqNullSafe(F.col("h_")) & F.col("receipt_digest").eqNullSafe(F.col("d_")), "left")
    others = firsts(others.where("seen_ is null or place_ < seen_").select(d.columns), "event_key")
    return events.unionByName(others).select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("n") - 1).alias("replays"), (F.col("lo") != F.col("hi")).alias("conflict"))


def _with_savings(df: DataFrame) -> DataFrame:
    return df.withColumn("savings", F.col("input_tokens") - F.col("inline_tokens")).withColumn("session_", F.coalesce("session_id", F.lit("<unknown>")))


def metrics_cumulative(df: DataFrame) -> DataFrame:
    """Events, distinct (host, session), signed savings, and provider savings if any was reported."""
    d = _with_savings(df)
    return d.agg(F.count("*").alias("events"), F.countDistinct("host", "session_").alias("sessions"), F.sum("savings").alias("savings"), F.sum("provider_savings").alias("provider_savings"))


def metrics_by_session(df: DataFrame) -> DataFrame:
    """Per (host, session): events, savings, and the client and model first seen."""
    first = F.struct("at", "seq")
    return _with_savings(df).groupBy("host", F.col("session_").alias("session_id")).agg(F.count("*").alias("events"), F.sum("savings").alias("savings"), F.min_by("client", first).alias("client"), F.min_by("model", first).alias("model"))


def average_by_session(df: DataFrame) -> DataFrame:
    """Savings for each session of a host, whole tokens rounded down."""
    s = metrics_by_session(df)
    return s.groupBy("host").agg(F.count("*").alias("sessions"), F.floor(F.sum("savings") / F.count("*")).cast("long").alias("average_savings"))


def metrics_by_period(df: DataFrame, zone: str = "UTC", now: str | None = None) -> DataFrame:
    """Events, sessions and savings by local day, ISO week and month. Sessions are counted anew for each grain.

    now: a UTC time; its day, week and month in the zone are then there even if empty (0 events, 0 savings), and current tells them from the rest.
    Rows are first added up to (session, day), so that what each grain shuffles is small.
    """
    d = _with_savings(df)
    keys = [period_key(F.col("at"), p, zone).alias(p) for p in ("day", "week", "month")]
    base = d.groupBy("host", "session_", *keys).agg(F.count("*").alias("events"), F.sum("savings").alias("savings"))
    sets = [[F.col("day")], [F.col("week")], [F.col("month")]]
    g = base.groupingSets(sets, F.col("day"), F.col("week"), F.col("month")).agg(F.sum("events").alias("events"), F.countDistinct("host", "session_").alias("sessions"), F.sum("savings").alias("savings"))
    period = F.when(F.col("day").isNotNull(), "day").when(F.col("week").isNotNull(), "week").otherwise("month")
    out = g.select(period.alias("period"), F.coalesce("day", "week", "month").alias("key"), "events", "sessions", "savings")
    if now is None:
        return out
    at = F.lit(now).cast("timestamp")
    today = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), period_key(at, p, zone).alias("key")) for p in ("day", "week", "month")]))
    zero = F.lit(0).cast("long")
    spine = df.sparkSession.range(1).select(today.alias("s")).select("s.*", zero.alias("events"), zero.alias("sessions"), zero.alias("savings"), F.lit(True).alias("current"))
    both = out.withColumn("current", F.lit(False)).unionByName(spine)
    return both.groupBy("period", "key").agg(*[F.sum(c).alias(c) for c in ("events", "sessions", "savings")], F.bool_or("current").alias("current"))


def latest_session(df: DataFrame) -> DataFrame:
    """The session of the latest event of each host, with its savings."""
    d = _with_savings(df)
    last = d.groupBy("host").agg(F.max_by("session_", F.struct("at", "seq")).alias("session_"))
    return d.join(last, ["host", "session_"]).groupBy("host", F.col("session_").alias("session_id")).agg(F.count("*").alias("events"), F.sum("savings").alias("savings"))


def normalize_event(df: DataFrame, body: str = "body") -> DataFrame:
    """event_name, tool_name, tool_input, output, cwd, session_id, event_id, client, model from a JSON event with any known spelling.

    Events without a name, tool or output go. A value that is no string keeps its JSON text.
    """
    names = {
        "event_name": ("event_name", "eventName", "hook_event_name", "type"), "tool_name": ("tool_name", "toolName", "tool"),
        "tool_input": ("tool_input", "toolInput", "input"), "output": ("output", "tool_output", "toolOutput", "tool_response", "result"),
        "cwd": ("cwd", "workspace", "working_directory"), "session_id": ("session_id", "sessionId"), "event_id": ("event_id", "eventId", "tool_use_id"),
        "client": ("client", "host"), "model": ("model", "model_id"),
    }
    v = F.try_parse_json(F.col(body))
    out = df
    for n, spellings in names.items():
        out = out.withColumn(n, F.coalesce(*[F.try_variant_get(v, f"$.{s}", "string") for s in spellings]))
    return out.where("event_name is not null and tool_name is not null and output is not null")


def benchmark_summary(df: DataFrame) -> DataFrame:
    """Per (benchmark, task, arm): runs, successes, attempts, cost of all attempts, cost per success; counters null where one run has none."""
    ok = F.col("passed") & F.col("verified")
    g = df.groupBy("benchmark_id", "task_id", "arm").agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.count_if(~F.col("passed") & F.col("verified")).alias("failures"), F.count_if(~F.col("verified")).alias("unverified"),
        F.sum("attempts").alias("attempts"), F.sum("cost_cents").alias("supported_cost"), strict_sum(F.col("duration_ms")).alias("duration_ms"), F.count("duration_ms").alias("duration_runs"),
        F.sum("cache_read").alias("cache_read"),
    )
    full = F.when(F.col("unverified") == 0, F.col("supported_cost"))
    return g.withColumn("cost_cents", full).withColumn("cost_per_success", F.when(F.col("successes") > 0, F.floor(F.col("supported_cost") / F.col("successes")).cast("long")))


def duplicate_attempts(df: DataFrame) -> DataFrame:
    """(task, arm, repetition) that occur more than once."""
    return df.groupBy("task_id", "arm", "repetition").agg(F.count("*").alias("n")).where("n > 1")


def regression_gate(df: DataFrame) -> DataFrame:
    """By task and overall (task null): successes of both arms and whether apply lost too many."""
    won = F.count_if(F.col("passed") & (F.col("arm") == "control")), F.count_if(F.col("passed") & (F.col("arm") == "apply"))
    g = df.rollup("task_id").agg(won[0].alias("control"), won[1].alias("apply"), F.grouping("task_id").cast("int").alias("overall"))
    lost = F.col("control") - F.col("apply")
    return g.select("task_id", "control", "apply", F.when(F.col("overall") == 1, lost <= 1).otherwise(lost < 2).alias("ok"))


def pair_arms(df: DataFrame) -> DataFrame:
    """Per (scenario, task): both arms' cost, skipping pairs with an arm missing or a free control; reduction in per mille."""
    p = df.groupBy("scenario", "task_id").pivot("arm", ["control", "apply"]).agg(F.sum("cost_cents"))
    p = p.where("control > 0 and apply is not null")
    return p.withColumn("reduction_mille", F.floor((F.col("control") - F.col("apply")) * 1000 / F.col("control")).cast("long"))


def screening_decision(df: DataFrame, least: int = 100, most_increase: int = 50) -> DataFrame:
    """Per scenario: pairs, mean and sample variance of the reduction, and whether it got dearer than allowed."""
    g = pair_arms(df).groupBy("scenario").agg(F.count("*").alias("pairs"), F.avg("reduction_mille").alias("mean_reduction"), F.var_samp("reduction_mille").alias("variance"))
    return g.withColumn("decision", F.when(F.col("pairs") < 2, "inconclusive").when(F.col("mean_reduction") < -most_increase, "failed").when(F.col("mean_reduction") >= least, "passed").otherwise("inconclusive"))


def metrics_by_arm_turn(df: DataFrame) -> DataFrame:
    """Rows and tokens overall, by arm, by turn, and by both."""
    return df.cube("arm", "turn_no").agg(F.count("*").alias("n"), F.sum("prompt").alias("prompt"), F.sum("output").alias("output"), strict_sum(F.col("tool_calls")).alias("tool_calls"), F.grouping_id().cast("int").alias("level"))


#: Quantiles that a round of selection looks at.
QUANTILES = 256


def _narrowed(d: DataFrame, rounds: int) -> DataFrame:
    """by_, lo, hi, k: of each group a range of values, and the place in it of the median of the whole group.

    Each round takes quantiles of what is in the range from a sketch that tasks merge, proposes the two around the place sought, and counts in the
    next round what is really below and between them; a proposal that misses the place is dropped. Only one row a group is ever shuffled for a task.
    """
    state = d.groupBy("by_").agg(F.min("value_").alias("lo"), F.max("value_").alias("hi"), F.expr("count(*) div 2").alias("k"), F.count("*").alias("n"))
    state = state.select("*", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    for left in range(rounds, -1, -1):
        inside = d.join(state.withColumnRenamed("by_", "of_"), F.col("by_").eqNullSafe(F.col("of_"))).where(F.col("value_").between(F.col("lo"), F.col("hi")))
        between = F.col("value_").between(F.col("lo2"), F.col("hi2"))
        sums = [F.first(c).alias(c) for c in ("lo", "hi", "lo2", "hi2", "k", "n")] + [F.count_if(F.col("value_") < F.col("lo2")).alias("below"), F.count_if(between).alias("n2")]
        if left:
            sums.append(F.percentile_approx(F.when(between, F.col("value_")), [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q"))
        g = inside.groupBy("by_").agg(*sums)
        good = (F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("n2"))
        g = g.select("by_", *[F.when(good, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi")], F.when(good, F.col("k") - F.col("below")).otherwise(F.col("k")).alias("k"), F.when(good, F.col("n2")).otherwise(F.col("n")).alias("n"), *(["q"] if left else []))
        if not left:
            return g.select("by_", "lo", "hi", "k")
        at = F.floor(F.col("k") * QUANTILES / F.col("n")).cast("int")
        state = g.select("by_", "lo", "hi", "k", "n", F.greatest("lo", F.get("q", F.greatest(at - 1, F.lit(0)))).alias("lo2"), F.least("hi", F.get("q", F.least(at + 2, F.lit(QUANTILES)))).alias("hi2"))


def upper_median(df: DataFrame, by: str, value: str, rounds: int = 2) -> DataFrame:
    """Of each group the value at place n div 2, counting from 0: the upper of two middle ones. Null values do not count; a null group is one.

    Exact selection: a range around the median is narrowed by sketches, about a hundredfold a round, and only distinct values of what is left are put in
    order, so that no task sorts a whole group. A sketch that misleads costs time, not the result.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(by).alias("by_"), F.col(value).alias("value_"))
    state = _narrowed(d, rounds).withColumnRenamed("by_", "of_")
    left = d.join(state, F.col("by_").eqNullSafe(F.col("of_"))).where(F.col("value_").between(F.col("lo"), F.col("hi"))).groupBy("by_", "value_").agg(F.count("*").alias("n"), F.first("k").alias("k"))
    reached = F.sum("n").over(Window.partitionBy("by_").orderBy("value_"))
    return left.withColumn("reached", reached).where("reached > k").groupBy("by_").agg(F.min("value_").alias("median")).withColumnRenamed("by_", by)


def gateway_gate(evidence: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per report: pass, fail or missing for each named threshold, and go / no-go / insufficient-evidence;
    a missing check wins over a failed one.

    evidence: report, check, value. thresholds: check, kind (max or min), bound. Every report is held against every
    threshold: checks are few, so they are exploded from an array beside each report.
    """
    checks = thresholds.agg(F.array_sort(F.collect_list(F.struct("check", "kind", "bound"))).alias("checks")).scalar()
    seen = evidence.groupBy("report").agg(F.map_from_entries(F.collect_list(F.struct("check", "value"))).alias("seen"))
    rows = seen.withColumn("t", F.explode(checks)).withColumn("value", F.try_element_at("seen", F.col("t.check")))
    good = F.when(F.col("t.kind") == "max", F.col("value") <= F.col("t.bound")).otherwise(F.col("value") >= F.col("t.bound"))
    rows = rows.withColumn("status", F.when(F.col("value").isNull(), "missing").when(good, "pass").otherwise("fail"))
    g = rows.groupBy("report").agg(F.bool_or(F.col("status") == "fail").alias("f"), F.bool_or(F.col("status") == "missing").alias("m"), F.array_sort(F.collect_set(F.when(F.col("status") != "pass", F.concat_ws(":", F.col("t.check"), F.col("status"))))).alias("reasons"))
    return g.select("report", F.when(F.col("m"), "insufficient-evidence").when(F.col("f"), "no-go").otherwise("go").alias("decision"), "reasons")


#: Checks of the gate with their bounds; max: at most, min: at least.
GATE_CHECKS = (
    ("paired-sample-count", "min", 10), ("discovery-intent-count", "min", 50), ("discovery-success", "min", 0.95), ("safety-critical-discovery", "min", 1), ("wrong-mutative-calls", "max", 0), ("provider-input-reduction", "min", 0.10),
    ("extra-tool-calls", "max", 1), ("p50-latency-overhead", "max", 0.15), ("startup-overhead", "max", 0.10), ("schema-validation", "min", 1), ("cancellation-propagation", "min", 1), ("timeout-propagation", "min", 1), ("error-propagation", "min", 1),
    ("progress-propagation", "min", 1), ("list-changed-invalidation", "min", 1), ("auth-propagation", "min", 1), ("approval-propagation", "min", 1), ("elicitation-propagation", "min", 1), ("weighted-cost", "max", 1),
)


def gateway_report(evidence: DataFrame, hosts: tuple[str, ...], checks: tuple[tuple[str, str, float], ...] = GATE_CHECKS) -> DataFrame:
    """Per report: decision, passed, failed and missing checks, and the sorted reasons of those not passed.

    evidence: report, host, check, value (double). Every host of a report is held against every check: one without a value is missing. The check
    all-hosts is missing unless the hosts are exactly the expected ones. Anything missing: insufficient-evidence; else anything failed: no-go; else go.
    Several values of a check: the worst counts. Checks that are not expected are not looked at; a null host is no host.
    """
    worst = evidence.where("host is not null").groupBy("report", "host", "check").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    of_host = worst.groupBy("report", "host").agg(F.map_from_entries(F.collect_list(F.struct("check", F.struct("low", "high").alias("v")))).alias("seen"))
    told = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(k).alias("kind"), F.lit(float(b)).alias("bound")) for c, k, b in checks])
    rows = of_host.withColumn("t", F.explode(told)).withColumn("v", F.try_element_at("seen", F.col("t.check")))
    good = F.when(F.col("t.kind") == "max", F.col("v.high") <= F.col("t.bound")).otherwise(F.col("v.low") >= F.col("t.bound"))
    rows = rows.select("report", "host", F.col("t.check").alias("check"), F.when(good.isNull(), "missing").when(good, "pass").otherwise("fail").alias("status"))
    whole = evidence.groupBy("report").agg(F.array_sort(F.collect_set("host")).alias("h")).select("report", F.lit("all").alias("host"), F.lit("all-hosts").alias("check"), F.when(F.col("h") == F.array(*[F.lit(h) for h in sorted(hosts)]), "pass").otherwise("missing").alias("status"))
    count = lambda s: F.count_if(F.col("status") == s)
    g = rows.unionByName(whole).groupBy("report").agg(count("pass").alias("passed"), count("fail").alias("failed"), count("missing").alias("missing"), F.array_sort(F.collect_set(F.when(F.col("status") != "pass", F.col("check")))).alias("reasons"))
    return g.withColumn("decision", F.when(F.col("missing") > 0, "insufficient-evidence").when(F.col("failed") > 0, "no-go").otherwise("go"))


def screening_report(sessions: DataFrame, repetitions: int, least_percent: int = 10, most_increase_percent: int = 5) -> DataFrame:
    """Per scenario, and for all (scenario null): pairs, costs of both arms, reduction in per mille, mean and variance over pairs, passes of both arms, status.

    sessions: scenario, repetition, arm (control, apply), cost (null: unknown), passed; one row for each scenario, repetition and arm. A pair has both costs, and a control that is not free.
    A scenario is incomplete without both costs in all repetitions, dearer if its cost rose by more than most_increase_percent, and worse if apply passed less often.
    All: inconclusive if any cost is unknown or any scenario has fewer pairs than repetitions; passed if no scenario is worse or dearer and the overall cost fell by least_percent or more; else failed.
    """
    arm = lambda a, v: F.max(F.when(F.col("arm") == a, v))
    p = sessions.groupBy("scenario", "repetition").agg(arm("control", F.col("cost")).alias("c"), arm("apply", F.col("cost")).alias("a"), arm("control", F.col("passed").cast("int")).alias("cp"), arm("apply", F.col("passed").cast("int")).alias("ap"))
    both, pair = F.col("c").isNotNull() & F.col("a").isNotNull(), F.col("c").isNotNull() & F.col("a").isNotNull() & (F.col("c") > 0)
    share = F.when(pair, (F.col("c") - F.col("a")) / F.col("c"))
    s = p.groupBy("scenario").agg(
        F.count_if(pair).alias("pairs"), (F.count_if(both) == repetitions).alias("complete"), F.sum("c").alias("control"), F.sum("a").alias("apply"), F.avg(share).alias("mean_reduction"), F.var_samp(share).alias("variance"),
        F.coalesce(F.sum("cp"), F.lit(0)).alias("control_passed"), F.coalesce(F.sum("ap"), F.lit(0)).alias("apply_passed"),
    )
    fell = lambda percent: 100 * (F.col("control") - F.col("apply")) >= percent * F.col("control")
    mille = F.when(F.col("control") > 0, F.floor((F.col("control") - F.col("apply")) * 1000 / F.col("control")).cast("long"))
    s = s.withColumn("status", F.when(~F.col("complete") | (F.col("control") <= 0), "incomplete").when(F.col("apply_passed") < F.col("control_passed"), "worse").when(~fell(-most_increase_percent), "dearer").otherwise("ok"))
    total = s.agg(
        F.lit(None).cast(s.schema["scenario"].dataType).alias("scenario"), F.sum("pairs").alias("pairs"), F.bool_and(F.col("complete") & (F.col("pairs") == repetitions)).alias("complete"), F.sum("control").alias("control"), F.sum("apply").alias("apply"),
        F.avg("mean_reduction").alias("mean_reduction"), F.lit(None).cast("double").alias("variance"), F.sum("control_passed").alias("control_passed"), F.sum("apply_passed").alias("apply_passed"), F.bool_and(F.col("status") == "ok").alias("fine"),
    ).where("pairs is not null")
    total = total.withColumn("status", F.when(~F.col("complete"), "inconclusive").when(F.col("fine") & fell(least_percent), "passed").otherwise("failed")).drop("fine")
    return s.unionByName(total).withColumn("reduction_mille", F.when(F.col("complete"), mille))
