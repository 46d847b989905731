"""Structured Streaming jobs over ledgers. Each has a batch twin among the operators, with equal results on the same rows.

Times are TIMESTAMP (cast from TIMESTAMP_NTZ first: watermarks need it).
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_metrics_ledger(df: DataFrame, late: str = "1 day") -> DataFrame:
    """Retries of an event counted once, across writers and batches."""
    return df.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_key"])


def stream_daily_close(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """A day's row for each (version, host), once the day has closed."""
    g = df.withWatermark("at", late).groupBy(F.window("at", "1 day"), "version", "host").agg(F.count("*").alias("n"), F.count_if("transformed").alias("transformed"))
    return g.select(F.col("window.start").cast("date").alias("day_utc"), "version", "host", "n", "transformed")


def stream_active_day(df: DataFrame, remember: str = "30 days") -> DataFrame:
    """One marker for each (day, version, host, install)."""
    d = df.withColumn("day_utc", F.to_date("at")).withWatermark("at", remember)
    return d.dropDuplicatesWithinWatermark(["day_utc", "version", "host", "install_id"]).select("day_utc", "version", "host", "install_id")


def stream_idle_sessions(df: DataFrame, gap: str = "65 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a session that end with an idle gap."""
    g = df.where("session_id is not null").withWatermark("at", late).groupBy("session_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("tokens"))
    return g.select("session_id", F.col("w.start").alias("first_at"), "requests", "tokens")


def late_data(df: DataFrame, late: str = "30 days", ahead: str = "5 minutes") -> DataFrame:
    """Without rows from the future; rows older than the watermark go in whatever stateful step follows."""
    return df.where(F.col("at") <= F.current_timestamp() + F.expr(f"interval {ahead}")).withWatermark("at", late)


def stream_proxy_rollup(df: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests and saved tokens of a host in one-day windows every hour."""
    g = df.withWatermark("at", late).groupBy(F.window("at", "1 day", "1 hour").alias("w"), "host").agg(F.count("*").alias("requests"), F.sum(F.col("input_tokens") - F.col("inline_tokens")).alias("saved"))
    return g.select(F.col("w.start").alias("window_start"), "host", "requests", "saved")


class _Changes(StatefulProcessor):
    """Emits a row where (day, version) differs from the install's last one; rows of a batch in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day string, version string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["at", "event_id"])
        last = self.last.get() if self.last.exists() else None
        out = []
        for r in d.itertuples():
            now = (str(r.day_utc), r.version)
            if last is None or tuple(last) != now:
                out.append((key[0], str(r.day_utc), r.version, r.host))
            last = now
        self.last.update(last)
        yield pd.DataFrame(out, columns=["install_id", "day_utc", "version", "host"])

    def close(self) -> None:
        pass


def stream_adoption(df: DataFrame) -> DataFrame:
    """Adoption markers as they happen, with an install's last (day, version) as state."""
    d = df.select("install_id", "at", "event_id", F.to_date("at").cast("string").alias("day_utc"), "version", "host")
    return d.groupBy("install_id").transformWithStateInPandas(_Changes(), "install_id string, day_utc string, version string, host string", "Append", "None")


class _Causes(StatefulProcessor):
    """Keeps a session's last turn (digests and time) and classifies the next one."""

    def __init__(self, least_prompt: int, ttl_s: int):
        self.least, self.ttl = least_prompt, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "tools string, system string, messages array<string>, at long")

    def _cause(self, r, last) -> str | None:
        if r.cached > 0:
            return None
        if last is None:
            return "cold-start"
        tools, system, messages, at = last
        now = list(r.messages)
        same = next((k for k, (a, b) in enumerate(zip(messages, now)) if a != b), None)
        if tools != r.tools_digest:
            return "tools-changed"
        if system != r.system_digest:
            return "system-changed"
        if same is not None or len(now) < len(messages):
            return "history-rewritten"
        if not r.breakpoint:
            return "no-breakpoint"
        if 0 < r.prompt < self.least:
            return "below-minimum"
        return "ttl-expired" if int(r.at.timestamp()) - at > self.ttl else "unexplained"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["turn"])
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for r in d.itertuples():
            out.append((key[0], int(r.turn), bool(r.cached > 0), self._cause(r, last)))
            last = (r.tools_digest, r.system_digest, [str(m) for m in r.messages], int(r.at.timestamp()))
        self.last.update(last)
        yield pd.DataFrame(out, columns=["session_id", "turn", "hit", "cause"])

    def close(self) -> None:
        pass


def stream_cache_attribution(df: DataFrame, least_prompt: int = 1024, ttl_s: int = 3600) -> DataFrame:
    """session_id, turn, hit and miss cause as turns arrive; turns of a session within a batch are put in order."""
    return df.groupBy("session_id").transformWithStateInPandas(_Causes(least_prompt, ttl_s), "session_id long, turn long, hit boolean, cause string", "Append", "None")
