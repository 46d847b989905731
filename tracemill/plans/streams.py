"""The streaming jobs run over the events there are, as queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs as J
from ..streaming.run import drain
from .registry import QUERIES, SQL
from .views import VIEWS, with_views


def _stream(name: str, view: str, sql: str | None = None):
    """Registers a streaming job over a view of events that has no window or join of its own."""

    def add(job: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            path = f"{sf_dir}/events.parquet"
            # as a pattern: a plain path to one file is no folder to stream from
            events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
            rows = spark.sql(VIEWS[view].replace("FROM events", "FROM {events}"), events=events).withColumn("at", F.col("at").cast("timestamp"))
            return drain(spark, job(rows))

        run.__doc__ = job.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql)
        return job

    return add


@_stream("str1_stream_metrics_ledger", "v_metrics", sql="SELECT DISTINCT event_key FROM v_metrics")
def ledger(df: DataFrame) -> DataFrame:
    return J.stream_metrics_ledger(df).select("event_key")


@_stream("str2_stream_daily_close", "v_counters", sql="""SELECT day_utc, version, host, count(*) AS n, count(*) FILTER (transformed) AS transformed FROM v_counters
  WHERE day_utc + INTERVAL 1 DAY <= (SELECT max(at) - INTERVAL 1 HOUR FROM v_counters) GROUP BY day_utc, version, host""")
def daily(df: DataFrame) -> DataFrame:
    return J.stream_daily_close(df)


@_stream("str3_stream_active_day", "v_counters", sql="SELECT DISTINCT day_utc, version, host, install_id FROM v_counters")
def active(df: DataFrame) -> DataFrame:
    return J.stream_active_day(df)


@_stream("str6_late_data", "v_metrics", sql="SELECT event_key, seq FROM v_metrics")
def late(df: DataFrame) -> DataFrame:
    return J.late_data(df).select("event_key", "seq")


@_stream("str8_stream_adoption", "v_counters", sql="""SELECT install_id, strftime(day_utc, '%Y-%m-%d') AS day_utc, version, host FROM (SELECT *, lag(day_utc || version) OVER (PARTITION BY install_id ORDER BY at, event_id) AS b
  FROM (SELECT * REPLACE ('1.' || (event_id % 2) AS version) FROM v_counters)) WHERE b IS DISTINCT FROM day_utc || version""")
def adoption(df: DataFrame) -> DataFrame:
    return J.stream_adoption(df.withColumn("version", F.concat(F.lit("1."), (F.col("event_id") % 2).cast("string"))))


@_stream("str7_stream_proxy_rollup", "v_metrics", sql="""SELECT window_start, host, count(*) AS requests, sum(input_tokens - inline_tokens)::BIGINT AS saved FROM (SELECT *, unnest(generate_series(date_trunc('hour', at) - INTERVAL 23 HOUR, date_trunc('hour', at), INTERVAL 1 HOUR)) AS window_start FROM v_metrics)
  WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(at) - INTERVAL 1 DAY FROM v_metrics) GROUP BY ALL""")
def rollup(df: DataFrame) -> DataFrame:
    out = J.stream_proxy_rollup(df)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_stream("str5_stream_idle_sessions", "v_metrics")
def idle(df: DataFrame) -> DataFrame:
    return J.stream_idle_sessions(df)
