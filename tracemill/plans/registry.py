"""Every registered query and, where SQL can say the same, its DuckDB text."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *inputs: str, sql: str | None = None):
    """Registers a function of views or tables under a name; sql may use the views by name."""

    def add(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, i) for i in inputs])

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


from . import accounting, files, history, ledgers, loaded, streams, telemetry, texts  # noqa: E402, F401
