"""Registry of queries: name -> function of (spark, sf_dir), and the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the function below under ``name``; timestamps are taken as UTC."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            zone = spark.conf.get("spark.sql.session.timeZone")
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            try:
                out = f(spark, sf_dir)
                out.schema  # noqa: B018  the plan is analysed, its time zone settled
                return out
            finally:
                spark.conf.set("spark.sql.session.timeZone", zone)

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return wrap
