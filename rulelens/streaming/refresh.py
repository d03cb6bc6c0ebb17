"""Structured Streaming twins: incremental refresh and trending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulelens.operators.ingest import merge_rows, refresh
from rulelens.operators.trending import windowed, windowed_append
from rulelens.store.snapshots import SnapshotTable


def incremental_refresh(spark: SparkSession, landing: str, schema: str, plan: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, whole: bool = False) -> StreamingQuery:
    """Run ``plan`` over what has newly landed and bring it into the partitions (sources) of ``table``, then stop.

    New rules replace those of the same id, the others of their source stay; of rules that repeat an id in their source the
    first counts, by source_file where there is one. With ``whole`` the new files are taken to hold all rules of their source,
    as in a full refresh.
    """

    def batch(rows: DataFrame, _: int) -> None:
        new = plan(rows)
        if whole:
            refresh(new, table)
        else:
            merge_rows(first_of_key(new), table)

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_key(rows: DataFrame, key: tuple[str, ...] = ("source", "id"), order: str = "source_file") -> DataFrame:
    """One row per key: the first by ``order`` where the rows have it, then by all columns, so that reruns agree."""
    cols = [c for c in (order,) if c in rows.columns]
    cols += [c for c in rows.columns if c not in cols]
    one = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min(F.struct(*cols)).alias("_row"))
    return one.select("_row.*").select(*rows.columns)


def snapshot_refresh(spark: SparkSession, landing: str, schema: str, plan: Callable[[DataFrame], DataFrame], table: SnapshotTable, checkpoint: str, scope: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run ``plan`` over what has newly landed and bring it into ``table`` as versions, then stop.

    ``scope`` gives, from a landed batch, the sources for which it is complete; rules of theirs that it lacks are deleted,
    also where a source has none left. A batch that is replayed after a failure changes nothing the second time, and a batch
    that fails midway leaves the version before.
    """

    def batch(rows: DataFrame, _: int) -> None:
        table.apply(first_of_key(plan(rows), tuple(table.key)), None if scope is None else scope(rows))

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trending_stream(events: DataFrame, late: str = "1 day", width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Windowed counts of a stream of events, exact users too; rows later than the watermark are dropped."""
    return windowed(events.withWatermark("ts", late), width, slide)


def trending_append(events: DataFrame, late: str = "1 day", width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """The same for append mode, with a state per user of a window that expires with it; for any number of users."""
    return windowed_append(events.withWatermark("ts", late), width, slide)
