"""Ingest bookkeeping and export: quarantine, statistics, refresh, run log, JSON and CSV."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

EXPORT_COLUMNS = (
    "id", "source", "source_file", "title", "description", "author", "status", "severity", "log_sources", "platform",
    "event_category", "mitre_tactics", "mitre_techniques", "language", "tags", "rule_created_date", "rule_modified_date",
)
STAGES = ("discovery", "read", "parse", "normalize", "store")


def staged(rows: DataFrame, rules: Sequence[tuple[str, str, Column, str]]) -> DataFrame:
    """``rows`` with error_stage, error_severity and error_message of the first (stage, severity, condition, message) that holds."""
    stage, severity, message = (F.coalesce(*[F.when(r[2], F.lit(r[k])) for r in rules]) for k in (0, 1, 3))
    return rows.withColumns({"error_stage": stage, "error_severity": severity, "error_message": message})


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where("error_stage is not null")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("error_stage is null").drop("error_stage", "error_severity", "error_message")


def error_sample(rows: DataFrame, path: str, k: int = 20) -> DataFrame:
    """The first k quarantined rows by path, for a quick review."""
    return quarantined(rows).orderBy(path).limit(k)


def stat_columns() -> list[Column]:
    """The counters of an ingest, as aggregates over ``staged`` rows."""
    skipped = F.coalesce(F.col("error_stage") == "skipped", F.lit(False))
    stored = F.count_if(F.col("error_stage").isNull())

    def passed(stage: str) -> Column:
        return F.count_if(~skipped & (F.col("error_stage").isNull() | F.col("error_stage").isin(*STAGES[STAGES.index(stage) + 1 :])))

    rate = F.when(F.count("*") > 0, F.round(100.0 * stored / F.count("*"), 1)).otherwise(0.0)
    return [
        F.count("*").alias("discovered"),
        F.count_if(skipped).alias("skipped"),
        passed("parse").alias("parsed"),
        passed("normalize").alias("normalized"),
        stored.alias("stored"),
        F.count_if(~skipped & (F.col("error_severity") == "error")).alias("errors"),
        F.count_if(~skipped & (F.col("error_severity") == "warning")).alias("warnings"),
        rate.alias("success_rate"),
        *(F.count_if(~skipped & (F.col("error_stage") == s)).alias(f"{s}_errors") for s in STAGES),
    ]


def ingest_stats(rows: DataFrame) -> DataFrame:
    """One row: discovered, skipped, parsed, normalized, stored, errors, warnings, success_rate and errors by stage, in one pass.

    A row that fails at a stage has passed those before it. Rows at stage ``skipped`` were left out by a filter: they
    are discovered and skipped, and count nowhere else.
    """
    return rows.agg(*stat_columns())


def write_ingested(rows: DataFrame, path: str) -> dict[str, object]:
    """Write ``staged`` rows to ``path`` and return the counters of ``ingest_stats``: one job does all.

    Accepted and quarantined rows go to ``quarantined=false`` and ``quarantined=true`` below ``path``, each with its error
    columns; the counters are observed on the rows as they are written, so no second pass reads or computes them again.
    """
    seen = Observation()
    marked = rows.observe(seen, *stat_columns()).withColumn("quarantined", F.col("error_stage").isNotNull())
    marked.write.partitionBy("quarantined").parquet(path)
    return seen.get


def recorded_ingest(spark: SparkSession, rows: DataFrame, path: str, log: str) -> dict[str, object]:
    """``write_ingested`` with a record of the run appended to the log at ``log``, also where writing fails."""
    got: dict[str, object] = {}

    def run() -> DataFrame:
        got.update(write_ingested(rows, path))
        return spark.createDataFrame([(got["stored"], got["errors"])], "stored long, errors long")

    logged_run(spark, log, run)
    return got


def dedup_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``. The minimum combines before the shuffle, so a hot key is no hot task."""
    cols = [order, *(c for c in rows.columns if c != order)]
    one = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*cols)).alias("_row"))
    return one.select("_row.*").select(*rows.columns)


def refresh(rows: DataFrame, path: str, by: str = "source") -> DataFrame:
    """Replace the partitions of ``path`` that ``rows`` holds, after the plan has succeeded; others stay. Returns the table.

    A source without rows keeps its old ones here, as a folder of partitions cannot be told of it; versions that can
    empty a source are in ``store.snapshots``.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return rows.sparkSession.read.parquet(path)


def merge_rows(rows: DataFrame, path: str, key: str = "id", by: str = "source") -> DataFrame:
    """Put ``rows`` in place of those of the same key in the partitions of ``path`` that they fall into. Returns the table.

    The touched partitions are read, merged by an anti join on the key and written anew; others stay. A null partition or
    key is one like others.
    """
    spark = rows.sparkSession
    try:
        table = spark.read.parquet(path)
    except AnalysisException:  # no table yet
        return refresh(rows, path, by)
    theirs = rows.select(F.col(by).alias("_by"), F.col(key).alias("_key"))
    touched = table.join(theirs.select("_by").distinct(), F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    merged = rows.unionByName(touched.join(theirs, F.col(by).eqNullSafe(F.col("_by")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti"))
    return refresh(merged, path, by)


def source_counts(rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    n = rows.groupBy("source").agg(F.count("*").alias("rule_count"))
    return n if sources is None else sources.join(n, "source", "left").withColumn("rule_count", F.coalesce("rule_count", F.lit(0)))


def source_dim(sources: DataFrame, rows: DataFrame, as_of: Column, synced: DataFrame | None = None) -> DataFrame:
    """The source dimension after a run: ``sources`` (source and more) with rule_count, last_sync, commit, status and error.

    ``synced(source, commit, error)`` holds the sources that the run tried: without an error a source is ``synced`` as of
    now with its new count, with one it is ``failed`` and keeps its time, commit and count. Others keep all.
    """
    have = lambda c, kind: F.col(c) if c in sources.columns else F.lit(None).cast(kind)
    old = sources.select("source", have("rule_count", "long").alias("n0"), have("last_sync", "timestamp").alias("t0"), have("commit", "string").alias("c0"), have("status", "string").alias("s0"), have("error", "string").alias("e0"))
    tried = rows.select("source").distinct().select("source", F.lit(None).cast("string").alias("commit"), F.lit(None).cast("string").alias("error")) if synced is None else synced.select("source", "commit", "error")
    now = old.join(tried.withColumn("tried", F.lit(True)), "source", "left").join(source_counts(rows), "source", "left")
    ok, bad = F.col("tried") & F.col("error").isNull(), F.col("error").isNotNull()
    return now.select(
        "source",
        F.when(ok, F.coalesce("rule_count", F.lit(0))).otherwise(F.coalesce("n0", F.lit(0))).alias("rule_count"),
        F.when(ok, as_of).otherwise(F.col("t0")).alias("last_sync"),
        F.when(ok, F.coalesce("commit", "c0")).otherwise(F.col("c0")).alias("commit"),
        F.when(ok, "synced").when(bad, "failed").otherwise(F.coalesce("s0", F.lit("pending"))).alias("status"),
        F.when(ok, F.lit(None).cast("string")).when(bad, F.col("error")).otherwise(F.col("e0")).alias("error"),
    )


def run_summary(per_source: DataFrame) -> DataFrame:
    """One row from (source, stored, errors): totals and a map per source. The map is as long as the list of sources."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.struct("stored", "errors").alias("result")))))
    return per_source.agg(F.sum("stored").alias("stored"), F.sum("errors").alias("errors"), F.count("*").alias("sources"), entries.alias("results"))


def logged_run(spark: SparkSession, path: str, run: Callable[[], DataFrame]) -> None:
    """Call ``run``, which gives a run summary, and append its record with times, duration and status to the log at ``path``.

    Where it fails, a ``failed`` record with the error is appended and the error raised again.
    """
    began = datetime.now(UTC)
    try:
        summary, error = run().limit(1).collect(), None
    except Exception as e:
        summary, error = [], e
    got = summary[0].asDict(recursive=True) if summary else {}
    done = datetime.now(UTC)
    kept = {k: got.get(k) for k in ("stored", "errors", "sources")} | {"results": {k: (v["stored"], v["errors"]) for k, v in (got.get("results") or {}).items()}}
    if error is not None:
        kept["errors"] = 1
    row = (began, done, (done - began).total_seconds(), "completed" if error is None else "failed", None if error is None else str(error), *kept.values())
    schema = "started_at timestamp, completed_at timestamp, duration_seconds double, status string, error_message string, stored long, errors long, sources long, results map<string, struct<stored: long, errors: long>>"
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)
    if error is not None:
        raise error


def job_history(jobs: DataFrame, source: str | None, k: int, order: str = "created_at", key: str = "id") -> DataFrame:
    """The newest k jobs, of one source or all."""
    rows = jobs if source is None else jobs.where(F.coalesce(F.col("source") == F.lit(source), F.lit(True)))
    return rows.orderBy(F.desc(order), key).limit(k)


def latest_run(jobs: DataFrame, by: str = "source") -> DataFrame:
    """Per source the completed job with the largest (completed_at, id)."""
    best = F.max(F.struct("completed_at", "id"))
    return jobs.where("status = 'completed'").groupBy(by).agg(best.alias("b")).select(by, "b.id", "b.completed_at")


def export_ids(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids, "id", "left_semi")


def export_rows(rules: DataFrame, raw: bool = False) -> DataFrame:
    """The export columns that ``rules`` has, timestamps as ISO text."""
    cols = [c for c in (*EXPORT_COLUMNS, *(["raw_content"] if raw else [])) if c in rules.columns]
    return rules.select(*(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if dict(rules.dtypes)[c] == "timestamp" else F.col(c) for c in cols))


def flat_rows(rules: DataFrame) -> DataFrame:
    """Export columns for CSV: arrays joined by commas, null description and author as ''."""
    rows = export_rows(rules)
    return rows.select(*(F.array_join(c, ",").alias(c) if kind.startswith("array") else F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("description", "author") else F.col(c) for c, kind in rows.dtypes))


def write_json(rules: DataFrame, path: str, raw: bool = False) -> None:
    export_rows(rules, raw).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(rules: DataFrame, path: str) -> None:
    flat_rows(rules).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def feed_union(feeds: dict[str, DataFrame], ts: str, source: str | None = None) -> DataFrame:
    """Rows of all feeds tagged with ``feed``, newest first."""
    out = None
    for name, rows in feeds.items():
        if source in (None, name):
            tagged = rows.withColumn("feed", F.lit(name))
            out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError(f"unknown feed {source}")
    return out.orderBy(F.desc_nulls_last(ts))
