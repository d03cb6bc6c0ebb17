"""Ingest bookkeeping and export queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from rulelens.operators import ingest as G
from rulelens.plans.registry import query
from rulelens.sources.corpus import DET, detections, read


def folder(spark, name: str) -> str:
    """A new folder for written results, in the session's shared folder where it has one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rulelens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(spark, sf):
    """Pages with the stage at which their ingest fails."""
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    pages = read(spark, sf, "pages").select("page_id", host.alias("source"), "url", "html", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    closed = F.contains("html", F.lit("</html>"))
    return G.staged(pages, [("read", "error", ~closed, "no end tag"), ("normalize", "warning", F.length("title") < 10, "short title")])


LANDED = """landed AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS source, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  CASE WHEN NOT contains(html, '</html>') THEN 'read' WHEN length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) < 10 THEN 'normalize' END AS stage FROM pages)"""


@query("ingest_quarantine", f"WITH {LANDED} SELECT page_id, stage AS error_stage, CASE stage WHEN 'read' THEN 'error' ELSE 'warning' END AS error_severity, CASE stage WHEN 'read' THEN 'no end tag' ELSE 'short title' END AS error_message FROM landed WHERE stage IS NOT NULL")
def ingest_quarantine(spark, sf):
    return G.quarantined(landed(spark, sf)).select("page_id", "error_stage", "error_severity", "error_message")


STATS = f"""WITH {LANDED} SELECT count(*) AS discovered, 0::BIGINT AS skipped, count(*) FILTER (stage IS NULL OR stage IN ('normalize', 'store')) AS parsed, count(*) FILTER (stage IS NULL OR stage = 'store') AS normalized, count(*) FILTER (stage IS NULL) AS stored, count(*) FILTER (stage = 'read') AS errors, count(*) FILTER (stage = 'normalize') AS warnings,
round(100.0::DOUBLE * count(*) FILTER (stage IS NULL) / count(*), 1) AS success_rate, 0::BIGINT AS discovery_errors, count(*) FILTER (stage = 'read') AS read_errors, 0::BIGINT AS parse_errors,
count(*) FILTER (stage = 'normalize') AS normalize_errors, 0::BIGINT AS store_errors FROM landed"""


@query("ingest_stats", STATS)
def ingest_stats(spark, sf):
    return G.ingest_stats(landed(spark, sf))


@query("ingest_observed", STATS)
def ingest_observed(spark, sf):
    """Write rows and quarantine, with the counters observed on the way."""
    got = G.write_ingested(landed(spark, sf), folder(spark, "ingested"))
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{c} {'double' if c == 'success_rate' else 'long'}" for c in got))


@query("dedup_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS id FROM documents GROUP BY text")
def dedup_first(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("id"))
    return G.dedup_first(rows, "id", "doc_id")


@query("refresh_partition", "SELECT o_orderstatus AS source, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders GROUP BY o_orderstatus")
def refresh_partition(spark, sf):
    """Write all sources, refresh one, read the table back."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("source"))
    path = folder(spark, "refresh")
    G.refresh(orders, path)
    table = G.refresh(orders.where("source = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2), path)
    return table.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("error_sample", f"WITH {LANDED} SELECT url, stage AS error_stage FROM landed JOIN pages USING (page_id) WHERE stage IS NOT NULL ORDER BY url, page_id LIMIT 20")
def error_sample(spark, sf):
    """The first 20 errors, for a quick review (a report)."""
    rows = landed(spark, sf).withColumn("at", F.struct("url", "page_id"))
    return G.error_sample(rows, "at").select("url", "error_stage")


def checked(spark, sf):
    """Documents with the stage at which their ingest fails."""
    docs = read(spark, sf, "documents").select("doc_id", "source", "text")
    return G.staged(docs, [("read", "error", F.col("text").isNull(), "no text"), ("normalize", "warning", F.length("text") < 40, "short text")])


@query("run_summary", """WITH s AS (SELECT source, count(*) FILTER (length(text) >= 40) AS stored, count(*) FILTER (text IS NULL OR length(text) < 40) AS errors FROM documents GROUP BY source)
SELECT sum(stored)::BIGINT AS stored, sum(errors)::BIGINT AS errors, count(*) AS sources, string_agg(source || '=' || stored || '/' || errors, ',' ORDER BY source) AS results FROM s""")
def run_summary(spark, sf):
    per = checked(spark, sf).groupBy("source").agg(F.count_if(F.col("error_stage").isNull()).alias("stored"), F.count_if(F.col("error_stage").isNotNull()).alias("errors"))
    out = G.run_summary(per)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("results")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["stored"], F.lit("/"), e["value"]["errors"])), ",")
    return out.withColumn("results", text)


@query("source_dim", """WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (text IS NULL) > 0 AS bad FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source, CASE WHEN bad THEN 0 ELSE n END AS rule_count, CASE WHEN bad THEN NULL ELSE '2024-12-31' END AS last_sync, CASE WHEN bad THEN 'failed' ELSE 'synced' END AS status, CASE WHEN bad THEN 'no text' END AS error FROM s""")
def source_dim(spark, sf):
    """Sources after a run that fails those with unreadable documents."""
    rows = checked(spark, sf).where("source is not null")
    tried = rows.groupBy("source").agg(F.lit(None).cast("string").alias("commit"), F.max(F.when(F.col("error_stage") == "read", F.col("error_message"))).alias("error"))
    out = G.source_dim(tried.select("source"), rows, F.lit("2024-12-31").cast("timestamp"), tried)
    return out.select("source", "rule_count", F.date_format("last_sync", "yyyy-MM-dd").alias("last_sync"), "status", "error")


@query("job_history", "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25")
def job_history(spark, sf):
    jobs = read(spark, sf, "events").select("event_id", F.col("event_type").alias("source"), "ts")
    return G.job_history(jobs, "error", 25, "ts", "event_id").select("event_id", F.col("source").alias("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("latest_run", "SELECT user_id, event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS completed_at FROM events WHERE event_type = 'purchase' OR event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark, sf):
    jobs = read(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("completed_at"), F.when(F.col("event_type").isin("purchase", "click"), "completed").otherwise("failed").alias("status"))
    return G.latest_run(jobs, "user_id").select("user_id", "id", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@query("repo_overview", "SELECT count(*) AS repos, sum(n)::BIGINT AS rules, count(*) FILTER (n > 50) AS synced FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def repo_overview(spark, sf):
    per = G.source_counts(read(spark, sf, "documents"))
    return per.agg(F.count("*").alias("repos"), F.sum("rule_count").alias("rules"), F.count_if(F.col("rule_count") > 50).alias("synced"))


@query("export_ids", f"WITH {DET} SELECT id, source, title FROM det WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def export_ids(spark, sf):
    rules = detections(spark, sf)
    wanted = read(spark, sf, "labels").where("quality = 0").select("doc_id")
    ids = rules.select("doc_id", "id").join(wanted, "doc_id", "left_semi").select("id")
    return G.export_ids(rules, ids).select("id", "source", "title")


@query("export_json", f"WITH {DET} SELECT id, source, title, array_to_string(mitre_techniques, ',') AS techniques, coalesce(strftime(rule_modified_date, '%Y-%m-%dT%H:%M:%S'), '') AS modified FROM det")
def export_json(spark, sf):
    """Write the export as JSON lines and read it back."""
    path = folder(spark, "json")
    G.write_json(detections(spark, sf), path)
    back = spark.read.schema("id string, source string, title string, mitre_techniques array<string>, rule_modified_date string").json(path)
    return back.select("id", "source", "title", F.array_join("mitre_techniques", ",").alias("techniques"), F.coalesce("rule_modified_date", F.lit("")).alias("modified"))


@query("export_csv", f"WITH {DET} SELECT id, source, title, array_to_string(mitre_techniques, ',') AS mitre_techniques, array_to_string(tags, ',') AS tags, author FROM det")
def export_csv(spark, sf):
    """Write the export as CSV and read it back."""
    path = folder(spark, "csv")
    G.write_csv(detections(spark, sf), path)
    back = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.select("id", "source", "title", "mitre_techniques", "tags", "author")


@query("feed_union", """SELECT 'events' AS feed, event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events UNION ALL SELECT 'orders', o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders""")
def feed_union(spark, sf):
    events = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return G.feed_union({"events": events, "orders": orders}, "at")
