"""Queries through kept tables: versions, posting table, clustered lookups and the technique bridge."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.operators import compare as P
from rulelens.operators import coverage as C
from rulelens.plans.ingest_queries import folder
from rulelens.plans.registry import query
from rulelens.plans.search_queries import ROW
from rulelens.sources.corpus import DET, detections, read
from rulelens.store.bridge import bridge_table, refresh_bridge, tags, with_techniques
from rulelens.store.postings import index_new_files, search_text
from rulelens.store.snapshots import SnapshotTable


def stored(spark, rows, name: str, **layout) -> SnapshotTable:
    """``rows`` as the first version of a new table."""
    table = SnapshotTable(spark, folder(spark, name), **layout)
    table.apply(rows)
    return table


@query("indexed_search", f"WITH {DET} SELECT doc_id, id, source, severity FROM det WHERE contains(lower(detection_logic), 'license') OR contains(lower(title), 'license')")
def indexed_search(spark, sf):
    """The free-text search through the posting table."""
    table = stored(spark, detections(spark, sf).select(*ROW, "title", "detection_logic"), "rules")
    index_new_files(table, ["title", "detection_logic"])
    return search_text(table, "License", ["title", "detection_logic"]).select(*ROW)


@query("indexed_keyword", f"WITH {DET} SELECT source, count(*) AS n FROM det WHERE contains(lower(detection_logic), 'with') GROUP BY source")
def indexed_keyword(spark, sf):
    """The keyword comparison through the posting table."""
    table = stored(spark, detections(spark, sf, False).select("id", "source", "detection_logic"), "rules")
    index_new_files(table, ["detection_logic"])
    return P.per_source(search_text(table, "With", ["detection_logic"]))


def orders_table(spark, sf) -> SnapshotTable:
    orders = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice", "o_orderdate")
    return stored(spark, orders, "orders")


def refreshed_orders(spark, sf) -> SnapshotTable:
    """The orders after a run in which source F came with new prices and source P came empty; the run is done twice."""
    table = orders_table(spark, sf)
    batch = table.read().where("source = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    complete = spark.createDataFrame([("F",), ("P",)], "source string")
    first = table.apply(batch, complete)
    again = table.apply(table.read(version=first).where("source = 'F'"), complete)
    if again is not None:
        raise AssertionError("a replayed batch changed the table")
    return table


@query("snapshot_refresh", "SELECT o_orderstatus AS source, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus")
def snapshot_refresh(spark, sf):
    table = refreshed_orders(spark, sf)
    return table.read().groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("snapshot_changes", "SELECT o_orderstatus AS source, CASE o_orderstatus WHEN 'F' THEN 'change' ELSE 'delete' END AS kind, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND (o_orderstatus = 'P' OR o_totalprice <> 0) GROUP BY ALL")
def snapshot_changes(spark, sf):
    """What the newest version changed."""
    return refreshed_orders(spark, sf).changes().groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("stored_lookup", "SELECT o_orderkey AS id, o_custkey, o_orderstatus AS source FROM orders WHERE o_orderkey = 77")
def stored_lookup(spark, sf):
    return orders_table(spark, sf).where_in("id", [77]).select("id", "o_custkey", "source")


@query("stored_lookup_ids", "SELECT pos, o_orderkey AS id, o_totalprice FROM (VALUES (1, 77), (2, 5), (3, 10000000), (4, 77), (5, 33)) v(pos, k) JOIN orders ON k = o_orderkey")
def stored_lookup_ids(spark, sf):
    """Orders of a list of ids, in its order, repeats kept, unknown ones dropped."""
    wanted = [77, 5, 10_000_000, 77, 33]
    rows = orders_table(spark, sf).where_in("id", sorted(set(wanted)))
    ids = spark.createDataFrame(list(enumerate(wanted, 1)), "pos int, id long")
    return ids.join(rows, "id").select("pos", "id", "o_totalprice").orderBy("pos")


@query("stored_filter_in", f"WITH {DET} SELECT doc_id, id, source, severity FROM det WHERE source IN ('src0', 'src3') AND status IN ('stable', 'unknown') AND severity IN ('high', 'low') AND language IN ('en', 'de')")
def stored_filter_in(spark, sf):
    table = stored(spark, detections(spark, sf).select(*ROW, "status", "language"), "rules")
    rows = table.where_in("source", ["src0", "src3"])
    return rows.where(F.col("status").isin("stable", "unknown") & F.col("severity").isin("high", "low") & F.col("language").isin("en", "de")).select(*ROW)


def bridged(spark, sf) -> SnapshotTable:
    """The bridge of all rules, brought up to date after source src3 was emptied."""
    rules = stored(spark, detections(spark, sf, False).select("source", "id", "mitre_techniques"), "rules")
    refresh_bridge(rules)
    rules.apply(rules.read().limit(0), spark.createDataFrame([("src3",)], "source string"))
    refresh_bridge(rules)
    return bridge_table(rules)


TAGS = f"{DET}, tags AS (SELECT source, id, unnest(mitre_techniques) AS t FROM det WHERE source IS DISTINCT FROM 'src3')"


@query("bridge_filter", f"WITH {TAGS} SELECT DISTINCT source, id FROM tags WHERE t IN ('T1005', 'T1011.002')")
def bridge_filter(spark, sf):
    return with_techniques(bridged(spark, sf), ["t1005", "T1011.002"])


@query("bridge_rollup", f"""WITH {TAGS}, each AS (SELECT source, id, t FROM tags UNION ALL SELECT source, id, split_part(t, '.', 1) FROM tags WHERE contains(t, '.'))
SELECT t AS technique, source, count(*) AS n, count(DISTINCT id) AS rules FROM each GROUP BY ALL""")
def bridge_rollup(spark, sf):
    return C.rollup(tags(bridged(spark, sf)))


@query("bridge_gap", f"WITH {TAGS} SELECT t AS item FROM tags WHERE source = 'src0' EXCEPT SELECT t FROM tags WHERE source = 'src1'")
def bridge_gap(spark, sf):
    items = tags(bridged(spark, sf)).select(F.col("source").alias("grp"), F.col("technique").alias("item"))
    return P.gap(items, "src0", "src1").where("in_base and not in_other").select("item")
