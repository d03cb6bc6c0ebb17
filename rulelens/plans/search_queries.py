"""Search, facet and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.functions import dims
from rulelens.functions import normalize as N
from rulelens.operators import coverage as C
from rulelens.operators import search as S
from rulelens.plans.registry import query
from rulelens.sources.corpus import CAT, DET, REMAP_SQL, catalog, detections, read, remap, spread

ROW = ["doc_id", "id", "source", "severity"]


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def score_sql(text: str, taxonomy: tuple) -> str:
    """DuckDB expression of the keyword score."""
    rows = [f"{{'n': len(list_filter({sql_list(words)}, lambda w: contains({text}, w))), 'o': -{k}, 'id': '{i}'}}" for k, (i, words) in enumerate(dims.keywords(taxonomy))]
    return f"(SELECT CASE WHEN b.n > 0 THEN b.id ELSE '' END FROM (SELECT list_sort([{', '.join(rows)}], 'DESC')[1] AS b))"


@query("search_text", f"WITH {DET} SELECT doc_id, id, source, severity FROM det WHERE contains(lower(detection_logic), 'license') OR contains(lower(title), 'license')")
def search_text(spark, sf):
    return S.search(detections(spark, sf), S.SearchSpec(text="License", text_columns=("title", "detection_logic"))).select(*ROW)


@query("filter_in", f"WITH {DET} SELECT doc_id, id, source, severity FROM det WHERE source IN ('src0', 'src3') AND status IN ('stable', 'unknown') AND severity IN ('high', 'low') AND language IN ('en', 'de')")
def filter_in(spark, sf):
    return S.search(detections(spark, sf), S.SearchSpec(sources=["src0", "src3"], statuses=["stable", "unknown"], severities=["high", "low"], languages=["en", "de"])).select(*ROW)


@query("filter_technique", f"WITH {DET} SELECT doc_id, id, source, severity FROM det WHERE len(list_intersect(mitre_techniques, ['T1005', 'T1011.002'])) > 0")
def filter_technique(spark, sf):
    return S.search(detections(spark, sf), S.SearchSpec(techniques=["t1005", "T1011.002"])).select(*ROW)


@query("filter_tag", f"WITH {DET} SELECT doc_id, id, source, severity FROM det WHERE len(list_intersect(tags, ['fr', 'q0'])) > 0")
def filter_tag(spark, sf):
    return S.search(detections(spark, sf), S.SearchSpec(tags=["FR", "q0"])).select(*ROW)


@query("filter_contains_any", f"WITH {DET} SELECT doc_id, id, source, severity FROM det WHERE len(list_filter(log_sources, lambda x: contains(x, 'de_') OR contains(x, 'src1'))) > 0")
def filter_contains_any(spark, sf):
    return S.search(detections(spark, sf), S.SearchSpec(log_sources=["DE_", "src1"])).select(*ROW)


RESOLVE = f"""{CAT}, {REMAP_SQL}, resolve AS (
  SELECT id AS technique, id AS mapped FROM cat WHERE NOT revoked AND NOT deprecated
  UNION ALL SELECT o.id, coalesce(r.new_id, o.id) FROM cat o LEFT JOIN (SELECT old_id, new_id FROM remap JOIN cat ON new_id = cat.id AND NOT revoked AND NOT deprecated) r ON r.old_id = o.id WHERE o.revoked OR o.deprecated
)"""
DERIVED = f"""{RESOLVE}, tags AS (SELECT doc_id, id, source, unnest(mitre_techniques) AS technique FROM det),
own AS (SELECT tags.id, coalesce(mapped, tags.technique) AS t FROM tags LEFT JOIN resolve USING (technique)),
tac AS (SELECT own.id, list_sort(list(DISTINCT u.tactic)) AS tactics FROM own, (SELECT id AS tid, unnest(tactics) AS tactic FROM cat) u
        WHERE u.tid = own.t OR u.tid = split_part(own.t, '.', 1) GROUP BY own.id)"""


def with_tactics(spark, sf):
    cat = catalog(spark, sf)
    return C.derive_tactics(C.bridge(detections(spark, sf, False)), C.resolve_table(cat, remap(spark)), cat)


@query("filter_tactic", f"WITH {DET}, {DERIVED} SELECT doc_id, det.id, source, severity FROM det JOIN tac ON det.id = tac.id WHERE list_contains(tactics, 'TA0002')")
def filter_tactic(spark, sf):
    joined = detections(spark, sf).select(*ROW).join(with_tactics(spark, sf).withColumnRenamed("tactics", "mitre_tactics"), "id")
    return S.search(joined, S.SearchSpec(tactics=["ta0002"])).select(*ROW)


@query("search_sorted", "SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS pos FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY pos LIMIT 100")
def search_sorted(spark, sf):
    """The 100 dearest orders with their place (a top-k report)."""
    rows = read(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100)
    top = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("k"), "o_orderkey", "o_orderstatus", "o_totalprice"))).alias("r"))
    return top.select(F.posexplode("r")).select("col.o_orderkey", "col.o_orderstatus", "col.o_totalprice", (F.col("pos") + 1).cast("long").alias("pos"))


@query("search_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def search_page(spark, sf):
    rows = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return S.page(rows, [F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")], 100, 50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("search_count", f"WITH {DET} SELECT count(*) AS n FROM det WHERE severity = 'low' AND contains(lower(detection_logic), 'the')")
def search_count(spark, sf):
    return S.search(detections(spark, sf), S.SearchSpec(text="the", severities=["low"], text_columns=("detection_logic",))).agg(F.count("*").alias("n"))


@query("lookup_id", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def lookup_id(spark, sf):
    return S.lookup(read(spark, sf, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("lookup_ids", "SELECT pos, o_orderkey, o_totalprice FROM (SELECT row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos, l_orderkey AS o_orderkey FROM lineitem ORDER BY pos LIMIT 25) ids JOIN orders USING (o_orderkey)")
def lookup_ids(spark, sf):
    """Orders of the 25 dearest lines, in that order, repeats kept."""
    best = read(spark, sf, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)
    packed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("k"), "l_orderkey", "l_linenumber"))).alias("r"))
    ids = packed.select(F.posexplode("r")).select((F.col("pos") + 1).cast("long").alias("pos"), F.col("col.l_orderkey").alias("o_orderkey"))
    return S.lookup_ordered(ids, read(spark, sf, "orders"), "o_orderkey").select("pos", "o_orderkey", "o_totalprice")


@query("list_view", f"WITH {DET} SELECT id, source, source_file, title, status, severity, language, array_to_string(tags, ',') AS tags, length(detection_logic) AS logic_chars FROM det")
def list_view(spark, sf):
    rows = S.list_view(detections(spark, sf))
    return rows.select("id", "source", "source_file", "title", "status", "severity", "language", F.array_join("tags", ",").alias("tags"), F.length("detection_logic").cast("long").alias("logic_chars"))


@query("facets", f"""WITH {DET} SELECT facet, value, count(*) AS n FROM (
  SELECT unnest([{{'facet': 'source', 'value': source}}, {{'facet': 'status', 'value': status}}, {{'facet': 'severity', 'value': severity}}, {{'facet': 'language', 'value': language}}], recursive := true) FROM det
) WHERE value <> '' GROUP BY ALL""")  # fmt: skip
def facets(spark, sf):
    return S.facets(detections(spark, sf))


DOMAINS = {"status": ["stable", "experimental", "deprecated", "unknown"], "severity": ["low", "medium", "high", "critical", "unknown"]}


@query("statistics", f"""WITH {DET}, dom AS (
  SELECT DISTINCT 'source' AS facet, source AS value FROM documents WHERE source <> '' UNION ALL SELECT 'status', unnest({sql_list(DOMAINS['status'])}) UNION ALL SELECT 'severity', unnest({sql_list(DOMAINS['severity'])})
), f AS (SELECT 'source' AS facet, source AS value FROM det UNION ALL SELECT 'status', status FROM det UNION ALL SELECT 'severity', severity FROM det),
t AS (SELECT dom.facet, dom.value, count(f.value) AS n FROM dom LEFT JOIN f ON dom.facet = f.facet AND dom.value = f.value GROUP BY ALL)
SELECT * FROM t UNION ALL SELECT 'total', 'all', count(*) FROM documents""")  # fmt: skip
def statistics(spark, sf):
    return S.statistics(detections(spark, sf), DOMAINS)


@query("severity_pivot", f"WITH {DET} SELECT source, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'unknown') AS unknown FROM det GROUP BY source")
def severity_pivot(spark, sf):
    return S.severity_pivot(detections(spark, sf))


@query("platform_dist", f"WITH {DET} SELECT coalesce(nullif(p, ''), 'unknown') AS platform, count(*) AS n FROM (SELECT {score_sql('lower(detection_logic)', dims.PLATFORMS)} AS p FROM det) GROUP BY 1")
def platform_dist(spark, sf):
    p = spread(detections(spark, sf, False).select("detection_logic")).select(N.platform(F.col("detection_logic")).alias("p"))
    return p.groupBy(F.coalesce(F.nullif("p", F.lit("")), F.lit("unknown")).alias("platform")).agg(F.count("*").alias("n"))


@query("source_counts", "SELECT source, count(*) AS rule_count FROM documents GROUP BY source")
def source_counts(spark, sf):
    from rulelens.operators.ingest import source_counts as counts

    return counts(detections(spark, sf, False))


@query("dim_lookup", f"""WITH {DET}, plat AS (SELECT * FROM (VALUES {', '.join(f"('{r[0]}', '{r[1]}', '{r[2]}')" for r in dims.PLATFORMS)}) v(id, display_name, category)),
c AS (SELECT {score_sql('lower(detection_logic)', dims.PLATFORMS)} AS p FROM det)
SELECT p AS platform, coalesce(display_name, 'Unknown') AS display_name, coalesce(category, '') AS category, count(*) AS n FROM c LEFT JOIN plat ON plat.id = p GROUP BY ALL""")  # fmt: skip
def dim_lookup(spark, sf):
    used = spread(detections(spark, sf, False).select("detection_logic")).select(N.platform(F.col("detection_logic")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    out = used.join(F.broadcast(dims.platforms(spark)), "id", "left")
    return out.select(F.col("id").alias("platform"), F.coalesce("display_name", F.lit("Unknown")).alias("display_name"), F.coalesce("category", F.lit("")).alias("category"), "n")
