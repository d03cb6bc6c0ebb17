"""Comparison, coverage and trending queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.functions import dims
from rulelens.functions import normalize as N
from rulelens.operators import compare as P
from rulelens.operators import coverage as C
from rulelens.operators import trending as T
from rulelens.plans.registry import query
from rulelens.plans.search_queries import DERIVED, RESOLVE, ROW, score_sql, sql_list, with_tactics
from rulelens.sources.corpus import CAT, DET, catalog, detections, read, remap, spread


@query("compare_technique", f"WITH {DET} SELECT doc_id, id, source, severity FROM det WHERE list_contains(mitre_techniques, 'T1011')")
def compare_technique(spark, sf):
    return P.compare(detections(spark, sf), technique="t1011").select(*ROW)


@query("compare_keyword", f"WITH {DET} SELECT source, count(*) AS n FROM det WHERE contains(lower(detection_logic), 'with') GROUP BY source")
def compare_keyword(spark, sf):
    return P.per_source(P.compare(detections(spark, sf, False), keyword="With"))


@query("compare_platform", f"WITH {DET} SELECT source, count(*) AS n FROM det WHERE {score_sql('lower(detection_logic)', dims.PLATFORMS)} = 'azure' GROUP BY source")
def compare_platform(spark, sf):
    rules = spread(detections(spark, sf, False).select("source", "detection_logic")).select("source", N.platform(F.col("detection_logic")).alias("platform"))
    return P.per_source(P.compare(rules, platform="AZURE"))


def shipped(spark, sf):
    """(grp, item): nation that ships, part shipped."""
    supplier = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return read(spark, sf, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("grp"), F.col("l_partkey").alias("item"))


SHIPPED = "items AS (SELECT DISTINCT s_nationkey AS grp, l_partkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


@query("gap_except", f"WITH {SHIPPED} SELECT item FROM items WHERE grp = 3 EXCEPT SELECT item FROM items WHERE grp = 7")
def gap_except(spark, sf):
    return P.gap(shipped(spark, sf), 3, 7).where("in_base and not in_other").select("item")


@query("gap_intersect", f"WITH {SHIPPED} SELECT item FROM items WHERE grp = 3 INTERSECT SELECT item FROM items WHERE grp = 7")
def gap_intersect(spark, sf):
    return P.gap(shipped(spark, sf), 3, 7).where("in_base and in_other").select("item")


@query("gap_reverse", f"WITH {SHIPPED} SELECT item FROM items WHERE grp = 7 EXCEPT SELECT item FROM items WHERE grp = 3")
def gap_reverse(spark, sf):
    return P.gap(shipped(spark, sf), 3, 7).where("in_other and not in_base").select("item")


@query("gap_summary", f"""WITH {SHIPPED}, a AS (SELECT item FROM items WHERE grp = 3), b AS (SELECT item FROM items WHERE grp = 7)
SELECT (SELECT count(*) FROM a) AS base_n, (SELECT count(*) FROM b) AS other_n, (SELECT count(*) FROM a JOIN b USING (item)) AS overlap""")
def gap_summary(spark, sf):
    return P.gap(shipped(spark, sf), 3, 7).agg(F.count_if("in_base").alias("base_n"), F.count_if("in_other").alias("other_n"), F.count_if(F.col("in_base") & F.col("in_other")).alias("overlap"))


@query("gap_all_pairs", f"""WITH {DET}, items AS (SELECT DISTINCT source AS grp, unnest(mitre_techniques) AS item FROM det), sizes AS (SELECT grp, count(*) AS n FROM items GROUP BY grp),
o AS (SELECT x.grp AS a, y.grp AS b, count(*) AS overlap FROM items x JOIN items y ON x.item = y.item AND x.grp <> y.grp GROUP BY ALL)
SELECT s.grp AS a, t.grp AS b, s.n AS base_n, t.n AS other_n, coalesce(overlap, 0) AS overlap, s.n - coalesce(overlap, 0) AS gap
FROM sizes s JOIN sizes t ON s.grp <> t.grp LEFT JOIN o ON o.a = s.grp AND o.b = t.grp""")
def gap_all_pairs(spark, sf):
    return P.gap_all_pairs(detections(spark, sf, False).select(F.col("source").alias("grp"), F.explode("mitre_techniques").alias("item")))


FIELDS = ["title", "source", "severity", "status", "language", "author", "description", "mitre_techniques", "tags", "log_sources"]
CHOSEN = f"""{DET}, chosen AS (SELECT row_number() OVER (ORDER BY length(detection_logic) DESC, doc_id) AS pos, * FROM det QUALIFY pos <= 4)"""
UNPIVOT = "f AS (SELECT pos, unnest([" + ", ".join(f"{{'field': '{c}', 'value': coalesce({'array_to_string(' + c + chr(44) + ' ' + chr(39) + ', ' + chr(39) + ')' if c in ('mitre_techniques', 'tags', 'log_sources') else c}, '')}}" for c in FIELDS) + "], recursive := true) FROM chosen)"


def chosen_rows(spark, sf):
    """The four longest rules, numbered."""
    rules = detections(spark, sf).withColumn("chars", F.length("detection_logic")).orderBy(F.desc("chars"), "doc_id").limit(4)
    packed = rules.agg(F.array_sort(F.collect_list(F.struct((-F.col("chars")).alias("k"), "doc_id", *FIELDS))).alias("r"))
    return packed.select(F.posexplode("r")).select((F.col("pos") + 1).alias("pos"), "col.*")


@query("side_by_side", f"WITH {CHOSEN}, {UNPIVOT} SELECT field, max(value) FILTER (pos = 1) AS v1, max(value) FILTER (pos = 2) AS v2, max(value) FILTER (pos = 3) AS v3, max(value) FILTER (pos = 4) AS v4 FROM f GROUP BY field")
def side_by_side(spark, sf):
    return P.side_by_side(chosen_rows(spark, sf), FIELDS, 4)


@query("diff_fields", f"WITH {CHOSEN} SELECT field, count(DISTINCT value) > 1 AS differs FROM (SELECT unnest([{', '.join(f"{{'field': '{c}', 'value': coalesce(to_json({c})::VARCHAR, 'null')}}" for c in FIELDS)}], recursive := true) FROM chosen) GROUP BY field")
def diff_fields(spark, sf):
    return P.differing(chosen_rows(spark, sf), FIELDS)


# ---------------------------------------------------------------- coverage


@query("coverage_rollup", f"""WITH {DET}, tags AS (SELECT source, id, unnest(mitre_techniques) AS t FROM det),
each AS (SELECT source, id, t FROM tags UNION ALL SELECT source, id, split_part(t, '.', 1) FROM tags WHERE contains(t, '.'))
SELECT t AS technique, source, count(*) AS n, count(DISTINCT id) AS rules FROM each GROUP BY ALL""")
def coverage_rollup(spark, sf):
    return C.rollup(C.bridge(detections(spark, sf, False)))


@query("catalog_load", f"WITH {CAT} SELECT id, name, array_to_string(list_sort(tactics), ',') AS tactics, revoked, deprecated, is_subtechnique FROM cat")
def catalog_load(spark, sf):
    return catalog(spark, sf).withColumn("tactics", F.array_join(F.array_sort("tactics"), ","))


@query("catalog_stats", f"WITH {CAT} SELECT (SELECT count(DISTINCT t) FROM (SELECT unnest(tactics) AS t FROM cat)) AS tactics, count(*) AS techniques, count(*) FILTER (is_subtechnique) AS subtechniques FROM cat")
def catalog_stats(spark, sf):
    return C.catalog_stats(catalog(spark, sf))


@query("catalog_lookup", f"WITH {DET}, {CAT} SELECT doc_id, t AS technique, coalesce(name, t) AS name FROM (SELECT doc_id, unnest(mitre_techniques) AS t FROM det) LEFT JOIN cat ON cat.id = t")
def catalog_lookup(spark, sf):
    tags = detections(spark, sf, False).select("doc_id", F.explode("mitre_techniques").alias("technique"))
    names = catalog(spark, sf).select(F.col("id").alias("technique"), "name")
    return tags.join(names, "technique", "left").select("doc_id", "technique", F.coalesce("name", "technique").alias("name"))


@query("catalog_valid", f"WITH {CAT} SELECT id, name FROM cat WHERE NOT revoked AND NOT deprecated")
def catalog_valid(spark, sf):
    return C.valid(catalog(spark, sf)).select("id", "name")


@query("suggest", f"WITH {CAT} SELECT id, name FROM cat WHERE NOT deprecated AND (contains(lower(id), 't101') OR contains(lower(name), 't101')) ORDER BY id LIMIT 15")
def suggest(spark, sf):
    return C.suggest(catalog(spark, sf), "T101")


@query("technique_norm", f"""WITH {DET}, x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'attack.' || lower(t) WHEN 1 THEN substr(t, 2) ELSE ' ' || t || ' ' END AS raw FROM (SELECT doc_id, unnest(mitre_techniques) AS t FROM det)),
y AS (SELECT doc_id, raw, regexp_replace(upper(trim(raw)), '^ATTACK\\.', '') AS b FROM x), z AS (SELECT *, CASE WHEN regexp_matches(b, '^[0-9]') THEN 'T' || b ELSE b END AS technique FROM y)
SELECT doc_id, raw, technique, split_part(technique, '.', 1) AS parent, contains(technique, '.') AS is_sub FROM z""")
def technique_norm(spark, sf):
    t = detections(spark, sf, False).select("doc_id", F.explode("mitre_techniques").alias("t"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("attack."), F.lower("t"))).when(F.col("doc_id") % 3 == 1, F.substring("t", 2, 99)).otherwise(F.concat(F.lit(" "), "t", F.lit(" ")))
    out = t.select("doc_id", raw.alias("raw")).withColumn("technique", N.technique_norm(F.col("raw")))
    return out.withColumns({"parent": N.parent_of(F.col("technique")), "is_sub": N.is_sub(F.col("technique"))})


@query("technique_resolve", f"WITH {DET}, {RESOLVE} SELECT doc_id, det_t.technique, mapped FROM (SELECT doc_id, unnest(mitre_techniques) AS technique FROM det) det_t LEFT JOIN resolve USING (technique)")
def technique_resolve(spark, sf):
    tags = detections(spark, sf, False).select("doc_id", F.explode("mitre_techniques").alias("technique"))
    return C.resolved(tags, C.resolve_table(catalog(spark, sf), remap(spark))).select("doc_id", "technique", "mapped")


@query("unmapped", f"WITH {DET}, {RESOLVE} SELECT DISTINCT technique FROM (SELECT unnest(mitre_techniques) AS technique FROM det) WHERE technique NOT IN (SELECT technique FROM resolve)")
def unmapped(spark, sf):
    return C.unmapped(C.bridge(detections(spark, sf, False)), C.resolve_table(catalog(spark, sf), remap(spark)))


@query("derive_tactics", f"WITH {DET}, {DERIVED} SELECT id, array_to_string(tactics, ',') AS tactics FROM tac")
def derive_tactics(spark, sf):
    return with_tactics(spark, sf).select("id", F.array_join("tactics", ",").alias("tactics"))


PARENTS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in dims.PARENT_TACTIC.items()) + ") p(technique, tactic)"


@query("infer_parent", f"""WITH x AS (SELECT l_orderkey AS id, 'T' || (1000 + l_partkey % 600) AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'T' || (1000 + l_partkey % 600)) AS k FROM lineitem),
y AS (SELECT id, p.tactic, min(k) AS k FROM x JOIN {PARENTS} ON x.t = p.technique GROUP BY ALL)
SELECT id, string_agg(tactic, ',' ORDER BY k) AS tactics FROM y GROUP BY id""")
def infer_parent(spark, sf):
    """Tactics inferred from made-up technique ids of an order's lines, in line order."""
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("T"), 1000 + F.col("l_partkey") % 600, F.lit(".001")).alias("t")))).alias("x"))
    out = lines.select("id", N.infer_tactics(F.transform("x", lambda s: s["t"])).alias("tactics"))
    return out.where(F.size("tactics") > 0).select("id", F.array_join("tactics", ",").alias("tactics"))


#: Long form: one row per tactic, valid technique and source of the table, zero-filled.
GRID = f"""{DET}, {RESOLVE}, m AS (SELECT source, mapped AS t FROM (SELECT source, unnest(mitre_techniques) AS technique FROM det) JOIN resolve USING (technique)),
each AS (SELECT source, t, count(*) AS n FROM (SELECT source, t FROM m UNION ALL SELECT source, split_part(t, '.', 1) FROM m WHERE contains(t, '.')) GROUP BY ALL),
cells AS (SELECT id AS technique, name, is_subtechnique, unnest(tactics) AS tactic FROM cat WHERE NOT revoked AND NOT deprecated),
grid AS (SELECT list_position({sql_list([r[0] for r in dims.TACTICS])}, tactic) - 1 AS ord, tactic, c.technique, name, is_subtechnique, s.source, coalesce(n, 0) AS n
  FROM cells c CROSS JOIN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s LEFT JOIN each ON each.t = c.technique AND each.source = s.source)"""


def counted(spark, sf):
    """The roll-up over resolved techniques, the catalog, and the sources of the table."""
    cat, rules = catalog(spark, sf), detections(spark, sf, False)
    tags = C.resolved(C.bridge(rules), C.resolve_table(cat, remap(spark)))
    return C.rollup(tags, "mapped"), cat, rules.select("source")


@query("coverage_matrix", f"WITH {GRID} SELECT *, (sum(n) OVER w)::BIGINT AS total, (count_if(n > 0) OVER w)::INT AS n_sources FROM grid WINDOW w AS (PARTITION BY tactic, technique)")
def coverage_matrix(spark, sf):
    return C.long_matrix(*counted(spark, sf))


@query("coverage_gaps_view", f"WITH {GRID} SELECT tactic, technique FROM grid GROUP BY ALL HAVING sum(CASE WHEN source IN ('src3', 'src4') THEN n ELSE 0 END) = 0")
def coverage_gaps_view(spark, sf):
    """Cells that src3 and src4 leave open."""
    counts, cat, _ = counted(spark, sf)
    return C.gaps_view(C.cell_totals(counts, cat, ["src3", "src4"]), covered=False).select("tactic", "technique")


@query("tactic_percent", f"WITH {GRID}, one AS (SELECT tactic, technique, sum(CASE WHEN source = 'src3' THEN n ELSE 0 END) AS k FROM grid GROUP BY ALL) SELECT tactic, count(*) FILTER (k > 0) AS covered, count(*) AS techniques, round(100 * avg((k > 0)::INT), 0) AS percent FROM one GROUP BY tactic")
def tactic_percent(spark, sf):
    """Share of each tactic's techniques that src3 covers."""
    counts, cat, _ = counted(spark, sf)
    return C.tactic_percent(C.cell_totals(counts, cat, ["src3"]))


@query("coverage_summary", f"""WITH {GRID}, one AS (SELECT technique, source, max(n) AS n FROM grid GROUP BY ALL), e AS (SELECT * FROM one UNION ALL SELECT technique, 'any', sum(n) FROM one GROUP BY technique)
SELECT source, count(*) FILTER (n > 0) AS covered, count(*) AS techniques, round(100.0::DOUBLE * count(*) FILTER (n > 0) / count(*), 1) AS percent FROM e GROUP BY source""")
def coverage_summary(spark, sf):
    return C.long_summary(*counted(spark, sf)).drop("level")


@query("coverage_summary_compat", f"""WITH {GRID}, e AS (SELECT technique, source, n FROM grid UNION ALL SELECT technique, 'any', sum(n) FROM grid GROUP BY tactic, technique)
SELECT source, count(DISTINCT technique) FILTER (n > 0) AS covered, count(*) AS techniques, round(100.0::DOUBLE * count(DISTINCT technique) FILTER (n > 0) / count(*), 1) AS percent FROM e GROUP BY source""")
def coverage_summary_compat(spark, sf):
    """As the summary, but a technique counts once per tactic in the total."""
    return C.long_summary(*counted(spark, sf), compat=True).drop("level")


@query("coverage_star", """SELECT p_type, n_name, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def coverage_star(spark, sf):
    """The coverage count at scale: part type by supplier nation."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    star = lines.join(read(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    star = star.join(read(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return star.groupBy("p_type", "n_name").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


# ---------------------------------------------------------------- trending

AS_OF = "TIMESTAMP '2024-12-31'"


def as_of():
    return F.lit("2024-12-31").cast("timestamp")


def iso(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("last")


RECENT = f"""{DET}, recent AS (SELECT * FROM det WHERE rule_modified_date >= {AS_OF} - INTERVAL 90 DAY)"""


@query("trending_techniques", f"""WITH {RECENT}, t AS (SELECT unnest(mitre_techniques) AS technique, source, rule_modified_date FROM recent)
SELECT technique, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, strftime(max(rule_modified_date), '%Y-%m-%d %H:%M:%S') AS last FROM t GROUP BY technique ORDER BY n DESC, technique LIMIT 20""")
def trending_techniques(spark, sf):
    return T.techniques(detections(spark, sf, False), as_of(), 90).select("technique", "n", "sources", iso("last"))


@query("trending_platforms", f"""WITH {RECENT}, t AS (SELECT {score_sql('lower(detection_logic)', dims.PLATFORMS)} AS platform, source, rule_modified_date FROM recent)
SELECT platform, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, strftime(max(rule_modified_date), '%Y-%m-%d %H:%M:%S') AS last FROM t WHERE platform <> '' GROUP BY platform ORDER BY n DESC, platform LIMIT 20""")
def trending_platforms(spark, sf):
    rules = spread(detections(spark, sf, False).select("source", "rule_modified_date", "detection_logic")).select("source", "rule_modified_date", N.platform(F.col("detection_logic")).alias("platform"))
    return T.platforms(rules, as_of(), 90).select("platform", "n", "sources", iso("last"))


@query("trending_summary", f"WITH {RECENT} SELECT source, count(*) AS n FROM recent GROUP BY source UNION ALL SELECT 'total', count(*) FROM recent")
def trending_summary(spark, sf):
    return T.summary(detections(spark, sf, False), as_of(), 90)


@query("trending_window", """WITH w AS (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS ws, * FROM events)
SELECT strftime(ws, '%Y-%m-%d') AS window_start, event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT user_id) AS users FROM w GROUP BY ws, event_type""")
def trending_window(spark, sf):
    out = T.windowed(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", iso("last"), "users")


@query("age_bucket", f"""WITH {DET}, d AS (SELECT doc_id, date_diff('day', rule_modified_date, {AS_OF}) AS d FROM det)
SELECT doc_id, CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN d || 'd' WHEN d < 30 THEN (d // 7) || 'w' WHEN d < 365 THEN (d // 30) || 'mo' WHEN d >= 365 THEN (d // 365) || 'y' END AS age FROM d""")
def age_bucket(spark, sf):
    return detections(spark, sf, False).select("doc_id", N.age_bucket(F.col("rule_modified_date"), as_of()).alias("age"))
