"""Normalization queries: each applies a Column function to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulelens.functions import dims
from rulelens.functions import normalize as N
from rulelens.plans.registry import query
from rulelens.plans.search_queries import score_sql, sql_list
from rulelens.sources.corpus import DET, detections, read, spread


def pick(values: list, by: str):
    """Element of a list of raw values chosen by a key, which gives dirty vocabularies."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(by) % len(values) + 1).cast("int"))


def pick_sql(values: list, by: str) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][{by} % {len(values)} + 1]"


STATUSES = ["stable", "Production", "released", "TEST", "dev", "obsolete", "retired", "draft", None, ""]
SEVERITIES = ["info", "Low", "moderate", "MEDIUM", "High", "severe", "critical", "none", None, ""]
TYPES = ["eql", "ESQL", "machine_learning", "threat_match", "query", "threshold", "new_terms", "other", None]
DECLARED = ["kuery", "lucene", "eql", None]


def case_sql(table: dict, c: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({c}) IN ({', '.join(repr(r) for r in raw)}) THEN '{v}'" for v, raw in table.items()) + " ELSE 'unknown' END"


@query("det_id", f"WITH {DET} SELECT doc_id, id FROM det")
def det_id(spark, sf):
    return detections(spark, sf).select("doc_id", "id")


@query("norm_status", f"SELECT o_orderkey, {case_sql(N.STATUS, pick_sql(STATUSES, 'o_orderkey'))} AS status FROM orders")
def norm_status(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", N.norm_status(pick(STATUSES, "o_orderkey")).alias("status"))


@query("norm_severity", f"SELECT o_orderkey, {case_sql(N.SEVERITY, pick_sql(SEVERITIES, 'o_orderkey'))} AS severity FROM orders")
def norm_severity(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", N.norm_severity(pick(SEVERITIES, "o_orderkey")).alias("severity"))


@query("detect_language", f"""SELECT o_orderkey, CASE WHEN t IN ('eql', 'esql') THEN t WHEN t = 'machine_learning' THEN 'ml' WHEN t = 'threat_match' THEN t
WHEN t IN ('query', 'threshold', 'new_terms') THEN CASE WHEN d IN ('lucene', 'eql') THEN d ELSE 'kql' END ELSE 'unknown' END AS language
FROM (SELECT o_orderkey, lower({pick_sql(TYPES, 'o_orderkey')}) AS t, {pick_sql(DECLARED, 'o_custkey')} AS d FROM orders)""")
def detect_language(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", N.detect_language(pick(TYPES, "o_orderkey"), pick(DECLARED, "o_custkey")).alias("language"))


@query("ordered_distinct", """SELECT p_partkey, array_to_string(list_filter([lower(p_brand), CASE WHEN lower(p_type) <> lower(p_brand) THEN lower(p_type) END, CASE WHEN p_size % 3 = 0 THEN lower(p_name) END], lambda x: x IS NOT NULL), ',') AS log_sources FROM part""")
def ordered_distinct(spark, sf):
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.lit(""))
    return read(spark, sf, "part").select("p_partkey", F.array_join(N.ordered_distinct(F.col("p_brand"), F.col("p_type"), F.col("p_brand"), name), ",").alias("log_sources"))


LAYOUTS = ["%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.250", "%Y-%m-%dT%H:%M:%S.250000Z", "%Y-%m-%d %H:%M:%S"]
JAVA = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'.250'", "yyyy-MM-dd'T'HH:mm:ss'.250000Z'", "yyyy-MM-dd HH:mm:ss"]


@query("parse_dates", f"""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || CASE WHEN o_orderkey % 10 IN (5, 6) THEN '.250' ELSE '.000' END END AS parsed FROM orders""")
def parse_dates(spark, sf):
    raw = F.when(F.col("o_orderkey") % 10 == 8, "soon")
    for k, layout in enumerate(JAVA):
        raw = raw.when(F.col("o_orderkey") % 10 == k, F.concat(F.lit(" "), F.date_format("o_orderdate", layout)))
    return read(spark, sf, "orders").select("o_orderkey", F.date_format(N.parse_date(raw), "yyyy-MM-dd HH:mm:ss.SSS").alias("parsed"))


@query("rule_url", r"""SELECT page_id, 'https://example.org/rules/blob/master/' || regexp_replace(replace(p, '\', '/'), '^/', '') AS url
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(x, '/', '\') WHEN 1 THEN x ELSE substr(x, 2) END AS p FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS x FROM pages))""")
def rule_url(spark, sf):
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    dirty = F.when(F.col("page_id") % 3 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).when(F.col("page_id") % 3 == 1, path).otherwise(F.substring(path, 2, 1 << 20))
    return read(spark, sf, "pages").select("page_id", N.rule_url(F.lit("https://example.org/rules.git"), dirty, "master").alias("url"))


@query("clean_list", "SELECT doc_id, len(l) AS n, array_to_string(l, '|') AS items FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)")
def clean_list(spark, sf):
    lines = N.clean_list(F.split("text", "\n"))
    return read(spark, sf, "documents").select("doc_id", lines.alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("items"))


NAMES = ["sysmon", "Security_Log", "my dns server", "linux", "custom_thing", "click", ""]
LABELS = ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in dims.DATA_SOURCE_LABELS.items())


@query("label_map", f"""WITH x AS (SELECT event_id, coalesce({pick_sql(NAMES, 'event_id')}, '') AS a, event_type AS b FROM events), l AS (SELECT [{LABELS}] AS l)
SELECT event_id, array_to_string(CASE WHEN fa = '' THEN [fb] WHEN fa = fb THEN [fa] ELSE [fa, fb] END, ',') AS labels FROM (
  SELECT event_id, CASE WHEN a = '' THEN '' ELSE coalesce(list_filter(l, lambda p: p.k = lower(a))[1].v, list_filter(l, lambda p: contains(lower(a), p.k))[1].v, upper(left(replace(a, '_', ' '), 1)) || CASE a WHEN 'custom_thing' THEN 'ustom Thing' ELSE substr(a, 2) END) END AS fa,
    coalesce(list_filter(l, lambda p: p.k = lower(b))[1].v, list_filter(l, lambda p: contains(lower(b), p.k))[1].v, upper(left(b, 1)) || substr(b, 2)) AS fb FROM x, l)""")
def label_map(spark, sf):
    return read(spark, sf, "events").select("event_id", F.array_join(N.label_map(F.array(pick(NAMES, "event_id"), F.col("event_type"))), ",").alias("labels"))


@query("classify_score", f"SELECT page_id, {score_sql('lower(html)', dims.PLATFORMS)} AS platform FROM pages")
def classify_score(spark, sf):
    return spread(read(spark, sf, "pages").select("page_id", "html")).select("page_id", N.platform(F.col("html")).alias("platform"))


@query("classify_category", f"SELECT page_id, {score_sql('lower(html)', dims.EVENT_CATEGORIES)} AS event_category FROM pages")
def classify_category(spark, sf):
    return spread(read(spark, sf, "pages").select("page_id", "html")).select("page_id", N.event_category(F.col("html")).alias("event_category"))


FIRST = ["bolt", "ring", "red", "widget"]


@query("first_keyword", f"SELECT p_partkey, coalesce(list_filter({sql_list(FIRST)}, lambda w: contains(lower(p_name), w))[1], '') AS word FROM part")
def first_keyword(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.coalesce(N.first_contained(F.lower("p_name"), FIRST), F.lit("")).alias("word"))


TOPICS = {"legal": ["license", "licensed", "rights", "reserved", "apache", "mit", "gnu"], "english": ["the", "of", "with"], "french": ["le", "les"], "german": ["der", "die"]}
TOPIC_ROWS = [(t, w) for t, ws in TOPICS.items() for w in ws]


@query("keyword_hits", f"""WITH k AS (SELECT * FROM (VALUES {', '.join(map(str, TOPIC_ROWS))}) v(topic, keyword)),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS keyword FROM documents)
SELECT topic, keyword, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w JOIN k USING (keyword) GROUP BY ALL""")
def keyword_hits(spark, sf):
    """Token mode: explode the tokens and join the keywords, for keyword lists too long for an expression."""
    words = spark.createDataFrame(TOPIC_ROWS, "topic string, keyword string")
    tokens = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_-]+"), F.lit(0))).alias("keyword"))
    per_doc = tokens.join(F.broadcast(words), "keyword").groupBy("topic", "keyword", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("topic", "keyword").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


SEARCH_SQL = ", ".join(f"CASE WHEN {' OR '.join('(' + ' AND '.join(f'contains(t, {w!r})' for w in g) + ')' for g in groups)} THEN '{dims.DATA_SOURCE_LABELS[name]}' END" for name, groups in N.SEARCH_SOURCES)


@query("infer_sources", f"SELECT page_id, array_to_string(list_filter([{SEARCH_SQL}], lambda x: x IS NOT NULL), ',') AS data_sources FROM (SELECT page_id, lower(html) AS t FROM pages)")
def infer_sources(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(N.infer_sources(F.col("html")), ",").alias("data_sources"))


@query("norm_tags", "SELECT p_partkey, replace(lower('brand:' || p_brand), ' ', '_') || ',' || replace(lower(p_name), ' ', '_') AS tags, replace(lower(p_brand), ' ', '_') || ',' || replace(lower(p_name), ' ', '_') AS bare FROM part")
def norm_tags(spark, sf):
    tags = F.array(F.concat(F.lit("brand:"), "p_brand"), F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(N.norm_tags(tags), ",").alias("tags"), F.array_join(N.norm_tags(tags, drop_prefix=True), ",").alias("bare"))


@query("score_bucket", """WITH x AS (SELECT l_orderkey, max(CASE WHEN l_linenumber > 1 THEN l_quantity * 2 END) AS top, avg(l_discount * 1000) AS mean FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(CASE WHEN top >= 80 THEN 'critical' WHEN top >= 60 THEN 'high' WHEN top >= 40 THEN 'medium' WHEN top > 0 THEN 'low' END,
  CASE WHEN mean >= 80 THEN 'critical' WHEN mean >= 60 THEN 'high' WHEN mean >= 40 THEN 'medium' WHEN mean > 0 THEN 'low' END, 'unknown') AS severity FROM x""")
def score_bucket(spark, sf):
    x = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") > 1, F.col("l_quantity") * 2)).alias("top"), F.avg(F.col("l_discount") * 1000).alias("mean"))
    return x.select("l_orderkey", N.score_bucket(F.col("top"), F.col("mean")).alias("severity"))


SHORT = [r[2] for r in dims.TACTICS]


@query("extract_tags", f"""SELECT doc_id, array_to_string(mitre_techniques, ',') AS techniques, {sql_list([r[0] for r in dims.TACTICS])}[doc_id % 14 + 1] AS tactics, source AS other FROM ({'WITH ' + DET + ' SELECT * FROM det'})""")
def extract_tags(spark, sf):
    tactic = F.element_at(N.lits(SHORT), (F.col("doc_id") % 14 + 1).cast("int"))
    tags = F.concat(F.transform("mitre_techniques", lambda t: F.concat(F.lit("attack."), F.lower(t))), F.array(F.concat(F.lit("Attack."), tactic), F.lit("attack.s0002"), F.lit("attack.g0016"), F.col("source")))
    technique, tactics, other = N.attack_tags(F.col("t"))
    return detections(spark, sf).select("doc_id", tags.alias("t")).select("doc_id", F.array_join(technique, ",").alias("techniques"), F.array_join(tactics, ",").alias("tactics"), F.array_join(other, ",").alias("other"))


@query("extract_ids", f"""WITH {DET} SELECT doc_id, array_to_string(mitre_techniques, ',') AS techniques, {sql_list([r[0] for r in dims.TACTICS])}[doc_id % 14 + 1] AS tactics FROM det""")
def extract_ids(spark, sf):
    ids = F.concat(F.transform("mitre_techniques", lambda t: F.concat(F.lit(" "), F.lower(t))), F.array(F.lit("T12"), F.col("source")))
    name = F.element_at(N.lits([r[1] for r in dims.TACTICS]), (F.col("doc_id") % 14 + 1).cast("int"))
    return detections(spark, sf).select("doc_id", F.array_join(N.technique_ids(ids), ",").alias("techniques"), F.array_join(N.tactic_ids(F.array(F.replace(name, F.lit(" "), F.lit("")), name, F.lit("none"))), ",").alias("tactics"))


@query("nested_flatten", "SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY k, l_partkey) AS parts FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS k FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def nested_flatten(spark, sf):
    """Ids of nested lines, flattened in order without repeats."""
    nested = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array("l_partkey").alias("parts")))).alias("lines"))
    flat = F.array_distinct(F.flatten(F.transform("lines", lambda x: x["parts"])))
    return nested.select("l_orderkey", F.array_join(flat, ",").alias("parts"))


@query("sanitize", r"SELECT conv_id, turn, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS text FROM conversations")
def sanitize(spark, sf):
    dirty = F.concat(F.lit("\x07"), "text", F.lit("\x7f\x1b"))
    return read(spark, sf, "conversations").select("conv_id", "turn", N.sanitize(dirty).alias("text"))


@query("line_repair", r"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: 'key: ''*' || replace(l, '''', '''''') || ''''), chr(10)) AS text FROM documents""")
def line_repair(spark, sf):
    keyed = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit("key: *"), line)), "\n")
    return read(spark, sf, "documents").select("doc_id", N.repair_lines(keyed).alias("text"))
