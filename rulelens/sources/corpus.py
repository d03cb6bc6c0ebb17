"""The uniform detections view over documents, and the technique catalog derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import dims
from rulelens.functions import normalize as N


SPREAD_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for heavy work on the texts of a table that is small and of fewer files than cores.

    One task reads a row group whole, so such a table would be worked on by a few tasks. Others stay as they are: what is
    dealt out anew is at most SPREAD_BYTES a core, whatever the cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df


def detections(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """One detection per document. Columns that a query does not use are pruned, the texts included.

    ``labelled`` joins the labels, which status, severity and tags need; a doc_id that they repeat takes the largest.
    Without it those three columns are missing and nothing is shuffled.
    """
    d = read(spark, sf_dir, "documents")
    if labelled:
        lab = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        d = d.join(lab, "doc_id", "left")
        graded = (
            F.when(F.col("quality") == 1, "stable").when(F.col("quality") == 0, "experimental").otherwise("unknown").alias("status"),
            F.when(F.col("toxic") == 1, "critical").when(F.col("n_chars") >= 8000, "high").when(F.col("n_chars") >= 2000, "medium").otherwise("low").alias("severity"),
            F.array_compact(F.array("lang", "source", F.concat(F.lit("q"), F.col("quality").cast("string")))).alias("tags"),
        )
    else:
        graded = ()
    n = F.col("doc_id") * 7 + F.col("n_chars")
    technique = F.concat(F.lit("T"), (1000 + n % 40).cast("string"))
    sub = F.concat(technique, F.lit(".00"), (1 + F.col("doc_id") % 3).cast("string"))
    path = F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt"))
    return d.select(
        "doc_id",
        N.det_id(F.col("source"), path).alias("id"),
        "source",
        path.alias("source_file"),
        F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(80)).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.concat(F.lit("author_"), F.col("doc_id") % 7).alias("author"),
        *graded,
        F.array("source", F.concat("lang", F.lit("_text"))).alias("log_sources"),
        F.when(F.col("doc_id") % 4 == 0, F.array(technique)).otherwise(F.array(technique, sub)).alias("mitre_techniques"),
        F.col("text").alias("detection_logic"),
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 11 != 0, F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 365) * 86400)).alias("rule_modified_date"),
        F.col("text").alias("raw_content"),
    )


#: The same view for DuckDB.
DET = """det AS (
  SELECT d.doc_id,
    substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id,
    source, 'docs/' || d.doc_id || '.txt' AS source_file, left(split_part(text, chr(10), 1), 80) AS title,
    NULL::VARCHAR AS description, 'author_' || (d.doc_id % 7) AS author,
    CASE quality WHEN 1 THEN 'stable' WHEN 0 THEN 'experimental' ELSE 'unknown' END AS status,
    CASE WHEN toxic = 1 THEN 'critical' WHEN n_chars >= 8000 THEN 'high' WHEN n_chars >= 2000 THEN 'medium' ELSE 'low' END AS severity,
    [source, lang || '_text'] AS log_sources,
    CASE WHEN d.doc_id % 4 = 0 THEN [t] ELSE [t, t || '.00' || (1 + d.doc_id % 3)] END AS mitre_techniques,
    list_filter([lang, source, 'q' || quality], lambda x: x IS NOT NULL) AS tags,
    text AS detection_logic, lang AS language,
    CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((d.doc_id % 365)::INT) END AS rule_modified_date, text AS raw_content
  FROM (SELECT *, sha256(source || ':docs/' || doc_id || '.txt') AS h, 'T' || (1000 + (doc_id * 7 + n_chars) % 40) AS t FROM documents) d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technique catalog: every technique that the documents use, but T1033.

    id, name, url, tactics (ids), revoked, deprecated, is_subtechnique. Revoked where the number ends in 9,
    deprecated in 8; tactic by the number modulo 14 in kill-chain order, a second one for multiples of 5.
    """
    used = read(spark, sf_dir, "documents").select((1000 + (F.col("doc_id") * 7 + F.col("n_chars")) % 40).alias("n"), (F.col("doc_id") % 3).alias("k"))
    ids = used.select("n", F.explode(F.array(F.lit(None).cast("long"), F.col("k"))).alias("k")).distinct().where("n <> 1033")
    number = F.col("n") % 1000
    tactic = N.lits([r[0] for r in dims.TACTICS])
    at = lambda i: F.element_at(tactic, (i % 14 + 1).cast("int"))
    tid = F.concat(F.lit("T"), F.col("n"), F.when(F.col("k").isNotNull(), F.concat(F.lit(".00"), F.col("k") + 1)).otherwise(""))
    return ids.select(
        tid.alias("id"),
        F.concat(F.lit("Technique "), F.col("n"), F.when(F.col("k").isNotNull(), F.concat(F.lit(" variant "), F.col("k") + 1)).otherwise("")).alias("name"),
        F.when(number % 5 == 0, F.array(at(number), at(number + 3))).otherwise(F.array(at(number))).alias("tactics"),
        (number % 10 == 9).alias("revoked"),
        (number % 10 == 8).alias("deprecated"),
        F.col("k").isNotNull().alias("is_subtechnique"),
    )


CAT = (
    """ids AS (
  SELECT DISTINCT n, k FROM (SELECT 1000 + (doc_id * 7 + n_chars) % 40 AS n, unnest([NULL, doc_id % 3]) AS k FROM documents) WHERE n <> 1033
), cat AS (
  SELECT 'T' || n || coalesce('.00' || (k + 1), '') AS id, 'Technique ' || n || coalesce(' variant ' || (k + 1), '') AS name,
    CASE WHEN n % 5 = 0 THEN [ts[(n % 1000) % 14 + 1], ts[(n % 1000 + 3) % 14 + 1]] ELSE [ts[(n % 1000) % 14 + 1]] END AS tactics,
    n % 10 = 9 AS revoked, n % 10 = 8 AS deprecated, k IS NOT NULL AS is_subtechnique
  FROM ids, (SELECT """
    + str([r[0] for r in dims.TACTICS])
    + """ AS ts)
)"""
)
#: Retired ids of the derived catalog and their successors.
REMAP = {"T1009": "T1010", "T1019": "T1020"}
REMAP_SQL = "remap AS (SELECT * FROM (VALUES ('T1009', 'T1010'), ('T1019', 'T1020')) v(old_id, new_id))"


def remap(spark: SparkSession, pairs: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((REMAP if pairs is None else pairs).items()), "old_id string, new_id string")
