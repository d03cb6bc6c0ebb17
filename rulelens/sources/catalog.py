"""The ATT&CK catalog from a STIX bundle, with a fallback of the tactics alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import dims

BUNDLE = (
    "objects array<struct<type: string, name: string, x_mitre_shortname: string, x_mitre_deprecated: boolean, revoked: boolean,"
    " external_references: array<struct<external_id: string, url: string>>,"
    " kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>>>"
)
SITE = "https://attack.mitre.org"


def load_stix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tactics, techniques) of a bundle; the order of its objects does not matter.

    tactics: id, name, short_name, url, deprecated. techniques: id, name, tactics (in the order of their phases),
    url, deprecated, revoked, is_subtechnique. Objects without a fitting external id are left out.
    """
    objects = spark.read.schema(BUNDLE).option("multiLine", True).json(path)
    each = objects.select(F.explode("objects").alias("o")).select("o.*")
    own = lambda prefix: F.get(F.filter("external_references", lambda r: r["external_id"].startswith(prefix)), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    tactics = each.where("type = 'x-mitre-tactic'").withColumn("id", own("TA")["external_id"]).where("id is not null and name <> ''")
    tactics = tactics.select("id", "name", F.coalesce("x_mitre_shortname", F.lit("")).alias("short_name"), F.concat(F.lit(f"{SITE}/tactics/"), "id", F.lit("/")).alias("url"), flag("x_mitre_deprecated").alias("deprecated"))
    patterns = each.where("type = 'attack-pattern'").withColumn("ref", own("T")).where("ref is not null")
    page = F.concat(F.lit(f"{SITE}/techniques/"), F.replace(F.col("ref.external_id"), F.lit("."), F.lit("/")), F.lit("/"))
    techniques = patterns.select(F.col("ref.external_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("ref.url", page).alias("url"), flag("x_mitre_deprecated").alias("deprecated"), flag("revoked").alias("revoked"), F.contains("ref.external_id", F.lit(".")).alias("is_subtechnique"), F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack").alias("phases"))
    phase = techniques.select("id", F.posexplode("phases").alias("pos", "p")).select("id", "pos", F.col("p.phase_name").alias("short_name"))
    named = phase.join(tactics.select(F.col("id").alias("tactic"), "short_name"), "short_name")
    ordered = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tactic"))), lambda x: x["tactic"]).alias("tactics"))
    full = techniques.drop("phases").join(ordered, "id", "left")
    return tactics, full.select("id", "name", F.coalesce("tactics", F.array().cast("array<string>")).alias("tactics"), "url", "deprecated", "revoked", "is_subtechnique")


def fallback(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed tactics and no techniques, where no bundle can be read."""
    tactics = dims.tactics(spark).select("id", "name", "short_name", F.concat(F.lit(f"{SITE}/tactics/"), "id", F.lit("/")).alias("url"), F.lit(False).alias("deprecated"))
    return tactics, spark.createDataFrame([], "id string, name string, tactics array<string>, url string, deprecated boolean, revoked boolean, is_subtechnique boolean")
