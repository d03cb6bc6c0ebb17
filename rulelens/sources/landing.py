"""Landing of rule files: discovery, reading, filtering and decoding, with every failure kept as a row."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from rulelens.functions.normalize import lits, repair_lines


@dataclass(frozen=True)
class Discovery:
    """Where a source keeps its rules: globs, excluded directories, words that the path must hold, format.

    ``repair``: its files hold unquoted values that YAML cannot read and are repaired line by line first.
    """

    globs: Sequence[str]
    must_hold: Sequence[str] = ()
    excluded: Sequence[str] = ("deprecated", "tests", "test", ".git")
    form: str = "yaml"
    repair: bool = False


# ---- fixed values: layout of the public rule repositories
DISCOVERY = {
    "sigma": Discovery(("rules/**/*.yml", "rules/**/*.yaml", "rules-*/**/*.yml", "rules-*/**/*.yaml"), ("rules",)),
    "elastic": Discovery(("rules/**/*.toml",), ("rules",), ("_deprecated", "deprecated", "tests", "test", ".git", "_building_block"), "toml"),
    "splunk": Discovery(("detections/**/*.yml", "detections/**/*.yaml"), ("detections",)),
    "sublime": Discovery(("detection-rules/**/*.yml", "detection-rules/**/*.yaml"), ("detection-rules",)),
    "elastic_protections": Discovery(("behavior/rules/**/*.toml",), ("behavior",), form="toml"),
    "lolrmm": Discovery(("detections/sigma/**/*.yml", "detections/sigma/**/*.yaml"), ("sigma",), repair=True),
    "elastic_hunting": Discovery(("hunting/**/*.toml",), ("hunting",), form="toml"),
    "sentinel": Discovery(tuple(f"Solutions/**/{d}/*.{e}" for d in ("Analytic Rules", "Hunting Queries", "Detection Queries") for e in ("yaml", "yml")), ("solutions", "analytic"), ("deprecated", "tests", "test", ".git", "sample")),
}


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ** spans directories (none too), * stays within one."""
    parts = [p.replace(".", r"\.").replace("*", "[^/]*") for p in glob.split("/")]
    return "^" + "/".join(parts).replace("[^/]*[^/]*/", "(?:[^/]+/)*") + "$"


def discovered(path: Column, spec: Discovery) -> Column:
    """Whether a relative path is one of the source's rule files."""
    hit = F.lit(False)
    for g in spec.globs:
        hit = hit | path.rlike(glob_pattern(g))
    return hit & ~F.arrays_overlap(F.transform(F.split(path, "/"), F.lower), lits(list(spec.excluded)))


def applicable(path: Column, spec: Discovery, compat_substring: bool = False) -> Column:
    """Whether the source's decoder takes the path: extension, words that it must hold, no excluded directory.

    ``compat_substring`` excludes any path that merely contains an excluded name.
    """
    low = F.lower(path)
    ends = low.endswith(".toml") if spec.form == "toml" else low.endswith(".yml") | low.endswith(".yaml")
    for word in spec.must_hold:
        ends = ends & F.contains(low, F.lit(word))
    if compat_substring:
        for word in spec.excluded:
            ends = ends & ~F.contains(low, F.lit(word))
        return ends
    return ends & ~F.arrays_overlap(F.split(low, "/"), lits([w.lower() for w in spec.excluded]))


def file_counts(files: DataFrame, specs: dict[str, Discovery] | None = None) -> DataFrame:
    """source, n_files: how many landed files (source, path) are rule files of their source, 0 where none are."""
    hit = F.lit(False)
    for source, spec in (DISCOVERY if specs is None else specs).items():
        hit = hit | ((F.col("source") == source) & discovered(F.col("path"), spec))
    return files.groupBy("source").agg(F.count_if(hit).alias("n_files"))


def escaped_glob(root: str) -> str:
    """A folder's name with the characters that file systems take for patterns escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", root)


def relative_path(spark: SparkSession, path: Column, root: str) -> Column:
    """``path`` below ``root``, whatever the root and however often its name occurs: the same id follows on any mount.

    The root is taken as a literal prefix, in the form that the file system itself gives its files. Paths are file paths, so
    nothing in them is decoded.
    """
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(root)
    prefix = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString().rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), content (null where it is not UTF-8) of all files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(escaped_glob(root))
    return files.select(relative_path(spark, F.col("path"), root).alias("path"), F.expr("try_validate_utf8(cast(content as string))").alias("content"))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root) and location of all files below ``root``, none of which is opened; empty files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(escaped_glob(root))
    return files.select(relative_path(spark, F.col("path"), root).alias("path"), F.col("path").alias("location"))


@F.pandas_udf(LongType())
def first_bad_byte(content: pd.Series) -> pd.Series:
    """Where the bytes stop being UTF-8, from 0; null for null and for valid bytes."""

    def place(data: bytes | None) -> int | None:
        try:
            if data is not None:
                bytes(data).decode("utf-8")
        except UnicodeDecodeError as e:
            return e.start
        return None

    return pd.Series([place(x) for x in content], dtype="Int64")


def read_rule_files(spark: SparkSession, root: str, spec: Discovery) -> DataFrame:
    """path, content (null where it is not UTF-8) and bad_byte_at of the rule files of one source below ``root``.

    Paths are filtered first, from the listing alone: the content of other files is never read. The list of the chosen files
    goes through the driver, as the index of any read of files does. A root without rule files gives no rows.
    """
    chosen = listed_files(spark, root).where(discovered(F.col("path"), spec) & applicable(F.col("path"), spec))
    places = [r.location for r in chosen.select("location").collect()]
    if not places:
        return spark.createDataFrame([], "path string, content string, bad_byte_at long")
    files = spark.read.format("binaryFile").load([escaped_glob(p) for p in places])
    valid = F.expr("try_validate_utf8(cast(content as string))")
    bad = first_bad_byte(F.when(valid.isNull(), F.col("content")))
    return files.select(relative_path(spark, F.col("path"), root).alias("path"), valid.alias("content"), bad.alias("bad_byte_at"))


def decoded_json(content: str, form: str) -> str | None:
    """JSON text of a YAML (first document) or TOML file, null if it is malformed or no mapping.

    Dates become ISO text; a ``detection`` section is added as YAML text too.
    """
    import tomllib

    import yaml

    try:
        data = tomllib.loads(content) if form == "toml" else next(iter(yaml.safe_load_all(content)), None)
        if not isinstance(data, dict):
            return None
        if form != "toml" and data.get("detection"):
            data["detection_text"] = yaml.safe_dump(data["detection"], sort_keys=False, allow_unicode=True)
        return json.dumps(data, default=lambda x: x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x))
    except (yaml.YAMLError, tomllib.TOMLDecodeError, ValueError, TypeError, RecursionError):
        return None


@F.pandas_udf(StringType())
def decode(content: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else decoded_json(c, f) for c, f in zip(content, form, strict=True)])


def landed(files: DataFrame, source: str, spec: Discovery) -> DataFrame:
    """source, path, content, doc (variant) and error_stage, error_severity, error_message of the source's files."""
    mine = files.where(discovered(F.col("path"), spec)).select(F.lit(source).alias("source"), "path", "content", F.lit(spec.form).alias("form"))
    text = repair_lines(F.col("content")) if spec.repair else F.col("content")
    docs = mine.withColumn("json", F.when(F.col("content").isNotNull() & applicable(F.col("path"), spec), decode(text, "form")))
    stage = F.when(F.col("content").isNull(), "read").when(~applicable(F.col("path"), spec), "skipped").when(F.col("json").isNull(), "parse")
    message = F.when(F.col("content").isNull(), "not UTF-8").when(~applicable(F.col("path"), spec), "not taken by the decoder").when(F.col("json").isNull(), "malformed")
    severity = F.when(stage == "read", "error").when(stage == "parse", "warning")
    return docs.select("source", "path", "content", F.try_parse_json("json").alias("doc"), stage.alias("error_stage"), severity.alias("error_severity"), message.alias("error_message"))
