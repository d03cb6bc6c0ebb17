"""Mixing sources to target weights.

Tokens are aggregated per source, targets and repetition rates follow from the aggregates, and each document is
emitted floor(rate) times plus one copy drawn with the fraction's probability from a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulelens.llm.common import cut, small_side, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
#: Sources by code point, null last, take these weights in turn.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
CAP = 3
SEED = "mix-1"


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sized(source, size)`` to one row per source: source, source_size, weight, target, rate.

    The sum of all sizes is shared by weight; a target above ``cap`` times its source's size stops there and the
    excess is shared again by weight. That fixed point is target = min(cap * size, level * weight), and the level
    is found by a few aggregations of the source table. A null source is a source; null sizes count 0; sources
    without a token get target and rate 0. The rank of a source is its place within a range partition plus the
    counts of the partitions before, so no task sees all sources.
    """
    per_source = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    ranged = cut(per_source.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, F.lit(0)
    for part, n in sorted(ranged.groupBy("part").count().collect()):  # one row for each of the range partitions
        offsets, before = F.when(F.col("part") == part, before).otherwise(offsets), before + n
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + offsets
    turn = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    table = cut(ranged.select("source", "source_size", turn.alias("weight")))

    most = F.col("source_size") * cap
    level, stopped = 0.0, -1
    while True:
        full = most <= F.lit(level) * F.col("weight") if stopped >= 0 else F.lit(False)
        x = table.agg(F.sum("source_size").alias("t"), F.sum(F.when(full, most)).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count_if(full).alias("n")).head()
        if not x.t or not x.w or x.n == stopped:
            break
        level, stopped = (x.t - (x.c or 0)) / x.w, x.n
    target = F.least(most.cast("double"), F.lit(float(level)) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return table.withColumn("target", target).withColumn("rate", rate)


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` joined with its source's row of ``targets`` and ``copies``, the times the mix takes each document.

    Columns of ``docs`` named like one of ``targets`` or ``copies`` are replaced; ``mix`` keeps them all.
    """
    docs = docs.drop(*(c for c in [*targets.columns, "copies"] if c != "source"))
    side = small_side(cut(targets)).withColumnRenamed("source", "target_source")
    joined = docs.join(side, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    draw = unit_hash(F.lit(seed), F.col("doc_id").cast("string"))
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("int")).cast("int"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (number of words; 0 for null or empty text) of each row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: ``docs`` rows with their own columns, each repeated as often as the mix takes it.

    ``docs`` needs doc_id, text and source; other columns pass through under any name. Rows that repeat a doc_id
    share its draw; a null doc_id draws as the text "null"; an empty table gives an empty table.
    """
    narrow = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = with_copies(narrow, source_targets(sizes(docs)), seed)
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size, source_size, target (its source's) and taken (words the mix takes, repeats counted)."""
    sized = cut(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = with_copies(sized, source_targets(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM per_source
), levels AS (
  SELECT k, 3.0::DOUBLE * source_size / weight AS stop_at,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM ordered
), chosen AS (
  SELECT min_by(level, k) AS level FROM levels WHERE stop_at >= level
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM per_source, chosen
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0
                                        < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
