"""Sharding by a hypergeometric communication matrix.

A uniform shuffle with exact shard sizes, in the coarse-grained parallel way: every input partition permutes its rows
locally; a matrix of counts says how many rows of each partition go to each shard, drawn so that rows and columns sum to
the partitions' and shards' sizes with the probabilities of a uniform permutation; rows are exchanged by it; and every
shard is permuted again, in random blocks, so that no task holds a shard.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulelens.llm.common import cut, small_side

SHARDS = 24
SEED = "shards-1"
#: The second permutation works in random blocks of about so many rows, and in so many blocks a shard at least.
BLOCK_ROWS, BLOCKS_LEAST = 1_000_000, 64
_LOW = (1 << 33) - 1


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without return from ``good`` and ``bad`` are good.

    Inversion over the probabilities around the mode, from the ratios of neighbours: counts may be of any size (library
    generators stop at 1e9). What the window leaves out is far below the resolution of a double.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = int(12 * math.sqrt(draws * share * (1 - share)) + 40)
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    up = np.log(good - x[:-1]) + np.log(draws - x[:-1]) - np.log(x[:-1] + 1) - np.log(bad - draws + x[:-1] + 1)
    log_p = np.concatenate([[0.0], np.cumsum(up)])
    mass = np.cumsum(np.exp(log_p - log_p.max()))
    return int(x[min(np.searchsorted(mass, rng.random() * mass[-1], side="right"), len(x) - 1)])


def communication_matrix(counts: Sequence[int], sizes: Sequence[int], seed: str = SEED) -> np.ndarray:
    """Rows from each partition (``counts``) to each shard (``sizes``, of the same sum), as a uniform permutation has them.

    One row after the other is a multivariate hypergeometric draw from what the shards have left, itself a chain of
    draws shard by shard.
    """
    rng = np.random.default_rng(zlib.crc32(seed.encode()))
    left = list(map(int, sizes))
    if sum(left) != sum(counts):
        raise ValueError("the shards' sizes must add up to the rows")
    out = np.zeros((len(counts), len(left)), dtype=np.int64)
    for p, n in enumerate(map(int, counts)):
        rest = sum(left)
        for s, room in enumerate(left):
            rest -= room
            out[p, s] = x = hypergeometric(rng, room, rest, n)
            n -= x
            left[s] = room - x
    return out


def shuffled(df: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard): a uniform shuffle.

    Shards differ by one row at most. All columns pass through (those named shard or slot are replaced). Content plays no
    part: null, empty and very long texts, ties and repeated rows are rows like others, each with a place of its own.
    An empty table gives an empty result; with fewer rows than shards, the last shards stay empty. The same files read
    in the same splits give the same shuffle.

    ``df`` is written once to the shared folder, after the local permutation; rows are then exchanged once. The driver
    holds one count per input partition and shard.
    """
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.monotonically_increasing_id().alias("at"))
    local = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), "at"), "at")
    place = F.monotonically_increasing_id()  # partition and rank within it, after the local permutation
    placed = cut(local.select("row", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit(_LOW)).alias("rank")))

    counts = sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect())  # one row per input partition
    sizes = shard_sizes(sum(n for _, n in counts), shards)
    matrix = communication_matrix([n for _, n in counts], sizes, seed).cumsum(axis=1)
    bounds = df.sparkSession.createDataFrame([(int(part), [int(x) for x in row]) for (part, _), row in zip(counts, matrix, strict=True)], "part long, bounds array<long>")
    sent = placed.join(small_side(bounds), "part").select("row", "part", "rank", F.size(F.filter("bounds", lambda x: x <= F.col("rank"))).alias("shard"))

    blocks = max(BLOCKS_LEAST, -(-sizes[0] // BLOCK_ROWS))
    mixed = sent.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "part", "rank"), F.lit(blocks)))
    # the blocks' sizes come from the narrow columns alone; there are shards x blocks of them
    sized = cut(mixed.groupBy("shard", "block").count())
    before = F.sum("count").over(W.partitionBy("shard").orderBy("block")) - F.col("count")
    offsets = small_side(cut(sized.select("shard", "block", before.alias("before"))))
    order = F.row_number().over(W.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("slot"), "part", "rank"), "part", "rank"))
    out = mixed.withColumn("order", order).join(offsets, ["shard", "block"])
    return out.select("row.*", "shard", (F.col("before") + F.col("order") - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED) -> None:
    """Write ``shuffled(df)`` as Parquet, one folder per shard; within a file rows are in the order of their slots."""
    shuffled(df, shards, seed).write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size (UTF-8 bytes plus 8), text_crc32 (a null text has no bytes), law, shard, slot, grown_shard (null)."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return shuffled(narrow).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
