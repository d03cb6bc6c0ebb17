"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows are at most this many (narrow rows, tens of MB).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; where that is unset, an own one, on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rulelens-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def text_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df`` unchanged; from now on its session hands at most ``rows`` rows at once to Python, as whole texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that a lost executor costs one reread.

    The files are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it; a shuffled join (split where skewed) otherwise.

    Pass a cut table, as it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.count() <= rows else df


def bucket_of(key: Column, mod: int) -> Column:
    """crc32 of the key as text modulo ``mod``: the fold of a document."""
    return F.crc32(F.encode(key.cast("string"), "utf-8")) % mod


def unit_hash(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys only (52 bits of an MD5)."""
    text = F.concat_ws(":", *(F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


# ---------------------------------------------------------------- words of many texts at once

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^0 .. p^(n-1) and their inverses modulo 2^64; grown on demand, at least 1 Mi entries."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 20, n)
        for name, base in (("up", _P), ("down", _P_INV)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


#: A random odd 64-bit value for every byte.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of value(data[j]) * p^j over j < i, modulo 2^64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that belong to words: letters, digits and everything beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True
#: Bytes other than ASCII white space.
INK_BYTE = np.ones(256, dtype=bool)
INK_BYTE[[9, 10, 11, 12, 13, 32]] = False


class Words:
    """The words of a batch of texts: byte spans [start, end) in one lower-cased buffer, and 64-bit hashes.

    ``doc`` numbers the text of each word, ``first`` has each text's first word (one more entry closes the last).
    """

    def __init__(self, texts: Iterable[str | None], word_byte: np.ndarray = WORD_BYTE, lower: bool = True):
        parts = [((t.lower() if lower else t) if t else "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = word_byte[self.data]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(parts) + 1))
        self.prefix = prefix_hash(self.data)
        self.hash = span_hash(self.prefix, self.start, self.end)


def batches(frames: Iterable, text: str = "text", most: int = 1_000_000):
    """Cut Arrow batches (as pandas frames) so that each holds at most ``most`` characters, or one text."""
    for pdf in frames:
        if not len(pdf):
            continue
        size = pdf[text].str.len().fillna(0).to_numpy(dtype=np.int64)
        group = (np.cumsum(size) - size) // most
        for lo, hi in zip(*_runs(group), strict=True):
            yield pdf.iloc[lo:hi]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return at, np.r_[at[1:], len(values)]


runs = _runs


def whole_groups(frames: Iterable, keys: list[str]):
    """The groups of equal ``keys`` in frames that are sorted by them (within a partition), one frame each."""
    held = None
    for pdf in frames:
        held = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
        if not len(held):
            continue
        new = np.zeros(len(held), bool)
        for k in keys:
            v = held[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(new)
        for lo, hi in zip(np.r_[0, at][: len(at)], at, strict=True):
            yield held.iloc[lo:hi]
        held = held.iloc[at[-1] if len(at) else 0 :].reset_index(drop=True)
    if held is not None and len(held):
        yield held

# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): one row (id, component) per linked id, component its smallest id.

    Alternates two star contractions until nothing changes (a logarithmic number of rounds in practice). Each round
    takes per-node minima, which combine before the shuffle, and joins them back; a node of very high degree is
    split by the adaptive skew join. Empty input gives an empty result.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = cut(edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).union(now.select("v", "u"))
        low = both.groupBy("n").agg(F.min("m").alias("lo"))
        large = (both.join(low.hint("merge"), "n").where("m > n").select(F.col("m").alias("u"), F.least("lo", "n").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("lo").alias("v")), F.struct("u", F.col("lo").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = cut(small)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def join_labels(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``docs`` rows that have a label: doc_id, text and ``y``; a doc_id that ``labels`` repeats takes the largest.

    Pass the sampled labels: they are counted, and broadcast if few, so that texts need no shuffle.
    """
    one = labels.where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    return docs.select("doc_id", "text").join(small_side(cut(one)), "doc_id")


def sample_rate(key: str, salt: str, rate: float) -> Column:
    """True for about ``rate`` of the rows, by a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, max(0.0, rate)) * (1 << 30))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps on a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
