"""Exact top-k search by pivot tables.

Every vector's distances to many pivots are computed once. |d(q, p) - d(x, p)| bounds d(q, x) from below for every
pivot p; the greatest of these bounds gives an upper bound of the inner product. Candidates are evaluated in the
order of that bound, and the search stops when no further candidate can reach the k-th best score. The candidates stay
where they are: each block of queries is sent to them, and every task keeps the k best it has met so far.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulelens.llm.common import cut

K, EVERY, SCALE = 10, 100, 1024
#: Pivots, and sampled vectors they are chosen from; the sample also gives each query a first threshold.
PIVOTS, SAMPLE = 24, 512
#: Queries sent to all candidates at once: their number, and bytes of their vectors, whichever is less.
QUERY_BLOCK, QUERY_BYTES = 16_384, 16 << 20
#: Candidates that a task looks at together, and those evaluated first in bound order.
BLOCK, STEP = 4096, 128
LOWEST = -(1 << 62)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and vec, floor(scale * x) of each component as long; unusable vectors take no part.

    Null vec_ids take no part either; a repeated vec_id counts once, with its smallest vector.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.select("vec_id", x.alias("x")).where("vec_id is not null and x is not null").where(~bad)
    whole = good.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("vec"))
    return whole.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of n rows."""
    chosen = [0]
    far = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table of the rows of ``x``: one row per pivot."""
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots])


def exact_in_floats(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether floating point gives the inner products of these longs exactly."""
    return not q.size or not x.size or float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of longs: by floating point where that is exact, else in integers."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    if exact_in_floats(q, x):
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


class Best:
    """The k best candidates of each query so far: ``scores`` falling, equal ones by rising ``ids``.

    ``first`` are scores that k candidates of each query are known to reach.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, far: np.ndarray, first: np.ndarray, k: int):
        self.query_ids, self.q, self.far, self.first = ids, q, far, first
        self.norm = (q.astype(float) ** 2).sum(1)
        self.scores = np.full((len(q), k), LOWEST)
        self.ids = np.full((len(q), k), -1, dtype=np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> int:
        """Bring in a block of candidates; gives how many pairs were evaluated."""
        work = float if exact_in_floats(self.q, x) else np.int64
        xs, evaluated = x.astype(work), 0
        norm = (x.astype(float) ** 2).sum(1)
        for i, qid in enumerate(self.query_ids):
            least = max(self.first[i], self.scores[i, -1])
            bound = np.abs(far - self.far[:, i : i + 1]).max(axis=0)
            both = self.norm[i] + norm
            top = (both - bound**2) / 2 + 1e-9 * both + 1e-6  # rounding of the distances
            live = np.flatnonzero((top >= least) & (ids != qid))
            live = live[np.argsort(-top[live], kind="stable")]
            query, at, step = self.q[i].astype(work), 0, STEP
            while at < len(live) and top[live[at]] >= least:
                part = live[at : at + step]
                at, step = at + step, 2 * step
                score = (xs[part] @ query).astype(np.int64)
                evaluated += len(part)
                good = score >= least
                if not good.any():
                    continue
                scores, own = np.append(self.scores[i], score[good]), np.append(self.ids[i], ids[part[good]])
                best = np.lexsort((own, -scores))[: self.scores.shape[1]]
                self.scores[i], self.ids[i] = scores[best], own[best]
                least = max(least, self.scores[i, -1])
        return evaluated

    def rows(self) -> pd.DataFrame:
        i, j = np.nonzero((self.scores > LOWEST) & (self.scores >= self.first[:, None]))
        return pd.DataFrame({"query_id": self.query_ids[i], "vec_id": self.ids[i, j], "score": self.scores[i, j]})


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), dim)


def together(frames, rows: int):
    """Frames joined until each holds at least ``rows`` rows."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, evaluated: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of every query with every other vector.

    Both take (vec_id, vec array<long>) with one row per vec_id; give cut tables. Ties go to the smaller vec_id; a query
    with fewer candidates gets them all; vectors meet only vectors of their own dimension. Empty tables give no rows.
    Scores are 64-bit numbers, as the components are. ``evaluated`` counts the pairs that the bounds did not eliminate.

    Candidates are never shuffled or copied: queries come to them in bounded blocks, one pass over the table for each,
    and a task gives at most k rows per query.
    """
    spark = vectors.sparkSession
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded
    for dim in {len(r.vec) for r in rows}:
        own = [r for r in rows if len(r.vec) == dim]
        sample[dim] = np.array([r.vec_id for r in own]), np.array([r.vec for r in own], dtype=np.int64).reshape(len(own), dim)
    pivots = {dim: choose_pivots(x.astype(float), PIVOTS) for dim, (_, x) in sample.items()}
    table_of = lambda x: distances(x.astype(float), pivots[x.shape[1]]) if x.shape[1] in pivots else np.zeros((1, len(x)))

    def pivot_table(frames):
        for pdf in frames:
            for dim, own in pdf.groupby("dim"):
                yield own.assign(far=table_of(matrix(own.vec, dim)).T.tolist())

    table = cut(vectors.withColumn("dim", F.size("vec")).mapInPandas(pivot_table, "vec_id long, vec array<long>, dim int, far array<double>"))
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).head()
    if not asked.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-asked.n // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, asked.dim)))))

    def start(dim: int, own: pd.DataFrame) -> Best:
        ids, q = own.vec_id.to_numpy(), matrix(own.vec, dim)
        first = np.full(len(q), LOWEST)
        if dim in sample and len(sample[dim][0]) > k:
            s_ids, s = sample[dim]
            known = np.where(s_ids[None] == ids[:, None], LOWEST, products(q, s))
            first = -np.sort(-known, axis=1)[:, k - 1]
        return Best(ids, q, table_of(q), first, k)

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    parts = []
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(blocks)) == b).select("vec_id", "vec", F.size("vec").alias("dim")).toPandas()  # a bounded block
        shared = spark.sparkContext.broadcast({int(dim): own for dim, own in mine.groupby("dim")})

        def search(frames, shared=shared):
            best = {}
            for pdf in together(frames, BLOCK):
                for dim, own in pdf.groupby("dim"):
                    if dim in shared.value:
                        if dim not in best:
                            best[dim] = start(dim, shared.value[dim])
                        n = best[dim].meet(own.vec_id.to_numpy(), matrix(own.vec, dim), np.array(own.far.tolist()).T)
                        if evaluated is not None:
                            evaluated.add(n)
            for found in best.values():
                yield found.rows()

        found = table.mapInPandas(search, "query_id long, vec_id long, score long")
        parts.append(cut(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")))
        shared.unpersist()
    return reduce(DataFrame.union, parts)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best integer inner products of every ``embeddings`` row whose vec_id is divisible by 100."""
    vectors = cut(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP6_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vectors AS (SELECT vec_id, min(v) AS v FROM whole GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
