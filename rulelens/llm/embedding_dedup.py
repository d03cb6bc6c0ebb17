"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors go to the shards of their nearest centroids (several each, so shards overlap). In each shard a flat graph is
built by robust pruning; the adjacency lists of a vector from all its shards are united; a greedy search from the
shard's medoids, widened over everything in range, finds each vector's neighbours, and cosines are verified in double
precision. Each shard compares a bounded set of its vectors with all others: where the graph's recall is below the bar
there, blocked products search that shard anew. Recall over all shards is audited against brute force on a bounded set
of queries of every class of link counts; more overlap is used if it is low, and labels where it stays low are searched
exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.common import components, cut

THRESHOLD = 0.93
#: Mean and largest number of vectors in a shard; larger shards are cut in parts, and all pairs of parts are searched.
SHARD, SHARD_MOST = 500, 1500
#: Centroids of one label at most, and sampled vectors that fit them.
CENTROIDS_MOST, SAMPLE = 4096, 20_000
#: A large alpha prunes little among equally near vectors: copies around one original stay linked to each other,
#: not only to the original. Searches begin at STARTS medoids.
DEGREE, BEAM, ALPHA, STARTS = 16, 48, 2.2, 32
#: Shards of a vector, first and at most; audited queries; the recall that ends the search.
OVERLAP, OVERLAP_MOST, AUDITED, RECALL = 2, 6, 200, 0.97
#: Vectors of a shard that audit its graph.
ASKED_IN_SHARD = 64


# ---------------------------------------------------------------- a flat graph in one shard


def robust_prune(x: np.ndarray, nodes: np.ndarray, pools: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each node from its pool (-1: none): nearest first, without those that a chosen one is alpha times nearer to.

    Gives rows of ``degree`` ids, filled up with -1.
    """
    pools = np.sort(np.where(pools == nodes[:, None], -1, pools), axis=1)
    pools[:, 1:][pools[:, 1:] == pools[:, :-1]] = -1
    far = np.where(pools >= 0, 1 - np.einsum("bpd,bd->bp", x[pools], x[nodes]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    pools, far = np.take_along_axis(pools, order, 1), np.take_along_axis(far, order, 1)
    among = 1 - x[pools] @ x[pools].transpose(0, 2, 1)
    alive = np.isfinite(far)
    out = np.full((len(nodes), degree), -1, dtype=np.int64)
    row = np.arange(len(nodes))
    for t in range(degree):
        k = alive.argmax(axis=1)
        some = alive[row, k]
        if not some.any():
            break
        out[some, t] = pools[row, k][some]
        alive &= alpha * among[row, k] > far
        alive[row, k] = False
    return out


def greedy(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search of all queries at once, from the nearest of ``starts``: (ids, cosines) of the beams and the visited bitmap."""
    n, b = len(x), len(queries)
    ids = np.full((b, beam), -1, dtype=np.int64)
    cos = np.full((b, beam), -np.inf)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    first = queries @ x[starts].T
    best = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    ids[:, : best.shape[1]], cos[:, : best.shape[1]] = starts[best], np.take_along_axis(first, best, 1)
    seen[:, starts] = seen[:, n] = True
    row = np.arange(b)
    while True:
        open_cos = np.where(done | (ids < 0), -np.inf, cos)
        k = open_cos.argmax(axis=1)
        act = np.flatnonzero(open_cos[row, k] > -np.inf)
        if not len(act):
            return ids, cos, seen
        done[act, k[act]] = True
        near = graph[ids[act, k[act]]]
        near = np.where(near < 0, n, near)
        new = ~seen[act[:, None], near]
        seen[act[:, None], near] = True
        sims = np.where(new, np.einsum("brd,bd->br", x[np.minimum(near, n - 1)], queries[act]), -np.inf)
        all_cos = np.concatenate([cos[act], sims], axis=1)
        best = np.argsort(-all_cos, axis=1, kind="stable")[:, :beam]
        ids[act] = np.take_along_axis(np.concatenate([ids[act], np.where(new, near, -1)], axis=1), best, 1)
        cos[act] = np.take_along_axis(all_cos, best, 1)
        done[act] = np.take_along_axis(np.concatenate([done[act], np.zeros_like(new)], axis=1), best, 1)


def medoids(x: np.ndarray, most: int) -> np.ndarray:
    """The medoid of all rows, and those of up to ``most`` - 1 clusters around rows that are far from each other."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[out[0]]
    while len(out) < min(most, len(x)) and near.min() < 0.9:
        out.append(int(near.argmin()))
        near = np.maximum(near, x @ x[out[-1]])
    home = (x @ x[out].T).argmax(axis=1)
    seeds = len(out)
    for c in range(1, seeds):
        own = np.flatnonzero(home == c)
        if len(own):
            out.append(int(own[(x[own] @ x[own].mean(axis=0)).argmax()]))
    return np.unique(out[:1] + out[seeds:])


def starts_of(x: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """The medoids, and a node of every connected component of ``graph`` that holds none of them."""
    start = medoids(x, STARTS)
    a, t = np.nonzero(graph >= 0)
    root = roots_of(a, graph[a, t], len(x))
    return np.union1d(start, np.setdiff1d(root, root[start]))


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists over the unit rows of ``x``."""
    n = len(x)
    if n <= degree + 1:
        return [np.delete(np.arange(n), i) for i in range(n)]
    rng = np.random.default_rng(n)
    width = 2 * degree
    graph = np.full((n, width), -1, dtype=np.int64)
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    start = medoids(x, STARTS)
    order = rng.permutation(n)
    for lo in range(0, n, 128):
        part = order[lo : lo + 128]
        pools, _, _ = greedy(x, graph, start, x[part], beam)
        own = robust_prune(x, part, np.concatenate([pools, graph[part]], axis=1), degree, alpha)
        graph[part] = -1
        graph[part, :degree] = own
        # back edges: each target takes what points to it, pruned where that is too much
        i, t = np.nonzero(own >= 0)
        to, back = own[i, t], part[i]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        fresh = np.full((len(targets), count.max(initial=0)), -1, dtype=np.int64)
        fresh[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(first, count)] = back
        pool = np.concatenate([graph[targets], fresh], axis=1)
        pool = -np.sort(-pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        pool = -np.sort(-pool, axis=1)
        over = (pool >= 0).sum(axis=1) > width
        graph[targets[~over]] = pool[~over, :width]
        if over.any():
            graph[targets[over]] = -1
            graph[targets[over], :degree] = robust_prune(x, targets[over], pool[over], degree, alpha)
    return [np.unique(g[g >= 0]) for g in graph]


def in_range(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) index pairs with cosine >= least: greedy search, then expansion of every node in range."""
    n = len(x)
    start = starts_of(x, graph)
    out_q, out_n = [], []
    for lo in range(0, len(queries), 128):
        part = queries[lo : lo + 128]
        ids, cos, seen = greedy(x, graph, start, part, beam)
        q, k = np.nonzero((cos >= least) & (ids >= 0))
        node = ids[q, k]
        # nodes that the beam has seen and dropped are seen again
        seen[:] = False
        seen[:, n] = True
        seen[q, node] = True
        while len(q):
            out_q.append(q + lo)
            out_n.append(node)
            near = graph[node]
            qq, near = np.repeat(q, near.shape[1]), np.where(near < 0, n, near).ravel()
            fresh = ~seen[qq, near]
            code = np.unique(qq[fresh] * (n + 1) + near[fresh])
            q, node = code // (n + 1), code % (n + 1)
            seen[q, node] = True
            hit = np.zeros(len(q), bool)
            for at in range(0, len(q), 100_000):
                s = slice(at, at + 100_000)
                hit[s] = np.einsum("ij,ij->i", x[node[s]], part[q[s]]) >= least
            q, node = q[hit], node[hit]
    return np.concatenate([*out_q, np.zeros(0, int)]), np.concatenate([*out_n, np.zeros(0, int)])


def by_products(x: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) index pairs with cosine >= least, by blocked products of all queries with all rows."""
    found = [np.nonzero(queries[lo : lo + 256] @ x.T >= least) for lo in range(0, len(queries), 256)]
    return np.concatenate([q + 256 * i for i, (q, _) in enumerate(found)]), np.concatenate([k for _, k in found])


def audited_links(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, same: bool, whole: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """(query, node) index pairs with cosine >= least and (links of audited queries, those that the graph found, 1 if repaired).

    The graph is searched for every query; with ``same`` the queries are the rows themselves, so a link found from
    either end counts for both. Up to ASKED_IN_SHARD queries are compared with all rows: where the graph's share of
    their links is below RECALL, products search the whole shard; otherwise only what these comparisons found is
    added. ``whole`` asks for products in any case.
    """
    n = len(x)
    if whole:
        return *by_products(x, queries, least), (0, 0, 1)
    q, k = in_range(x, graph, queries, least)
    code = q * n + k
    if same:
        code = np.union1d(code, k * n + q)
    asked = np.random.default_rng(len(queries)).permutation(len(queries))[:ASKED_IN_SHARD]
    true_q, true_k = by_products(x, queries[asked], least)
    true = asked[true_q] * n + true_k
    others = true[true // n != true % n] if same else true  # a row always meets itself
    hits = int(np.isin(others, code).sum())
    if hits < RECALL * len(others):
        return *by_products(x, queries, least), (len(others), hits, 1)
    code = np.union1d(code, true)
    return code // n, code % n, (len(others), hits, 0)


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component under the links (a, b) of nodes 0 .. n - 1."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = np.minimum(low, low[root])
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            return root
        root = low


# ---------------------------------------------------------------- shards on Spark


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector as doubles, without what links with nothing."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "label", v.alias("vec")).where("vec_id is not null and label is not null and vec is not null").where(~bad & F.exists("vec", lambda x: x != 0))


def centroids(points: DataFrame, shard: int, most: int, sample: int) -> dict[tuple, np.ndarray]:
    """Unit centroids per (label, dimension) that has more vectors than a shard, from a bounded sample.

    A label's share of the sample follows its size; labels that fit one shard need none.
    """
    sizes = points.groupBy("label", "dim").count().where(F.col("count") > shard)
    total = sizes.agg(F.sum("count")).head()[0] or 0
    if not total:
        return {}
    taken = points.where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30)))
    by_key: dict[tuple, list] = {}
    for r in taken.select("label", "dim", "vec").limit(2 * sample).toLocalIterator():
        by_key.setdefault((r.label, r.dim), []).append(r.vec)
    want = {(r.label, r.dim): r["count"] for r in sizes.orderBy(F.desc("count")).limit(most).collect()}
    out = {}
    for key, n in want.items():
        x = np.array(by_key.get(key, []), dtype=float)
        k = min(math.ceil(n / shard), len(x), max(1, most * n // total))
        if k < 2:
            continue
        x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
        c = x[np.random.default_rng(0).permutation(len(x))[:k]]
        for _ in range(8):
            near = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        out[key] = c
    return out


def by_label(pdf: pd.DataFrame, most: int = 512):
    """(label, dim), row positions and the matrix of their vectors, at most ``most`` rows at a time."""
    for key, own in pdf.groupby(["label", "dim"], dropna=False).indices.items():
        for lo in range(0, len(own), most):
            at = own[lo : lo + most]
            yield key, at, np.array(pdf.vec.iloc[at].tolist(), dtype=float)


def nearest(x: np.ndarray, centers: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` centroids (all, if fewer) nearest to every row of ``x``, the nearest first."""
    near = -(x @ centers.T)
    some = np.argpartition(near, min(count, len(centers)) - 1, axis=1)[:, :count]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def assign(points: DataFrame, centers: dict[tuple, np.ndarray], overlap: int) -> DataFrame:
    """``points`` with ``shards``, the numbers of the nearest centroids of its label (0 where it has none)."""
    shared = points.sparkSession.sparkContext.broadcast(centers)  # at most CENTROIDS_MOST vectors

    def run(frames):
        for pdf in frames:
            shards = np.full(len(pdf), None, dtype=object)
            for key, at, x in by_label(pdf):
                own = nearest(x, shared.value[key], overlap).tolist() if key in shared.value else [[0]] * len(at)
                for i, numbers in zip(at, own, strict=True):
                    shards[i] = numbers
            yield pdf.assign(shards=shards)

    return points.mapInPandas(run, points.schema.simpleString()[7:-1] + ",shards:array<int>")


def angles(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The angle of every row of ``x`` with every unit centroid."""
    return np.arccos(np.clip(x @ centers.T / np.linalg.norm(x, axis=1, keepdims=True), -1, 1))


def reaches(placed: DataFrame, centers: dict[tuple, np.ndarray], threshold: float) -> dict[tuple, np.ndarray]:
    """How far from each centroid a vector can be that links with one whose first shard it is (the angles' triangle inequality)."""
    shared = placed.sparkSession.sparkContext.broadcast(centers)

    def run(frames):
        for pdf in frames:
            for key, at, x in by_label(pdf):
                if key in shared.value:
                    own = pdf.iloc[at]
                    cell = own.shards.str[0].to_numpy(dtype=int)
                    yield pd.DataFrame({"label": own.label, "dim": own.dim, "cell": cell, "far": angles(x, shared.value[key])[np.arange(len(x)), cell]})

    schema = placed.select("label", "dim").schema.simpleString()[7:-1]
    out = {key: np.full(len(c), -1.0) for key, c in centers.items()}
    for r in placed.mapInPandas(run, schema + ",cell:int,far:double").groupBy("label", "dim", "cell").agg(F.max("far").alias("far")).collect():  # a row for each centroid
        out[r.label, r.dim][r.cell] = r.far + math.acos(threshold) + 1e-6
    return out


def asked_shards(placed: DataFrame, centers: dict[tuple, np.ndarray], reach: dict[tuple, np.ndarray]) -> DataFrame:
    """``placed`` with ``asks``, all shards that can hold a link of the vector: those whose centroid is within its reach."""
    shared = placed.sparkSession.sparkContext.broadcast((centers, reach))

    def run(frames):
        for pdf in frames:
            asks = pdf.shards.to_numpy(dtype=object, copy=True)
            for key, at, x in by_label(pdf):
                if key in shared.value[0]:
                    for i, near in zip(at, angles(x, shared.value[0][key]) <= shared.value[1][key], strict=True):
                        asks[i] = np.flatnonzero(near).tolist()
            yield pdf.assign(asks=asks)

    return placed.mapInPandas(run, placed.schema.simpleString()[7:-1] + ",asks:array<int>")


def search(points: DataFrame, centers: dict[tuple, np.ndarray], overlap: int, threshold: float, most: int, whole: bool = False) -> DataFrame:
    """(rep, links, root, asked, met, repaired): link counts per shard, and for each linked vector the smallest one it is connected to there.

    A pair is counted in the smallest shard that both vectors share. The roots of all shards span the components. With
    ``whole`` a vector is held by one shard and compared by products in every shard that can hold a link of it, so that
    the result is exact. A row without rep for each searched shard tells how many links its audit asked for, how many
    of these the graph had met, and whether the shard was repaired.
    """
    keys = ["label", "dim", "shard"]
    placed = cut(assign(points, centers, 1 if whole else overlap))
    wide = placed.withColumn("shard", F.explode("shards"))
    parts = wide.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    parts, part = cut(parts), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    wide = cut(wide.join(parts, keys).withColumn("part", part))
    asks = wide
    if whole:
        found = asked_shards(placed, centers, reaches(placed, centers, threshold))
        asks = found.withColumn("shard", F.explode("asks")).drop("asks").withColumn("shards", F.array().cast("array<int>")).join(parts, keys).withColumn("part", part)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf.vec)
        reps = pdf.rep.to_numpy()
        return pd.DataFrame({"rep": reps, "near": [reps[g].tolist() for g in build_graph(x)]})

    lists = wide.groupBy(*keys, "part").applyInPandas(build, "rep long, near array<long>")
    union = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # at most a list for each shard
    nodes = wide.join(cut(union), "rep")
    both = [*keys, "part", "asked"]
    graphs = nodes.withColumn("asked", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asking = asks.select(*(F.col(c).alias("asked" if c == "part" else c) for c in wide.columns)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("rep", "links", "root", "asked", "met", "repaired")}).astype("Int64")
        left, right = left.sort_values("rep", ignore_index=True), right.sort_values("rep", ignore_index=True)
        shard = int(left.shard.iloc[0])
        place = pd.Index(left.rep)
        x = unit(left.vec)
        width = max(map(len, left.near))
        graph = np.full((len(left), max(1, width)), -1, dtype=np.int64)
        for i, near in enumerate(left.near):
            at = place.get_indexer(near)
            at = at[at >= 0]
            graph[i, : len(at)] = at
        raw, ask = np.array(left.vec.tolist(), dtype=float), np.array(right.vec.tolist(), dtype=float)
        at = unit(right.vec)
        reps, asked = left.rep.to_numpy(), right.rep.to_numpy()
        same = len(reps) == len(asked) and bool((reps == asked).all())
        q, k, (true, met, anew) = audited_links(x, graph, at, threshold - 1e-9, same, whole)
        keep = reps[k] != asked[q]
        q, k = q[keep], k[keep]
        exact = np.concatenate([np.einsum("ij,ij->i", raw[k[s : s + 200_000]], ask[q[s : s + 200_000]]) for s in range(0, len(q), 200_000)] or [np.zeros(0)])
        keep = exact / (np.linalg.norm(raw, axis=1)[k] * np.linalg.norm(ask, axis=1)[q]) >= threshold
        q, k = q[keep], k[keep]
        nodes, at = np.unique(np.concatenate([asked[q], reps[k]]), return_inverse=True)
        joined = pd.DataFrame({"rep": nodes, "links": 0, "root": nodes[roots_of(at[: len(q)], at[len(q) :], len(nodes))]})
        # each pair belongs to the smallest shard that both are in
        mine_l, mine_r = ([{int(s) for s in own if s < shard} for own in f.shards] for f in (left, right))
        if any(mine_l) and any(mine_r):
            keep = np.fromiter((not (mine_l[b] & mine_r[a]) for a, b in zip(q, k, strict=True)), bool, len(q))
            q, k = q[keep], k[keep]
        links = np.bincount(q, weights=left.copies.to_numpy()[k], minlength=len(right)).astype("int64")
        audited = pd.DataFrame({"rep": [None], "asked": [true], "met": [met], "repaired": [anew]})
        return pd.concat([pd.DataFrame({"rep": asked, "links": links, "root": asked}), joined[joined["rep"] != joined["root"]], audited]).astype("Int64")

    return graphs.groupBy(*both).cogroup(asking.groupBy(*both)).applyInPandas(find, "rep long, links long, root long, asked long, met long, repaired long")


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def audit(points: DataFrame, found: DataFrame, threshold: float, audited: int) -> tuple[float, list[tuple]]:
    """The recall of ``found`` in the worst class of link counts (1.0 without links), and the (label, dim) below RECALL in a class.

    Of every class of found link counts (powers of two) about ``audited`` vectors are compared with all; every vector
    counts the same, so that a large group does not hide small ones.
    """
    classed = found.withColumn("class", F.floor(F.log2(F.col("links") + 1)))
    rate = F.lit(0.0)
    for r in classed.groupBy("class").count().collect():  # at most 64
        rate = F.when(F.col("class") == r["class"], min(1.0, audited / r["count"])).otherwise(rate)
    some = classed.where(F.pmod(F.xxhash64("rep", F.lit("audit")), F.lit(1 << 30)) < rate * float(1 << 30)).select("rep", "links")
    asked = points.join(F.broadcast(some), "rep").select("rep", "label", "dim", "vec", "links").toPandas()
    if not len(asked):
        return 1.0, []
    groups = {key: (g.rep.to_numpy(), np.array(g.vec.tolist(), dtype=float)) for key, g in asked.groupby(["label", "dim"])}

    def count(frames):
        for pdf in frames:
            for key, g in pdf.groupby(["label", "dim"]):
                if key in groups:
                    reps, q = groups[key]
                    x = np.array(g.vec.tolist(), dtype=float)
                    cos = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])
                    hit = (cos >= threshold) & (reps[:, None] != g.rep.to_numpy()[None])
                    yield pd.DataFrame({"rep": reps, "true": hit @ g.copies.to_numpy()})

    true = points.mapInPandas(count, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true")).toPandas()
    both = asked.merge(true, on="rep").query("true > 0")
    if not len(both):
        return 1.0, []
    both["share"], both["class"] = np.minimum(both.links, both.true) / both.true, np.log2(both.true).astype(int)
    low = both.groupby(["label", "dim", "class"]).share.mean()
    low = sorted({key[:2] for key in low.index[low < RECALL]})
    return float(both.groupby("class").share.mean().min()), [(label, int(dim)) for label, dim in low]


def links_of(pairs: DataFrame) -> DataFrame:
    """(rep, links) of all vectors over all shards of ``search``."""
    return pairs.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))


def graph_report(pairs: DataFrame) -> DataFrame:
    """One row over all shards of ``search``: shards, audited links, graph_recall (1.0 without any) and repaired_share."""
    own = pairs.where("rep is null")
    return own.agg(F.count("*").alias("shards"), F.coalesce(F.sum("asked"), F.lit(0)).alias("audited"), F.coalesce(F.sum("met") / F.nullif(F.sum("asked"), F.lit(0)), F.lit(1.0)).alias("graph_recall"), F.coalesce(F.avg("repaired"), F.lit(0.0)).alias("repaired_share"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, report: dict | None = None) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept, audit_recall.

    Vectors are compared within equal labels and equal dimensions. Null vectors or labels, zero vectors and vectors
    with a null or non-finite component link with nothing and are kept. Bytewise equal vectors of a label are one
    node whose copies all count as links; rows that repeat a vec_id count as vectors of their own where the vector
    is the same. Rows with a null vec_id come back without links, component_id null, kept true. Further columns do
    not come along. audit_recall is the audited recall of the links in the worst class of link counts (1.0 without any).
    ``report`` takes the columns of ``graph_report`` for the last search by graphs, its overlap, and its recall in the
    worst class before labels are searched exactly: links are missed where graphs miss them or no shard holds both ends.
    """
    good = cut(usable(vectors))
    points = cut(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vec")).select("rep", "label", "dim", "vec", "copies"))
    centers = centroids(points, SHARD, CENTROIDS_MOST, SAMPLE)
    overlap = OVERLAP
    while True:
        pairs = cut(search(points, centers, overlap, threshold, SHARD_MOST))
        found = cut(links_of(pairs))
        recall, low = audit(points, found, threshold, AUDITED)
        if not low or overlap >= OVERLAP_MOST:
            break
        overlap += 2
    if report is not None:
        report |= graph_report(pairs).head().asDict() | {"recall": recall, "overlap": overlap}
    if low:  # the labels that overlap does not settle are searched exactly
        keys = F.broadcast(points.sparkSession.createDataFrame([(getattr(x, "item", lambda x=x: x)(), dim) for x, dim in low], points.select("label", "dim").schema))
        redone = cut(points.join(keys, ["label", "dim"], "left_semi").select(*points.columns))
        kept = pairs.join(redone.select("rep"), "rep", "left_anti")
        pairs = cut(kept.unionByName(search(redone, centers, 1, threshold, SHARD_MOST, whole=True)))
        found = cut(links_of(pairs))
        recall, _ = audit(points, found, threshold, AUDITED)
    roots = cut(components(pairs.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))).select(F.col("id").alias("rep"), "component")
    nodes = points.select("rep", "label", "vec", "copies").join(found, "rep", "left").join(roots, "rep", "left")
    nodes = cut(nodes.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = good.join(nodes, ["label", "vec"]).groupBy("vec_id").agg(F.min("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.col("vec_id").isNull() | (F.coalesce("component_id", "vec_id") == F.col("vec_id"))).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP4_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), reach AS (
  SELECT DISTINCT a AS id, a AS to_id FROM links
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a
), roots AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept, 1.0::DOUBLE AS audit_recall
FROM embeddings LEFT JOIN degree ON vec_id = a LEFT JOIN roots ON vec_id = id
"""
