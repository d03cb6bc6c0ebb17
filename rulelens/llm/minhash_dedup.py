"""MinHash near-duplicates by Order MinHash.

Texts are sequences of words; their k-mers are five words long and labelled with their occurrence number, so that all
k-mers of a text differ. Each sketch takes the smallest k-mers under its own hash and keeps them in text order: two
texts share it if they share those k-mers in that order. Texts that share a sketch are candidates. A candidate pair is
verified by banded alignment of its k-mer sequences: with M aligned k-mers of n and m, the similarity is
M / (n + m - M), the Jaccard similarity of the shingles where they keep their order; 0.8 or more links.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.common import Words, batches, components, cut, mix64, prefix_hash, small_side, span_hash, text_batches, whole_groups

K, SIMILARITY = 5, 0.8
#: Sketches per text and k-mers in each. A pair at similarity 0.8 is missed with probability (1 - 0.8^6)^32 = 6e-5.
SKETCHES, SAMPLED = 32, 6
#: Texts of few k-mers are sampled with fewer: up to SHORT[1] k-mers with SHORT_SAMPLED, above SHORT[0] with SAMPLED.
#: 15 >= 12 / 0.8: any pair that can reach the similarity shares a kind of sketch.
SHORT, SHORT_SAMPLED = (12, 15), 2
#: Fewer k-mers than this reach the similarity only by equality.
FEWEST = 4
#: Texts in a block of a bucket.
BLOCK = 1000

_rng = np.random.default_rng(20240101)
_XOR = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def kmers(texts: list[str | None], k: int = K) -> tuple[np.ndarray, np.ndarray, Words]:
    """Occurrence-labelled k-mer hashes of all texts in order, and where each text's begin (one more entry ends)."""
    _, labelled, first, words = both_kmers(texts, k)
    return labelled, first, words


def both_kmers(texts: list[str | None], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """K-mer hashes of all texts in order, plain and with labels, and where each text's begin (one more entry ends).

    A text of fewer than k words, but at least one, has one k-mer of all its words; words ignore case and ASCII
    punctuation.
    """
    words = Words(texts)
    n_words = np.diff(words.first)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    start = words.first[doc] + np.arange(first[-1]) - first[doc]
    long = np.minimum(k, n_words)[doc]
    padded = np.append(words.hash, np.zeros(k, np.uint64))
    h = np.zeros(first[-1], np.uint64)
    for j in range(k):
        h = mix64(h + np.where(long > j, padded[start + j], np.uint64(j + 1)))
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    label = np.zeros(len(h), np.uint64)
    label[order] = run.astype(np.uint64)
    return h, np.where(label > 0, mix64(h + label * _STEP), h), first, words


def sketches(h: np.ndarray, sampled: int) -> np.ndarray:
    """The order sketches of one text's k-mers: SKETCHES hashes of ``sampled`` smallest k-mers in text order."""
    sampled = min(sampled, len(h))
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(sampled)
    rows = max(1, 1_000_000 // len(h))
    for lo in range(0, SKETCHES, rows):
        part = slice(lo, lo + rows)
        v = (h[None, :] ^ _XOR[part, None]) * _MUL[part, None]
        at = np.argpartition(v, sampled - 1, axis=1)[:, :sampled] if sampled < len(h) else np.broadcast_to(np.arange(len(h)), (len(v), len(h)))
        taken = h[np.sort(at, axis=1)]
        key = out[part]
        for j in range(sampled):
            key = mix64(key * _STEP + taken[:, j])
        out[part] = key
    return out


def content_hashes(texts: list[str | None], h: np.ndarray, first: np.ndarray, words: Words) -> list[tuple[int, int] | tuple[None, None]]:
    """128 bits that stand for a text's words (for its bytes, if it has none); none for null and empty texts."""
    out = []
    for i, t in enumerate(texts):
        own = words.hash[words.first[i] : words.first[i + 1]]
        if not len(own) and t:
            data = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            own = span_hash(prefix_hash(data), np.array([0]), np.array([len(data)])) ^ np.uint64(1)
        if not len(own):
            out.append((None, None))
            continue
        place = np.arange(1, len(own) + 1, dtype=np.uint64)
        pair = (mix64(own + place * _STEP).sum(dtype=np.uint64), mix64(own ^ mix64(place)).sum(dtype=np.uint64))
        out.append(tuple(int(x) for x in np.array(pair, dtype=np.uint64).astype(np.int64)))
    return out


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, n (k-mers), c1, c2 (content) and keys (sketches; empty where only equal texts can link)."""

    def run(frames):
        for pdf in batches(frames):
            texts = [None if pd.isna(t) else t for t in pdf.text]
            h, first, words = kmers(texts)
            content = content_hashes(texts, h, first, words)
            keys = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                own, n = h[a:b], b - a
                kinds = [s for s, on in ((SHORT_SAMPLED, n <= SHORT[1]), (SAMPLED, n > SHORT[0])) if on and n >= FEWEST]
                keys.append(np.concatenate([sketches(own, s) for s in kinds]).astype(np.int64).tolist() if kinds else [])
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n": np.diff(first).astype(np.int32), "c1": pd.array([c[0] for c in content], dtype="Int64"), "c2": pd.array([c[1] for c in content], dtype="Int64"), "keys": keys})

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n int, c1 long, c2 long, keys array<long>")


def increasing(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within the band, by bits of long integers.

    Every pairing of places at most ``band`` apart is considered, and some up to a sixteenth further. Bit i of ``left``
    stands for place low + i of ``a``, 0 where a common subsequence grows there. The window of places within the band
    moves along ``b`` in steps: what leaves it can grow no more.
    """
    ends = []
    for step in (1, -1):
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[::step][:n] != b[::step][:n])
        ends.append(int(differ[0]) if len(differ) else n)
        a, b = (x[::step][ends[-1] :][::step] for x in (a, b))
    names, code = np.unique(a, return_inverse=True)
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(len(names) + 1)).tolist()
    found = np.searchsorted(names, b)
    found[found == len(names)] = 0
    known = names[found] == b if len(names) else np.zeros(len(b), bool)
    # places of a k-mer are walked while they are few, and kept as one long integer where they are many
    many, masks = max(64, len(a) // 500), {}
    step = max(1, band // 16)
    width = 2 * band + 1 + step
    full = (1 << width) - 1
    left, low, grown = full, -band, 0
    for j in np.flatnonzero(known).tolist():
        move = j - band - low
        if move >= step:
            # growth that leaves the window is kept as a number
            out = min(move, width)
            grown += out - (left & ((1 << out) - 1)).bit_count()
            left = (left >> out) | (full ^ (full >> out))
            low += move
        c = found[j]
        lo, hi = first[c], first[c + 1]
        if hi - lo > many:
            if c not in masks:
                bits = np.zeros(len(a), np.uint8)
                bits[order[lo:hi]] = 1
                masks[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            mask = (masks[c] >> low if low >= 0 else masks[c] << -low) & full
        else:
            bits = bytearray(width // 8 + 1)
            for i in order[lo:hi].tolist():
                if low <= i < low + width:
                    bits[(i - low) >> 3] |= 1 << ((i - low) & 7)
            mask = int.from_bytes(bits, "little")
        both = left & mask
        left = ((left + both) | (left - both)) & full
    return sum(ends) + grown + width - left.bit_count()


def alignment(a: np.ndarray, b: np.ndarray, similarity: float, plain_a: np.ndarray | None = None, plain_b: np.ndarray | None = None) -> float:
    """Similarity of two sequences of distinct k-mers by their best alignment within the band.

    Where k-mers repeat, ``plain_a`` or ``plain_b`` has them without labels, and the best alignment of these, within the
    same band, decides when that of the labelled ones falls short.

    Where the similarity is reached at all, at most (n + m) / 9 k-mers (for 0.8) of a text are unaligned, so aligned
    places differ by no more than that. As k-mers are distinct, the best alignment is the longest increasing chain of
    equal k-mers inside the band.
    """
    n, m = len(a), len(b)
    if min(n, m) < similarity * max(n, m):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < similarity * (n + m - len(at_a)):
        return 0.0
    band = int((n + m) * (1 - similarity) / (1 + similarity)) + 1
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    aligned = increasing(at_b[np.abs(at_a - at_b) <= band])
    if aligned < similarity * (n + m - aligned) and (plain_a is not None or plain_b is not None):
        a, b = (a if plain_a is None else plain_a), (b if plain_b is None else plain_b)
        n, m = len(a), len(b)
        aligned = common(a, b, band)
    return aligned / (n + m - aligned)


def plain_of(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.frombuffer(data, np.int64)


def verified(pairs: DataFrame, tokens: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs(a, b)`` that reach the similarity; ``tokens(rep, kmers, plain)`` holds both texts' k-mers."""

    def run(frames):
        for pdf in frames:
            ok = [alignment(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), similarity, plain_of(p), plain_of(q)) >= similarity for x, y, p, q in zip(pdf.ka, pdf.kb, pdf.pa, pdf.pb, strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    left = tokens.select(F.col("rep").alias("a"), F.col("kmers").alias("ka"), F.col("plain").alias("pa"))
    right = tokens.select(F.col("rep").alias("b"), F.col("kmers").alias("kb"), F.col("plain").alias("pb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def token_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, kmers (64-bit hashes as bytes) and, where k-mers repeat, plain (without labels) of the documents named in ``ids(rep)``."""

    def run(frames):
        for pdf in batches(frames):
            plain, h, first, _ = both_kmers(pdf.text.tolist())
            h, plain = h.view(np.int64), plain.view(np.int64)
            spans = list(zip(first[:-1], first[1:], strict=True))
            yield pd.DataFrame({"rep": pdf.rep, "kmers": [h[a:b].tobytes() for a, b in spans], "plain": [None if (h[a:b] == plain[a:b]).all() else plain[a:b].tobytes() for a, b in spans]})

    mine = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(small_side(ids), "rep", "left_semi")
    return mine.mapInPandas(run, "rep long, kmers binary, plain binary").dropDuplicates(["rep"])


def bucket_links(pdf: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links between texts of one group of ``dealt`` that are in different components, as many as join components.

    The group's own texts outside the main component (``few`` = ``f``) are compared with its block of all texts
    (``own`` = ``block``). Shared k-mers are counted by an index of the block's k-mers; only pairs that can reach the
    similarity are aligned. Two texts outside the main component are compared once, where the larger id asks.
    """
    f, block = pdf.f.iloc[0], pdf.block.iloc[0]
    reps, comps, few = pdf.rep.to_numpy(), pdf.component.to_numpy(), pdf.few.to_numpy()
    asked, members = np.flatnonzero(few == f), np.flatnonzero(pdf.own.to_numpy() == block)
    if not len(asked) or not len(members):
        return []
    own = [np.frombuffer(k, np.int64) for k in pdf.kmers]
    plain = [plain_of(k) for k in pdf.plain]
    size = np.array([len(k) for k in own])
    every, doc = np.concatenate([own[j] for j in members]), np.repeat(np.arange(len(members)), size[members])
    order = np.argsort(every, kind="stable")
    every, doc = every[order], doc[order]
    names, group = np.unique(comps, return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in asked:
        lo, hi = np.searchsorted(every, own[i]), np.searchsorted(every, own[i], side="right")
        long = hi - lo
        at = np.repeat(lo, long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        both = np.bincount(doc[at], minlength=len(members))
        near = both >= similarity * (size[i] + size[members] - both)
        near &= (few[members] < 0) | (reps[members] < reps[i])
        for j in members[near]:
            x, y = find(group[i]), find(group[j])
            if x != y and alignment(own[i], own[j], similarity, plain[i], plain[j]) >= similarity:
                root[x] = y
                links.append((max(reps[i], reps[j]), min(reps[i], reps[j])))
    return links


def dealt(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Groups (key, f, block) of the texts of open buckets, ``rows(key, rep, component)``; rep, component, few and own.

    The main component of a bucket is its largest. Its texts, and all others, are dealt out over blocks of ``most``
    (``own``); the texts outside it are also dealt out over blocks of their own (``few``; -1 in the main component), and
    each such block meets each block of all texts once. So a text of the main component goes to as many groups as there
    are blocks outside it: one, however many copies the main component holds, while ``most`` texts or fewer are not in it.
    """
    most = most or BLOCK
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    plan = parts.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1 and c > 2")
    plan = plan.select("key", F.col("main.component").alias("main"), F.ceil(F.col("c") / most).cast("int").alias("blocks"), F.ceil((F.col("c") - F.col("main.c")) / most).cast("int").alias("few_blocks"))
    each = rows.join(plan, "key")
    each = each.withColumns({"own": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "few": F.when(F.col("component") == F.col("main"), -1).otherwise(F.pmod(F.xxhash64("rep", F.lit("few")), F.col("few_blocks"))).cast("int")})
    place = lambda f, block: F.struct(f.alias("f"), block.alias("block"))
    answers = F.transform(F.sequence(F.lit(0), F.col("few_blocks") - 1), lambda f: place(f, F.col("own")))
    asks = F.when(F.col("few") < 0, F.array().cast("array<struct<f:int,block:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda block: place(F.col("few"), block)))
    return each.select("key", "rep", "component", "few", "own", F.explode(F.array_union(answers, asks)).alias("x")).select("key", "x.*", "rep", "component", "few", "own")


def linked_in_buckets(rows: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components within buckets; ``rows(key, rep, component)``.

    No group holds more than two blocks of texts (``dealt``).
    """
    keys = ["key", "f", "block"]

    def run(frames):
        for group in whole_groups(frames, keys):
            links = bucket_links(group, similarity)
            yield pd.DataFrame({"a": [x[0] for x in links], "b": [x[1] for x in links]}, dtype="int64")

    return dealt(rows).join(tokens, "rep").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def one_document(member: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of a doc_id that stands on several texts; ``member(doc_id, rep)``."""
    several = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top")
    return member.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, class_id (smallest doc_id of its group), kept.

    Groups are the components of links between texts of at least ``similarity``, and of equal texts (equal up to
    case and ASCII punctuation; texts without words, if bytewise equal). Null and empty texts and texts without
    doc_id stand alone and are kept; class_id is null without doc_id. A repeated doc_id names one document: its
    rows share a class. Extra columns of ``docs`` do not come along; an empty table gives an empty result.

    Copies of a text are one class before anything is compared. In each sketch bucket every text is compared with
    the bucket's smallest id; components of those links are formed; then texts of one bucket that are still in
    different components are compared within the bucket, so that no pairs are ever shuffled and only texts outside a
    bucket's largest component go to several of its blocks.
    """
    table = cut(sketch_table(docs))
    named = table.where("doc_id is not null and c1 is not null")
    classes = cut(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    rows = classes.select("rep", "n", F.explode("keys").alias("key"))
    lead = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("b"), F.max("rep").alias("top")).where("c > 1 and b < top")
    shared = cut(rows.join(lead.select("key", "b"), "key"))
    tokens = cut(token_table(docs, cut(shared.select("rep").distinct())))
    first = cut(shared.where("rep <> b").select(F.col("rep").alias("a"), "b").distinct())
    member = cut(named.select("doc_id", "c1", "c2").join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).select("doc_id", "rep"))
    links = cut(verified(first, tokens, similarity).union(one_document(member)))
    comp = cut(components(links))

    placed = cut(shared.select("key", "rep").join(small_side(comp.withColumnRenamed("id", "rep")), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    more = cut(linked_in_buckets(placed, tokens, similarity))
    if more.head() is not None:
        comp = cut(components(links.union(more)))

    member = member.join(small_side(comp.withColumnRenamed("id", "rep")), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    member = member.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = table.select("doc_id").join(member, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "class_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the row whose doc_id is the smallest; all columns stay.

    Of rows that repeat a doc_id one stays; rows without doc_id, and null and empty texts, stay. Columns of any name
    pass through; an empty table stays empty.
    """
    found = cut(near_duplicates(docs))
    gone = cut(found.where("not kept").select("doc_id").distinct())
    out = docs.join(small_side(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head() is not None:
        out = out.where("doc_id is null").unionByName(out.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return out


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every whole text of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
