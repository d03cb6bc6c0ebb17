"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer at shared cuts.

The token ends of both tokenizers are increasing byte offsets. In an interval of tokens, the ends of the first tokenizer
are tried from the middle outwards, each looked up among the ends of the second by bisection; the nearest end that both
share cuts the interval in two, and each half goes on by itself. An interval without a shared end is a leaf group.
All open intervals of a batch of texts go through a step together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.common import BROADCAST_ROWS, cut, small_side, text_batches
from rulelens.llm.packing import PATTERN, byte_level, byte_of_char

#: Characters that are aligned at once; a longer text is a batch by itself.
BATCH_CHARS = 1_000_000
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


# ---------------------------------------------------------------- the two tokenizers


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """(encode, token bytes by id) of a byte-level BPE file; strings of special tokens are plain text.

    The same merges run in tiktoken where the file is of the plain kind, otherwise in the tokenizer itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars = byte_of_char()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
    table = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
    for token, i in vocab.items():
        table[i] = bytes(chars[c] for c in token)
    if byte_level(spec):
        import tiktoken

        fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(table) if t}, special_tokens={})
        return lambda texts: [fast.encode_to_numpy(t, disallowed_special=()) for t in texts], table
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, dtype=np.int64) for e in whole.encode_batch(texts, add_special_tokens=False)], table


@lru_cache(maxsize=2)
def piece_bpe(path: str):
    """(encode, token bytes by id) of a sentencepiece file; U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return lambda texts: model.encode(texts, num_threads=1), table


# ---------------------------------------------------------------- shared cuts


def ramp(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), then those of the next, and so on."""
    first = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(start - first, count)


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each of ``a_end`` whether it is a cut: an end of ``b_end`` too. Both increase.

    Intervals [lo, hi) of positions in ``a_end`` are open at first: each is cut at the shared end nearest to its middle,
    found by bisection in rings that double, and both parts go on. One without a shared end is closed as a leaf.
    """
    cut_at = np.zeros(len(a_end), dtype=bool)
    keep = lo < hi
    lo, hi = lo[keep], hi[keep]
    ring = np.zeros(len(lo), dtype=np.int64)
    none = np.iinfo(np.int64).max
    while len(lo):
        mid = (lo + hi) // 2
        start, end = np.maximum(lo, mid - ring), np.minimum(hi, mid + ring + 1)
        tried = ramp(start, end - start)
        found_at = np.minimum(np.searchsorted(b_end, a_end[tried]), len(b_end) - 1)
        away = tried - np.repeat(mid, end - start)
        rank = np.where(b_end[found_at] == a_end[tried], 2 * np.abs(away) + (away > 0), none)
        best = np.minimum.reduceat(rank, np.cumsum(end - start) - (end - start))
        hit = best != none
        at = mid[hit] + np.where(best[hit] & 1, best[hit] >> 1, -(best[hit] >> 1))
        cut_at[at] = True
        wider = ~hit & ((start > lo) | (end < hi))
        lo, hi, ring = (
            np.concatenate([lo[hit], at + 1, lo[wider]]),
            np.concatenate([at, hi[hit], hi[wider]]),
            np.concatenate([np.zeros(2 * len(at), dtype=np.int64), 2 * ring[wider] + 1]),
        )
        keep = lo < hi
        lo, hi, ring = lo[keep], hi[keep], ring[keep]
    return cut_at


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in the order of the written groups, and what follows each: 0 a comma, 1 a bar, 2 a semicolon."""
    side = np.concatenate([a_group * 2, b_group * 2 + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    after = np.full(len(side), 2)
    after[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[:-1] & 1, 2, 1))
    return np.concatenate([a_ids, b_ids])[order], after


@lru_cache(maxsize=1)
def written(most: int) -> list[str]:
    return [f"{i}{mark}" for i in range(most) for mark in ",|;"]


def align_texts(texts: list[str | None], a_path: str, b_path: str) -> dict[str, object]:
    """Counts, group digests and the distinct linked id pairs of each text.

    A null or empty text, or one that either tokenizer does not give back, has no tokens: zeros, '' and no pairs.
    """
    encode_a, bytes_a = byte_bpe(a_path)
    encode_b, bytes_b = piece_bpe(b_path)
    n = len(texts)
    out = {k: np.zeros(n, dtype=np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    out["groups_sha256"] = [""] * n
    some = [i for i, t in enumerate(texts) if t]
    plain = [" " + texts[i] for i in some]
    all_a = [np.asarray(x, dtype=np.int64) for x in encode_a(plain)]
    all_b = [np.asarray(x, dtype=np.int64) for x in encode_b([texts[i] for i in some])] if some else []
    good = []
    for k, (text, a, b) in enumerate(zip(plain, all_a, all_b, strict=True)):
        raw = text.encode("utf-8", "surrogatepass")
        if b"".join(map(bytes_a.__getitem__, a.tolist())) == raw and b"".join(map(bytes_b.__getitem__, b.tolist())) == raw:
            good.append(k)
    if not good:
        return out | {"pair_doc": np.zeros(0, np.int64), "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    length_a, length_b = (np.fromiter(map(len, t), dtype=np.int64, count=len(t)) for t in (bytes_a, bytes_b))
    a_ids, b_ids = np.concatenate([all_a[k] for k in good]), np.concatenate([all_b[k] for k in good])
    a_end, b_end = np.cumsum(length_a[a_ids]), np.cumsum(length_b[b_ids])  # texts stand one behind the other
    n_a, n_b = (np.array([len(x[k]) for k in good]) for x in (all_a, all_b))
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b

    is_cut = shared_cuts(a_end, b_end, a_first, a_first + n_a - 1)
    is_cut[a_first + n_a - 1] = True  # the end of a text
    a_group = np.cumsum(is_cut) - is_cut
    b_cut = np.zeros(len(b_end), dtype=bool)
    b_cut[np.searchsorted(b_end, a_end[is_cut])] = True
    b_group = np.cumsum(b_cut) - b_cut
    ids, after = group_text(a_ids, b_ids, a_group, b_group)
    names = written(max(len(bytes_a), len(bytes_b)))

    # token i of A overlaps the tokens of B from the one that reaches beyond its start to the last that starts before its end
    a_start, b_start = a_end - length_a[a_ids], b_end - length_b[b_ids]
    from_b = np.searchsorted(b_end, a_start, side="right")
    many = np.searchsorted(b_start, a_end, side="left") - from_b
    doc_of = np.repeat(np.arange(len(good)), n_a)
    key = (np.repeat(doc_of * len(bytes_a) + a_ids, many)) * len(bytes_b) + b_ids[ramp(from_b, many)]
    distinct, times = np.unique(key, return_counts=True)
    pair = distinct % (len(bytes_a) * len(bytes_b))

    where = np.array(some)[good]
    out["n_a"][where], out["n_b"][where] = n_a, n_b
    out["n_groups"][where] = np.add.reduceat(is_cut, a_first)
    out["n_links"][where] = np.add.reduceat(many, a_first)
    at = np.cumsum(n_a + n_b) - n_a - n_b
    for i, lo, size in zip(where.tolist(), at.tolist(), (n_a + n_b).tolist(), strict=True):
        line = "".join(map(names.__getitem__, (ids[lo : lo + size] * 3 + after[lo : lo + size]).tolist()))[:-1]
        out["groups_sha256"][i] = hashlib.sha256(line.encode()).hexdigest()
    return out | {"pair_doc": where[distinct // (len(bytes_a) * len(bytes_b))], "pairs": (pair // len(bytes_b) << 32) | pair % len(bytes_b), "times": times}


def text_runs(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` characters, or one text."""
    sizes = [len(t) if t else 0 for t in batch.column("text").to_pylist()]
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield batch.slice(lo)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts, digest, and its distinct linked pairs with their occurrences.

    A pair is the id of A times 2^32 plus that of B. doc_id may be null or repeated: ``row`` numbers the rows.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in text_runs(frame, BATCH_CHARS):
                got = align_texts(part.column("text").to_pylist(), a_path, b_path)
                bounds = pa.array(np.searchsorted(got["pair_doc"], np.arange(len(part) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(got[c], kind)) for c, kind in (("pairs", pa.int64()), ("times", pa.int32()))]
                counts = [pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                columns = [part.column("row"), part.column("doc_id"), *counts, pa.array(got["groups_sha256"], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return text_batches(rows).mapInArrow(run, ALIGNED)


# ---------------------------------------------------------------- counts over the corpus


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (n is the highest of its A id, ties included), from ``aligned`` rows."""
    counts = cut(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_sums(rows: DataFrame, counts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """row, n_best and count_sum of ``aligned`` rows that have pairs; ``counts`` is a cut table.

    The most frequent pairs, at most ``broadcast_rows`` of them, are broadcast: with words as frequent as they are, they
    hold nearly all links, and these need no shuffle. All other pairs are joined by a shuffle; none is left out.
    """
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    total = counts.count()
    if total <= broadcast_rows:
        found = each.join(F.broadcast(counts), "pair")
    else:
        floor = counts.agg(F.percentile_approx("n", 1 - broadcast_rows / 2 / total)).head()[0]
        hot = cut(counts.where(F.col("n") > floor))
        side = small_side(hot, broadcast_rows)
        rare = each.join(side, "pair", "left_anti").join(counts.where(F.col("n") <= floor), "pair")
        found = each.join(side, "pair").unionByName(rare)
    return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null, empty and unreproducible texts have zeros and ''. Texts of any length are aligned whole; repeated rows are
    documents of their own and count each; a null doc_id passes through; other columns do not come along; an empty table
    gives an empty result. Ties of the highest count are all best.
    """
    rows = cut(aligned(docs, a_path, b_path))
    sums = link_sums(rows, cut(pair_counts(rows)), broadcast_rows)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    narrow = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return narrow.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def token_map(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, n, best: how many documents link each pair of ids; the best pairs map A's vocabulary onto B's."""
    pair = F.col("pair")
    return pair_counts(cut(aligned(docs, a_path, b_path))).select(F.shiftright(pair, 32).alias("a_id"), pair.bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "n", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``alignment_report`` of all documents, byte-level BPE against sentencepiece."""
    import public_tokenizers

    return alignment_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
