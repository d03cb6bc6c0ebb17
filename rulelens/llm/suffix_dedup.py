"""Removal of long byte strings that occur more than once, by suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts somewhere else is removed. Windows are first dealt out
by an anchor, the smallest gram that a window holds: equal windows have equal anchors at equal places, so they meet.
Runs of windows whose anchors occur once cannot repeat; runs that are equal as a whole repeat as a whole. What is left
(the rims of repeated passages) goes through suffix arrays: two-stage sorting directly sorts only the suffixes that are
smaller than their successors, induces the others by bucket scans, and adjacent common prefixes of LENGTH or more mark
repeated windows. Anchors with many different surroundings are split by the anchor's place within the window and by the
bytes that all windows of such a place share; a part that still has many is resolved by counting its windows, which
combines before the shuffle. So no array, and no task, takes more than a bounded number of surroundings of one anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.common import batches, cut, mix64, prefix_hash, runs, small_side, span_hash, text_batches

LENGTH, GRAM = 200, 50
KEY = ["k", "q"]
#: Different surroundings of an anchor up to which a suffix array takes it as a whole, and bytes sorted in one array.
GROUP_MOST, ARRAY_BYTES = 1_000, 1_000_000
#: Places of an anchor within the window that stay together where an anchor is split.
STEP = 16


# ---------------------------------------------------------------- anchors


def anchored(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of window starts that share their anchor, the leftmost smallest gram within the window.

    Gives for each run the number of its text, the first and last start there, the anchor's start ``p`` and hash ``f``
    and a hash ``whole`` of all bytes of the run's windows and the anchor's place among them.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n, width = len(data), length - gram + 1
    starts = np.arange(max(0, n - length + 1))
    doc = np.searchsorted(base, starts, side="right") - 1
    ok = starts + length <= base[doc + 1]
    if not ok.any():
        return {name: np.zeros(0, np.int64) for name in ("doc", "s0", "s1", "p", "f", "whole")}
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    # smallest (hash, place) in every window: minima of blocks from both ends
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[starts], ahead[starts + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts, anchor, doc = starts[ok], anchor[ok], doc[ok]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    s0, s1, p, d = starts[new], starts[last], anchor[new], doc[new]
    whole = mix64(span_hash(prefix, s0, s1 + length) + (p - s0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {"doc": d, "s0": s0 - base[d], "s1": s1 - base[d], "p": p - base[d], "f": grams[p].astype(np.int64), "whole": whole.astype(np.int64)}


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """k, q, s0, s1, p, f, whole of every run of ``docs(k, q, text)``."""

    def run(frames):
        for pdf in batches(frames):
            out = anchored([t.encode("utf-8", "surrogatepass") for t in pdf.text], length)
            yield pd.DataFrame({"k": pdf.k.to_numpy()[out["doc"]], "q": pdf.q.to_numpy()[out["doc"]], "s0": out["s0"].astype(np.int32), "s1": out["s1"].astype(np.int32), "p": out["p"].astype(np.int32), "f": out["f"], "whole": out["whole"]})

    return text_batches(docs).where(F.octet_length("text") >= length).select("k", "q", "text").mapInPandas(run, "k long, q long, s0 int, s1 int, p int, f long, whole long")


# ---------------------------------------------------------------- suffix arrays


def words_at(data: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from every place as one number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(beyond + 8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)


def direct_sort(words: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """``pos`` in the order of the suffixes there, compared to ``depth`` bytes: ties are refined word by word."""
    first = words[pos]
    by = np.argsort(first, kind="stable")
    order, key = pos[by], first[by]
    tied = np.r_[False, key[1:] == key[:-1]]
    group = np.maximum.accumulate(np.where(tied, 0, np.arange(len(order))))
    at = np.flatnonzero(tied | np.r_[tied[1:], False])
    for k in range(8, depth, 8):
        if not len(at):
            break
        word, g = words[order[at] + k], group[at]
        by = np.lexsort((word, g))
        order[at], word = order[at][by], word[by]
        same = np.r_[False, (g[1:] == g[:-1]) & (word[1:] == word[:-1])]
        group[at] = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
        at = at[same | np.r_[same[1:], False]]
    return order


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, words) of ``data``; suffixes equal over ``depth`` bytes stand together in any order.

    Two-stage sorting: a suffix smaller than its successor is sorted directly. The others are induced by one scan
    over the buckets (first bytes) in order: within a bucket they come first, and each placed suffix whose
    predecessor is one of them puts that predecessor next in its bucket.
    """
    n = len(data)
    words = words_at(data, depth + 8)
    step = np.concatenate([np.diff(data.astype(np.int16)), [-1]])
    nxt = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = step[nxt] > 0
    sorted_small = direct_sort(words, np.flatnonzero(small), depth)
    small_at = np.searchsorted(data[sorted_small], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[n - 1]].append(np.array([n - 1]))  # the empty suffix stands before all
    out = []

    def place(scanned: np.ndarray, c: int) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        before = before[data[before] != c]
        byte = data[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        if len(byte):
            for lo, hi in zip(*runs(byte), strict=True):
                induced[byte[lo]].append(before[lo:hi])

    for c in range(256):
        if induced[c]:
            # runs of one byte: a predecessor in the same bucket follows what induces it
            part = np.concatenate(induced[c])
            parts = [part]
            while len(part):
                part = part[part > 0] - 1
                part = part[~small[part] & (data[part] == c)]
                parts.append(part)
            own = np.concatenate(parts)
            out.append(own)
            place(own, c)
        direct = sorted_small[small_at[c] : small_at[c + 1]]
        if len(direct):
            out.append(direct)
            place(direct, c)
    return np.concatenate(out), words


def repeated_starts(data: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places start a window that another ``valid`` place starts too, by adjacent common prefixes."""
    order, words = suffix_array(data, length)
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    whole, rest = length // 8 * 8, length % 8
    for k in range(0, whole, 8):
        live = live[words[a[live] + k] == words[b[live] + k]]
    if rest:
        shift = np.uint64(64 - 8 * rest)
        live = live[words[a[live] + whole] >> shift == words[b[live] + whole] >> shift]
    out = np.zeros(len(data), bool)
    out[a[live]] = out[b[live]] = True
    return out


def sorted_groups(slices: DataFrame, length: int) -> DataFrame:
    """k, q, lo, hi: byte spans covered by repeated windows among ``slices(f, k, q, s0, s1, part)``, compared within each f."""

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(pdf.part), dtype=np.uint8)
        size = pdf.part.str.len().to_numpy()
        base = np.cumsum(size) - size
        count = size - length + 1
        row = np.repeat(np.arange(len(pdf)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + base[row]
        valid = np.zeros(len(data), bool)
        valid[at] = True
        hit = repeated_starts(data, valid, length)[at]
        row, at = row[hit], at[hit]
        if not len(at):
            return pd.DataFrame({"k": [], "q": [], "lo": [], "hi": []})
        lo = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])
        hi = np.r_[lo[1:], len(at)] - 1
        start = pdf.s0.to_numpy() - base
        return pd.DataFrame({"k": pdf.k.to_numpy()[row[lo]], "q": pdf.q.to_numpy()[row[lo]], "lo": at[lo] + start[row[lo]], "hi": at[hi] + start[row[hi]] + length})

    def run(frames):
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = held.f.iloc[-1]
            whole = held[held.f != last]
            if whole.part.str.len().sum() >= ARRAY_BYTES:
                held = held[held.f == last]
                yield from arrays(whole)
        if held is not None and len(held):
            yield from arrays(held)

    def arrays(pdf: pd.DataFrame):
        f, total = pdf.f.to_numpy(), pdf.part.str.len().cumsum().to_numpy()
        lo = 0
        while lo < len(pdf):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + ARRAY_BYTES))
            hi = int(np.searchsorted(f, f[min(hi, len(f) - 1)], side="right")) if hi < len(f) else len(f)
            yield spans(pdf.iloc[lo:hi]).astype({"k": "int64", "q": "int64", "lo": "int32", "hi": "int32"})
            lo = hi

    return slices.repartition("f").sortWithinPartitions("f").mapInPandas(run, "k long, q long, lo int, hi int")


def split_anchors(slices: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of parts that repeat as a whole, and the parts that are left, of ``slices(f, k, q, s0, s1, p, kinds, part)``.

    Equal windows have their anchor at equal places. Windows with the anchor at STEP neighbouring places share all but
    STEP - 1 bytes, so these bytes and the places say where equal windows meet: they are the new f. Parts that are equal
    give one of them; an f with one kind of part is done. Two windows of one part differ in the anchor's place.
    """
    at, p, s0, s1 = F.col("at"), F.col("p"), F.col("s0"), F.col("s1")
    lo, hi = F.greatest(s0, p - at * STEP - (STEP - 1)), F.least(s1, p - at * STEP)
    each = slices.withColumn("at", F.explode(F.sequence(F.expr(f"cast((p - s1) div {STEP} as int)"), F.expr(f"cast((p - s0) div {STEP} as int)"))))
    shared, own = F.substring("part", p - at * STEP - s0 + 1, F.lit(length - STEP + 1)), F.substring("part", lo - s0 + 1, hi - lo + length)
    each = each.select(F.xxhash64("f", "at", shared).alias("f"), F.xxhash64(own, p - lo).alias("w1"), F.xxhash64(p - lo, own).alias("w2"), *KEY, s0.alias("run"), lo.alias("s0"), hi.alias("s1"))
    each = cut(each)
    kinds = cut(each.groupBy("f", "w1", "w2").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "run", "s0", "s1")).alias("r")))
    alike = each.join(kinds.where("c > 1").select("f", "w1", "w2"), ["f", "w1", "w2"]).select(*KEY, F.col("s0").alias("lo"), (F.col("s1") + length).alias("hi"))
    several = kinds.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1")
    left = kinds.select("f", "r.*").join(several, "f").join(slices.select(*KEY, F.col("s0").alias("run"), "part"), [*KEY, "run"])
    return alike, cut(left.select("f", *KEY, "s0", "s1", "kinds", F.substring("part", s0 - F.col("run") + 1, s1 - s0 + length).alias("part")))


def counted_groups(slices: DataFrame, length: int) -> DataFrame:
    """The same spans by counting windows (128-bit hashes)."""
    each = slices.select("k", "q", "part", "s0", F.explode(F.sequence(F.lit(0), F.col("s1") - F.col("s0"))).alias("i"))
    window = F.substring("part", F.col("i") + 1, F.lit(length))
    each = each.select("k", "q", (F.col("s0") + F.col("i")).alias("lo"), F.xxhash64(window, F.lit("a")).alias("h1"), F.xxhash64(F.lit("b"), window).alias("h2"))
    many = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return each.join(many, ["h1", "h2"]).select("k", "q", F.col("lo").cast("int").alias("lo"), (F.col("lo") + length).cast("int").alias("hi"))


# ---------------------------------------------------------------- the operator


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the row's key of 128 bits (k, q); equal rows share it, and repeat each other anyway."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(row_key(F.col("doc_id"), F.col("text")))


def row_key(doc_id: Column, text: Column) -> dict[str, Column]:
    return {"k": F.xxhash64(doc_id, text), "q": F.xxhash64(F.lit("q"), text, doc_id)}


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """k, q and spans (array of lo, hi byte places, may overlap) of the rows of ``keyed`` that hold repeated windows."""
    table = cut(anchors(rows, length))
    often = cut(table.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"))  # a join of its own can split a hot anchor
    shared = cut(table.join(often, "f"))
    kinds = cut(shared.groupBy("f", "whole").agg(F.count("*").alias("c"), F.min(F.struct("k", "q", "s0", "s1", "p")).alias("r")))
    same = shared.join(kinds.where("c > 1").select("f", "whole"), ["f", "whole"]).select(*KEY, F.col("s0").alias("lo"), (F.col("s1") + length).alias("hi"))

    several = kinds.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1")
    rims = cut(kinds.select("f", "r.*").join(several, "f"))
    per_row = cut(rims.groupBy(*KEY).agg(F.collect_list(F.struct("f", "s0", "s1", "p", "kinds")).alias("runs")))  # at most a row's own runs
    texts = rows.select(*KEY, F.encode("text", "utf-8").alias("bytes")).join(small_side(per_row.select(*KEY)), KEY, "left_semi")
    part = lambda r: F.struct(r["f"].alias("f"), r["s0"].alias("s0"), r["s1"].alias("s1"), r["p"].alias("p"), r["kinds"].alias("kinds"), F.substring("bytes", r["s0"] + 1, r["s1"] - r["s0"] + length).alias("part"))
    # rows that are equal give each run once
    sliced = texts.dropDuplicates(KEY).join(per_row, KEY).select(*KEY, F.explode(F.transform("runs", part)).alias("x")).select(*KEY, "x.*")
    sliced = cut(sliced)
    few, hot = sliced.where(F.col("kinds") <= GROUP_MOST).drop("p"), sliced.where(F.col("kinds") > GROUP_MOST)
    spans = same
    if hot.head() is not None:
        alike, parts = split_anchors(hot, length)
        spans = spans.union(alike).union(counted_groups(parts.where(F.col("kinds") > GROUP_MOST), length))
        few = few.unionByName(parts.where(F.col("kinds") <= GROUP_MOST))
    spans = spans.union(sorted_groups(few, length))
    return cut(spans.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))


def merged(spans, n: int) -> list[tuple[int, int]]:
    """Maximal disjoint spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, min(hi, n)) for lo, hi in out]


def with_spans(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with repeated spans and these, rows without); only the former's texts are shuffled while keys are few."""
    some = small_side(spans.select(*KEY))
    return rows.join(some, KEY, "left_semi").join(spans, KEY), rows.join(some, KEY, "left_anti")


def dedup_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs(doc_id, text)``.

    Strings are judged on the input; overlaps count; nothing crosses documents. A null text is empty. Rows that
    repeat (also with a null doc_id) are each other's copies, so all of their long strings go. Texts shorter than
    ``length`` bytes stay; texts of any length are read whole; an empty table gives an empty result. Extra columns do not
    come along.
    """
    rows = keyed(docs)
    hit, free = with_spans(rows, repeated_spans(rows, length))

    def run(frames):
        for pdf in frames:
            out = []
            for doc, text, spans in zip(pdf.doc_id, pdf.text, pdf.spans, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = merged([(s["lo"], s["hi"]) for s in spans], len(data))
                kept = b"".join(data[a:b] for a, b in zip([0, *(hi for _, hi in gone)], [*(lo for lo, _ in gone), len(data)], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    some = hit.select(F.col("doc_id").cast("long"), "text", "spans").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rest = free.select(F.col("doc_id").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
    return some.union(rest)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of text (where a cut splits a character its rest goes too).

    All columns and rows stay, whatever their names, other columns unchanged; texts without repeats, null ones
    included, stay as they are. Rows that repeat as a whole lose all their long strings; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"))  # so that columns of any name pass through
    rows = rows.withColumns(row_key(F.col("row.doc_id"), F.coalesce("row.text", F.lit(""))))

    @F.pandas_udf("string")
    def cut_out(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            data = t.encode("utf-8", "surrogatepass")
            gone = merged([(s["lo"], s["hi"]) for s in own], len(data))
            out.append(b"".join(data[a:b] for a, b in zip([0, *(hi for _, hi in gone)], [*(lo for lo, _ in gone), len(data)], strict=True)).decode("utf-8", "ignore"))
        return pd.Series(out)

    hit, free = with_spans(rows, repeated_spans(keyed(docs), length))
    own = [cut_out("row.text", "spans").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return hit.select(*own).union(free.select("row.*"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that remain of every whole text of ``documents``."""
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
