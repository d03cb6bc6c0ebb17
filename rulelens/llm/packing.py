"""Best-fit packing of token pieces into sequences by a linear grouping scheme.

Piece lengths are integers up to the capacity, so their histogram (at most ``capacity`` numbers) says all that the
optimiser needs: large lengths are rounded up within groups of equal cardinality, the configuration programme over
those few sizes is solved by column generation, actual lengths take the rounded places, and what is left, the small
ones above all, is placed best-fit. The plan is a short list of (number of sequences, lengths in each); pieces take
their places by their rank among the pieces of equal length, which a salted window counts.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulelens.llm.common import BROADCAST_ROWS, batches, cut, small_side, text_batches

CAPACITY, END_ID = 1024, 2
#: Plans tried, the one with the fewest sequences wins: number of groups for the rounding, and places that a sequence of
#: actual large lengths may keep free before small ones are added.
TRIED = ((24, 0), (24, 4), (48, 1))
#: Lengths up to this share of the capacity are small.
SMALL = 1 / 8
#: Pivots of the column generation at most; it only ends the search for a better plan.
PIVOTS = 1500
#: The byte-level vocabulary's splitting pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_level(spec: dict) -> bool:
    """Whether merging by id, after splitting by PATTERN, gives the ids of this tokenizer."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["merges"]]
    return all(a < b for a, b in zip([-1, *made], made))  # noqa: B905  merges come in the order of their ids


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from text to ids for the byte-level BPE file at ``path`` (special strings become their ids).

    The same merges run in tiktoken, which is several times faster, where the file is of that plain kind; other files,
    and texts that hold a special token's string, go to the tokenizer itself.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    fast = None
    if byte_level(spec):
        chars = byte_of_char()
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1)
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if fast is None or any(s in text for s in special):
            return np.array(whole().encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or pieces of the capacity of which the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    A null text is empty (its one piece is the end id). doc_id may be null or repeated: each row is cut by itself.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for pdf in batches(frames):
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                doc = None if pd.isna(doc) else int(doc)
                all_ids = np.append(encode(text) if text else np.zeros(0, "<u4"), np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(cut_points(len(all_ids), capacity)):
                    part = all_ids[at : at + n]
                    rows.append((doc, k, at, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])
            yield out.astype({"doc_id": "Int64"})

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES + (", ids array<int>" if ids else ""))


# ---------------------------------------------------------------- the plan over lengths

Bins = list[tuple[int, tuple[int, ...]]]


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping: (rounded size, [(length, count), ...] from the longest) for groups of equal cardinality."""
    most = -(-sum(counts.values()) // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                if out and out[-1][0] == length:  # the group before ended within this length: nothing is rounded
                    out[-1][1].append((length, left))
                    break
                out.append((length, []))
                room = most
            n = min(left, room)
            out[-1][1].append((length, n))
            room, left = room - n, left - n
    return out


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = sizes <= c
        gain = np.where(fits, worth[np.where(fits, c - sizes, 0)] + value, -1.0)
        k = int(gain.argmax())
        worth[c], last[c] = (gain[k], k) if gain[k] > worth[c - 1] + 1e-12 else (worth[c - 1], -1)
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(worth[capacity]), pattern


def configurations(sizes: list[int], need: list[int], capacity: int, pivots: int) -> list[tuple[int, np.ndarray]]:
    """(whole number of sequences, pattern over sizes) from the configuration programme, rounded down."""
    size, want = np.array(sizes), np.array(need, dtype=float)
    basis = np.diag(np.floor(capacity / size))
    for _ in range(pivots):
        value = np.linalg.solve(basis.T, np.ones(len(size)))
        worth, pattern = best_pattern(size, value, capacity)
        if worth <= 1 + 1e-7:
            break
        level, way = np.linalg.solve(basis, want), np.linalg.solve(basis, pattern)
        ratio = np.where(way > 1e-9, np.maximum(level, 0) / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    level = np.linalg.solve(basis, want)
    return [(int(x + 1e-6), basis[:, k].astype(int)) for k, x in enumerate(level) if x + 1e-6 >= 1]


def best_fit(bins: Bins, counts: dict[int, int], capacity: int) -> Bins:
    """Place ``counts`` by decreasing length into the sequence with the least room that suffices, or a new one.

    Equal lengths are placed together, as many into one sequence as best-fit would put there one by one.
    """
    by_room: list[Bins] = [[] for _ in range(capacity + 1)]
    for n, lengths in bins:
        by_room[capacity - sum(lengths)].append((n, lengths))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, capacity + 1):
            while left and by_room[room]:
                n, lengths = by_room[room].pop()
                each = min(room // length, left)
                used = min(n, left // each)
                by_room[room - each * length].append((used, lengths + (length,) * each))
                if n > used:
                    by_room[room].append((n - used, lengths))
                left -= used * each
        each = capacity // length
        for per, n in ((each, left // each), (left % each, 1)):
            if per and n:
                by_room[capacity - per * length].append((n, (length,) * per))
    return [b for same in by_room for b in same]


def substitute(places: list[int], rest: dict[int, int], capacity: int, small: int) -> list[int]:
    """Actual lengths for the rounded places of one sequence: the longest left that fits each place.

    The last place takes the longest that the sequence has room for. A longer length than its place leaves a shorter
    one for a place of the longer group, so all places can still be taken.
    """
    free, lengths = Counter(), []
    for k, place in enumerate(places):
        most = capacity - sum(lengths) if k == len(places) - 1 else place
        length = next((x for x in range(min(most, capacity - 1), small, -1) if rest.get(x, 0) > free[x]), None)
        if length is not None:
            free[length] += 1
            lengths.append(length)
    return lengths


def plan_for(counts: dict[int, int], groups: int, capacity: int, small: int, pivots: int = PIVOTS, slack: int = 0) -> Bins:
    """One plan: linear grouping, configurations, substitution, best-fit.

    Sequences that substitution leaves with more than ``slack`` free are not taken: what is left of the large
    lengths is grouped again, as long as a round takes a fair part of it; best-fit places the rest.
    """
    rest = dict(counts)
    bins: Bins = []
    while True:
        large = {k: n for k, n in rest.items() if n and small < k < capacity}
        before = sum(large.values())
        if not before:
            break
        grouped = group_sizes(large, groups)
        for times, pattern in configurations([s for s, _ in grouped], [sum(n for _, n in items) for _, items in grouped], capacity, pivots):
            places = [grouped[k][0] for k, n in enumerate(pattern) for _ in range(n)]
            while times:
                lengths = substitute(places, rest, capacity, small)
                if sum(lengths) < capacity - slack:
                    break
                run = min([times, *(rest[length] // n for length, n in Counter(lengths).items())])
                for length, n in Counter(lengths).items():
                    rest[length] -= n * run
                bins.append((run, tuple(lengths)))
                times -= run
        if sum(n for k, n in rest.items() if small < k < capacity) > 0.9 * before:
            break
    return best_fit(bins, {k: n for k, n in rest.items() if n}, capacity)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """The best of the tried plans: [(number of sequences, lengths in each)]."""
    if not counts:
        return []
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    best: Bins = []
    for groups, slack in TRIED:
        new = plan_for(counts, groups, capacity, int(capacity * SMALL), slack=slack)
        if not best or sum(n for n, _ in new) < sum(n for n, _ in best):
            best = new
        if sum(n for n, _ in best) <= least:
            break
    return best


# ---------------------------------------------------------------- places for pieces


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with sequence_id and offset; give a cut table, it is read three times.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, and only the plan (a few rows per
    distinct length) is broadcast. Equal rows are interchangeable. Columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    slots, at, ids = [], dict.fromkeys(counts, 0), 0
    for n, lengths in plan(counts, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, at[length], at[length] + n, ids, offset))
            at[length] += n
            offset += length
        ids += n
    salts = max(64, -(-max(counts.values(), default=0) // 10_000))
    salted = pieces.select(F.struct("*").alias("row"), F.col("length").alias("size"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt"))
    before = salted.groupBy("size", "salt").count()
    before = before.select("size", "salt", F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("size", "salt").orderBy("row.doc_id", "row.piece", "row.ids_crc32"))
    ranked = salted.withColumn("own", own).join(small_side(cut(before)), ["size", "salt"]).select("row", "size", (F.col("before") + F.col("own") - 1).alias("rank"))
    table = spark.createDataFrame(slots, "size long, from long, to long, first long, place long")
    table = F.broadcast(table) if len(slots) <= BROADCAST_ROWS else table
    placed = ranked.join(table, (ranked["size"] == table["size"]) & (ranked["rank"] >= table["from"]) & (ranked["rank"] < table["to"]))
    return placed.select("row.*", (F.col("first") + F.col("rank") - F.col("from")).alias("sequence_id"), F.col("place").alias("offset"))


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most ``capacity``), doc_ids and starts of their pieces."""
    placed = place(cut(token_pieces(docs, tokenizer, capacity, end_id, ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Places of all pieces of ``docs(doc_id, text)``: one row per piece; extra columns are left out.

    Null and empty texts are documents of the end id alone. Only texts of more tokens than the capacity are cut, however
    long. Repeated rows are packed each; an empty table gives an empty result. Pieces of one length take their places
    by doc_id, piece and content; equal ones may change places, which changes nothing else.
    """
    return place(cut(token_pieces(docs, tokenizer or default_tokenizer()))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
