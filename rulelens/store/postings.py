"""Free-text search through a kept table of n-grams.

``postings/<write>/<column>/`` of a snapshot table tells which blocks of rows hold which three characters in a row of the
column's lower-cased text, sorted by them. A search looks up the term's own n-grams, reads only the files and row groups
with blocks that hold all of them, and verifies the term there. Data files never change, so their postings are made once;
a version needs those of its new files only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulelens.operators.search import contains_text
from rulelens.store.snapshots import BLOCK, SnapshotTable, Version

SIZE = 3
#: Beyond so many runs of blocks only files are left out, not blocks within them; the result is the same.
RUNS_MOST = 500
#: Blocks whose n-grams a task combines and sorts, whatever the size of the table.
TASK_BLOCKS = 128


def grams(term: str) -> list[str]:
    """The distinct n-grams of a lower-cased term; none if it is shorter."""
    low = term.lower()
    return sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})


def text_grams(column: str) -> Column:
    """The distinct n-grams of a lower-cased text, line breaks included; a look-ahead finds the overlapping ones in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1)))


def _folders(table: SnapshotTable, version: Version) -> set[str]:
    return {r.folder for r in table.files(version).select(F.split_part("file", F.lit("/"), F.lit(1)).alias("folder")).distinct().collect()}


def indexed_folders(table: SnapshotTable, version: Version, columns: Sequence[str]) -> set[str]:
    """The writes of a version that have all postings of all the columns."""
    out = set()
    for folder in _folders(table, version):
        marks = [table._fs(f"postings/{folder}/{c}/_SUCCESS") for c in columns]
        if all(fs.exists(mark) for fs, mark in marks):
            out.add(folder)
    return out


def index_new_files(table: SnapshotTable, columns: Sequence[str]) -> list[tuple[str, str]]:
    """Make the postings of the newest version's writes that have none yet; the (write, column) pairs so indexed.

    Whole blocks, TASK_BLOCKS a task, are dealt out by their text, and their (n-gram, block) pairs combine there, in memory that does not
    grow with the table. The distinct pairs are written before they are sorted by n-gram, so that the ranges are found
    without working on the texts again. Each column has postings of its own, and only its text is read for them.
    """
    version, done = table.version(), []
    folder_of = F.split_part("file", F.lit("/"), F.lit(1))
    for column in columns:
        for folder in sorted(_folders(table, version) - indexed_folders(table, version, [column])):
            n_rows = table.files(version).where(folder_of == folder).agg(F.sum("n_rows")).head()[0]
            parts = max(table.spark.sparkContext.defaultParallelism, -(-n_rows // (table.block_rows * TASK_BLOCKS)))
            rows = table.spark.read.schema(version.schema).parquet(f"{table.path}/data/{folder}")
            name = F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file")
            dealt = rows.select(name, F.col(BLOCK).alias("block"), column).repartition(parts, "block")
            pairs = dealt.select("file", "block", F.explode(text_grams(column)).alias("gram")).distinct()
            scratch = f"postings/{folder}/_unsorted-{uuid.uuid4().hex}"
            pairs.write.option("compression", "zstd").parquet(f"{table.path}/{scratch}")
            order = ["gram", "file", "block"]
            ordered = table.spark.read.schema(pairs.schema).parquet(f"{table.path}/{scratch}").repartitionByRange(parts, *order).sortWithinPartitions(*order)
            ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{table.path}/postings/{folder}/{column}")
            fs, path = table._fs(scratch)
            fs.delete(path, True)
            done.append((folder, column))
    return done


def candidate_blocks(table: SnapshotTable, folders: Sequence[str], term: str, columns: Sequence[str]) -> DataFrame:
    """file, block of the blocks where one of the columns holds all n-grams of the term."""
    wanted = grams(term)
    out = None
    for column in columns:
        postings = table.spark.read.parquet(*(f"{table.path}/postings/{f}/{column}" for f in sorted(folders)))
        hit = postings.where(F.col("gram").isin(*wanted)).groupBy("file", "block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("file", "block")
        out = hit if out is None else out.union(hit)
    return out.distinct()


def runs_of(blocks: Sequence[int]) -> list[tuple[int, int]]:
    """Sorted numbers as runs of neighbours."""
    out: list[tuple[int, int]] = []
    for b in sorted(set(blocks)):
        if out and b == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((b, b))
    return out


def search_text(table: SnapshotTable, term: str, columns: Sequence[str]) -> DataFrame:
    """The rows where one of the columns contains the term, ignoring case: the same as a scan of all rows.

    Terms shorter than an n-gram, and files without postings of all the columns, are scanned. The driver sees the names of the files that
    have candidates, and of their blocks at most ``RUNS_MOST`` runs.
    """
    version = table.version()
    folders = indexed_folders(table, version, columns)
    keep = contains_text(term, columns)
    if not grams(term) or not folders:
        return table.read(version=version).where(keep)
    found = candidate_blocks(table, sorted(folders), term, columns)
    per_file = found.groupBy("file").agg(F.count("*").alias("blocks"))
    live = table.files(version).select("file").join(per_file, "file", "left")
    plain = ~F.split_part("file", F.lit("/"), F.lit(1)).isin(*folders)
    names = [r.file for r in live.where(F.col("blocks").isNotNull() | plain).collect()]
    rows = table._rows(names, version.schema)
    some = [r.block for r in found.select("block").distinct().limit(50 * RUNS_MOST + 1).collect()]
    runs = runs_of(some)
    if len(some) <= 50 * RUNS_MOST and 0 < len(runs) <= RUNS_MOST and not any(n.split("/")[0] not in folders for n in names):
        block = F.col(BLOCK)
        near = F.lit(False)
        for lo, hi in runs:
            near = near | block.between(lo, hi)
        rows = rows.where(near)  # reaches the row groups' statistics
    return rows.where(keep).drop("_hash", BLOCK)
