"""Comparison across sources: groups, gaps, side by side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulelens.operators.search import any_element, contains_text


def compare(rules: DataFrame, technique: str | None = None, platform: str | None = None, keyword: str | None = None) -> DataFrame:
    """Rules that match the first given of technique, platform and keyword; they stay flat, one row per rule."""
    if technique:
        return rules.where(any_element("mitre_techniques", [technique]))
    if platform:
        return rules.where(F.col("platform") == platform.lower())
    if keyword:
        return rules.where(contains_text(keyword, ["detection_logic", "raw_content"]))
    raise ValueError("technique, platform or keyword is needed")


def per_source(rules: DataFrame) -> DataFrame:
    return rules.groupBy("source").agg(F.count("*").alias("n"))


def gap(items: DataFrame, base: object, other: object, group: str = "grp", item: str = "item", known: Sequence | None = None) -> DataFrame:
    """item, in_base, in_other of every item of either group: one shuffle answers difference, overlap and reverse."""
    if known is not None and (base not in known or other not in known):
        raise ValueError("unknown source")
    flag = lambda g: F.max((F.col(group) == F.lit(g)).cast("int")) == 1
    return items.where(F.col(group).isin(base, other)).groupBy(item).agg(flag(base).alias("in_base"), flag(other).alias("in_other"))


#: Items whose sets of groups a task turns into pair counts at once, and groups of a tile of the product.
ITEMS_AT_ONCE, TILE = 8192, 2048


def set_overlaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b, overlap of different groups: how many of the items' sets hold both, by products of bit matrices, tile by tile."""
    for pdf in frames:
        for lo in range(0, len(pdf), ITEMS_AT_ONCE):
            sets = pdf.groups.iloc[lo : lo + ITEMS_AT_ONCE]
            row = np.repeat(np.arange(len(sets)), sets.map(len))
            names, code = np.unique(np.concatenate(sets.to_list()), return_inverse=True)
            tiles = []
            for at in range(0, len(names), TILE):
                bits = np.zeros((len(sets), min(TILE, len(names) - at)), dtype=np.float32)
                here = (code >= at) & (code < at + TILE)
                bits[row[here], code[here] - at] = 1
                tiles.append((at, bits))
            for s, left in tiles:
                for t, right in tiles:
                    both = left.T @ right  # whole numbers below 2^24 are exact
                    a, b = np.nonzero(both)
                    off = a + s != b + t
                    a, b = a[off], b[off]
                    yield pd.DataFrame({"a": names[a + s], "b": names[b + t], "overlap": both[a, b].astype(np.int64)})


def gap_all_pairs(items: DataFrame, group: str = "grp", item: str = "item") -> DataFrame:
    """Every ordered pair of groups: sizes of both, overlap, missing in the second. Null groups and items do not count.

    Each item gets the set of its groups; pairs are counted from the sets within tasks, as products of bit matrices, before
    anything is shuffled: no item is joined with itself. The result has a row for each pair of groups.
    """
    one = items.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null")
    kind = one.schema["g"].dataType.simpleString()
    sets = one.groupBy("i").agg(F.collect_set("g").alias("groups")).select("groups")
    both = sets.mapInPandas(set_overlaps, f"a {kind}, b {kind}, overlap long").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    size = one.distinct().groupBy("g").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(W.orderBy("g")))
    last = size.agg(F.max("k").alias("last"), F.lit(1).alias("_one"))
    left = size.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").select(F.col("g").alias("a"), F.col("n").alias("base_n"), "k", F.explode(F.sequence(F.lit(1), "last")).alias("other"))
    pairs = left.where("k <> other").join(size.select(F.col("g").alias("b"), F.col("n").alias("other_n"), F.col("k").alias("other")), "other")
    overlap = F.coalesce("overlap", F.lit(0))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", "base_n", "other_n", overlap.alias("overlap"), (F.col("base_n") - overlap).alias("gap"))


def unpivoted(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """pos, field, value of every field, arrays joined, null as ''."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.coalesce(F.array_join(c, ", ") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit(""))
    return rows.select("pos", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in fields))).alias("f")).select("pos", "f.*")


def side_by_side(rows: DataFrame, fields: Sequence[str], n: int) -> DataFrame:
    """field and v1..vn for 2 to 6 chosen rows (``pos`` from 1)."""
    if not 2 <= n <= 6:
        raise ValueError("2 to 6 rows can be compared")
    out = unpivoted(rows, fields).groupBy("field").pivot("pos", list(range(1, n + 1))).agg(F.first("value"))
    return out.select("field", *(F.col(str(k)).alias(f"v{k}") for k in range(1, n + 1)))


def differing(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, differs: whether the chosen rows have more than one value. Arrays compare by element, null is a value."""
    value = lambda c: F.to_json(F.struct(F.col(c).alias("v")))  # noqa: E731  leaves out a null, so it stands for itself
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in fields))).alias("f")).select("f.*")
    return each.groupBy("field").agg((F.count_distinct("value") > 1).alias("differs"))
