"""Technique coverage: resolving ids, roll-up, matrix, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import dims
from rulelens.functions.normalize import is_sub, parent_of


def bridge(rules: DataFrame) -> DataFrame:
    """source, id, technique: one row per tag."""
    return rules.select("source", "id", F.explode("mitre_techniques").alias("technique"))


def valid(catalog: DataFrame) -> DataFrame:
    return catalog.where("not deprecated and not revoked")


def resolve_table(catalog: DataFrame, remap: DataFrame) -> DataFrame:
    """technique, mapped: a valid id is itself, else its valid successor, else itself while the catalog has it."""
    good = valid(catalog).select(F.col("id").alias("new_id"))
    succeeded = remap.join(good, "new_id", "left_semi")
    gone = catalog.where("deprecated or revoked").select("id")
    old = gone.select(F.col("id").alias("old_id")).union(remap.select("old_id")).distinct()
    mapped = old.join(succeeded, "old_id", "left").join(gone.select(F.col("id").alias("old_id"), F.lit(True).alias("kept")), "old_id", "left")
    mapped = mapped.join(valid(catalog).select(F.col("id").alias("old_id")), "old_id", "left_anti")
    own = mapped.select(F.col("old_id").alias("technique"), F.coalesce("new_id", F.when(F.col("kept"), F.col("old_id"))).alias("mapped")).where("mapped is not null")
    return valid(catalog).select(F.col("id").alias("technique"), F.col("id").alias("mapped")).union(own)


def resolved(tags: DataFrame, table: DataFrame) -> DataFrame:
    """``tags`` with ``mapped`` (null where the catalog knows neither the id nor a successor). The table is catalog-sized."""
    return tags.join(table, "technique", "left")


def rollup(tags: DataFrame, technique: str = "technique") -> DataFrame:
    """technique, source, n, rules: a sub-technique also counts once for its parent. n counts tags, rules rules."""
    t = F.col(technique)
    each = tags.where(t.isNotNull()).select("source", "id", F.explode(F.when(is_sub(t), F.array(t, parent_of(t))).otherwise(F.array(t))).alias("technique"))
    return each.groupBy("technique", "source").agg(F.count("*").alias("n"), F.count_distinct("id").alias("rules"))


def unmapped(tags: DataFrame, table: DataFrame) -> DataFrame:
    return tags.select("technique").distinct().join(table, "technique", "left_anti")


def derive_tactics(tags: DataFrame, table: DataFrame, catalog: DataFrame) -> DataFrame:
    """id, tactics: sorted tactics of the rule's techniques (mapped where that works) and of their parents."""
    own = resolved(tags, table).select("id", F.coalesce("mapped", "technique").alias("t"))
    each = own.select("id", F.explode(F.array("t", parent_of(F.col("t")))).alias("tid"))
    known = catalog.select(F.col("id").alias("tid"), F.explode("tactics").alias("tactic"))
    return each.join(known, "tid").groupBy("id").agg(F.array_sort(F.collect_set("tactic")).alias("tactics"))


def matrix(counts: DataFrame, catalog: DataFrame, sources: Sequence[str], tactic: str | None = None, subtechniques: bool = True) -> DataFrame:
    """One row per (tactic, valid technique): counts per source (zero-filled), total and n_sources, in kill-chain order.

    A wide report of chosen ``sources``, each a column, so none may have the name of another column; ``long_matrix`` takes
    any. ``counts`` is a roll-up. An unknown tactic, and a source of such a name, raise ValueError.
    """
    clash = {"ord", "tactic", "technique", "name", "is_subtechnique", "total", "n_sources"} & set(sources)
    if clash:
        raise ValueError(f"sources named like columns: {sorted(clash)}")
    if tactic is not None:
        tactic = tactic.upper()
        if tactic not in {r[0] for r in dims.TACTICS}:
            raise ValueError(f"unknown tactic {tactic}")
    order = F.create_map(*(F.lit(x) for k, r in enumerate(dims.TACTICS) for x in (r[0], k)))
    wide = counts.groupBy("technique").pivot("source", list(sources)).agg(F.sum("n"))
    cells = valid(catalog).select(F.col("id").alias("technique"), "name", "is_subtechnique", F.explode("tactics").alias("tactic"))
    if tactic:
        cells = cells.where(F.col("tactic") == tactic)
    if not subtechniques:
        cells = cells.where("not is_subtechnique")
    out = cells.join(wide, "technique", "left")
    filled = [F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in sources]
    total = sum((F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in sources), F.lit(0))
    several = sum(((F.coalesce(F.col(f"`{s}`"), F.lit(0)) > 0).cast("int") for s in sources), F.lit(0))
    return out.select(F.element_at(order, F.col("tactic")).alias("ord"), "tactic", "technique", "name", "is_subtechnique", *filled, total.cast("long").alias("total"), several.alias("n_sources")).orderBy("ord", "is_subtechnique", "technique")


# ---------------------------------------------------------------- the matrix in long form: any number of sources, any names


def cells(catalog: DataFrame, tactic: str | None = None, subtechniques: bool = True) -> DataFrame:
    """ord, tactic, technique, name, is_subtechnique of every valid technique under each of its tactics."""
    if tactic is not None:
        tactic = tactic.upper()
        if tactic not in {r[0] for r in dims.TACTICS}:
            raise ValueError(f"unknown tactic {tactic}")
    order = F.create_map(*(F.lit(x) for k, r in enumerate(dims.TACTICS) for x in (r[0], k)))
    out = valid(catalog).select(F.col("id").alias("technique"), "name", "is_subtechnique", F.explode("tactics").alias("tactic"))
    if tactic:
        out = out.where(F.col("tactic") == tactic)
    if not subtechniques:
        out = out.where("not is_subtechnique")
    return out.select(F.element_at(order, F.col("tactic")).alias("ord"), "tactic", "technique", "name", "is_subtechnique")


def levels(counts: DataFrame) -> DataFrame:
    """technique, source, n, n_sources and of_all from a roll-up, by grouping sets: one row per technique and source, and one
    of all sources together (``of_all``). A null source is a source."""
    sets = counts.groupingSets([["technique", "source"], ["technique"]], "technique", "source")
    return sets.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_sources"), (F.grouping("source") == 1).alias("of_all"))


def long_matrix(counts: DataFrame, catalog: DataFrame, sources: DataFrame, tactic: str | None = None, subtechniques: bool = True) -> DataFrame:
    """One row per cell of the catalog and source of ``sources``: n (zero-filled), total and n_sources of the cell.

    ``counts`` is a roll-up. Sources may be any number of any names, null too; nothing runs while the plan is made. The
    result has a row for each cell and source by definition; the catalog-sized cells are what is copied to the sources.
    """
    each = levels(counts)
    own = each.where("not of_all").select(F.col("technique").alias("_t"), F.col("source").alias("_s"), "n")
    total = each.where("of_all").select("technique", F.col("n").alias("total"), "n_sources")
    grid = sources.select("source").distinct().crossJoin(F.broadcast(cells(catalog, tactic, subtechniques).join(total, "technique", "left")))
    out = grid.join(own, (F.col("technique") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return out.select("ord", "tactic", "technique", "name", "is_subtechnique", "source", zero("n", "long"), zero("total", "long"), zero("n_sources", "int"))


def cell_totals(counts: DataFrame, catalog: DataFrame, sources: Sequence[str | None] | None = None, tactic: str | None = None, subtechniques: bool = True) -> DataFrame:
    """The cells of the catalog with total and n_sources over all sources, or over the chosen ones (None is the null source)."""
    if sources is not None:
        some = F.col("source").isin(*(s for s in sources if s is not None)) if any(s is not None for s in sources) else F.lit(False)
        counts = counts.where(F.coalesce(some, F.lit(False)) | (F.col("source").isNull() if None in sources else F.lit(False)))
    total = counts.groupBy("technique").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("n_sources"))
    joined = cells(catalog, tactic, subtechniques).join(total, "technique", "left")
    return joined.select("ord", "tactic", "technique", "name", "is_subtechnique", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("n_sources", F.lit(0)).cast("int").alias("n_sources"))


def long_summary(counts: DataFrame, catalog: DataFrame, sources: DataFrame, compat: bool = False) -> DataFrame:
    """level ('source' or 'all'), source ('any' for all), covered, techniques, percent over the valid techniques.

    A source may itself be called any: ``level`` tells it from all of them. With ``compat`` a technique counts in the total
    once for each of its tactics, and once when covered.
    """
    grid = cells(catalog)
    size = grid.agg((F.count("*") if compat else F.count_distinct("technique")).alias("techniques")).withColumn("_k", F.lit(1))
    used = counts.where("n > 0").join(grid.select("technique").distinct(), "technique", "left_semi")
    found = used.groupingSets([["source"], []], "source").agg(F.count_distinct("technique").alias("covered"), (F.grouping("source") == 1).alias("of_all"))
    listed = sources.select("source", F.lit(False).alias("of_all")).distinct()
    every = listed.unionByName(size.select(F.lit(None).cast("string").alias("source"), F.lit(True).alias("of_all")))
    own = found.select(F.col("source").alias("_s"), F.col("of_all").alias("_all"), "covered")
    out = every.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("of_all") == F.col("_all")), "left").withColumn("_k", F.lit(1)).join(F.broadcast(size), "_k")
    covered = F.coalesce("covered", F.lit(0))
    return out.where("techniques > 0").select(
        F.when(F.col("of_all"), "all").otherwise("source").alias("level"),
        F.when(F.col("of_all"), "any").otherwise(F.col("source")).alias("source"),
        covered.alias("covered"),
        "techniques",
        F.round(100.0 * covered / F.col("techniques"), 1).alias("percent"),
    )


# ---------------------------------------------------------------- the matrix as a wide report of chosen sources


def known_sources(rules: DataFrame, most: int = 1000) -> list[str]:
    """The sorted sources of ``rules`` for a pivot; more than ``most`` raise ValueError, as each becomes a column."""
    found = [r.source for r in rules.select("source").where("source is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} sources")
    return sorted(found)


def by_source(grid: DataFrame, sources: Sequence[str]) -> DataFrame:
    """The matrix in long form: its cells without the columns of the sources, and source and n of each."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(f"`{s}`").alias("n")) for s in sources)))
    return grid.select(*(c for c in grid.columns if c not in sources), each.alias("e")).select("*", "e.*").drop("e")


def gaps_view(grid: DataFrame, covered: bool) -> DataFrame:
    return grid.where("total > 0" if covered else "total = 0")


def tactic_percent(grid: DataFrame) -> DataFrame:
    return grid.groupBy("tactic").agg(F.count_if(F.col("total") > 0).alias("covered"), F.count("*").alias("techniques"), F.round(100 * F.avg((F.col("total") > 0).cast("int")), 0).alias("percent"))


def technique_remap(spark: SparkSession) -> DataFrame:
    """old_id, new_id of the retired ids of the public catalog."""
    return spark.createDataFrame(list(dims.TECHNIQUE_REMAP.items()), "old_id string, new_id string")


def with_tactics(rules: DataFrame, table: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rules`` with mitre_tactics derived from their techniques where they state none; other rows stay as they are."""
    bare = rules.where("size(mitre_tactics) = 0")
    found = derive_tactics(bridge(bare).distinct(), table, catalog).withColumnRenamed("tactics", "_derived")
    out = rules.join(found, "id", "left").withColumn("mitre_tactics", F.when(F.size("mitre_tactics") > 0, F.col("mitre_tactics")).otherwise(F.coalesce("_derived", "mitre_tactics")))
    return out.select(*rules.columns)


def tactic_of(tactics: DataFrame, tactic: str) -> DataFrame:
    """The row of one tactic, its id in any case."""
    return tactics.where(F.col("id") == tactic.upper())


def technique_of(catalog: DataFrame, technique: str) -> DataFrame:
    """The row of one technique, its id in any case."""
    return catalog.where(F.col("id") == technique.upper())


def summary(grid: DataFrame, sources: Sequence[str], compat: bool = False) -> DataFrame:
    """source (and 'any'), covered, techniques, percent over distinct techniques of the matrix.

    With ``compat`` a technique counts in the total once for each of its tactics, and once when covered.
    """
    one = grid.groupBy("technique").agg(*(F.max(F.col(f"`{s}`")).alias(s) for s in sources), F.max("total").alias("any"), F.count("*").alias("cells"))
    names = [*sources, "any"]
    total = F.sum("cells") if compat else F.count("*")
    each = one.select("cells", F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(f"`{s}`").alias("n")) for s in names))).alias("e")).select("cells", "e.*")
    return each.groupBy("source").agg(F.count_if(F.col("n") > 0).alias("covered"), total.alias("techniques"), F.round(100.0 * F.count_if(F.col("n") > 0) / total, 1).alias("percent"))


def catalog_stats(catalog: DataFrame, tactics: DataFrame | None = None) -> DataFrame:
    """One row: tactics (of the given table, else those that any technique has), techniques, subtechniques."""
    own = catalog.agg(F.count("*").alias("techniques"), F.count_if("is_subtechnique").alias("subtechniques"))
    used = catalog.select(F.explode("tactics").alias("id")) if tactics is None else tactics.select("id")
    n = used.agg(F.count_distinct("id").alias("tactics"))
    return n.select("tactics", F.lit(1).alias("k")).join(own.withColumn("k", F.lit(1)), "k").drop("k")


def suggest(catalog: DataFrame, term: str, k: int = 15) -> DataFrame:
    """The first k techniques by id that are not deprecated and hold the term in id or name."""
    low = F.lit(term.lower())
    return catalog.where(~F.col("deprecated") & (F.contains(F.lower("id"), low) | F.contains(F.lower("name"), low))).orderBy("id").limit(k).select("id", "name")
