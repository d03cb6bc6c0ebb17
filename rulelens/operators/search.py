"""Search over detections: predicates, sorting, pages, lookups, facets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulelens.functions.normalize import lits, sanitize

SORTABLE = ("title", "severity", "status", "source", "rule_created_date", "rule_modified_date", "created_at", "updated_at")
SEVERITY_RANK = ("unknown", "low", "medium", "high", "critical")
TEXT_COLUMNS = ("title", "description", "detection_logic", "raw_content")


def contains_text(term: str, columns: Sequence[str], wildcards: bool = False) -> Column:
    """Case-insensitive substring in any of the columns; with ``wildcards`` % and _ match as in LIKE."""
    out = F.lit(False)
    for c in columns:
        hit = F.ilike(c, F.lit(f"%{term}%")) if wildcards else F.contains(F.lower(c), F.lit(term.lower()))
        out = out | F.coalesce(hit, F.lit(False))
    return out


def any_element(column: str, values: Sequence[str]) -> Column:
    """An element equals one of the values, ignoring case."""
    return F.arrays_overlap(F.transform(column, F.lower), lits([v.lower() for v in values]))


def any_element_contains(column: str, values: Sequence[str]) -> Column:
    """An element contains one of the values, ignoring case."""

    def hit(x: Column) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | F.contains(F.lower(x), F.lit(v.lower()))
        return out

    return F.exists(column, hit)


@dataclass(frozen=True)
class SearchSpec:
    """What to search for; empty parts do not filter, given parts are AND-ed."""

    text: str | None = None
    sources: Sequence[str] = ()
    statuses: Sequence[str] = ()
    severities: Sequence[str] = ()
    languages: Sequence[str] = ()
    tactics: Sequence[str] = ()
    techniques: Sequence[str] = ()
    tags: Sequence[str] = ()
    log_sources: Sequence[str] = ()
    platforms: Sequence[str] = ()
    event_categories: Sequence[str] = ()
    data_sources: Sequence[str] = ()
    text_columns: Sequence[str] = TEXT_COLUMNS

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.text:
            out = out & contains_text(self.text, self.text_columns)
        for column, values in (("source", self.sources), ("status", self.statuses), ("severity", self.severities), ("language", self.languages), ("platform", self.platforms), ("event_category", self.event_categories), ("data_source_normalized", self.data_sources)):
            if values:
                out = out & F.col(column).isin(*values)
        for column, values in (("mitre_tactics", self.tactics), ("mitre_techniques", self.techniques), ("tags", self.tags)):
            if values:
                out = out & any_element(column, values)
        if self.log_sources:
            out = out & any_element_contains("log_sources", self.log_sources)
        return out


def search(rules: DataFrame, spec: SearchSpec) -> DataFrame:
    return rules.where(spec.predicate())


def sort_order(column: str, descending: bool = False, key: str = "id") -> list[Column]:
    """Ordering by a whitelisted column (another name means title), nulls last, ties by key. severity_rank sorts by rank."""
    if column == "severity_rank":
        c = F.array_position(lits(SEVERITY_RANK), F.col("severity"))
    else:
        c = F.col(column if column in SORTABLE else "title")
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key)]


def page(rules: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page; deep pages are cheaper by ``page_after``."""
    if offset < 0 or not 1 <= limit <= 200:
        raise ValueError("offset must be at least 0 and limit from 1 to 200")
    return rules.orderBy(*order).offset(offset).limit(limit)


def page_after(rules: DataFrame, column: str, last: tuple, limit: int = 50, key: str = "id", descending: bool = False) -> DataFrame:
    """The page after the row whose (column, key) is ``last``, without counting off what came before.

    Nulls come last either way, ordered by key; a ``last`` with a null value goes on among them. Ties go by key.
    """
    value, at = last
    c, later = F.col(column), F.col(key) > F.lit(at)
    if value is None:
        rest = c.isNull() & later
    else:
        rest = ((c < F.lit(value)) if descending else (c > F.lit(value))) | ((c == F.lit(value)) & later) | c.isNull()
    return page(rules.where(rest), [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key)], 0, limit)


def lookup(rules: DataFrame, key: str, value: object) -> DataFrame:
    return rules.where(F.col(key) == F.lit(value))


def lookup_ordered(rules: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``ids(pos, key)`` in that order; missing ids are dropped, repeats kept."""
    return ids.join(rules, key).orderBy("pos")


def list_view(rules: DataFrame) -> DataFrame:
    """All but the raw content, texts sanitized."""
    return rules.drop("raw_content").withColumns({c: sanitize(F.col(c)) for c, kind in rules.dtypes if kind == "string" and c in ("title", "description", "author", "detection_logic")})


def facets(rules: DataFrame, columns: Sequence[str] = ("source", "status", "severity", "language")) -> DataFrame:
    """facet, value, n of every distinct non-empty value, in one scan."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns)))
    return rules.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def severity_pivot(rules: DataFrame) -> DataFrame:
    """source and the number of rules of each severity, 0 where none has it; another severity counts as unknown."""
    known = F.when(F.col("severity").isin(*SEVERITY_RANK), F.col("severity")).otherwise("unknown")
    return rules.select("source", known.alias("severity")).groupBy("source").pivot("severity", [*SEVERITY_RANK[1:], SEVERITY_RANK[0]]).count().fillna(0, list(SEVERITY_RANK))


def statistics(rules: DataFrame, domains: dict[str, Sequence[str]]) -> DataFrame:
    """facet, value, n and a total of all rules: one scan for all facets.

    The values of a domain are kept with 0 where no rule has them; values outside it, and sources, which have no
    fixed domain, appear as they occur.
    """
    spark = rules.sparkSession
    every = rules.withColumn("total", F.lit("all"))
    counted = facets(every, ["source", *(c for c in domains if c != "source"), "total"])
    listed = [("total", "all"), *((c, v) for c, values in domains.items() for v in values)]
    domain = spark.createDataFrame(listed, "facet string, value string")
    return domain.join(counted, ["facet", "value"], "full").select("facet", "value", F.coalesce("n", F.lit(0)).alias("n"))
