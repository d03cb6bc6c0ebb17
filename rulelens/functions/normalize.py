"""Column functions that turn vendor values into the normalized vocabulary. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulelens.functions import dims

# ---- fixed values: vocabularies
STATUS = {
    "stable": ("stable", "production", "released"),
    "experimental": ("experimental", "test", "testing", "development", "dev"),
    "deprecated": ("deprecated", "obsolete", "retired"),
}
SEVERITY = {
    "low": ("informational", "info", "low"),
    "medium": ("medium", "moderate"),
    "high": ("high",),
    "critical": ("critical", "severe"),
}
# ---- fixed values: date layouts in the order they are tried
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]'Z'",
    "yyyy-MM-dd HH:mm:ss",
)
DATE_SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$",
    r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}Z$", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$",
)
LANGUAGES = ("eql", "esql")


def lits(values: Sequence) -> Column:
    return F.array(*map(F.lit, values))


def lit_map(values: dict) -> Column:
    return F.create_map(*(x if isinstance(x, Column) else F.lit(x) for pair in values.items() for x in pair))


def vocabulary(c: Column, table: dict[str, Sequence[str]], other: str = "unknown") -> Column:
    out = F.lit(other)
    for value, raw in table.items():
        out = F.when(F.lower(c).isin(*raw), value).otherwise(out)
    return out


def det_id(source: Column, path: Column) -> Column:
    """Deterministic id: first 32 hex digits of sha256('source:path') as 8-4-4-4-12."""
    h = F.sha2(F.concat(source, F.lit(":"), path), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def norm_status(c: Column) -> Column:
    return vocabulary(c, STATUS)


def norm_severity(c: Column) -> Column:
    return vocabulary(c, SEVERITY)


def ordered_distinct(*parts: Column) -> Column:
    """Lower-cased non-empty values in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.array(*parts), F.lower), lambda x: x.isNotNull() & (x != "")))


def parse_date(c: Column) -> Column:
    """First of nine layouts that fits, else null. Day-first wins over month-first."""
    t = F.trim(c)
    return F.coalesce(*(F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f.replace("MM-dd", "M-d").replace("MM/dd", "M/d").replace("dd/MM", "d/M") if "HH" not in f else f))) for f, shape in zip(DATE_FORMATS, DATE_SHAPES, strict=True)))


def rule_url(repo: Column, path: Column, branch: Column | str = "main") -> Column:
    """Link to a file: backslashes turned, one leading slash and a .git suffix dropped. Null without repo or path."""
    branch = F.lit(branch) if isinstance(branch, str) else branch
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/", "")
    return F.concat(F.regexp_replace(repo, r"\.git$", ""), F.lit("/blob/"), branch, F.lit("/"), clean)


def clean_list(c: Column) -> Column:
    """Trimmed elements without blanks; null becomes empty."""
    return F.coalesce(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere (ASCII letters)."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), F.initcap), "")


def label_of(x: Column, labels: dict[str, str] = dims.DATA_SOURCE_LABELS) -> Column:
    """Label of one raw data source: exact pattern, else first pattern contained, else title case of the name."""
    low = F.lower(F.trim(x))
    part = F.filter(lits(list(labels)), lambda p: F.contains(low, p))
    by = lit_map(labels)
    return F.coalesce(F.try_element_at(by, low), F.try_element_at(by, F.get(part, F.lit(0))), title_case(F.replace(x, F.lit("_"), F.lit(" "))))


def label_map(c: Column) -> Column:
    """Labels of a list of raw data sources, in order, without repeats; blank elements are dropped."""
    return F.array_distinct(F.transform(F.filter(c, lambda x: x.isNotNull() & (x != "")), lambda x: label_of(x)))


def keyword_score(text: Column, taxonomy: tuple) -> Column:
    """Id with most keywords contained in the text (already lower case), the earliest defined among equals, '' if none.

    Keywords of letters, digits, ``_`` and ``-`` alone stand within a run of such characters, so a text's different runs are
    taken once and searched instead of the whole text. The few keywords that are found are counted by id. The expression is
    short, however long the taxonomy: the keywords are literals of it.
    """
    ids, owners = [], {}
    for k, (i, words) in enumerate(dims.keywords(taxonomy)):
        ids.append(i)
        for w in words:
            owners.setdefault(w, []).append(k)
    runs = text
    if all(re.fullmatch("[a-z0-9_-]+", w) for w in owners):
        runs = F.array_join(F.array_distinct(F.split(text, "[^a-z0-9_-]+")), " ")
    of = lit_map({w: lits(numbers) for w, numbers in owners.items()})

    def best(hits: Column) -> Column:
        counts = F.transform(F.array_distinct(hits), lambda k: F.struct(F.size(F.filter(hits, lambda x: x == k)).alias("n"), (-k).alias("o")))
        return F.when(F.size(hits) > 0, F.element_at(lits(ids), (1 - F.array_max(counts)["o"]).cast("int"))).otherwise("")

    def scored(where: Column) -> Column:
        found = F.filter(lits(list(owners)), lambda w: F.contains(where, w))
        return let(F.flatten(F.transform(found, lambda w: F.element_at(of, w))), best)

    return F.when(text.isNull(), "").otherwise(let(runs, scored))


def hinted(hint: Column, taxonomy: tuple) -> Column:
    """Id that a product or category hint names, else null."""
    return F.try_element_at(lit_map(dims.hint_map(taxonomy)), F.translate(F.lower(hint), "- ", "__"))


def first_contained(text: Column, names: Sequence[str]) -> Column:
    """First of ``names`` contained in the text, else null."""
    return F.get(F.filter(lits(names), lambda n: F.contains(text, n)), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def platform(text: Column, product: Column | None = None, service: Column | None = None, patterns: Column | None = None) -> Column:
    """Platform from the product, else the service, else index patterns, else keyword scores over the text."""
    out = []
    if product is not None:
        out.append(hinted(product, dims.PLATFORMS))
    if service is not None:
        out.append(F.try_element_at(lit_map({r[0]: r[1] for r in dims.DATA_SOURCES}), F.lower(service)))
    if patterns is not None:
        by_word = {w: i for i, words in dims.keywords(dims.PLATFORMS) for w in words}
        hits = F.filter(F.flatten(F.transform(patterns, lambda p: F.filter(lits(list(by_word)), lambda w: F.contains(F.lower(p), w)))), lambda w: w.isNotNull())
        out.append(F.try_element_at(lit_map(by_word), F.get(hits, F.lit(0))))
    return F.coalesce(*out, let(F.lower(text), lambda t: keyword_score(t, dims.PLATFORMS)), F.lit(""))


def event_category(text: Column, category: Column | None = None) -> Column:
    score = F.coalesce(let(F.lower(text), lambda t: keyword_score(t, dims.EVENT_CATEGORIES)), F.lit(""))
    return score if category is None else F.coalesce(hinted(category, dims.EVENT_CATEGORIES), score)


def data_source(text: Column, service: Column | None = None, patterns: Column | None = None) -> Column:
    names, out = [r[0] for r in dims.DATA_SOURCES], []
    if service is not None:
        out.append(F.when(F.lower(service).isin(*names), F.lower(service)))
    if patterns is not None:
        out.append(F.get(F.flatten(F.transform(patterns, lambda p: F.filter(lits(names), lambda n: F.contains(F.lower(p), n)))), F.lit(0)))
    return F.coalesce(*out, let(F.lower(text), lambda t: first_contained(t, names)), F.lit(""))


def detect_language(rule_type: Column, language: Column) -> Column:
    """Query language of a rule from its type and declared language."""
    t, lang = F.lower(rule_type), F.lower(language)
    declared = F.when(lang == "kuery", "kql").when(lang.isin("lucene", *LANGUAGES), lang).otherwise("kql")
    return F.when(t.isin(*LANGUAGES), t).when(t == "machine_learning", "ml").when(t == "threat_match", "threat_match").when(t.isin("query", "threshold", "new_terms"), declared).otherwise("unknown")


def variant_strings(c: Column) -> Column:
    """Array of variants as strings: a mapping gives its name, id or Schema, else its text; nulls are dropped."""
    part = lambda x: F.coalesce(*(F.try_variant_get(x, f"$.{k}", "string") for k in ("name", "id", "Schema")), F.try_variant_get(x, "$", "string"), F.to_json(x))
    return F.filter(F.transform(c, lambda x: part(x)), lambda x: x.isNotNull())


def norm_tags(c: Column, drop_prefix: bool = False) -> Column:
    """Lower case, spaces to underscores; optionally without what stands before the first colon."""
    bare = (lambda t: F.trim(F.regexp_replace(t, "^[^:]*:", ""))) if drop_prefix else (lambda t: t)
    return F.transform(c, lambda t: F.replace(F.lower(bare(t)), F.lit(" "), F.lit("_")))


def bucket_score(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").when(score > 0, "low")


def score_bucket(top: Column, average: Column, stated: Column | None = None) -> Column:
    """Severity from the top risk score, else from the mean of impact and confidence, else as stated, else unknown."""
    rest = [] if stated is None else [F.nullif(norm_severity(stated), F.lit("unknown"))]
    return F.coalesce(bucket_score(top), bucket_score(average), *rest, F.lit("unknown"))


def attack_tags(tags: Column) -> tuple[Column, Column, Column]:
    """(technique ids, tactic ids, other tags) of flat ``attack.`` tags; software and group tags are dropped."""
    low = F.transform(tags, F.lower)
    own = F.transform(F.filter(low, lambda t: t.startswith("attack.")), lambda t: F.replace(F.substring(t, 8, 1 << 20), F.lit("-"), F.lit("_")))
    technique = F.array_distinct(F.transform(F.filter(own, lambda t: t.rlike(r"^t\d")), F.upper))
    tactic = F.array_distinct(F.filter(F.transform(own, lambda t: F.try_element_at(lit_map(dims.TACTIC_ID), t)), lambda x: x.isNotNull()))
    return technique, tactic, F.filter(tags, lambda t: ~F.lower(t).startswith("attack."))


def technique_ids(c: Column) -> Column:
    """Elements that are technique ids (T, four digits, optional three), upper-cased, without repeats."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.upper(F.trim(x))), lambda x: x.rlike(r"^T\d{4}(\.\d{3})?$")))


def tactic_ids(names: Column) -> Column:
    """Tactic ids of names in any case, with spaces, hyphens, underscores or none; TA ids stand for themselves."""
    by = {n.replace("_", ""): i for n, i in dims.TACTIC_ID.items()} | {r[0].lower(): r[0] for r in dims.TACTICS}
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.try_element_at(lit_map(by), F.regexp_replace(F.lower(n), "[ _-]", ""))), lambda x: x.isNotNull()))


def technique_norm(c: Column) -> Column:
    """Upper-cased id without an ``ATTACK.`` prefix; bare digits get their T."""
    bare = F.regexp_replace(F.upper(F.trim(c)), r"^ATTACK\.", "")
    return F.when(bare.rlike(r"^\d"), F.concat(F.lit("T"), bare)).otherwise(bare)


def parent_of(technique: Column) -> Column:
    return F.split_part(technique, F.lit("."), F.lit(1))


def is_sub(technique: Column) -> Column:
    return F.contains(technique, F.lit("."))


def infer_tactics(techniques: Column) -> Column:
    """Likely tactics of the parents of technique ids, in order, without repeats."""
    return F.array_distinct(F.filter(F.transform(techniques, lambda t: F.try_element_at(lit_map(dims.PARENT_TACTIC), parent_of(t))), lambda x: x.isNotNull()))


def sanitize(c: Column) -> Column:
    """Text without control characters (tab, newline and carriage return stay); invalid bytes become U+FFFD, null ''."""
    return F.regexp_replace(F.make_valid_utf8(F.coalesce(c, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def repair_lines(c: Column) -> Column:
    """Quote ``key: value`` values that start with * or hold %, so that a YAML reader takes them as text."""
    quoted = lambda line: F.concat(F.regexp_extract(line, r"^(\s*(?:- )?(?:[\w.|-]+:\s+|- ))(.*)$", 1), F.lit("'"), F.replace(F.regexp_extract(line, r"^(\s*(?:- )?(?:[\w.|-]+:\s+|- ))(.*)$", 2), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.array_join(F.transform(F.split(c, "\n"), lambda line: F.when(line.rlike(r"^\s*(- )?([\w.|-]+:\s+|- )(\*|[^'\"\[{|>&#].*%)"), quoted(line)).otherwise(line)), "\n")


def age_bucket(then: Column, as_of: Column) -> Column:
    """Today, Yesterday, Nd, Nw, Nmo or Ny."""
    d = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(then)) / 86400)
    part = lambda n, unit: F.concat(F.floor(d / n).cast("string"), F.lit(unit))
    return F.when(d <= 0, "Today").when(d == 1, "Yesterday").when(d < 7, part(1, "d")).when(d < 30, part(7, "w")).when(d < 365, part(30, "mo")).when(d >= 365, part(365, "y"))


# ---- fixed values: raw data source and the words of a search of which all of one group must occur
SEARCH_SOURCES = (
    ("sysmon", (("sysmon",),)),
    ("windows_event", (("wineventlog",),)),
    ("security_event", (("security", "windows"),)),
    ("powershell", (("powershell",),)),
    ("registry", (("registry",),)),
    ("process_creation", (("process",),)),
    ("network", (("network",),)),
    ("dns", (("dns",),)),
    ("authentication", (("authentication",), ("logon",))),
    ("aws", (("cloudtrail",), ("aws",))),
    ("azure", (("azure",),)),
    ("gcp", (("gcp",), ("google",))),
)


def infer_sources(search: Column, stated: Column | None = None) -> Column:
    """Labels of the stated data sources and of those that a search text names."""
    low = F.lower(search)

    def named(groups: tuple) -> Column:
        out = F.lit(False)
        for words in groups:
            every = F.lit(True)
            for w in words:
                every = every & F.contains(low, F.lit(w))
            out = out | every
        return out

    raw = F.array_compact(F.array(*(F.when(named(groups), name) for name, groups in SEARCH_SOURCES)))
    return label_map(raw if stated is None else F.concat(F.coalesce(stated, F.array().cast("array<string>")), raw))
