"""Field Columns per source: what a decoded document says, in the normalized vocabulary. A new source is a new entry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulelens.functions import normalize as N
from rulelens.sources.landing import DISCOVERY


def none() -> Column:
    return F.array().cast("array<string>")


def text(path: str) -> Column:
    return F.try_variant_get("doc", f"$.{path}", "string")


def strings(path: str) -> Column:
    """List-or-scalar field as an array of non-empty strings."""
    many, one = F.try_variant_get("doc", f"$.{path}", "array<string>"), text(path)
    scalar = F.when(many.isNull() & one.isNotNull(), F.array(one))
    return F.filter(F.coalesce(many, scalar, none()), lambda x: x.isNotNull() & (x != ""))


def records(path: str) -> Column:
    """List-or-mapping field as an array of variants."""
    many, one = F.try_variant_get("doc", f"$.{path}", "array<variant>"), F.try_variant_get("doc", f"$.{path}", "variant")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def of(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def each_of(record: Column, path: str) -> Column:
    many, one = of(record, path, "array<variant>"), of(record, path, "variant")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def known(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


def threat_ids(path: str) -> tuple[Column, Column]:
    """(tactics, techniques) of a nested threat array: techniques and their sub-techniques in order, without repeats."""
    threats = records(path)
    tactics = F.array_distinct(known(F.transform(threats, lambda t: of(t, "tactic.id"))))
    own = lambda x: F.concat(F.array(of(x, "id")), F.transform(each_of(x, "subtechnique"), lambda s: of(s, "id")))
    techniques = F.flatten(F.transform(threats, lambda t: F.flatten(F.transform(each_of(t, "technique"), own))))
    return tactics, F.array_distinct(known(techniques))


def first_match(c: Column, rules: dict[str, tuple[str, ...]], other: Column | None = None) -> Column:
    """Value of the first rule of which a word is contained in ``c``."""
    out = other if other is not None else F.lit(None).cast("string")
    for value, words in reversed(list(rules.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = F.when(hit, value).otherwise(out)
    return out


def first_element(c: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Value of the first element of the array that a rule fits."""
    return F.get(known(F.transform(c, lambda x: first_match(F.lower(x), rules))), F.lit(0))


@dataclass(frozen=True)
class SourceSpec:
    """How a source's documents become detections. Each part is a function, as Columns need a session to be built.

    ``fields`` gives raw parts: title, logic, description, author, status, severity, rule_id, product, category,
    service, patterns, extra_sources (log sources), data_sources, tactics, techniques, tags, references,
    false_positives, created, modified, language. ``fallback`` gives platform, event_category and data_source where
    the taxonomy finds none.
    """

    fields: Callable[[], dict[str, Column]]
    language: str
    branch: str = "main"
    fallback: Callable[[], dict[str, Column]] = dict
    accept: Callable[[], Column] = field(default=lambda: F.lit(True))
    needs_logic: bool = True


def sigma_fields(own: str | None = None) -> dict[str, Column]:
    techniques, tactics, tags = N.attack_tags(strings("tags"))
    if own:
        tags = F.when(F.exists(tags, lambda t: F.lower(t) == own), tags).otherwise(F.array_append(tags, F.lit(own)))
    product, category, service = (text(f"logsource.{k}") for k in ("product", "category", "service"))
    by_product = F.when(F.coalesce(service, F.lit("")) == "", F.when(F.lower(product) == "windows", "windows_event").when(F.lower(product).isin("linux", "macos"), F.lower(product)))
    sources = known(F.array(F.nullif(F.lower(service), F.lit("")), F.nullif(F.lower(category), F.lit("")), by_product, F.lit("rmm_tool") if own else F.lit(None).cast("string")))
    return {"title": text("title"), "logic": text("detection_text"), "description": text("description"), "author": text("author"), "status": text("status"), "severity": text("level"), "rule_id": text("id"), "product": product, "category": category, "service": service, "data_sources": sources, "tactics": tactics, "techniques": techniques, "tags": tags, "references": strings("references"), "false_positives": strings("falsepositives"), "created": text("date"), "modified": text("modified")}


# ---- fixed values: hints in index patterns, assets, integrations and connectors
INDEX_PRODUCT = {"windows": ("windows", "winlogbeat"), "linux": ("linux", "auditbeat"), "cloud": ("cloud", "aws", "gcp", "azure")}
INDEX_LOG = {"windows": ("winlogbeat",), "auditbeat": ("auditbeat",), "filebeat": ("filebeat",), "network": ("packetbeat",), "endpoint": ("logs-endpoint",)}
INDEX_SOURCES = {"sysmon": ("sysmon",), "security_event": ("security",), "powershell": ("powershell",), "endpoint": ("endpoint",), "windows_event": ("winlogbeat",), "auditd": ("auditbeat",), "file_monitoring": ("filebeat",), "network": ("packetbeat",), "aws": ("aws", "cloudtrail"), "azure": ("azure",), "gcp": ("gcp",), "o365": ("o365", "office365"), "okta": ("okta",), "github": ("github",)}
ASSET_PRODUCT = {"windows": ("endpoint", "windows"), "network": ("network",), "cloud": ("cloud", "aws")}
CONTEXT_PRODUCT = {"endpoint": ("endpoint",), "network": ("network",)}
CONNECTOR_PRODUCT = {"aws": ("aws",), "gcp": ("gcp", "google"), "office365": ("office", "o365"), "azure_ad": ("azuread", "entra"), "defender": ("defender",)}
CONNECTOR_PLATFORM = {"aws": ("aws",), "gcp": ("gcp", "google"), "office365": ("office", "o365"), "azure_ad": ("azuread", "entra"), "windows": ("windows",), "linux": ("linux",)}
CONNECTOR_SOURCE = {"cloudtrail": ("aws",), "azure_ad": ("azuread",), "office365": ("office365",), "defender": ("defender",), "windows_event": ("securityevents",), "syslog": ("syslog",), "windows_firewall": ("windowsfirewall",), "azure_activity": ("azureactivity",)}
INTEGRATION_SOURCE = {"okta": ("okta",), "cloudtrail": ("aws",), "azure": ("azure",), "windows_event": ("windows",), "linux": ("linux",), "macos": ("macos",), "endpoint": ("endpoint",)}
PRODUCT_SOURCES = {"windows": ("windows_event", "endpoint"), "linux": ("linux", "endpoint"), "macos": ("macos", "endpoint"), "aws": ("aws", "cloud"), "azure": ("azure", "cloud"), "okta": ("okta", "identity"), "llm": ("llm", "application")}


def product_sources(product: Column, names: tuple[str, ...]) -> Column:
    out = N.lits(["endpoint"])
    for name in names:
        out = F.when(product == name, N.lits(PRODUCT_SOURCES[name])).otherwise(out)
    return out


def elastic_fields() -> dict[str, Column]:
    tactics, techniques = threat_ids("rule.threat")
    index, kind, query = strings("rule.index"), text("rule.type"), F.nullif(text("rule.query"), F.lit(""))
    product = first_element(index, INDEX_PRODUCT)
    job = F.concat(F.lit("Machine Learning Job: "), F.coalesce(F.array_join(strings("rule.machine_learning_job_id"), ", "), F.lit("unknown")))
    per_index = F.flatten(F.transform(index, lambda i: known(F.array(*(first_match(F.lower(i), {v: w}) for v, w in INDEX_SOURCES.items())))))
    logs = known(F.transform(index, lambda i: first_match(F.lower(i), INDEX_LOG)))
    maturity = F.lower(text("metadata.maturity"))
    status = F.when(maturity == "production", "stable").when(maturity == "development", "experimental").when(maturity == "deprecated", "deprecated").otherwise("unknown")
    return {"title": text("rule.name"), "logic": F.coalesce(query, F.when(kind == "machine_learning", job)), "description": text("rule.description"), "author": F.array_join(strings("rule.author"), ", "), "status": status, "severity": text("rule.severity"), "rule_id": text("rule.rule_id"), "product": product, "patterns": index, "extra_sources": logs, "data_sources": F.concat(per_index, known(F.array(product))), "tactics": tactics, "techniques": techniques, "tags": N.norm_tags(strings("rule.tags")), "references": strings("rule.references"), "false_positives": strings("rule.false_positives"), "created": text("metadata.creation_date"), "modified": text("metadata.updated_date"), "language": N.detect_language(kind, text("rule.language"))}


def splunk_fields() -> dict[str, Column]:
    ids = F.transform(strings("tags.mitre_attack_id"), lambda x: F.upper(F.trim(x)))
    techniques = F.array_distinct(F.filter(ids, lambda x: x.rlike("^T[0-9]")))
    stated = F.array_distinct(F.concat(F.filter(ids, lambda x: x.startswith("TA")), N.tactic_ids(strings("tags.kill_chain_phases"))))
    inferred = N.infer_tactics(techniques)
    top = F.array_max(F.transform(records("rba.risk_objects"), lambda r: of(r, "score").try_cast("int")))
    mean = (text("tags.impact").try_cast("int") + text("tags.confidence").try_cast("int")) / 2
    product = F.coalesce(first_element(strings("tags.asset_type"), ASSET_PRODUCT), first_element(strings("tags.context"), CONTEXT_PRODUCT))
    named = lambda prefix, path: F.transform(strings(path), lambda x: F.concat(F.lit(prefix), x))
    tags = N.norm_tags(F.concat(named("story:", "tags.analytic_story"), named("asset:", "tags.asset_type"), named("domain:", "tags.security_domain")), drop_prefix=True)
    search, raw = text("search"), strings("data_source")
    return {"title": text("name"), "logic": F.nullif(search, F.lit("")), "description": text("description"), "author": F.array_join(strings("author"), ", "), "status": text("status"), "severity": N.score_bucket(F.nullif(top, F.lit(0)), mean, text("tags.risk_severity")), "rule_id": text("id"), "product": product, "extra_sources": F.transform(raw, F.lower), "hint_text": F.left(F.lower(search), F.lit(500)), "labels": N.infer_sources(search, raw), "tactics": F.array_distinct(F.concat(stated, inferred)), "techniques": techniques, "tags": tags, "references": strings("references"), "false_positives": strings("known_false_positives"), "created": text("date")}


def sublime_fields() -> dict[str, Column]:
    both = strings("tactics_and_techniques")
    authors = records("authors")
    author = F.coalesce(of(F.get(authors, F.lit(0)), "name"), F.get(authors, F.lit(0)).try_cast("string"))
    return {"title": text("name"), "logic": F.nullif(text("source"), F.lit("")), "description": text("description"), "author": author, "status": F.lit("stable"), "severity": text("severity"), "rule_id": text("id"), "product": F.lit("email"), "category": F.lit("email_security"), "hints": F.lit(False), "data_sources": F.concat(N.lits(["email"]), strings("detection_methods"), strings("attack_types")), "tactics": N.tactic_ids(both), "techniques": N.technique_ids(both), "tags": strings("tags"), "references": strings("references"), "false_positives": strings("false_positives")}


def protections_fields() -> dict[str, Column]:
    tactics, techniques = threat_ids("threat")
    nested, deeper = threat_ids("rule.threat")
    systems, path = F.transform(strings("rule.os_list"), F.lower), F.lower("path")
    product = F.lit("endpoint")
    product = F.when(F.contains(path, F.lit("cross-platform")), "cross_platform").otherwise(product)
    for name in ("macos", "linux", "windows"):
        product = F.when(F.contains(path, F.lit(name)) | F.array_contains(systems, name), name).otherwise(product)
    severity = F.when(F.exists(records("actions"), lambda a: of(a, "action").isin("terminate_process", "block")), "high").otherwise("medium")
    sources = F.concat(product_sources(product, ("windows", "linux", "macos")), N.lits(["behavior", "behavior_event"]))
    return {"title": text("rule.name"), "logic": F.coalesce(text("rule.query"), F.lit("")), "description": text("rule.description"), "author": F.lit("Elastic"), "status": F.lit("stable"), "severity": severity, "rule_id": text("rule.id"), "product": product, "category": F.lit("behavior"), "data_sources": sources, "tactics": F.array_union(tactics, nested), "techniques": F.array_union(techniques, deeper), "tags": F.concat(N.lits(["behavior_rule", "endpoint_protection"]), systems)}


HUNT_PATHS = {name: (f"/{name}/", f"\\{name}\\") for name in ("windows", "linux", "macos", "aws", "azure", "okta", "llm")} | {"cross_platform": ("/cross-platform/", "\\cross-platform\\")}


def hunting_fields() -> dict[str, Column]:
    integration = F.transform(strings("hunt.integration"), F.lower)
    by_path = first_match(F.lower(F.concat(F.lit("/"), "path")), HUNT_PATHS, F.lit("endpoint"))
    every = F.array_join(integration, " ")
    product = F.when(F.array_contains(integration, "okta"), "okta").when(F.contains(every, F.lit("aws")), "aws").when(F.contains(every, F.lit("azure")), "azure").otherwise(by_path)
    notes = strings("hunt.notes")
    noted = F.concat(F.lit("\n\nNotes:\n"), F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n"))
    language = F.coalesce(F.get(strings("hunt.language"), F.lit(0)), F.lit("ES|QL"))
    return {"title": text("hunt.name"), "logic": F.array_join(strings("hunt.query"), "\n\n---\n\n"), "description": F.concat(F.coalesce(text("hunt.description"), F.lit("")), F.when(F.size(notes) > 0, noted).otherwise("")), "author": F.coalesce(text("hunt.author"), F.lit("Elastic")), "status": F.lit("stable"), "severity": F.lit("medium"), "rule_id": text("hunt.uuid"), "product": product, "category": F.lit("hunting"), "data_sources": F.concat(product_sources(product, tuple(PRODUCT_SOURCES)), integration, N.lits(["hunting_query"])), "tactics": none(), "techniques": F.array_distinct(F.filter(strings("hunt.mitre"), lambda t: t.startswith("T"))), "tags": F.concat(N.lits(["hunting_query", "threat_hunting"]), integration), "references": strings("hunt.references"), "language": F.when(language == "ES|QL", "esql").when(F.lower(language).isin("eql", "kql", "lucene"), F.lower(language)).otherwise(language)}


def hunting_fallback() -> dict[str, Column]:
    product, source = F.col("_product"), first_element(strings("hunt.integration"), INTEGRATION_SOURCE)
    return {"platform": F.when(product.isin(*PRODUCT_SOURCES, "cross_platform"), product), "event_category": F.lit("hunting"), "data_source": F.coalesce(source, F.lit("endpoint"))}


def connectors() -> Column:
    return F.transform(known(F.transform(records("requiredDataConnectors"), lambda c: of(c, "connectorId"))), F.lower)


def sentinel_fields() -> dict[str, Column]:
    kinds = F.flatten(F.transform(records("requiredDataConnectors"), lambda c: F.coalesce(of(c, "dataTypes", "array<string>"), none())))
    product = first_match(F.array_join(connectors(), " "), CONNECTOR_PRODUCT, F.lit("azure"))
    technique = F.transform(strings("relevantTechniques"), lambda t: F.when(F.upper(t).startswith("T"), F.upper(t)).otherwise(F.concat(F.lit("T"), F.upper(t))))
    return {"title": text("name"), "logic": F.nullif(text("query"), F.lit("")), "description": F.trim(F.coalesce(text("description"), F.lit(""))), "author": F.lit("Microsoft"), "status": text("status"), "severity": text("severity"), "rule_id": text("id"), "product": product, "category": F.lit("sentinel"), "extra_sources": F.transform(kinds, F.lower), "data_sources": F.concat(F.array(product), F.transform(kinds, F.lower), connectors(), N.lits(["sentinel"])), "tactics": N.tactic_ids(strings("tactics")), "techniques": F.array_distinct(technique), "tags": strings("tags")}


def sentinel_fallback() -> dict[str, Column]:
    return {"platform": first_match(F.array_join(connectors(), " "), CONNECTOR_PLATFORM, F.lit("azure")), "event_category": F.lit("siem"), "data_source": F.coalesce(first_element(connectors(), CONNECTOR_SOURCE), F.lit("sentinel"))}


def constants(**values: str) -> Callable[[], dict[str, Column]]:
    return lambda: {k: F.lit(v) for k, v in values.items()}


def protections_fallback() -> dict[str, Column]:
    return {"event_category": F.when(F.col("_product").isin("windows", "linux", "macos", "cross_platform"), "process"), "data_source": F.lit("defender")}


SPECS = {
    "sigma": SourceSpec(sigma_fields, "sigma", "master"),
    "elastic": SourceSpec(elastic_fields, "unknown"),
    "splunk": SourceSpec(splunk_fields, "spl", "develop"),
    "sublime": SourceSpec(sublime_fields, "mql", fallback=constants(platform="email", event_category="email", data_source="exchange")),
    "elastic_protections": SourceSpec(protections_fields, "eql", fallback=protections_fallback, needs_logic=False),
    "lolrmm": SourceSpec(lambda: sigma_fields("lolrmm"), "sigma", fallback=constants(platform="windows", event_category="process", data_source="sysmon")),
    "elastic_hunting": SourceSpec(hunting_fields, "esql", fallback=hunting_fallback, needs_logic=False),
    "sentinel": SourceSpec(sentinel_fields, "kql", "master", sentinel_fallback, lambda: F.coalesce(F.lower(text("kind")), F.lit("")).isin("", "scheduled", "nrt")),
}


def normalized(landed: DataFrame, source: str, repo_url: str, spec: SourceSpec | None = None) -> DataFrame:
    """Landed documents of one source as detections plus the error columns; documents without title or logic are parse errors."""
    spec = spec or SPECS[source]
    f = spec.fields()
    null = F.lit(None).cast("string")
    get = lambda name, other=null: f.get(name, other)
    product, category, service = (get(k) for k in ("product", "category", "service"))
    logs = N.ordered_distinct(product, category, service)
    logs = F.array_distinct(F.concat(logs, get("extra_sources", none())))
    hint = F.lower(F.concat_ws(" ", logs, product, category, service, get("patterns", none()), get("hint_text")))
    rows = landed.withColumns({"_product": product, "_category": category, "_service": service, "_patterns": get("patterns", none()), "_logs": logs, "_hint": hint})
    hints = "hints" not in f
    product, category, service, hint = (F.col(f"_{k}") for k in ("product", "category", "service", "hint"))
    patterns = F.col("_patterns") if "patterns" in f else None
    fallback = {"platform": F.lit(""), "event_category": F.lit(""), "data_source": F.lit("")} | spec.fallback()
    pick = lambda found, name: F.coalesce(F.nullif(found, F.lit("")), fallback[name], F.lit(""))
    ok = F.coalesce(f["title"], F.lit("")) != ""
    if spec.needs_logic:
        ok = ok & (F.coalesce(f["logic"], F.lit("")) != "")
    bad = F.col("error_stage").isNull() & ~F.coalesce(ok & spec.accept(), F.lit(False))
    return rows.select(
        N.det_id(F.col("source"), F.col("path")).alias("id"),
        "source",
        F.col("path").alias("source_file"),
        F.lit(repo_url).alias("source_repo_url"),
        N.rule_url(F.lit(repo_url), F.col("path"), spec.branch).alias("source_rule_url"),
        get("rule_id").alias("rule_id"),
        f["title"].alias("title"),
        get("description").alias("description"),
        get("author").alias("author"),
        N.norm_status(get("status")).alias("status"),
        N.norm_severity(get("severity")).alias("severity"),
        F.col("_logs").alias("log_sources"),
        (f["labels"] if "labels" in f else N.label_map(get("data_sources", none()))).alias("data_sources"),
        pick(N.platform(hint, product if hints else None, service, patterns), "platform").alias("platform"),
        pick(N.event_category(hint, category if hints else None), "event_category").alias("event_category"),
        pick(N.data_source(hint, service, patterns), "data_source").alias("data_source_normalized"),
        get("tactics", none()).alias("mitre_tactics"),
        get("techniques", none()).alias("mitre_techniques"),
        f["logic"].alias("detection_logic"),
        get("language", F.lit(spec.language)).alias("language"),
        get("tags", none()).alias("tags"),
        get("references", none()).alias("references"),
        N.clean_list(get("false_positives", none())).alias("false_positives"),
        F.col("content").alias("raw_content"),
        N.parse_date(get("created")).alias("rule_created_date"),
        N.parse_date(get("modified")).alias("rule_modified_date"),
        F.when(bad, "parse").otherwise(F.col("error_stage")).alias("error_stage"),
        F.when(bad, "warning").otherwise(F.col("error_severity")).alias("error_severity"),
        F.when(bad, "a required field is missing").otherwise(F.col("error_message")).alias("error_message"),
    )


def ingest(files: DataFrame, repos: dict[str, str], catalog: DataFrame | None = None, remap: DataFrame | None = None) -> DataFrame:
    """Files of several sources as one table of detections with error columns; ``repos`` maps source to repository URL.

    With a technique ``catalog``, hunting rules, which state no tactics, get those of their techniques; retired ids go
    by ``remap``, the public catalog's successors unless given.
    """
    from rulelens.operators import coverage
    from rulelens.sources.landing import landed

    out = None
    for source, url in repos.items():
        one = normalized(landed(files, source, DISCOVERY[source]), source, url)
        if catalog is not None and source == "elastic_hunting":
            table = coverage.resolve_table(catalog, coverage.technique_remap(files.sparkSession) if remap is None else remap)
            one = coverage.with_tactics(one, table, catalog)
        out = one if out is None else out.unionByName(one)
    return out
