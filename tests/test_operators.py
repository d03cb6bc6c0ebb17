"""Contracts, invariants and plans of the operators, beside the comparison with SQL."""

import random

import pytest
from pyspark.sql import functions as F

from rulelens.functions import dims
from rulelens.functions import normalize as N
from rulelens.operators import compare, coverage, ingest, search, trending
from rulelens.sources.corpus import catalog, detections, remap
from rulelens.streaming import refresh as stream
from tests.conftest import SF


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head().x


def strs(values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def test_contracts(spark):
    rules = spark.createDataFrame([("a", "1")], "source string, id string")
    with pytest.raises(ValueError):
        compare.compare(rules)
    with pytest.raises(ValueError):
        search.page(rules, [F.col("id")], -1, 10)
    with pytest.raises(ValueError):
        search.page(rules, [F.col("id")], 0, 201)
    with pytest.raises(ValueError):
        compare.side_by_side(rules, ["id"], 7)
    with pytest.raises(ValueError):
        compare.gap(rules, "x", "a", known=["a"])
    with pytest.raises(ValueError):
        trending.recent(rules, "id", F.current_timestamp(), 3)
    with pytest.raises(ValueError):
        coverage.matrix(rules, rules, ["a"], tactic="ta9999")
    with pytest.raises(ValueError):
        ingest.feed_union({"a": rules}, "id", "b")


def test_gap_partition(spark):
    items = detections(spark, SF).select(F.col("source").alias("grp"), F.explode("mitre_techniques").alias("item"))
    g = compare.gap(items, "src0", "src1").agg(F.count_if("in_base").alias("b"), F.count_if(F.col("in_base") & F.col("in_other")).alias("o"), F.count_if(F.col("in_base") & ~F.col("in_other")).alias("d")).head()
    assert g.b == g.o + g.d == items.where("grp = 'src0'").select("item").distinct().count()


def test_rollup_counts_tags_and_parents(spark):
    tags = coverage.bridge(detections(spark, SF))
    total = coverage.rollup(tags).agg(F.sum("n")).head()[0]
    assert total == tags.count() + tags.where("technique like '%.%'").count()


def test_resolve_table(spark):
    rows = [("T1", False, False), ("T2", True, False), ("T3", False, True), ("T4", True, False)]
    cat = spark.createDataFrame(rows, "id string, revoked boolean, deprecated boolean")
    table = coverage.resolve_table(cat, remap(spark, {"T2": "T1", "T3": "T9", "T8": "T1"}))
    assert {tuple(r) for r in table.collect()} == {("T1", "T1"), ("T2", "T1"), ("T3", "T3"), ("T4", "T4"), ("T8", "T1")}


def test_plans_stay_in_the_jvm(spark):
    rules, cat = detections(spark, SF), catalog(spark, SF)
    tags = coverage.resolved(coverage.bridge(rules), coverage.resolve_table(cat, remap(spark)))
    plans = [coverage.rollup(tags, "mapped"), rules.select(N.platform(F.col("detection_logic"))), search.facets(rules)]
    for df in plans:
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "EvalPython" not in plan
    assert "BroadcastHashJoin" in plans[0]._jdf.queryExecution().toString()
    narrow = search.facets(rules, ["source", "status"])._jdf.queryExecution().toString()
    assert "text" not in narrow.split("ReadSchema: ")[1].split(">")[0]


def test_vocabularies(spark):
    status = {"Production": "stable", "testing": "experimental", "OBSOLETE": "deprecated", "x": "unknown", None: "unknown", "": "unknown"}
    for raw, want in status.items():
        assert one(spark, N.norm_status(F.lit(raw).cast("string"))) == want
    severity = {"informational": "low", "moderate": "medium", "Severe": "critical", "??": "unknown", None: "unknown"}
    for raw, want in severity.items():
        assert one(spark, N.norm_severity(F.lit(raw).cast("string"))) == want


def test_dates(spark):
    cases = {"2024-03-04": "2024-03-04 00:00:00", "2024/03/04": "2024-03-04 00:00:00", "04/03/2024": "2024-03-04 00:00:00", "03/25/2024": "2024-03-25 00:00:00", "2024-03-04T05:06:07": "2024-03-04 05:06:07", "2024-03-04T05:06:07Z": "2024-03-04 05:06:07", "2024-03-04T05:06:07.5": "2024-03-04 05:06:07.500000", "2024-03-04T05:06:07.123456Z": "2024-03-04 05:06:07.123456", " 2024-03-04 05:06:07 ": "2024-03-04 05:06:07", "soon": "None", "": "None"}
    for raw, want in cases.items():
        assert str(one(spark, N.parse_date(F.lit(raw)))) == want


def test_texts(spark):
    assert one(spark, N.title_case(F.lit("foo-bar o'neil x1y"))) == "foo-bar o'neil x1y".title()
    assert one(spark, N.sanitize(F.lit("a\x00b\tc\x7f"))) == "ab\tc" and one(spark, N.sanitize(F.lit(None).cast("string"))) == ""
    assert one(spark, N.repair_lines(F.lit("a: *x\nb: 'ok%'\nc: 50%\nd: e\n- *y"))) == "a: '*x'\nb: 'ok%'\nc: '50%'\nd: e\n- '*y'"
    assert one(spark, N.technique_norm(F.lit("attack.t1059.001"))) == "T1059.001" and one(spark, N.technique_norm(F.lit("1059"))) == "T1059"
    assert one(spark, N.rule_url(F.lit("https://e.org/r.git"), F.lit("\\a\\b c.yml"), "dev")) == "https://e.org/r/blob/dev/a/b c.yml"
    assert one(spark, N.score_bucket(F.lit(None).cast("int"), F.lit(61.0))) == "high" and one(spark, N.score_bucket(F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit("Low"))) == "low"


def label(raw):
    low = raw.lower().strip()
    if low in dims.DATA_SOURCE_LABELS:
        return dims.DATA_SOURCE_LABELS[low]
    return next((v for k, v in dims.DATA_SOURCE_LABELS.items() if k in low), raw.replace("_", " ").title())


def best(text, rows):
    scores = [(sum(w in text for w in words), i) for i, words in dims.keywords(rows)]
    top = max(n for n, _ in scores)
    return next(i for n, i in scores if n == top) if top else ""


def test_taxonomy_against_a_plain_model(spark):
    rng = random.Random(1)
    bits = [w for _, ws in dims.keywords(dims.PLATFORMS) for w in ws] + [w for _, ws in dims.keywords(dims.EVENT_CATEGORIES) for w in ws] + list(dims.DATA_SOURCE_LABELS) + ["zq", "other_thing", "x-y"]
    texts = [rng.choice(["", " ", "_"]).join(rng.choice(bits) for _ in range(rng.randrange(0, 5))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", N.platform(F.col("t")).alias("p"), N.event_category(F.col("t")).alias("e"), N.data_source(F.col("t")).alias("d"), N.label_map(F.array("t")).alias("l")).collect()
    for r in out:
        assert r.p == best(r.t.lower(), dims.PLATFORMS) and r.e == best(r.t.lower(), dims.EVENT_CATEGORIES)
        assert r.d == next((s[0] for s in dims.DATA_SOURCES if s[0] in r.t.lower()), "")
        assert r.l == ([label(r.t)] if r.t else [])


def test_hints(spark):
    hint = lambda p: one(spark, N.platform(F.lit("linux"), F.lit(p).cast("string")))
    assert hint("EKS") == "kubernetes" and hint("exchange_online") == "exchange" and hint("microsoft-365") == "microsoft_365" and hint("nothing") == "linux" and hint(None) == "linux"
    assert one(spark, N.platform(F.lit(""), None, F.lit("CloudTrail"))) == "aws"
    assert one(spark, N.platform(F.lit(""), None, None, strs(["x", "logs-okta*"]))) == "okta"
    assert one(spark, N.data_source(F.lit(""), F.lit("Sysmon"))) == "sysmon" and one(spark, N.data_source(F.lit(""), None, strs(["winlogbeat-*"]))) == "winlogbeat"
    assert one(spark, N.event_category(F.lit(""), F.lit("dns-query"))) == "dns"


def test_sort_and_keyset_page(spark):
    rows = spark.createDataFrame([(i, f"t{i % 4}" if i % 5 else None, ["low", "critical", "medium", "unknown", "high"][i % 5]) for i in range(40)], "id int, title string, severity string")
    for descending in (False, True):
        got = search.page(rows, search.sort_order("title", descending), 0, 7).collect()
        while more := search.page_after(rows, "title", (got[-1].title, got[-1].id), 7, descending=descending).collect():
            got += more
        assert got == rows.orderBy(*search.sort_order("title", descending)).collect()
    assert rows.orderBy(*search.sort_order("severity_rank", True)).head().severity == "critical"
    assert rows.orderBy(*search.sort_order("no such column")).head().title == "t0"


def test_refresh_replaces_only_its_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.refresh(spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int"), path)
    out = ingest.refresh(spark.createDataFrame([("a", 3)], "source string, n int"), path)
    assert {(r.source, r.n) for r in out.collect()} == {("a", 3), ("b", 2)}


def test_streams(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int").write.parquet(landing)
    run = lambda: stream.incremental_refresh(spark, landing, "source string, n int", lambda d: d, table, str(tmp_path / "c"), whole=True).awaitTermination(60)
    run()
    spark.createDataFrame([("a", 5)], "source string, n int").write.mode("append").parquet(landing)
    run()
    assert {(r.source, r.n) for r in spark.read.parquet(table).collect()} == {("a", 5), ("b", 2)}
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    spool = str(tmp_path / "events")
    events.write.parquet(spool)
    live = stream.trending_stream(spark.readStream.schema(events.schema).parquet(spool))
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    same = lambda df: {(r.window_start, r.event_type, r.n, r["last"]) for r in df.collect()}
    assert same(spark.table("live")) == same(trending.windowed(events))


def test_stream_merges_part_of_a_source(spark, tmp_path):
    landing, table, schema = str(tmp_path / "in"), str(tmp_path / "out"), "source string, id string, n int"
    spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], schema).write.parquet(landing)
    run = lambda: stream.incremental_refresh(spark, landing, schema, lambda d: d, table, str(tmp_path / "c")).awaitTermination(60)
    run()
    spark.createDataFrame([("a", "x", 5), ("a", "w", 6), ("c", "v", 7)], schema).write.mode("append").parquet(landing)
    run()
    assert {(r.source, r.id, r.n) for r in spark.read.parquet(table).collect()} == {("a", "x", 5), ("a", "y", 2), ("a", "w", 6), ("b", "z", 3), ("c", "v", 7)}


def test_pivot_statistics_and_differences(spark):
    rules = spark.createDataFrame([("a", "low", ["x, y"]), ("a", None, ["x", "y"]), (None, "odd", [])], "source string, severity string, tags array<string>")
    got = {r.source: (r.low, r.unknown) for r in search.severity_pivot(rules).collect()}
    assert got == {"a": (1, 1), None: (0, 1)}
    stats = {(r.facet, r.value): r.n for r in search.statistics(rules, {"severity": ["low", "high"]}).collect()}
    assert stats == {("source", "a"): 2, ("severity", "low"): 1, ("severity", "high"): 0, ("severity", "odd"): 1, ("total", "all"): 3}
    rows = rules.limit(2).withColumn("pos", F.lit(1))
    assert {r.field: r.differs for r in compare.differing(rows, ["source", "severity", "tags"]).collect()} == {"source": False, "severity": True, "tags": True}
    assert coverage.known_sources(rules) == ["a"]
    with pytest.raises(ValueError):
        coverage.known_sources(spark.range(5).select(F.col("id").cast("string").alias("source")), 4)


def test_catalog_stats_and_lookups(spark):
    cat = spark.createDataFrame([("T1", "n", ["TA0001", "TA0002"], False, False, False)], "id string, name string, tactics array<string>, revoked boolean, deprecated boolean, is_subtechnique boolean")
    assert coverage.catalog_stats(cat).head().asDict() == {"tactics": 2, "techniques": 1, "subtechniques": 0}
    assert coverage.catalog_stats(cat, dims.tactics(spark)).head().tactics == 14
    assert coverage.tactic_of(dims.tactics(spark), "ta0040").head().name == "Impact" and coverage.technique_of(cat, "t1").count() == 1
    table = coverage.resolve_table(spark.createDataFrame([("T1059.001", "p", ["TA0002"], False, False, True)], cat.schema), coverage.technique_remap(spark))
    assert coverage.resolved(spark.createDataFrame([("T1086",)], "technique string"), table).head().mapped == "T1059.001"
    assert dims.display_name("aws") == "AWS" and dims.display_name("some_thing") == "Some Thing" and dims.display_name("") == "Unknown"
    assert "aws" in dims.platforms_of("cloud") and dims.event_categories(spark).count() == len(dims.EVENT_CATEGORIES) and dims.data_sources(spark).count() == len(dims.DATA_SOURCES)


def test_ingest_records(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p1", None, None, None), ("a", "p2", "parse", "warning", "m"), ("a", "p3", "skipped", None, "s"), ("b", "p0", "normalize", "error", "n"), ("b", "p5", "read", "error", "r")], "source string, path string, error_stage string, error_severity string, error_message string")
    got = ingest.ingest_stats(rows).head()
    assert (got.discovered, got.skipped, got.parsed, got.normalized, got.stored, got.errors, got.warnings) == (5, 1, 2, 1, 1, 2, 1)
    assert [r.path for r in ingest.error_sample(rows, "path", 2).collect()] == ["p0", "p2"]
    log = str(tmp_path / "log")
    per = spark.createDataFrame([("a", 2, 1), ("b", 0, 3)], "source string, stored long, errors long")
    ingest.logged_run(spark, log, lambda: ingest.run_summary(per))
    with pytest.raises(ZeroDivisionError):
        ingest.logged_run(spark, log, lambda: 1 / 0)
    runs = {r.status: r for r in spark.read.parquet(log).collect()}
    assert runs["completed"].stored == 2 and runs["completed"].results["b"].errors == 3 and runs["completed"].duration_seconds >= 0
    assert runs["failed"].error_message == "division by zero" and runs["failed"].errors == 1
    old = spark.createDataFrame([("a", 7, "old"), ("b", 8, "old"), ("c", 9, "old")], "source string, rule_count long, commit string")
    tried = spark.createDataFrame([("a", "new", None), ("b", "new", "no route")], "source string, commit string, error string")
    dim = {r.source: r for r in ingest.source_dim(old, rows.where("source = 'a'"), F.lit("2025-01-01").cast("timestamp"), tried).collect()}
    assert (dim["a"].rule_count, dim["a"].commit, dim["a"].status) == (3, "new", "synced") and dim["a"].last_sync is not None
    assert (dim["b"].rule_count, dim["b"].commit, dim["b"].status, dim["b"].error) == (8, "old", "failed", "no route")
    assert (dim["c"].rule_count, dim["c"].status, dim["c"].last_sync) == (9, "pending", None)


def test_sanitize_invalid_bytes(spark):
    assert one(spark, N.sanitize(F.concat(F.unhex(F.lit("61FF62")).cast("string"), F.lit("\x07c")))) == "a\ufffdbc"


def test_empty_tables(spark):
    rules = detections(spark, SF).limit(0)
    cat = catalog(spark, SF).limit(0)
    assert search.facets(rules).count() == 0 and coverage.rollup(coverage.bridge(rules)).count() == 0
    assert coverage.matrix(coverage.rollup(coverage.bridge(rules)), cat, ["a"]).count() == 0
    assert {tuple(r) for r in search.statistics(rules, {"severity": ["low"]}).collect()} == {("severity", "low", 0), ("total", "all", 0)}
    assert coverage.catalog_stats(cat).head().asDict() == {"tactics": 0, "techniques": 0, "subtechniques": 0}
    assert ingest.ingest_stats(ingest.staged(rules, [("read", "error", F.lit(False), "x")])).head().success_rate == 0.0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_gap_of_all_pairs_against_sets(spark):
    rng = random.Random(7)
    items = [(rng.randrange(60) or None, f"i{rng.randrange(40)}" if rng.random() > 0.05 else None) for _ in range(900)]
    sets = {}
    for g, i in items:
        if g is not None and i is not None:
            sets.setdefault(g, set()).add(i)
    got = {(r.a, r.b): (r.base_n, r.other_n, r.overlap, r.gap) for r in compare.gap_all_pairs(spark.createDataFrame(items, "grp int, item string")).collect()}
    assert got == {(a, b): (len(x), len(y), len(x & y), len(x - y)) for a, x in sets.items() for b, y in sets.items() if a != b}
    assert compare.gap_all_pairs(spark.createDataFrame([("a", "x")], "grp string, item string")).count() == 0
    assert compare.gap_all_pairs(spark.createDataFrame([], "grp string, item string")).count() == 0


def test_gap_of_two_thousand_sources(spark):
    """Every item in every third source; more than one tile of the product."""
    items = spark.range(2400).select(F.concat(F.lit("s"), F.col("id")).alias("grp"), F.explode(F.array(*(F.lit(k) for k in range(6)))).alias("item")).where("(cast(substring(grp, 2) as int) + item) % 3 = 0")
    got = compare.gap_all_pairs(items)
    assert "SortMergeJoin [i" not in got._jdf.queryExecution().toString()
    n = got.agg(F.count("*").alias("n"), F.sum("overlap").alias("o"), F.max("overlap").alias("m")).head()
    assert n.n == 2400 * 2399 and n.m == 2 and n.o == 2 * 3 * 800 * 799


def test_matrix_of_many_odd_sources(spark):
    """Null sources and sources named like columns count, whatever their number; nothing runs while the plan is made."""
    schema = "id string, name string, tactics array<string>, revoked boolean, deprecated boolean, is_subtechnique boolean"
    cat = spark.createDataFrame([("T1", "one", ["TA0001", "TA0002"], False, False, False), ("T1.001", "sub", ["TA0002"], False, False, True), ("T2", "two", ["TA0040"], False, False, False), ("T3", "gone", ["TA0040"], True, False, False)], schema)
    names = [None, "total", "any", "name", "technique", "source", "", *(f"s{i}" for i in range(5000))]
    rules = spark.createDataFrame([(s, f"r{k}", ["T1.001"] if k % 2 else ["T1", "T9"]) for k, s in enumerate(names)], "source string, id string, mitre_techniques array<string>")
    status = spark.sparkContext.statusTracker()
    before = len(status.getJobIdsForGroup())
    counts = coverage.rollup(coverage.bridge(rules))
    matrix, summary = coverage.long_matrix(counts, cat, rules), coverage.long_summary(counts, cat, rules)
    assert len(status.getJobIdsForGroup()) == before
    cell = lambda s, t: matrix.where(F.col("source").eqNullSafe(F.lit(s)) & (F.col("technique") == t)).select("n", "total", "n_sources").distinct().collect()
    assert matrix.count() == len(names) * 4
    total = len(names)
    assert cell(None, "T1") == [(1, total, total)] and cell("total", "T1.001") == [(1, total // 2, total // 2)] and cell("any", "T1.001") == [(0, total // 2, total // 2)] and cell("name", "T2") == [(0, 0, 0)]
    odd = {(r.level, r.source): (r.covered, r.techniques, r.percent) for r in summary.collect()}
    assert odd["all", "any"] == (2, 3, 66.7) and odd["source", "any"] == (1, 3, 33.3) and odd["source", "total"] == (2, 3, 66.7) and odd["source", None] == (1, 3, 33.3) and len(odd) == total + 1
    compat = {(r.level, r.source): (r.covered, r.techniques) for r in coverage.long_summary(counts, cat, rules, compat=True).collect()}
    assert compat["all", "any"] == (2, 4)
    totals = {r.technique: (r.total, r.n_sources) for r in coverage.cell_totals(counts, cat, [None, "any"]).collect()}
    assert totals == {"T1": (2, 2), "T1.001": (0, 0), "T2": (0, 0)}
    assert [r.technique for r in coverage.gaps_view(coverage.cell_totals(counts, cat, tactic="ta0002", subtechniques=False), covered=True).collect()] == ["T1"]
    empty = rules.limit(0)
    none = coverage.rollup(coverage.bridge(empty))
    assert coverage.long_matrix(none, cat, empty).count() == 0 and [tuple(r)[2:] for r in coverage.long_summary(none, cat, empty).collect()] == [(0, 3, 0.0)]
    with pytest.raises(ValueError):
        coverage.matrix(counts, cat, ["total"])
    with pytest.raises(ValueError):
        coverage.cells(cat, "ta9999")
