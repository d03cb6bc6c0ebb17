"""Versions, posting table, clustered lookups and bridge: against plain models, and what they leave unread."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rulelens.operators import coverage, ingest
from rulelens.operators.search import contains_text
from rulelens.sources.landing import read_files
from rulelens.store import bridge as B
from rulelens.store import postings as N
from rulelens.store.snapshots import SnapshotTable, content_hash, in_scope
from rulelens.streaming import refresh as stream

SCHEMA = "source string, id string, title string, n int"


def rows_of(table, version=None):
    return sorted((tuple(r) for r in table.read(version=version).select("source", "id", "title", "n").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def small(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), rows_per_file=2)
    table.apply(frame(spark, [("a", "1", "x", 1), ("a", "2", None, 2), (None, "1", "null source", 3), (None, None, "null key", 4), ("", "1", "empty source", 5), ("b", "1", "y", 6)]))
    return table


def test_null_sources_and_keys_are_kept(spark, small):
    assert small.apply(frame(spark, [(None, "1", "new", 30), (None, "9", "more", 31)])).number == 1
    got = rows_of(small)
    assert (None, "1", "new", 30) in got and (None, "9", "more", 31) in got and (None, None, "null key", 4) in got and ("", "1", "empty source", 5) in got
    assert len(got) == 7
    kinds = {(r.source, r.id): r.kind for r in small.changes().collect()}
    assert kinds == {(None, "1"): "change", (None, "9"): "insert"}


def test_emptied_source_and_rules_that_left(spark, small):
    small.apply(frame(spark, [("a", "2", None, 2)]), spark.createDataFrame([("a",), ("b",), (None,)], "source string"))
    assert rows_of(small) == sorted([("a", "2", None, 2), ("", "1", "empty source", 5)], key=str)
    assert {r.kind for r in small.changes().collect()} == {"delete"}
    assert len(rows_of(small, small.version(0))) == 6  # the version before is still there


def test_table_may_become_empty_and_fill_again(spark, small):
    every = small.read().select("source").distinct()
    small.apply(frame(spark, []), every)
    assert rows_of(small) == []
    small.apply(frame(spark, [("a", "1", "back", 1)]))
    assert rows_of(small) == [("a", "1", "back", 1)]


def test_rows_of_a_scope_are_not_dealt_by_its_few_values(spark):
    rows = spark.createDataFrame([("a", i) for i in range(300)] + [(None, 1), ("b", 2)], "source string, id int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = in_scope(rows, spark.createDataFrame([("a",), (None,), (None,)], "source string"))
        assert got.count() == 301
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_replayed_batch_changes_nothing(spark, small):
    batch = [("a", "1", "changed", 1), ("c", "1", "new", 9)]
    first = small.apply(frame(spark, batch))
    assert first is not None and small.apply(frame(spark, batch)) is None
    assert small.version().number == 1
    # a null and an empty text, and values that trade places, are different contents
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None), ("a", "")], "x string, y string")
    assert df.select(content_hash(["x", "y"]).alias("h")).distinct().count() == 4


def test_only_files_with_changes_are_written_anew(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), rows_per_file=5)
    table.apply(frame(spark, [("s", f"{i:03d}", "t", i) for i in range(60)]))
    before = {r.file for r in table.files().collect()}
    table.apply(frame(spark, [("s", "007", "changed", 7)]))
    after = {r.file for r in table.files().collect()}
    assert len(before - after) == 1 and len(after - before) == 1 and table.read().count() == 60
    number = table.version().number
    table.compact(1000)
    assert table.version().number == number + 1 and table.files().agg(F.sum("n_rows")).head()[0] == 60 and table.changes().count() == 0


@pytest.mark.parametrize("step", ["_write", "_publish_manifest", "publish"])
def test_failure_midway_leaves_the_version_before(spark, small, monkeypatch, step):
    before = rows_of(small)

    def fail(*_):
        raise OSError("disk gone")

    batch = frame(spark, [("a", "1", "changed", 1)])
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, step, fail)
        with pytest.raises(OSError):
            small.apply(batch, spark.createDataFrame([("b",)], "source string"))
    assert rows_of(small) == before and small.version().number == 0
    small.apply(batch, spark.createDataFrame([("b",)], "source string"))
    assert ("a", "1", "changed", 1) in rows_of(small) and not any(r[0] == "b" for r in rows_of(small))


def test_two_writers_and_a_torn_pointer(spark, small):
    v = small.version()
    with pytest.raises(Exception, match="(?i)exist"):
        small.publish(v.number, v.manifest, v.changes, v.schema)
    with open(f"{small.path}/versions/000000000001", "w") as f:
        f.write('{"manifest": "x"')  # a writer that died
    assert small.version().number == 0


def test_new_columns_and_random_batches_against_a_dict(spark, tmp_path):
    rng = random.Random(3)
    table = SnapshotTable(spark, str(tmp_path / "t"), rows_per_file=3)
    want = {}
    for step in range(4):
        batch = {(rng.choice(["a", "b", None]), str(rng.randrange(8))): (rng.choice(["x", "y", None]), rng.randrange(3)) for _ in range(9)}
        scope = rng.sample(["a", "b", None], step % 3)
        table.apply(frame(spark, [(*k, *v) for k, v in batch.items()]), spark.createDataFrame([(s,) for s in scope], "source string") if scope else None)
        want = {k: v for k, v in want.items() if k[0] not in scope} | batch
        assert rows_of(table) == sorted(((*k, *v) for k, v in want.items()), key=str)
    table.apply(spark.createDataFrame([("a", "0", "z", 1, 2.5)], SCHEMA + ", score double"))
    assert table.read().where("score is not null").count() == 1 and table.read().count() == len(set(want) | {("a", "0")})


def test_stream_of_versions(spark, tmp_path):
    landing, schema = str(tmp_path / "in"), SCHEMA + ", source_file string"
    table = SnapshotTable(spark, str(tmp_path / "t"))
    land = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
    run = lambda c: stream.snapshot_refresh(spark, landing, schema, lambda d: d, table, str(tmp_path / c), lambda d: d.select("source").distinct()).awaitTermination(90)
    land([("a", "1", "second", 1, "f2"), ("a", "1", "first", 1, "f1"), (None, "1", "n", 1, "f"), ("b", "1", "b", 1, "f")])
    run("c")
    assert rows_of(table) == sorted([("a", "1", "first", 1), (None, "1", "n", 1), ("b", "1", "b", 1)], key=str)
    land([("a", "2", "only", 1, "f"), (None, "2", "n2", 1, "f")])
    run("c")
    assert rows_of(table) == sorted([("a", "2", "only", 1), (None, "2", "n2", 1), ("b", "1", "b", 1)], key=str)


def test_old_versions_expire_with_their_files(spark, small):
    for k in range(3):
        small.apply(frame(spark, [("a", "1", f"x{k}", k), ("b", f"new{k}", "y", k)]))
    now, last = rows_of(small), small.version().number
    under_way = f"{small.path}/data/other"
    os.makedirs(under_way)
    assert small.expire(2) > 0 and rows_of(small) == now and len(rows_of(small, small.version(last - 1))) == len(now) - 1
    assert small.version(0) is None and small.version(1) is None and os.path.isdir(under_way) and small.expire(2) == 0
    on_disk = {f"{d}/{f}" for d in os.listdir(f"{small.path}/data") for f in os.listdir(f"{small.path}/data/{d}") if f.endswith(".parquet")}
    assert on_disk == {r.file for v in (last - 1, last) for r in small.files(small.version(v)).collect()}
    assert small.changes_since(last - 1).count() == 2 and small.changes_since(0) is None
    with pytest.raises(ValueError):
        small.expire(0)


# ---------------------------------------------------------------- posting table


def texts(rng, n):
    words = ["License", "powershell", "rundll32", "étude", "straße", "a_b%c", "x", "naïve🙂end", "multi\nline"]
    return [(f"s{i % 3}", f"{i:04d}", " ".join(rng.choice(words) for _ in range(2)) if i % 7 else None, i) for i in range(n)]


def test_search_gives_the_rows_of_a_scan(spark, tmp_path):
    rng = random.Random(1)
    table = SnapshotTable(spark, str(tmp_path / "t"), rows_per_file=40, block_rows=4)
    table.apply(frame(spark, texts(rng, 200)))
    assert len(N.index_new_files(table, ["title"])) == 1 and N.index_new_files(table, ["title"]) == []
    scanned_too = N.search_text(table, "s1", ["title", "source"])  # one of the columns has no postings yet
    assert scanned_too.count() == table.read().where("source = 's1'").count()
    assert len(N.index_new_files(table, ["title", "source"])) == 1
    for term in ["license", "POWERSHELL RUND", "Étude", "STRASSE", "a_b%c", "x", "", "🙂end", "multi\nline", "i\nl", "nothing", "s1", "s2  ", "e l"]:
        got = sorted(r.id for r in N.search_text(table, term, ["title", "source"]).collect())
        want = sorted(r.id for r in table.read().where(contains_text(term, ["title", "source"])).collect())
        assert got == want, term


def test_postings_are_made_by_more_tasks_for_more_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "TASK_BLOCKS", 2)
    table = SnapshotTable(spark, str(tmp_path / "t"), rows_per_file=40, block_rows=4)
    table.apply(frame(spark, texts(random.Random(2), 160)))
    (folder, column), = N.index_new_files(table, ["title"])
    assert os.listdir(f"{table.path}/postings/{folder}") == [column]  # nothing unsorted is left
    names = [n for n in os.listdir(f"{table.path}/postings/{folder}/{column}") if n.startswith("part-")]
    assert len(names) > 10  # of 20 tasks; a session has 4 partitions here
    assert N.search_text(table, "license", ["title"]).count() == table.read().where(contains_text("license", ["title"])).count() > 0


def test_unread_files_stay_unread_and_refresh_keeps_the_table(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), rows_per_file=50, block_rows=5)
    table.apply(frame(spark, [("s", f"{i:04d}", "needle here" if i == 120 else f"hay {i}", i) for i in range(400)]))
    N.index_new_files(table, ["title"])
    holds = [r.file for r in table.files().where("min_id <= '0120' and max_id >= '0120'").collect()]
    for name in {r.file for r in table.files().collect()} - set(holds):
        os.rename(f"{table.path}/data/{name}", f"{table.path}/data/{name}.away")  # reading it would fail
    assert [r.id for r in N.search_text(table, "NEEDLE", ["title"]).collect()] == ["0120"]
    blocks = N.candidate_blocks(table, sorted(N.indexed_folders(table, table.version(), ["title"])), "needle", ["title"]).collect()
    assert len(blocks) == 1  # of 80
    for name in {r.file for r in table.files().collect()} - set(holds):
        os.rename(f"{table.path}/data/{name}.away", f"{table.path}/data/{name}")
    table.apply(frame(spark, [("s", "0120", "gone", 120), ("s", "0390", "another needle", 390)]))
    assert [r.id for r in N.search_text(table, "needle", ["title"]).collect()] == ["0390"]  # the new files are scanned so far
    assert len(N.index_new_files(table, ["title"])) == 1
    assert [r.id for r in N.search_text(table, "needle", ["title"]).collect()] == ["0390"]


# ---------------------------------------------------------------- clustered lookups


def scanned(df):
    """Files and rows that the scans of a plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(df.inputFiles()), plan


def test_lookups_read_few_files(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), rows_per_file=25)
    table.apply(frame(spark, [(f"s{i % 4}", f"{i:05d}", "t" * 50, i) for i in range(1000)]))
    total = table.files().count()
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    assert total >= 40
    one = table.where_in("id", ["00123"])
    files, plan = scanned(one)
    assert files <= 4 and "PushedFilters" in plan and "EqualTo(id,00123)" in plan and [r.n for r in one.collect()] == [123]
    some = table.where_in("id", ["00123", "00124", "00999", "zzz"])
    assert scanned(some)[0] <= 8 and sorted(r.n for r in some.collect()) == [123, 124, 999]
    by_source = table.where_in("source", ["s1", "none"])
    assert scanned(by_source)[0] <= total // 4 + 2 and by_source.count() == 250
    assert size(one) * 8 < size(table.read()) and size(by_source) * 3 < size(table.read())
    assert table.where_in("id", ["nothing"]).count() == 0 and table.where_in("id", []).count() == 0


# ---------------------------------------------------------------- bridge


def test_bridge_follows_the_rules(spark, tmp_path):
    schema = "source string, id string, mitre_techniques array<string>"
    rules = SnapshotTable(spark, str(tmp_path / "rules"), rows_per_file=10)
    rows = [("a" if i % 3 else None, str(i), [f"T10{i % 5}", f"t10{i % 5}.001", None, f"T10{i % 5}"][: i % 5]) for i in range(60)]
    rules.apply(spark.createDataFrame([*rows, ("a", "null", None)], schema))
    same = lambda: sorted(map(str, B.tags(B.bridge_table(rules)).collect())) == sorted(map(str, coverage.bridge(rules.read()).where("technique is not null").collect()))
    assert B.refresh_bridge(rules) is not None and same() and B.refresh_bridge(rules) is None
    before = {r.file for r in B.bridge_table(rules).files().collect()}
    rules.apply(spark.createDataFrame([("a", "1", ["T999"]), ("a", "new", ["T100"])], schema))
    rules.apply(spark.createDataFrame([], schema), spark.createDataFrame([(None,)], "source string"))
    B.refresh_bridge(rules)
    assert same() and B.tags(B.bridge_table(rules)).where("technique = 'T999'").count() == 1
    assert {r.id for r in B.with_techniques(B.bridge_table(rules), ["t999", "T100"]).collect()} == {r.id for r in rules.read().where("arrays_overlap(transform(mitre_techniques, x -> lower(x)), array('t999', 't100'))").collect()}
    assert before  # the table kept its files or wrote new ones; its rows were compared above
    assert "Generate explode" not in B.with_techniques(B.bridge_table(rules), ["t1"])._jdf.queryExecution().toString()


def test_bridge_is_made_anew_where_versions_expired(spark, tmp_path):
    schema = "source string, id string, mitre_techniques array<string>"
    rules = SnapshotTable(spark, str(tmp_path / "rules"))
    rules.apply(spark.createDataFrame([("a", "1", ["T1"]), ("b", "1", ["T2"])], schema))
    B.refresh_bridge(rules)
    rules.apply(spark.createDataFrame([], schema), spark.createDataFrame([("b",)], "source string"))
    rules.apply(spark.createDataFrame([("c", "1", ["T3"])], schema))
    rules.expire(1)
    B.refresh_bridge(rules)
    assert sorted(r.technique for r in B.tags(B.bridge_table(rules)).collect()) == ["T1", "T3"]


def test_bridge_refresh_that_died_before_its_mark(spark, tmp_path, monkeypatch):
    schema = "source string, id string, mitre_techniques array<string>"
    rules = SnapshotTable(spark, str(tmp_path / "rules"))
    rules.apply(spark.createDataFrame([("a", "1", ["T1"]), ("b", "1", ["T2"])], schema))
    B.bridge_table(rules).apply(B.exploded(rules.read(), "mitre_techniques"))  # no mark
    rules.apply(spark.createDataFrame([], schema), spark.createDataFrame([("b",)], "source string"))
    B.refresh_bridge(rules)
    assert [r.technique for r in B.tags(B.bridge_table(rules)).collect()] == ["T1"]


# ---------------------------------------------------------------- null partitions and roots


def test_merge_keeps_null_sources(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "source string, id string, n int"
    ingest.merge_rows(spark.createDataFrame([(None, "x", 1), (None, "y", 2), ("a", "x", 3)], schema), path)
    out = ingest.merge_rows(spark.createDataFrame([(None, "y", 5), (None, "z", 6)], schema), path)
    assert {(r.source, r.id, r.n) for r in out.collect()} == {(None, "x", 1), (None, "y", 5), (None, "z", 6), ("a", "x", 3)}


@pytest.mark.parametrize("root", ["rules", "myrules/rules", "a b/ru[l]es", "x%20y/rules/rules"])
def test_relative_paths_do_not_depend_on_the_root(spark, tmp_path, root):
    base = tmp_path / root
    (base / "rules" / "sub dir").mkdir(parents=True)
    (base / "a.yml").write_text("a")
    (base / "rules" / "sub dir" / "b%20c.yml").write_text("b")
    got = {r.path: r.content for r in read_files(spark, str(base)).collect()}
    assert got == {"a.yml": "a", "rules/sub dir/b%20c.yml": "b"}


def test_only_rule_files_are_opened(spark, tmp_path):
    from rulelens.sources.landing import DISCOVERY, listed_files, read_rule_files

    root = tmp_path / "clone of [x]"
    files = {"rules/a.yml": b"a: 1", "rules/deep er/b.yaml": "b: é".encode(), "rules/bad.yml": b"ok\xff\xfe", "rules/tests/c.yml": b"c", "other/d.yml": b"d", "rules/e.txt": b"e"}
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    assert {r.path for r in listed_files(spark, str(root)).collect()} == set(files)
    assert "content" not in listed_files(spark, str(root))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    got = read_rule_files(spark, str(root), DISCOVERY["sigma"])
    assert {r.path: (r.content, r.bad_byte_at) for r in got.collect()} == {"rules/a.yml": ("a: 1", None), "rules/deep er/b.yaml": ("b: é", None), "rules/bad.yml": (None, 2)}
    assert len(got.inputFiles()) == 3
    assert read_rule_files(spark, str(root), DISCOVERY["splunk"]).count() == 0


def test_one_job_writes_rows_quarantine_and_counters(spark, tmp_path):
    rows = spark.createDataFrame([(i, [None, "parse", "skipped", "read"][i % 4]) for i in range(40)], "id int, error_stage string").withColumns({"error_severity": F.when(F.col("error_stage") == "read", "error").when(F.col("error_stage") == "parse", "warning"), "error_message": F.lit("m")})
    path, log = str(tmp_path / "out"), str(tmp_path / "log")
    status = spark.sparkContext.statusTracker()
    before = len(status.getJobIdsForGroup())
    got = ingest.write_ingested(rows, path)
    assert len(status.getJobIdsForGroup()) == before + 1
    assert got == ingest.ingest_stats(rows).head().asDict() and got["stored"] == 10 and got["errors"] == 10
    back = spark.read.parquet(path)
    assert back.where("quarantined = 'true'").count() == 30 and back.where("quarantined = 'false'").count() == 10
    ingest.recorded_ingest(spark, rows, str(tmp_path / "second"), log)
    with pytest.raises(Exception):  # noqa: B017  the folder is there already
        ingest.recorded_ingest(spark, rows, path, log)
    runs = sorted((r.status, r.stored, r.errors) for r in spark.read.parquet(log).collect())
    assert runs == [("completed", 10, 10), ("failed", None, 1)]


def test_stream_of_trends_is_exact_and_drops_late_rows(spark, tmp_path):
    from rulelens.operators import trending

    schema = "event_id long, ts timestamp, user_id long, event_type string"
    rng = random.Random(5)
    frame_of = lambda rows: spark.createDataFrame([(i, d, h, u, t) for i, d, h, u, t in rows], "event_id long, d int, h int, user_id long, event_type string").select("event_id", F.timestamp_seconds(1704067200 + F.col("d") * 86400 + F.col("h") * 3600).alias("ts"), "user_id", "event_type")
    first = [(i, rng.randrange(20), rng.randrange(24), rng.choice([None, 1, 2, 3, 4]), rng.choice(["a", "b"])) for i in range(300)]
    ahead, late, last = [(900, 40, 0, 9, "a")], [(901, 5, 0, 77, "a")], [(902, 41, 0, 9, "b")]
    spool = str(tmp_path / "spool")
    for k, rows in enumerate((first, ahead, late + last)):
        frame_of(rows).coalesce(1).write.parquet(f"{spool}/{k}")
        for f in os.listdir(f"{spool}/{k}"):
            os.utime(f"{spool}/{k}/{f}", (1_700_000_000 + k * 100,) * 2)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(spool)
    out = str(tmp_path / "windows")
    q = stream.trending_append(live).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = trending.windowed(frame_of(first + ahead + last)).where("window_start < '2024-02-03'")  # ended before the watermark
    key = lambda df: sorted(map(tuple, df.select("window_start", "event_type", "n", "last", "users").collect()))
    assert key(spark.read.parquet(out)) == key(want) and want.count() > 30
    assert key(trending.windowed_append(frame_of(first))) == key(trending.windowed(frame_of(first)))
    whole = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{spool}/0")
    q = stream.trending_stream(whole).writeStream.format("memory").queryName("exact").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert key(spark.table("exact")) == key(trending.windowed(frame_of(first)))
