import pytest
from tests import oracle
from tests.llm import cases
from tests.conftest import SF

import corpus_pipeline
from rulelens.llm import mixing, suffix_dedup
from rulelens.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    oracle.same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = QUERIES[name](spark, SF)
    if name == "op5_packing":
        rows = rows.where("piece = 0")
    assert rows.count() == rows.select("doc_id").distinct().count() == n


def test_pipeline(spark, tmp_path):
    """Every stage against what it must do to its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    raw, clean, unique, cut, mixed, packed = kept
    assert all(k.columns == columns for k in kept[:-1])
    scores = {r.doc_id: r.score for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}
    assert unique.join(clean, "doc_id", "left_anti").count() == 0
    assert unique.select("text").distinct().count() == unique.count()
    assert cut.count() == unique.count()
    report = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.dedup_report(unique).collect()}
    assert all(len(r.text.encode()) == report[r.doc_id] for r in cut.collect())
    assert mixed.join(cut, ["doc_id", "text"], "left_anti").count() == 0
    by = {r.source: r for r in mixing.source_targets(mixing.sizes(cut)).collect()}
    assert all(0 <= r.target <= 3 * r.source_size + 1e-6 for r in by.values())
    first = packed.where("piece = 0")
    assert first.count() == mixed.count()
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).head()[0] <= 1024


@pytest.mark.parametrize("table", [cases.awkward, cases.empty])
def test_pipeline_stages_on_awkward_and_empty_tables(spark, tmp_path, table):
    docs = table(spark)
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        if not n:
            assert docs.count() == 0
        elif name == "minhash_dedup":
            assert {1, 2, 3} <= {r.doc_id for r in docs.collect()}
