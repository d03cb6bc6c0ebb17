import json

from pyspark.sql import functions as F

from rulelens.functions import normalize as N
from rulelens.operators import coverage
from rulelens.sources import catalog
from rulelens.sources.corpus import remap


def technique(tid, name, *phases, **more):
    return {"type": "attack-pattern", "name": name, "external_references": [{"external_id": "CVE-1"}, {"external_id": tid, "url": f"u/{tid}"}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": p} for p in phases] + [{"kill_chain_name": "other", "phase_name": "execution"}], **more}


def tactic(tid, name, short):
    return {"type": "x-mitre-tactic", "name": name, "x_mitre_shortname": short, "external_references": [{"external_id": tid}]}


OBJECTS = [
    technique("T1001", "Before its tactic", "persistence", "execution"),
    tactic("TA0002", "Execution", "execution"),
    tactic("TA0003", "Persistence", "persistence"),
    technique("T1002", "Old", "execution", x_mitre_deprecated=True),
    technique("T1003", "Gone", "execution", revoked=True),
    technique("T1004", "Gone with an heir", "execution", revoked=True),
    technique("T1999.001", "Parent is missing", "persistence"),
    technique("T1005", "No known phase", "nowhere"),
    {"type": "attack-pattern", "name": "no id", "external_references": [{"external_id": "X1"}]},
    {"type": "malware", "name": "other"},
]


def test_stix(spark, tmp_path):
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps({"objects": OBJECTS}, indent=1))
    tactics, techniques = catalog.load_stix(spark, str(path))
    assert {(r.id, r.short_name, r.deprecated) for r in tactics.collect()} == {("TA0002", "execution", False), ("TA0003", "persistence", False)}
    by = {r.id: r for r in techniques.collect()}
    assert set(by) == {"T1001", "T1002", "T1003", "T1004", "T1005", "T1999.001"}
    assert by["T1001"].tactics == ["TA0003", "TA0002"] and by["T1005"].tactics == [] and by["T1001"].url == "u/T1001"
    assert by["T1002"].deprecated and by["T1003"].revoked and by["T1999.001"].is_subtechnique
    table = {r.technique: r.mapped for r in coverage.resolve_table(techniques, remap(spark, {"T1004": "T1001"})).collect()}
    assert table == {"T1001": "T1001", "T1005": "T1005", "T1999.001": "T1999.001", "T1002": "T1002", "T1003": "T1003", "T1004": "T1001"}
    tags = spark.createDataFrame([("a", ["T1004", "T1999.001"]), ("b", ["T1234.005"])], "id string, t array<string>").select(F.lit("s").alias("source"), "id", F.explode("t").alias("technique"))
    derived = coverage.derive_tactics(tags, coverage.resolve_table(techniques, remap(spark, {"T1004": "T1001"})), techniques)
    assert {r.id: r.tactics for r in derived.collect()} == {"a": ["TA0002", "TA0003"]}


def test_fallback(spark):
    tactics, techniques = catalog.fallback(spark)
    assert tactics.count() == 14 and techniques.count() == 0


def test_variant_strings(spark):
    df = spark.createDataFrame([('["a", {"name": "n"}, {"id": 5}, {"Schema": "s"}, {"x": 1}, 7, null]',)], "j string")
    out = df.select(N.variant_strings(F.try_variant_get(F.parse_json("j"), "$", "array<variant>")).alias("s")).head().s
    assert out[:4] == ["a", "n", "5", "s"] and out[4] == '{"x":1}' and out[5] == "7"
