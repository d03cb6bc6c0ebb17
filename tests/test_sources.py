"""Rule files of all sources: one good, one with a missing field, one malformed, list and scalar variants."""

import pytest
from pyspark.sql import functions as F

from rulelens.operators import ingest as G
from rulelens.sources import landing, specs

FILES = {
    "rules/windows/process_creation/ps.yml": """title: Odd shell start
id: 11111111-2222-3333-4444-555555555555
status: Stable
description: Starts a shell oddly
author: Someone
date: 2024/03/05
modified: 2024-04-01
logsource: {product: Windows, category: process_creation}
detection:
  selection: {Image|endswith: [a.exe, b.exe]}
  condition: selection
level: high
falsepositives: Admin work
tags: [attack.execution, attack.t1059.001, attack.defense-evasion, attack.t1027, attack.s0002, cve.2024]
""",
    "rules/linux/none.yml": "title: No detection\nlogsource: {product: linux}\n",
    "rules/linux/bad.yml": "title: [unclosed\n",
    "rules/tests/skip.yml": "title: x\ndetection: {a: b}\n",
    "rules/windows/el.toml": """[metadata]
creation_date = "2023/01/31"
maturity = "production"
[rule]
author = ["A", "B"]
index = ["winlogbeat-*", "logs-endpoint.events.*"]
language = "kuery"
name = "Registry change"
type = "query"
query = "registry.path : x"
severity = "Medium"
tags = ["Domain: Endpoint", "OS Windows"]
false_positives = ["none known", " "]
[[rule.threat]]
framework = "MITRE ATT&CK"
  [rule.threat.tactic]
  id = "TA0003"
  [[rule.threat.technique]]
  id = "T1547"
    [[rule.threat.technique.subtechnique]]
    id = "T1547.001"
""",
    "rules/ml/job.toml": "[metadata]\nmaturity = 'development'\n[rule]\nname = 'Rare'\ntype = 'machine_learning'\nmachine_learning_job_id = ['j1', 'j2']\nseverity = 'low'\n",
    "rules/ml/bad.toml": "[rule\nname = ",
    "detections/endpoint/sp.yml": """name: Dump
id: abc
author: [X, Y]
date: '2024-05-06'
status: production
search: '| tstats from datamodel=Endpoint sysmon process dns'
data_source: [Sysmon EventID 1]
known_false_positives: few
tags: {analytic_story: [Big Story], asset_type: Endpoint, mitre_attack_id: [T1003.001, TA0006], impact: 90, confidence: 90}
""",
    "detections/endpoint/sp2.yml": "name: Scored\nsearch: x\nstatus: experimental\nrba: {risk_objects: [{score: 45}, {score: '61'}, {score: bad}]}\ntags: {asset_type: [AWS Account], mitre_attack_id: T1110}\n",
    "detections/endpoint/sp3.yml": "name: No search\n",
    "detection-rules/mail.yml": "name: Mail\nsource: type.inbound\nseverity: critical\nauthors: [{name: N}, z]\ntactics_and_techniques: [Initial Access, T1566.001, junk]\ndetection_methods: [Header analysis]\nattack_types: [Phishing]\n",
    "detection-rules/mail2.yml": "name: Mail2\nsource: x\nauthors: [plain]\nfalse_positives: one\n",
    "detection-rules/bad.yml": "name: 'open\n",
    "behavior/rules/windows/bp.toml": "[rule]\nname = 'Block'\nid = 'i'\nquery = 'process where true'\nos_list = ['Windows']\n[[actions]]\naction = 'block'\n[[threat]]\n[threat.tactic]\nid = 'TA0002'\n[[threat.technique]]\nid = 'T1059'\n",
    "behavior/rules/cross-platform/cp.toml": "[rule]\nname = 'Watch'\n",
    "behavior/rules/linux/none.toml": "[rule]\nid = 'x'\n",
    "detections/sigma/rmm.yml": "title: Tool\ndetection: {s: {a: b}, condition: s}\nlevel: low\ntags: [Remote]\nlogsource: {product: windows, service: sysmon}\n",
    "detections/sigma/rmm2.yml": "title: Tool2\ndetection: {s: {a: b}}\ntags: [LOLRMM]\n",
    "detections/sigma/rmm3.yml": "title: Tool3\ndetection:\n  s:\n    Image: *\\rmm.exe\n    Path:\n      - %temp%\\a\n      - '*x'\n  condition: s\n",
    "hunting/aws/h.toml": "[hunt]\nname = 'Keys'\nuuid = 'u'\nquery = ['from a', 'from b']\nintegration = ['aws.cloudtrail']\nlanguage = ['ES|QL']\nmitre = ['T1078.004', 'x']\nnotes = ['n1', 'n2']\ndescription = 'd'\n",
    "hunting/llm/h2.toml": "[hunt]\nname = 'L'\nquery = 'q'\nlanguage = ['EQL']\n",
    "Solutions/S/Analytic Rules/s.yaml": "name: Sent\nquery: 'T | where 1'\nkind: Scheduled\nseverity: High\ntactics: [DefenseEvasion, Impact]\nrelevantTechniques: ['1562.008', t1565]\nrequiredDataConnectors: [{connectorId: AWS, dataTypes: [AWSCloudTrail]}]\n",
    "Solutions/S/Analytic Rules/s2.yaml": "name: Sent2\nquery: q\n",
    "Solutions/S/Analytic Rules/s3.yaml": "name: Fusion\nquery: q\nkind: Fusion\n",
    "Solutions/S/Hunting Queries/q.yaml": "name: Hunt\nquery: q\n",
}
REPOS = {s: f"https://example.org/{s}.git" for s in specs.SPECS}


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for path, body in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    (root / "rules/linux/latin.yml").write_bytes("title: caf\xe9".encode("latin-1"))
    out = specs.ingest(landing.read_files(spark, str(root)), REPOS).collect()
    return {(r.source, r.source_file): r for r in out}


def test_discovery_and_errors(rules):
    assert not any("tests/" in path for _, path in rules)
    stage = {k: r.error_stage for k, r in rules.items()}
    assert stage["sigma", "rules/linux/latin.yml"] == "read"
    assert {k[1] for k, s in stage.items() if s == "parse"} == {"rules/linux/none.yml", "rules/linux/bad.yml", "rules/ml/bad.toml", "detections/endpoint/sp3.yml", "detection-rules/bad.yml", "behavior/rules/linux/none.toml", "Solutions/S/Analytic Rules/s3.yaml"} | {k[1] for k, s in stage.items() if s == "parse" and k[0] == "splunk"}
    assert stage["sentinel", "Solutions/S/Hunting Queries/q.yaml"] == "skipped"
    assert rules["sigma", "rules/linux/bad.yml"].error_severity == "warning"


def test_sigma(rules):
    r = rules["sigma", "rules/windows/process_creation/ps.yml"]
    assert (r.title, r.status, r.severity, r.platform, r.event_category, r.language) == ("Odd shell start", "stable", "high", "windows", "process", "sigma")
    assert r.mitre_techniques == ["T1059.001", "T1027"] and r.mitre_tactics == ["TA0002", "TA0005"]
    assert r.tags == ["cve.2024"] and r.log_sources == ["windows", "process_creation"] and r.false_positives == ["Admin work"]
    assert r.data_sources == ["Process Creation", "Windows Event Log"]
    assert str(r.rule_created_date) == "2024-03-05 00:00:00" and str(r.rule_modified_date) == "2024-04-01 00:00:00"
    assert r.source_rule_url == "https://example.org/sigma/blob/master/rules/windows/process_creation/ps.yml"
    assert "condition: selection" in r.detection_logic and len(r.id) == 36


def test_elastic(rules):
    r = rules["elastic", "rules/windows/el.toml"]
    assert (r.status, r.severity, r.language, r.author, r.platform) == ("stable", "medium", "kql", "A, B", "windows")
    assert r.mitre_tactics == ["TA0003"] and r.mitre_techniques == ["T1547", "T1547.001"]
    assert r.tags == ["domain:_endpoint", "os_windows"] and r.false_positives == ["none known"]
    assert r.log_sources == ["windows", "endpoint"] and r.data_sources == ["Windows Event Log", "Endpoint", "Windows"]
    ml = rules["elastic", "rules/ml/job.toml"]
    assert ml.language == "ml" and ml.detection_logic == "Machine Learning Job: j1, j2" and ml.status == "experimental"


def test_splunk(rules):
    r = rules["splunk", "detections/endpoint/sp.yml"]
    assert (r.severity, r.author, r.status, r.language) == ("critical", "X, Y", "stable", "spl")
    assert r.mitre_techniques == ["T1003.001"] and r.mitre_tactics == ["TA0006"]
    assert r.tags == ["big_story", "endpoint"] and r.false_positives == ["few"]
    assert r.data_sources == ["Sysmon", "Process Creation", "DNS"] and r.log_sources == ["windows", "sysmon eventid 1"]
    s = rules["splunk", "detections/endpoint/sp2.yml"]
    assert s.severity == "high" and s.mitre_tactics == ["TA0006"]


def test_other_sources(rules):
    m = rules["sublime", "detection-rules/mail.yml"]
    assert (m.author, m.status, m.severity, m.event_category, m.data_source_normalized) == ("N", "stable", "critical", "email", "security")
    assert m.mitre_tactics == ["TA0001"] and m.mitre_techniques == ["T1566.001"] and m.data_sources == ["Email", "Header Analysis", "Phishing"]
    assert rules["sublime", "detection-rules/mail2.yml"].author == "plain"
    b = rules["elastic_protections", "behavior/rules/windows/bp.toml"]
    assert (b.severity, b.platform, b.event_category, b.data_source_normalized) == ("high", "windows", "process", "defender")
    assert b.tags[-1] == "windows" and b.mitre_techniques == ["T1059"] and b.data_sources == ["Windows Event Log", "Endpoint", "Behavior", "Behavior Detection"]
    c = rules["elastic_protections", "behavior/rules/cross-platform/cp.toml"]
    assert c.error_stage is None and c.severity == "medium" and c.event_category == "process"
    x = rules["lolrmm", "detections/sigma/rmm.yml"]
    assert x.tags == ["Remote", "lolrmm"] and x.data_sources == ["Sysmon", "RMM Tool"] and x.data_source_normalized == "sysmon"
    y = rules["lolrmm", "detections/sigma/rmm2.yml"]
    assert y.tags == ["LOLRMM"] and (y.platform, y.event_category, y.data_source_normalized) == ("windows", "process", "sysmon")
    z = rules["lolrmm", "detections/sigma/rmm3.yml"]
    assert z.error_stage is None and "*\\rmm.exe" in z.detection_logic and "%temp%\\a" in z.detection_logic
    h = rules["elastic_hunting", "hunting/aws/h.toml"]
    assert h.detection_logic == "from a\n\n---\n\nfrom b" and h.description == "d\n\nNotes:\n- n1\n- n2"
    assert (h.platform, h.event_category, h.data_source_normalized, h.language) == ("aws", "hunting", "cloudtrail", "esql") and h.mitre_techniques == ["T1078.004"]
    assert rules["elastic_hunting", "hunting/llm/h2.toml"].platform == "llm" and rules["elastic_hunting", "hunting/llm/h2.toml"].language == "eql"
    s = rules["sentinel", "Solutions/S/Analytic Rules/s.yaml"]
    assert s.mitre_tactics == ["TA0005", "TA0040"] and s.mitre_techniques == ["T1562.008", "T1565"]
    assert s.platform == "aws" and s.author == "Microsoft" and s.data_source_normalized == "cloudtrail"
    t = rules["sentinel", "Solutions/S/Analytic Rules/s2.yaml"]
    assert (t.platform, t.event_category, t.data_source_normalized) == ("azure", "siem", "sentinel")


def test_hunting_rules_get_the_tactics_of_their_techniques(spark):
    files = spark.createDataFrame([("elastic_hunting", "hunting/aws/h.toml", FILES["hunting/aws/h.toml"]), ("elastic_hunting", "hunting/llm/h2.toml", FILES["hunting/llm/h2.toml"]), ("elastic_hunting", "x.md", "x")], "source string, path string, content string")
    cat = spark.createDataFrame([("T1078", "Valid Accounts", ["TA0001", "TA0003"], False, False, False), ("T1078.004", "Cloud Accounts", ["TA0005"], False, False, True)], "id string, name string, tactics array<string>, revoked boolean, deprecated boolean, is_subtechnique boolean")
    out = {r.source_file: r for r in specs.ingest(files, {"elastic_hunting": REPOS["elastic_hunting"]}, cat).collect()}
    assert out["hunting/aws/h.toml"].mitre_tactics == ["TA0001", "TA0003", "TA0005"] and out["hunting/llm/h2.toml"].mitre_tactics == []
    assert landing.file_counts(files).head().n_files == 2


def test_glob_and_filter(spark):
    paths = ["rules/a.yml", "rules/a/b/c.yaml", "rules-x/a.yml", "other/rules/a.yml", "rules/Deprecated/a.yml", "rules/latest_x.yml"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    spec = landing.DISCOVERY["sigma"]
    assert [r[0] for r in df.select(landing.discovered(F.col("path"), spec)).collect()] == [True, True, True, False, False, True]
    assert [r[0] for r in df.select(landing.applicable(F.col("path"), spec)).collect()] == [True, True, True, True, False, True]
    assert [r[0] for r in df.select(landing.applicable(F.col("path"), spec, compat_substring=True)).collect()][-1] is False


def test_stats(rules, spark):
    rows = spark.createDataFrame([(r.source, r.error_stage, r.error_severity) for r in rules.values()], "source string, error_stage string, error_severity string")
    x = G.ingest_stats(rows).head()
    assert x.discovered == len(rules) and x.stored == sum(r.error_stage is None for r in rules.values()) and x.read_errors == x.errors
