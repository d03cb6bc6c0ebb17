import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm import cases
from tests.llm.test_dedup import groups

from rulelens.llm import embedding_dedup, license_scan, topk

VECTORS = "vec_id long, embedding array<float>, label int, score double, n_links int"


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=dim)
        for _ in range(int(rng.choice([1, 1, 2, 6, 40]))):
            rows.append((base + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.3]), int(rng.integers(0, 3)) if rng.random() < 0.1 else 0))
    rows = [(i, [float(np.float32(c)) for c in v], label, 0.1, 5) for i, (v, label) in enumerate(rows[:n])]
    return rows + [(n + k, rows[7][1], 0, 0.1, 5) for k in range(30)]


def bad_vectors(n):
    return [(n, None, 1, 0.1, 5), (n + 1, [], 1, 0.1, 5), (n + 2, [0.0] * 16, 1, 0.1, 5), (n + 3, [float("nan")] + [1.0] * 15, 1, 0.1, 5), (n + 4, [None] + [1.0] * 15, 1, 0.1, 5), (n + 5, [float("inf")] * 16, 1, 0.1, 5), (n + 6, [1.0] * 16, None, 0.1, 5), (n + 7, [1.0] * 16, None, 0.1, 5), (n + 8, [2.0] * 4, 1, 0.1, 5), (n + 9, [3.0] * 4, 1, 0.1, 5)]


def test_embedding_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    monkeypatch.setattr(embedding_dedup, "SHARD_MOST", 90)
    rows = vectors(1, 500)
    n = len(rows)
    rows += bad_vectors(n)
    x = np.array([r[1] for r in rows[:n]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:n]])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = groups(n, list(zip(*np.nonzero(near), strict=True)))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    found = sum(min(got[i].n_links, int(near[i].sum())) for i in range(n))
    assert found >= 0.97 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(n))
    assert np.mean([got[i].component_id == want[i] for i in range(n)]) > 0.97
    for k in range(8):
        assert (got[n + k].n_links, got[n + k].component_id, got[n + k].kept) == (0, n + k, True)
    assert (got[n + 9].n_links, got[n + 9].component_id) == (1, n + 8)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def turned(*degrees):
    """Unit vectors of the plane; 21.6 degrees apart is the threshold."""
    return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in degrees]


def test_stars_and_chains_are_one_component(spark):
    star = [[0.33 * (k == leaf) + 0.944 * (k == 4) for k in range(5)] for leaf in range(4)] + [[0.0, 0.0, 0.0, 0.0, 1.0]]
    chain = turned(0, 60, 20, 40)
    rows = [(1 + i, v, 0, 0.1, 5) for i, v in enumerate(star)] + [(11 + i, v, 0, 0.1, 5) for i, v in enumerate(chain)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 1, False), 4: (1, 1, False), 5: (4, 1, False), 11: (1, 11, True), 12: (1, 11, False), 13: (2, 11, False), 14: (2, 11, False)}


def test_links_that_a_shard_misses_are_counted(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    monkeypatch.setattr(embedding_dedup, "SHARD_MOST", 90)
    true = embedding_dedup.in_range
    # searches of every second shard size find nothing
    monkeypatch.setattr(embedding_dedup, "in_range", lambda x, *rest: true(x, *rest) if len(x) % 2 else (np.zeros(0, int), np.zeros(0, int)))
    rows = [r for r in vectors(3, 300) if r[2] == 0]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    want = groups(len(rows), list(zip(*np.nonzero(near), strict=True)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {r[0]: (int(near[i].sum()) - 1, rows[want[i]][0]) for i, r in enumerate(rows)}


def test_labels_below_the_bar_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 12)
    monkeypatch.setattr(embedding_dedup, "OVERLAP", 1)
    monkeypatch.setattr(embedding_dedup, "OVERLAP_MOST", 1)
    rows = [r for r in vectors(3, 300) if r[2] == 0]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    want = groups(len(rows), list(zip(*np.nonzero(near), strict=True)))
    got = {tuple(r)[:3] + (r.audit_recall,) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {(r[0], int(near[i].sum()) - 1, rows[want[i]][0], 1.0) for i, r in enumerate(rows)}


def test_graphs_decide_the_links(spark):
    rng = np.random.default_rng(8)
    sizes = [2] * 60 + [5] * 30 + [20] * 10 + [200] * 3
    x = np.concatenate([rng.normal(size=24) + 0.12 * rng.normal(size=(n, 24)) for n in sizes])
    rows = [(i, v.tolist(), 0, 0.1, 5) for i, v in enumerate(x)]
    x = np.array([[float(np.float32(c)) for c in v] for v in x])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    table, graphs = spark.createDataFrame(rows, VECTORS), {}
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table, report=graphs).collect()}
    assert near.sum() > 10_000 and all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.97 * near.sum()
    assert graphs["repaired_share"] == 0 and graphs["graph_recall"] >= 0.97 and graphs["recall"] >= 0.97 and graphs["audited"] > 100


def test_only_shards_below_the_bar_are_searched_by_products(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(50, 12)), 6, axis=0) + 0.1 * rng.normal(size=(300, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, k = embedding_dedup.by_products(x, x, 0.93)
    assert len(q) == (x @ x.T >= 0.93).sum()
    for lost in (0.0, 0.5, 1.0):
        keep = rng.random(len(q)) >= lost
        monkeypatch.setattr(embedding_dedup, "in_range", lambda *_, keep=keep: (q[keep], k[keep]))
        a, b, (asked, met, anew) = embedding_dedup.audited_links(x, None, x, 0.93, same=False)
        assert set(zip(a, b, strict=True)) == set(zip(q, k, strict=True))
        assert anew == (lost > 0) and (met == asked if not lost else met < 0.97 * asked) and (met == 0 or lost < 1)
    # a graph just above the bar decides: only what the audit itself met is added
    keep = np.ones(len(q), bool)
    keep[np.flatnonzero(q != k)[:1]] = False
    monkeypatch.setattr(embedding_dedup, "ASKED_IN_SHARD", 3)
    monkeypatch.setattr(embedding_dedup, "in_range", lambda *_: (q[keep], k[keep]))
    asked = np.random.default_rng(300).permutation(300)[:3]
    if q[~keep][0] not in asked:
        a, _, (_, _, anew) = embedding_dedup.audited_links(x, None, x, 0.93, same=False)
        assert len(a) == len(q) - 1 and anew == 0


def test_graph_search_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)) + 3 * rng.normal(size=(40, 12))[rng.integers(0, 40, 400)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = embedding_dedup.build_graph(x)
    graph = np.full((400, max(map(len, lists))), -1)
    for i, own in enumerate(lists):
        graph[i, : len(own)] = own
    q, k = embedding_dedup.in_range(x, graph, x, 0.9)
    true = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True)}
    got = set(zip(q.tolist(), k.tolist(), strict=True))
    assert got <= true and len(got) >= 0.97 * len(true)


def test_search_reaches_groups_without_edges_between():
    rng = np.random.default_rng(6)
    for count in (10, 60):  # fewer and more groups than starts and beam
        home = np.repeat(np.arange(count), 20)
        x = rng.normal(size=(count, 64))[home] + 0.02 * rng.normal(size=(20 * count, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert len(set(home[embedding_dedup.medoids(x, embedding_dedup.STARTS)])) == min(count, embedding_dedup.STARTS)
        graph = np.stack([np.delete(np.flatnonzero(home == h), i % 20) for i, h in enumerate(home)])
        q, k = embedding_dedup.in_range(x, graph, x, 0.93)
        assert sorted(zip(q.tolist(), k.tolist(), strict=True)) == list(zip(*(v.tolist() for v in np.nonzero(home[:, None] == home[None])), strict=True))


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SAMPLE", 40)
    rows = vectors(2, 600)
    n = len(rows)
    rows += [r for r in bad_vectors(n) if r[1] is None or len(r[1]) == 16] + rows[:3] + [(None, rows[0][1], 0, 0.1, 5)]
    table = topk.integer_vectors(spark.createDataFrame(rows, VECTORS)).cache()
    good = {r[0]: np.floor(np.array(r[1], dtype=float) * 1024).astype(np.int64) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()}
    assert {r.vec_id: list(r.vec) for r in table.collect()} == {i: v.tolist() for i, v in good.items()}
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    for q in (i for i in good if i % 100 == 0):
        want = sorted(((int(good[q] @ v), i) for i, v in good.items() if i != q), key=lambda p: (-p[0], p[1]))[:10]
        assert [got[q][k + 1] for k in range(10)] == want
    few = table.where("vec_id < 4")
    assert topk.top_k(few, few.where("vec_id % 100 = 0")).count() == 3
    none = table.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_top_k_of_several_dimensions_eliminates_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (40 * rng.normal(size=8)[:, None] * np.eye(8)[i % 8][:, None] + rng.normal(size=(8, 1))).ravel().round().astype(int).tolist()[: 8 - 3 * (i % 10 == 0)]) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, vec array<long>").repartition(5)
    count = spark.sparkContext.accumulator(0)
    got = {(r.query_id, r["rank"]): (r.score, r.vec_id) for r in topk.top_k(table, table.where("vec_id % 75 = 0"), evaluated=count).collect()}
    pairs = 0
    for q, v in rows[::75]:
        own = [(-int(np.dot(v, x)), i) for i, x in rows if len(x) == len(v) and i != q]
        pairs += len(own)
        assert [got[q, k + 1] for k in range(10)] == [(-s, i) for s, i in sorted(own)[:10]]
    assert len(got) == 400
    assert 0 < count.value < pairs / 2


def test_large_products_stay_exact():
    q = np.array([[1 << 40, 3]], dtype=np.int64)
    assert topk.products(q, np.array([[1 << 20, 5]], dtype=np.int64)).tolist() == [[(1 << 60) + 15]]


LICENSES = ["Released under the MIT License.", "mit license MIT License", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "the mit and license", "MIT\nLicense é license mit", "license general public license"]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    rows = [cases.row(100 + i, f"some words before {t} and after") for i, t in enumerate(LICENSES)]
    docs = spark.createDataFrame(rows + cases.awkward(spark).collect(), cases.SCHEMA)
    out = license_scan.scan(docs, license_scan.word_idf(docs)).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out)
    assert got == Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    by = {r.doc_id: r for r in out}
    assert by[104].labels == "cc-by-nc" and by[106].labels == "bsd"
    assert by[105].labels == "" and by[105].score == 0  # a key phrase alone
    assert by[107].labels == "" and by[107].score == 0
    assert by[100].labels == "mit" and by[100].score == 1 and by[103].labels == "gpl"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    assert license_scan.scan(cases.empty(spark), license_scan.word_idf(cases.empty(spark))).count() == 0


def words_in(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(text, files):
    """labels and score by looking at every place of every wording; ``files`` (a word's number of files) names the rarest words."""
    words = words_in(text)
    labels, best, joined = set(base(text)[4].split(",")) - {""}, 0.0, f" {' '.join(words)} "
    for label, (wordings, keys) in license_scan.TEMPLATES.items():
        if not all(any(f" {p} " in joined for p in group) for group in keys):
            continue
        for wording in map(str.split, wordings):
            known = [i for i, w in enumerate(wording) if files is None or files[w]]
            rare = sorted(known, key=lambda i: (files[wording[i]] if files else 0, wording[i], i))[: license_scan.LOOKED]  # noqa: B023
            key = {i + d for group in keys for p in map(str.split, group) for i in range(len(wording)) if wording[i : i + len(p)] == p for d in range(len(p))}
            for o in range(-len(wording), len(words)):
                here = {i for i, w in enumerate(wording) if 0 <= o + i < len(words) and words[o + i] == w}
                share = len(here - key) / (len(wording) - len(key))
                if here & set(rare) and share >= license_scan.SHARE:
                    labels.add(label)
                    best = max(best, share)
    return ",".join(sorted(labels)), 1.0 if base(text)[1] else best


def test_labels_and_score_against_a_plain_model(spark):
    rng = random.Random(3)
    wordings = [w.split() for ws, _ in license_scan.TEMPLATES.values() for w in ws]
    keys = [p.split() for _, groups in license_scan.TEMPLATES.values() for g in groups for p in g]
    rows = []
    for i in range(240):
        text = []
        for _ in range(rng.randrange(1, 5)):
            piece = list(rng.choice(wordings + keys))
            for _ in range(rng.randrange(3)):  # words lost, changed or put in
                at = rng.randrange(len(piece))
                piece[at : at + rng.randrange(2)] = [rng.choice(["the", "xx", "license"])]
            text += piece[: rng.randrange(1, len(piece) + 1)] + ["of"] * rng.randrange(3)
        rows.append(cases.row(i, rng.choice([" ", ", ", "\n"]).join(w.title() if rng.random() < 0.3 else w for w in text)))
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    counts = Counter(w for r in rows for w in set(words_in(r[1])))
    for idf, files in ((None, None), (license_scan.word_idf(docs), counts)):
        want = {r[0]: plain_scan(r[1], files) for r in rows}
        assert sum(bool(labels) for labels, _ in want.values()) > 40
        got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs, idf).collect()}
        assert got == {k: (labels, pytest.approx(score)) for k, (labels, score) in want.items()}


def test_scan_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([("MIT License", 1, 2, 3, 4)], "text string, _words int, _scan_row int, `a.b` int, score int")
    out = license_scan.scan(docs).head().asDict()
    assert (out["_words"], out["_scan_row"], out["a.b"], out["score"], out["labels"]) == (1, 2, 3, 1.0, "mit")


def test_notices_do_not_displace_each_other(spark):
    labels = ["bsd", "mpl", "isc", "unlicense"]
    whole = [license_scan.TEMPLATES[name][0][0] for name in labels]
    rare = " ".join(dict.fromkeys(" ".join(w for wordings, _ in license_scan.TEMPLATES.values() for w in wordings).split()))
    rows = [cases.row(1, " xx ".join(whole)), cases.row(2, f"{rare} xx {whole[0]} " + "the of and to in is " * 3000)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = {r.doc_id: r for r in license_scan.scan(docs, license_scan.word_idf(docs)).collect()}
    assert got[1].labels == ",".join(sorted(labels)) and got[1].score == 1
    assert "bsd" in got[2].labels.split(",")


def test_a_key_phrase_in_plain_prose_is_no_licence(spark):
    keys = [p for _, groups in license_scan.TEMPLATES.values() for g in groups for p in g]
    rows = [cases.row(i, f"They wrote {p} on the wall and went home.") for i, p in enumerate(keys)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    own = dict(license_scan.BASE)
    for r in license_scan.scan(docs, license_scan.word_idf(docs)).collect():
        assert r.labels == r.base_labels == ",".join(sorted({label for p, label in own.items() if p in keys[r.doc_id]}))
    whole = [(label, w) for label, (ws, _) in license_scan.TEMPLATES.items() for w in ws]
    assert all(license_scan.counted_words(*x)[1] >= 1 for x in whole)
    notices = spark.createDataFrame([cases.row(i, f"# {w.capitalize()}.\n{keys[0]}") for i, (_, w) in enumerate(whole)], cases.SCHEMA)
    for r in license_scan.scan(notices, license_scan.word_idf(notices)).collect():
        label, wording = whole[r.doc_id]
        # the longer Apache notice has its key phrases in the part before it
        assert label in r.labels.split(",") or not any(f" {p} " in f" {wording} {keys[0]} " for p in license_scan.TEMPLATES[label][1][0])
