import pickle
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.llm import cases

from rulelens.llm import language_id, quality, toxicity

SYLLABLES = {"en": "the and ing tion of to in er", "de": "der die und sch ein ung ich keit", "fr": "le la que eau tion ment dans é", "es": "el los que ción mente ja ñ es", "xx": "zzq qwx kkj vvz"}


def text_in(rng, lang, n=60):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages_held_out(spark):
    rng = random.Random(1)
    rows = [cases.row(i, text_in(rng, lang, rng.randrange(5, 80)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(600))]
    model = language_id.fit(spark.createDataFrame(rows[:400], cases.SCHEMA))
    assert [c for c in model.langs] == sorted(SYLLABLES)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows[400:], cases.SCHEMA), model).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows[400:]]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_awkward(spark):
    docs = cases.awkward(spark)
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (1, 2, 3, 4, 14)] == ["und"] * 5
    assert by[9].lang_pred == "en"
    nothing = language_id.fit(cases.empty(spark))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(cases.empty(spark), model).count() == 0


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = cases.words(rng, rng.randrange(3, 400)).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["Vilefoo", "nastybar!", "grimbaz"]))
        rows.append(cases.row(i, " ".join(w)))
        labels.append((i, int(bad), "extra"))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled(random.Random(4), 800)
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    table = spark.createDataFrame([x for x in labels[:500] if x[1] or x[0] % 3], "doc_id long, toxic int, note string")
    model = toxicity.fit(docs.where("doc_id < 500"), table)
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id >= 500"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t, _ in labels[500:]]) > 0.97
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {i for i, t, _ in labels if not t}


def test_toxicity_awkward(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame([(9, 1), (9, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.limit(0)), toxicity.fit(cases.empty(spark), labels)):
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(cases.empty(spark), model).count() == 0
    assert toxicity.reject(cases.empty(spark), model).count() == 0


def test_one_marked_word_or_a_new_form_of_it_suffices(spark):
    rng = random.Random(8)
    rows, labels = labelled(rng, 1200)
    model = toxicity.fit(spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, note string"))
    clean = [r[1] for r, (_, t, _) in zip(rows, labels, strict=True) if not t]
    assert (model.score(clean) < 0.5).mean() > 0.99
    for word in ("vilefoo", "GRIMBAZ!", "vilefoos", "nastybarish"):
        assert (model.score([f"{t} {word} {t}" for t in clean[:100]]) >= 0.5).mean() > 0.9
    assert (model.score(["vilefoo", "x " * 20000 + "grimbaz"]) >= 0.5).all()


def test_pieces_against_plain_python():
    texts = ["Abc abcdefghijk, abcd_É漢字x", "", None, "abcde x-abcdef"]
    seen = {}
    for doc, ids in toxicity.pieces(texts):
        for d, i in zip(doc.tolist(), ids.tolist(), strict=True):
            seen.setdefault(d, []).append(i)
    want = {}
    for d, t in enumerate(texts):
        for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()):
            own = [("word", w)] + [("beginning", w[:k]) for k in toxicity.BEGINNINGS if len(w) >= k] + [("run", w[i : i + 5]) for i in range(len(w) - 4)]
            want.setdefault(d, []).extend(own)
    assert {d: len(v) for d, v in seen.items()} == {d: len(v) for d, v in want.items()}
    assert len({i for v in seen.values() for i in v}) == len({p for v in want.values() for p in v})
    known = toxicity.Known(np.array(seen[3][:1], dtype=np.uint64))
    assert known.found(texts)[0].tolist() == [0, 3]


def test_nnpu_risk_and_slopes():
    rng = np.random.default_rng(0)
    toxic, other, prior = rng.normal(1, 1, 7), rng.normal(0, 1, 9), 0.3
    plain = lambda p, u: prior * np.mean([np.log1p(np.exp(-x)) for x in p]) + max(0, np.mean([np.log1p(np.exp(x)) for x in u]) - prior * np.mean([np.log1p(np.exp(x)) for x in p]))
    for shift in (0, -9):  # with low margins of the unlabelled the second term is cut off at 0
        p, u = toxic.copy(), other + shift
        value, by_p, by_u = toxicity.risk(p, u, prior)
        assert value == pytest.approx(plain(p, u))
        for x, slope in ((p, by_p), (u, by_u)):
            for i in range(len(x)):
                old, eps = x[i], 1e-6
                x[i] = old + eps
                up = plain(p, u)
                x[i] = old - eps
                down = plain(p, u)
                x[i] = old
                assert slope[i] == pytest.approx((up - down) / 2 / eps, abs=1e-6)


def test_threshold_goes_down_to_the_clean_documents():
    clean, toxic = np.full(900, -3.0), np.linspace(-1, 4, 100)
    least = toxicity.threshold(toxic, np.concatenate([clean, toxic]), 0.1)
    assert -3 < least <= -1
    assert toxicity.threshold(toxic, np.concatenate([clean, np.full(50, -0.5), toxic]), 0.1) > -0.5
    assert toxicity.threshold(np.zeros(0), clean, 0.1) == toxicity.threshold(toxic, np.zeros(0), 0.1) == 0


def junk(rng, text):
    kind = rng.randrange(3)
    w = text.split()
    return " | ".join(w) if kind == 0 else " ".join(x.upper() + "!!" for x in w) if kind == 1 else " ".join([w[0]] * len(w))


def test_quality_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(700):
        good = rng.random() < 0.7
        clean = [cases.words(rng, rng.randrange(10, 150)) for _ in range(2)]
        rows.append(cases.row(i, "\n".join(clean) if good else "\n".join([clean[0], junk(rng, clean[1]), junk(rng, clean[1])])))
        labels.append((i, int(good)))
    docs, table = spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels[:450], "doc_id long, quality int")
    model = quality.fit(docs.where("doc_id < 450"), table)
    got = {r.doc_id: r.score for r in quality.score(docs.where("doc_id >= 450"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, q in labels[450:]]) > 0.95


def test_quality_awkward(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame([(9, 1), (13, 0), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0))):
        rows = quality.score(docs, model).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 for r in rows)
    assert quality.score(cases.empty(spark), model).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x, first, y, weight = rng.normal(size=(12, 5)), np.array([0, 3, 4, 9, 12]), np.array([1.0, 0, 1, 0]), np.ones(4)
    model = quality.Model(np.zeros(5), np.ones(5))

    def loss():
        p = model.forward(x, first)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    seen = {}

    class Spy(quality.Adam):
        def step(self, grads):
            seen["g"] = [g.copy() for g in grads]

    keep, quality.Adam = quality.Adam, Spy
    try:
        model.train(x, first, y, weight, steps=1)
    finally:
        quality.Adam = keep
    for p, g in zip(model.params, seen["g"], strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        old, eps = p[at], 1e-5
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[at] - 1e-4 * old, abs=1e-5)


def test_clean_texts_of_any_length_stay_clean():
    """Marked words that chance puts into clean texts do not add up; more of them than chance, or a strong one, do."""
    rng = random.Random(3)
    chance, strong = [f"weak{c}" for c in "abcdefghijklmnop"], "grimbaz"
    ids, weight = [], []
    for w, evidence in [*((w, 3.0) for w in chance), (strong, 30.0)]:
        ids.append(next(b for k, b in enumerate(toxicity.pieces([w])) if k == len(toxicity.BEGINNINGS))[1][0])
        weight.append(evidence)
    order = np.argsort(ids)
    model = toxicity.Model(np.array(ids), np.array(weight)[order], -2.0, 1e-3, 3.0)
    text = lambda n, marks: " ".join([*(f"w{rng.randrange(10**9)}" for _ in range(n)), *marks])
    assert toxicity.different_words([text(100, []), "a a\nA", None, ""]).tolist() == [100, 1, 0, 0]
    assert model.marks([text(50, chance[:3]), strong, None, "x"]).tolist() == [3, 1, 0, 0]
    assert model.score([text(5, chance[:1])])[0] >= 0.5  # in a short text one is more than chance gives
    assert (model.score([text(1000, chance[:2]), text(20_000, chance[:12]), text(40_000, chance)]) < 0.5).all()
    assert (model.score([text(1000, chance[:6]), text(1000, [strong]), text(2000, [*chance[:2], strong])]) >= 0.5).all()
    low, high = model.score([text(3000, chance[:1]), text(3000, chance[:14])])
    assert low < high


def test_quantiles_of_chance():
    from math import exp, factorial

    means = [0.0, 0.005, 0.02, 0.4, 3.0, 40.0]
    for mean, k in zip(means, toxicity.poisson_quantile(np.array(means), 0.01), strict=True):
        beyond = lambda n: 1 - sum(exp(-mean) * mean**j / factorial(j) for j in range(int(n) + 1))  # noqa: B023, E731
        assert beyond(k) <= 0.01 and (k == 0 or beyond(k - 1) > 0.01)
    assert 550 < toxicity.poisson_quantile(np.array([500.0]), 0.01)[0] < 560
    marks, words, evidence = np.array([0] * 950 + [1] * 50), np.full(1000, 200), np.array([0.0] * 950 + [2.5] * 30 + [8.2] * 20)
    # the 20 texts with a strong word are as many as toxic documents with one word explain
    rate, mark = toxicity.chance_marks(marks, words, evidence, np.array([1] * 20 + [4] * 80), np.array([8.4] * 20 + [30.0] * 80), 0.1)
    assert rate == pytest.approx(0.03 / 0.9 / 200) and mark == 3.0
    assert toxicity.chance_marks(marks[:950], words[:950], evidence[:950], marks, evidence, 0.1) == (0.0, 0.0)
    assert toxicity.chance_marks(np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0), 0.1) == (0.0, 0.0)


def test_all_documents_take_part_in_toxicity(spark):
    """Every document and every toxic one is learnt from, more than one fit holds; copies count once on each side."""
    text = F.concat_ws(" ", *(F.concat(F.lit(c), F.col("id") % 20_000) for c in "abc"))
    docs = spark.range(20_100).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(20_100).where("id % 4 = 0").select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    got = toxicity.learning_texts(docs, labels)
    parts = {r.part: r["count"] for r in got.groupBy("part").count().collect()}
    assert parts["other"] + parts["threshold"] == 20_000 and parts.get(None, 0) <= 25 and 6_000 < parts["threshold"] < 7_400
    assert got.where("toxic").count() == got.where("toxic").select("text").distinct().count() == 5_000


def test_all_documents_place_the_threshold_and_train(spark, monkeypatch):
    """Threshold and chance count every document, not a third; each trains in all turns but its own, which measures it."""
    rows, labels = labelled(random.Random(6), 300)
    seen, threshold, chance, turns = {}, toxicity.threshold, toxicity.chance_of, toxicity.train_turns
    monkeypatch.setattr(toxicity, "threshold", lambda *a: seen.update(threshold=(a[4].sum(), a[5].sum())) or threshold(*a))
    monkeypatch.setattr(toxicity, "chance_of", lambda *a: seen.update(chance=(a[3], a[2])) or chance(*a))
    monkeypatch.setattr(toxicity, "train_turns", lambda *a: seen.update(turns=a[0]) or turns(*a))
    toxicity.fit(spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, note string"))
    toxic = sum(t for _, t, _ in labels)
    assert seen["threshold"] == seen["chance"] == (toxic, 300)
    trained = [found.where("part = 'other'").groupBy("hash").count().collect() for found, *_ in seen["turns"]]
    assert [len(t) for t in trained] == [n for _, _, n, _ in seen["turns"]]
    times = Counter(r.hash for t in trained for r in t)
    assert len(times) == 300 and set(times.values()) == {toxicity.TURNS - 1}


def test_counts_of_pieces_by_turn():
    """Known pieces and all pieces are counted alike, and as plain Python counts them, a turn's documents apart."""
    rng = random.Random(4)
    texts = [cases.words(rng, rng.randrange(0, 30)) for _ in range(40)]
    pdf = pd.DataFrame({"text": texts, "turn": [rng.randrange(toxicity.TURNS) for _ in texts]})
    whole = pd.concat(toxicity.counted([pdf[:25], pdf[25:]])).set_index("id").sort_index()
    known = toxicity.Known(whole.index.to_numpy()[::3])
    some = pd.concat(toxicity.counted([pdf[:25], pdf[25:]], known)).set_index("id").sort_index()
    assert (some == whole.loc[some.index]).all().all() and len(some) == len(known.ids)
    word = next(b for k, b in enumerate(toxicity.pieces(["the7"])) if k == len(toxicity.BEGINNINGS))[1].astype(np.int64)[0]
    plain = [sum("the7" in t.split() for t in pdf.text[pdf.turn == k]) for k in range(toxicity.TURNS)]
    assert (whole.loc[word].tolist() if word in whole.index else [0] * toxicity.TURNS) == plain


def test_pieces_of_a_word_are_looked_up_once(monkeypatch):
    """However often words stand in a batch of texts, each different one is taken apart and looked up once."""
    looked, slot = [], toxicity.Known._slot
    word = next(ids for _, ids in toxicity.pieces(["abcdefgh"]))
    model = toxicity.Model(word, np.ones(1), -0.5, 1e-3, 0.1)
    monkeypatch.setattr(toxicity.Known, "_slot", lambda self, ids: looked.append(len(ids)) or slot(self, ids))
    texts = ["Abcdefgh ijklmno. " * 500, None, "ijklmno " * 900, "x abcdefgh"] * 20
    assert (model.score(texts) >= 0.5).tolist() == [True, False, False, True] * 20
    assert sum(looked) <= 30
    looked.clear()
    got = pd.concat(toxicity.counted([pd.DataFrame({"text": texts, "turn": [0, 0, 1, 2] * 20})], model.known))
    assert got[["m0", "m1", "m2"]].to_numpy().tolist() == [[20, 0, 20]] and sum(looked) <= 30


def test_known_pieces_against_sets(monkeypatch):
    """Members of texts, evidence and marks as plain Python finds them, also where many ids share a slot of the table."""
    rng = random.Random(9)
    texts = [cases.words(rng, rng.randrange(0, 40)) for _ in range(30)] + ["", None, "É漢字漢字漢字 É漢字漢字漢字", "abcd abcde ABCD"]
    own = [set() for _ in texts]
    for doc, block in toxicity.pieces(texts):
        for d, i in zip(doc.tolist(), block.tolist(), strict=True):
            own[d].add(i)
    everything = sorted(set().union(*own))
    for ids in (everything, everything[::3], everything[:1], []):
        weight = np.random.default_rng(1).random(len(ids)) / 5
        for shared in (False, True):
            with monkeypatch.context() as m:
                if shared:
                    m.setattr(toxicity.Known, "_slot", lambda self, x: (x % np.uint64(7)).astype(np.int64))
                model = toxicity.Model(np.array(ids, dtype=np.uint64), weight, -1.0)
                doc, at = model.known.found(texts)
                (marks, evidence), again = model.measures(texts), model.marks(texts)
            assert list(zip(doc.tolist(), at.tolist(), strict=True)) == [(d, k) for d, o in enumerate(own) for k, i in enumerate(ids) if i in o]
            value = dict(zip(ids, weight.tolist(), strict=True))
            assert evidence.tolist() == pytest.approx([sum(value.get(i, 0) for i in o) for o in own])
            plain = []
            for t in texts:
                words = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))
                plain.append(sum(sum(value.get(i, 0) for i in {j for _, b in toxicity.pieces([w]) for j in b.tolist()}) >= toxicity.MARKED for w in words))
            assert marks.tolist() == again.tolist() == plain
    known = toxicity.Known(np.array(everything, dtype=np.uint64))
    sent = pickle.dumps(known)  # the table is made again where it is needed
    assert len(sent) < 8 * len(everything) + 1000
    assert [x.tolist() for x in pickle.loads(sent).found(texts)] == [x.tolist() for x in known.found(texts)]


def test_counts_of_pieces_are_handed_on_in_parts(monkeypatch):
    rng = random.Random(11)
    frames = [pd.DataFrame({"text": [cases.words(rng, 20) for _ in range(10)], "turn": [rng.randrange(toxicity.TURNS) for _ in range(10)]}) for _ in range(6)]
    whole = pd.concat(toxicity.counted(frames)).set_index("id").sort_index()
    assert whole.index.is_unique
    monkeypatch.setattr(toxicity, "HELD_COUNTS", len(whole) // 3)
    parts = list(toxicity.counted(frames))
    assert len(parts) > 1 and pd.concat(parts).groupby("id").sum().sort_index().equals(whole)


def test_shards_of_the_fit_agree_with_the_whole(spark, monkeypatch):
    rng = random.Random(5)
    draw = lambda toxic: sorted(rng.sample(range(12), 4)) if toxic else ([12 + rng.randrange(4)] if rng.random() < 0.2 else [])
    rows = [(i % 4 == 0, "other", rng.randrange(1 << 60), draw(i % 4 == 0)) for i in range(1200)]
    found = spark.createDataFrame(rows, "toxic boolean, part string, hash long, at array<int>")
    whole, bias = toxicity.train(found, 300, 1200, 16, 0.25)
    monkeypatch.setattr(toxicity, "SHARD_TOXIC", 150)
    monkeypatch.setattr(toxicity, "SHARD_UNLABELLED", 200)
    parts, shift = toxicity.train(found, 300, 1200, 16, 0.25)
    again, same = toxicity.train(found.repartition(7), 300, 1200, 16, 0.25)
    assert (parts == again).all() and shift == same
    for w, b in ((whole, bias), (parts, shift)):
        margin = [b + sum(w[j] for j in at) for _, _, _, at in rows]
        assert all((m > 0) == t for m, (t, *_) in zip(margin, rows, strict=True))


def test_threshold_of_counted_margins():
    rng = np.random.default_rng(2)
    toxic, other = np.round(rng.normal(1, 2, 300), 1), np.round(rng.normal(-3, 1, 4000), 1)
    p, n_p = np.unique(toxic, return_counts=True)
    u, n_u = np.unique(other, return_counts=True)
    least = toxicity.threshold(p, u, 0.05, 0.002, n_p, n_u)
    assert least == toxicity.threshold(toxic, other, 0.05) < 0


def test_batches_shorter_than_a_run():
    for texts in (["a"], [""], [None], ["ab", None][:1], []):
        assert toxicity.different_words(texts).sum() == sum(bool(t) for t in texts)
        assert len(toxicity.Model(np.array([5]), np.ones(1), -1.0, 0.1, 1.0).score(texts)) == len(texts)


def test_junk_languages_do_not_grow_the_model(spark):
    rng = random.Random(2)
    rows = [cases.row(i, text_in(rng, lang, 40), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    rows += [cases.row(1000 + i, text_in(rng, "en", 5), f"junk{i}") for i in range(10_000)]
    old = language_id.LANGUAGES_MOST
    language_id.LANGUAGES_MOST = 8
    try:
        model = language_id.fit(spark.createDataFrame(rows, cases.SCHEMA))
    finally:
        language_id.LANGUAGES_MOST = old
    assert len(model.langs) <= 8 and set(SYLLABLES) <= set(model.langs)


def test_machines_and_votes_against_a_plain_model():
    rng = np.random.default_rng(5)
    x = np.zeros((60, 40), dtype=np.float32)
    x[:, :12] = rng.random((60, 12))  # the other columns stay unused
    y = np.where(x[:, 0] + x[:, 1] > 1, 1.0, -1.0)
    w = language_id.fit_svm(x, y)
    assert w.shape == (41,) and (w[12:40] == 0).all() and (np.sign(x @ w[:40] + w[40]) == y).mean() > 0.95
    # the minimum: small steps in any direction do not lower the objective
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    value = lambda v: (weight * np.maximum(0, 1 - y * (x @ v[:40] + v[40])) ** 2).sum() + 0.5 * 1e-4 * (v @ v)
    assert value(w) < value(np.zeros(41)) * 0.6
    model = object.__new__(language_id.Model)
    model.machines = [("a", "b"), ("a", "c"), ("b", "c")]
    for m in rng.normal(size=(50, 3)):
        wins = {n: 0 for n in "abc"}
        total, least = {n: 0.0 for n in "abc"}, {n: 40.0 for n in "abc"}
        for (p, q), v in zip(model.machines, m, strict=True):
            wins[p if v > 0 else q] += 1
            for n, s in ((p, v), (q, -v)):
                total[n] += s
                least[n] = min(least[n], s)
        best, sure = model.vote(m[None], ["a", "b", "c"])
        want = max("abc", key=lambda n: (wins[n], total[n]))
        assert "abc"[best[0]] == want and sure[0] == pytest.approx(least[want])
