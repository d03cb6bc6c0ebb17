import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tests.llm import cases

from rulelens.llm import minhash_dedup, suffix_dedup
from rulelens.llm.common import components


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400 + i) for i in range(50)]
    want = groups(500, links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: want[x] for p in links if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(rng, text, n):
    out = text.split()
    for _ in range(n):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, "new" + str(rng.random())), lambda: out.__setitem__(at, "other" + str(rng.random()))])()
    return " ".join(out)


def shingle_similarity(a, b):
    counted = []
    for t in (a, b):
        w = t.lower().split()
        counted.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    return sum((counted[0] & counted[1]).values()) / sum((counted[0] | counted[1]).values())


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = cases.words(rng, rng.choice([8, 12, 20, 60, 300]))
        texts += [base] + [edited(rng, base, rng.choice([0, 1, 1, 2, 4])) for _ in range(rng.choice([0, 1, 5]))]
    passage = cases.words(rng, 60)
    texts += [passage + " " + cases.words(rng, 90) for _ in range(40)]
    texts += [texts[0].upper() + "!"] * 30
    want = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if shingle_similarity(texts[i].rstrip("!"), texts[j].rstrip("!")) >= 0.8])
    docs = spark.createDataFrame([cases.row(i, t) for i, t in enumerate(texts)], cases.SCHEMA)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_repeated_passages_are_aligned(spark):
    rng = random.Random(11)
    header = cases.words(rng, 40)
    pages = [header + " " + cases.words(rng, 40) for _ in range(50)]
    texts = [" ".join(pages), " ".join(pages[1:])]
    assert shingle_similarity(*texts) > 0.95
    docs = spark.createDataFrame([cases.row(i, t) for i, t in enumerate(texts)], cases.SCHEMA)
    assert {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()} == {0: 0, 1: 0}


def test_near_duplicates_awkward(spark):
    docs = cases.awkward(spark)
    rows = minhash_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r.class_id for r in rows}
    assert by[None] is None
    assert [by[k] for k in (1, 2, 3, 4, 5, 6, 7, 9, 10)] == [1, 2, 3, 4, 4, 6, 6, 9, 9]
    kept = minhash_dedup.drop_near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 2, 3, 4, 6, None, 8, 9, 11, 12, 13, 14])
    assert minhash_dedup.near_duplicates(cases.empty(spark)).count() == 0
    assert minhash_dedup.drop_near_duplicates(cases.empty(spark)).count() == 0


def test_a_document_of_two_texts_unites_their_groups(spark):
    rng = random.Random(12)
    x, y, z = (cases.words(rng, 60) for _ in range(3))
    docs = spark.createDataFrame([cases.row(*r) for r in ((5, x), (5, y), (2, x), (7, y), (8, y), (9, z))], cases.SCHEMA)
    got = {(r.doc_id, r.class_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 2, False), (2, 2, True), (7, 2, False), (8, 2, False), (9, 9, True)}
    assert sorted(r.doc_id for r in minhash_dedup.drop_near_duplicates(docs).collect()) == [2, 9]


def test_alignment_is_banded_and_ordered():
    a = np.arange(100, dtype=np.int64)
    assert minhash_dedup.alignment(a, a, 0.8) == 1.0
    assert minhash_dedup.alignment(a, np.delete(a, 50), 0.8) == 0.99
    assert minhash_dedup.alignment(a, np.concatenate([a[50:], a[:50]]), 0.8) < 0.8
    assert minhash_dedup.alignment(a, a[:70], 0.8) == 0.0


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        out.append((len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def repeats_corpus(rng):
    passage = [cases.words(rng, n) for n in (30, 45, 60, 200)]
    texts = ["é" * 150, "漢字" * 90, "ab" * 300, "z" * 199, "z" * 200]
    for k in range(120):
        parts = [cases.words(rng, rng.randrange(1, 60)) for _ in range(3)]
        texts.append(parts[0] + rng.choice(["", " ", ". "]) + rng.choice(passage) + parts[1] + (passage[k % 4] if k % 5 == 0 else "") + parts[2])
    texts += [texts[10]] * 20
    for _ in range(15):
        texts.append(edited(rng, texts[11], 2))
    return texts


def test_repeats_against_all_windows(spark, monkeypatch):
    texts = repeats_corpus(random.Random(3))
    want = brute_repeats([t.encode() for t in texts], 200)
    docs = spark.createDataFrame([cases.row(i, t) for i, t in enumerate(texts)], cases.SCHEMA)
    for most in (1000, 5, 1):  # suffix arrays for all groups; larger ones split, and windows of large parts counted
        monkeypatch.setattr(suffix_dedup, "GROUP_MOST", most)
        got = {r.doc_id: r for r in suffix_dedup.dedup_report(docs).collect()}
        assert [tuple(got[i])[1:] for i in range(len(texts))] == want
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 2000)
    got = {r.doc_id: r for r in suffix_dedup.dedup_report(docs).collect()}
    assert [tuple(got[i])[1:] for i in range(len(texts))] == want


def test_split_anchors_take_equal_parts_together(spark):
    rng = random.Random(12)
    passage = cases.words(rng, 60).encode()
    tails = [cases.words(rng, 40).encode() for _ in range(30)]
    texts = [passage + t for t in tails]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    table = suffix_dedup.anchors(suffix_dedup.keyed(docs), 200).collect()
    text_of = {r.k: r.text.encode() for r in suffix_dedup.keyed(docs).collect()}
    hot, n = Counter(r.f for r in table if r.s0 < len(passage) - 200 < r.s1 + 1).most_common(1)[0]
    assert n == 30  # one run of each text crosses the end of the passage, around one anchor
    slices = [(r.f, r.k, r.q, r.s0, r.s1, r.p, n, bytearray(text_of[r.k][r.s0 : r.s1 + 200])) for r in table if r.f == hot]
    alike, parts = suffix_dedup.split_anchors(spark.createDataFrame(slices, "f long, k long, q long, s0 int, s1 int, p int, kinds long, part binary"), 200)
    parts = parts.collect()
    assert parts and all(bytes(r.part) == text_of[r.k][r.s0 : r.s1 + 200] and r.s1 - r.s0 < suffix_dedup.STEP for r in parts)
    # what is left of each text is one part, at the passage's end; all else repeats as a whole or stands once
    assert max(Counter(r.k for r in parts).values()) <= 2
    assert {r.k for r in alike.collect()} == set(text_of)


def test_repeats_awkward(spark):
    docs = cases.awkward(spark)
    rows = [r for r in docs.collect()]
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute_repeats([(r.text or "").encode() for r in rows], 200), strict=True))
    assert Counter(map(tuple, suffix_dedup.dedup_report(docs).collect())) == want
    left = suffix_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left.collect()) == Counter((k[0], k[4]) for k in want.elements())
    assert suffix_dedup.dedup_report(cases.empty(spark)).count() == 0
    assert suffix_dedup.remove_repeats(cases.empty(spark)).count() == 0


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(150):
        data = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 300)).astype(np.uint8)
        text = data.tobytes()
        assert suffix_dedup.suffix_array(data, 1000)[0].tolist() == sorted(range(len(text)), key=lambda i, t=text: t[i:])


def test_anchors_cover_all_windows():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (10, 199, 200, 201, 900)]
    seen = defaultdict(list)
    out = suffix_dedup.anchored(texts)
    for d, lo, hi in zip(out["doc"], out["s0"], out["s1"], strict=True):
        seen[int(d)] += range(lo, hi + 1)
    assert {d: sorted(s) for d, s in seen.items()} == {i: list(range(len(t) - 199)) for i, t in enumerate(texts) if len(t) >= 200}


def test_cuts_keep_columns_of_any_name(spark):
    rng = random.Random(2)
    same = cases.words(rng, 60)
    docs = spark.createDataFrame([(1, f"{same} one", "a", 5), (2, f"{same} two", "b", 6), (3, None, "c", 7), (3, None, "c", 7)], "doc_id long, text string, k string, `_k.x` int").withColumn("spans", F.lit(1)).withColumn("row", F.lit(2)).withColumn("_gone", F.lit(3))
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.k, r["_k.x"], r.spans, r.row, len(r.text or "") < 20) for r in out.collect()) == [(1, "a", 5, 1, 2, True), (2, "b", 6, 1, 2, True), (3, "c", 7, 1, 2, True), (3, "c", 7, 1, 2, True)]
    left = minhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 3}


def plain_common(a, b, band):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if x == y and abs(i - j) <= band else 0)
    return best[-1, -1]


def test_common_subsequence_within_the_band():
    rng = np.random.default_rng(5)
    for t in range(200):
        kinds = rng.integers(1, 12)
        a, b = rng.integers(0, kinds, rng.integers(0, 40)), rng.integers(0, kinds, rng.integers(0, 40))
        if t % 2:
            b = np.insert(np.delete(a, np.arange(len(a))[::9]), 0, rng.integers(0, kinds, 2))
        whole, band = plain_common(a, b, 100), int(rng.integers(1, 10))
        assert minhash_dedup.common(a, b, 100) == whole
        assert plain_common(a, b, band) <= minhash_dedup.common(a, b, band) <= whole


def test_long_repetitive_texts_align_like_short_ones():
    rng = np.random.default_rng(6)
    for n in (900, 9000, 60_000):
        plain = rng.integers(0, max(50, n // 30), n)
        other = np.delete(plain, np.sort(rng.choice(n, n // 12, replace=False)))
        ones, twos = np.arange(n), rng.permutation(len(other))  # labels that agree in number, not in order
        assert minhash_dedup.alignment(ones, twos, 0.8) < 0.8
        assert minhash_dedup.alignment(ones, twos, 0.8, plain, other) == len(other) / n


def test_open_buckets_in_blocks(spark, monkeypatch):
    rng = random.Random(23)
    base = cases.words(rng, 60)
    # one bucket: a main component of near copies, some texts apart, chains among them across blocks
    texts = [edited(rng, base, 1) for _ in range(60)]
    for _ in range(6):
        other = base.split()[:30] + cases.words(rng, 40).split()
        texts += [edited(rng, " ".join(other), n) for n in (0, 1, 2)]
    texts += [edited(rng, base, 2) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    main = set(range(60))
    rows = [(1, i, 0 if i in main else i) for i in range(len(texts))] + [(2, 0, 0), (2, 1, 0)] + [(3, 70, 70), (3, 71, 71)]
    rows = spark.createDataFrame(rows, "key long, rep long, component long").cache()
    tokens = minhash_dedup.token_table(docs.withColumnRenamed("rep", "doc_id"), docs.select("rep")).cache()
    real = [(i, j) for i in range(len(texts)) for j in range(i) if not {i, j} <= main and shingle_similarity(texts[i], texts[j]) >= 0.8]
    inner = [(i, 0) for i in main]
    want = groups(len(texts), inner + real)
    for most in (7, 1000):
        monkeypatch.setattr(minhash_dedup, "BLOCK", most)
        links = [(r.a, r.b) for r in minhash_dedup.linked_in_buckets(rows, tokens, 0.8).collect()]
        assert groups(len(texts), inner + links) == want and set(links) <= set(real)
        sent = Counter((r.key, r.rep) for r in minhash_dedup.dealt(rows).collect())
        apart, blocks = -(-(len(texts) - 60) // most), -(-len(texts) // most)
        assert {key for key, _ in sent} == {1}  # two texts were compared with each other, one component needs no more
        assert all(n == apart if rep in main else n == apart + blocks - 1 for (_, rep), n in sent.items())
