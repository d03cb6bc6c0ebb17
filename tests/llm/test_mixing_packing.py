import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tests.llm import cases
from tokenizers import Tokenizer

from rulelens.llm import mixing, packing


def targets(sizes):
    """Targets by the stated rule: share by weight, stop at three times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        total, over = sum(weight[s] for s in free), 0.0
        for s in list(free):
            out[s] += left * weight[s] / total
            if out[s] > 3 * sizes[s]:
                over += out[s] - 3 * sizes[s]
                out[s] = 3.0 * sizes[s]
                free.discard(s)
        left = over
    return out


def test_targets_follow_the_rule(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 25):
        sizes = {f"s{k:02d}" if k else None: rng.choice([0, 1, 10, 1000, 50000]) for k in range(n)}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = targets(sizes)
        assert {r.source for r in got} == set(sizes)
        for r in got:
            assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])


def test_mix_repeats_documents(spark):
    docs = cases.awkward(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    again = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert Counter(r.doc_id for r in rows) == again
    many = spark.createDataFrame([cases.row(i, "w " * 50, "en", "big" if i % 4 else f"s{i % 3}") for i in range(2000)], cases.SCHEMA)
    sized = mixing.sizes(many)
    by = {r.source: r for r in mixing.source_targets(sized).collect()}
    taken = Counter()
    for r in mixing.with_copies(sized, mixing.source_targets(sized)).collect():
        assert 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    for s, r in by.items():
        assert abs(taken[s] - r.target) <= 0.12 * r.target
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_sizes(spark):
    text = "a b  c\x1fd\n\x0be"
    got = mixing.sizes(spark.createDataFrame([cases.row(1, text)], cases.SCHEMA)).head()
    assert got["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_pieces_are_the_tokenizer_s(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([cases.row(1, "plain <|endoftext|> text"), *cases.awkward(spark).collect()], cases.SCHEMA)
    own = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        at = 0
        while at < len(ids):
            n = len(ids) if len(ids) <= 1024 else (first if at == 0 else 1024)
            want[(r.doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
            at += n
    placed = packing.pack(docs, path).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in placed) == want
    rooms = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == rooms.get(r.sequence_id, 0)
        rooms[r.sequence_id] = r.offset + r.length
    assert max(rooms.values()) <= 1024
    assert packing.pack(cases.empty(spark), path).count() == 0
    packed = packing.sequences(docs, path).collect()
    assert sum(len(r.ids) for r in packed) == sum(r.length for r in placed)


def test_plan_is_complete_and_tight():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 1025, 3000), np.minimum(1024, rng.lognormal(6, 1, 3000).astype(int) + 1), np.full(100, 1024), rng.integers(300, 700, 2000), np.array([5])):
        counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        bins = packing.plan(counts)
        got = Counter()
        for n, own in bins:
            assert sum(own) <= 1024
            for length in own:
                got[length] += n
        assert got == counts
        best_fit = sum(n for n, _ in packing.best_fit([], counts, 1024))
        assert sum(n for n, _ in bins) <= 1.01 * best_fit + 1
    assert packing.plan({}) == []
