import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm import cases

from rulelens.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  \n\t ", "Hello, world! <|endoftext|> <s> </s>", "▁ under ▁▁bars", "naïve café — 漢字かな 🙂🙂 ́x", "a\x00b\r\n\x07",
    "<0x41> literal", "x" * 3000, "0123456789" * 40, "the the the the", "the the the the", "The quick brown fox's tail isn't 3.14159 long", "  wide  spaces   here",
]


def plain_groups(text):
    """Straight from the two libraries: tokens with their bytes, cut at all common ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = alignment.byte_of_char()
    a = [(i, bytes(chars[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        piece = sp.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    spans = []
    for tokens in (a, b):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        spans.append(out)
    common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, lo = [], 0
    for cut in common:
        groups.append([[i for i, s, e in side if s >= lo and e <= cut] for side in spans])
        lo = cut
    links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
    return groups, links, len(a), len(b)


def plain_report(texts):
    found = [plain_groups(t) for t in texts]
    n = Counter(p for f in found if f for p in set(f[1]))
    most = {}
    for (a, _), c in n.items():
        most[a] = max(most.get(a, 0), c)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links, na, nb = f
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(n[p] == most[p[0]] for p in links)
        out.append((na, nb, len(groups), len(links), best, sum(n[p] for p in links), hashlib.sha256(line.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_report_against_brute_force(spark, most):
    """With three pairs broadcast, the others come through the shuffled join."""
    rng = random.Random(2)
    texts = TEXTS + [cases.words(rng, 60) for _ in range(6)] + ["".join(chr(rng.choice([32, 97, 233, 0x4E00 + rng.randrange(500), 0x1F600])) for _ in range(80))]
    docs = spark.createDataFrame([(i, t, i, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_a long, row string, pairs string")
    got = alignment.alignment_report(docs, A, B, most).orderBy("doc_id").collect()
    want = plain_report(texts)
    assert [tuple(r)[1:] for r in got] == want
    assert want[4][0] > 0 and want[5] == (0, 0, 0, 0, 0, 0, "")


def test_cuts_against_intersection():
    rng = np.random.default_rng(1)
    for k in range(200):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(1, n * 2, n))
        b = np.unique(np.r_[rng.integers(1, n * 2, n), a[-1]])
        if k % 3 == 0:  # one text that shares nothing but its end
            b = np.unique(np.r_[a[:-1] * 1000 + 1, a[-1] * 1000])
            a = a * 1000
        got = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
        want = np.isin(a, b)
        want[-1] = False  # the last end is not an open candidate
        assert (got == want).all()


def test_long_texts_stay_fast_and_whole():
    text = "abcdefgh" * 40_000 + "漢" * 20_000
    got = alignment.align_texts([text, "short"], A, B)
    assert got["n_a"][0] > 20_000 and got["n_groups"][0] >= 1 and got["n_groups"][1] >= 1
    assert got["times"].sum() == got["n_links"].sum()


def test_awkward_and_empty_tables(spark):
    docs = cases.awkward(spark)
    rows = alignment.alignment_report(docs, A, B).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.n_a for r in rows}[1] == 0 and sum(r.doc_id is None for r in rows) == 1
    twice = [r for r in rows if r.doc_id == 12]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert alignment.alignment_report(cases.empty(spark), A, B).count() == 0
    pairs = alignment.token_map(docs, A, B)
    assert pairs.groupBy("a_id").agg({"best": "max"}).where("not `max(best)`").count() == 0
