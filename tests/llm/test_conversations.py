import hashlib
import random
import re
from itertools import product

import pytest

from rulelens.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int"
GOOD = re.compile(r"(s?(ua)+)?")


def all_repairs(rows):
    """(cost, audit, lines) of the best of all repairs, by trying every edit of every row and up to two inserts in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    options = []
    for role, text, fault in rows:
        more = 3 * (fault == "t")
        some = [(4, "D", None)]
        if fault not in ("b", "d"):
            some += [(more, "K", (role, text))] + [(3 + more, "R", (r, text)) for r in ("user", "assistant")]
        options.append(some)
    best = None
    for edits in product(*options):
        for put in product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k, g in enumerate(put):
                for x in g:
                    cost, audit = cost + 3, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[x], ""))
                if k < len(edits):
                    cost, audit = cost + edits[k][0], audit + edits[k][1]
                    if edits[k][2]:
                        out.append(edits[k][2])
            if (best is None or (cost, audit) < best[:2]) and GOOD.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = cost, audit, out
    return best


def plain(rows):
    """Faults, gaps and repair of one conversation, from its rows in order (turn, role, text)."""
    seen, judged, n = set(), [], {"b": 0, "d": 0, "t": 0, "": 0}
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        n[fault] += 1
        judged.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, out = all_repairs(judged)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, n["b"], n["d"], n["t"], illegal, cost, audit, sha


def report(spark, rows, most):
    table = C.cleaned(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    found = C.repair_report(table, most)
    digests = {r.conv: r.repaired_sha256 for r in C.repaired_digests(table, found).collect()}
    return table, found, {r.conv: (*r[1:], digests[r.conv]) for r in found.collect()}


@pytest.mark.parametrize("most", [1, 2, 256])
def test_repair_against_all_repairs(spark, most):
    rng = random.Random(most)
    rows = []
    for conv in range(40):
        turn = rng.randrange(-2, 3)
        for _ in range(rng.randrange(1, 4)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(["Yes.", "No!", "cut", "Yes.", " \t", "Why?\n"])))
            turn += rng.choice([1, 1, 2])
    _, _, got = report(spark, rows, most)
    for conv in range(40):
        assert got[str(conv)] == plain([r[1:] for r in rows if r[0] == conv]), conv


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."),  # a null id is a conversation
        (1, None, "user", "First."), (1, None, "user", "First."), (1, 7, "assistant", "Last."),  # null turns come first
        (2, 3, None, "x."), (2, 4, "user", None), (2, 5, "", "y."),
        (3, 2**60, "user", "a" * 100_000 + "."), (3, 2**60 + 1, "assistant", "é" * 50_000 + "!"),
        (2**60 + 1, None, "user", "Alone."),
    ]
    table, found, got = report(spark, rows, 2)
    assert got[None][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert got["1"][:7] == (0, 0, 1, 0, 1, 4, "DKK") or got["1"][:7] == (0, 0, 1, 0, 1, 4, "KDK")
    assert got["2"][:7] == plain([(3, " ", "x."), (4, "user", " "), (5, "", "y.")])[:7]
    assert got["3"][:7] == (0, 0, 0, 0, 0, 0, "KK") and got[str(2**60 + 1)][6] == "KI"
    assert C.repaired_rows(table, found).where(f"conv_id = {2**60 + 1}").orderBy("position").select("role", "text").collect() == [("user", "Alone."), ("assistant", "")]
    empty = C.cleaned(spark.createDataFrame([], SCHEMA))
    assert C.repair_report(empty).count() == 0
    assert C.repaired_digests(empty, C.repair_report(empty)).count() == 0


def test_one_long_conversation_is_spread(spark):
    """Blocks of 256 rows over several partitions give what one agenda over all rows gives."""
    rng = random.Random(8)
    rows = [(9, t, rng.choice(["user", "assistant", "system"]), f"{t}" + rng.choice([".", ""])) for t in range(3000)] + [(t, 0, "user", "Hi.") for t in range(8)]
    table = C.cleaned(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart, as large ones do
    try:
        found = C.blocks(C.faulty(table)).where("conv = '9'").select("part", "rows").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in found}) > 1 and max(r.rows for r in found) <= 256
    whole = C.lightest([(r[2][0], False, r[3][-1] != ".") for r in rows[:3000]], 0)
    got = C.repair_report(table).where("conv = '9'").head()
    assert (got.cost, got.audit) == min(whole[0, q] for q in (0, 3))
    assert C.repaired_rows(table, C.repair_report(table)).where("conv_id = 9").count() == len(got.audit) - got.audit.count("D")


def test_damage_against_its_rule(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b! c? d") for c in range(30) for t in (0, 1, None)]
    got = {}
    for r in C.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r["copy"]))
    for c, t, role, text in rows:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [(role, text, 0)], 1: [(role, "", 1)], 2: [(role, "A b c d", 1)], 3: [(role, text, 1), (role, text, 2)], 4: [("user", text, 1)]}
        assert got[c, t] == want.get(k, [(role, text, 1)])
