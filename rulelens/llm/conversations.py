r"""Repair of conversation structure as lightest derivations.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Repair items ``(rows read, state)`` are
derived from one another by weighted deductions (keep, rerole, delete, insert), each weight a pair of cost and audit, the
letters of the edits so far. An agenda pops the least item first, as in Knuth's generalisation of shortest paths: the
deductions never give less than their premise, so what is popped is final.

Long conversations are cut into blocks of rows. For a block the agenda derives the lightest way from every state to every
state; items of neighbouring blocks are premises of one deduction that adds costs and joins audits. Equal costs never meet
with one audit a beginning of the other (that one would be cheaper), so the order of audits survives what is put behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulelens.llm.common import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a block: a bound of the agenda's memory, not of a conversation.
BLOCK_ROWS = 256
#: States after what has been read out: nothing, a system row, a user row, an assistant row. The first and last accept.
START, ACCEPT = 0, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAME = {"u": "user", "a": "assistant"}
MARKS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"

Span = dict[tuple[int, int], tuple[int, str]]


# ---------------------------------------------------------------- derivations


def lightest(rows: list[tuple[str, bool, bool]], entry: int, goals: tuple[int, ...] = ()) -> Span:
    """The least (cost, audit) from ``entry`` to the states after all ``rows`` (initial, must_go, truncated).

    With ``goals`` the agenda ends as soon as one of them is final, without them when all states are.
    """
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    final: set[tuple[int, int]] = set()
    out: Span = {}
    while agenda:
        cost, audit, read, state = heappop(agenda)
        if (read, state) in final:
            continue
        final.add((read, state))
        if read == len(rows):
            out[entry, state] = cost, audit
            if state in goals:
                break
        for letter in "ua":
            if (state, letter) in STEP:
                heappush(agenda, (cost + INSERT, audit + "I", read, STEP[state, letter]))
        if read < len(rows):
            initial, must_go, truncated = rows[read]
            heappush(agenda, (cost + DELETE, audit + "D", read + 1, state))
            if not must_go:
                more = cost + TRUNCATED * truncated
                if (state, initial) in STEP:
                    heappush(agenda, (more + KEEP, audit + "K", read + 1, STEP[state, initial]))
                for letter in "ua":
                    if (state, letter) in STEP:
                        heappush(agenda, (more + REROLE, audit + "R", read + 1, STEP[state, letter]))
    return out


def joined(left: Span, right: Span) -> Span:
    """The lightest ways through two neighbouring blocks."""
    out: Span = {}
    for (p, q), (c1, w1) in left.items():
        for r in range(4):
            if (q, r) in right:
                c2, w2 = right[q, r]
                best = out.get((p, r))
                if best is None or c1 + c2 <= best[0]:
                    new = (c1 + c2, w1 + w2)
                    out[p, r] = new if best is None else min(best, new)
    return out


class Joiner:
    """Blocks one after the other, joined in pairs of like size, so that audits are copied a logarithmic number of times."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Span]] = []

    def add(self, span: Span) -> None:
        size = 1
        while self.stack and self.stack[-1][0] == size:
            span = joined(self.stack.pop()[1], span)
            size *= 2
        self.stack.append((size, span))

    def result(self) -> tuple[int, str]:
        span = self.stack.pop()[1]
        while self.stack:
            span = joined(self.stack.pop()[1], span)
        return min(span[START, q] for q in ACCEPT if (START, q) in span)


# ---------------------------------------------------------------- rows and their faults


def cleaned(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy (1) of ``rows``; a null role or text is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"), F.lit(1).alias("copy"))


def damaged(rows: DataFrame) -> DataFrame:
    """``cleaned`` rows after the stated damage, by crc32 of ``conv_id:turn`` modulo 20 (a null part is one space).

    A dropped row stays as a mark of its conversation with ``copy`` 0; a repeated one has copies 1 and 2.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(F.encode(key, "utf-8")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(0))).when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return cleaned(rows).withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def order_columns() -> list[Column]:
    """The order of a conversation's rows: turn, nulls first; equal turns by role, then by a digest of the text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def digest() -> Column:
    return F.unhex(F.sha2(F.encode("text", "utf-8"), 256))


def faulty(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copy and fault (b, d, t or '') of each row; texts stay behind.

    A duplicate is found among the rows of its conversation, role and text alone, so that a long conversation is spread;
    blank rows, which may be many and equal, are told apart by their turn as they need no comparison.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    own = F.when(trimmed == "", "b").when(~F.substring(trimmed, -1, 1).isin(*MARKS), "t").otherwise("")
    narrow = rows.select("conv_id", "turn", "role", digest().alias("digest"), "copy", own.alias("own"))
    apart = F.when((F.col("own") == "b") | (F.col("copy") == 0), F.xxhash64("turn", "copy"))
    earlier = F.row_number().over(W.partitionBy("conv_id", "role", "digest", apart, F.col("copy") == 0).orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    return narrow.withColumn("fault", F.when(F.col("own") == "b", "b").when(earlier, "d").otherwise(F.col("own"))).drop("own")


# ---------------------------------------------------------------- blocks of rows

BLOCK = (
    "conv string, part int, no int, rows int, first_initial string, last_initial string, first_turn string, last_turn string, turns int, "
    "blank int, duplicate int, truncated int, illegal int, ways array<struct<entry: int, exit: int, cost: long, audit: string>>"
)
LEGAL = ("su", "ua", "au")


class Block:
    """A block under construction."""

    def __init__(self, conv: str | None, part: int, no: int, every: bool):
        self.conv, self.part, self.no, self.every = conv, part, no, every
        self.rows: list[tuple[str, bool, bool]] = []
        self.first_turn = self.last_turn = None
        self.turns = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0}

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        if self.rows and self.rows[-1][0] + initial not in LEGAL:
            self.illegal += 1
        if fault:
            self.faults[fault] += 1
        self.rows.append((initial, fault in ("b", "d"), fault == "t"))

    def row(self) -> tuple:
        span: Span = {}
        for entry in range(4) if self.every else (START,):
            span |= lightest(self.rows, entry)
        ends = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        ways = [{"entry": p, "exit": q, "cost": c, "audit": w} for (p, q), (c, w) in span.items()]
        return (self.conv, self.part, self.no, len(self.rows), *ends, *(None if t is None else str(t) for t in (self.first_turn, self.last_turn)), self.turns, *self.faults.values(), self.illegal, ways)


def blocks(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most ``most`` rows of ``faulty`` rows, numbered in the order of their conversation by (part, no).

    Rows are ordered by range partitions, over which a long conversation is spread; a partition is read as a stream.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, leading = None, None
        for pdf in frames:
            done = []
            for conv, part, turn, initial, fault, copy in zip(pdf.conv, pdf.part, pdf.turn, pdf.initial, pdf.fault, pdf["copy"], strict=True):
                if block is None:
                    leading = conv  # it may have begun in the partition before
                    block = Block(conv, part, 0, True)
                elif conv != block.conv:
                    done.append(block.row())
                    block = Block(conv, part, 0, False)
                elif len(block.rows) >= most:
                    done.append(block.row())
                    block = Block(conv, part, block.no + 1, True)
                if copy:
                    block.add(None if turn is None else int(turn), initial, fault)
            yield pd.DataFrame(done, columns=names)
        if block is not None:
            yield pd.DataFrame([block.row()], columns=names)

    names = [c.split()[0] for c in BLOCK.split(", ") if ":" not in c or c.startswith("ways")]
    order = [F.col("conv_id").asc_nulls_first(), *order_columns()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # numbers that may be null travel as text: pandas would turn them into floats
    narrow = placed.select(F.col("conv_id").cast("string").alias("conv"), F.spark_partition_id().alias("part"), F.col("turn").cast("string").alias("turn"), F.substring("role", 1, 1).alias("initial"), "fault", "copy")
    return narrow.mapInPandas(run, BLOCK)


CONVERSATION = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def conversations(table: DataFrame) -> DataFrame:
    """One row per conversation from its ``blocks``, which come as a stream in their order."""

    def finished(conv: str | None, of: dict, joiner: Joiner) -> tuple:
        cost, audit = joiner.result()
        gaps = 0 if of["first"] is None else of["last"] - of["first"] + 1 - of["turns"]
        return conv, gaps, of["blank"], of["duplicate"], of["truncated"], of["illegal"], cost, audit

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CONVERSATION.split(", ")]
        now = joiner = conv = None
        for pdf in frames:
            done = []
            for b in pdf.itertuples():
                if now is None or b.conv != conv:
                    if now is not None:
                        done.append(finished(conv, now, joiner))
                    conv, joiner = b.conv, Joiner()
                    now = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | dict.fromkeys(("first", "last", "initial"))
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += getattr(b, c)
                if b.first_turn is not None:
                    first, last = int(b.first_turn), int(b.last_turn)
                    now["turns"] += b.turns - (first == now["last"])
                    now["first"] = first if now["first"] is None else now["first"]
                    now["last"] = last
                if b.rows:
                    if now["initial"] is not None and now["initial"] + b.first_initial not in LEGAL:
                        now["illegal"] += 1
                    now["initial"] = b.last_initial
                joiner.add({(w["entry"], w["exit"]): (w["cost"], w["audit"]) for w in b.ways})
            yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([finished(conv, now, joiner)], columns=names)

    return table.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInPandas(run, CONVERSATION)


# ---------------------------------------------------------------- what the edits give


class Replay:
    """The repaired rows of a conversation, as its rows come one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        letter = "a" if self.state == 2 else "u"
        self.state = STEP[self.state, letter]
        return NAME[letter]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._made(), ""

    def rows(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state, role[:1]]
            yield role, text
        elif edit == "R":
            yield self._made(), text


def streams(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Each conversation's row of ``report`` (kind 0), then its rows in order, in one partition: one exchange of texts."""
    head = report.select(F.col("conv").cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copy"), F.lit(0).alias("kind"))
    both = head.unionByName(rows.where("copy > 0").withColumn("kind", F.lit(1)))
    both = both.withColumn("digest", F.when(F.col("kind") == 1, digest()))
    placed = both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *order_columns())
    return placed.select(F.col("conv_id").cast("string").alias("conv"), "kind", "role", "text")


def replayed(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str | None, int, str | None, str]]]:
    """Repaired rows (conv, position, role, text) of the ``streams``; a conversation without rows has one of role None."""
    conv, replay, n = None, None, 0
    for pdf in frames:
        out = []
        for c, kind, role, text in zip(pdf.conv, pdf.kind, pdf.role, pdf.text, strict=True):
            if kind == 0:
                if replay is not None:
                    out += [(conv, n + k, *r) for k, r in enumerate(replay.inserted())]
                conv, replay, n = c, Replay(text), 0
                out.append((conv, -1, None, ""))
            else:
                for r in replay.rows(role, text):
                    out.append((conv, n, *r))
                    n += 1
        yield out
    if replay is not None:
        yield [(conv, n + k, *r) for k, r in enumerate(replay.inserted())]


def repaired_rows(rows: DataFrame, report: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text: the repaired conversations. ``rows`` and ``report`` as of ``repair_report``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in replayed(frames):
            yield pd.DataFrame([r for r in out if r[1] >= 0], columns=["conv", "position", "role", "text"])

    found = streams(rows, report).mapInPandas(run, "conv string, position long, role string, text string")
    return found.select(F.col("conv").cast("long").alias("conv_id"), "position", "role", "text")


def repaired_digests(rows: DataFrame, report: DataFrame) -> DataFrame:
    """conv, repaired_sha256: SHA-256 of each repaired conversation's ``role:text`` lines, fed in as they come."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv = sha = None
        for out in replayed(frames):
            done = []
            for c, position, role, text in out:
                if position < 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(f"{chr(10) if position else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        if sha is not None:
            yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv", "repaired_sha256"])

    return streams(rows, report).mapInPandas(run, "conv string, repaired_sha256 string")


def repair_report(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """One row per conv_id of ``rows`` (``cleaned`` or ``damaged``): conv, gaps, faults, illegal, cost and audit.

    A null conv_id is a conversation; null turns come first and count in no gap; rows of equal turns are ordered by role,
    then by a digest of their text, and repeated rows are duplicates; empty and blank texts must go; texts of any length
    are read whole, but only digests of them are shuffled here; other columns do not come along; an empty table gives an
    empty result. A conversation of any length is spread over range partitions and blocks; one task then holds its audit.
    """
    return cut(conversations(cut(blocks(faulty(rows), most))))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation after damage: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    report = repair_report(rows)
    both = report.join(repaired_digests(rows, report).withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    counts = [F.col(c).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("conv").cast("long").alias("conv_id"), *counts, "audit", "repaired_sha256")


OP13_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS kind
  FROM keyed
), after_damage AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, E' \t\n\x0b\x0c\r') AS trimmed FROM after_damage
), judged AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN trimmed = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM ordered
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), steps(p, letter, q) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(p, q, cost, audit, lines) AS (  -- none, one or two rows put in; more would return to a state at a cost
  SELECT p, p, 0, '', [] FROM range(4) r(p)
  UNION ALL SELECT p, q, 3, 'I', [CASE letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM steps WHERE letter <> 's'
  UNION ALL SELECT p, 3, 6, 'II', ['user:', 'assistant:'] FROM range(2) r(p)
), edits AS (  -- what may be done to row i in state p
  SELECT conv_id, i, p, p AS q, 4 AS cost, 'D' AS audit, [] AS lines FROM judged, range(4) r(p)
  UNION ALL
  SELECT conv_id, i, p, q, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', [role || ':' || text]
  FROM judged JOIN steps ON letter = initial WHERE fault NOT IN ('b', 'd')
  UNION ALL
  SELECT conv_id, i, p, q, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', [CASE letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM judged, steps WHERE letter <> 's' AND fault NOT IN ('b', 'd')
), moves AS (
  SELECT e.conv_id, e.i, a.p, e.q, a.cost + e.cost AS cost, a.audit || e.audit AS audit, a.lines || e.lines AS lines
  FROM edits e JOIN inserts a ON a.q = e.p
), derived(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} FROM stats
  UNION ALL
  SELECT d.conv_id, d.i + 1, m.q, min({'cost': d.best.cost + m.cost, 'audit': d.best.audit || m.audit, 'lines': d.best.lines || m.lines})
  FROM derived d JOIN moves m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i + 1 AND m.p = d.q
  GROUP BY d.conv_id, d.i, m.q
), ended AS (
  SELECT s.conv_id, min({'cost': d.best.cost + a.cost, 'audit': d.best.audit || a.audit, 'lines': d.best.lines || a.lines}) AS best
  FROM stats s JOIN derived d ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = s.n JOIN inserts a ON a.p = d.q
  WHERE a.q IN (0, 3) GROUP BY s.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
