"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones train a linear classifier in numpy. Its risk is
prior * E_toxic[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_toxic[loss(-)]), the class-prior-corrected
estimator that is never negative, with the logistic loss. Features say which pieces of words stand anywhere in a text:
whole words, word beginnings and runs of letters inside words, so that new forms of a marked word are known by
what they share with it. Weights are never negative: clean words around a marked one cannot hide it. Long clean texts
hold a marked word by chance now and then; how often, by number of different words, is estimated from unlabelled
documents, and evidence that chance gives at a text's length does not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.common import Adam, Words, batches, bucket_of, cut, logistic, mix64, powers, small_side, text_batches

FOLDS, HELD_OUT = 5, 0
#: Models are trained in so many turns: in each the unlabelled documents of another part are measured, all others train.
TURNS = 3
#: Documents that are fitted together (expected numbers): toxic and unlabelled ones. More are fitted in several shards.
SHARD_TOXIC, SHARD_UNLABELLED = 3000, 12000
#: Pieces of toxic documents go to all tasks up to so many; beyond, the pieces of all documents are counted and joined.
KNOWN_MOST = 1_000_000
#: Margins are counted in steps of 1 / GRID; a task hands on its counts of pieces when it holds so many.
GRID, HELD_COUNTS = 1024, 1 << 20
#: Most features, and training steps at most.
FEATURES, STEPS = 2000, 1200
#: A feature stands in so many toxic documents at least (a tenth of them where there are few).
SUPPORT = 5
#: Log-likelihood ratio that a feature reaches: chance alone gives about one piece in 30,000.
GAIN = 10.0
#: Share of toxic documents, as estimated from toxic and unlabelled documents and the prior, among those that hold a feature.
PURITY = 0.7
#: Estimated share of clean documents that lowering the threshold may reject.
CLEAN_LOSS = 0.002
#: A word is marked from so much evidence on; the chance that a clean text holds more marked words than are allowed for.
MARKED, CHANCE = 0.25, 0.01
#: Lengths of word beginnings and of runs of letters, in characters.
BEGINNINGS, RUN = range(4, 9), 5

_BASE = 0x9E3779B97F4A7C15
_KIND = {"word": 0x5851F42D4C957F2D, "run": 0x2545F4914F6CDD1D} | {k: (k * 0xD1342543DE82EF95) % (1 << 64) for k in BEGINNINGS}


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A number for each character of the lower-cased texts, and the words in them: text number, start and size."""
    parts = [(t or "").lower() + "\n" for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    inside = np.zeros(len(code) + 2, dtype=np.int8)
    inside[1:-1] = ((code >= 48) & (code < 58)) | ((code >= 97) & (code < 123)) | (code >= 128)
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return code.astype(np.uint64) + np.uint64(1), np.searchsorted(ends, start, side="right"), start, end - start


def _hashes(value: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of value * base^place over the characters of words of any length, from prefix sums."""
    up, down = powers(len(value) + 1)
    prefix = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value * up[:-1], out=prefix[1:])
    return (prefix[start + size] - prefix[start]) * down[start]


def _pieces(value: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (word number, 64-bit id) of the pieces of words, one block per kind of piece; ``whole`` are the words' hashes."""
    total = np.zeros(len(start), dtype=np.uint64)
    for k in range(max(BEGINNINGS)):
        live = np.flatnonzero(size > k)
        total[live] += value[start[live] + k] * _power(k)
        if k + 1 in BEGINNINGS:
            yield live, total[live] ^ np.uint64(_KIND[k + 1])
    yield np.arange(len(start)), whole ^ np.uint64(_KIND["word"])
    many = np.maximum(0, size - RUN + 1)
    at = _ranges(start, many)
    run = np.zeros(len(at), dtype=np.uint64)
    for j in range(RUN):
        run += value[at + j] * _power(j)
    yield np.repeat(np.arange(len(start)), many), run ^ np.uint64(_KIND["run"])


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (text number, 64-bit id) of all word pieces, repeats included, one block per kind of piece."""
    value, doc, start, size = _spans(texts)
    for word, ids in _pieces(value, start, size, _hashes(value, start, size)):
        yield doc[word], ids


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (``many[i]`` of them) for each i."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct whole numbers, by a sort: np.unique hashes them, which takes many times as long."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


class Vocabulary:
    """The different words of a batch of texts, and which text holds which; a word's pieces are made once.

    ``doc`` and ``word`` are the distinct pairs (text number, word number), sorted.
    """

    def __init__(self, texts: list[str | None]):
        self.n_texts = len(texts)
        self.value, doc, start, size = _spans(texts)
        word, self.whole = pd.factorize(_hashes(self.value, start, size))
        self.n = len(self.whole)
        first = np.zeros(self.n, dtype=np.int64)
        first[word[::-1]] = np.arange(len(word))[::-1]
        self.start, self.size = start[first], size[first]
        self.doc, self.word = np.divmod(_distinct(doc * self.n + word), max(1, self.n))

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (word number, 64-bit id) of the pieces of the different words."""
        return _pieces(self.value, self.start, self.size, self.whole)

    def different(self) -> np.ndarray:
        """The number of different words of each text."""
        return np.bincount(self.doc, minlength=self.n_texts)

    def spread(self, word: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (text number, ``at``), sorted, of what words hold: pairs (word number, ``at`` below ``n``), sorted by word."""
        first = np.searchsorted(word, np.arange(self.n + 1))
        many = np.diff(first)[self.word]
        return np.divmod(_distinct(np.repeat(self.doc, many) * n + at[_ranges(first[self.word], many)]), max(1, n))


class Known:
    """A sorted set of piece ids that finds its members in blocks of ids by a table of their scrambled upper bits."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.sort(np.asarray(ids).astype(np.uint64))
        self.bits = min(24, max(16, len(self.ids).bit_length() + 2))
        slot = self._slot(self.ids)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.by_slot = self.ids[self.order]
        self.first = np.r_[0, np.cumsum(np.bincount(slot, minlength=1 << self.bits))].astype(np.int32)

    def __reduce__(self):
        return Known, (self.ids,)  # tasks make the table again

    def _slot(self, ids: np.ndarray) -> np.ndarray:
        return ((ids * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def members(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` members stand, and their positions in the sorted set."""
        slot = self._slot(ids)
        at, end = self.first[slot], self.first[slot + 1]
        live = np.flatnonzero(at < end)
        where, found = [live[:0]], [self.order[:0]]
        while len(live):
            hit = self.by_slot[at[live]] == ids[live]
            where.append(live[hit])
            found.append(self.order[at[live[hit]]])
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return np.concatenate(where), np.concatenate(found).astype(np.int64)

    def in_words(self, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and positions in ``ids`` of the members that stand in each different word, each once, sorted."""
        pairs = [np.zeros(0, np.int64)]
        for word, ids in words.pieces() if len(self.ids) else ():
            where, at = self.members(ids)
            pairs.append(word[where] * len(self.ids) + at)
        return np.divmod(_distinct(np.concatenate(pairs)), max(1, len(self.ids)))

    def among(self, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and positions in ``ids`` of the members that stand in each text, each once, sorted."""
        return words.spread(*self.in_words(words), len(self.ids))

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``among`` for the words of texts."""
        return self.among(Vocabulary(texts))


def different_words(texts: list[str | None]) -> np.ndarray:
    """The number of different words of each text."""
    return Vocabulary(texts).different()


def poisson_quantile(mean: np.ndarray, beyond: float) -> np.ndarray:
    """The least whole numbers that a Poisson variable of each mean exceeds with a probability of at most ``beyond``."""
    mean = np.asarray(mean, dtype=float)
    out, term, total = np.zeros(len(mean)), np.exp(-mean), np.exp(-mean)
    open_ = np.flatnonzero((1 - total > beyond) & (mean < 500))
    k = 0
    while len(open_):
        k += 1
        term[open_] *= mean[open_] / k
        total[open_] += term[open_]
        out[open_] = k
        open_ = open_[1 - total[open_] > beyond]
    far = mean >= 500  # the normal approximation
    out[far] = np.ceil(mean[far] + 2.4 * np.sqrt(mean[far]))
    return out


class Model:
    """Chosen piece ids (sorted), their weights, the bias, and what chance gives: marked words per different word and the
    evidence of one."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, bias: float, rate: float = 0.0, mark: float = 0.0):
        self.known, self.weight, self.bias, self.rate, self.mark = Known(ids), weight, bias, rate, mark

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        return self._evidence(Vocabulary(texts))

    def _evidence(self, words: Vocabulary) -> np.ndarray:
        doc, at = self.known.among(words)
        return np.bincount(doc, weights=self.weight[at], minlength=words.n_texts)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        words = Vocabulary(texts)
        found = self._evidence(words)
        lit = np.flatnonzero(found)
        if self.rate > 0 and len(lit):
            found[lit] -= self.mark * poisson_quantile(self.rate * words.different()[lit], CHANCE)
        return self.bias + np.maximum(found, 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return logistic(self.margins(texts))

    def marks(self, texts: list[str | None]) -> np.ndarray:
        """The number of marked words of each text, different ones only."""
        return self.measures(texts)[0]

    def measures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``marks`` and ``evidence``."""
        words = Vocabulary(texts)
        word, at = self.known.in_words(words)
        marked = np.bincount(word, weights=self.weight[at], minlength=words.n) >= MARKED
        return np.bincount(words.doc[marked[words.word]], minlength=words.n_texts), self._evidence(words)


def chance_marks(marks: np.ndarray, words: np.ndarray, evidence: np.ndarray, toxic_marks: np.ndarray, toxic_evidence: np.ndarray, prior: float) -> tuple[float, float]:
    """(marked words per different word of clean texts, the evidence of such a word) from unlabelled and toxic documents.

    Texts of one marked word tell it, by steps of evidence: from each step the toxic share, known from the toxic sample and
    the prior, is taken off, and a step counts only where more is left than chance leaves of toxic documents alone. So
    words that only toxic documents hold, however often alone, are never taken for chance.
    """
    steps = lambda marks, evidence: np.bincount(evidence[marks == 1].astype(np.int64))
    mean = words[marks <= 1].mean() if (marks <= 1).any() else 0.0
    return chance_of(steps(marks, evidence), steps(toxic_marks, toxic_evidence), len(marks), len(toxic_marks), mean, prior)


def chance_of(seen: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int, words: float, prior: float) -> tuple[float, float]:
    """``chance_marks`` from counts: texts of one marked word by steps of evidence (unlabelled, toxic), numbers of all texts, and
    the mean number of different words of unlabelled texts with at most one marked word."""
    toxic = np.r_[toxic, np.zeros(max(0, len(seen) - len(toxic)))][: len(seen)] * (prior * n / max(1, n_toxic))
    left = np.where(seen > toxic + 2 * np.sqrt(toxic + 1), seen - toxic, 0)
    if not left.any():
        return 0.0, 0.0
    share = left.sum() / n / (1 - prior)
    return float(share / max(1.0, words)), float(np.average(np.arange(1, len(left) + 1), weights=left))  # upper ends of the steps


NOTHING = (np.zeros(0, np.uint64), np.zeros(0), -3.0)


class Sample:
    """Feature numbers of documents: ``at`` in the order of ``row``, which repeats each document's number.

    Documents without a feature are one row, the last; ``many`` says how many documents a row is.
    """

    def __init__(self, docs: list[np.ndarray]):
        lit = [d for d in docs if len(d)]
        self.n, self.many = len(docs), np.r_[np.ones(len(lit)), len(docs) - len(lit)]
        self.at = np.concatenate([np.zeros(0, np.int64), *lit]).astype(np.int64)
        size = np.array([len(d) for d in lit], dtype=np.int64)
        self.row, self.first = np.repeat(np.arange(len(lit)), size), np.cumsum(size) - size

    def margins(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, weights=weight[self.at], minlength=len(self.many))

    def thinned(self, rng: np.random.Generator) -> Sample:
        """Each document with a random share of its features, one at least: evidence as thin as a single marked word."""
        out, draw = object.__new__(Sample), rng.random(len(self.at))
        least = np.minimum.reduceat(draw, self.first) if len(draw) else draw
        stays = np.flatnonzero(draw <= np.maximum(least, (rng.random(len(self.many)) ** 4)[: len(least)])[self.row])
        out.n, out.many, out.at, out.row = self.n, self.many, self.at[stays], self.row[stays]
        return out


def risk(toxic: np.ndarray, other: np.ndarray, prior: float, n_toxic: np.ndarray | None = None, n_other: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative PU risk of margins, and its slopes by them.

    Where the estimated risk on clean documents is below 0, it counts as 0 and has no slope. Each margin stands for one
    document, or for as many as ``n_toxic`` and ``n_other`` say.
    """
    p, u = (np.full(len(x), 1 / len(x)) if n is None else n / n.sum() for x, n in ((toxic, n_toxic), (other, n_other)))
    rest = (u * np.logaddexp(0, other)).sum() - prior * (p * np.logaddexp(0, toxic)).sum()
    value, by_toxic = prior * (p * np.logaddexp(0, -toxic)).sum() + max(0.0, rest), -prior * logistic(-toxic) * p
    if rest < 0:
        return value, by_toxic, np.zeros(len(other))
    return value, by_toxic - prior * logistic(toxic) * p, logistic(other) * u


def fit_weights(toxic: Sample, other: Sample, n_features: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights (0 or more) and bias by Adam on thinned documents, until the risk of 100 steps no longer falls.

    Every feature was chosen as a mark of toxic documents, so each starts with a weight that suffices.
    """
    weight, bias = np.ones(n_features), np.array([-1.0])
    opt, rng, seen, best = Adam([weight, bias], 0.05), np.random.default_rng(7), [], np.inf
    for step in range(steps):
        p, u = toxic.thinned(rng), other.thinned(rng)
        value, by_toxic, by_other = risk(p.margins(weight, bias[0]), u.margins(weight, bias[0]), prior, p.many, u.many)
        slope = np.bincount(p.at, by_toxic[p.row], n_features) + np.bincount(u.at, by_other[u.row], n_features)
        opt.step([slope + 1e-4 * weight, np.array([by_toxic.sum() + by_other.sum()])])
        np.maximum(weight, 0, out=weight)
        seen.append(value)
        if step % 100 == 99:
            if step >= 799 and np.mean(seen[-100:]) > best - 1e-4:
                break
            best = min(best, np.mean(seen[-100:]))
    return weight, float(bias[0])


def threshold(toxic: np.ndarray, other: np.ndarray, prior: float, clean_loss: float = CLEAN_LOSS, n_toxic: np.ndarray | None = None, n_other: np.ndarray | None = None) -> float:
    """The lowest margin, at most 0, down to which at most ``clean_loss`` of the clean documents are rejected besides.

    ``other`` are margins of unlabelled documents that took no part in training. What they hold between the threshold
    and 0 beyond the toxic share (``prior`` times that of ``toxic``) is clean. Each margin stands for one document, or for as
    many as ``n_toxic`` and ``n_other`` say.
    """

    def sums(x: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(x, kind="stable")
        return x[order], np.r_[0, np.cumsum(np.ones(len(x)) if n is None else n[order])]

    other, toxic = sums(other, n_other), sums(toxic, n_toxic)
    below = np.unique(other[0][other[0] < 0])
    if not len(below) or not len(toxic[0]):
        return 0.0
    share = lambda x: (x[1][np.searchsorted(x[0], 0.0)] - x[1][np.searchsorted(x[0], below)]) / x[1][-1]
    fine = share(other) - prior * share(toxic) <= clean_loss * (1 - prior)
    bad = np.flatnonzero(~fine)
    if not len(bad):
        return 0.0  # no clean document to hold the threshold up
    above = below[bad[-1] + 1] if bad[-1] + 1 < len(below) else 0.0
    return float((below[bad[-1]] + above) / 2)


def chosen(counts: DataFrame, toxic: int, other: int, prior: float, most: int = FEATURES) -> np.ndarray:
    """The piece ids of ``counts(id, n, m)`` whose document frequencies mark toxic documents best (likelihood ratio)."""
    p, u = (F.col("n") + 0.5) / (toxic + 1), (F.col("m") + 0.5) / (other + 1)
    floor = lambda c: F.greatest(1 - c, F.lit(1e-9))
    gain = F.col("n") * F.log(p / u) + (toxic - F.col("n")) * F.log(floor(p) / floor(u))
    best = counts.where(prior * p / u >= PURITY).select("id", gain.alias("gain")).where(F.col("gain") >= GAIN).orderBy(F.desc("gain"), "id").limit(most)
    return np.array([r.id for r in best.collect()], dtype=np.int64).astype(np.uint64)


def counted(frames, known: Known | None = None):
    """Partial document frequencies of pieces by the documents' turn: of all, or of the ``known`` ones."""
    ids = np.zeros(0, np.uint64) if known is None else known.ids
    n = np.zeros((len(ids), TURNS), np.int64)
    waiting, rows = [], 0
    for pdf in batches(frames):
        words, turn = Vocabulary(pdf.text.tolist()), pdf.turn.to_numpy(dtype=np.int64)
        if known is not None:
            doc, at = known.among(words)
            n += np.bincount(at * TURNS + turn[doc], minlength=n.size).reshape(n.shape)
            continue
        word, block = (np.concatenate(x) for x in zip(*words.pieces(), strict=True))
        at, value = pd.factorize(block)
        word, at = np.divmod(_distinct(word * len(value) + at), max(1, len(value)))
        doc, at = words.spread(word, at, len(value))
        waiting.append((value, np.bincount(at * TURNS + turn[doc], minlength=len(value) * TURNS).reshape(-1, TURNS)))
        rows += len(value)
        if rows > HELD_COUNTS:
            ids, n = _summed([(ids, n), *waiting])
            waiting, rows = [], 0
            if len(ids) > HELD_COUNTS:
                yield _frequencies(ids, n)
                ids, n = ids[:0], n[:0]
    ids, n = _summed([(ids, n), *waiting]) if waiting else (ids, n)
    some = n.any(axis=1)
    yield _frequencies(ids[some], n[some])


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted ids of several (ids, counts by turn) and the sums of their counts."""
    ids, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(ids)
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
    return ids[first], np.add.reduceat(n[order], first) if len(first) else n


def _frequencies(ids: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": ids.astype(np.int64)} | {f"m{k}": n[:, k] for k in range(TURNS)})


def sketches(texts: list[str]) -> np.ndarray:
    """The least hash of each text's 3-word strings, which near copies share."""
    words = Words(texts)
    h, last = words.hash, len(words.hash) - 2
    three = mix64(h[:last] + mix64(h[1 : last + 1] + mix64(h[2:]))) if last > 0 else h[:0]
    least = np.full(len(texts), np.iinfo(np.uint64).max, dtype=np.uint64)
    whole = np.flatnonzero(words.doc[:last] == words.doc[2:]) if last > 0 else np.zeros(0, np.int64)
    np.minimum.at(least, words.doc[whole], three[whole])
    short = np.flatnonzero(np.diff(words.first) < 3)
    for i in short:
        least[i] = mix64(h[words.first[i] : words.first[i + 1]].sum(keepdims=True, dtype=np.uint64))[0]
    return least.astype(np.int64)


def learning_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All texts to learn from: text, hash (of it), toxic (counts as a toxic document), turn, part (other, threshold or null).

    ``turn`` is the one whose model measures the document; ``part`` says what it is for as an unlabelled one in the first turn. Of near copies one counts as unlabelled, and one of those labelled toxic as toxic. Which one is found over narrow rows;
    texts meet the result by a broadcast while it is small.
    """

    @F.pandas_udf("long")
    def sketch(text: pd.Series) -> pd.Series:
        parts = batches([pd.DataFrame({"text": text})])
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *(sketches(part.text.tolist()) for part in parts)]))

    rows = text_batches(docs).where("text is not null").select("doc_id", "text", sketch("text").alias("sketch"), F.xxhash64("text").alias("hash"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    narrow = rows.select("row", "doc_id", "sketch", "hash")
    marked = narrow.join(small_side(cut(labels.where("toxic = 1").select("doc_id").distinct())), "doc_id", "left_semi")
    first = lambda of, use: of.groupBy("sketch").agg(F.min(F.struct("hash", "row")).alias("m")).select("m.row", F.lit(use).alias("use"))
    keep = cut(first(narrow, 2).union(first(marked, 1)).groupBy("row").agg(F.sum("use").alias("use")))
    turn = F.pmod(F.xxhash64("sketch", F.lit("threshold")), F.lit(TURNS)).cast("int")
    both = rows.join(small_side(keep), "row").select("text", "hash", (F.col("use") != 2).alias("toxic"), turn.alias("turn"), F.when(F.col("use") >= 2, "other").alias("part"))
    return cut(parts_of(both, 0))


def parts_of(rows: DataFrame, turn: int) -> DataFrame:
    """``rows(turn, part)`` with the parts of one turn: unlabelled documents of this turn are held back from its training."""
    return rows.withColumn("part", F.when(F.col("part").isNotNull(), F.when(F.col("turn") == turn, "threshold").otherwise("other")))


def train(found: DataFrame, n_toxic: int, n_other: int, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias over all rows of ``found(toxic, part, hash, at)``: fitted in shards, then averaged.

    A shard holds about SHARD_TOXIC toxic and SHARD_UNLABELLED unlabelled documents; the scarcer side is dealt to several
    shards. A feature's weight is averaged over the shards by its documents there, the bias evenly, in whole numbers, so
    that reruns agree. A table of one shard is fitted as a whole.
    """
    return train_turns([(found, n_toxic, n_other, np.ones(n_features, bool))], prior)[0]


def train_turns(turns: list[tuple[DataFrame, int, int, np.ndarray]], prior: float) -> list[tuple[np.ndarray, float]]:
    """``train`` for each (found, n_toxic, n_other, the features that it may use) in one job."""
    allowed = [mine for _, _, _, mine in turns]
    n_features = len(allowed[0])

    def dealt(turn: int, rows: DataFrame, toxic: bool, n: int, least: int, shards: int) -> DataFrame:
        copies = min(shards, -(-shards * least // n))
        shard = F.pmod(F.pmod("hash", F.lit(shards)) + F.col("copy"), F.lit(shards))
        rows = rows.select("at", "hash", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        return rows.select("at", F.lit(toxic).alias("toxic"), F.lit(turn).alias("turn"), shard.alias("shard"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        turn = int(pdf.turn.iloc[0])
        pdf = pdf.assign(at=[a[allowed[turn][a]] for a in (np.asarray(a, dtype=np.int64) for a in pdf["at"])])
        pdf = pdf.assign(key=[tuple(a) for a in pdf["at"]]).sort_values("key", kind="stable")
        toxic, other = (Sample(list(pdf["at"][side])) for side in (pdf.toxic, ~pdf.toxic))
        if not toxic.n or not other.n:
            return pd.DataFrame({"turn": [], "feature": [], "n": [], "total": []})
        weight, bias = fit_weights(toxic, other, n_features, prior)
        n = np.bincount(np.concatenate([toxic.at, other.at]), minlength=n_features)
        at = np.flatnonzero(n)
        total = np.rint(np.r_[weight[at] * n[at], bias] * (1 << 20)).astype(np.int64)
        return pd.DataFrame({"turn": turn, "feature": np.r_[at, n_features], "n": np.r_[n[at], 1], "total": total})

    both = None
    for turn, (found, n_toxic, n_other, _) in enumerate(turns):
        shards = max(1, -(-n_toxic // SHARD_TOXIC), -(-n_other // SHARD_UNLABELLED))
        some = dealt(turn, found.where("toxic"), True, n_toxic, SHARD_TOXIC, shards)
        some = some.union(dealt(turn, found.where("part = 'other'"), False, n_other, SHARD_UNLABELLED, shards))
        both = some if both is None else both.union(some)
    parts = both.groupBy("turn", "shard").applyInPandas(fitted, "turn int, feature long, n long, total long")
    sums = parts.groupBy("turn", "feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
    mean = np.zeros((len(turns), n_features + 1))
    mean[sums.turn, sums.feature] = sums.total / sums.n / (1 << 20)
    return [(m[:-1], float(m[-1])) for m in mean]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, both already cut to the rows to learn from.

    All of them are used. Toxic documents: those labelled 1. Unlabelled: all ``docs``, whose labels are not looked at. They
    are in TURNS parts, by content: each part is measured by a model whose features and weights come from the others alone.
    The threshold and chance come from these measures of all documents; the model is the mean of those of the turns, so that
    each document trains it too. Near copies count once. The class prior is the share of 1 among the labels. Null texts are left out; without toxic documents, labels or
    features every score is that of no evidence, below 0.5. Repeated rows count once.

    What reaches the driver is bounded whatever the number of documents: at most KNOWN_MOST pieces, the chosen features,
    their weights, and counts by steps of evidence and of margins.
    """
    counts = labels.where("toxic is not null").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).head()
    prior = (counts.k or 0) / counts.n if counts.n else 0.0
    if prior <= 0:
        return Model(*NOTHING)
    share = docs.sparkSession.sparkContext.broadcast
    texts = learning_texts(docs, labels)
    in_turn = [F.count_if(F.col("part").isNotNull() & (F.col("turn") == k)).alias(f"m{k}") for k in range(TURNS)]
    n = texts.agg(F.count_if("toxic").alias("toxic"), *in_turn).head()
    n_other = {k: sum(n[1:]) - n[f"m{k}"] for k in range(TURNS)}
    turns = [k for k in range(TURNS) if n_other[k]]
    if not n.toxic or not turns:
        return Model(*NOTHING)
    held = [f"m{k}" for k in range(TURNS)]

    def count(rows: DataFrame, run) -> DataFrame:
        partial = rows.select("text", "turn").mapInPandas(run, "id long, " + ", ".join(f"{m} long" for m in held))
        return partial.groupBy("id").agg(*(F.sum(m).alias(m) for m in held))

    seen = count(texts.where("toxic").withColumn("turn", F.lit(0)), counted).select("id", F.col("m0").alias("n"))
    seen = cut(seen.where(F.col("n") >= min(SUPPORT, max(1, n.toxic // 10))))
    known = share(Known(np.array(seen.select("id").toPandas()["id"], dtype=np.int64)) if seen.count() <= KNOWN_MOST else None)
    there = count(texts.where("part is not null"), lambda frames: counted(frames, known.value))
    there = cut(seen.join(there, "id", "left").fillna(0, held))
    besides = lambda k: there.select("id", "n", sum(F.col(m) for m in held if m != f"m{k}").alias("m"))
    ids = [chosen(besides(k), n.toxic, n_other[k], prior) for k in turns]
    every = np.unique(np.concatenate(ids))
    if not len(every):
        return Model(*NOTHING)
    features = share(Known(every))

    def present(frames):
        for pdf in batches(frames):
            words = Vocabulary(pdf.text.tolist())
            doc, at = features.value.among(words)
            cuts = np.searchsorted(doc, np.arange(len(pdf) + 1))
            lit = np.diff(cuts) > 0  # the others' texts are not looked at again
            yield pdf[["toxic", "turn", "part", "hash"]].assign(at=[at[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], words=words.different(), text=pdf.text.where(lit, None))

    found = cut(texts.mapInPandas(present, "toxic boolean, turn int, part string, hash long, at array<int>, words long, text string"))
    models = train_turns([(parts_of(found, k), n.toxic, n_other[k], np.isin(every, mine)) for k, mine in zip(turns, ids, strict=True)], prior)
    weight, bias = np.mean([w for w, _ in models], axis=0), float(np.mean([b for _, b in models]))
    plain = share({k: Model(every, w, bias) for k, (w, _) in zip(turns, models, strict=True)})

    def measured(frames):
        for pdf in batches(frames):
            marks, evidence = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for k, model in plain.value.items():
                lit = np.flatnonzero(pdf.text.notna() & (pdf.turn == k))
                texts = pdf.text.iloc[lit].tolist()
                marks[lit], evidence[lit] = model.measures(texts)
            yield pdf[["toxic", "held", "words"]].assign(marks=marks, evidence=evidence)

    # a table so small that all its documents are of one turn has no model without them
    turn = F.when(F.col("turn").isin(turns), F.col("turn")).otherwise(turns[0]).alias("turn")
    judged = found.select("toxic", F.col("part").isNotNull().alias("held"), turn, "words", "text")
    judged = cut(judged.mapInPandas(measured, "toxic boolean, held boolean, words long, marks long, evidence double"))
    few = F.col("marks") <= 1
    steps = judged.groupBy("toxic", "held", F.when(F.col("marks") == 1, F.floor("evidence")).alias("step"))
    steps = steps.agg(F.count("*").alias("n"), F.count_if(few).alias("few"), F.sum(F.when(few, F.col("words")).otherwise(0)).alias("words")).toPandas()
    by_step = lambda x: np.bincount(x.step.dropna().astype(np.int64), x.n[x.step.notna()])
    of_toxic, of_held = steps[steps.toxic], steps[steps.held]
    rate, mark = chance_of(by_step(of_held), by_step(of_toxic), of_held.n.sum(), of_toxic.n.sum(), of_held.words.sum() / max(1, of_held.few.sum()), prior)

    def margins(frames):
        for pdf in frames:
            x = bias + np.maximum(pdf.evidence - mark * poisson_quantile(rate * pdf.words.to_numpy(), CHANCE), 0)
            yield pdf[["toxic", "held"]].assign(bin=np.floor(np.minimum(x, 0) * GRID).astype(np.int64))

    bins = judged.mapInPandas(margins, "toxic boolean, held boolean, bin long").groupBy("toxic", "held", "bin").agg(F.count("*").alias("n")).toPandas()
    middle = np.where(bins.bin < 0, (bins.bin + 0.5) / GRID, 0.0)
    least = threshold(middle[bins.toxic], middle[bins.held], prior, CLEAN_LOSS, bins.n[bins.toxic].to_numpy(), bins.n[bins.held].to_numpy())
    return Model(every, weight, min(bias - least, -1e-6), rate, mark)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id and score in 0..1, one row per row; extra columns are left out.

    Null texts, empty ones and those without a known piece get the score of no evidence, below 0.5. Repeated rows and
    equal texts score alike; a text of any length is read whole. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for pdf in batches(frames):
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "score": shared.value.score([None if pd.isna(t) else t for t in pdf.text])})

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` (any columns, all kept) without the rows whose text scores ``least`` or more.

    Null and empty texts stay; repeated rows go or stay together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        parts = batches([pd.DataFrame({"text": text})])
        return pd.Series(np.concatenate([shared.value.score([None if pd.isna(t) else t for t in part.text]) for part in parts]))

    return text_batches(docs).where(scored("text") < least)


def learning_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents and labels outside the held-out fold; rows without doc_id belong to no fold and are left out."""
    mine = bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT
    return docs.select("doc_id", "text").where(mine), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(mine)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(*learning_rows(spark, docs, sf_dir)))
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
