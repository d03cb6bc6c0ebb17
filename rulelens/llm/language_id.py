"""Language identification by hierarchical discrimination.

Byte trigrams of the letters are hashed to frequencies. Linear support vector machines (one against one) first choose
the language family, then machines between the languages of that family choose within it. The machines are fitted in
numpy on a bounded sample of labelled documents; every document is scored in Arrow batches.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.common import batches, bucket_of, logistic, sample_rate, text_batches

FOLDS, HELD_OUT = 5, 0
DIM = 4096
#: Sampled documents per language at most (expected number; languages with fewer are taken whole).
PER_LANGUAGE = 600
#: Languages learned at most, those of most documents (machines grow with their square), and documents of all of them together.
LANGUAGES_MOST, SAMPLE_MOST = 64, 20_000
#: Families of language codes (fixed values); another code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tt"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of each byte trigram of all texts, and where each text's begin (one more entry ends the last).

    Everything in ASCII but letters counts as a space; texts are padded, so that each has a trigram.
    """
    parts = [b"  " + (t.lower() if t else "").encode("utf-8", "surrogatepass") + b"  " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    number = (code * np.uint32(2654435761)) >> np.uint32(20)
    number[code == 0x202020] = DIM  # runs of spaces say nothing
    return np.append(number, [DIM, DIM]).astype(np.int32), first


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge loss, accelerated gradient descent); y is +1 or -1."""
    used = np.flatnonzero(x.any(axis=0))  # a column of zeros keeps weight 0
    x1 = np.hstack([x[:, used], np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    v = np.ones(x1.shape[1]) / np.sqrt(x1.shape[1])
    for _ in range(20):
        v = x1.T @ (weight * (x1 @ v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    rate = 1 / (2 * top + decay)
    w = z = np.zeros(x1.shape[1])
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x1 @ z))
        new = z - rate * (-2 * x1.T @ (weight * y * slack) + decay * z)
        z = new + (t - 1) / (t + 2) * (new - w)
        w = new
    out = np.zeros(x.shape[1] + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


class Model:
    """Machines between families and between the languages of a family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        self.family = {c: FAMILY_OF.get(c, f"only {c}") for c in self.langs}
        self.families = sorted(set(self.family.values()))
        self.scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5) if len(x) else np.ones(DIM)
        self.machines: list[tuple[str, str]] = []
        weights = []
        fam = np.array([self.family[c] for c in langs.tolist()], dtype=object)
        groups = [(fam, self.families)] + [(langs, [c for c in self.langs if self.family[c] == f]) for f in self.families]
        for tags, names in groups:
            for a, b in combinations(names, 2):
                own = (tags == a) | (tags == b)
                weights.append(fit_svm((x[own] * self.scale).astype(np.float32), np.where(tags[own] == a, 1.0, -1.0)))
                self.machines.append((a, b))
        w = np.array(weights).reshape(len(weights), DIM + 1)
        # column j: weight of each trigram in machine j; the last row is for what is not counted
        self.table = np.vstack([(w[:, :DIM] * self.scale).T, np.zeros((1, len(w)))]).astype(np.float32)
        self.bias = w[:, DIM]

    def margins(self, texts: list[str | None]) -> np.ndarray:
        number, first = trigrams(texts)
        counted = np.add.reduceat((number < DIM).astype(np.int64), first[:-1])
        sums = [np.add.reduceat(self.table[:, j][number].astype(np.float64), first[:-1]) for j in range(len(self.machines))]
        return np.array(sums).reshape(len(self.machines), len(texts)).T / np.maximum(counted, 1)[:, None] + self.bias

    def vote(self, margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the machines between ``names`` (number of wins, then sum of margins) and its weakest margin."""
        if len(names) == 1:
            return np.zeros(len(margins), int), np.full(len(margins), 40.0)
        wins, total, least = (np.full((len(margins), len(names)), v) for v in (0.0, 0.0, 40.0))
        for j, (a, b) in enumerate(self.machines):
            if a in names and b in names:
                for name, side in ((a, 1), (b, -1)):
                    k, m = names.index(name), side * margins[:, j]
                    wins[:, k] += m > 0
                    total[:, k] += m
                    least[:, k] = np.minimum(least[:, k], m)
        best = np.lexsort((total, wins), axis=1)[:, -1]
        return best, least[np.arange(len(best)), best]

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        margins = self.margins(texts)
        lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        fam, sure = self.vote(margins, self.families)
        for k, family in enumerate(self.families):
            own = fam == k
            names = [c for c in self.langs if self.family[c] == family]
            best, within = self.vote(margins[own], names)
            lang[own] = np.array(names, dtype=object)[best]
            score[own] = logistic(3 * np.minimum(sure[own], within))
        blank = np.array([not t or not any(map(str.isalpha, t)) for t in texts])
        lang[blank], score[blank] = "und", 0.0
        return lang, score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: about ``per_language`` documents of each language, by a hash of doc_id.

    The LANGUAGES_MOST languages of most documents are learned (ties by code), from SAMPLE_MOST documents at most; codes
    beyond them, such as junk, are never predicted. Repeated rows are drawn together; null texts and languages are left out.
    """
    usable = text_batches(docs).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES_MOST).collect()}
    per_language = min(per_language, SAMPLE_MOST // max(1, len(counts)))
    pick = F.lit(False)
    for lang, n in counts.items():
        pick = pick | ((F.col("lang") == lang) & sample_rate("doc_id", "lang", per_language / n))

    def features(frames):
        for frame in frames:
            for pdf in batches([frame]):
                number, first = trigrams(pdf.text.tolist())
                rows = [np.unique(number[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pd.DataFrame({"lang": pdf.lang, "at": [r[0].tolist() for r in rows], "n": [r[1].tolist() for r in rows]})

    rows = usable.where(pick).select("lang", "text").mapInPandas(features, "lang string, at array<int>, n array<int>").toPandas()
    rows = rows.iloc[np.lexsort((rows["at"].map(len), rows["lang"]))] if len(rows) else rows
    x = np.zeros((len(rows), DIM + 1), dtype=np.float32)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        x[i, at] = n
    x = x[:, :DIM]
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    return Model(x, rows["lang"].to_numpy(dtype=object))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` with lang_pred and score: one row per row, whole texts.

    Null texts and texts without a letter get ``und`` and score 0, as do all texts if the model knows no language. Repeated
    rows and equal texts get the same; texts of any length are read whole; an empty table gives an empty one; other columns
    do not come along. Of languages with equal wins the larger sum of margins is taken, then the later code.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for pdf in batches(frames):
            lang, score = shared.value.predict([None if pd.isna(t) else t for t in pdf.text])
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "lang_pred": lang, "score": score})

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where(bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", "text", "lang")
    out = identify(docs, fit(learn))
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
