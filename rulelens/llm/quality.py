"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from counts of its bytes and words; gated attention, learned
from document labels, weighs the encodings; the weighted sum is scored. Training is in numpy on a bounded sample,
scoring in Arrow batches over whole texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.common import INK_BYTE, Adam, Words, batches, bucket_of, join_labels, logistic, sample_rate, text_batches

FOLDS, HELD_OUT = 3, 1
PASSAGE = 40
#: Sampled documents per label (expected number), encoding and attention widths, training steps.
PER_LABEL, HIDDEN, GATE, STEPS = 1500, 16, 8, 300


def byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


CLASSES = [
    byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    byte_class("abcdefghijklmnopqrstuvwxyz"),
    byte_class("0123456789"),
    byte_class(".,;:'\"-()"),
    byte_class("!?"),
    byte_class("|/\\_=<>{}[]"),
    byte_class("#$%&*@^~+`"),
    np.arange(256) >= 128,
]
N_FEATURES = len(CLASSES) + 6


def passages(texts: list[str | None], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text and an end); an empty text has one passage of zeros."""
    words = Words(texts, INK_BYTE, lower=False)
    n_words = np.diff(words.first)
    n_passages = np.maximum(1, -(-n_words // size))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    x = np.zeros((first[-1], N_FEATURES))
    if not len(words.start):
        return x, first
    place = np.arange(len(words.start)) - words.first[words.doc]
    home = first[words.doc] + place // size
    at = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
    end = np.r_[at[1:], len(home)]
    rows, count = home[at], (end - at).astype(float)
    lo, hi = words.start[at], words.end[end - 1]
    length = (words.end - words.start).astype(float)
    ink = np.add.reduceat(length, at)
    for k, member in enumerate(CLASSES):
        total = np.concatenate([[0], np.cumsum(member[words.data], dtype=np.int32)])
        x[rows, k] = (total[hi] - total[lo]) / ink
    same = np.zeros(len(home))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (home[1:] == home[:-1])
    order = np.lexsort((words.hash, home))
    fresh = np.ones(len(home))
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (home[order][1:] != home[order][:-1])
    initial = CLASSES[0][words.data[words.start]].astype(float)
    k = len(CLASSES)
    x[rows, k] = np.add.reduceat(same, at) / count
    x[rows, k + 1] = np.add.reduceat(fresh, at) / count
    x[rows, k + 2] = np.add.reduceat(initial, at) / count
    x[rows, k + 3] = ink / count / 10
    x[rows, k + 4] = np.log1p(count) / 4
    x[rows, k + 5] = np.log1p(n_words[words.doc[at]]) / 10
    return x, first


class Model:
    """Encoder, gated attention and scorer."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = len(mean)
        self.mean, self.spread = mean, spread
        self.params = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), rng.normal(0, GATE**-0.5, GATE), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        enc, enc_b, att_t, att_s, att, out, out_b = self.params
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(z @ enc + enc_b)
        t, s = np.tanh(h @ att_t), logistic(h @ att_s)
        e = (t * s) @ att
        size = np.diff(first)
        top = np.repeat(np.maximum.reduceat(e, first[:-1]), size)
        a = np.exp(e - top)
        a /= np.repeat(np.add.reduceat(a, first[:-1]), size)
        bag = np.add.reduceat(a[:, None] * h, first[:-1])
        return z, h, t, s, a, bag, logistic(bag @ out + out_b)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.forward(*passages(texts))[-1]

    def train(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> None:
        opt = Adam(self.params, 0.02)
        size = np.diff(first)
        for _ in range(steps):
            _, _, att_t, att_s, att, out, _ = self.params
            z, h, t, s, a, bag, p = self.forward(x, first)
            d = weight * (p - y) / weight.sum()
            d_h = a[:, None] * np.repeat(d[:, None] * out, size, axis=0)
            d_a = h @ out * np.repeat(d, size)
            d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first[:-1]), size))
            d_t, d_s = d_e[:, None] * att * s * (1 - t * t), d_e[:, None] * att * t * s * (1 - s)
            d_h += d_t @ att_t.T + d_s @ att_s.T
            d_z = d_h * (1 - h * h)
            grads = [z.T @ d_z, d_z.sum(0), h.T @ d_t, h.T @ d_s, (t * s).T @ d_e, bag.T @ d, np.array([d.sum()])]
            opt.step([g + 1e-4 * q for g, q in zip(grads, self.params, strict=True)])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, both cut to the rows to learn from.

    About PER_LABEL documents of each label are taken by a hash of doc_id and weighted back to the labels' shares.
    Without labels all texts score 0.5 or so; with one label only, scores lean to it.
    """
    labels = labels.where("quality in (0, 1)")
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    pick = F.lit(False)
    for value, n in counts.items():
        pick = pick | ((F.col("quality") == value) & sample_rate("doc_id", "quality", PER_LABEL / n))
    rows = join_labels(docs.where("text is not null"), labels.where(pick), "quality").select("text", "y")

    def encode(frames):
        for pdf in batches(frames):
            x, first = passages(pdf.text.tolist())
            yield pd.DataFrame({"y": pdf.y, "x": [x[a:b].ravel().tolist() for a, b in zip(first[:-1], first[1:], strict=True)]})

    got = rows.mapInPandas(encode, "y int, x array<double>").toPandas()
    if not len(got):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    got = got.iloc[np.argsort([sum(v[:8]) for v in got["x"]], kind="stable")]
    x = np.concatenate([np.asarray(v) for v in got["x"]]).reshape(-1, N_FEATURES)
    first = np.concatenate([[0], np.cumsum([len(v) // N_FEATURES for v in got["x"]])])
    y = got["y"].to_numpy(dtype=float)
    weight = np.where(y == 1, counts.get(1, 0) / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y == 0).sum()))
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3)
    model.train(x, first, y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id and score in 0..1, one row per row; a null text counts as empty.

    Repeated rows and equal texts score alike; texts of any length are read whole; an empty table gives an empty one; other
    columns do not come along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for pdf in batches(frames):
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "score": shared.value.score([None if pd.isna(t) else t for t in pdf.text])})

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mine = bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(mine)
    out = score(docs, fit(docs.select("doc_id", "text").where(mine), labels))
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
