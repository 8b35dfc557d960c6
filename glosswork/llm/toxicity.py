"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of their beginnings is trained in numpy from confirmed toxic documents and
unlabelled ones. The risk is prior * risk(toxic as toxic) + max(0, risk(unlabelled as clean) - prior *
risk(toxic as clean)), with logistic loss; when the second term falls below zero, its own gradient is followed
backwards. The class prior is the share of toxic rows among all labelled training rows.

The training sample is bounded and documented: POSITIVES confirmed and UNLABELLED other documents of the
training folds, least hash first, and at most FEATURES words or beginnings, those first whose shares in the two samples differ by
the most standard errors. None is left out for differing by few; its presence counts less, by the square of its share
of FULL standard errors. The beginnings of BEGINNINGS letters gather families of words that are rare each, such as
inflected insults. Scores cover every whole text.

Defined results: a null or empty text scores the bias alone; without confirmed toxic rows every score is
the prior (0 without labels); repeated rows get equal scores; labels of null or unknown documents are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table_of, whole_text

#: Bounds of the training sample, and of the model.
POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 2000
FULL = 4.0  # standard errors between a word's shares in the two samples from which its presence counts as 1
BEGINNINGS = (5, 6, 7, 8)
EPOCHS, RATE, DECAY = 400, 0.05, 1e-4
#: Entries of presence lists worked on at a time.
PART = 1 << 20
_STOPS = re.compile(r"[^\w\s]+")


def words_of(text: str) -> set[str]:
    """Distinct words in lower case without signs."""
    return set(_STOPS.sub(" ", text.lower()).split())


def features_of(text: str) -> set[str]:
    """The words of a text, and the beginnings of longer ones, marked by a sign that no word holds."""
    words = words_of(text)
    return words.union([w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n])


class Presence:
    """Rows of 0/1 presence, times the scale of each column, held as lists of columns of 16 bits."""

    def __init__(self, rows: list[np.ndarray], scale: np.ndarray):
        self.scale, self.size, self.parts = scale, len(rows), []
        first, have = 0, 0
        for i, row in enumerate(rows):
            have += len(row)
            if have >= PART or i == len(rows) - 1:
                some = rows[first:i + 1]
                self.parts.append((first, np.array([len(r) for r in some]), np.concatenate(some).astype(np.uint16)))
                first, have = i + 1, 0

    def __len__(self) -> int:
        return self.size

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        w = w * self.scale
        sums = [np.bincount(np.repeat(np.arange(len(n)), n), weights=w[columns], minlength=len(n)) for _, n, columns in self.parts]
        return np.concatenate(sums) if sums else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transposed rows times g."""
        out = np.zeros(len(self.scale))
        for first, n, columns in self.parts:
            out += np.bincount(columns, weights=np.repeat(g[first:first + len(n)], n), minlength=len(out))
        return out * self.scale


def _batch_risk(x: Presence, w: np.ndarray, b: float, sign: float) -> tuple[float, np.ndarray, float]:
    """Mean logistic loss of calling rows `sign`, and its gradient."""
    z = -sign * (x @ w + b)
    g = -sign / (1 + np.exp(-np.clip(z, -60, 60))) / max(1, len(x))
    return float(np.logaddexp(0, z).mean()) if len(x) else 0.0, x.back(g), float(g.sum())


def step_of(p: Presence, u: Presence, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, float]:
    """(risk of the confirmed as toxic, corrected risk as clean, direction for weights and for the bias): the gradient of
    both terms, or backwards that of the second where it is below zero."""
    rp, gp, bp = _batch_risk(p, w, b, 1.0)
    rpn, gpn, bpn = _batch_risk(p, w, b, -1.0)
    run, gun, bun = _batch_risk(u, w, b, -1.0)
    if run - prior * rpn >= 0:
        return prior * rp, run - prior * rpn, prior * gp + gun - prior * gpn, prior * bp + bun - prior * bpn
    return prior * rp, run - prior * rpn, prior * gpn - gun, prior * bpn - bun


def train(positive: Presence, unlabelled: Presence, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by steps over the whole bounded sample."""
    n = len(positive.scale)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for epoch in range(EPOCHS):
        _, _, g, gb = step_of(positive, unlabelled, w, b, prior)
        g, t = np.append(g + DECAY * w, gb), epoch + 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """(weights by word or beginning, bias). The driver receives at most the sample's presence lists."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("doc_id").isNotNull() & ~held_out())
    counts = known.agg(F.count("toxic").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    if not counts.p:
        return {}, -700.0
    prior = min(max(counts.p / counts.n, 1e-3), 0.9)
    order = F.xxhash64("doc_id", F.lit("sample"))
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(POSITIVES).withColumn("kind", F.lit(1))
    others = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out()).orderBy(F.xxhash64("doc_id", F.lit("other")), "doc_id").limit(UNLABELLED).distinct().withColumn("kind", F.lit(0))
    chosen = toxic.unionByName(others)  # at most POSITIVES + UNLABELLED rows of 16 bytes: bounded, so broadcast

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch):
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array([sorted(features_of(t)) for t in texts], pa.list_(pa.string()))], ["doc_id", "kind", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "kind", "text").mapInArrow(parse, "doc_id long, kind int, words array<string>"), "toxicity-sample")
    sizes = {r.kind: r.n for r in sample.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return {}, float(np.log(prior / (1 - prior)))
    share = lambda k: F.sum(F.when(F.col("kind") == k, 1.0).otherwise(0.0)) / F.lit(float(sizes.get(k, 0) or 1))
    spread = sample.select("kind", F.explode("words").alias("word")).groupBy("word").agg(share(1).alias("p"), share(0).alias("u"))
    positives, rest = float(sizes[1]), float(sizes.get(0, 0) or 1)
    spread_of = F.sqrt((F.col("p") + 1 / positives) / positives + (F.col("u") + 1 / rest) / rest)
    gap = F.abs(F.col("p") - F.col("u")) / spread_of
    ranked = spread.select("word", gap.alias("gap")).orderBy(F.desc("gap"), "word").limit(FEATURES).collect()
    vocabulary, scale = [r.word for r in ranked], np.array([min(1.0, r.gap / FULL) ** 2 for r in ranked])
    if not vocabulary:
        return {}, float(np.log(prior / (1 - prior)))
    index = {w: i for i, w in enumerate(vocabulary)}
    listed = F.split(F.lit(" ".join(vocabulary)), " ")  # words hold no space; one literal, not one a word
    rows: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in sample.orderBy("doc_id", "kind").select("kind", F.array_intersect("words", listed).alias("words")).toLocalIterator():
        rows[r.kind].append(np.array([index[x] for x in r.words], np.uint16))
    w, b = train(Presence(rows[1], scale), Presence(rows[0] or rows[1], scale), prior)
    return dict(zip(vocabulary, (w * scale).tolist())), b


def scores(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """(doc_id, score) for every row; the model has at most FEATURES words and beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = weights.keys()
        for batch in batches:
            for start, texts in slices(batch):
                z = np.array([bias + sum(map(weights.__getitem__, sorted(features_of(t) & names))) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["key", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("key"), whole_text().alias("text")).mapInArrow(run, "key long, score double").withColumnRenamed("key", "doc_id")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, columns as before."""
    weights, bias = fit(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("row"), whole_text().alias("text"))
    kind = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = weights.keys()
        for batch in batches:
            for start, texts in slices(batch):
                z = [bias + sum(map(weights.__getitem__, sorted(features_of(t) & names))) for t in texts]
                part = batch.slice(start, len(texts)).filter(pa.array([s < 0 for s in z]))
                row = part.column(0)
                yield pa.RecordBatch.from_arrays(row.flatten(), [f.name for f in row.type])

    return rows.mapInArrow(keep, kind)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels of the held-out fifth are never read."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scores(docs, *fit(docs, table_of(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
