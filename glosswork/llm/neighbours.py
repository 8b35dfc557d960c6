"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred and turned by a rotation learned on a bounded sample (alternating sign codes and
orthogonal Procrustes), and their signs are 64-bit codes. A code is eight substrings of eight bits, each
indexed by a direct table. By the pigeonhole principle a code within Hamming radius 8 s + a of a query agrees
with it in one of the first a + 1 substrings up to s bits, or in one of the others up to s - 1: probing
these buckets of each table retrieves every code within the radius, and nothing is found any other way.
Retrieved vectors within the radius are reranked by exact inner products in double precision.

The radius of a query grows until its present 20th is so near that, of true neighbours as near, the share LEFT_OUT
lies outside. How many standard deviations of the Hamming distance (bits differ with the probability angle / pi)
that takes is measured on the sample, where true neighbours are known. Vectors of unequal length get one more
coordinate first, which makes the largest inner product the smallest angle.

All rows are indexed, in blocks of a bounded size; the stated queries, in blocks too, meet each block once. Where
vectors are near none in particular, as random ones in many dimensions, the radius is wide: probes then touch most
buckets, and it is the Hamming distance that keeps most rows from being scored (share_scored tells how many).

Defined results: vectors that are null, zero, of another length than the sample's, or hold null or
non-finite components take no part; ties go to the smaller vec_id; with fewer candidates all are ranked;
rows with equal vec_id and vector are one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table_of

SAMPLE, BLOCK_ROWS, QUERY_ROWS, BITS, TOP = 10_000, 16_384, 1024, 64, 20
WIDTH = 8  # bits of a substring
PARTS = BITS // WIDTH
#: Share of true neighbours that the radius may miss on the sample, and sample rows that are taken for queries there.
LEFT_OUT, TRIALS = 0.12, 256
STEP = 2  # greatest growth of a radius before its 20th is looked at again
_POP = np.array([bin(i).count("1") for i in range(1 << WIDTH)], np.uint8)
#: Differences of a substring by their number of bits, fewest first, and how many have at most s.
_BY_BITS = np.argsort(_POP, kind="stable").astype(np.uint8)
_UP_TO = np.cumsum(np.bincount(_POP))


def learn_rotation(sample: np.ndarray, rounds: int = 30, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs lose least of the centred sample."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    turns = []
    for _ in range(-(-BITS // x.shape[1])):
        values, vectors = np.linalg.eigh(x.T @ x)
        basis = vectors[:, ::-1][:, :BITS]
        v = x @ basis
        turn = np.linalg.qr(rng.standard_normal((basis.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        turns.append(basis @ turn)
    return mean, np.concatenate(turns, axis=1)[:, :BITS]


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """(rows, PARTS) substrings of the codes."""
    return np.packbits((x - mean) @ projection >= 0, axis=1, bitorder="little")


class Index:
    """Direct tables over the substrings of one block's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(PARTS)]
        self.starts = [np.searchsorted(codes[o, j], np.arange((1 << WIDTH) + 1)) for j, o in enumerate(self.order)]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows in the buckets that are due for a radius, without repeats."""
        bits, more = divmod(radius, PARTS)
        seen = np.zeros(len(self.codes), bool)
        for j in range(PARTS):
            within = bits if j <= more else bits - 1
            if within >= 0:
                buckets = _BY_BITS[:_UP_TO[min(within, WIDTH)]] ^ code[j]
                order, starts = self.order[j], self.starts[j]
                for a, b in zip(starts[buckets].tolist(), starts[buckets.astype(np.int64) + 1].tolist()):
                    seen[order[a:b]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all codes within a Hamming radius, and their distances."""
        rows = self.probed(code, radius)
        distance = _POP[self.codes[rows] ^ code].sum(axis=1, dtype=np.uint8)
        near = distance <= radius
        return rows[near], distance[near]


def radius_for(score: float, reach: float, slack: float) -> int:
    """Hamming radius due for neighbours of a score. reach: length of the query times the greatest of all vectors."""
    p = np.arccos(np.clip(score / reach, -1, 1)) / np.pi
    return int(np.clip(np.ceil(BITS * p + slack * np.sqrt(BITS * p * (1 - p))), 0, BITS))


def measured(sample: np.ndarray, most: float, mean: np.ndarray, projection: np.ndarray, top: int) -> tuple[float, int]:
    """(slack in standard deviations, radius to probe first): what holds all but LEFT_OUT of the true neighbours of TRIALS
    rows of the sample among the rest of it. With all rows they are nearer, and fewer are missed."""
    at = np.unique(np.linspace(0, len(sample) - 1, TRIALS).astype(np.int64))
    lengths = np.sqrt((sample[at] ** 2).sum(axis=1))
    codes, asked = codes_of(lift(sample, most), mean, projection), codes_of(lift_query(sample[at], most), mean, projection)
    apart, angles = [], []
    for i, code, length in zip(at, asked, lengths):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        near = np.argsort(-scores, kind="stable")[:min(top, len(sample) - 1)]
        if not len(near):
            continue
        p = np.arccos(np.clip(scores[near[-1]] / (length * np.sqrt(most)), -1, 1)) / np.pi
        distance = _POP[codes[near] ^ code].sum(axis=1, dtype=np.int64)
        apart.append((distance - BITS * p) / max(np.sqrt(BITS * p * (1 - p)), 1e-9))
        angles.append(p)
    if not apart:
        return 0.0, 0
    slack, p = float(np.quantile(np.concatenate(apart), 1 - LEFT_OUT)), float(np.median(angles))
    return slack, int(np.clip(np.ceil(BITS * p + slack * np.sqrt(BITS * p * (1 - p))), 0, BITS))


def lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))])


def lift_query(q: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([q, np.zeros(len(q))]) * np.sqrt(most) / np.linalg.norm(q, axis=1)[:, None]


def nearest(query: np.ndarray, own: int, code: np.ndarray, index: Index, ids: np.ndarray, x: np.ndarray, reach: float, top: int, slack: float, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(vec_ids, scores) of the nearest found in a block, and how many rows were scored."""
    rows, scores, at, below = np.empty(0, np.int64), np.empty(0), radius - 2 * STEP, -1
    found, distance = index.within(code, radius)
    while True:
        if at > radius:  # wider than what has been probed
            radius = min(BITS, at + STEP)
            found, distance = index.within(code, radius)
        new = found[(distance <= at) & (distance > below) & (ids[found] != own)]
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, (x[new] * query).sum(axis=1)])
        need = radius_for(np.partition(scores, -top)[-top], reach, slack) if len(rows) >= top else BITS
        if at >= need:
            break
        below, at = at, min(need, at + STEP)
    best = np.lexsort((ids[rows], -scores))[:top]
    return ids[rows[best]], scores[best], len(rows)


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    x = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return x.where(~bad).withColumn("squares", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).where("squares > 0")


def search(table: DataFrame, queries: DataFrame, top: int = TOP, key: str = "vec_id", vector: str = "embedding", scored: bool = False) -> DataFrame:
    """Each query's nearest rows of table but itself: query_id, rank, vec_id, score. If scored, instead
    (query_id, n_scored, n_rows): how many rows of how many were reranked for each."""
    spark = table.sparkSession
    data, asked = valid_vectors(table, key, vector), valid_vectors(queries, key, vector)
    out = "query_id long, rank int, vec_id long, score double" if not scored else "query_id long, n_scored long, n_rows long"
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()
    if not sample:
        return spark.createDataFrame([], out)
    lengths = [len(r.x) for r in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    data, asked = data.where(F.size("x") == dim), asked.where(F.size("x") == dim)
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.max("squares").alias("most")).first()
    n_asked, most = asked.count(), float(facts.most)
    known = np.array([r.x for r in sample if len(r.x) == dim])
    mean, projection = learn_rotation(lift(known, most))
    slack, radius = measured(known, most, mean, projection, top)
    blocks, groups = -(-facts.n // BLOCK_ROWS), max(1, -(-n_asked // QUERY_ROWS))
    packed = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n))).groupBy(name).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.flatten(F.collect_list("x")).alias(f"{name}_x"))
    spread = packed(asked, groups, "q").withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = packed(data, blocks, "d").join(spread, "d").select("d_ids", "d_x", "q_ids", "q_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                d_ids, d_x, q_ids, q_x = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(4))
                x, q = d_x.reshape(-1, dim), q_x.reshape(-1, dim)
                index = Index(codes_of(lift(x, most), mean, projection))
                codes, reach = codes_of(lift_query(q, most), mean, projection), np.linalg.norm(q, axis=1) * np.sqrt(most)
                found = [nearest(q[i], q_ids[i], codes[i], index, d_ids, x, reach[i], top, slack, radius) for i in range(len(q))]
                if scored:
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array([f[2] for f in found], pa.int64()), pa.array([len(x)] * len(q), pa.int64())], ["query_id", "n_scored", "n_rows"])
                    continue
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([f[0] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    if scored:
        return pairs.mapInArrow(run, out).groupBy("query_id").agg(F.sum("n_scored").alias("n_scored"), F.sum("n_rows").alias("n_rows"))
    best = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # top rows a block at most
    return best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 20; candidates: every other row."""
    rows = table_of(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))
