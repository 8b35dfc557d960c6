"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal word sequences are one class, stood for by the least doc_id. Signatures of 192
minima are cut into 32 bands of six. In each bucket of a band every member is paired with the bucket's
least one. Pairs go through their signatures batch by batch: after n comparisons with m matches, a pair is
dropped once the posterior chance of similarity at or over the threshold (uniform prior) is under MISS;
survivors are confirmed on the full shingle sets. Links make components.

A pair of members of which neither is the least of its bucket needs no test if a component holds both.
Buckets that still hold several components are finished exactly: members outside the component of the least
one meet all other members of the bucket (in blocks where it is large), by signatures and then by their full
sets, likeliest pairs first; pairs that links found so far already join are passed over, so a block gives no
more links than it has members. Of buckets with the same members one is read. So no candidate is lost, and a
bucket of one large group costs its size, not its square.

Defined results: texts without words have no shingles and link with nothing; fewer words than a shingle make
one of all; a row without doc_id links with nothing and is kept; rows with equal doc_id are one
node, which has the links of all their texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, let_go, slices, stored, table_of, whole_text

BANDS, ROWS = 32, 6
PERMUTATIONS = BANDS * ROWS
BATCH, MISS = 32, 1e-5
CHUNK = 256
#: Bits of the map of ids whose texts are needed.
SLOTS = 1 << 24
#: Pairs of signatures compared at a time.
PAIRS = 1 << 14
#: Characters of text taken at a time, and bytes hashed at a time.
CHARS, PART = 1_000_000, 1 << 17
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


#: Word hashes are polynomials in an odd base, modulo 2**64, with a random coefficient for each byte.
_VALUES = np.random.default_rng(17).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)


def normal(text: str) -> bytes:
    """The words in order, parted by one space each: lower-cased A-Z, cut at space, tab, line feed, vertical tab, form feed and return, which is what bytes do."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(line: bytes) -> np.ndarray:
    """A hash for each word of a line in which one space follows each word."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(line):
        stop = line.rfind(b" ", at, at + PART) + 1 or line.index(b" ", at) + 1
        raw = np.frombuffer(line, np.uint8, stop - at, at)
        bits = max(PART, len(raw) - 1).bit_length()
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * _powers(_BASE, bits)[:len(raw)], out=sums[1:])
        ends = np.flatnonzero(raw == 32)
        starts = np.append(0, ends[:-1] + 1)
        h = (sums[ends] - sums[starts]) * _powers(_INVERSE, bits)[starts]
        h = (h ^ h >> np.uint64(32)) * _MIX[0]
        out.append(h ^ h >> np.uint64(29))
        at = stop
    return np.concatenate(out)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words."""
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i:len(h) - k + 1 + i]) * _MIX[i % 5]
        s ^= s >> np.uint64(29)
    return s


def shingle_sets(lines: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted 64-bit shingle hashes of each of some normal texts."""
    counts = [x.count(b" ") + 1 if x else 0 for x in lines]
    hashes = word_hashes(b"".join(x + b" " for x in lines if x))
    runs, out, at = _runs(hashes, size) if len(hashes) >= size else hashes, [], 0
    for n in counts:
        out.append(np.unique(runs[at:at + n - size + 1] if n >= size else _runs(hashes[at:at + n], n) if n else hashes[:0]))
        at += n
    return out


def signature(shingles: np.ndarray, factors: np.ndarray = _A) -> np.ndarray:
    """Minima of multiplicative permutations of the shingles' halves, mixed."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(len(factors), 2**32 - 1, np.uint32)
    room = np.empty((min(len(x), 256), len(factors)), np.uint32)
    for i in range(0, len(x), 256):
        part = x[i:i + 256, None]
        np.multiply(part, factors, out=room[:len(part)])
        np.minimum(least, room[:len(part)].min(axis=0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """A key for each band of each signature, different between bands."""
    rows = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[4] + np.zeros((len(rows), 1), np.uint64)
    for j in range(ROWS):
        key = (key ^ rows[:, :, j]) * _MIX[j % 5]
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def least_matches(threshold: float, slots: int, miss: float = MISS) -> list[int]:
    """For each number n of slots compared, by batches: the fewest matches with a posterior chance of at least
    `miss` that the similarity reaches the threshold; from a uniform prior it is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(BATCH, slots + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
            if total >= miss:
                break
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of rows of signatures survive, batch after batch."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least_k in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= least_k
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ids, a row for each different text of an id. A bitmap of SLOTS hashed ids, broadcast as at most SLOTS / 64 rows
    whatever the input, keeps most other texts out of the join by id; what it lets through, the join drops."""
    ids = stored(ids, "near-ids")
    slot, bit = F.pmod(F.xxhash64("id"), F.lit(SLOTS)), F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text")).withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6))
    texts = texts.join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0).select("id", "text")
    return texts.join(ids, "id", "left_semi").groupBy("id", F.xxhash64("text").alias("of")).agg(F.min("text").alias("text")).select("id", "text")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles): the sorted hashes of the documents in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for start, texts in slices(batch, chars=CHARS):
                found = [x.tobytes() for x in shingle_sets([normal(t) for t in texts], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(found, pa.binary())], ["id", "shingles"])

    return texts_of(docs, ids).mapInArrow(run, "id long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """100 * intersection >= threshold * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= threshold * (len(both) - common)


def block_links(x: pa.Array, y: pa.Array, least: list[int], threshold: int) -> list[tuple[int, int]]:
    """Links between components, of members (id, comp, out, sig, shingles) x that are out and members y: a forest."""
    xi, xc, yi, yc = (v.field(k).to_numpy() for v in (x, y) for k in (0, 1))
    xo, yo = (v.field(2).to_numpy(zero_copy_only=False) for v in (x, y))
    sx, sy = _signatures(x.field(3)), _signatures(y.field(3))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = c = parent.get(up, up)
        return c

    i, j = np.nonzero(xo[:, None] & (xc[:, None] != yc[None, :]) & (~yo[None, :] | (xi[:, None] < yi[None, :])))
    kept = [surviving(sx[i[k:k + PAIRS]], sy[j[k:k + PAIRS]], least) + k for k in range(0, len(i), PAIRS)]
    kept = np.concatenate(kept) if kept else np.empty(0, np.int64)
    i, j = i[kept], j[kept]
    alike = np.concatenate([(sx[i[k:k + PAIRS]] == sy[j[k:k + PAIRS]]).sum(axis=1) for k in range(0, len(i), PAIRS)]) if len(i) else kept
    sets_x, sets_y = ({k: np.frombuffer(v.field(4)[k].as_py(), np.uint64) for k in set(of.tolist())} for v, of in ((x, i), (y, j)))
    out = []
    for k in np.argsort(-alike, kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        ra, rb = root(int(xc[a])), root(int(yc[b]))
        if ra != rb and similar(sets_x[a], sets_y[b], threshold):
            parent[max(ra, rb)] = min(ra, rb)
            out.append((int(max(xi[a], yi[b])), int(min(xi[a], yi[b]))))
    return out


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, seq (digest of the words), sig and band keys of every row."""
    schema = "doc_id long, n_shingles long, seq binary, sig binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for start, texts in slices(batch, chars=CHARS):
                lines = [normal(t) for t in texts]
                sets = shingle_sets(lines, size)
                sigs = [signature(s) for s in sets]
                bands = bands_of(np.array(sigs))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x, digest_size=16).digest() if x else None for x in lines], pa.binary()),
                    pa.array([x.astype(np.uint16).tobytes() if len(s) else None for x, s in zip(sigs, sets)], pa.binary()),
                    pa.array([x if len(s) else None for x, s in zip(bands, sets)], pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "seq", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets meet 100 * intersection >= threshold * union. Only texts in pairs travel twice."""
    pairs = stored(pairs, "near-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = stored(texts_of(docs, ids), "near-texts")
    both = pairs.join(texts.withColumnRenamed("id", "a").withColumnRenamed("text", "text_a"), "a").join(texts.withColumnRenamed("id", "b").withColumnRenamed("text", "text_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None, None
        let_go()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(batch.num_rows):
                if last[0] != b[i]:
                    last = b[i], shingle_sets([normal(batch.column(3)[i].as_py())], size)[0]
                mine = shingle_sets([normal(batch.column(2)[i].as_py())], size)[0]
                if similar(mine, last[1], threshold):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    links = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "near-links")
    drop_stored(pairs, texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, comp): least id reachable, for all ids in links (a, b). Minimum labels with pointer jumping."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links-both")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        new = stored(lower.join(jump, "low", "left").select("id", F.least("low", "far").alias("comp"), (F.least("low", "far") < F.col("comp")).alias("moved")), "labels")
        drop_stored(labels)
        if new.where("moved").isEmpty():
            drop_stored(both)
            return new.select("id", "comp")
        labels = new.select("id", "comp")


def classified(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    prints = stored(fingerprints(docs, size), "near-prints")
    usable = prints.where("doc_id is not null and seq is not null")
    reps = stored(usable.groupBy("seq").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("r")).select("seq", F.col("r.doc_id").alias("id"), "r.sig", "r.bands"), "near-reps")
    # an id of several texts is one node: its texts' classes are linked, and those that it stands for itself are one already
    of = usable.select("doc_id", "seq").join(reps.select("seq", "id"), "seq").groupBy("doc_id").agg(F.collect_set("id").alias("ids")).where("size(ids) > 1")
    same = stored(of.select(F.explode("ids").alias("a"), F.array_min("ids").alias("b")).where("a <> b").distinct(), "near-same")
    keyed = reps.select("id", F.explode("bands").alias("key")).distinct()
    prints_of = F.bit_xor(F.xxhash64("id")).alias("p"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("q")
    buckets = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n"), *prints_of).where("n > 1")
    buckets = stored(buckets.groupBy("pivot", "n", "p", "q").agg(F.min("key").alias("key")).select("key", "pivot", "n"), "near-buckets")
    members = stored(keyed.join(buckets, "key"), "near-members")
    drop_stored(buckets)
    sigs = reps.select("id", "sig")
    least = least_matches(threshold / 100, PERMUTATIONS)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = surviving(_signatures(batch.column(2)), _signatures(batch.column(3)), least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])

    pairs = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    signed = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    links = confirmed(signed.select("a", "b", "sa", "sb").mapInArrow(screen, "a long, b long").distinct(), docs, size, threshold).union(same)
    comps = components(links)

    # buckets with several components: members outside the least one's component against all others
    comp_of = lambda df, col, name: df.join(comps.select(F.col("id").alias(col), F.col("comp").alias(name)), col, "left").withColumn(name, F.coalesce(name, col))
    placed = stored(comp_of(comp_of(members, "id", "comp"), "pivot", "pivot_comp"), "near-placed")
    drop_stored(members)
    outside = placed.where("comp <> pivot_comp")
    if not outside.isEmpty():
        rest = placed.where("id <> pivot").join(outside.select("key").distinct(), "key", "left_semi")
        rest = rest.select("key", "n", "id", "comp", (F.col("comp") != F.col("pivot_comp")).alias("out"))
        sets = stored(full_sets(docs, rest.select("id").distinct(), size), "near-sets")
        filled = rest.join(sigs, "id").join(sets, "id")
        member = F.collect_list(F.struct("id", "comp", "out", "sig", "shingles"))
        whole = filled.where(F.col("n") <= CHUNK).groupBy("key").agg(member.alias("x")).select("x")
        chunked = filled.where(F.col("n") > CHUNK).withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)))
        blocks = lambda df, name: df.groupBy("key", "chunk", "n").agg(member.alias(name))
        # a block meets another by the key of both, so the blocks of one bucket are dealt over tasks
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / CHUNK) - 1))
        meet = blocks(chunked.where("out"), "x").withColumn("chunk", others).join(blocks(chunked, "y").drop("n"), ["key", "chunk"]).select("x", "y")

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in batches:
                for row in range(batch.num_rows):
                    found = block_links(batch.column(0)[row].values, batch.column(-1)[row].values, least, threshold)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        more = stored(whole.mapInArrow(linked, "a long, b long").union(meet.mapInArrow(linked, "a long, b long")).distinct(), "near-links")
        drop_stored(sets)
        comps = components(links.union(more))

    classes = reps.select("seq", "id").join(comps, "id", "left").select("seq", F.coalesce("comp", "id").alias("component_id"))
    rows = prints.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("seq")).alias("seq")).join(classes, "seq", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each group, columns as before. A document read twice stays as often as it was."""
    gone = classified(docs, size, threshold).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of 0.85 or more."""
    return classified(table_of(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85)
