"""Suffix-array dedup: every byte covered by a WINDOW-byte string that also starts elsewhere goes.

The suffix array is sparse and dealt out. In each window the k-gram of least hash is its anchor, so equal
windows have equal anchors at equal places; suffixes are sorted at anchors only, and all anchors with one hash
meet. For such a group the suffixes' right sides are sorted, their common prefixes found, and a
stack scan yields the tree of common-prefix intervals. At an interval of prefix length r, the members whose
left extensions of WINDOW - r bytes are equal repeat a window together, all of them, not just neighbours. The
left sides' diversity decides where such a class ends: a member leaves it where its left side
differs from all others.

Anchors whose hash comes once are dropped before any text moves. Equal texts are one text with a
count, and equal surroundings of an anchor are one with a count, combined before the shuffle. A group with more
than HOT distinct surroundings is not brought into one task: its windows are counted by digest instead, which
is exact too. Neighbouring anchors of a text whose surroundings are equal, as over one byte or a short period
repeated, are one entry with the number of times, so that such a stretch has no more entries than any other.

Defined results: a null or empty text has no bytes and no spans; texts under WINDOW bytes lose nothing; equal
texts, under any doc_id or none, get equal results, and lose everything if they have WINDOW bytes or more; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table_of, whole_text

WINDOW, GRAM, HOT = 200, 32, 20_000
#: Windows of a text whose anchors are looked for at once, and surroundings that a worker holds at once.
BLOCK, HELD = 1 << 22, 20_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    width = 1
    while width < GRAM:
        m = np.uint64(0xD6E8FEB86659FD93 + 2 * width)
        h = (h[:-width] * m) ^ (h[width:] >> np.uint64(7)) ^ (h[width:] * np.uint64(0xC2B2AE3D27D4EB4F))
        width *= 2
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(29))


def anchors_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the anchors of all windows, and the first and last start of the windows each serves."""
    none = np.empty(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none
    h = gram_hashes(np.frombuffer(data, np.uint8))
    span = WINDOW - GRAM + 1
    # least hash with its place, the last of equal ones: minima over runs of two's powers, then of two runs
    low, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * width <= span:
        right = low[width:] <= low[:-width]
        at = np.where(right, at[width:], at[:-width])
        low = np.minimum(low[width:], low[:-width])
        width *= 2
    rest = span - width
    n = len(h) - span + 1
    place = np.where(low[rest:rest + n] <= low[:n], at[rest:rest + n], at[:n]).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    return h[place[first]].view(np.int64), place[first], first, last


def merged(data: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries that stay, times of each): neighbouring anchors with equal surroundings become the first of them.

    Anchors serve adjoining windows, so those of a run with equal surroundings stand as far apart as one serves windows.
    """
    times, stays, step = np.ones(len(h), np.int64), np.ones(len(h), bool), np.diff(first)
    alike = np.flatnonzero((h[1:] == h[:-1]) & (np.diff(place) == step) & (np.diff(last) == step))
    for run in np.split(alike, np.flatnonzero(np.diff(alike) != 1) + 1):
        if not len(run):
            continue
        a, z, d = first[run[0]], last[run[-1]] + WINDOW, step[run[0]]
        uneven = np.concatenate([[0], np.cumsum(data[a:z] != data[a + d:z + d])])
        equal = run[uneven[last[run] + WINDOW - a] == uneven[first[run] - a]]
        for part in np.split(equal, np.flatnonzero(np.diff(equal) != 1) + 1):
            if len(part):
                times[part[0]] += len(part)
                stays[part + 1] = False
    return stays, times[stays]


def entries_of(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, place, first, last, times) of a text's anchors, block after block; an anchor at a block's edge comes in both,
    each time with the windows that it serves there."""
    for at in range(0, len(data) - WINDOW + 1, BLOCK):
        block = data[at:at + BLOCK + WINDOW - 1]
        h, place, first, last = anchors_of(block)
        stays, times = merged(np.frombuffer(block, np.uint8), first, last, h, place)
        yield h[stays], place[stays] + at, first[stays] + at, last[stays] + at, times


def common(a: bytes, b: bytes) -> int:
    """Bytes that two sides share, WINDOW at most: no window needs more, and intervals that differ beyond it are one."""
    return len(commonprefix([a[:WINDOW], b[:WINDOW]]))


def intervals(heights: list[int]) -> list[tuple[int, int, int]]:
    """Stack scan: (common prefix, first, last) of each interval of a suffix array; heights[i] is that of i - 1 and i."""
    out, stack = [], [(0, 0)]
    for i, height in enumerate([*heights[1:], -1], 1):
        first = i - 1
        while stack and stack[-1][0] > height:
            size, first = stack.pop()
            if size > 0:
                out.append((size, first, i - 1))
        if not stack or stack[-1][0] < height:
            stack.append((height, first))
    return out


def repeats(group: list[tuple[bytes, bytes]]) -> list[list[tuple[int, int]]]:
    """For each (left side reversed, right side) of a group of different surroundings: (least, most) numbers of bytes
    left of the anchor at which a repeated window starts."""
    found: list[list[tuple[int, int]]] = [[] for _ in group]
    order = sorted(range(len(group)), key=lambda i: group[i][1])
    heights = [0] + [common(group[a][1], group[b][1]) for a, b in zip(order, order[1:])]
    for right, first, last in intervals(heights):
        need = max(0, WINDOW - right)
        members = [i for i in order[first:last + 1] if len(group[i][0]) >= need]
        members.sort(key=lambda i: group[i][0])
        lefts = [common(group[a][0], group[b][0]) for a, b in zip(members, members[1:])]
        for k, i in enumerate(members):
            most = max(lefts[k - 1] if k else -1, lefts[k] if k < len(lefts) else -1)
            if most >= need:
                found[i].append((need, most))
    return found


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    facts = base.select("doc_id", F.unhex(F.md5("text")).alias("th"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    texts = base.select(F.unhex(F.md5("text")).alias("th"), F.encode("text", "UTF-8").alias("data")).where(F.length("data") >= WINDOW)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for entry in entries_of(batch.column(1)[i].as_py()):
                    th = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(entry[0]), np.int32)), batch.column(0).slice(i, 1)).dictionary_decode()
                    yield pa.RecordBatch.from_arrays([th, *map(pa.array, entry)], ["th", "h", "p", "s", "e", "k"])

    anchors = stored(texts.mapInArrow(mark, "th binary, h long, p long, s long, e long, k long"), "anchors")
    one = F.xxhash64("th", "p")
    again = stored(anchors.groupBy("h").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.max("k").alias("k")).where("a <> b or k > 1").select("h"), "anchors-again")
    lists = anchors.join(again, "h", "left_semi").groupBy("th").agg(F.collect_set(F.struct("h", "p", "s", "e", "k")).alias("found"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.compress(x.as_py()) for x in batch.column(1)], pa.binary())], ["th", "z"])

    tight = texts.mapInArrow(squeeze, "th binary, z binary").groupBy("th").agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("n"))
    suspects = stored(tight.join(lists, "th", "left").where("n > 1 or found is not null"), "repeat-texts", "none")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                data, found = d.decompress(batch.column(1)[i].as_py()), batch.column(2).slice(i, 1).flatten()
                for at in range(0, len(found), HELD):
                    rows = found.slice(at, HELD).to_pylist()
                    ctx = [data[r["s"]:r["e"] + WINDOW] for r in rows]
                    off = [r["p"] - r["s"] for r in rows]
                    cid = [hashlib.blake2b(c + b"%d" % o, digest_size=12).digest() for c, o in zip(ctx, off)]
                    th = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(rows), np.int32)), batch.column(0).slice(i, 1)).dictionary_decode()
                    long = [pa.array(x, pa.int64()) for x in ([r["h"] for r in rows], [r["s"] for r in rows], [r["k"] for r in rows], [(r["k"] - 1) * (r["e"] - r["s"] + 1) for r in rows])]
                    yield pa.RecordBatch.from_arrays([th, *long, pa.array(cid, pa.binary()), pa.array(off, pa.int32()), pa.array(ctx, pa.binary())], ["th", "h", "s", "k", "tail", "cid", "off", "ctx"])

    # an entry's surroundings stand k times, the last of them `tail` bytes after the first; what repeats in one does in all
    places = suspects.where("found is not null").select("th", "z", "found").mapInArrow(surroundings, "th binary, h long, s long, k long, tail long, cid binary, off int, ctx binary")
    distinct = stored(places.groupBy("h", "cid").agg(F.sum("k").alias("n"), F.first("off").alias("off"), F.first("ctx").alias("ctx")), "surroundings")
    sizes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).where("all > 1")
    hot = stored(sizes.where(F.col("m") > HOT).select("h"), "hot-anchors")
    ranges = "cid binary, least int, most int"  # in bytes left of the anchor

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows):
            out = []
            if len(rows) > 1:
                for (cid, n, off, ctx), found in zip(rows, repeats([(ctx[:off][::-1], ctx[off:]) for _, _, off, ctx in rows])):
                    # windows that this anchor serves: starts 0 .. len(ctx) - WINDOW
                    least = max(0, off - (len(ctx) - WINDOW))
                    out += [(cid, max(a, least), min(b, off)) for a, b in found if max(a, least) <= min(b, off)]
            return out + [(cid, max(0, off - len(ctx) + WINDOW), off) for cid, n, off, ctx in rows if n > 1]

        def table(out):
            cid, a, b = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(cid, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["cid", "least", "most"])

        now, rows, out = None, [], []
        for batch in batches:
            for h, cid, n, off, ctx in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now:
                    out += close(rows)
                    now, rows = h, []
                    if len(out) > 20_000:
                        yield table(out)
                        out = []
                rows.append((cid, n, off, ctx))
        out += close(rows)
        if out:
            yield table(out)

    normal = distinct.join(sizes.where(F.col("m") <= HOT).select("h"), "h", "left_semi").select("h", "cid", "n", "off", "ctx")
    found = normal.repartition("h").sortWithinPartitions("h").mapInArrow(grouped, ranges)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, n, off, ctx in zip(*(c.to_pylist() for c in batch.columns)):
                digests = [hashlib.blake2b(ctx[i:i + WINDOW], digest_size=16).digest() for i in range(len(ctx) - WINDOW + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([cid] * len(digests), pa.binary()), pa.array([n] * len(digests), pa.int64()), pa.array([off - i for i in range(len(digests))], pa.int32())], ["w", "cid", "n", "left"])

    each = distinct.join(hot, "h", "left_semi").select("cid", "n", "off", "ctx").mapInArrow(windows, "w binary, cid binary, n long, left int")
    twice = stored(each.groupBy("w").agg(F.sum("n").alias("all")).where("all > 1").select("w"), "hot-windows")
    found = found.union(each.join(twice, "w", "left_semi").select("cid", F.col("left").alias("least"), F.col("left").alias("most")))
    spans = places.select("th", "s", "tail", "cid", "off").join(found.distinct(), "cid").select("th", (F.col("s") + F.col("off") - F.col("most")).alias("a"), (F.col("s") + F.col("off") - F.col("least") + WINDOW + F.col("tail")).alias("b"))
    by_text = spans.groupBy("th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    cut = suspects.where("n = 1").select("th", "z").join(by_text, "th")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = d.decompress(batch.column(1)[i].as_py())
                kept, at, gone, runs = hashlib.sha256(), 0, 0, 0
                for r in sorted(batch.column(2)[i].as_py(), key=lambda r: r["a"]):
                    if r["a"] > at or not runs:
                        kept.update(data[at:r["a"]])
                        runs, start = runs + 1, r["a"]
                    else:
                        start = at
                    gone += max(0, r["b"] - start)
                    at = max(at, r["b"])
                kept.update(data[at:])
                out.append((gone, runs, kept.hexdigest()))
            g, r, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.string())], ["th", "gone", "runs", "left_sha"])

    whole = suspects.where("n > 1").select("th", F.lit(True).alias("copied"))
    ready = cut.select("th", "z", "spans").mapInArrow(keep, "th binary, gone long, runs long, left_sha string")
    changes = stored(ready.withColumn("copied", F.lit(False)).unionByName(whole, allowMissingColumns=True), "repeat-changes")
    joined = facts.join(changes, "th", "left")
    return joined.select(
        "doc_id", "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )


def op9_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return removed(table_of(spark, sf_dir, "documents").select("doc_id", "text"))
