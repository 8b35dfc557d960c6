"""Byte-level BPE encoding and decoding.

A text is split by the pattern; each match is encoded on its own. Matches are put into buckets by
their length in bytes, each bucket being a padded numpy matrix with a row for each match. A round
looks all adjacent pairs up in a hash table, merges each row's leftmost pair of least rank, and
compacts rows and columns. Unless the new token would form a pair of its own rank or less with a
neighbour, the round also merges the row's later pairs of the same rank that don't overlap, since these
would be the very next rounds. Else it merges one.

A text is cut where a space follows a character that isn't white space. No match crosses such a cut
and no lookahead sees past it, so each stretch between cuts is encoded once and its ids are remembered by its text.
What is remembered is bounded. This holds for the default pattern; by any other, texts are encoded whole.

Decoding starts from a document's ids alone: their tokens lie one after another in one array of bytes, from
which a gather by starts and lengths takes all bytes of many documents at once.

Defined results: a null or empty text has no ids, and the digests of the empty string. Decoding gives
back the UTF-8 bytes of every text exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, held, slices, table_of, whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Cells of a matrix.
CELLS = 1 << 20
NONE = np.int32(2**31 - 1)
_SPACE_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open addressing over pairs of ids: rank of the merged token, or NONE."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        self.rising = np.ones(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
                    self.rising[[x for x in (a, b) if rank <= x]] = False
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        left = np.fromiter(pairs.keys(), np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]  # of those with one slot the last stays
            placed = self.keys[slot] == left
            self.values[slot[placed]] = value[placed]
            left, value, slot = left[~placed], value[~placed], (slot[~placed] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those with a negative part have none."""
        out = np.full(a.shape, NONE, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a.ravel()[at].astype(np.int64) << 32 | b.ravel()[at].astype(np.int64)
        slot, flat = self._slot(keys), out.ravel()
        while len(at):
            here = self.keys[slot]
            hit = here == keys
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (here != -1)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(a.shape)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct match."""
        out: dict[bytes, list[int]] = {}
        buckets: dict[int, list[bytes]] = {}
        for piece in set(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[piece] = [whole]
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for power, rows in buckets.items():
            step = max(1, CELLS >> power)
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                out.update(zip(part, self._merge(part)))
        return out

    def _merge(self, rows: list[bytes]) -> list[list[int]]:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), int(lengths.max())), -1, np.int32)
        ids[np.arange(ids.shape[1]) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        result: list[list[int]] = [[]] * len(rows)
        where = np.arange(len(rows))

        def finish(which):
            for k, row, n in zip(where[which].tolist(), ids[which].tolist(), (ids[which] >= 0).sum(axis=1).tolist()):
                result[k] = row[:n]

        while True:
            if ids.shape[1] < 2:
                finish(slice(None))
                return result
            ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
            least = ranks.min(axis=1)
            done = least == NONE
            if done.any():
                finish(done)
                ids, ranks, least, where = ids[~done], ranks[~done], least[~done], where[~done]
                if not len(where):
                    return result
            picked = ranks == least[:, None]
            column = np.arange(picked.shape[1])
            begins = picked.copy()
            begins[:, 1:] &= ~picked[:, :-1]
            run = np.maximum.accumulate(np.where(begins, column, 0), axis=1)
            one = column == picked.argmax(axis=1)[:, None]
            picked &= (column - run) % 2 == 0  # of neighbours that overlap every other one, from the left
            if not self.pairs.rising[least].all():
                picked = np.where(self._early(ids, picked, least)[:, None], one, picked)
            row, at = np.nonzero(picked)
            ids[row, at] = least[row]
            ids[row, at + 1] = -1
            keep = ids >= 0
            count = keep.sum(axis=1)
            packed = np.full((len(ids), int(count.max())), -1, np.int32)
            packed[np.arange(packed.shape[1]) < count[:, None]] = ids[keep]
            ids = packed

    def _early(self, ids: np.ndarray, picked: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Rows in which a merged token would at some time form a pair of its own rank or less."""
        row, at = np.nonzero(picked)
        wide = np.pad(ids, ((0, 0), (1, 1)), constant_values=-1)
        new = least[row]
        soon = np.minimum.reduce([self.pairs.find(wide[row, at], new), self.pairs.find(new, wide[row, at + 3]), self.pairs.find(new, new)])
        out = np.zeros(len(ids), bool)
        out[row[soon <= new]] = True
        return out

    def encode(self, text: str) -> list[int]:
        pieces = [m.encode() for m in self.split(text)]
        known = self.encode_pieces(pieces)
        return [i for p in pieces for i in known[p]]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_many(ids, [len(ids)])[0]

    def decode_many(self, ids: np.ndarray, counts: list[int]) -> list[bytes]:
        """The bytes of documents whose ids stand one after another, so many each."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[ids] - ends + sizes, sizes)
        at += np.arange(len(at))
        raw = self.bytes[at].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])].tolist()
        return [raw[a:b] for a, b in zip(stops, stops[1:])]


def stretches(text: str) -> list[str]:
    """The text cut before each space after a non-space; all but the first without that space."""
    if _SPACE_RUN.search(text):
        first, *rest = _CUT.split(text)
        return [first, *(x[1:] for x in rest)]
    return text.split(" ")


class Memo:
    """Ids by stretch, as decimal text and as 32-bit numbers of this machine: of first stretches, and of those led by a space."""

    def __init__(self, bpe: ByteBPE, cuts: bool = True):
        self.bpe, self.cut = bpe, stretches if cuts else lambda text: [text]
        self.first, self.others = Remembered(50_000), Remembered(400_000)

    def learn(self, firsts: set[str], others: set[str]) -> None:
        new = [(self.first, x, x) for x in self.first.missing(firsts)] + [(self.others, x, " " + x) for x in self.others.missing(others)]
        split = [[m.encode() for m in self.bpe.split(text)] for _, _, text in new]
        known = self.bpe.encode_pieces(chain.from_iterable(split))
        for (memory, x, _), pieces in zip(new, split):
            ids = list(chain.from_iterable(map(known.__getitem__, pieces)))
            memory[x] = ",".join(map(str, ids)), array("i", ids).tobytes()

    def ids(self, parts: list[str]) -> tuple[str, bytes]:
        """(decimal ids joined by commas, the ids) of a text cut into stretches that are known."""
        found = [self.first[parts[0]]] if parts[0] else []
        found += map(self.others.__getitem__, parts[1:])
        listed, raw = zip(*found) if found else ((), ())
        return ",".join(listed), b"".join(raw)

    def encode_many(self, texts: list[str]) -> list[tuple[str, bytes]]:
        cut = [self.cut(x) for x in texts]
        self.learn({c[0] for c in cut if c[0]}, set(chain.from_iterable(c[1:] for c in cut)))
        return [self.ids(parts) for parts in cut]


def loaded(path: str, pattern: str) -> Memo:
    """One per worker process."""
    return held((Memo, path, pattern), lambda: Memo(ByteBPE(load_ranks(path), pattern), pattern == public_tokenizers.PATTERN))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Digests of each text's ids and of what they decode to; a map over the scan, no shuffle."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = loaded(path, pattern)
        for batch in batches:
            for start, texts in slices(batch):
                known = memo.encode_many(texts)
                counts = [len(raw) // 4 for _, raw in known]
                decoded = memo.bpe.decode_many(np.frombuffer(b"".join(raw for _, raw in known), np.int32), counts)
                sums = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in ((listed.encode() for listed, _ in known), decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(counts, pa.int64()), *map(pa.array, sums)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, SCHEMA)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return encode_decode(table_of(spark, sf_dir, "documents"))
