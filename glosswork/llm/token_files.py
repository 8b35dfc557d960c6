"""Token-ID output with fixed-width bit packing.

Each id takes as many bits as the vocabulary needs. A shard is a run of documents in ascending doc_id
order, cut into blocks of whole documents; a block holds its packed ids in one binary value beside
its documents' ids and the offsets at which they start, so a reader unpacks any range of a block with
numpy and reaches a document without touching the others. Blocks are rows of Parquet files, which
Spark's committer writes: a lost executor leaves no part of a file behind, and any store will do.

Defined results: a null or empty text is the end id alone; rows without doc_id come first, and rows with
equal doc_id follow one another by text; an empty table writes no blocks. Extra columns are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, held, shared_dir, slices, table_of, whole_text

VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: A block is closed at so many ids.
BLOCK_IDS = 1 << 18


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, `bits` bits each, least significant bit first."""
    n = len(ids)
    groups = np.zeros((-(-n // 8), 8), np.uint64)
    groups.reshape(-1)[:n] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = groups[:, j] << np.uint64(shift)
        for t in range(-(-(bits + shift) // 8)):
            out[:, byte + t] |= (value >> np.uint64(8 * t) & np.uint64(255)).astype(np.uint8)
    return out.reshape(-1)[: -(-n * bits // 8)].tobytes()


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of packed data; reads only the bytes that hold them."""
    first = start // 8 * 8
    n = max(0, stop - first)
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, np.uint8)
    part = np.frombuffer(data, np.uint8)[first // 8 * bits:][: groups * bits]
    raw[: len(part)] = part
    raw = raw.reshape(groups, bits).astype(np.uint64)
    out = np.zeros((groups, 8), np.uint64)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        for t in range(-(-(bits + shift) // 8)):
            out[:, j] |= raw[:, byte + t] << np.uint64(8 * t)
        out[:, j] = out[:, j] >> np.uint64(shift) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[start - first:n].astype(np.uint32)


class WordEncoder:
    """Ids (little-endian 32-bit) by stretch of text, made by the tokenizer's library.

    The vocabulary drops white space and its words never cross it, nor a step from a letter or digit to a full
    stop or comma, so stretches between these can be encoded alone. ASCII texts are lower-cased first, as
    the vocabulary does itself. New stretches go to the library together: those of Latin letters only are
    one word each, whose last id ends a word; the others are parted by a sign whose id nothing else yields,
    and stretches that hold the sign go one by one. So do, as they hold it, those in which one of the vocabulary's
    special tokens is spelt out, which the library takes for that token; no such token holds white space, a full stop or
    a comma, so none is cut, and case is left to the library where a text may hold one.
    """

    SIGN = "|"
    _STOP = re.compile(r"[.,](?<=[^\W_][.,])")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = Remembered()
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # for stretches without the sign, which hold none: they needn't be looked for
        size = self.tokenizer.get_vocab_size()
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        if any(self.SIGN not in x or self._cut(x) != [x] for x in special):
            raise ValueError("the vocabulary has special tokens that stretches would cut")
        self.opening = [x[:x.index(self.SIGN) + 1].lower() for x in special]
        self.bits = max(1, (size - 1).bit_length())
        self.sign_id = self.tokenizer.encode(self.SIGN, add_special_tokens=False).ids[0]
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _together(self, stretches: list[str], between: str) -> np.ndarray:
        joined = [between.join(stretches[i:i + 100]) + between for i in range(0, len(stretches), 100)]
        return np.concatenate([np.array(x.ids, "<u4") for x in self.plain.encode_batch_fast(joined, add_special_tokens=False)])

    def learn(self, stretches: set[str]) -> None:
        new = self.known.missing(stretches)
        words = [x for x in new if x.isalpha() and (x.isascii() or max(x) < "\u0100")]
        if words:
            ids = self._together(words, " ")
            self._keep(words, ids, np.flatnonzero(self.ends[ids]) + 1, 0)
        rest = list(set(new).difference(words))
        parted = [x for x in rest if self.SIGN not in x]
        if parted:
            ids = self._together(parted, f" {self.SIGN} ")
            self._keep(parted, ids, np.flatnonzero(ids == self.sign_id), 1)
        for x in rest:
            if self.SIGN in x:
                self.known[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()

    def _keep(self, stretches: list[str], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        raw, start = ids.tobytes(), 0
        for x, end in zip(stretches, ends.tolist(), strict=True):
            self.known[x] = raw[4 * start:4 * end]
            start = end + skip

    def _parted(self, text: str) -> str:
        return self._STOP.sub(r" \g<0>", text.replace("\n", " ").replace("\r", " ").replace("\t", " "))

    def _cut(self, text: str) -> list[str]:
        return self._parted(text).split(" ")

    def _lowered(self, text: str) -> str:
        lower = text.lower()
        return text if any(x in lower for x in self.opening) else lower

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Only different stretches become Python objects; a text's ids are put together from theirs, by number."""
        cut = pc.split_pattern(pa.array([self._parted(self._lowered(x) if x.isascii() else x) for x in texts], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        each, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.learn(set(each))
        raw = list(map(self.known.__getitem__, each))
        at = cut.offsets.to_pylist()
        return [b"".join(map(raw.__getitem__, which[a:b].tolist())) for a, b in zip(at, at[1:])]


def loaded(path: str) -> WordEncoder:
    """One per worker process, whose library stays in one thread: each core has a worker of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held((WordEncoder, path), lambda: WordEncoder(path))


BLOCK = "shard long, block long, before long, bits int, n_ids long, doc_ids array<long>, offsets array<long>, packed binary"
_BLOCK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("packed", pa.binary())])


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every text and writes its ids, ended by end_id, in ascending doc_id order.

    The order comes from one range exchange of (doc_id, text), in which rows of one doc_id, or of none, may be dealt
    by how their texts begin; a shard is one of its partitions. A block knows how many ids lie before it in its shard.
    """
    words = vocabulary or public_tokenizers.path(VOCABULARY)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number, before = loaded(words), TaskContext.get().partitionId(), 0, 0
        if not 0 <= end_id < 1 << encoder.bits:
            raise ValueError(f"the end id {end_id} takes more than {encoder.bits} bits")
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, parts, offsets = [], [], [0]

        def close():
            nonlocal number, before
            packed = pack(np.frombuffer(b"".join(parts), "<u4"), encoder.bits)
            row = [shard, number, before, encoder.bits, offsets[-1], list(doc_ids), list(offsets), packed]
            number, before = number + 1, before + offsets[-1]
            doc_ids.clear(), parts.clear()
            offsets[:] = [0]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, texts in slices(batch):
                for key, ids in zip(keys[start:], encoder.encode(texts)):
                    doc_ids.append(key)
                    parts += ids, end
                    offsets.append(offsets[-1] + len(ids) // 4 + 1)
                    if offsets[-1] >= BLOCK_IDS:
                        yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(blocks, BLOCK).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a folder of token files, each with `base`: how many ids lie before it.

    Blocks are read where they are; what is broadcast is one total for each shard, of which there are no more than the
    writing exchange has partitions. Their sums in shard order are taken in one task.
    """
    files = spark.read.schema(BLOCK).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("shard_base"))
    return files.join(F.broadcast(shards), "shard").withColumn("base", F.col("shard_base") + F.col("before")).drop("shard_base")


FACTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def token_facts(blocks: DataFrame) -> DataFrame:
    """Per document what its packed ids hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bits, doc_ids, offsets, packed, base = (batch.column(i)[row].as_py() for i in range(5))
                ids = unpack(packed, bits, 0, offsets[-1]).astype("<u4").tobytes()
                sums = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(offsets, offsets[1:])]
                at = np.array(offsets, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("bits", "doc_ids", "offsets", "packed", "base").mapInArrow(read, FACTS)


def document_ids(block: dict, k: int) -> np.ndarray:
    """Random access: the ids of the k-th document of one block row, unpacking no others."""
    return unpack(block["packed"], block["bits"], block["offsets"][k], block["offsets"][k + 1])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, written and read back."""
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table_of(spark, sf_dir, "documents"), path)
    return token_facts(read_tokens(spark, path))
