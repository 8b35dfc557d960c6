"""Media columns: interleaved document sequences.

HTML is parsed into one ordered list of structs, text runs and media references by turns. A media
store holds each payload under the digest of its bytes; a join on the digest resolves references, and
position and caption stay with the reference they were parsed with.

Elements that pages leave open end where their kind allows: a head at the first element of a body, a caption at the next
block or the figure's end; a template or noscript without an end tag hides nothing. The caption of a figure without
media is text.

Defined results: null HTML gives an empty sequence; a reference without a stored payload keeps its
place with null payload columns; repeated references each get the payload; equal payloads, under any
number of documents, are one digest. A null or empty text is stored as one blank row of 192 bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table_of, whole_text

#: A picture row: 64 pixels of three 8-bit samples.
WIDTH, ROW_BYTES = 64, 192
SCHEME = "media:sha256:"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
#: HTML elements whose text is no prose, and those that end a run of text (fixed values).
SILENT = {"script", "style", "template", "noscript", "title"}
BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "blockquote", "pre", "figure", "br", "hr", "nav", "header", "footer", "main", "aside", "body", "html"}
MEDIA = {"img", "video", "audio", "source", "embed"}


_END = re.compile(r"</\s*(template|noscript|figcaption)\b", re.I)


class _Sequencer(HTMLParser):
    """Collects text runs and media references in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._run: list[str] = []
        self._ends = Counter(m[1].lower() for m in _END.finditer(html))  # end tags to come
        self._silent: list[str] = []
        self._head = False
        self._caption: list[str] | None = None
        self._figure_from: int | None = None

    def _flush(self):
        text = " ".join("".join(self._run).split())
        self._run.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def _end_caption(self):
        if self._caption is None:
            return
        caption, self._caption = " ".join("".join(self._caption).split()), None
        media = [x for x in self.items[self._figure_from or 0:] if x["kind"] == "media"]
        for item in media:
            if caption:
                item["caption"] = caption
        if caption and not media:
            self.items.append({"kind": "text", "text": caption, "digest": None, "caption": None})

    def end(self):
        """What is open at the end of the page."""
        self.close()
        self._end_caption()
        self._flush()

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            if tag not in ("template", "noscript") or self._ends[tag] > self._silent.count(tag):
                self._silent.append(tag)
        elif tag == "head":
            self._head = True
        elif tag in BLOCKS or tag in MEDIA:
            self._head = False
        if tag in BLOCKS:
            if not self._ends["figcaption"]:
                self._end_caption()
            self._flush()
        if tag == "figure":
            self._figure_from = len(self.items)
        elif tag == "figcaption":
            self._flush()
            self._caption = []
        elif tag in MEDIA and not self._silent:
            found = dict(attrs)
            if source := found.get("src"):
                self._flush()
                digest = source[len(SCHEME):] if source.startswith(SCHEME) else None
                self.items.append({"kind": "media", "text": None if digest else source, "digest": digest, "caption": found.get("alt") or None})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self._silent and self._silent[-1] == tag:
            self._silent.pop()

    def handle_endtag(self, tag):
        if tag in self._ends:
            self._ends[tag] -= 1
        if tag in SILENT:
            if tag in self._silent:
                del self._silent[len(self._silent) - 1 - self._silent[::-1].index(tag)]
        elif tag == "head":
            self._head = False
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure":
            self._end_caption()
            self._figure_from = None
        if tag in BLOCKS:
            if self._caption is not None and not self._ends["figcaption"]:
                self._end_caption()
            self._flush()

    def handle_data(self, data):
        if not self._silent and not self._head:
            (self._run if self._caption is None else self._caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """The ordered structs of one page. A figure's caption goes to every reference inside the figure."""
    parser = _Sequencer(html or "")
    parser.feed(html or "")
    parser.end()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, sequence): each page's text runs and media references in order."""
    source = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    kind = source.schema["key"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.list_(_ITEM)
        for batch in batches:
            found = [sequence_of(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, out)], ["key", "sequence"])

    return source.mapInArrow(parse, f"key {kind}, sequence {SEQUENCE}").withColumnRenamed("key", key)


def resolve(sequences: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """One row per sequence item, in place, with the store's columns for its digest (left join on the digest). The columns
    of an item win over columns of the store with the same names.

    The store has one row per digest. A digest that a third of all rows refer to is a skewed join key
    with one row on the store's side, which adaptive execution splits on the references' side.
    """
    items = sequences.select(key, F.inline("sequence"))
    others = [c for c in store.columns if c == "digest" or c not in items.columns]
    return items.join(store.select(*others).dropDuplicates(["digest"]), "digest", "left")


def payload_column(text=None):
    """UTF-8 bytes with spaces up to a positive multiple of 192."""
    text = whole_text() if text is None else text
    n = F.octet_length(text)
    rows = F.greatest(F.lit(1), F.ceil(n / ROW_BYTES).cast("int"))
    return F.encode(F.concat(text, F.repeat(F.lit(" "), (rows * ROW_BYTES - n).cast("int"))), "UTF-8")


def picture_column(payload):
    """A binary PPM picture (P6, 64 pixels wide, 8-bit samples) whose raster is the payload."""
    rows = (F.octet_length(payload) / ROW_BYTES).cast("int").cast("string")
    return F.concat(F.encode(F.concat(F.lit(f"P6\n{WIDTH} "), rows, F.lit("\n255\n")), "UTF-8"), payload)


def raster_of(media: bytes) -> bytes:
    """The samples of a stored picture; ValueError if the header and the raster don't agree."""
    magic, size, depth, raster = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P6" or depth != b"255" or len(raster) != width * height * 3:
        raise ValueError("not a stored picture")
    return raster


def feature_of(raster: bytes) -> str:
    """Channel means (1/1000), entropy of the samples (1/1000 bit) and a 64-bit average hash of an 8x8 grid."""
    samples = np.frombuffer(raster, np.uint8)
    means = samples.reshape(-1, 3).mean(axis=0, dtype=np.float64)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    entropy = float(-(share * np.log2(share)).sum())
    grid = samples.reshape(-1, 8, 24).sum(axis=2, dtype=np.int64)
    first = np.arange(8) * len(grid) // 8
    if len(grid) < 8:
        cells = grid[first]
    else:
        cells = np.add.reduceat(grid, first, axis=0) / np.diff([*first, len(grid)])[:, None]
    bits = (cells > cells.mean()).ravel()
    return f"{','.join(str(round(x * 1000)) for x in means)};{round(entropy * 1000)};{np.packbits(bits).tobytes().hex()}"


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_facts(store: DataFrame) -> DataFrame:
    """What is computed from the stored bytes, read back: one row per stored picture."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FACTS.split(", ")]
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = media.as_py()
                raster = raster_of(media)
                rows.append((digest, len(raster), hashlib.sha256(raster).hexdigest(), zlib.crc32(raster[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(raster)))
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("digest", "feature") or n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns)], names)

    return store.select("digest", "media").mapInArrow(read, FACTS)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page that refers to its text, stored as a picture under the digest of the payload.

    The store is written in the shared folder straight from the scan, so payloads are never shuffled;
    copies of a payload meet at the digest join, where only the computed facts travel.
    """
    docs = table_of(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    with_payload = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), payload_column(F.col("text")).alias("payload"))
    keyed = with_payload.select("doc_id", "n_bytes", F.sha2("payload", 256).alias("digest"), picture_column(F.col("payload")).alias("media"))
    store = stored(keyed, "media-store")
    caption = F.concat(F.lit("text of "), F.col("n_bytes").cast("string"), F.lit(" bytes"))
    html = F.concat(F.lit("<article><p>document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit(f'</p><figure><img src="{SCHEME}'), F.col("digest"), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))
    pages = store.select(F.struct("doc_id", "n_bytes").alias("page"), html.alias("html"))
    items = resolve(interleave(pages, "page"), "page", media_facts(store))
    return items.where("kind = 'media'").select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
