"""Documents as files: read whole, opened by an extractor, and laid out as a glyph table.

An extractor is a function from a file's bytes to its pages, each (width, height, glyphs), a glyph being
(character, x0, y0, x1, y1). It runs in the workers, a file at a time. plain_text is one for text files; layout_of_pdf
needs the library fitz, where it is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Glyph = tuple[str, float, float, float, float]
Extractor = Callable[[bytes], Iterable[tuple[float, float, Iterable[Glyph]]]]
GLYPHS = "doc_id string, page_index int, width double, height double, pos long, c string, x0 double, y0 double, x1 double, y1 double, error string"
#: Glyphs handed on at a time.
PART = 100_000


def plain_text(data: bytes) -> Iterator[tuple[float, float, list[Glyph]]]:
    """Pages parted by form feeds, on a grid of 6 by 12."""
    for page in data.decode("utf-8", "replace").split("\f"):
        lines = page.splitlines()
        glyphs = [(c, 6.0 * x, 12.0 * y, 6.0 * x + 6.0, 12.0 * y + 12.0) for y, line in enumerate(lines) for x, c in enumerate(line)]
        yield 6.0 * max(map(len, lines), default=0), 12.0 * len(lines), glyphs


def layout_of_pdf(data: bytes) -> Iterator[tuple[float, float, list[Glyph]]]:
    """Characters and boxes of a PDF's pages, in the order of its blocks, lines and spans."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as document:
        for page in document:
            spans = (s for b in page.get_text("rawdict")["blocks"] for line in b.get("lines", ()) for s in line["spans"])
            yield page.rect.width, page.rect.height, [(x["c"], *x["bbox"]) for s in spans for x in s["chars"]]


def read_glyphs(spark: SparkSession, path: str, extractor: Extractor = plain_text, strict: bool = True) -> DataFrame:
    """The glyph table of the files under a path: doc_id is the file's path. A file that can't be opened is an error,
    or if not strict a row with that error and no glyph."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.string()), ("page_index", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("pos", pa.int64()), ("c", pa.string()), *((x, pa.float64()) for x in ("x0", "y0", "x1", "y1")), ("error", pa.string())])
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), kinds)], schema=kinds)
        for batch in batches:
            for name, content in zip(*batch.columns):
                rows, name = [], name.as_py()
                try:
                    for index, (width, height, glyphs) in enumerate(extractor(content.as_py())):
                        for pos, (c, *box) in enumerate(glyphs):
                            rows.append((name, index, width, height, pos, c, *box, None))
                        while len(rows) >= PART:
                            yield table(rows[:PART])
                            del rows[:PART]
                except Exception as e:
                    if strict:
                        raise RuntimeError(f"failed to open {name}: {e}") from e
                    rows.append((name, *[None] * 9, str(e)))
                if rows:
                    yield table(rows)

    return files.mapInArrow(run, GLYPHS)


def page_facts(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_index (from 0), page_number (from 1), width, height."""
    return glyphs.where("error is null").groupBy("doc_id", "page_index").agg(F.max("width").alias("width"), F.max("height").alias("height")).withColumn("page_number", F.col("page_index") + 1)
