"""Boxes, lines and maps of glyphs. A glyph table has doc_id, page_index, pos, c, x0, y0, x1, y1."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DASHES, DOUBLE_QUOTES, SINGLE_QUOTES, hyphen_cuts, normalize_chars, tenths

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
_RECT = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
#: How far below a hyphen the next glyph's top lies if a new line parts them.
NEW_LINE = 4.0


def line_rects(boxes: DataFrame, by: list[str], y_tol: float = 3.0) -> DataFrame:
    """One rectangle per line of boxes (by..., pos, x0, y0, x1, y1): a line ends where the top moves by over y_tol."""
    order = Window.partitionBy(*by).orderBy(tenths(F.col("y0")), "x0", "pos")
    marked = boxes.withColumn("new", (F.abs(F.col("y0") - F.lag("y0").over(order)) > y_tol).cast("int"))
    lines = marked.withColumn("line", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.groupBy(*by, "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def rects_of(boxes: Column, y_tol: float = 3.0) -> Column:
    """The same for an array of boxes: one rectangle per line, in one fold."""
    order = F.array_sort(F.transform(boxes, lambda b, i: F.struct(tenths(b.y0).alias("at"), b.x0.alias("x"), i.alias("i"), b.alias("b"))))
    whole = lambda a, b: F.struct(F.least(a.x0, b.x0).alias("x0"), F.least(a.y0, b.y0).alias("y0"), F.greatest(a.x1, b.x1).alias("x1"), F.greatest(a.y1, b.y1).alias("y1"))
    none = F.lit(None).cast(RECT)
    start = F.struct(F.lit(None).cast("double").alias("top"), none.alias("line"), F.array().cast(f"array<{RECT}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = F.coalesce(F.abs(x.b.y0 - a.top) > y_tol, F.lit(True))
        out = F.when(new & a.line.isNotNull(), F.concat(a.out, F.array(a.line))).otherwise(a.out)
        return F.struct(x.b.y0.alias("top"), F.when(new, x.b).otherwise(whole(a.line, x.b)).cast(RECT).alias("line"), out.alias("out"))

    return F.aggregate(order, start, step, lambda a: F.when(a.line.isNull(), a.out).otherwise(F.concat(a.out, F.array(a.line))))


def glyph_grid(pages: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """Glyphs of a plain text on a grid, 6 by 12 a character: key, pos, c, x0, y0, x1, y1."""
    keys = [key] if isinstance(key, str) else key
    lines = pages.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("row", "line"))
    chars = lines.select(*keys, "row", F.posexplode(F.split("line", "")).alias("col", "c")).where("c <> ''")
    x, y = F.col("col") * 6.0, F.col("row") * 12.0
    return chars.select(*keys, (F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")).alias("pos"), "c", x.alias("x0"), y.alias("y0"), (x + 6.0).alias("x1"), (y + 12.0).alias("y1"))


def text_of(glyphs: DataFrame, key: str) -> DataFrame:
    """The text of a page's glyphs in order, without anything between lines."""
    listed = glyphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("g"))
    return listed.select(key, F.array_join("g.c", "").alias("text"))


@lru_cache(65536)
def normal_char(c: str) -> str:
    """What a glyph's character stands for: several characters for a ligature, none for a soft hyphen."""
    out = ""
    for x in unicodedata.normalize("NFKC", c):
        if x != "­":
            out += " " if x.isspace() else "-" if x in DASHES else "'" if x in SINGLE_QUOTES else '"' if x in DOUBLE_QUOTES else x
    return out


def kept_by_joining(text: str, tops: list[float] | None = None) -> list[int]:
    """Places of the characters that stay when words cut by a hyphen are joined.

    A hyphen goes, with the spaces after it, if it stands between letters (spaces aside) in a word without another
    hyphen so far, and a space follows it, or the next character's top lies on a new line.
    """
    if "-" not in text:
        return list(range(len(text)))
    kept: list[int] = []
    at, letter, hyphened, parted = 0, False, False, True  # of the last character but spaces, and its word
    while at < len(text):
        c = text[at]
        if c == "-" and letter and not hyphened and at + 1 < len(text):
            after = at + 1
            while after < len(text) and text[after] == " ":
                after += 1
            broken = after > at + 1 or (tops is not None and tops[at + 1] - tops[at] > NEW_LINE)
            if broken and after < len(text) and text[after].isalpha():
                at = after
                continue
        kept.append(at)
        if c == " ":
            parted = True
        else:
            hyphened = c == "-" or (hyphened and not parted)
            letter, parted = c.isalpha(), False
        at += 1
    return kept


def page_maps(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_index, text_norm, char_map): a page's text as it is searched, with one box for each character.

    Glyphs without a character or a box are left out; one that stands for several characters gives its box to each.
    Words cut at line ends are joined, by the boxes where no space tells. A page, not a document, is one record.
    """
    usable = glyphs.where("c is not null and c <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    listed = usable.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "x0", "y0", "x1", "y1"))).alias("g"))
    kinds = dict(glyphs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g = batch.column(2)[row].values
                forms = [normal_char(c) for c in g.field("c").to_pylist()]
                text = "".join(forms)
                source = [i for i, f in enumerate(forms) for _ in f]
                tops = g.field("y0").to_pylist()
                kept = kept_by_joining(text, [tops[i] for i in source])
                boxes = pa.StructArray.from_arrays([g.field(c).take(pa.array([source[k] for k in kept], pa.int64())) for c in ("x0", "y0", "x1", "y1")], ["x0", "y0", "x1", "y1"])
                maps = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), boxes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array(["".join(text[k] for k in kept)]), maps], ["doc_id", "page_index", "text_norm", "char_map"])

    return listed.mapInArrow(run, f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, text_norm string, char_map array<{RECT}>")


def grid_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_maps of the glyph_grid of plain pages (doc_id, page_index, text), each row a page, without a table of glyphs."""
    for batch in batches:
        rows, texts, sizes, columns, lines = [], [], [], [], []

        def table():
            x, y = np.concatenate(columns) * 6.0, np.concatenate(lines) * 12.0
            boxes = pa.StructArray.from_arrays([pa.array(v) for v in (x, y, x + 6.0, y + 12.0)], ["x0", "y0", "x1", "y1"])
            maps = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), boxes)
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(texts, pa.string()), maps], ["doc_id", "page_index", "text_norm", "char_map"])

        for row in range(batch.num_rows):
            parts = (batch.column(2)[row].as_py() or "").split("\n")
            chars = "".join(parts)
            if not chars:
                continue
            forms = [normal_char(c) for c in chars]
            text = "".join(forms)
            source = np.repeat(np.arange(len(chars)), np.fromiter(map(len, forms), np.int64, len(forms)))
            widths = np.array([len(p) for p in parts])
            line = np.repeat(np.arange(len(parts)), widths)
            column = np.arange(len(chars)) - np.repeat(np.cumsum(widths) - widths, widths)
            kept = kept_by_joining(text, (line[source] * 12.0).tolist())
            source = source[kept]
            rows.append(row), texts.append(text if len(kept) == len(text) else "".join([text[k] for k in kept])), sizes.append(len(kept)), columns.append(column[source]), lines.append(line[source])
            if sum(sizes[-100:]) > 100_000 or len(rows) >= 400:
                yield table()
                rows, texts, sizes, columns, lines = [], [], [], [], []
        if rows:
            yield table()


def grid_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, text_lines, cuts) of plain pages (text), for hit_rects."""
    lined = pages.select("doc_id", "page_index", normalize_chars(F.col("text"), keep_lines=True).alias("text_lines"))
    return lined.select("*", hyphen_cuts(F.replace(F.col("text_lines"), F.lit("\n"), F.lit(" "))).alias("cuts"))


def hit_rects(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """hits with rects, one rectangle a line that a range (start, end) covers.

    pages has a char_map, whose boxes are taken; or (doc_id, page_index, text_lines, cuts), the normal form with line
    feeds in place of the spaces for them and what joining hyphens took out of it, for the grid of 6 by 12.
    """
    at = ["doc_id", "page_index"]
    if "char_map" in pages.columns:
        joined = hits.join(pages.select(*at, "char_map"), at)
        covered = F.slice("char_map", F.col("start") + 1, F.greatest(F.lit(0), F.col("end") - F.col("start")))
        return joined.withColumn("rects", rects_of(covered)).drop("char_map")
    back = lambda place: place + F.aggregate(F.filter("cuts", lambda c: c.at <= place), F.lit(0), lambda n, c: n + c.n)
    joined = hits.join(pages.select(*at, "text_lines", "cuts"), at)
    joined = joined.withColumns({"grid_start": back(F.col("start")), "grid_end": back(F.col("end") - 1) + 1})
    before = F.expr("substring(text_lines, 1, grid_start)")
    row = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    column = F.length(F.substring_index(before, "\n", -1))
    parts = F.split(F.expr("substring(text_lines, grid_start + 1, grid_end - grid_start)"), "\n", -1)
    joined = joined.withColumns({"grid_row": row, "grid_column": column})

    def rect(part: Column, i: Column) -> Column:
        x = F.when(i == 0, F.col("grid_column")).otherwise(0) * 6.0
        y = (F.col("grid_row") + i) * 12.0
        return F.struct(x.alias("x0"), y.alias("y0"), (x + F.length(part) * 6.0).alias("x1"), (y + 12.0).alias("y1"))

    rects = F.filter(F.transform(parts, rect), lambda r: r.x1 > r.x0)
    return joined.withColumn("rects", rects).drop("text_lines", "cuts", "grid_start", "grid_end", "grid_row", "grid_column")
