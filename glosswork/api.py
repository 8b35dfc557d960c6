"""The engine from Python: a session collects phrases over pages and evaluates them together."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import literal_pattern, mode_of, normalize_chars, page_text, parse_color, rarest_word, tokens
from .operators import layout, search
from .sources import pages as src


class SelectionMode(str, Enum):
    """What is kept where a phrase matches more than once in a document."""

    SINGLE = "single"
    BEST = "best"
    ALL = "all"


class MultipleMatchesError(RuntimeError):
    """A phrase of mode single matches more than once."""


@dataclass(frozen=True)
class Phrase:
    """One phrase with its options. regex and literal_whitespace only count where progressive is off."""

    text: str
    progressive: bool = True
    regex: bool = False
    literal_whitespace: bool = False
    ignore_case: bool = True
    kmax: int = 3
    max_gap: int = 200
    min_words: int = 3
    mode: str = "best"
    color: str = "yellow"
    opacity: float = 0.3
    label: str | None = None
    skipped: bool = False
    allow_multiple: bool | None = None
    select_shortest: bool | None = None


@dataclass(frozen=True)
class Session:
    """pages: doc_id, page_index and text, or text_norm and char_map (layout.page_maps). Immutable; nothing runs before
    a result is asked for, and a result evaluates all phrases in one search of each kind. Without a save a session is a
    dry run. subwords: how phrases are cut (functions.subwords.tokenizer), none for white space."""

    pages: DataFrame
    phrases: tuple[Phrase, ...] = ()
    subwords: Callable[[str], list[str]] | None = None

    def where(self, condition: Column | str) -> Session:
        """Only pages that meet a condition; it reaches the scan."""
        return replace(self, pages=self.pages.where(condition))

    def find(self, text: str, **options) -> Session:
        phrase = Phrase(text, **options)
        mode = phrase.mode.value if isinstance(phrase.mode, SelectionMode) else phrase.mode
        return replace(self, phrases=(*self.phrases, replace(phrase, mode=mode_of(mode))))

    def find_all(self, recipe: DataFrame) -> Session:
        """All items of a recipe with defaults (sources.pages.with_defaults), in their order, skipped ones too."""
        items = [r.asDict() for r in recipe.orderBy("query_id").collect()]
        return reduce(lambda s, item: s.find(**{k: "" if k == "text" and v is None else v for k, v in item.items() if k != "query_id"}), items, self)

    @property
    def _mapped(self) -> bool:
        return "char_map" in self.pages.columns

    def _normal(self) -> DataFrame:
        text = F.col("text_norm") if self._mapped else page_text(F.col("text"))
        return self.pages.select("doc_id", "page_index", text.alias("text_norm"))

    def queries(self) -> DataFrame:
        """The phrases as one table. It is folded from a literal, so that Spark knows its size."""
        if not self.phrases:
            raise ValueError("no phrases")
        rows = json.dumps([{"query_id": i, **asdict(p)} for i, p in enumerate(self.phrases)])
        spark = self.pages.sparkSession
        kind = "array<struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in src.ITEM.split(",")) + ">>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))

    def ranges(self) -> DataFrame:
        """Every range found: query_id, doc_id, page_index, start, end, place (in its query and document, the kept one
        of mode best first), n (ranges there), kept, and the query's mode, progressive, color, opacity and label."""
        queries, pages, found = self.queries().where("not skipped and text <> ''"), self._normal(), []
        columns = ["query_id", "doc_id", "page_index", "start", "end", "seq", "score"]
        live = [p for p in self.phrases if not p.skipped and p.text]
        if any(p.progressive for p in live):
            asked = queries.where("progressive").select("query_id", "text", *search.OPTIONS)
            found.append(search.scored(search.progressive_candidates(pages, asked, subwords=self.subwords)).select(*columns))
        if not found or not all(p.progressive for p in live):
            asked = queries.where("not progressive")
            text, flag = F.col("text"), F.when(F.col("ignore_case"), "(?iu)").otherwise("")
            pattern = F.when(F.col("regex"), F.concat(flag, text)).otherwise(literal_pattern(text, F.col("literal_whitespace"), F.col("ignore_case")))
            word = F.when(~F.col("regex"), rarest_word(tokens(normalize_chars(text))))
            spans = search._pattern_spans(pages, asked.select("query_id", pattern.alias("pattern"), word.alias("word")), ["query_id"])
            found.append(spans.select(*columns[:5], F.col("start").alias("seq"), F.lit(0.0).alias("score")))
        table = reduce(DataFrame.unionByName, found).join(queries.select("query_id", "mode", "progressive", "color", "opacity", "label"), "query_id")
        at = Window.partitionBy("query_id", "doc_id")
        best = F.col("progressive") & (F.col("mode") == "best")
        length = F.col("end") - F.col("start")
        order = [F.when(best, F.col("score")).desc(), F.when(best, length), F.when(best, F.col("start")), "page_index", "seq"]
        placed = table.withColumns({"n": F.count(F.lit(1)).over(at), "place": F.row_number().over(at.orderBy(*order))})
        kept = F.when(F.col("mode") == "best", F.col("place") == 1).when(F.col("mode") == "single", F.col("n") == 1).otherwise(True)
        return placed.withColumn("kept", kept)

    def _rects(self, ranges: DataFrame) -> DataFrame:
        return layout.hit_rects(ranges, self.pages if self._mapped else layout.grid_lines(self.pages))

    def hits(self, snippets: bool = False) -> DataFrame:
        """The ranges that the phrases' modes keep, with rectangles; with their text if asked for."""
        found = self._rects(self.ranges().where("kept").drop("kept", "n"))
        if not snippets:
            return found
        return found.join(self._normal(), ["doc_id", "page_index"]).withColumn("text_snippet", F.expr("substring(text_norm, start + 1, `end` - start)")).drop("text_norm")

    def _outcomes_of(self, ranges: DataFrame) -> DataFrame:
        distinct = F.count_distinct(F.when(F.col("kept"), F.struct("page_index", "start", "end")))
        each = ranges.groupBy("query_id", "doc_id").agg(F.count_if("kept").alias("n"), distinct.alias("d"), (F.max("n") > 1).alias("many"))
        return search.summed(each, self.queries(), (F.col("mode") == "best") & ~F.col("progressive"), F.col("mode") == "single")

    def outcomes(self) -> DataFrame:
        """A row per phrase, found or not."""
        return self._outcomes_of(self.ranges())

    def totals(self) -> DataFrame:
        """A row per document: ranges kept and distinct ones of each phrase, over all phrases."""
        return search.session_totals(self.ranges().where("kept"))

    def items(self) -> DataFrame:
        """(query_id, item, exit_code): a JSON object for each phrase, with its hits."""
        ranges = self.ranges()
        hits = self._rects(ranges.where("kept")).withColumn("color", parse_color(F.col("color")))
        return src.report_items(self._outcomes_of(ranges), self.queries(), hits)

    def report(self, source: str = "pages", output: str | None = None, context: str | None = None) -> DataFrame:
        return src.report(self.items(), source, output, context)

    def single_report(self, source: str = "pages", output: str | None = None, dry_run: bool = True, context: str | None = None) -> DataFrame:
        """The report of a session of one phrase."""
        ranges = self.ranges()
        hits = self._rects(ranges.where("kept")).withColumn("color", parse_color(F.col("color")))
        return src.single_report(self._outcomes_of(ranges), source, output, self.phrases[0].mode, dry_run, hits, context)

    def save(self, path: str) -> dict:
        """Writes the highlights and returns the session's totals; refuses a path that exists or holds the pages."""
        clean = lambda p: re.sub("/+", "/", p.split(":", 1)[-1]).rstrip("/")
        if any(clean(f) == clean(path) or clean(f).startswith(clean(path) + "/") for f in self.pages.inputFiles()):
            raise RuntimeError("the pages can't be overwritten by their highlights")
        hits = self.hits()
        src.write_new(src.annotations(hits, F.col("color"), F.col("opacity"), F.col("label")), path)
        drawn = self.pages.sparkSession.read.parquet(path)
        sums = search.session_totals(drawn).agg(F.sum("segment_matches").alias("n"), F.sum("highlight_count").alias("d")).first()
        return {"segment_matches": sums.n or 0, "highlight_count": sums.d or 0, "not_found": not sums.n, "saved_path": path}


def highlight_text(pages: DataFrame, text: str, output: str | None = None, **options) -> dict:
    """One phrase at once: its outcome, and its highlights saved if an output is given, even if there are none.

    Mode single raises MultipleMatchesError where the phrase matches more than once.
    """
    session = Session(pages).find(text, **options)
    found = session.outcomes().first().asDict()
    if found["error"]:
        raise MultipleMatchesError(f"multiple matches found for '{text}'")
    return found | (session.save(output) if output else {"saved_path": None})
