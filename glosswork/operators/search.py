"""Search: queries against pages. Pages have (doc_id, page_index, text_norm), queries (query_id, text)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_pattern, folded, literal_pattern, normalize_chars, query_tokens, rarest_word, running, tokens
from . import lexicon
from .chains import Chains, fits, odd
from .phrases import Page, Phrase

#: Characters of query words that go to the workers with one pass over the pages.
BLOCK_CHARS = 4_000_000
#: Candidates that a worker holds before it hands them on, and characters of pages that it searches together.
HELD, SLICE = 50_000, 250_000
SEGMENTS = "array<struct<s:int,e:int,k:int>>"
OPTIONS = {"kmax": 3, "ignore_case": True, "max_gap": 200, "min_words": 3}


def spread(pages: DataFrame) -> DataFrame:
    """Pages over all cores, if their files give fewer partitions than there are cores."""
    if pages.isStreaming:
        return pages
    cores = pages.sparkSession.sparkContext.defaultParallelism
    parts = pages._jdf.queryExecution().toRdd().getNumPartitions()
    return pages.repartition(cores, "doc_id", "page_index") if parts < cores else pages


def _pattern_spans(pages: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Every match of patterns (keys, pattern, word) in pages, whose text must hold the word, if any.

    The word is looked for first, without a pattern; whether patterns are broadcast is left to Spark's check of their size.
    """
    shaped = spread(pages).withColumn("shape", folded(F.col("text_norm")))
    there = F.coalesce(F.contains("shape", F.col("word")), F.lit(True)) & F.expr("regexp_like(text_norm, pattern)")
    hit = shaped.join(patterns.where("pattern not in ('', '(?iu)')"), there)
    spans = hit.select(*keys, "doc_id", "page_index", F.inline_outer(match_spans("text_norm", "pattern")))
    return spans.where("start is not null")


def literal_matches(pages: DataFrame, queries: DataFrame, literal_whitespace: bool = False, ignore_case: bool = True, many: bool = False, through=None) -> DataFrame:
    """Every match: query_id, doc_id, page_index, start, end (code points), in a map over pages.

    Offsets come from the lengths of the parts between matches and of the matches. many: queries are looked up by the
    words of a page, in place of a comparison of each with each page; if pages have a char_map, matches have rects.
    through: see lexicon.spans.
    """
    text = F.col("text")
    if many and not literal_whitespace:
        return lexicon.spans(spread(pages), _worded(queries), ["query_id"], ignore_case=ignore_case, through=through)
    patterns = queries.select("query_id", literal_pattern(text, literal_whitespace, ignore_case).alias("pattern"), rarest_word(tokens(normalize_chars(text))).alias("word"))
    return _pattern_spans(pages, patterns, ["query_id"])


def _worded(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", tokens(normalize_chars(F.col("text"))).alias("words"))


def ordered_literal_matches(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """ordered(literal_matches) for many queries: places are counted as a document's pages are gone through, once for all
    queries of the same words, so that matches are not sorted again."""
    if queries.groupBy("query_id").count().where("count > 1").limit(1).count():
        return ordered(literal_matches(pages, queries, many=True))
    no_nulls = pages.where("doc_id is null or page_index is null").isEmpty()
    if no_nulls:
        pages = pages.where("doc_id is not null and page_index is not null")  # so that it holds
    context = pages.sparkSession.sparkContext
    parts = max(4 * context.defaultParallelism, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = pages.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "page_index")
    return lexicon.spans(together, _worded(queries), ["query_id"], places=True, no_nulls=no_nulls)


def match_spans(text: str, pattern: str) -> Column:
    """array<struct<start,end>> of all matches of a pattern column, from the lengths of matches and of the parts between."""
    gaps, found = F.split(text, F.col(pattern), -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.zip_with(F.transform(gaps, lambda g: F.length(g)), F.transform(found, lambda m: F.length(m)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    sizes = F.filter(sizes, lambda x: x.m.isNotNull())
    before = running(F.transform(sizes, lambda x: x.g + x.m))
    return F.zip_with(sizes, before, lambda x, b: F.struct((b + x.g).cast("int").alias("start"), (b + x.g + x.m).cast("int").alias("end")))


def regex_matches(pages: DataFrame, queries: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Every match of raw patterns (query_id, pattern); patterns should not match the empty string."""
    flag = "(?iu)" if ignore_case else ""
    patterns = queries.select("query_id", F.concat(F.lit(flag), "pattern").alias("pattern"), F.lit(None).cast("string").alias("word"))
    return _pattern_spans(pages, patterns, ["query_id"])


def starters(pages: DataFrame, queries: DataFrame, kmax: int = 3, ignore_case: bool = True, kmin: int = 1, many: bool = False) -> DataFrame:
    """Every match of a query's first k0 words, for k0 from kmax down to kmin: query_id, doc_id, page_index, k0, start, end.

    many: as in literal_matches; words that normalizing emptied or parted are searched by their pattern even so."""
    words = queries.select("query_id", query_tokens(F.col("text")).alias("words")).where(F.size("words") >= F.lit(max(1, kmin)))
    sized = words.select("query_id", "words", F.explode(F.sequence(F.lit(max(1, kmin)), F.least(F.lit(kmax), F.size("words")))).alias("k0"))
    if many and kmax <= 6:
        plain = F.forall(F.slice("words", F.lit(1), F.col("k0")), lambda w: (w != "") & ~F.contains(w, F.lit(" ")))
        looked_up = sized.where(plain).select("query_id", "k0", F.slice("words", F.lit(1), F.col("k0")).alias("words"))
        found = lexicon.spans(spread(pages), looked_up, ["query_id", "k0"], loose=True, ignore_case=ignore_case)
        sized = sized.where(~plain)
        if sized.isEmpty():
            return found
        return found.unionByName(_starters_by_pattern(pages, sized, ignore_case))
    return _starters_by_pattern(pages, sized, ignore_case)


def _starters_by_pattern(pages: DataFrame, sized: DataFrame, ignore_case: bool) -> DataFrame:
    pattern = F.concat(F.lit("(?iu)" if ignore_case else ""), chunk_pattern(F.col("words"), F.lit(0), F.col("k0")))
    patterns = sized.select("query_id", "k0", pattern.alias("pattern"), rarest_word(F.slice("words", F.lit(1), F.col("k0"))).alias("word"))
    return _pattern_spans(pages, patterns, ["query_id", "k0"])


def merged(segs: str) -> Column:
    """Segments that touch as one, their words added."""
    empty = F.expr(f"cast(array() as {SEGMENTS})")

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        grown = F.struct(last.s.alias("s"), x.e.alias("e"), (last.k + x.k).alias("k"))
        return F.when(last.e == x.s, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(segs, empty, step)


def first_segments(candidates: DataFrame) -> DataFrame:
    """Of each query and page the first candidate found, with touching segments merged."""
    first = candidates.groupBy("query_id", "doc_id", "page_index").agg(F.min_by("segs", "seq").alias("segs"))
    return first.select("query_id", "doc_id", "page_index", merged("segs").alias("segs"))


def chosen(matches: DataFrame, mode: str) -> DataFrame:
    """Literal matches under a mode: all; the first in page order and whether there are more (best, blocked); or all,
    with an error where there are several, of which none is to be kept (single)."""
    at = Window.partitionBy("query_id", "doc_id")
    many = F.count(F.lit(1)).over(at) > 1
    if mode == "best":
        first = F.min(F.struct("page_index", "start", "end")).alias("f")
        return matches.groupBy("query_id", "doc_id").agg(first, (F.count(F.lit(1)) > 1).alias("blocked")).select("query_id", "doc_id", "f.*", "blocked")
    if mode == "single":
        return matches.withColumn("error", F.when(many, "multiple_matches"))
    return matches


def ordered(matches: DataFrame) -> DataFrame:
    """Matches with their place in each query and document: by page; within it by discovery, which is the longest first
    k0 (where there is one) and then the offset."""
    within = [F.desc("k0")] if "k0" in matches.columns else [F.asc("seq")] if "seq" in matches.columns else []
    return matches.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("page_index", *within, "start", "end")))


def session_totals(matches: DataFrame) -> DataFrame:
    """A row per document: matches and distinct ranges of each query, over all queries."""
    one = matches.groupBy("doc_id", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_index", "start", "end").alias("d"))
    return one.groupBy("doc_id").agg(F.sum("n").alias("segment_matches"), F.sum("d").alias("highlight_count"))


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """(query_id, words, kmax, ignore_case, max_gap, min_words) in lists of about BLOCK_CHARS characters."""
    block, chars = [], 0
    for row in queries.toLocalIterator():
        block.append(tuple(row))
        chars += sum(map(len, row.words)) + 50
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def progressive_candidates(pages: DataFrame, queries: DataFrame, kmax: int = 3, ignore_case: bool = True, max_gap: int = 200, min_words: int = 3, subwords=None) -> DataFrame:
    """All candidates: query_id, doc_id, page_index, seq (order of discovery), segs, n_tokens, start, end.

    Queries may carry columns kmax, ignore_case, max_gap and min_words of their own. The set of queries is read by the
    driver, in blocks of a fixed size; a block goes to the workers once and meets every page in one pass, so a page's
    text is shipped once a block, and what is looked up in it is shared by all queries. Queries with fewer words than
    min_words can't match. subwords: a function from a text to its parts, in place of white space.
    """
    options = {"kmax": kmax, "ignore_case": ignore_case, "max_gap": max_gap, "min_words": min_words}
    asked = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in queries.columns else F.lit(v).alias(c) for c, v in options.items()]
    words = F.udf(subwords, "array<string>")(F.col("text")) if subwords else query_tokens(F.col("text"))
    listed = queries.select("query_id", words.alias("words"), *asked).where("size(words) >= greatest(1, min_words)")
    kinds = dict(pages.dtypes) | dict(queries.select("query_id").dtypes)
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, seq int, segs {SEGMENTS}, n_tokens int"
    source = spread(pages.select("doc_id", "page_index", "text_norm"))
    parts = [source.mapInArrow(_searcher(block, queries.schema["query_id"].dataType), schema) for block in _query_blocks(listed)]
    found = reduce(DataFrame.unionByName, parts) if parts else pages.sparkSession.createDataFrame([], schema)
    return found.withColumns({"start": F.element_at("segs", 1)["s"], "end": F.element_at("segs", -1)["e"]})


def _searcher(block: list[tuple], id_type):
    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [Phrase(list(words), kmax, case, gap, least) for _, words, kmax, case, gap, least in block]
        ids, n_tokens = pa.array([q[0] for q in block], id_kind), pa.array([len(p.words) for p in phrases], pa.int32())
        fit = [fits(p) for p in phrases]
        by_case = [[i for i, p in enumerate(phrases) if fit[i] and p.ignore_case == case] for case in (True, False)]
        chains = [(Chains([phrases[i] for i in those], case), np.array(those)) for those, case in zip(by_case, (True, False)) if those]
        most = min((c.together() for c, _ in chains), default=1)
        rest, every = ({}, {})  # of phrases, by first word: those that don't fit, and all
        for i, p in enumerate(phrases):
            for d in [every] if fit[i] else [every, rest]:
                d.setdefault((p.ignore_case, p.shapes[0] if p.plain else ""), []).append(i)

        def table(batch, who, rows, seqs, counts, flat):
            who, at = pa.array(who, pa.int64()), pa.array(rows, pa.int64())
            segs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["s", "e", "k"]))
            return pa.RecordBatch.from_arrays([ids.take(who), batch.column(0).take(at), batch.column(1).take(at), pa.array(seqs, pa.int32()), segs, n_tokens.take(who)], ["query_id", "doc_id", "page_index", "seq", "segs", "n_tokens"])

        def one_by_one(batch, row, text, asked):
            page = Page(text)
            who, seqs, counts, flat = [], [], [], []
            for (case, first), those in asked.items():
                if first not in page.form(case)[0]:
                    continue
                for i in those:
                    for seq, segments in enumerate(phrases[i].candidates(page)):
                        who.append(i), seqs.append(seq), counts.append(len(segments))
                        for x in segments:
                            flat.extend(x)
                        if len(who) >= HELD:
                            yield table(batch, who, [row] * len(who), seqs, counts, np.array(flat, np.int32).reshape(-1, 3).T.copy())
                            who, seqs, counts, flat = [], [], [], []
            if who:
                yield table(batch, who, [row] * len(who), seqs, counts, np.array(flat, np.int32).reshape(-1, 3).T.copy())

        def together(batch, rows, texts):
            rows = np.array(rows)
            for c, those in chains:
                for which, page, seq, counts, flat in c.search(texts):
                    ends = np.cumsum(counts)
                    for lo in range(0, len(which), HELD):
                        hi = min(lo + HELD, len(which))
                        part = [x[ends[lo] - counts[lo]:ends[hi - 1]] for x in flat]
                        yield table(batch, those[which[lo:hi]], rows[page[lo:hi]], seq[lo:hi], counts[lo:hi], part)

        for batch in batches:
            rows, texts, chars = [], [], 0
            for row, text in enumerate(batch.column(2).to_pylist()):
                if text is None:
                    continue
                usual = bool(chains) and not odd(text)
                asked = rest if usual else every
                if asked:
                    yield from one_by_one(batch, row, text, asked)
                if usual:
                    rows.append(row), texts.append(text)
                    chars += len(text)
                    if chars >= SLICE or len(rows) >= most:
                        yield from together(batch, rows, texts)
                        rows, texts, chars = [], [], 0
            if rows:
                yield from together(batch, rows, texts)

    return run


def scored(candidates: DataFrame) -> DataFrame:
    """2 word coverage + character coverage - gaps / 2 - length / 4 (of 800 at most), as a double."""
    length = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    total = lambda f: F.aggregate("segs", F.lit(0), f)
    gaps = F.aggregate("segs", F.struct(F.lit(0).alias("sum"), F.col("start").alias("at")), lambda a, x: F.struct((a.sum + F.greatest(F.lit(0), x.s - a.at)).alias("sum"), x.e.alias("at")), lambda a: a.sum)
    words, chars = total(lambda a, x: a + x.k), total(lambda a, x: a + x.e - x.s)
    score = 2.0 * (words / F.greatest(F.lit(1), F.col("n_tokens"))) + 1.0 * (chars / length) - 0.5 * (gaps / length) - 0.25 * F.least(F.lit(1.0), length / 800.0)
    return candidates.withColumns({"words": words, "score": score})


def select_best(candidates: DataFrame) -> DataFrame:
    """One winner for each query and document over all pages: score, then shortest, first start, first page."""
    rank = F.struct("score", F.col("start") - F.col("end"), -F.col("start"), -F.col("page_index"), -F.col("seq"))
    return candidates.groupBy("query_id", "doc_id").agg(F.max_by(F.struct("page_index", "start", "end", "score"), rank).alias("w")).select("query_id", "doc_id", "w.*")


def select_all(candidates: DataFrame) -> DataFrame:
    """Every candidate's range, repeats included, with its place in discovery order: pages ascending, then as found."""
    return ordered(candidates.select("query_id", "doc_id", "page_index", "seq", "start", "end"))


def exit_code(missing: Column, several: Column) -> Column:
    """A phrase that isn't found (1) outweighs one that is found too often (2)."""
    return F.when(missing, 1).when(several, 2).otherwise(0)


def outcomes(matches: DataFrame, queries: DataFrame, mode: str = "best") -> DataFrame:
    """A row per query, found or not: counts of ranges kept and of distinct ones, flags and exit code.

    Of literal matches, best keeps the first of a document (the query is then blocked if there are more), single none
    where there are several (an error), all every one.
    """
    at = ["query_id", "doc_id"]
    each = matches.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_index", "start", "end").alias("d"))
    many = F.col("n") > 1
    kept = {"best": lambda c: F.least(F.lit(1), F.col(c)), "single": lambda c: F.when(many, 0).otherwise(F.col(c)), "all": F.col}[mode]
    each = each.select("query_id", kept("n").alias("n"), kept("d").alias("d"), many.alias("many"))
    return summed(each, queries, F.lit(mode == "best"), F.lit(mode == "single"))


def summed(each: DataFrame, queries: DataFrame, best: Column, single: Column) -> DataFrame:
    """A row per query from rows per query and document (n, d: ranges kept and distinct; many: more than were asked for)."""
    total = each.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.bool_or("many").alias("many"))
    joined = queries.join(total, "query_id", "left")
    many = F.coalesce("many", F.lit(False))
    missing = F.coalesce("n", F.lit(0)) == 0
    found = joined.select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("segment_matches"), F.coalesce("d", F.lit(0)).cast("long").alias("highlight_count"), (missing & ~(many & single)).alias("not_found"), (many & best).alias("blocked"), F.when(many & single, "multiple_matches").alias("error"))
    return found.withColumn("exit_code", exit_code(F.col("not_found"), F.col("blocked") | F.col("error").isNotNull()))
