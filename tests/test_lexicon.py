"""Many phrases at once, against a comparison of each with each page."""

import random
import re
from itertools import product

import numpy as np

from glosswork.operators import layout, lexicon, search
from glosswork.operators.lexicon import Lexicon
from glosswork.operators.phrases import fold
from glosswork.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "doc_id long, page_index int, text_norm string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def compares_all(df):
    return any(x in plan_of(df) for x in ("NestedLoopJoin", "CartesianProduct"))


def some_text(rng, n):
    return "".join(rng.choice("aab bcA éÉßſsıİ  .\t") for _ in range(rng.randrange(n)))


def some_rows(rng, n_pages, n_queries):
    pages = [(rng.randrange(4) if rng.random() < 0.9 else None, rng.randrange(6), some_text(rng, 60) if rng.random() < 0.9 else None) for _ in range(n_pages)]
    return pages, [(i, some_text(rng, 7)) for i in range(n_queries)] + [(n_queries, None), (n_queries + 1, "aa"), (n_queries + 2, "a a"), (n_queries + 3, "a ¨ b")]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_lexicon_against_patterns():
    rng = random.Random(3)
    for t in range(300):
        texts = [some_text(rng, 50) for _ in range(4)]
        phrases = sorted({tuple(fold("".join(rng.choice("aabcé") for _ in range(rng.randrange(1, 3)))) for _ in range(rng.randrange(1, 5))) for _ in range(8)})
        loose = t % 2 == 0
        want = []
        for p, text in enumerate(texts):
            for n, words in enumerate(phrases):
                pattern = (r"[\t ]*" if loose else r"[\t ]+").join(map(re.escape, words))
                want += [(p, n, *m.span()) for m in re.finditer(pattern, fold(text))]
        assert [tuple(map(int, r)) for r in zip(*Lexicon(phrases, loose, True).search(texts))] == sorted(want), (texts, phrases)


def test_forgets_without_loss(monkeypatch):
    monkeypatch.setattr(lexicon, "KNOWN", 3)
    one = Lexicon([("ab",), ("b", "a")], False, True)
    for _ in range(3):
        assert [x.tolist() for x in one.search(["ab ab", "", "b ab"])] == [[0, 0, 0, 2, 2], [0, 0, 1, 0, 1], [0, 3, 1, 2, 0], [2, 5, 4, 4, 3]]


def test_long_words_and_slices(monkeypatch):
    monkeypatch.setattr(lexicon, "LONG", 3)
    assert [x.tolist() for x in Lexicon([("cd", "ab"), ("d", "abab")], True, False).search(["abcd ababab", "abcdab"])] == [[0, 0, 1], [0, 1, 0], [2, 3, 2], [7, 9, 6]]


def test_many_literal_matches(spark):
    rng = random.Random(5)
    data, asked = some_rows(rng, 60, 40)
    pages, queries = spark.createDataFrame(data, PAGES), spark.createDataFrame(asked, "query_id long, text string")
    at = ["query_id", "doc_id", "page_index", "start", "end"]
    for case in (True, False):
        want = rows(search.literal_matches(pages, queries, ignore_case=case), *at)
        assert rows(search.literal_matches(pages, queries, ignore_case=case, many=True), *at) == want and want
    assert search.literal_matches(pages, queries.where("false"), many=True).collect() == []


def test_case_as_patterns_take_it(spark):
    """The lexicon's folded form is equal exactly where a pattern that ignores case takes characters for equal."""
    chars = [chr(c) for c in range(33, 0x2C00) if chr(c).isprintable() and not chr(c).isspace()]
    df = spark.createDataFrame([(a, x) for a in chars for x in {a.lower()[:1], a.upper()[:1], a.swapcase()[:1], fold(a)}], "a string, b string")
    for r in df.selectExpr("a", "b", r"regexp_like('q' || a, '(?iu)q' || '\\Q' || b || '\\E') AS same").collect():
        assert r.same == (fold(r.a) == fold(r.b)), (r.a, r.b)


def test_grid_maps(spark):
    """Boxes of plain pages are those of their glyph tables, and rectangles those of the boxes."""
    rng = random.Random(7)
    texts = ["", None, "\n", "differ-\nent ﬁne", "a- b\tc"] + ["".join(rng.choice("ab- \n­ﬁ") for _ in range(40)) for _ in range(30)]
    pages = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "doc_id long, page_index int, text string")
    maps = layout.page_maps(layout.glyph_grid(pages, ["doc_id", "page_index"]))
    kind = f"doc_id long, page_index int, text_norm string, char_map array<{layout.RECT}>"
    assert rows(pages.mapInArrow(layout.grid_maps, kind), "*") == rows(maps, "*")
    queries = spark.createDataFrame([(1, "different"), (2, "a"), (3, "b a"), (4, "fi")], "query_id int, text string")
    at = ["query_id", "doc_id", "page_index", "start", "end", "rects"]
    want = rows(layout.hit_rects(search.literal_matches(maps, queries), maps), *at)
    assert rows(search.literal_matches(pages, queries, many=True, through=layout.grid_maps), *at) == want
    assert rows(search.literal_matches(maps, queries, many=True), *at) == want and len(want) > 20


def test_norm_hyphen_boxes_compares_no_pairs(spark):
    found = QUERIES["norm_hyphen_boxes"](spark, SF)
    assert not compares_all(found) and "Join" not in plan_of(found)


def test_places(spark, monkeypatch):
    rng = random.Random(11)
    data, asked = some_rows(rng, 80, 20)  # numbers of pages repeat in a document
    pages, queries = spark.createDataFrame(data, PAGES), spark.createDataFrame(asked, "query_id long, text string")
    at = ["query_id", "doc_id", "page_index", "start", "end", "place"]
    want = rows(search.ordered(search.literal_matches(pages, queries)), *at)
    again = queries.unionByName(spark.createDataFrame([(1, "c"), (2, "a")], queries.schema))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for size in (1, 60, 200_000):
            monkeypatch.setattr(lexicon, "SLICE", size)
            assert rows(search.ordered_literal_matches(pages, queries), *at) == want and want
        assert rows(search.ordered_literal_matches(pages, again), *at) == rows(search.ordered(search.literal_matches(pages, again)), *at)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_order_hits_sorts_no_matches(spark):
    found = QUERIES["order_hits"](spark, SF)
    assert not compares_all(found) and "Window" not in plan_of(found)


def test_pieces_hold_each_row_once():
    rng = np.random.default_rng(17)
    for t in range(200):
        many = rng.integers(1, 12, 6)
        begin, n = np.cumsum(many) - many, np.sort(rng.integers(0, 6, rng.integers(0, 40)))
        size, width, held = (int(rng.integers(1, most)) for most in (30, 8, 60))
        got = []
        for (who, w), (which, h) in lexicon.pieces(n, many, begin, size, width, held):
            assert len(w) == len(h)
            for a, b, c, d in zip(w, w[1:], h, h[1:]):
                assert 0 < b - a <= width and 0 < (b - a) * (d - c) <= max(size, width)
                got += product(who[a:b].tolist(), which[c:d].tolist())
        assert sorted(got) == sorted((q, m) for m, k in enumerate(n.tolist()) for q in range(begin[k], begin[k] + many[k]))


def test_order_hits_makes_rows_of_pieces(spark, monkeypatch):
    """Workers don't write out each query of a match; columns of ids may be null only if some are."""
    asked = [*((i, "A") for i in range(150)), (200, "b a"), (201, "none"), (202, None)]
    data = [(d, p, "a b a " * (9 + d)) for d in range(3) for p in range(3)]
    at = ["query_id", "doc_id", "page_index", "start", "end", "place"]
    for blocks, page, key, null in ((4_000_000, [], [], []), (2_000, [(None, 1, "a")], [], ["doc_id", "page_index"]), (2_000, [], [(None, "b")], ["query_id"])):
        monkeypatch.setattr(lexicon, "BLOCK_CHARS", blocks)
        pages, queries = spark.createDataFrame(data + page, PAGES), spark.createDataFrame(asked + key, "query_id long, text string")
        found = search.ordered_literal_matches(pages, queries)
        want = rows(search.ordered(search.literal_matches(pages, queries)), *at)
        assert rows(found, *at) == want and len(want) > 20_000
        assert [f.name for f in found.schema if f.nullable] == null and "Generate explode(askers" in plan_of(found)


def test_places_with_rects(spark):
    texts = [(i % 3, i, "ab a\nb ab" * (i + 1)) for i in range(9)]
    maps = layout.page_maps(layout.glyph_grid(spark.createDataFrame(texts, "doc_id long, page_index int, text string"), ["doc_id", "page_index"]))
    queries = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, "a b")], "query_id int, text string")
    got = rows(search.ordered_literal_matches(maps, queries), "query_id", "doc_id", "page_index", "start", "end", "rects")
    assert got == rows(search.literal_matches(maps, queries, many=True), "query_id", "doc_id", "page_index", "start", "end", "rects") and len(got) > 100


def test_many_starters(spark):
    rng = random.Random(13)
    data, asked = some_rows(rng, 60, 40)
    pages, queries = spark.createDataFrame(data, PAGES).where("text_norm is null or not contains(text_norm, '\t')"), spark.createDataFrame([*asked, (90, "a ¨ b"), (91, "a ­ b")], "query_id long, text string")
    at = ["query_id", "doc_id", "page_index", "k0", "start", "end"]
    for case in (True, False):
        want = rows(search.starters(pages, queries, ignore_case=case), *at)
        assert rows(search.starters(pages, queries, ignore_case=case, many=True), *at) == want
        assert rows(search.starters(pages, queries, ignore_case=case, kmin=3, many=True), *at) == [r for r in want if r[3] == 3]
    assert {r[3] for r in want} == {1, 2, 3}


def test_chunk_pattern_compares_no_pairs(spark):
    assert not compares_all(QUERIES["chunk_pattern"](spark, SF))


def test_filter_page_compares_no_pairs(spark):
    assert not compares_all(QUERIES["filter_page"](spark, SF))


def test_prog_starters_compares_no_pairs(spark):
    assert not compares_all(QUERIES["prog_starters"](spark, SF))
