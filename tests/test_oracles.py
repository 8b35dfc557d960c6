"""Every query of the engine against its SQL, and the phrase search against hand-traced cases."""

import os
import random
import re

import duckdb
import pytest

from glosswork.operators.phrases import Page, Phrase
from glosswork.operators.search import literal_matches, progressive_candidates, scored
from glosswork.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def cell(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
        rel = con.sql(ORACLES[name])
        assert got == rows_of(rel.columns, rel.fetchall())
        assert got[1]


@pytest.mark.parametrize("text,query,gap,want", [
    ("we configuredMSCCD then something similaritythreshold of 70%", "we configured MSCCD similarity threshold of 70%", 200, [[(0, 18, 3), (34, 56, 3), (57, 60, 1)], [(0, 13, 2), (13, 18, 1), (34, 56, 3), (57, 60, 1)], [(0, 2, 1), (3, 18, 2), (34, 56, 3), (57, 60, 1)]]),
    ("alpha betaX gamma deltaX epsilon", "alpha beta gamma delta epsilon", 50, [[(0, 10, 2), (12, 23, 2), (25, 32, 1)], [(0, 5, 1), (6, 10, 1), (12, 23, 2), (25, 32, 1)]]),
    ("Introduction", "Introduction", 200, []),
    ("alpha beta gamma " + "x" * 300 + " delta", "alpha beta gamma delta", 200, []),
])
def test_candidates(text, query, gap, want):
    assert list(Phrase(query.split(), 3, True, gap, 3).candidates(Page(text))) == want


def test_scores(spark):
    pages = spark.createDataFrame([(1, 0, "alpha beta gamma")], "doc_id long, page_index int, text_norm string")
    queries = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma delta"), (3, "")], "query_id int, text string")
    got = sorted((r.query_id, r.seq, round(r.score, 6)) for r in scored(progressive_candidates(pages, queries)).collect())
    assert [x for x in got if x[0] == 1] == [(1, 0, 2.995), (1, 1, 2.90125), (1, 2, 2.90125)]
    assert (2, 0, 2.495) in got and not [x for x in got if x[0] == 3]


def plain_search(words, text, kmax, ignore_case, gap, least):
    """The same chains by patterns over the rest of the text, without any memory."""
    pattern = lambda i, k: re.compile(r"\s*".join(map(re.escape, words[i:i + k])), re.IGNORECASE if ignore_case else 0)
    out = []
    for k0 in range(min(kmax, len(words)), 0, -1):
        for m in pattern(0, k0).finditer(text):
            segments, i = [(m.start(), m.end(), k0)], k0
            while i < len(words):
                for k in range(min(kmax, len(words) - i), 0, -1):
                    if hit := pattern(i, k).search(text, segments[-1][1]):
                        segments.append((*hit.span(), k))
                        i += k
                        break
                else:
                    i += 1
            if all(b[0] - a[1] <= gap for a, b in zip(segments, segments[1:])) and sum(s[2] for s in segments) >= max(1, least):
                out.append(segments)
    return out


def test_candidates_against_plain_search():
    rng = random.Random(1)
    for t in range(3000):
        letters = "ab AbİiIıςσΣ " if t % 3 == 0 else "aab b "
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        words = ["".join(rng.choice(letters.replace(" ", "")) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 6))]
        if t % 50 == 0:
            words[rng.randrange(len(words))] = ""
        kmax, case, gap, least = rng.randrange(1, 4), rng.random() < 0.7, rng.choice([0, 1, 3, 200]), rng.randrange(0, 4)
        want = plain_search(words, text, kmax, case, gap, least) if len(words) >= max(1, least) else []
        assert list(Phrase(words, kmax, case, gap, least).candidates(Page(text))) == want, (text, words)


def test_options_of_each_query(spark):
    pages = spark.createDataFrame([(1, 0, "alpha beta xx gamma"), (2, 0, None), (3, 0, "")], "doc_id long, page_index int, text_norm string")
    rows = [(1, "Alpha beta gamma", True, 200), (2, "Alpha beta gamma", False, 200), (3, "alpha beta gamma", True, 2), (4, None, True, 2)]
    queries = spark.createDataFrame(rows, "query_id int, text string, ignore_case boolean, max_gap int")
    assert {r.query_id for r in progressive_candidates(pages, queries).collect()} == {1}
    assert progressive_candidates(pages, queries.where("false")).collect() == []


def test_a_page_of_many_matches(spark):
    pages = spark.createDataFrame([(1, 0, "ab " * 5000)], "doc_id long, page_index int, text_norm string")
    found = literal_matches(pages, spark.createDataFrame([(1, "AB")], "query_id int, text string")).orderBy("start").collect()
    assert [(r.start, r.end) for r in found] == [(3 * i, 3 * i + 2) for i in range(5000)]


def test_folded_words_are_found(spark):
    """The test for a plain word never hides what the pattern would find."""
    pages = spark.createDataFrame([(i, 0, x) for i, x in enumerate(["İstanbul", "ıSTANBUL", "Istanbul", "straße istanbul", "x"])], "doc_id long, page_index int, text_norm string")
    found = literal_matches(pages, spark.createDataFrame([(1, "istanbul")], "query_id int, text string"))
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in pages.where("regexp_like(text_norm, '(?iu)istanbul')").collect()} >= {0, 2, 3}
