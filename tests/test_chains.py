"""The chains of many phrases in many pages at once, against plain patterns and against one phrase and page at a time."""

import random

import pyarrow as pa
from pyspark.sql import types as T

from glosswork.operators import chains, search
from glosswork.operators.chains import Chains, fits, odd
from glosswork.operators.phrases import Page, Phrase
from test_oracles import plain_search


def found(phrases, texts, case):
    got = {}
    for which, page, seq, counts, flat in Chains(phrases, case).search(texts):
        at = 0
        for f, p, nth, n in zip(which.tolist(), page.tolist(), seq.tolist(), counts.tolist()):
            mine = got.setdefault((f, p), [])
            assert nth == len(mine)
            mine.append([tuple(x) for x in flat[:, at:at + n].T.tolist()])
            at += n
    return got


def test_against_plain_search(monkeypatch):
    rng = random.Random(3)
    for t in range(150):
        monkeypatch.setattr(chains, "STARTS", rng.choice([1, 7, 300_000]))
        letters = rng.choice(["aab b ", "ab AB\n", "ab ñÑ éiİıIςσΣ", "aaaaab   "])
        make = lambda n, some: "".join(rng.choice(some) for _ in range(rng.randrange(n)))
        texts, case = [make(60, letters) for _ in range(rng.randrange(1, 6))], rng.random() < 0.7
        phrases = []
        for _ in range(rng.randrange(1, 8)):
            words = [x for x in (make(3, "".join(letters.split())) for _ in range(rng.randrange(1, 7))) if x]
            if words:
                phrases.append(Phrase(words, rng.randrange(1, 5), case, rng.choice([0, 1, 3, 200]), rng.randrange(0, 4)))
        phrases, texts = [p for p in phrases if fits(p)], [x for x in texts if not odd(x)]
        if not phrases:
            continue
        got = found(phrases, texts, case)
        for f, p in enumerate(phrases):
            for i, text in enumerate(texts):
                want = plain_search(p.words, text, p.kmax, case, p.max_gap, p.min_words) if len(p.words) >= p.min_words else []
                assert got.get((f, i), []) == want, (text, p.words, p.kmax, p.max_gap, p.min_words)


def test_odd_pages_and_phrases_among_others():
    texts = ["a b c", None, "a b c a b c", "", "x\x1ca b c", "ab c\nabc", "A b c"]
    block = [(1, ["a", "b", "c"], 3, True, 200, 3), (2, ["A", "b", "c"], 2, False, 200, 1), (3, ["a", "", "c"], 3, True, 200, 2), (4, ["b c", "a", "b"], 3, True, 9, 1), (5, ["a", "b", "c"], 7, True, 200, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], ["doc_id", "page_index", "text_norm"])
    got = [tuple(r.values()) for out in search._searcher(block, T.IntegerType())(iter([batch])) for r in out.to_pylist()]
    want = []
    for q, words, kmax, case, gap, least in block:
        for d, text in enumerate(texts):
            for seq, segs in enumerate(Phrase(words, kmax, case, gap, least).candidates(Page(text)) if text is not None else ()):
                want.append((q, d, 0, seq, [dict(zip("sek", x)) for x in segs], len(words)))
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[0] for r in got} == {1, 2, 3, 4, 5}


def test_no_phrase_is_followed_alone(monkeypatch):
    """What took the time: each phrase in each page by itself."""
    monkeypatch.setattr(Phrase, "candidates", None)
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([0], pa.int32()), pa.array(["Alpha beta xx gamma ñ"])], ["doc_id", "page_index", "text_norm"])
    got = [r for out in search._searcher([(7, ["alpha", "beta", "gamma"], 3, True, 200, 3)], T.IntegerType())(iter([batch])) for r in out.to_pylist()]
    assert [r["segs"] for r in got] == [[{"s": 0, "e": 10, "k": 2}, {"s": 14, "e": 19, "k": 1}], [{"s": 0, "e": 5, "k": 1}, {"s": 6, "e": 10, "k": 1}, {"s": 14, "e": 19, "k": 1}]]
