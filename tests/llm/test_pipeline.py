"""The corpus pipeline on a small fixture: each stage against plain Python on what the stage before it left."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
import public_tokenizers
import tiktoken
from test_ops_5_to_10 import SCHEMA, edited, near, shingles, words

import corpus_pipeline
from glosswork.llm import byte_bpe

INSULTS = ["vile", "filth", "scum", "swine"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, where = random.Random(21), tmp_path_factory.mktemp("pipeline")
    base = [words(rng, 70) for _ in range(4)]
    texts = [None, "", " \n", "Footer text", "body one two three four five\nFooter text"]
    for i in range(500):
        ws = list(rng.choice(base)) if i % 5 == 0 else words(rng, rng.randrange(20, 90))
        if i % 5 == 0:
            ws[rng.randrange(70)] = "changed"
            ws[rng.randrange(70)] = "again"
        if i % 4 == 1:
            ws[rng.randrange(len(ws))] = rng.choice(INSULTS)
        texts.append(" ".join(ws) + rng.choice(["", "\nFooter text", "\nthe same closing line of seven words"]))
    texts += [texts[9], "long " * 4000]
    rows = [(i, x, "en", rng.choice(["a", "a", "a", "b", None]), None if x is None else len(x), "k", "c") for i, x in enumerate(texts)] + [(None, "no id at all stands here", "en", "a", 24, "k", "c")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(any(w in INSULTS for w in (x or "").split()))) for i, x in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    before = docs.collect()

    def after(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), folder)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        return out.collect()

    left = after("toxicity", before)
    toxic = {r.doc_id for r in before if any(w in INSULTS for w in (r.text or "").split())}
    held = {i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0}
    kept = {r.doc_id for r in left}
    assert len(kept & held) <= 0.3 * len(held) and len(kept & toxic) <= 0.1 * len(toxic)
    assert len([r for r in before if r.doc_id not in toxic and r.doc_id not in kept]) <= 0.03 * len(before)
    assert {repr(r) for r in left} <= {repr(r) for r in before}

    gone, seen, longer = set(), set(), []
    for r in sorted(left, key=lambda r: -(2**63) if r.doc_id is None else r.doc_id):
        for pos, line in enumerate((r.text or "").split("\n")):
            ws = line.lower().split()
            if tuple(ws) in seen or len(ws) >= 5 and any(near(ws, o) for o in longer):
                gone.add((r.doc_id, pos))
            if ws:
                seen.add(tuple(ws))
            if len(ws) >= 5:
                longer.append(ws)
    want = {}
    for r in left:
        lines = (r.text or "").split("\n")
        stay = [x for pos, x in enumerate(lines) if (r.doc_id, pos) not in gone]
        if stay:
            want[r.doc_id] = r.text if len(stay) == len(lines) else "\n".join(stay)
    lines = after("line_dedup", left)
    assert {r.doc_id: r.text for r in lines} == want and gone
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines)

    sets = {r.doc_id: shingles(r.text, 5) for r in lines if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    alone = after("near_dedup", lines)
    assert Counter(r.doc_id for r in alone) == Counter(r.doc_id for r in lines if r.doc_id is None or find(r.doc_id) == r.doc_id)
    assert len(alone) < len(lines)

    mixed = after("mixing", alone)
    count = Counter(r.doc_id for r in mixed)
    assert set(count) == {r.doc_id for r in alone} and max(count.values()) == 2
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})
    rows = Counter()
    for r in mixed:
        ids = known.encode_ordinary(r.text or "")
        rows[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, after("byte_bpe", mixed))) == rows
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and Counter(map(tuple, whole.collect())) == rows


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
