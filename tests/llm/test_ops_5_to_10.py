"""Operators 5 to 10 and the pipeline against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import line_dedup, mixing, near_dedup, neighbours, repeat_spans, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, comp string"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n)]


def edited(rng, ws):
    ws = list(ws)
    i, kind = rng.randrange(len(ws)), rng.randrange(3)
    ws[i:i + (kind != 0)] = [] if kind == 1 else words(rng, 1)
    return ws


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [words(rng, rng.randrange(6, 40)) for _ in range(12)]
    texts = [None, "", " ", "short line\nshort line", "\n\n"]
    for _ in range(60):
        lines = [" ".join(edited(rng, rng.choice(base)) if rng.random() < 0.6 else words(rng, rng.randrange(3, 30))) for _ in range(rng.randrange(1, 6))]
        texts.append("\n".join(lines))
    long = " ".join(words(rng, 3000))
    texts += [texts[8], texts[8], long, long[:9000] + " odd " + long[9000:], "a" * 5000, "é" * 300, texts[9] + " tail"]
    return [(None if i == 20 else i * 7 % 101, x, "en", rng.choice(["a", "b", None, "c"]), None, "k", "c") for i, x in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty(spark, none):
    assert line_dedup.judged(none).collect() == near_dedup.classified(none, 3, 85).collect() == repeat_spans.removed(none).collect() == []
    assert mixing.mixed(none).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.without_toxic(none, labels).collect() == []
    assert neighbours.search(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2).collect() == []


def test_lines_oracle(spark, tmp_path, rows):
    import duckdb

    kept = {r[0]: r for r in rows if r[0] is not None}
    spark.createDataFrame(list(kept.values()), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = line_dedup.op5_line_dedup(spark, str(tmp_path))
    rel = con.sql(line_dedup.ORACLE_SQL)
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_lines(docs, rows):
    judged = []
    for i, t, *_ in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        for pos, line in enumerate((t or "").split("\n")):
            ws = line.lower().split()
            if len(ws) >= 5:
                judged.append((i, pos, ws))
    gone = {(i, pos) for k, (i, pos, ws) in enumerate(judged) if any(near(ws, o) for _, _, o in judged[:k])}
    assert len(gone) > 20
    for r in line_dedup.judged(docs, equal_words=5).collect():
        kept = [x for pos, x in enumerate((r.row.text or "").split("\n")) if (r.doc_id, pos) not in gone]
        assert (r.n_dropped, r.kept_text) == (r.n_lines - len(kept), "\n".join(kept))
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns


def test_short_lines_that_repeat(spark, docs, rows, tmp_path):
    """Every equal line but the earliest goes, however short; blank lines stay."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    earlier, seen, gone = [], set(), set()
    for i, t, *_ in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        for pos, line in enumerate((t or "").split("\n")):
            ws = line.lower().split()
            if tuple(ws) in seen or len(ws) >= 5 and any(near(ws, o) for o in earlier):
                gone.add((i, pos))
            if ws:
                seen.add(tuple(ws))
            if len(ws) >= 5:
                earlier.append(ws)
    want = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if (i, pos) not in gone]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert Counter(map(tuple, line_dedup.op5_line_dedup(spark, str(tmp_path)).collect())) == want
    few = spark.createDataFrame([(1, "All rights reserved.\nx"), (2, "\nall  RIGHTS reserved."), (3, "X")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.without_repeats(few).collect()) == [(1, "All rights reserved.\nx"), (2, "")]


def shingles(text, k):
    ws = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)} | {c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    return {tuple(ws[i:i + min(k, len(ws))]) for i in range(len(ws) - min(k, len(ws)) + 1)} if ws else set()


@pytest.mark.parametrize("k,threshold", [(3, 85), (5, 80)])
def test_near(spark, k, threshold):
    rng = random.Random(k)
    base = words(rng, 150)
    texts = [None, "", " ", "One two", "one  TWO"] + [" ".join(words(rng, 80)) for _ in range(30)]
    for _ in range(150):
        ws = list(base)
        for _ in range(rng.randrange(1, 10)):
            ws[rng.randrange(len(ws))] = words(rng, 1)[0]
        texts.append(" ".join(ws))
    table = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[-1], "x")]
    sets, parent = {i: shingles(t, k) for i, t in enumerate(texts)}, list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: r for r in near_dedup.classified(spark.createDataFrame(table, "doc_id long, text string, id string"), k, threshold).collect()}
    assert len({root(i) for i in sets}) > 40
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root(i), root(i) == i)
    assert got[None].kept and got[None].component_id is None


def kept_by_brute_force(raw):
    windows = Counter()
    for _, b in raw:
        windows.update(b[i:i + 200] for i in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        mask = bytearray(len(b))
        for j in range(len(b) - 199):
            if windows[b[j:j + 200]] > 1:
                mask[j:j + 200] = b"\1" * 200
        runs = sum(m and not (j and mask[j - 1]) for j, m in enumerate(mask))
        want[i, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()] += 1
    return want


def test_repeats(docs, rows):
    want = kept_by_brute_force([(i, (t or "").encode()) for i, t, *_ in rows])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_spans.removed(docs).collect()) == want


@pytest.mark.parametrize("block", [repeat_spans.BLOCK, 150])
def test_repeats_in_periodic_texts(spark, monkeypatch, block):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = []
    for period in (1, 2, 3, 7, 31, 32, 33, 100, 168, 169, 170, 199, 200, 201, 350):
        unit = noise(period)
        for size in (199, 200, 201, 199 + period, 200 + period, 900):
            texts.append(noise(rng.randrange(300)) + (unit * 900)[:size] + noise(rng.randrange(300)))
        texts.append(noise(250) + (unit * 900)[3:203] + noise(250) + (unit * 900)[:450] + "!" + (unit * 900)[:450])
    texts += [" " * 199, " " * 200, " " * 2000, "\n" * 201, "ab" * 99 + "a", "x" + " " * 199 + "y"]
    table = list(enumerate(texts))
    rng.shuffle(table)
    monkeypatch.setattr(repeat_spans, "BLOCK", block)
    got = repeat_spans.removed(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == kept_by_brute_force([(i, t.encode()) for i, t in table])


@pytest.mark.parametrize("unit", [" ", "ab", "0123456789" * 9, "word and word or "])
def test_long_periodic_texts_have_few_entries(unit):
    data = (unit * 300_000)[:300_000].encode()
    entries = list(repeat_spans.entries_of(b"begin" + data + b"end"))
    assert sum(len(e[0]) for e in entries) < 800
    windows = sum(int(((e[3] - e[2] + 1) * e[4]).sum()) for e in entries)
    assert windows == len(data) + 8 - 199


def test_repeats_in_hot_groups(docs, monkeypatch):
    want = sorted(map(repr, repeat_spans.removed(docs).collect()))
    monkeypatch.setattr(repeat_spans, "HOT", 1)
    assert sorted(map(repr, repeat_spans.removed(docs).collect())) == want


def test_mixing(docs, rows):
    count = Counter(r.doc_id for r in mixing.mixed(docs, max_repeats=2.0).collect())
    assert set(count) == {r[0] for r in rows} and max(count.values()) <= 4  # a doc_id may stand in several rows
    tokens = Counter()
    for _, t, _, s, *_ in rows:
        tokens[s or ""] += len((t or "").split())
    chosen = {r.src: r for r in mixing.plan(docs, mixing.tokens_of(), max_repeats=2.0).collect()}
    repeats = [r.repeats for r in chosen.values()]
    assert abs(min(repeats) - 1) < 1e-6 and max(repeats) <= 2 + 1e-6 and abs(sum(r.weight for r in chosen.values()) - 1) < 1e-9
    totals = docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.sum(mixing.tokens_of()).alias("tokens"))
    a = mixing.exponent(totals, 0.999, 2.0, None)
    p = np.array([v for v in tokens.values() if v]) / sum(tokens.values())
    w = p**a / (p**a).sum()
    assert -(w * np.log(w)).sum() >= 0.999 * np.log(len(p)) - 1e-6


def test_mixing_against_plain_python(docs, rows, spark):
    """Weights, repeats and the very rows, from the operator's hashes and nothing else of it."""
    distinct = list({r[0]: r for r in rows if r[0] is not None}.values())
    table = spark.createDataFrame([(r[0], r[1], "en", r[3], None, "k", "c") for r in distinct], SCHEMA)
    keys = {r.doc_id: r for r in mixing._keys(table.select("doc_id", "source"), mixing.SEED).collect()}
    size = {r[0]: len((r[1] or "").split()) for r in distinct}
    of = {r[0]: r[3] or "" for r in distinct}
    tokens = Counter()
    for i, n in size.items():
        tokens[of[i]] += n
    share = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    low, high = 0.0, 1.0

    def most(a):
        power = {s: p**a / p for s, p in share.items()}
        return max(power.values()) / min(power.values())

    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if most(mid) > 2 * (1 + 1e-12) else (low, mid)
    a = 0.0 if most(0.0) <= 2 * (1 + 1e-12) else high
    z = sum(tokens[s]**a for s in share)
    whole = max(tokens[s] / tokens[s]**a for s in share) * z
    want = Counter()
    for s, n in tokens.items():
        repeats = round(tokens[s]**a / z * whole / n, 9) if n else 1.0
        epochs = int(repeats)
        rest = int((repeats - epochs) * n)
        left, full = rest, True
        for i in sorted((i for i in of if of[i] == s), key=lambda i: (keys[i].block_order, keys[i].doc_order, i)):
            want[i] += epochs
            block = [j for j in of if of[j] == s and keys[j].block_order == keys[i].block_order]
            before = sum(size[j] for j in of if of[j] == s and keys[j].block_order < keys[i].block_order)
            upto = sum(size[j] for j in block if (keys[j].doc_order, j) <= (keys[i].doc_order, i))
            inside = before + sum(size[j] for j in block) <= rest
            want[i] += bool(rest and (inside or upto <= rest - before))
    got = Counter(r.doc_id for r in mixing.mixed(table).collect())
    assert got == +want and 1 < max(got.values())


def test_columns_of_any_name(spark):
    """Tables whose columns are called what the operators call theirs."""
    inner = ["row", "gone", "did", "th", "pos", "norm", "h1", "kept_text", "n_lines", "n_dropped", "src", "block", "epoch", "weight", "repeats", "rest", "edge_block", "block_order", "doc_order", "read_order", "plan_src", "id", "seq", "component_id", "kept", "key", "score", "kind", "words"]
    rows = [(i, f"line {i % 3} one two three four\nother {i} words stand in here", "ab"[i % 2], *[f"{c}{i}" for c in inner]) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in inner))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    for out in (line_dedup.without_repeats(table), mixing.mixed(table), near_dedup.without_near_copies(table), toxicity.without_toxic(table, labels)):
        assert out.columns == table.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in inner)


def test_near_ids_with_several_texts(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    table = [(5, a), (5, b), (9, b), (11, a), (3, c), (20, c), (20, b), (30, c + " x"), (40, None), (40, "")]
    got = near_dedup.classified(spark.createDataFrame(table, "doc_id long, text string"), 3, 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (9, 3), (11, 3), (3, 3), (20, 3), (30, 3), (40, 40)} and len(got) == len(table)


def test_near_in_blocks(spark, monkeypatch):
    """A bucket of several groups that share most of their shingles' minima, met block by block."""
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    test_near(spark, 3, 85)


def test_risk_and_its_negative_branch():
    """The direction is the gradient of prior * risk + corrected risk, or minus that of the latter where it is negative."""
    rng = np.random.default_rng(5)
    p, u = (rng.random((20, 4)) < 0.6).astype(float), (rng.random((30, 4)) < 0.3).astype(float)
    loss = lambda x, sign, w, b: np.mean([np.log1p(np.exp(-sign * (sum(v * k for v, k in zip(row, w)) + b))) for row in x])
    seen = set()
    for prior, w, b in [(0.2, rng.standard_normal(4), -1.0), (0.9, np.array([4.0, 4.0, 4.0, 4.0]), 1.0), (0.5, np.zeros(4), 0.0)]:
        first = lambda w, b: prior * loss(p, 1, w, b)
        second = lambda w, b: loss(u, -1, w, b) - prior * loss(p, -1, w, b)
        a, c, g, gb = toxicity.step_of(*(toxicity.Presence([np.flatnonzero(r) for r in x], np.ones(4)) for x in (p, u)), w, b, prior)
        assert np.isclose(a, first(w, b)) and np.isclose(c, second(w, b))
        followed = (lambda w, b: first(w, b) + second(w, b)) if c >= 0 else (lambda w, b: -second(w, b))
        seen.add(c >= 0)
        slopes = [(followed(w + e, b) - followed(w - e, b)) / 2e-6 for e in np.eye(4) * 1e-6]
        assert np.allclose(g, slopes, atol=1e-6) and np.isclose(gb, (followed(w, b + 1e-6) - followed(w, b - 1e-6)) / 2e-6, atol=1e-6)
    assert seen == {True, False}


@pytest.mark.parametrize("part", [1, 7, 1 << 20])
def test_presence_against_matrices(monkeypatch, part):
    monkeypatch.setattr(toxicity, "PART", part)
    rng = np.random.default_rng(2)
    for n in (0, 1, 40):
        x, scale, w, g = rng.random((n, 9)) < 0.3, rng.random(9), rng.standard_normal(9), rng.standard_normal(n)
        x[1::3] = False
        rows = toxicity.Presence([np.flatnonzero(r) for r in x], scale)
        assert len(rows) == n and np.allclose(rows @ w, (x * scale) @ w) and np.allclose(rows.back(g), (x * scale).T @ g)


def test_toxicity(spark):
    rng = random.Random(2)
    table = [(i, " ".join(words(rng, 40) + (["vile", "filth"] if i % 4 == 0 else [])), "z") for i in range(600)] + [(600, None, "z"), (601, "", "z")]
    docs = spark.createDataFrame(table, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 600, 3)] + [(None, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.scores(docs, *toxicity.fit(docs, labels)).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i] >= 0.5) == (i % 4 == 0) for i in out) >= 0.97 * len(out)
    assert 0 <= found[600] == found[601] <= 1
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {i for i, s in found.items() if s < 0.5}
    assert set(toxicity.scores(docs, *toxicity.fit(docs, labels.where("toxic = 0"))).agg(F.max("score")).first()) == {np.exp(-700.0) / (1 + np.exp(-700.0))}


def test_toxicity_in_rare_words(spark):
    """Six insults that share the toxic documents among them, and one family of which no word stands twice."""
    rng = random.Random(4)
    insults = ["vile", "filth", "scum", "swine", "dregs", "louse"]
    kind = {i: "family" if i % 3 == 0 else "word" for i in range(0, 1200, 4)}
    toxic = lambda i: f"grumpf{'abcdefghij'[i % 10]}{i}" if kind[i] == "family" else rng.choice(insults)
    table = [(i, " ".join(words(rng, 40) + ([toxic(i)] if i in kind else []))) for i in range(1200)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in kind)) for i in range(1200)], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.scores(docs, *toxicity.fit(docs, labels)).collect()}
    out = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    for k in ("family", "word"):
        those = [i for i in out if kind.get(i) == k]
        assert len(those) > 10 and sum(found[i] >= 0.5 for i in those) >= 0.8 * len(those), k
    assert sum(found[i] >= 0.5 for i in out if i not in kind) <= 0.02 * len(out)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24))
    x[300:400] = x[300]
    x *= rng.uniform(0.5, 2, (1500, 1))
    table = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] + [1.0] * 23), (2080, [float("inf")] * 24), (2100, [])]
    df = spark.createDataFrame(table + bad, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.search(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, rs in found.items():
        s = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        hits += len({v for _, v, _ in rs} & set(best))
        assert [k for k, *_ in sorted(rs)] == list(range(1, len(rs) + 1)) and all(abs(sc - s[v]) < 1e-9 for _, v, sc in rs)
        assert [(-sc, v) for _, v, sc in sorted(rs)] == sorted((-sc, v) for _, v, sc in rs)
    assert hits >= 0.9 * 20 * len(found)


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.toPandas()
    x, ids = np.array(t.embedding.tolist(), np.float64), t.vec_id.to_numpy()
    found = neighbours.search(df, df.where("vec_id % 20 = 0")).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    at, hits = {v: i for i, v in enumerate(ids)}, 0
    for r in found:
        s = (x * x[at[r.query_id]]).sum(axis=1)
        hits += len(set(r.v) & {v for v in ids[np.lexsort((ids, -s))] [:21] if v != r.query_id})
    assert hits >= 0.9 * 20 * len(found)
    shares = neighbours.search(df, df.where("vec_id % 20 = 0"), scored=True).agg(F.sum("n_scored").alias("n"), F.sum("n_rows").alias("all")).first()
    print("share scored", shares.n / shares["all"], "recall", hits / 20 / len(found))
    assert shares.n < 0.4 * shares["all"]  # random vectors in 64 dimensions are near none in particular


def test_probes_retrieve_all_within_a_radius_and_rows_come_from_probes(monkeypatch):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    codes[:200] = codes[0] ^ (1 << rng.integers(0, 8, (200, 8))).astype(np.uint8) * (rng.random((200, 8)) < 0.4)
    index = neighbours.Index(codes)
    bits = np.unpackbits(codes[:, None] ^ codes[None, :5], axis=2).sum(axis=2)
    for q in range(5):
        for radius in (0, 1, 5, 7, 8, 15, 20, 27, 40, 64):
            assert index.within(codes[q], radius)[0].tolist() == np.flatnonzero(bits[:, q] <= radius).tolist()
        assert len(index.probed(codes[q], 7)) < 0.1 * len(codes)
    x = rng.standard_normal((3000, 16))
    monkeypatch.setattr(neighbours.Index, "probed", lambda self, code, radius: np.arange(30, 60))
    found = neighbours.nearest(x[0], 0, codes[0], index, np.arange(3000), x, 100.0, 20, 1.0, 30)
    assert set(found[0]) <= set(range(30, 60))
