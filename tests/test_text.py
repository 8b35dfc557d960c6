from pyspark.sql import functions as F

from glosswork.functions.text import hyphen_cuts, join_hyphens, normalize_chars, query_tokens, running, tenths
from glosswork.operators.layout import kept_by_joining, line_rects, rects_of


def test_normalization(spark):
    cases = {"a­b": "ab", "\n": " ", "\t 　": "   ", "ﬁ": "fi", "‐—−﹣－-": "------", "‘’": "''", "“”": '""', "″": "''", "é": "é", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in df.select("s", normalize_chars(F.col("s")).alias("n")).collect()} == cases


def test_hyphens(spark):
    cases = {"differ- ent": "different", "state-of-the-art": "state-of-the-art", "foo - bar": "foo bar", "foo- bar": "foobar", "a-b - c": "a-b - c", "-x y-": "-x y-", "": "", "a- b- c": "abc", "ab  -  cd-e- f": "ab  cd-e- f", "a-1 b": "a-1 b"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    rows = df.select("s", join_hyphens(F.col("s")).alias("j"), hyphen_cuts(F.col("s")).alias("c")).collect()
    assert {r.s: r.j for r in rows} == cases
    for r in rows:
        assert "".join(r.s[k] for k in kept_by_joining(r.s)) == r.j
        back, out = 0, []
        for i in range(len(r.j)):
            out.append(i + sum(c.n for c in r.c if c["at"] <= i))
        assert [r.s[i] for i in out] == list(r.j)


def test_hyphens_by_boxes():
    text = "state-of-the-art"
    assert len(kept_by_joining(text, [100.0] * 9 + [110.5] * 7)) == len(text)
    assert "".join(text[k] for k in kept_by_joining(text, [100.0] * 6 + [110.5] * 10)) == "stateof-the-art"
    assert len(kept_by_joining("a-", [0.0, 0.0])) == 2


def test_lines_of_boxes(spark):
    boxes = [(10.0, 10.0, 12.0, 14.0), (13.0, 10.2, 15.0, 14.1), (16.0, 10.1, 18.0, 14.2), (10.0, 30.0, 12.0, 34.0), (13.0, 30.1, 15.0, 34.2), (16.0, 29.9, 18.0, 34.1)]
    want = [(10.0, 10.0, 18.0, 14.2), (10.0, 29.9, 18.0, 34.2)]
    table = spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)], "k int, pos int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r)[2:] for r in line_rects(table, ["k"]).orderBy("line").collect()] == want
    whole = table.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("x0", "y0", "x1", "y1").alias("b")))).alias("g")).select(rects_of(F.col("g.b")).alias("r"), rects_of(F.slice("g.b", 1, 0)).alias("none"))
    assert [tuple(r) for r in whole.first().r] == want and whole.first().none == []
    assert len(line_rects(table, ["k"], y_tol=50.0).collect()) == 1
    df = spark.createDataFrame([(10.35,), (10.25,), (1234.56,)], "v double")
    assert [r[0] for r in df.select(tenths(F.col("v"))).collect()] == [round(x, 1) for x in (10.35, 10.25, 1234.56)]


def test_running_sums(spark):
    n = 1300
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i * 2).alias("v"))
    assert df.select(running(F.col("v")).alias("r")).first().r == [i * (i + 1) for i in range(n)]
    assert df.select(running(F.slice("v", 1, 0)).alias("r")).first().r == []


def test_words_compose_after_the_cut(spark):
    df = spark.createDataFrame([("Cafe\u0301 x\u00ady \ufb01n",)], "s string")
    assert df.select(query_tokens(F.col("s")).alias("w")).first().w == ["Caf\u00e9", "xy", "fin"]
