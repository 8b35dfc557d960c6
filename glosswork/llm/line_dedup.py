"""Line dedup by deletion neighbourhoods; DataFrame functions only.

Lines are compared by their words (lower case, white space collapsed); the edit bound is one word inserted,
deleted or replaced. A line is dropped if an equal line, or one within the bound, comes earlier in the
order (doc_id, position in the document); the earliest stays. Lines of fewer than min_words words have
no edit bound, as chance makes them alike; equal ones of at least equal_words words go all the same (the operator
and the pipeline take every line that isn't blank). This is judged on the input, so it doesn't chain.

Equal lines meet first, by hash. A line with an edit of one word keeps its first or its last half, so
lines that share no half with another line are set aside exactly. Each that remains emits its sequence and
all its sequences with one word left out as hashed keys. Two lines within the bound share a key: of a
deletion at one place (a replaced word), or of one line's deletion and the other's whole (an added word).
The earliest line of each key is found by aggregation, which combines before the shuffle, so no key's
lines are paired with each other; a line's earliest partner by each of its keys is then verified on the words
themselves, so that a false one by one key hides no true one by another.

A row travels as one struct beside the operator's own columns, so its columns may have any names.

Defined results: a null or empty text stays empty; rows with equal doc_id and text share their fate; null
doc_id comes first; an empty table gives no rows. A text without a dropped line is returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored, table_of, whole_text

MIN_WORDS = 5
#: Tables of keys are broadcast up to so many bytes, counted before; larger ones are joined by shuffle, with equal results.
BROADCAST_BYTES = 12_000_000
_NO_ID = -(2**63)


def _words(norm: str = "norm") -> Column:
    return F.split(norm, " ")


def _count(norm: str = "norm") -> Column:
    """Words of a normal form."""
    return F.octet_length(norm) - F.octet_length(F.replace(F.col(norm), F.lit(" "), F.lit(""))) + 1


def _halves(norm: str = "norm") -> Column:
    """Keys of the first and last halves, at the sizes that a line or one a word shorter has."""
    n = _count(norm)
    longer, shorter = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array_distinct(F.array(*(F.xxhash64(F.lit(sign), h, F.call_function("substring_index", F.col(norm), F.lit(" "), h * sign)) for h in (longer, shorter) for sign in (1, -1))))


def _mixed(words: Column, ahead: int) -> Column:
    """A hash of each word with its place, or with the place before it."""
    return F.transform(words, lambda w, i: F.xxhash64(w, i - ahead))


def _variants(words: Column) -> Column:
    """(place, key) of the whole sequence at place 0 and of those with the word at each place left out.

    A sequence's key is the exclusive or of its words' hashes with their places, so that leaving out the next
    word instead changes two terms only: all keys of a line are one running exclusive or.
    """
    here, before = _mixed(words, 0), _mixed(words, 1)
    xor = lambda a, b: a.bitwiseXOR(b)
    none = F.lit(0).cast("long")
    whole, moved = F.aggregate(here, none, xor), F.aggregate(before, none, xor)
    steps = F.zip_with(before, F.concat(F.array(none), F.slice(here, F.lit(1), F.size(here) - 1)), xor)
    start = F.struct(moved.alias("run"), F.array(F.struct(F.lit(0).alias("p"), whole.alias("v"))).alias("out"))

    def step(a: Column, d: Column) -> Column:
        run = xor(a.run, d)
        return F.struct(run.alias("run"), F.concat(a.out, F.array(F.struct(F.size(a.out).alias("p"), run.alias("v")))).alias("out"))

    return F.aggregate(steps, start, step, lambda a: a.out)


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one word: common prefix and suffix leave at most one."""
    n = F.greatest(F.size(a), F.size(b))
    shorter = F.least(F.size(a), F.size(b))
    parted = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    prefix = F.when(parted == 0, shorter).otherwise(parted.cast("int") - 1)
    rest = n - prefix - 1
    tail = lambda x: F.slice(x, F.size(x) - rest + 1, rest)
    return (F.abs(F.size(a) - F.size(b)) <= 1) & ((prefix >= n) | (rest <= 0) | ((rest <= shorter) & (tail(a) == tail(b))))


def _has_words(norm: Column, least: int) -> Column:
    return norm != "" if least <= 1 else F.call_function("substring_index", norm, F.lit(" "), F.lit(least - 1)) != norm


def exploded(docs: DataFrame, min_words: int, equal_words: int) -> DataFrame:
    """A row per line that is judged: document key, position, normal form, its hashes and those of its halves,
    which are null for a line without edit bound.

    Case and white space are settled on the whole text, once, as a filter on lines would do it again.
    """
    wide = F.contains("text", F.lit("  "))
    for c in "\t\r\x0b\x0c":
        wide |= F.contains("text", F.lit(c))
    lower = F.lower("text")
    settled = F.when(wide, F.regexp_replace(lower, "[ \\t\\r\\x0b\\x0c]+", " ")).otherwise(lower)
    lines = docs.select("did", "th", F.posexplode(F.split(settled, "\n", -1)).alias("pos", "line"))
    norm = F.trim("line")
    lines = lines.where(_has_words(norm, min(min_words, equal_words))).select("did", "th", "pos", norm.alias("norm"))
    return lines.select("*", F.xxhash64("norm").alias("h1"), F.hash("norm").alias("h2"), F.when(_has_words(F.col("norm"), min_words), _halves()).alias("halves"))


def _sized(table: DataFrame) -> DataFrame:
    """A written table of numbers, marked for broadcast if all its rows are few enough bytes."""
    width = sum(f.dataType.jsonValue() == "long" and 8 or 4 for f in table.schema if f.dataType.typeName() != "struct") + 24 * sum(f.dataType.typeName() == "struct" for f in table.schema)
    return F.broadcast(table) if table.count() * width <= BROADCAST_BYTES else table


def _among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is in a written table."""
    return rows.join(_sized(keys), on, "left_semi")


def near_earlier(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that come after a different line within the bound."""
    keys = lines.select("h1", F.explode("halves").alias("key"))
    differ = [F.min("h1").alias("one"), F.max("h1").alias("other")]
    shared = stored(keys.groupBy("key").agg(*differ).where("one <> other").select("key"), "halves-shared")
    alive = stored(_among(keys, shared, ["key"]).select("h1").distinct(), "lines-alive")
    left = _among(lines.select("h1", "h2", "did", "pos", "norm"), alive, ["h1"]).groupBy("h1", "h2").agg(F.min(F.struct("did", "pos", "h1")).alias("own"), F.first("norm").alias("norm"))
    left = stored(left, "lines-alike")
    variants = stored(left.select("h1", F.inline(_variants(_words()))), "variants")
    met = stored(variants.groupBy("v").agg(*differ).where("one <> other").select("v"), "variants-met")
    members = stored(_among(variants, met, ["v"]).join(left.select("h1", "own"), "h1"), "variant-members")
    places = members.groupBy("v", "p").agg(F.min("own").alias("m"))
    groups = places.groupBy("v").agg(F.min(F.when(F.col("p") == 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("p") > 0, F.col("m"))).alias("deleted"))
    places = places.where("p > 0").withColumnRenamed("m", "replaced")
    here = members.join(groups, "v").join(places, ["v", "p"], "left")
    partner = F.when(F.col("p") == 0, F.col("deleted")).otherwise(F.least("whole", "replaced"))
    found = here.select("h1", "own", partner.alias("partner")).where("partner < own and partner.h1 <> h1")
    pairs = found.select("h1", F.col("partner.h1").alias("other")).distinct()  # as many as the line has keys, at most
    text = left.select("h1", "h2", "norm")
    pairs = pairs.join(text, "h1").join(text.select(F.col("h1").alias("other"), F.col("norm").alias("other_norm")), "other")
    return pairs.where(within_one_word(_words(), _words("other_norm"))).select("h1", "h2").distinct()


def judged(docs: DataFrame, min_words: int = MIN_WORDS, equal_words: int = 1) -> DataFrame:
    """(row, doc_id, kept_text, n_lines, n_dropped) of docs (any columns with doc_id and text), row being a struct of all."""
    did, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(whole_text()).alias("th")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), did, th)
    lines = stored(exploded(docs.select(did, th, whole_text().alias("text")), min_words, equal_words), "lines")
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", F.lit(False).alias("near"))
    near = near_earlier(lines.where("halves is not null")).withColumn("near", F.lit(True))
    marks = stored(repeated.union(near).groupBy("h1", "h2").agg(F.max("near").alias("near")), "lines-marked")
    placed = stored(lines.select("did", "th", "pos", "h1", "h2").join(_sized(marks), ["h1", "h2"]), "lines-placed")
    # written first, so that the join has two plain inputs and a hot line can be split or meets a broadcast
    firsts = stored(placed.groupBy("h1", "h2").agg(F.min(F.struct("did", "pos", "th")).alias("first")), "lines-first")
    gone = placed.join(_sized(firsts), ["h1", "h2"]).where("near or struct(did, pos, th) <> first").select("did", "th", "pos").distinct()
    lists = stored(gone.groupBy("did", "th").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "lines-gone")
    drop_stored(lines, marks, placed, firsts)
    joined = keyed.join(lists, ["did", "th"], "left")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    parts = F.split(text, "\n", -1)
    # pieces between dropped lines, so that a long document is filtered in one pass
    edges = F.array_union(F.array(F.lit(-1)), F.col("gone"))
    pieces = F.zip_with(edges, F.concat(F.col("gone"), F.array(F.size(parts))), lambda a, b: F.slice(parts, a + 2, b - a - 1))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return joined.select("row", F.col("row.doc_id").alias("doc_id"), kept.alias("kept_text"), F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the lines that stay; those that lose every line go. Columns as before."""
    kept = judged(docs, min_words).where("n_dropped < n_lines")
    text = F.when(F.col("n_dropped") == 0, F.col("row")["text"]).otherwise(F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its lines, of those dropped, and the digest of what is left."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same by whole sequences in place of hashes: every variant of every line with a word left out is written out.
ORACLE_SQL = r"""
WITH l AS (SELECT coalesce(doc_id, -9223372036854775808) AS did, doc_id, i - 1 AS pos, parts[i] AS line, trim(regexp_replace(lower(parts[i]), '[ \t\r\v\f]+', ' ', 'g'), ' ') AS norm
 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
firsts AS (SELECT norm, min((did, pos)) AS own, string_split(norm, ' ') AS w FROM l WHERE norm <> '' GROUP BY norm),
v AS (SELECT norm, own, p, CASE WHEN p = 0 THEN norm ELSE array_to_string(w[1:p - 1] || w[p + 1:], ' ') END AS key FROM (SELECT *, unnest(range(0, len(w) + 1)) AS p FROM firsts WHERE len(w) >= 5)),
near AS (SELECT DISTINCT a.norm FROM v a JOIN v b ON a.key = b.key AND a.norm <> b.norm AND b.own < a.own AND ((a.p = 0) <> (b.p = 0) OR a.p = b.p)),
marked AS (SELECT *, norm <> '' AND (norm IN (SELECT norm FROM near) OR row_number() OVER (PARTITION BY norm ORDER BY did, pos) > 1) AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
