"""Mixing sources to target weights by temperature; DataFrame functions only.

Weights are token shares to a power a in [0, 1], normalised. The power is bisected until the weights
meet the target: the greatest a whose entropy is at least a share of the greatest possible, or the
least a at which no source is repeated more than max_repeats times. A budget of tokens then fixes how often
each source is read: whole epochs, and a part of one more. Without a budget it is the least at
which every source is read at least once. Documents fall into blocks by hash; the part epoch takes
blocks in a permuted order, and the block at its edge is cut between documents, in a permuted order too.

Only totals of sources and blocks are gathered; a document's share in the plan is decided from its own
hashes and its source's row, so hot sources are neither shuffled nor windowed.

Defined results: a null source is the source of the empty string; texts without a word count no tokens, and
a source without tokens is read once; an empty table gives no rows; ties in hashes go by doc_id. A row travels as one
struct, so its columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table_of, whole_text

BLOCKS, SEED, MAX_REPEATS = 1024, 20, 2.0


def _keys(df: DataFrame, seed: int) -> DataFrame:
    """src, block order and document order of the part epoch."""
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(BLOCKS)).cast("int")
    src = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return df.withColumns({"src": src, "block": block}).withColumns({"block_order": F.xxhash64("block", "src", F.lit(seed + 1)), "doc_order": F.xxhash64(F.col("doc_id"), F.lit(seed + 2))})


def exponent(totals: DataFrame, target_entropy: float | None, max_repeats: float, budget: float | None) -> float:
    """Bisects in [0, 1]; a pass judges all points that the next five halvings can ask for. totals: one row per source."""
    low, high = 0.0, 1.0
    whole = totals.agg(F.sum("tokens").alias("n")).first().n or 1
    shares = totals.where("tokens > 0").select("tokens", (F.col("tokens") / F.lit(whole)).alias("share"))
    for _ in range(8):
        step = (high - low) / 32
        points = shares.select("tokens", "share", F.explode(F.array(*(F.lit(low + k * step) for k in range(33)))).alias("a"))
        power = F.pow("share", F.col("a"))
        sums = points.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max(power / F.col("share")).alias("most"), F.min(power / F.col("share")).alias("least"), F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n"))
        rows = {r.a: r for r in sums.collect()}
        if not rows:
            return 1.0

        def met(r) -> bool:
            if target_entropy is not None:  # entropy falls as a grows: the greatest that still meets it
                return math.log(r.z) - r.a * r.l / r.z >= target_entropy * math.log(r.n) - 1e-12
            repeats = r.most / r.z * budget / r.all if budget is not None else r.most / r.least
            return repeats > max_repeats * (1 + 1e-12)

        at = sorted(rows)
        if not met(rows[at[0]]):
            return at[0]
        if met(rows[at[-1]]):
            return at[-1]
        lo, hi = 0, 32
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if met(rows[at[mid]]) else (lo, mid)
        low, high = at[lo], at[hi]
    return low if target_entropy is not None else high


def plan(docs: DataFrame, tokens: Column, seed: int = SEED, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """One row per source: weight, whole epochs, and the last (block_order, doc_order, doc_id) of the part epoch."""
    counted = stored(_keys(docs.select("doc_id", "source", tokens.cast("long").alias("tokens")), seed).select("doc_id", "src", "block_order", "doc_order", "tokens"), "mix-counts")
    blocks = stored(counted.groupBy("src", "block_order").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    totals = blocks.groupBy("src").agg(F.sum("tokens").alias("tokens"))
    a = exponent(totals, target_entropy, max_repeats, budget)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(0.0)
    weighed = totals.select("src", "tokens", power.alias("power"))
    sums = weighed.agg(F.sum("power").alias("z"), F.max(F.when(F.col("power") > 0, F.col("tokens") / F.col("power"))).alias("scale")).first()
    z = sums.z or 1.0
    whole = budget if budget is not None else (sums.scale or 0.0) * z
    weight = F.col("power") / F.lit(z)
    repeats = F.when(F.col("tokens") > 0, F.round(weight * F.lit(float(whole)) / F.col("tokens"), 9)).otherwise(1.0)
    sources = weighed.select("src", "tokens", weight.alias("weight"), repeats.alias("repeats")).withColumn("epochs", F.floor("repeats").cast("int")).withColumn("rest", F.floor((F.col("repeats") - F.col("epochs")) * F.col("tokens")).cast("long"))
    running = Window.partitionBy("src").orderBy("block_order")  # BLOCKS rows a source at most
    edge = blocks.withColumn("upto", F.sum("tokens").over(running)).join(sources.select("src", "rest"), "src").where("upto > rest and upto - tokens <= rest").groupBy("src").agg(F.min(F.struct("block_order", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))).alias("edge")).select("src", "edge.*")
    inside = Window.partitionBy("src").orderBy("doc_order", "doc_id")  # one block of a source
    cut = counted.join(edge, ["src", "block_order"]).withColumn("upto", F.sum("tokens").over(inside)).where("upto <= room").groupBy("src").agg(F.max(F.struct("doc_order", "doc_id")).alias("cut"))
    ready = sources.join(edge, "src", "left").join(cut, "src", "left").select("src", "weight", "repeats", "epochs", F.col("block_order").alias("edge_block"), F.col("cut.doc_order").alias("cut_order"), F.col("cut.doc_id").alias("cut_id"), F.col("rest"))
    return stored(ready, "mix-plan")


def realised(docs: DataFrame, chosen: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each time a document is read: row (a struct of all its columns), epoch (from 1), block, read_order within
    its epoch, and its source's weight and repeats.

    The plan has one row per source; whether it is broadcast is left to Spark's own check of its size.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source")
    keyed = _keys(whole, seed).join(chosen.withColumnRenamed("src", "plan_src"), F.col("src") == F.col("plan_src"))
    before = F.col("block_order") < F.col("edge_block")
    at_edge = (F.col("block_order") == F.col("edge_block")) & (F.struct(F.col("doc_order"), F.col("doc_id")) <= F.struct(F.col("cut_order"), F.col("cut_id"))) & F.col("cut_order").isNotNull()
    part = F.when((F.col("rest") > 0) & (before | at_edge), 1).otherwise(0)
    times = F.col("epochs") + part
    out = keyed.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    return out.select("row", "epoch", "block", F.xxhash64("block", F.lit(seed), "epoch").alias("read_order"), "weight", "repeats")


def tokens_of(text: str = "text") -> Column:
    """Words of a text."""
    return F.regexp_count(whole_text(text), F.lit(r"\S+"))


def mixed(docs: DataFrame, seed: int = SEED, **target) -> DataFrame:
    """The documents as the mix reads them, columns as before; a document read twice is there twice."""
    return realised(docs, plan(docs, tokens_of(), seed, **target), seed).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the mix reads it, with its source's weight and its place."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "source", "text")
    chosen = plan(docs, tokens_of())
    return realised(docs.drop("text"), chosen).select("row.doc_id", "row.source", "epoch", "block", "read_order", F.round("weight", 12).alias("weight"), "repeats")
