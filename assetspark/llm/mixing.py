"""Mixing sources to target weights by entropy balancing.

The rates closest in entropy to taking each document once, under one constraint on words for each source, are
exp(lambda * size / mean size) with one multiplier for each source: the minimiser of a convex dual. Rates depend on a
document's source and size alone, so the corpus is summed up to (source, size) counts once and distributed Newton
iterations run on those. Rates are bounded by the greatest number of copies; the rest falls on the others.

Copies: in each source the sizes are taken from the largest to the smallest, each group's words rounded to whole copies
and the remainder carried on, so a source misses its target by about its smallest document. The copies of a group are
dealt to its documents evenly, the odd ones by a hash of doc_id, in buckets, so no group meets in one task.

Null texts have size 0 and are never taken. A null source is a source of its own, the last. Rows that repeat a doc_id
are documents of their own. An empty table gives an empty result; a corpus without words has targets of 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetspark.llm.common import settle

MOST_COPIES = 3
ROUNDS = 40
BUCKETS = 64


def n_words(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++"))).cast("long")


def source_targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size -> with weight and target. sources has a row for each source.

    Water filling: a source is full if at the common level its weight asks for more than most times its size; with the
    sources in order of size over weight, that is a prefix, found by running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    s = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("all_words", F.sum("source_size").over(whole).cast("double")).withColumn("all_weights", F.sum("weight").over(whole))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("all_words") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("full", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))  # that of the first that is not full: it falls from there on
    return s.select("source", "source_size", "weight", F.when(F.col("full") | F.col("level").isNull(), (most * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _rate(multiplier: Column, scaled: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(multiplier * scaled, F.lit(50.0))))


def balance(groups: DataFrame, targets: DataFrame, most: int = MOST_COPIES, rounds: int = ROUNDS, close: float = 1e-9) -> DataFrame:
    """(source, size, n) and (source, target) -> with rate: Newton steps on the dual, inside a bracket that bisects where a step leaves it."""
    sized = groups.filter("size > 0").withColumnRenamed("source", "of")
    stats = sized.groupBy("of").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    t = targets.join(stats, F.expr("source <=> of"))
    state = settle(t.select("source", "target", "mean", F.lit(0.0).alias("m"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), F.lit(False).alias("done")))
    for _ in range(rounds):
        joined = sized.join(state, F.expr("source <=> of"))
        scaled = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("m") * scaled, F.lit(50.0)))
        words = F.col("size") * F.col("n")
        sums = joined.groupBy("source", "target", "mean", "m", "low", "high", "done").agg(F.sum(words * F.least(F.lit(float(most)), raw)).alias("got"), F.sum(F.when(raw < most, words * raw * scaled).otherwise(0.0)).alias("slope"))
        low = F.when(F.col("got") < F.col("target"), F.col("m")).otherwise(F.col("low"))
        high = F.when(F.col("got") >= F.col("target"), F.col("m")).otherwise(F.col("high"))
        step = F.col("m") + (F.col("target") - F.col("got")) / F.when(F.col("slope") > 0, F.col("slope")).otherwise(F.lit(1e-300))
        next_m = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= close * F.greatest(F.col("target"), F.lit(1.0))) | (high - low < 1e-12)
        state = settle(sums.select("source", "target", "mean", F.when(done, F.col("m")).otherwise(next_m).alias("m"), low.alias("low"), high.alias("high"), done.alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            break
    joined = groups.join(state.withColumnRenamed("source", "of"), F.expr("source <=> of"), "left")
    return joined.select("source", "size", "n", "target", F.when(F.col("size") > 0, _rate(F.col("m"), F.col("size") / F.col("mean"), most)).otherwise(0.0).alias("rate"))


def _whole_copies(most: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("size", ascending=False, kind="stable")
        carried, copies = 0.0, []
        for size, n, rate in zip(g["size"], g["n"], g["rate"], strict=True):
            wanted = size * n * rate + carried
            c = min(most * n, max(0, round(wanted / size))) if size else 0
            carried = wanted - c * size
            copies.append(c)
        return g.assign(copies=copies)[["source", "size", "n", "rate", "copies"]]

    return run


def mix(docs: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the document, 0 to most)."""
    sized = docs.withColumn("size", n_words(F.col("text"))).withColumn("__bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    by_bucket = settle(sized.groupBy("source", "size", "__bucket").agg(F.count("*").alias("n")))
    groups = settle(by_bucket.groupBy("source", "size").agg(F.sum("n").alias("n")))
    targets = settle(source_targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), most))
    rated = balance(groups, targets, most)
    whole = rated.select("source", "size", "n", "rate").groupBy("source").applyInPandas(_whole_copies(most), "source string, size long, n long, rate double, copies long")
    # The odd copies of a (source, size) group fall on its buckets by running sums, in a bucket on the first by hash.
    w = Window.partitionBy("source", "size").orderBy("__bucket")
    whole = whole.select(F.col("source").alias("of"), F.col("size").alias("z"), F.col("n").alias("in_group"), "rate", "copies")
    b = by_bucket.join(whole, F.expr("source <=> of AND size = z"))
    b = b.withColumn("upto", F.sum("n").over(w)).withColumn("odd", F.expr("copies % in_group"))
    b = b.select("source", "size", "__bucket", "rate", F.expr("copies div in_group").alias("each"), F.expr("(upto * odd) div in_group - ((upto - n) * odd) div in_group").alias("extra"))
    b = settle(b.join(targets.select(F.col("source").alias("of"), "source_size", "target"), F.expr("source <=> of")))
    b = b.select("of", F.col("size").alias("z"), F.col("__bucket").alias("b"), "source_size", "target", "rate", "each", "extra")
    return sized.join(b, F.expr("source <=> of AND size = z AND __bucket = b")).drop("of", "z", "b")


def mixed(docs: DataFrame, most: int = MOST_COPIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, and the columns of keep."""
    keyed = mix(docs.select("doc_id", "source", "text", *keep), most).drop("text")
    w = Window.partitionBy("source", "size", "__bucket").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", *keep)
    copies = F.col("each") + F.when(F.row_number().over(w) <= F.col("extra"), 1).otherwise(0)
    return keyed.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "rate", "copies", *keep)


def mix_digest(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")
