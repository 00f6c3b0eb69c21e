"""Sharing and placing payloads: first-occurrence dedup, aligned packing, stream layout, level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetspark.functions.dialect import SPARK
from assetspark.operators import ranges

ALIGNMENT = 64


def mark_first(entries: DataFrame, key: list[str], order: list[str], by: str = "bundle") -> DataFrame:
    """entries with is_first: whether an entry is the first of its bundle to hold the payload that key names, and first: that one's place in the order.

    The first of each payload is found by a minimum, combined before the shuffle, so a payload of many entries is no task's burden.
    """
    names = [by, *key]
    first = entries.groupBy(*names).agg(F.min(F.struct(*order)).alias("first"))
    first = first.select(*(F.col(c).alias(f"__f_{c}") for c in names), "first")
    marked = entries.join(first, [entries[c].eqNullSafe(first[f"__f_{c}"]) for c in names])
    return marked.withColumn("is_first", F.struct(*order) == F.col("first")).drop("__first", *(f"__f_{c}" for c in names))


def pack(entries: DataFrame, key: list[str] | None = None, order: tuple[str, ...] = ("gpu_offset", "pos"), size: str = "size", by: str = "bundle") -> DataFrame:
    """entries with is_first and new_offset, every start aligned; with a key, later entries of a payload share the first one's place.

    An aligned start plus an aligned size is an aligned start, so a start is the sum of the aligned sizes before it. The
    order is one of whole numbers that tells the entries of a bundle apart.
    """
    ordered = [*order]
    if not key:
        placed = entries.withColumn("is_first", F.lit(True))
        return ranges.sum_before(placed, [by], ordered, F.expr(SPARK.align(size)), "new_offset")
    marked = mark_first(entries, key, ordered, by)
    names = [by, *key]
    firsts = ranges.sum_before(marked.filter("is_first").select(*names, *(c for c in [*ordered, size] if c not in names)), [by], ordered, F.expr(SPARK.align(size)), "new_offset")
    firsts = firsts.select(*(F.col(c).alias(f"__f_{c}") for c in names), "new_offset")
    return marked.join(firsts, [marked[c].eqNullSafe(firsts[f"__f_{c}"]) for c in names]).drop("first", *(f"__f_{c}" for c in names))


def packed_size(entries: DataFrame, key: list[str] | None = None, order: tuple[str, ...] = ("gpu_offset", "pos"), size: str = "size", by: str = "bundle") -> DataFrame:
    """Per bundle the length of the packed file: where its last payload ends, which is not padded."""
    placed = pack(entries, key, order, size, by).filter("is_first")
    return placed.groupBy(by).agg(F.max_by(F.col("new_offset") + F.col(size), F.struct("new_offset", *order)).alias("packed_size"))


def level_table(textures: DataFrame) -> DataFrame:
    """One row per mip level: its size, where the next begins and what is left; the last level has zeros."""
    levels = textures.withColumn("c", F.expr(SPARK.chain("format", "w", "h", "mips"))).select("bundle", "pos", "mips", "w", "h", F.expr(SPARK.total("c")).alias("total"), F.posexplode("c").alias("level", "level_size"))
    w = Window.partitionBy("bundle", "pos").orderBy("level")
    levels = levels.withColumn("upto", F.sum("level_size").over(w))
    last = F.col("level") == F.col("mips") - 1
    return levels.select(
        "bundle", "pos", F.col("level").cast("long").alias("level"), F.expr(f"greatest(1, {SPARK.shr('w', 'level')})").alias("level_w"), F.expr(f"greatest(1, {SPARK.shr('h', 'level')})").alias("level_h"),
        "level_size", F.when(last, 0).otherwise(F.col("upto")).alias("next_offset"), F.when(last, 0).otherwise(F.col("total") - F.col("upto")).alias("rest"),
    )
