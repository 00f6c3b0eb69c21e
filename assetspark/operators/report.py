"""Plans and verifications as lines of text: frames (bundle, part, pos, line), written in order from their partitions."""

from __future__ import annotations

from functools import reduce
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetspark import formats
from assetspark.functions.dialect import SPARK
from assetspark.operators import plan as plans

LINE = ["bundle", "part", "pos", "line"]


def human(column: str) -> Column:
    return F.expr(SPARK.human_bytes(column).replace("{string}", SPARK.string))


def _name(column: str) -> Column:
    return F.expr(SPARK.text(formats.format_name(column)))


def _lines(df: DataFrame, part: int, line: Column, pos: str | Column = "pos") -> DataFrame:
    return df.select("bundle", F.lit(part).alias("part"), (F.col(pos) if isinstance(pos, str) else pos).cast("long").alias("pos"), line.alias("line"))


def detail() -> Column:
    """What a surface holds, and what the loss of halving it would be where it is really made smaller and has detail."""
    values = lambda names: F.concat_ws(",", *(F.col(c).cast("string") for c in names))
    content = F.when(F.col("solid"), F.concat(F.lit("one-value "), values("rgba"))).when(F.col("flat_alpha"), F.concat(F.lit("one-colour "), values("rgb"))).when(F.col("alpha_detail"), "transparent").otherwise("opaque")
    content = F.when(F.col("solid").isNull(), "unseen").otherwise(content)
    smaller = (F.col("to_w") != F.col("w")) & ~F.coalesce("solid", F.lit(False))
    return F.when(smaller, F.concat(content, F.lit("; halving "), F.expr(SPARK.verdict("psnr")))).otherwise(content)


def plan_lines(entries: DataFrame, plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each bundle: its entries by type, its textures with what becomes of them, those left as they are, what is shared, and the totals.

    sizes: library.predicted.
    """
    census = entries.groupBy("bundle", "type_name").agg(F.count("*").alias("n"))
    count = entries.groupBy("bundle").agg(F.count("*").alias("n"), F.countDistinct("type_name").alias("types"))
    dims = F.concat_ws("x", "w", "h")
    to = F.concat_ws("x", "to_w", "to_h")
    planned = plan.filter("include").withColumn("dims", F.when(dims == to, dims).otherwise(F.concat(dims, F.lit("->"), to)))
    left = plan.filter("NOT include").withColumn("reason", F.when(F.col("outcome") == "planned", "excluded").otherwise(F.col("outcome")))
    counts = plans.totals(plan)
    # Entries that repeat a payload: of each payload of several places all but one.
    shared = entries.filter("gpu_size > 0").groupBy("bundle", "hash", "gpu_size").agg(F.countDistinct("gpu_offset").alias("n")).filter("n > 1")
    shared = shared.groupBy("bundle").agg(F.sum(F.col("n") - 1).alias("repeats"), F.sum((F.col("n") - 1) * F.col("gpu_size")).alias("wasted"))
    grown = counts.withColumn("moved", human("added_stream_bytes"))
    first = F.lit(0)
    return reduce(DataFrame.unionByName, (
        _lines(count, 0, F.format_string("%s: %d entries, %d types", "bundle", "n", "types"), first),
        _lines(census, 1, F.format_string("  %4d x %s", "n", "type_name"), first),
        _lines(planned, 2, F.format_string("%-16s %-18s %-20s %10s -> %10s  %s", "name", "dims", _name("to_format"), human("gpu_size"), human("predicted_size"), detail())),
        _lines(left, 3, F.format_string("%-16s %-30s skipped: %s", "name", F.concat_ws(" ", dims, _name("format")), "reason")),
        _lines(shared, 4, F.format_string("duplicates: %d payloads are held again, %s", "repeats", human("wasted")), first),
        _lines(grown.filter("n_generated > 0"), 5, F.format_string("mipmaps: %d textures get a chain", "n_generated"), first),
        _lines(grown.filter("n_streamed > 0"), 6, F.format_string("streaming: %d textures move their chain, %s on disk", "n_streamed", "moved"), first),
        _lines(sizes, 7, F.format_string("disk  %10s -> %10s", human("file_before"), human("file_after")), first),
        _lines(sizes, 8, F.format_string("gpu   %10s -> %10s", human("resident_before"), human("resident_after")), first),
    ))


def issue_lines(issues: DataFrame) -> DataFrame:
    return _lines(issues, 20, F.concat(F.lit("  ["), F.col("category"), F.lit("] "), F.coalesce(F.col("detail"), F.lit(""))), F.coalesce("pos", F.lit(-1)))


def applied_lines(applied: DataFrame) -> DataFrame:
    """What was written, from apply.apply_plan."""
    share = F.when(F.col("bytes_before") > 0, F.col("bytes_after") / F.col("bytes_before")).otherwise(1.0)
    line = F.format_string("%s: %s -> %s (%.1f%%), %d textures encoded or cut, %d payloads shared", "bundle", human("bytes_before"), human("bytes_after"), share * 100, "n_planned", "n_shared")
    return _lines(applied, 10, line, F.lit(0))


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*LINE)


def stream(lines: DataFrame, out: TextIO) -> int:
    """The lines in order to an open file, a partition at a time; how many there were."""
    n = 0
    for row in ordered(lines).select("line").toLocalIterator(prefetchPartitions=True):
        out.write(row["line"] + "\n")
        n += 1
    return n


def save(lines: DataFrame, folder: str) -> None:
    """The lines in order as text files, whose names sort as the lines do; written by tasks."""
    ordered(lines).select("line").write.text(folder)
