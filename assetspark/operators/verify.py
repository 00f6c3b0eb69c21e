"""Independent checks of a bundle's layout and headers. Each gives rows of issues: bundle, category, pos, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetspark import formats
from assetspark.functions.dialect import SPARK
from assetspark.operators import layout, ranges

ALIGNMENT = 64


def issues(df: DataFrame, *found: tuple[str, Column, Column]) -> DataFrame:
    """Rows of issues from (category, condition, detail), several for a row of df where several hold."""
    raised = [F.when(when, F.struct(F.lit(category).alias("category"), detail.cast("string").alias("detail"))) for category, when, detail in found]
    return df.select("bundle", "pos", F.explode(F.filter(F.array(*raised), lambda x: x.isNotNull())).alias("i")).select("bundle", "i.category", "pos", "i.detail")


def first_of(found: DataFrame, n: int = 3) -> DataFrame:
    """The first n issues of each bundle by place, with their rank k, and the number of all as n_issues."""
    counts = found.groupBy("bundle").agg(F.count("*").alias("n_issues"))
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("bundle").orderBy("pos", "category", "detail"))).filter(F.col("k") <= n)
    return ranked.join(counts, "bundle").select("bundle", "pos", "detail", F.col("k").cast("long").alias("k"), "n_issues")


def check_alignment(entries: DataFrame) -> DataFrame:
    return issues(entries, ("alignment", F.col("gpu_offset") % ALIGNMENT != 0, F.col("gpu_offset")))


def check_bounds(entries: DataFrame, lengths: DataFrame) -> DataFrame:
    """lengths: bundle, file_length."""
    end = F.col("gpu_offset") + F.col("size")
    return issues(entries.join(lengths, "bundle"), ("bounds", end > F.col("file_length"), end - F.col("file_length")))


def regions(entries: DataFrame) -> DataFrame:
    """The distinct regions of each bundle with the entry that names them first. Equal regions are aliases, not overlaps."""
    return entries.groupBy("bundle", "gpu_offset", "size").agg(F.min("pos").alias("pos"), F.count("*").alias("n_entries"))


def check_overlap(entries: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct regions that begin before the one before them ends; strict: before any earlier one ends."""
    before = ranges.max_before if strict else ranges.value_before
    placed = before(regions(entries), ["bundle"], ["gpu_offset", "pos"], F.col("gpu_offset") + F.col("size"), "before")
    return issues(placed, ("overlap", F.col("gpu_offset") < F.col("before"), F.col("before") - F.col("gpu_offset")))


def check_slack(entries: DataFrame, lengths: DataFrame) -> DataFrame:
    """Files that run on for an alignment or more past their last region."""
    last = regions(entries).groupBy("bundle").agg(F.max_by(F.col("gpu_offset") + F.col("size"), F.struct("gpu_offset", "pos")).alias("end"))
    slack = F.col("file_length") - F.col("end")
    return issues(last.join(lengths, "bundle").withColumn("pos", F.lit(None).cast("long")), ("slack", slack >= ALIGNMENT, slack))


def check_headers(textures: DataFrame) -> DataFrame:
    """Textures whose size, linear size or flags contradict their format. Needs linear_size and flags beside w, h, format, mips."""
    sized = textures.filter(F.expr(formats.is_sizable("format")) & F.col("has_dx10") & (F.col("stream_size") == 0))
    sized = sized.withColumn("expected", F.expr(SPARK.total(SPARK.chain("format", "w", "h", "mips")))).withColumn("level0", F.expr(SPARK.surface("format", "w", "h")))
    single = F.expr(formats.is_block("format")) & (F.col("mips") <= 1)
    return issues(
        sized, ("texture-size", F.col("expected") != F.col("gpu_size"), F.col("gpu_size") - F.col("expected")),
        ("texture-linearsize", single & (F.col("linear_size") != F.col("level0")), F.col("linear_size") - F.col("level0")), ("texture-flags", single & (F.expr("flags & 524288") == 0), F.col("flags")),
    )


def check_streamed(textures: DataFrame) -> DataFrame:
    """Streamed textures against their chains. A first resident level outside the chain ends the checks of an entry."""
    s = textures.filter(F.expr(formats.is_sizable("format")) & F.col("has_dx10") & (F.col("stream_size") > 0))
    s = s.withColumn("c", F.expr(SPARK.chain("format", "w", "h", "mips"))).withColumn("total", F.expr(SPARK.total("c")))
    inside = F.col("first_resident") < F.greatest("mips", F.lit(1))
    s = s.withColumn("tail", F.when(inside, F.expr(SPARK.total(SPARK.cut("c", "first_resident")))))
    return issues(
        s, ("stream-resident", ~inside, F.col("first_resident")), ("stream-size", inside & (F.col("stream_size") != F.col("total")), F.col("stream_size") - F.col("total")),
        ("stream-resident-size", inside & (F.col("gpu_size") != F.col("tail")), F.col("gpu_size") - F.col("tail")), ("stream-alignment", inside & (F.col("stream_offset") % ALIGNMENT != 0), F.col("stream_offset")),
        ("stream-bounds", inside & (F.col("stream_offset") + F.col("stream_size") > F.col("stream_length")), F.col("stream_offset") + F.col("stream_size") - F.col("stream_length")),
    )


def check_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Bundles with payloads in a companion that isn't there: one issue for each companion. files: path, of what there is."""
    need = entries.groupBy("bundle").agg(F.max(F.col("gpu_size") > 0).alias("gpu"), F.max(F.coalesce(F.col("stream_size") > 0, F.lit(False))).alias("stream"))
    wanted = need.select("bundle", F.explode(F.filter(F.array(F.when(F.col("gpu"), F.lit(".gpu_resources")), F.when(F.col("stream"), F.lit(".stream"))), lambda x: x.isNotNull())).alias("ending"))
    missing = wanted.withColumn("path", F.concat("bundle", "ending")).join(files.select("path"), "path", "left_anti")
    return missing.select("bundle", F.lit("missing-file").alias("category"), F.lit(None).cast("long").alias("pos"), F.col("ending").alias("detail"))


def check_companions(entries: DataFrame, lengths: DataFrame, stream_lengths: DataFrame) -> DataFrame:
    """check_files over the companions whose lengths could be taken."""
    there = lengths.select(F.concat("bundle", F.lit(".gpu_resources")).alias("path")).union(stream_lengths.select(F.concat("bundle", F.lit(".stream"))))
    return check_files(entries, there)


def check_texture_headers(textures: DataFrame, readable: Column | None = None, detail: Column | None = None) -> DataFrame:
    """Textures without a header that can be read, by default those without a width, or without a payload."""
    readable = F.col("w").isNotNull() if readable is None else readable
    return issues(textures, ("texture-header", ~readable | (F.col("gpu_size") == 0), F.col("name") if detail is None else detail))


def check_stream_tables(textures: DataFrame, tables: DataFrame) -> DataFrame:
    """Streamed textures whose level table differs from that of their format and size: the first bad level of each.

    tables: bundle, pos, level, level_size, next_offset, rest, as read from the prefixes. A level that is missing differs.
    """
    key = ["bundle", "pos", "level"]
    right = layout.level_table(textures.filter(F.expr(formats.is_sizable("format")) & F.col("has_dx10") & (F.col("stream_size") > 0)))
    columns = ["level_size", "next_offset", "rest"]
    found = tables.select(*key, *(F.col(c).alias(f"found_{c}") for c in columns))
    bad = right.join(found, key, "left").filter(~F.expr(" AND ".join(f"({c} <=> found_{c})" for c in columns)))
    first = bad.groupBy("bundle", "pos").agg(F.min("level").alias("level"))
    return first.select("bundle", F.lit("stream-table").alias("category"), "pos", F.col("level").cast("string").alias("detail"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a rewrite must not touch: entries, CPU payloads and the data of all but textures, matched by place."""
    columns = ["type_name", "file_id", "cpu_offset", "cpu_size", "prefix_id", "size", "hash"]
    b = before.select("bundle", "pos", *(F.col(c).alias(f"b_{c}") for c in columns))
    a = after.select("bundle", "pos", *(F.col(c).alias(f"a_{c}") for c in columns))
    z = b.join(a, ["bundle", "pos"], "full_outer")
    counts = z.groupBy("bundle").agg(F.count("b_file_id").alias("nb"), F.count("a_file_id").alias("na"))
    uneven = issues(counts.withColumn("pos", F.lit(None).cast("long")), ("entry-count", F.col("nb") != F.col("na"), F.col("na") - F.col("nb")))
    even = z.join(counts.filter("nb = na").select("bundle"), "bundle", "left_semi")
    differ = lambda c: F.col(f"b_{c}") != F.col(f"a_{c}")
    same = ~(differ("file_id") | differ("type_name"))
    plain = same & (F.col("a_type_name") != "texture") & (F.col("a_size") > 0)
    found = issues(
        even, ("entry-identity", ~same, F.col("a_file_id")), ("cpu-payload", same & (differ("cpu_offset") | differ("cpu_size")), F.col("a_cpu_offset")),
        ("texture-prefix", same & (F.col("a_type_name") == "texture") & differ("prefix_id"), F.col("a_prefix_id")), ("passthrough-size", plain & differ("size"), F.col("a_size") - F.col("b_size")),
        ("passthrough-data", plain & ~differ("size") & differ("hash"), F.col("a_hash")),
    )
    return uneven.unionByName(found)


def report(entries: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per bundle: distinct regions, aliased entries, bytes covered and padding."""
    r = regions(entries).groupBy("bundle").agg(F.count("*").alias("n_regions"), (F.sum("n_entries") - F.count("*")).alias("n_aliased"), F.sum("size").alias("covered"))
    return r.join(lengths, "bundle").select("bundle", "n_regions", "n_aliased", "covered", (F.col("file_length") - F.col("covered")).alias("padding"))
