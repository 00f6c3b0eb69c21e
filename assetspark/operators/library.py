"""Folders of bundles from end to end: scan, analyse, plan, optimise, verify."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspark.functions import headers
from assetspark.operators import codec, layout, verify
from assetspark.operators import plan as plans
from assetspark.operators.apply import apply_plan
from assetspark.operators.plan import Options
from assetspark.progress import Progress, Silent
from assetspark.sources import listing
from assetspark.sources.container import GPU, STREAM, ContainerError, entries_at, file_lengths, level_tables, with_payload_hash
from assetspark.sources.shared import stored
from assetspark.sources.writer import PieceSink

#: What becomes of a plan's texture, beside where it is and what it was.
CHOICE = ["to_format", "to_w", "to_h", "to_mips", "drop_levels", "resident", "generates"]


def entries_of(spark: SparkSession, root: str) -> DataFrame:
    """The entries of all bundles under root, or of one bundle, with the hash of each payload, as a table. A bundle that can't be parsed is an error."""
    if os.path.isfile(root):
        bundles = spark.createDataFrame([(root,)], "bundle string")
    else:
        bundles = listing.discover(spark, root)[0].select(F.col("path").alias("bundle"))
    entries, errors = entries_at(bundles.repartition(spark.sparkContext.defaultParallelism, "bundle"))
    if bad := errors.first():
        raise ContainerError(f"{bad['bundle']}: {bad['error']}")
    return stored(with_payload_hash(entries), "entries")


def textures_of(entries: DataFrame) -> DataFrame:
    """Entries that are textures with a header and a payload, vec_id being the name of what they show."""
    key = F.concat_ws(":", "hash", "format", "w", "h")
    return entries.filter("type_name = 'texture' AND w IS NOT NULL AND gpu_size > 0").withColumn("vec_id", key)


def analyse(entries: DataFrame) -> DataFrame:
    """tex_id, statistics, reason: of the first level of each distinct surface that a plan may look at."""
    rows = plans.rules.apply(textures_of(entries), plans.rules.classify(plans.SPARK)).filter("unsupported IS NULL")
    place = {"key": F.col("vec_id"), "source": F.concat("bundle", F.lit(GPU)), "source_at": F.col("gpu_offset"), "source_size": F.col("gpu_size")}
    return stored(codec.analyse_payloads(rows.withColumns(place)), "analysis").withColumnRenamed("key", "tex_id")


def plan_of(entries: DataFrame, options: Options = Options(), analysis: DataFrame | None = None) -> DataFrame:
    """plan.build over the textures of entries, with recommended targets kept beside those that may be edited."""
    built = plans.build(textures_of(entries), analyse(entries) if analysis is None else analysis, options)
    return stored(plans.with_recommendation(built), "plan")


def predicted(entries: DataFrame, plan: DataFrame, share: bool = True) -> DataFrame:
    """Per bundle file_before (the companion's length), file_after, resident_before, resident_after, worth_writing.

    Payloads are shared by content and target, so encodings that happen to be equal may make the file smaller still.
    """
    chosen = plan.filter("include").select("bundle", "pos", F.col("predicted_size").alias("planned_size"), *CHOICE)
    rows = entries.filter("gpu_size > 0").join(chosen, ["bundle", "pos"], "left").withColumn("size", F.coalesce("planned_size", "gpu_size"))
    after = layout.packed_size(rows, ["hash", "w", "h", "format", *CHOICE, "size"] if share else None)
    lengths = file_lengths(entries.select("bundle").distinct())
    sums = rows.groupBy("bundle").agg(F.sum("gpu_size").alias("resident_before"), F.sum("size").alias("resident_after"))
    out = sums.join(after.withColumnRenamed("packed_size", "file_after"), "bundle").join(lengths.select("bundle", F.col("file_length").alias("file_before")), "bundle")
    return out.withColumn("worth_writing", (F.col("file_after") < F.col("file_before")) | (F.col("resident_after") < F.col("resident_before")))


def optimise(entries: DataFrame, plan: DataFrame, root: str, out_root: str, share: bool = True, backend: str = "auto", quality: str = "balanced", progress: Progress | Silent = Silent()) -> DataFrame:
    """Writes the bundles that a plan makes smaller, on disk or resident; the others are left out. See apply.apply_plan."""
    worth = stored(predicted(entries, plan, share).filter("worth_writing").select("bundle"), "worth")
    return apply_plan(entries.join(worth, "bundle", "left_semi"), plan.join(worth, "bundle", "left_semi"), root, out_root, share, backend, quality, progress)


def verify_library(spark: SparkSession, root: str, original: str | None = None) -> DataFrame:
    """bundle, category, pos, detail: every issue of the bundles under root, read again; with original also against those of the same path there."""
    entries = entries_of(spark, root).withColumn("size", F.col("gpu_size"))
    backed = entries.filter("gpu_size > 0")
    bundles = entries.select("bundle").distinct()
    lengths, stream_lengths = file_lengths(bundles), file_lengths(bundles, STREAM).select("bundle", F.col("file_length").alias("stream_length"))
    textures = entries.filter("type_name = 'texture'").join(stream_lengths, "bundle", "left")
    streamed = textures.filter("w IS NOT NULL")
    found = [
        verify.check_companions(entries, lengths, stream_lengths), verify.check_alignment(backed), verify.check_bounds(backed, lengths), verify.check_overlap(backed), verify.check_slack(backed, lengths),
        verify.check_texture_headers(textures), verify.check_headers(streamed), verify.check_streamed(streamed), verify.check_stream_tables(streamed, level_tables(streamed)),
    ]
    if original is not None:
        found.append(verify.compare(below(entries_of(spark, original).withColumn("size", F.col("gpu_size")), original), below(entries, root)).withColumn("bundle", F.concat(F.lit(_folder(root)), "bundle")))
    return stored(reduce(DataFrame.unionByName, (f.withColumn("pos", F.col("pos").cast("long")) for f in found)), "issues")


def _folder(root: str) -> str:
    return (root if os.path.isdir(root) else os.path.dirname(root)).rstrip("/") + "/"


def below(entries: DataFrame, root: str) -> DataFrame:
    """entries with their bundles named from the root."""
    return entries.withColumn("bundle", F.expr(f"substring(bundle, {len(_folder(root)) + 1})"))


def override(plan: DataFrame, edits: DataFrame) -> DataFrame:
    """plan with edits (bundle, pos, and any of include, to_format, to_w, to_h; null: as it is) laid over it, sizes predicted anew.

    Only textures of a single level take another format or size: a chain is sliced, never encoded.
    """
    names = [c for c in ("include", "to_format", "to_w", "to_h") if c in edits.columns]
    named = edits.select("bundle", "pos", *(F.col(c).alias(f"__{c}") for c in names))
    free = F.col("mips") <= 1
    joined = plan.join(named, ["bundle", "pos"], "left")
    for c in names:
        new: Column = F.col(f"__{c}") if c == "include" else F.when(free, F.col(f"__{c}"))
        joined = joined.withColumn(c, F.coalesce(new, c))
    return plans.repredicted(joined.drop(*(f"__{c}" for c in names)))


def export_images(entries: DataFrame, folder: str) -> DataFrame:
    """Writes each texture as an image file of its own, <bundle's name>/<texture's name>.dds in the folder; bundle, pos, file of each.

    A file is the header of the texture, read by the task that writes it, and the payload, copied from its place. Of a
    streamed texture the stream file's payload is taken, which has all levels.
    """
    spark = entries.sparkSession
    spark.dataSource.register(PieceSink)
    streamed = F.col("stream_size") > 0
    named = textures_of(entries).select("bundle", "pos", F.concat_ws("/", F.element_at(F.split("bundle", "/"), -1), F.concat("name", F.lit(".dds"))).alias("file"), "cpu_offset", "prefix", "has_dx10", streamed.alias("streamed"), "gpu_offset", "gpu_size", "stream_offset", "stream_size")
    header = F.when(F.col("has_dx10"), headers.CORE + headers.EXTENSION).otherwise(headers.CORE).cast("long")
    held = named.withColumn("header", header)
    piece = lambda at, size, source, source_at: held.select(F.col("file").alias("target"), F.lit(0).alias("rank"), F.lit(False).alias("sequence"), at.alias("at"), size.alias("size"), F.lit(None).cast("binary").alias("payload"), source.alias("source"), source_at.alias("source_at"))
    first = piece(F.lit(0).cast("long"), F.col("header"), F.col("bundle"), F.col("cpu_offset") + F.col("prefix"))
    ending = F.when(F.col("streamed"), STREAM).otherwise(GPU)
    rest = piece(F.col("header"), F.when(F.col("streamed"), F.col("stream_size")).otherwise(F.col("gpu_size")), F.concat("bundle", ending), F.when(F.col("streamed"), F.col("stream_offset")).otherwise(F.col("gpu_offset")))
    first.unionByName(rest).write.format("pieces").mode("append").save(folder)
    return named.select("bundle", "pos", "file")
