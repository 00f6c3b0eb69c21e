"""Bundles among files: which are candidates, what lies beside them, and the tree of their folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GPU, STREAM = ".gpu_resources", ".stream"
BACKUP = "backup"


def folders(path: str = "path"):
    return F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: x != "")


def without_backups(files: DataFrame) -> DataFrame:
    """Files that have no folder named backup, in any case, above them."""
    return files.filter(~F.exists(folders(), lambda x: F.lower(x) == BACKUP))


def candidates(files: DataFrame) -> DataFrame:
    """Files that aren't companions themselves and have a companion."""
    lower = F.lower("path")
    mine = files.filter(~(lower.endswith(GPU) | lower.endswith(STREAM))).withColumn("__gpu", F.concat("path", F.lit(GPU)))
    return mine.join(files.select(F.col("path").alias("__gpu")), "__gpu", "left_semi").drop("__gpu")


def describe(files: DataFrame) -> DataFrame:
    """Bundles: path, mod_name, file_name, relative_folders, gpu_size, stream_size (0 if there is none)."""
    found = candidates(without_backups(files))
    beside = lambda suffix, name: files.select(F.col("path").alias(f"__{name}"), F.col("size").alias(name))
    found = found.withColumn("__gpu_size", F.concat("path", F.lit(GPU))).withColumn("__stream_size", F.concat("path", F.lit(STREAM)))
    for suffix, name in ((GPU, "gpu_size"), (STREAM, "stream_size")):
        found = found.join(beside(suffix, name), f"__{name}", "left")
    f = folders()
    file_name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", F.when(F.size(f) > 0, F.element_at(f, -1)).otherwise(file_name).alias("mod_name"), file_name.alias("file_name"), f.alias("relative_folders"), F.coalesce("gpu_size", F.lit(0)).cast("long").alias("gpu_size"), F.coalesce("stream_size", F.lit(0)).cast("long").alias("stream_size"))


def in_order(bundles: DataFrame) -> DataFrame:
    """By folders, then file name, without regard to case."""
    return bundles.orderBy(F.upper(F.array_join("relative_folders", "/")), F.upper("file_name"), "path")


def tree_nodes(bundles: DataFrame) -> DataFrame:
    """One row per folder at any depth: key, name, parent (null at the top), depth, bundles and bytes below it."""
    keys = F.transform(F.sequence(F.lit(1), F.size("relative_folders")), lambda n: F.slice("relative_folders", F.lit(1), n))
    each = bundles.filter(F.size("relative_folders") > 0).select(F.explode(keys).alias("k"), "gpu_size", "stream_size")
    rolled = each.groupBy(F.array_join("k", "/").alias("key"), F.size("k").alias("depth"), F.element_at("k", -1).alias("name")).agg(F.count("*").alias("n_bundles"), F.sum(F.col("gpu_size") + F.col("stream_size")).alias("bytes"))
    parent = F.when(F.col("depth") > 1, F.expr("left(key, length(key) - length(name) - 1)"))
    return rolled.select("key", "name", parent.alias("parent"), F.col("depth").cast("long").alias("depth"), "n_bundles", "bytes")


def absorbed(bundles: DataFrame) -> DataFrame:
    """Per bundle how its line reads: the folder's name where the bundle is all that a folder holds, else its file name."""
    nodes = tree_nodes(bundles)
    inner = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_folders"))
    own = bundles.withColumn("key", F.array_join("relative_folders", "/"))
    direct = own.groupBy("key").agg(F.count("*").alias("n_direct"))
    alone = (F.col("n_direct") == 1) & F.col("n_folders").isNull() & (F.size("relative_folders") > 0)
    named = own.join(direct, "key").join(inner, "key", "left")
    owner = F.when(alone & (F.size("relative_folders") == 1), F.lit(None)).otherwise(F.get("relative_folders", F.lit(0)))
    return named.select("path", alone.alias("absorbed"), F.when(alone, F.element_at(F.when(F.size("relative_folders") > 0, F.col("relative_folders")).otherwise(F.array("file_name")), -1)).otherwise(F.col("file_name")).alias("title"), owner.alias("owner"))


def tick_states(bundles: DataFrame) -> DataFrame:
    """Per folder 'all', 'none' or 'some' of the bundles below it ticked. Needs a boolean column ticked."""
    keys = F.transform(F.sequence(F.lit(1), F.size("relative_folders")), lambda n: F.array_join(F.slice("relative_folders", F.lit(1), n), "/"))
    each = bundles.filter(F.size("relative_folders") > 0).select(F.explode(keys).alias("key"), "ticked")
    state = F.when(F.bool_and("ticked"), "all").when(~F.bool_or("ticked"), "none").otherwise("some")
    return each.groupBy("key").agg(state.alias("state"))
