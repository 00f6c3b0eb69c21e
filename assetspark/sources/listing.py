"""Folders listed by tasks, level by level, with what couldn't be read as rows."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspark.sources.container import GPU, MAGIC, STREAM
from assetspark.sources.shared import stored

LISTED = "folder string, path string, name string, is_folder boolean, size long, error string"
BACKUP = "backup"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in each folder; a folder that can't be listed has one row of its own with the reason."""
    for batch in batches:
        rows = []
        for folder in batch.column(0).to_pylist():
            held = []
            try:
                with os.scandir(folder) as found:
                    for e in found:
                        inside = e.is_dir()
                        if inside and e.is_symlink():
                            continue
                        try:
                            held.append((folder, e.path, e.name, inside, None if inside else e.stat().st_size, None))
                        except OSError as error:
                            held.append((folder, e.path, e.name, inside, None, error.strerror))
            except OSError as error:
                held = [(folder, folder, os.path.basename(folder), True, None, error.strerror)]
            rows += held
        types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], LISTED.replace(",", "").split()[::2])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """LISTED: all files below root, and folders that couldn't be listed with their error; none in folders named backup.

    One job for each depth of the tree: the folders found are the next job's rows. A folder is listed by one task. Links
    to folders aren't followed.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    frontier, levels = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), []
    while True:
        level = stored(frontier.mapInArrow(_list, LISTED), "listing")
        levels.append(level.filter("NOT is_folder OR error IS NOT NULL"))
        below = level.filter(F.col("is_folder") & F.col("error").isNull() & (F.lower("name") != BACKUP)).select("path")
        if below.isEmpty():
            break
        frontier = below.repartition(spark.sparkContext.defaultParallelism, "path")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def candidates(files: DataFrame) -> DataFrame:
    """Of scan: folder, path, name, gpu_size, stream_size of files that have a companion and aren't one."""
    whole = files.filter("NOT is_folder")
    lower = F.lower("name")
    mine = whole.filter(~(lower.endswith(GPU) | lower.endswith(STREAM))).select("folder", "path", "name")
    for ending, size, how in ((GPU, "gpu_size", "inner"), (STREAM, "stream_size", "left")):
        beside = whole.filter(F.col("path").endswith(ending)).select(F.expr(f"left(path, length(path) - {len(ending)})").alias("path"), F.coalesce("size", F.lit(0)).alias(size))
        mine = mine.join(beside, "path", how)
    return mine.withColumn("stream_size", F.coalesce("stream_size", F.lit(0)))


def sniffed(found: DataFrame) -> DataFrame:
    """candidates with is_bundle, whether the first four bytes are the magic, and error where they can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[bool | None, str | None]] = []
            for path in batch.column("path").to_pylist():
                try:
                    with open(path, "rb") as f:
                        held.append((f.read(4) == MAGIC.to_bytes(4, "little"), None))
                except OSError as error:
                    held.append((None, error.strerror))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h[0] for h in held], pa.bool_()), pa.array([h[1] for h in held], pa.string())], [*batch.schema.names, "is_bundle", "error"])

    columns = ("folder", "path", "name", "gpu_size", "stream_size")
    return found.select(*columns).mapInArrow(run, "folder string, path string, name string, gpu_size long, stream_size long, is_bundle boolean, error string")


def discover(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(bundles below root: path, mod_name, file_name, relative_folders, gpu_size, stream_size; what couldn't be read: path, error).

    Unreadable are folders that can't be listed, and files with a companion, which are meant to be bundles, that can't
    be opened. A file without a companion is somebody else's and is never opened.
    """
    files = scan(spark, root)
    found = stored(sniffed(candidates(files)), "candidates")
    relative = F.expr(f"substring(folder, {len(root.rstrip('/')) + 2})")
    folders = F.filter(F.split(relative, "/"), lambda x: x != "")
    bundles = found.filter("is_bundle").select(
        "path", F.when(F.size(folders) > 0, F.element_at(folders, -1)).otherwise(F.col("name")).alias("mod_name"), F.col("name").alias("file_name"), folders.alias("relative_folders"), "gpu_size", "stream_size"
    )
    return bundles, files.filter("is_folder").select("path", "error").unionByName(found.filter("error IS NOT NULL").select("path", "error"))
