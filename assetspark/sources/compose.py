"""Containers made of rows: tables, records and payloads written each to its place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetspark.functions.records import Records
from assetspark.operators import layout, ranges
from assetspark.sources.container import ENTRY_BYTES, ENTRY_DTYPE, GPU, HEADER_BYTES, MAGIC, TYPE_BYTES, TYPE_DTYPE
from assetspark.sources.shared import stored
from assetspark.sources.writer import PieceSink

FIELDS = ("file_id", "type_id", "cpu_offset", "gpu_offset", "cpu_size", "gpu_size", "index")


def placed(rows: DataFrame) -> DataFrame:
    """rows (bundle, pos, file_id, type_id, cpu_size, gpu_size) with index, cpu_offset, gpu_offset, n_files, n_types: entries in the order of pos, payloads aligned."""
    counts = rows.groupBy("bundle").agg(F.count("*").alias("n_files"), F.countDistinct("type_id").alias("n_types"))
    held = ranges.sum_before(rows, ["bundle"], ["pos"], F.lit(1), "index")
    held = ranges.sum_before(held, ["bundle"], ["pos"], F.col("cpu_size"), "cpu_before")
    held = layout.pack(held, order=("pos",), size="gpu_size").withColumnRenamed("new_offset", "gpu_offset").drop("is_first")
    tables = HEADER_BYTES + TYPE_BYTES * F.col("n_types") + ENTRY_BYTES * F.col("n_files")
    return held.join(counts, "bundle").withColumn("cpu_offset", tables + F.col("cpu_before")).drop("cpu_before")


def _records(width: int, places: dict[str, tuple[int, int]]):
    """Batches of (target, at, fields) -> pieces, each a record of zeros with its fields put in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record = Records(pa.array([bytes(width)] * batch.num_rows, pa.binary()))
            for name, (at, size) in places.items():
                record.put(at, size, batch.column(name).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("target"), batch.column("at"), record.column()], ["target", "at", "payload"])

    return run


def _pieces(df: DataFrame, rank: int) -> DataFrame:
    return df.select("target", F.lit(rank).alias("rank"), F.lit(False).alias("sequence"), F.col("at").cast("long").alias("at"), F.octet_length("payload").cast("long").alias("size"), "payload", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("source_at"))


def compose(rows: DataFrame, folder: str) -> None:
    """Writes containers: rows (bundle, the path in the folder; pos; file_id, type_id as longs of the same bits; cpu and payload as binary).

    Only ids and sizes are brought into order; payloads go from their tasks to their places.
    """
    rows.sparkSession.dataSource.register(PieceSink)
    sizes = rows.select("bundle", "pos", "file_id", "type_id", F.octet_length("cpu").cast("long").alias("cpu_size"), F.octet_length("payload").cast("long").alias("gpu_size"))
    where = stored(placed(sizes), "composed")
    schema = "target string, at long, payload binary"
    heads = where.groupBy("bundle").agg(F.first("n_types").alias("n_types"), F.first("n_files").alias("n_files")).select(F.col("bundle").alias("target"), F.lit(0).cast("long").alias("at"), F.lit(MAGIC).cast("long").alias("magic"), "n_types", "n_files")
    types = where.groupBy("bundle", "type_id").agg(F.count("*").alias("count"))
    types = types.select(F.col("bundle").alias("target"), (HEADER_BYTES + TYPE_BYTES * (F.row_number().over(Window.partitionBy("bundle").orderBy("type_id")) - 1)).cast("long").alias("at"), "type_id", "count")
    entries = where.select(F.col("bundle").alias("target"), (HEADER_BYTES + TYPE_BYTES * F.col("n_types") + ENTRY_BYTES * F.col("index")).alias("at"), *FIELDS)
    of = lambda dtype, names: {n: (dtype.fields[n][1], dtype.fields[n][0].itemsize) for n in names}
    held = rows.select("bundle", "pos", "cpu", "payload").join(where.select("bundle", "pos", "cpu_offset", "gpu_offset"), ["bundle", "pos"])
    pieces = [
        heads.mapInArrow(_records(HEADER_BYTES, {"magic": (0, 4), "n_types": (4, 4), "n_files": (8, 8)}), schema),
        types.mapInArrow(_records(TYPE_BYTES, of(TYPE_DTYPE, ("type_id", "count"))), schema),
        entries.mapInArrow(_records(ENTRY_BYTES, of(ENTRY_DTYPE, FIELDS)), schema),
        held.filter(F.octet_length("cpu") > 0).select(F.col("bundle").alias("target"), F.col("cpu_offset").alias("at"), F.col("cpu").alias("payload")),
    ]
    gpu = held.select(F.concat("bundle", F.lit(GPU)).alias("target"), F.col("gpu_offset").alias("at"), "payload")
    out = _pieces(gpu, 0)
    for p in pieces:
        out = out.unionByName(_pieces(p, 1))
    out.write.format("pieces").mode("append").save(folder)
