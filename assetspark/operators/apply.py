"""Applying a plan: bundles written anew with encoded, sliced, shared and aligned payloads, patched tables and headers.

Every payload of the result is a range of an old file or an encoding. Ranges (payloads kept, chains cut, tails left
resident) travel as places and sizes and are copied by the tasks that write them; encodings are made once for each
distinct payload and target and kept as a table. Sizes and digests alone decide the layout. The pieces are then written
each to its place (sources/writer.py), so neither a bundle nor its payloads ever meet in one task; only tables and
headers, which are small, are patched bundle by bundle.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspark import formats
from assetspark.functions import headers
from assetspark.functions.dialect import SPARK
from assetspark.functions.records import Records
from assetspark.operators import codec, layout
from assetspark.progress import Progress, Silent
from assetspark.sources.container import ENTRY_BYTES, ENTRY_DTYPE, GPU, HEADER_BYTES, STREAM, TYPE_BYTES, digest_ranges, file_lengths
from assetspark.sources.shared import stored
from assetspark.sources.writer import PieceSink

TARGET = ["to_format", "to_w", "to_h", "to_mips", "drop_levels", "resident", "generates"]
RANKS = {STREAM: 0, GPU: 1, "": 2}


def payload_work(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """entries with what becomes of each payload: encodes, and if not, cut (bytes left out before it) and size; stream_cut and new_stream_size where it is converted.

    plan: (bundle, pos, include, TARGET) of the textures planned; entries that it doesn't name, or excludes, stay.
    """
    planned = plan.filter("include").select("bundle", "pos", *TARGET, F.lit(True).alias("planned"))
    rows = entries.join(planned, ["bundle", "pos"], "left").withColumn("planned", F.coalesce("planned", F.lit(False)))
    # A drop or a residency is a slice of the chain that is there; what has no chain, or gets a new one, is encoded.
    steps = [
        ["*", "planned AND (generates OR mips <= 1) AS encodes", f"CASE WHEN planned AND {formats.is_sizable('format')} THEN {SPARK.chain('format', 'w', 'h', 'mips')} END AS chain"],
        ["*", "planned AND NOT encodes AS sliced", f"CASE WHEN encodes AND generates AND resident IS NOT NULL THEN {SPARK.total(SPARK.cut(SPARK.chain('to_format', 'to_w', 'to_h', 'to_mips'), '0', 'resident'))} ELSE 0L END AS encoded_cut"],
        [
            "*", f"CASE WHEN sliced THEN {SPARK.total(SPARK.cut('chain', '0', '(drop_levels + coalesce(resident, 0))'))} ELSE 0L END AS cut",
            f"CASE WHEN sliced THEN {SPARK.total(SPARK.cut('chain', '(drop_levels + coalesce(resident, 0))', '(to_mips - coalesce(resident, 0))'))} ELSE gpu_size END AS kept",
            f"CASE WHEN sliced AND resident IS NOT NULL THEN {SPARK.total(SPARK.cut('chain', '0', 'drop_levels'))} END AS stream_cut",
            f"CASE WHEN sliced AND resident IS NOT NULL THEN {SPARK.total(SPARK.cut('chain', 'drop_levels'))} END AS stream_kept",
        ],
    ]
    for step in steps:
        rows = rows.selectExpr(*step)
    return rows.withColumn("cut_at", F.col("gpu_offset") + F.col("cut"))


def encoded(rows: DataFrame, backend: str, quality: str) -> DataFrame:
    """One encoding for each distinct payload and target of rows that encode, as a table: code, payload, digest and size of the resident part, those of the whole."""
    wanted = rows.filter("encodes").select(
        "code", F.concat("bundle", F.lit(GPU)).alias("source"), F.col("gpu_offset").alias("source_at"), F.col("gpu_size").alias("source_size"), "w", "h", "format", "to_w", "to_h", "to_format", "to_mips", F.col("encoded_cut").alias("cut")
    )
    return stored(codec.encode_ranges(wanted, backend, quality), "encoded")


def coded(rows: DataFrame) -> DataFrame:
    """rows with code, the name of a payload and its target."""
    parts = ["hash", "w", "h", "format", *TARGET]
    return rows.withColumn("code", F.when(F.col("encodes"), F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in parts))))


def table_pieces(rows: DataFrame, root: str) -> DataFrame:
    """The pieces of the bundles' own files: the old file, then each entry's record and each planned header over it."""
    fields = ["bundle", "pos", "new_offset", "new_size", "new_stream_offset", "new_stream_size", "planned", "cpu_offset", "cpu_size", "prefix", "mips", *TARGET]
    at = {name: ENTRY_DTYPE.fields[name][1] for name in ("stream_offset", "gpu_offset", "stream_size", "gpu_size")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, table = None, None, 0
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("bundle", "pos", "cpu_offset", "cpu_size", "planned")}
            n = {name: batch.column(name).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for name in (*fields[2:6], "prefix", "mips", *TARGET[:-1])}
            generates = batch.column("generates").fill_null(False).to_numpy(zero_copy_only=False)
            planned = np.array(c["planned"], bool)
            places, records, payloads, bases = [], [], [], []
            for path, pos, cpu_at, cpu_size, touched in zip(*c.values(), strict=True):
                if path != current:
                    if number is not None:
                        os.close(number)
                    current, number = path, os.open(path, os.O_RDONLY)
                    table = HEADER_BYTES + TYPE_BYTES * struct.unpack("<I", os.pread(number, 4, 4))[0]
                    bases.append((len(places), path, os.fstat(number).st_size))
                places.append(table + ENTRY_BYTES * pos)
                records.append(os.pread(number, ENTRY_BYTES, places[-1]))
                payloads.append(os.pread(number, cpu_size, cpu_at) if touched else b"")
            record = Records(pa.array(records, pa.binary()))
            for name, width in (("gpu_offset", 8), ("gpu_size", 4), ("stream_offset", 8), ("stream_size", 4)):
                value = n["new_" + {"gpu_offset": "offset", "gpu_size": "size"}.get(name, name)]
                record.put(at[name], width, np.maximum(value, 0), value >= 0)
            cpu = Records(pa.array(payloads, pa.binary()))
            streams = planned & (n["resident"] >= 0)
            chain = planned & ~streams & ((n["mips"] > 1) | generates)
            level0 = headers.surface_bytes(n["to_format"], n["to_w"], n["to_h"])
            headers.patch(cpu, n["prefix"], n["to_w"], n["to_h"], n["to_format"], np.where(streams, 0, np.where(chain, level0, n["new_size"])), np.where(streams | chain, n["to_mips"], -1), planned)
            headers.patch_streamed(cpu, n["prefix"], n["to_w"], n["to_format"], streams)
            headers.write_prefix(cpu, n["prefix"], n["to_w"], n["to_h"], n["to_format"], n["to_mips"], n["resident"], streams)
            records, payloads = record.column().to_pylist(), cpu.column().to_pylist()
            out = []
            starts = dict((i, (path, size)) for i, path, size in bases)
            for i, path in enumerate(c["bundle"]):
                if i in starts:
                    out.append((path, 0, starts[i][1], None, path, 0))
                out.append((path, places[i], ENTRY_BYTES, records[i], None, None))
                if planned[i]:
                    out.append((path, c["cpu_offset"][i], c["cpu_size"][i], payloads[i], None, None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()), strict=True)], ["bundle", "at", "size", "payload", "source", "source_at"])
        if number is not None:
            os.close(number)

    ordered = rows.select(*fields).repartition("bundle").sortWithinPartitions("bundle", "pos")
    made = ordered.mapInArrow(run, "bundle string, at long, size long, payload binary, source string, source_at long")
    return made.select(under(root, "").alias("target"), F.lit(RANKS[""]).alias("rank"), F.lit(True).alias("sequence"), "at", "size", "payload", "source", "source_at")


def under(root: str, ending: str):
    """The path of a bundle's file from the root."""
    return F.concat(F.expr(f"substring(bundle, {len(root.rstrip('/')) + 2})"), F.lit(ending))


def file_pieces(rows: DataFrame, codes: DataFrame, root: str, ending: str, offset: str) -> DataFrame:
    """The pieces of companions: rows (bundle, code, source, source_at, size, first cut of an encoding), ranges copied and encodings joined."""
    named = rows.select(under(root, ending).alias("target"), F.lit(RANKS[ending]).alias("rank"), F.lit(False).alias("sequence"), F.col(offset).alias("at"), "size", "code", "source", "source_at", "from")
    ranges = named.filter("code IS NULL").select("target", "rank", "sequence", "at", "size", F.lit(None).cast("binary").alias("payload"), "source", "source_at")
    made = named.filter("code IS NOT NULL").join(codes.select("code", "encoded"), "code")
    part = F.expr("substring(encoded, CAST(`from` + 1 AS INT), CAST(size AS INT))")
    return ranges.unionByName(made.select("target", "rank", "sequence", "at", "size", part.alias("payload"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("source_at")))


def apply_plan(entries: DataFrame, plan: DataFrame, root: str, out_root: str, share: bool = True, backend: str = "auto", quality: str = "balanced", progress: Progress | Silent = Silent()) -> DataFrame:
    """Writes the bundles of entries (format("bundle") of root, with payload hash) under out_root as the plan says; out_root may be root.

    Returns bundle, bytes_before, bytes_after (of the resident payloads' file), n_encoded (planned), n_shared and bytes
    not written again. A payload that can't be read or encoded fails the job before any file gets its name. Without
    share each entry has a place of its own. The files of bundles to be streamed are laid out anew; others' stream
    files are copied, if out_root is another folder.
    """
    spark = entries.sparkSession
    spark.dataSource.register(PieceSink)
    rows = stored(coded(payload_work(entries, plan)), "work")
    with progress.step("encode"):
        codes = encoded(rows, backend, quality)
    if bad := codes.filter("reason IS NOT NULL").select("code", "reason").first():
        raise ValueError(f"{bad['code']}: {bad['reason']}")
    sizes = codes.select("code", F.col("size").alias("made"), "digest", F.col("whole").alias("made_whole"), "whole_digest")
    gpu, stream = F.concat("bundle", F.lit(GPU)), F.concat("bundle", F.lit(STREAM))
    # Slices are digested by their range; payloads that are kept have theirs.
    sliced = digest_ranges(rows.filter("sliced").select("bundle", "pos", gpu.alias("source"), F.col("cut_at").alias("source_at"), F.col("kept").alias("size")), "cut_digest").select("bundle", "pos", "cut_digest")
    rows = rows.join(sizes, "code", "left").join(sliced, ["bundle", "pos"], "left")
    own = F.concat_ws(":", "bundle", "pos")
    digest = F.coalesce("digest", "cut_digest", F.when(~F.col("encodes") & ~F.col("sliced"), F.col("hash")), own) if share else own
    rows = stored(rows.withColumns({"new_size": F.when(F.col("encodes"), F.col("made")).otherwise(F.col("kept")), "content": digest}), "sized")
    placed = layout.pack(rows.filter("gpu_size > 0").withColumn("size", F.col("new_size")), ["content"])
    placed = stored(placed.select("bundle", "pos", "new_offset", "is_first", "size", "code", gpu.alias("source"), F.col("cut_at").alias("source_at"), F.col("encoded_cut").alias("from")), "placed")
    # Streams: what is there already, and what is converted now, in the order of the file table.
    converting = rows.filter("resident IS NOT NULL").select("bundle").distinct()
    targets = rows.filter("stream_size > 0 OR resident IS NOT NULL").join(converting, "bundle", "left_semi")
    converts = F.col("resident").isNotNull()
    targets = targets.select(
        "bundle", "pos", F.when(converts, F.col("code")).alias("code"), F.when(converts, gpu).otherwise(stream).alias("source"),
        F.when(converts, F.col("gpu_offset") + F.coalesce("stream_cut", F.lit(0))).otherwise(F.col("stream_offset")).alias("source_at"), F.when(converts, F.coalesce("made_whole", "stream_kept")).otherwise(F.col("stream_size")).alias("size"), "whole_digest",
    )
    digested = digest_ranges(targets.filter("code IS NULL").select("bundle", "pos", "source", "source_at", "size"), "range_digest").select("bundle", "pos", "range_digest")
    content = F.coalesce("whole_digest", "range_digest", own) if share else own
    streamed = layout.pack(targets.join(digested, ["bundle", "pos"], "left").withColumn("content", content), ["content"], order=("pos",))
    streamed = stored(streamed.select("bundle", "pos", F.col("new_offset").alias("new_stream_offset"), "is_first", "size", "code", "source", "source_at", F.lit(0).alias("from")), "streamed")
    moved = rows.join(placed.select("bundle", "pos", "new_offset"), ["bundle", "pos"], "left").withColumn("new_size", F.when(F.col("new_offset").isNotNull(), F.col("new_size")))
    moved = moved.join(streamed.select("bundle", "pos", "new_stream_offset", F.col("size").alias("new_stream_size")), ["bundle", "pos"], "left")
    pieces = [
        file_pieces(streamed.filter("is_first"), codes, root, STREAM, "new_stream_offset"),
        file_pieces(placed.filter("is_first AND size > 0"), codes, root, GPU, "new_offset"),
        # A companion of no payload at all is still a file.
        rows.select("bundle").distinct().select(under(root, GPU).alias("target"), F.lit(RANKS[GPU]).alias("rank"), F.lit(False).alias("sequence"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("payload"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("source_at")),
        table_pieces(moved, root),
    ]
    if os.path.abspath(root) != os.path.abspath(out_root):
        pieces.append(carried(rows.select("bundle").distinct().join(converting, "bundle", "left_anti"), root))
    all_pieces = pieces[0]
    for more in pieces[1:]:
        all_pieces = all_pieces.unionByName(more)
    before = stored(file_lengths(rows.select("bundle").distinct()).withColumnRenamed("file_length", "bytes_before"), "lengths")
    with progress.step("write"):
        all_pieces.write.format("pieces").mode("append").save(out_root)
    after = placed.filter("is_first").groupBy("bundle").agg(F.max(F.col("new_offset") + F.col("size")).alias("bytes_after"))
    shared = placed.filter("NOT is_first").groupBy("bundle").agg(F.count("*").alias("n_shared"), F.sum("size").alias("bytes_shared"))
    done = rows.groupBy("bundle").agg(F.count_if("planned").alias("n_planned")).join(before, "bundle").join(after, "bundle", "left").join(shared, "bundle", "left")
    return stored(done.select("bundle", "bytes_before", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bytes_after", "n_planned", "n_shared", "bytes_shared"))), "applied")


def carried(bundles: DataFrame, root: str) -> DataFrame:
    """The stream files of bundles whose streams stay as they are, as pieces."""
    there = file_lengths(bundles, STREAM).withColumnRenamed("file_length", "size")
    return there.select(under(root, STREAM).alias("target"), F.lit(RANKS[STREAM]).alias("rank"), F.lit(False).alias("sequence"), F.lit(0).cast("long").alias("at"), "size", F.lit(None).cast("binary").alias("payload"), F.concat("bundle", F.lit(STREAM)).alias("source"), F.lit(0).cast("long").alias("source_at"))
