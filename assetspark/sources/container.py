"""The packed container as a Spark data source, and writers of its files.

`spark.read.format("bundle").load(path)` gives one row for each entry of the file tables of a bundle, or of all bundles
under a folder; one bundle is one partition. Only tables are read, and of a texture the bytes of its header. A schema
given with `.schema(...)` names the columns wanted: without those of the header no header is read, and the columns
PAYLOAD, which are read on demand only, bring the resident payload or why it can't be had. With option pushdown (and
spark.sql.python.filterPushdown.enabled) filters on bundle, type_name and pos leave out files and entries unread.

A bundle that can't be parsed fails its task with the reason, unless mode is "skip". Listing runs on the driver here;
listing.discover lists in tasks, and entries_at reads the bundles of a frame.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from decimal import Decimal
from itertools import chain, islice
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType, _parse_datatype_string

from assetspark.sources.shared import stored

#: Fixed values of the format.
MAGIC = 0xF0000011
HEADER_BYTES, TYPE_BYTES, ENTRY_BYTES, ALIGNMENT = 0x48, 32, 80, 64
TYPE_NAMES = {0xEAC0B497876ADEDF: "material", 0xCD4238C6A0C69E32: "texture", 0xE0A48D0BE9A7453F: "unit", 0x18DEAD01056B72E9: "bones"}
TEXTURE = 0xCD4238C6A0C69E32
TYPE_DTYPE = np.dtype([("opaque", "<u8"), ("type_id", "<u8"), ("count", "<u8"), ("alignment", "<u4"), ("opaque2", "<u4")])
ENTRY_DTYPE = np.dtype([
    ("file_id", "<u8"), ("type_id", "<u8"), ("cpu_offset", "<u8"), ("stream_offset", "<u8"), ("gpu_offset", "<u8"), ("opaque1", "<u8"), ("opaque2", "<u8"),
    ("cpu_size", "<u4"), ("stream_size", "<u4"), ("gpu_size", "<u4"), ("opaque3", "<u4"), ("opaque4", "<u4"), ("index", "<u4"),
])
GPU, STREAM = ".gpu_resources", ".stream"
SCHEMA = (
    "bundle string, pos long, file_id decimal(20,0), name string, type_id decimal(20,0), type_name string, cpu_offset long, cpu_size long, gpu_offset long, gpu_size long, stream_offset long, stream_size long, index long, "
    "w long, h long, format long, mips long, linear_size long, flags long, has_dx10 boolean, first_resident long, prefix_id long, prefix long"
)
NOT_STREAMED = 0xFFFFFFFF


class ContainerError(ValueError):
    pass


def parse(data: bytes, path: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(type table, file table) of a bundle, checked for magic, extent and agreement of their counts."""
    if len(data) < HEADER_BYTES:
        raise ContainerError(f"{path}: {len(data)} bytes are fewer than a header")
    magic, n_types, n_files = struct.unpack_from("<IIQ", data)
    if magic != MAGIC:
        raise ContainerError(f"{path}: magic is {magic:#x}")
    at = HEADER_BYTES + TYPE_BYTES * n_types
    if at + ENTRY_BYTES * n_files > len(data):
        raise ContainerError(f"{path}: tables of {n_types} types and {n_files} files run past the end")
    types = np.frombuffer(data, TYPE_DTYPE, n_types, HEADER_BYTES)
    if int(types["count"].sum()) != n_files:
        raise ContainerError(f"{path}: the types count {int(types['count'].sum())} files, the header {n_files}")
    return types, np.frombuffer(data, ENTRY_DTYPE, n_files, at)


def dds_header(payload: bytes) -> dict | None:
    """The image header in a texture's CPU payload, found by its magic; None if there is none."""
    at = payload.find(b"DDS ")
    if at < 0 or at + 128 > len(payload):
        return None
    flags, h, w, linear = struct.unpack_from("<IIII", payload, at + 8)
    dx10 = payload[at + 0x54 : at + 0x58] == b"DX10" and at + 148 <= len(payload)
    return {
        "w": w, "h": h, "flags": flags, "linear_size": linear, "mips": struct.unpack_from("<I", payload, at + 0x1C)[0], "has_dx10": dx10,
        "format": struct.unpack_from("<I", payload, at + 0x80)[0] if dx10 else 0,
        "prefix_id": struct.unpack_from("<I", payload)[0] if at >= 4 else None, "first_resident": struct.unpack_from("<I", payload, 8)[0] if at >= 12 else NOT_STREAMED, "prefix": at,
    }


HEADER_FIELDS = ("w", "h", "format", "mips", "linear_size", "flags", "has_dx10", "first_resident", "prefix_id", "prefix")


PAYLOAD = ("payload", "payload_error")
FULL_SCHEMA = f"{SCHEMA}, payload binary, payload_error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def read_range(path: str, at: int, size: int) -> tuple[bytes | None, str | None]:
    """(size bytes from a place of a file, None), or (None, why they can't be had). Of a range past the end nothing is read: the file's length tells what is missing."""
    try:
        with open(path, "rb") as f:
            f.seek(at)
            there = min(size, max(0, os.fstat(f.fileno()).st_size - at))
            if there == size:
                held = f.read(size)
                there = len(held)
    except OSError as error:
        return None, error.strerror
    return (held, None) if there == size else (None, f"read past end: {size - there} of {size} bytes at {at} are missing")


def entry_rows(path: str, columns: list[str] = COLUMNS, keep=lambda row: True) -> Iterator[tuple]:
    """Rows of the columns asked for of a bundle's entries that keep accepts by pos and type_name. Only what they need is read."""
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        head = f.read(16)
        n_types, n_files = struct.unpack_from("<IQ", head, 4) if len(head) == 16 else (0, 0)
        f.seek(0)
        _, entries = parse(f.read(min(size, HEADER_BYTES + TYPE_BYTES * n_types + ENTRY_BYTES * n_files)), path)
        wants_header, wants_payload = (any(c in columns for c in names) for names in (HEADER_FIELDS, PAYLOAD))
        for pos, e in enumerate(chain.from_iterable(entries[at : at + 4096].tolist() for at in range(0, n_files, 4096))):
            e = dict(zip(ENTRY_DTYPE.names, e, strict=True))
            type_id = e["type_id"]
            row = {"bundle": path, "pos": pos, "type_name": TYPE_NAMES.get(type_id) or f"{type_id:016X}"}
            if not keep(row):
                continue
            row |= {**e, "file_id": Decimal(e["file_id"]), "name": f"{e['file_id']:016X}", "type_id": Decimal(type_id)}
            if wants_header and type_id == TEXTURE:
                f.seek(row["cpu_offset"])
                row |= dds_header(f.read(row["cpu_size"])) or {}
            if wants_payload:
                row["payload"], row["payload_error"] = read_range(path + GPU, row["gpu_offset"], row["gpu_size"])
            yield tuple(map(row.get, columns))


def bundle_files(root: str) -> list[str]:
    """root itself if it is a file, else bundles under it: files with a companion and the magic, none below a folder named backup. Unreadable ones are passed over."""
    if os.path.isfile(root):
        return [root]
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    out = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n.lower() != "backup")
        held = set(files)
        for f in sorted(files):
            if not f.lower().endswith((GPU, STREAM)) and f + GPU in held:
                path = os.path.join(folder, f)
                try:
                    with open(path, "rb") as file:
                        if file.read(4) == struct.pack("<I", MAGIC):
                            out.append(path)
                except OSError:
                    continue
    return out


class _Bundle(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.root, self.skip = options.get("path"), options.get("mode", "fail").lower() == "skip"
        self.columns = columns
        self.wanted: dict[str, set] = {}

    def partitions(self):
        names = self.wanted.get("bundle")
        return [_Bundle(p) for p in bundle_files(self.root) if names is None or p in names]

    def read(self, partition):
        try:
            yield from entry_rows(partition.path, self.columns, lambda row: all(row[c] in values for c, values in self.wanted.items()))
        except ContainerError:
            if not self.skip:
                raise


class _PushedReader(_Reader):
    def pushFilters(self, filters):  # noqa: N802
        """Values of bundle, type_name and pos are taken here; all else is left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("bundle",), ("type_name",), ("pos",)):
                yield f
            else:
                (name,) = f.attribute
                self.wanted[name] = self.wanted.get(name, values) & values


class BundleSource(DataSource):
    """spark.dataSource.register(BundleSource), then format("bundle")."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _PushedReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        unknown = set(schema.names) - {*COLUMNS, *PAYLOAD}
        if unknown:
            raise ValueError(f"a bundle has no columns {sorted(unknown)}")
        return kind(self.options, schema.names)


def entries_at(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of the bundles of a frame (bundle), read in tasks; errors: bundle, error, of those that can't be read or parsed."""
    fields = [f for f in _parse_datatype_string(FULL_SCHEMA).fields if f.name in COLUMNS]
    schema = StructType([*fields, StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], arrow.names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    rows = entry_rows(path)
                    held = [of([(*r, None) for r in part]) for part in iter(lambda: list(islice(rows, 10_000)), [])]
                except (ContainerError, OSError) as error:
                    held = [of([(path, *[None] * (len(COLUMNS) - 1), str(error))])]
                yield from held

    read = stored(bundles.select("bundle").mapInArrow(run, schema), "read")
    return read.filter("error IS NULL").drop("error"), read.filter("error IS NOT NULL").select("bundle", "error")


def with_payloads(entries: DataFrame, at_once: int = 1 << 25) -> DataFrame:
    """entries with PAYLOAD: the resident payload, or why it can't be had, such as `read past end`. Batches stay about at_once bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("bundle", "gpu_offset", "gpu_size")), strict=True))
            first, held, size = 0, [], 0
            for i, (path, at, n) in enumerate(places):
                held.append(read_range(path + GPU, at, n))
                size += len(held[-1][0] or b"")
                if size >= at_once or i + 1 == len(places):
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.string())], [*batch.schema.names, *PAYLOAD])
                    first, held, size = i + 1, [], 0

    return entries.mapInArrow(run, StructType([*entries.schema.fields, StructField("payload", BinaryType()), StructField("payload_error", StringType())]))


def digest_ranges(ranges: DataFrame, name: str, place: tuple[str, str, str] = ("source", "source_at", "size"), chunk: int = 1 << 20) -> DataFrame:
    """ranges (a file, a place in it, a size and other columns) with the SHA-256 of their bytes, read by offset in chunks; null where the file ends before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in place), strict=True):
                digest, left = hashlib.sha256(), size
                with open(path, "rb") as f:
                    f.seek(at)
                    while left and (part := f.read(min(chunk, left))):
                        digest.update(part)
                        left -= len(part)
                hashes.append(None if left else digest.hexdigest().upper())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], [*batch.schema.names, name])

    return ranges.mapInArrow(run, StructType([*ranges.schema.fields, StructField(name, StringType())]))


def with_payload_hash(entries: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """entries with hash, the SHA-256 of the GPU payload; null where the file ends before it."""
    place = ("__source", "__at", "__size")
    named = entries.withColumns(dict(zip(place, (F.concat("bundle", F.lit(GPU)), F.col("gpu_offset"), F.col("gpu_size")), strict=True)))
    return digest_ranges(named, "hash", place, chunk).drop(*place)


def file_lengths(bundles: DataFrame, ending: str = GPU) -> DataFrame:
    """bundle, file_length of the companions that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [p + ending for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([os.path.getsize(f) if os.path.exists(f) else None for f in files], pa.int64())], ["bundle", "file_length"])

    return bundles.select("bundle").mapInArrow(run, "bundle string, file_length long").filter("file_length IS NOT NULL")


def level_tables(textures: DataFrame) -> DataFrame:
    """bundle, pos, level, level_size, next_offset, rest: the level tables in the prefixes of streamed textures, as they stand.

    A level's size is what lies between its start and the next one's, the last one's what is left of the total.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, pos, at, mips, prefix in zip(*(batch.column(c).to_pylist() for c in ("bundle", "pos", "cpu_offset", "mips", "prefix")), strict=True):
                with open(path, "rb") as f:
                    f.seek(at)
                    held = f.read(prefix)
                total, before = int.from_bytes(held[16:20], "little"), 0
                for level in range(min(max(mips, 1), max(0, (prefix - 20) // 12))):
                    following, rest = struct.unpack_from("<II", held, 20 + 12 * level + 4)
                    last = level == mips - 1
                    out.append((path, pos, level, (total if last else following) - before, following, rest))
                    before = following
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), *[pa.int64()] * 5))], ["bundle", "pos", "level", "level_size", "next_offset", "rest"])

    streamed = textures.filter("stream_size > 0 AND prefix IS NOT NULL").select("bundle", "pos", "cpu_offset", "mips", "prefix")
    return streamed.mapInArrow(run, "bundle string, pos long, level long, level_size long, next_offset long, rest long")


def copy_range(old: BinaryIO, new: BinaryIO, size: int, chunk: int = 1 << 20) -> None:
    """The next size bytes of old written to new, a chunk at a time."""
    while size:
        part = old.read(min(chunk, size))
        if not part:
            raise ContainerError(f"{old.name}: ends {size} bytes before its payload does")
        new.write(part)
        size -= len(part)


def write_layout(placed: DataFrame, out_root: str, root: str) -> DataFrame:
    """Bundles rewritten with shared, aligned payloads: placed is layout.pack over the source's entries with size and is_first.

    One task writes one bundle: stream file, companion, then the table, copied in chunks to names of the attempt's own that
    are renamed at the end, so a task that is lost or run twice leaves no part of a file under a final name. Returns
    bundle, bytes_before, bytes_after. A bundle is bounded by its file table, so its entries meet in one task.
    """

    def write(key, group):
        import pandas as pd

        source = key[0]
        target = os.path.join(out_root, os.path.relpath(source, root))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        data = bytearray(Path(source).read_bytes())
        n_types = struct.unpack_from("<I", data, 4)[0]
        table = HEADER_BYTES + TYPE_BYTES * n_types
        end = 0
        own = f".{uuid.uuid4().hex}.tmp"
        with open(source + GPU, "rb") as old, open(target + GPU + own, "wb") as new:
            for e in group[group["is_first"] & (group["size"] > 0)].sort_values("new_offset").itertuples():
                new.write(b"\0" * (e.new_offset - end))
                old.seek(e.gpu_offset)
                copy_range(old, new, e.size)
                end = e.new_offset + e.size
        for e in group[group["size"] > 0].itertuples():
            struct.pack_into("<Q", data, table + ENTRY_BYTES * e.pos + 0x20, e.new_offset)
        Path(target + own).write_bytes(bytes(data))
        if os.path.exists(source + STREAM):
            shutil.copyfile(source + STREAM, target + STREAM + own)
            os.replace(target + STREAM + own, target + STREAM)
        os.replace(target + GPU + own, target + GPU)
        os.replace(target + own, target)
        return pd.DataFrame([(source, os.path.getsize(source + GPU), end)], columns=["bundle", "bytes_before", "bytes_after"])

    return placed.select("bundle", "pos", "gpu_offset", "size", "is_first", "new_offset").groupBy("bundle").applyInPandas(write, "bundle string, bytes_before long, bytes_after long")


def backup(path: str, folder: str = "backup") -> list[str]:
    """A bundle and its companions copied beside it; an earlier copy is never overwritten."""
    files, copies = (list(x) for x in zip(*_copies(path, folder), strict=True))
    if taken := [c for c in copies if os.path.exists(c)]:
        raise FileExistsError(taken[0])
    for f, c in zip(files, copies, strict=True):
        os.makedirs(os.path.dirname(c), exist_ok=True)
        shutil.copyfile(f, c)
    return copies


def _copies(path: str, folder: str) -> list[tuple[str, str]]:
    """The files of a bundle that are there, each with the name of its copy; a folder that isn't absolute lies beside the bundle."""
    there = os.path.join(os.path.dirname(path), folder)
    return [(f, os.path.join(there, os.path.basename(f))) for f in (path, path + GPU, path + STREAM) if os.path.exists(f)]


def backup_all(bundles: DataFrame, folder: str = "backup") -> DataFrame:
    """bundle, n_files, bytes: bundles and their companions copied by tasks, as a table.

    If any copy is there already, nothing is copied at all. Copies get their names once they are whole, and one that an
    earlier attempt of a task made is left as it is.
    """

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c for p in batch.column(0).to_pylist() for _, c in _copies(p, folder) if os.path.exists(c)], pa.string())], ["copy"])

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            counts, sizes = [], []
            for files in (_copies(p, folder) for p in paths):
                for f, c in files:
                    if not os.path.exists(c):
                        os.makedirs(os.path.dirname(c), exist_ok=True)
                        own = f"{c}.{uuid.uuid4().hex}.tmp"
                        shutil.copyfile(f, own)
                        os.replace(own, c)
                counts.append(len(files))
                sizes.append(sum(os.path.getsize(f) for f, _ in files))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["bundle", "n_files", "bytes"])

    bundles = stored(bundles.select("bundle").distinct(), "bundles")
    if there := bundles.mapInArrow(taken, "copy string").first():
        raise FileExistsError(there["copy"])
    return stored(bundles.mapInArrow(copy, "bundle string, n_files long, bytes long"), "backups")
