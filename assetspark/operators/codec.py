"""Decoding, analysing and encoding payloads: once for each distinct one, in Arrow batches, beside the relational plan.

Frames name payloads by place (source, source_at, source_size), which tasks read, or hold them as a column payload.
Places are what is deduplicated and shuffled; frames that hold payloads shuffle those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspark.functions import blocks, encoders

ANALYSIS = "key string, solid boolean, flat_alpha boolean, alpha_detail boolean, binary_alpha boolean, r long, g long, b long, a long, psnr double, reason string"
CHUNK = 16
PLACE = ("source", "source_at", "source_size")


def distinct_payloads(payloads: DataFrame, by: list[str], others: list[str]) -> DataFrame:
    """One row for each value of by, with others and a place or payload; places are chosen by a minimum, combined before the shuffle."""
    if "payload" in payloads.columns:
        return payloads.dropDuplicates(by).select(*by, *others, "payload")
    rest = [*PLACE, *(c for c in others if c not in by)]
    least = payloads.groupBy(*by).agg(F.min(F.struct(*rest)).alias("__one"))
    return least.select(*by, *(F.col(f"__one.{c}").alias(c) for c in rest))


def payload_of(row: dict) -> bytes:
    if "payload" in row:
        return row["payload"]
    with open(row["source"], "rb") as f:
        f.seek(row["source_at"])
        payload = f.read(row["source_size"])
    if len(payload) < row["source_size"]:
        raise ValueError(f"read past end: {row['source_size'] - len(payload)} bytes at {row['source_at']} are missing")
    return payload


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, kept: list[str], make) -> Iterator[pa.RecordBatch]:
    """A row of schema for each row, with the columns kept and what make gives; an error of the payload is its reason."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            rows = []
            for x in batch.slice(at, CHUNK).to_pylist():
                row = {c: x[c] for c in kept}
                try:
                    row |= make(x)
                except (ValueError, TypeError, OSError) as error:
                    row["reason"] = str(error)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)


def analyse_payloads(payloads: DataFrame) -> DataFrame:
    """payloads: key, w, h, format and a place or payload -> one row of statistics for each distinct key; a reason where it can't be decoded."""
    schema = pa.schema([("key", pa.string()), *((c, pa.bool_()) for c in ("solid", "flat_alpha", "alpha_detail", "binary_alpha")), *((c, pa.int64()) for c in "rgba"), ("psnr", pa.float64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, schema, ["key"], lambda x: blocks.analyse(blocks.decode(payload_of(x), x["w"], x["h"], x["format"])))

    return distinct_payloads(payloads, ["key"], ["w", "h", "format"]).mapInArrow(run, ANALYSIS)


def _encoded(x: dict, encoder: encoders.Choice, effort: float) -> bytes:
    surface = blocks.decode(payload_of(x), x["w"], x["h"], x["format"])
    if (x["to_w"], x["to_h"]) != (x["w"], x["h"]):
        surface = blocks.resample(surface, x["to_w"], x["to_h"])
    return encoder.encode_chain(surface, x["to_format"], x["to_mips"], effort)


def encode_payloads(payloads: DataFrame, backend: str = "auto", quality: str = "balanced") -> DataFrame:
    """payloads: key, w, h, format, to_w, to_h, to_format, to_mips and a place or payload -> key, to_format, to_w, to_h, to_mips, encoded, reason.

    One encoding for each distinct payload and target, chains included; join it back on both.
    """
    target = ["key", "to_format", "to_w", "to_h", "to_mips"]
    schema = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in target[1:]), ("encoded", pa.binary()), ("reason", pa.string())])
    encoder, effort = encoders.resolve(backend), encoders.EFFORTS[quality]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, schema, target, lambda x: {"encoded": _encoded(x, encoder, effort)})

    wide = payloads.withColumns({c: F.col(c).cast("long") for c in target[1:]})
    return distinct_payloads(wide, target, ["w", "h", "format"]).mapInArrow(run, "key string, to_format long, to_w long, to_h long, to_mips long, encoded binary, reason string")


def encode_ranges(payloads: DataFrame, backend: str = "auto", quality: str = "balanced") -> DataFrame:
    """As encode_payloads, for each distinct code, which names payload and target, and with sizes and digests.

    cut: bytes of the encoding before the part that stays resident. -> code, encoded, size and digest of that part,
    whole and whole_digest of all, reason.
    """
    schema = pa.schema([("code", pa.string()), ("encoded", pa.binary()), ("size", pa.int64()), ("digest", pa.string()), ("whole", pa.int64()), ("whole_digest", pa.string()), ("reason", pa.string())])
    encoder, effort = encoders.resolve(backend), encoders.EFFORTS[quality]
    name = lambda data: hashlib.sha256(data).hexdigest().upper()

    def make(x: dict) -> dict:
        made = _encoded(x, encoder, effort)
        part = memoryview(made)[x["cut"] :]
        return {"encoded": made, "size": len(part), "digest": name(part), "whole": len(made), "whole_digest": name(made)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, schema, ["code"], make)

    others = ["w", "h", "format", "to_w", "to_h", "to_format", "to_mips", "cut"]
    return distinct_payloads(payloads, ["code"], others).mapInArrow(run, "code string, encoded binary, size long, digest string, whole long, whole_digest string, reason string")
