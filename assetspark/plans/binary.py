"""Header and prefix bytes of textures, patched as columns of records and compared byte by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from assetspark import formats
from assetspark.bindings import TEXTURES, textures
from assetspark.functions import headers
from assetspark.functions.dialect import DUCK
from assetspark.functions.records import Records
from assetspark.plans import checking
from assetspark.plans.registry import query
from assetspark.sources.synthetic import texture_header

PREFIX = 192
FLAGS = 0x0002100F


def _with_base(batch: pa.RecordBatch) -> tuple[Records, dict[str, np.ndarray]]:
    """The CPU payloads of a batch of textures as they would stand in a bundle, and the batch's numbers."""
    n = {c: batch.column(c).to_numpy() for c in ("pos", "w", "h", "format", "mips")}
    cpu = Records(pa.array([texture_header(0, 0, 0, flags=FLAGS)] * batch.num_rows, pa.binary()))
    cpu.put(headers.ID, 4, n["pos"] % 3)
    for field, column in (("width", "w"), ("height", "h"), ("mips", "mips"), ("format", "format")):
        cpu.put(PREFIX + headers.AT[field], 4, n[column])
    return cpu, n


def _hex(batch: pa.RecordBatch, cpu: Records, lo: int, hi: int, name: str) -> pa.RecordBatch:
    shown = [x[lo:hi].hex() for x in cpu.column().to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("bundle"), batch.column("pos"), pa.array(shown, pa.string())], ["bundle", "pos", name])


def _le(value: str, width: int) -> str:
    """The bytes of a number, lowest first, in hexadecimal."""
    return " || ".join(f"format('{{:02x}}', CAST((CAST({value} AS BIGINT) >> {8 * i}) & 255 AS INTEGER))" for i in range(width))


_SIZED = f"has_dx10 AND {formats.is_sizable('format')}"
_HALF_W, _HALF_H = f"greatest(1, {DUCK.shr('w', '1')})", f"greatest(1, {DUCK.shr('h', '1')})"
_FIELDS = {
    0x08: f"CASE WHEN {formats.is_block('format')} THEN {FLAGS & ~8 | 0x80000} ELSE {FLAGS & ~0x80000 | 8} END", 0x0C: _HALF_H, 0x10: _HALF_W,
    0x14: f"CASE WHEN {formats.is_block('format')} THEN greatest(1, ({_HALF_W} + 3) // 4) * greatest(1, ({_HALF_H} + 3) // 4) * {formats.block_bytes('format')} ELSE {_HALF_W} * {formats.pixel_bytes('format')} END",
    0x18: "1", 0x1C: "CASE WHEN mips > 1 THEN mips - 1 ELSE mips END", 0x54: f"{headers.DX10}", 0x6C: f"CASE WHEN mips > 2 THEN {0x401008} ELSE {0x1000} END", 0x80: "format", 0x84: "3", 0x8C: "1", 0x00: f"{0x20534444}", 0x04: "124",
}


@query("patched_header", f"WITH {TEXTURES} SELECT bundle, pos, {' || '.join(_le(_FIELDS.get(at, '0'), 4) for at in range(0, 148, 4))} AS header FROM textures WHERE {_SIZED}")
def patched_header(spark, sf_dir):
    """Each texture's header once its first level is gone: half its sides, a level less, sizes and flags of its format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cpu, n = _with_base(batch)
            w, h = (np.maximum(1, n[c] >> 1) for c in "wh")
            headers.patch(cpu, PREFIX, w, h, n["format"], headers.surface_bytes(n["format"], w, h), np.where(n["mips"] > 1, n["mips"] - 1, -1))
            yield _hex(batch, cpu, PREFIX, PREFIX + 148, "header")

    return textures(spark, sf_dir).filter(_SIZED).select("bundle", "pos", "w", "h", "format", "mips").mapInArrow(run, "bundle string, pos long, header string")


_SUM = lambda values: f"coalesce(list_sum({values}), 0)"
_LEVEL = " || ".join((
    _le(f"greatest(1, {DUCK.shr('w', 'i')})", 2), _le(f"greatest(1, {DUCK.shr('h', 'i')})", 2), _le(f"CASE WHEN i = mips - 1 THEN 0 ELSE {_SUM('list_slice(chain, 1, i + 1)')} END", 4),
    _le(f"CASE WHEN i = mips - 1 THEN 0 ELSE {_SUM('list_slice(chain, i + 2, mips)')} END", 4),
))


@query(
    "streaming_prefix",
    f"WITH {TEXTURES}, c AS (SELECT *, {checking.own_chain()} AS chain FROM textures WHERE {_SIZED} AND mips > 1) "
    f"SELECT bundle, pos, rpad({_le('pos % 3', 4)} || {_le('CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 END', 4)} || {_le('pos % mips', 4)} || '00000000' || {_le(_SUM('chain'), 4)} || array_to_string(list_transform(range(0, mips), lambda i: {_LEVEL}), ''), {2 * PREFIX}, '0') AS prefix FROM c",
)
def streaming_prefix(spark, sf_dir):
    """The prefix of each texture with a chain, were it streamed from one of its levels on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cpu, n = _with_base(batch)
            headers.write_prefix(cpu, PREFIX, n["w"], n["h"], n["format"], n["mips"], n["pos"] % n["mips"])
            yield _hex(batch, cpu, 0, PREFIX, "prefix")

    return textures(spark, sf_dir).filter(f"{_SIZED} AND mips > 1").select("bundle", "pos", "w", "h", "format", "mips").mapInArrow(run, "bundle string, pos long, prefix string")
