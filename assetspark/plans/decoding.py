"""Blocks made of the bytes of surfaces, decoded, and surfaces encoded: pixels and sizes against SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assetspark.bindings import PIXELS, surfaces
from assetspark.functions import blocks, encoders
from assetspark.plans.registry import query

#: The 64 channel values of a surface as bytes b[1] to b[64], which is eight blocks of 8 bytes or four of 16.
BYTES = f"{PIXELS}, held AS (SELECT tex_id, list(v ORDER BY y, x, ch) AS b FROM pixels GROUP BY tex_id)"


def _pixels_of(code: int, block_bytes: int):
    """Batches of (tex_id, v) -> the pixels of the first block that their bytes are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy().reshape(-1, 64).astype(np.uint8)
            shown = [blocks.decode(row[:block_bytes].tobytes(), 4, 4, code).reshape(16, 4) for row in values]
            flat = np.stack(shown).astype(np.int64) if shown else np.zeros((0, 16, 4), np.int64)
            ids = np.repeat(batch.column("tex_id").to_numpy(), 16)
            at = np.tile(np.arange(16), len(values))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, at, *flat.reshape(-1, 4).T.copy())], ["tex_id", "i", "r", "g", "b", "a"])

    return run


SHOWN = "tex_id long, i long, r long, g long, b long, a long"


def _decoded(spark, sf_dir, code: int, block_bytes: int):
    return surfaces(spark, sf_dir).select("tex_id", "v").mapInArrow(_pixels_of(code, block_bytes), SHOWN)


def _colours(at: int, cutout: bool) -> str:
    """Tables ends and coloured: the pixels of a colour block at a byte, with a transparent fourth colour where the first end isn't greater."""
    word = lambda k: f"b[{at + k + 1}] + 256 * b[{at + k + 2}]"
    five = lambda c, s: f"(((({c} >> {s}) & 31) << 3) | ((({c} >> {s}) & 31) >> 2))"
    six = lambda c: f"(((({c} >> 5) & 63) << 2) | ((({c} >> 5) & 63) >> 4))"
    three = "c0 <= c1" if cutout else "false"
    mixed = lambda x: f"CASE k WHEN 0 THEN {x}0 WHEN 1 THEN {x}1 WHEN 2 THEN CASE WHEN {three} THEN ({x}0 + {x}1) // 2 ELSE (2 * {x}0 + {x}1) // 3 END ELSE CASE WHEN {three} THEN 0 ELSE ({x}0 + 2 * {x}1) // 3 END END"
    return f"""words AS (SELECT tex_id, b, {word(0)} AS c0, {word(2)} AS c1 FROM held),
ends AS (SELECT *, {five('c0', 11)} AS r0, {six('c0')} AS g0, {five('c0', 0)} AS b0, {five('c1', 11)} AS r1, {six('c1')} AS g1, {five('c1', 0)} AS b1, unnest(range(0, 16)) AS i FROM words),
picked AS (SELECT *, (b[{at} + 5 + i // 4] >> CAST(2 * (i % 4) AS INTEGER)) & 3 AS k FROM ends),
coloured AS (SELECT tex_id, i, {mixed('r')} AS r, {mixed('g')} AS g, {mixed('b')} AS bl, CASE WHEN {three} AND k = 3 THEN 0 ELSE 255 END AS a FROM picked)"""


def _ramp(at: int, name: str) -> str:
    """Table name: the values of a one-channel block at a byte."""
    return f"""{name}_bits AS (SELECT tex_id, b[{at + 1}] AS e0, b[{at + 2}] AS e1, list_sum(list_transform(range(0, 6), lambda k: CAST(b[{at} + 3 + k] AS BIGINT) << CAST(8 * k AS INTEGER))) AS bits, unnest(range(0, 16)) AS i FROM held),
{name}_picked AS (SELECT *, (CAST(bits AS BIGINT) >> CAST(3 * i AS INTEGER)) & 7 AS k FROM {name}_bits),
{name} AS (SELECT tex_id, i, CASE WHEN k = 0 THEN e0 WHEN k = 1 THEN e1 WHEN e0 > e1 THEN ((8 - k) * e0 + (k - 1) * e1) // 7 WHEN k = 6 THEN 0 WHEN k = 7 THEN 255 ELSE ((6 - k) * e0 + (k - 1) * e1) // 5 END AS v FROM {name}_picked)"""


@query("decode_bc1", f"WITH {BYTES}, {_colours(0, True)} SELECT tex_id, i, r, g, bl AS b, CAST(a AS BIGINT) AS a FROM coloured")
def decode_bc1(spark, sf_dir):
    return _decoded(spark, sf_dir, 71, 8)


@query("decode_bc3", f"WITH {BYTES}, {_colours(8, False)}, {_ramp(0, 'alpha')} SELECT c.tex_id, c.i, c.r, c.g, c.bl AS b, alpha.v AS a FROM coloured c JOIN alpha ON alpha.tex_id = c.tex_id AND alpha.i = c.i")
def decode_bc3(spark, sf_dir):
    return _decoded(spark, sf_dir, 77, 16)


@query("decode_bc5", f"WITH {BYTES}, {_ramp(0, 'red')}, {_ramp(8, 'green')} SELECT red.tex_id, red.i, red.v AS r, green.v AS g, CAST(0 AS BIGINT) AS b, CAST(255 AS BIGINT) AS a FROM red JOIN green ON green.tex_id = red.tex_id AND green.i = red.i")
def decode_bc5(spark, sf_dir):
    return _decoded(spark, sf_dir, 83, 16)


#: Sides to which surfaces are scaled, and levels made of each.
SIDES = ((4, 4, 3), (16, 8, 5), (6, 10, 1))


@query(
    "encoded_sizes",
    f"""WITH ids AS (SELECT vec_id AS tex_id FROM embeddings), t(code, block) AS (VALUES {', '.join(f'({c}, {blocks.BLOCK_BYTES[c]})' for c in encoders.TARGETS)}), s(w, h, mips) AS (VALUES {', '.join(map(str, SIDES))})
SELECT tex_id, CAST(code AS BIGINT) AS code, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(list_sum(list_transform(range(0, mips), lambda i: ((greatest(1, w >> CAST(i AS INTEGER)) + 3) // 4) * ((greatest(1, h >> CAST(i AS INTEGER)) + 3) // 4) * block)) AS BIGINT) AS n_bytes FROM ids, t, s""",
)
def encoded_sizes(spark, sf_dir):
    """Each surface scaled, encoded with its chain in each target offered, by the encoder that is resolved by default."""
    encoder = encoders.resolve()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tex_id, v in zip(batch.column("tex_id").to_pylist(), batch.column("v").flatten().to_numpy().reshape(-1, 4, 4, 4).astype(np.uint8), strict=True):
                for w, h, mips in SIDES:
                    scaled = v if (w, h) == (4, 4) else blocks.resample(v, w, h)
                    out += [(tex_id, code, w, h, len(encoder.encode_chain(scaled, code, mips))) for code in encoders.TARGETS]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["tex_id", "code", "w", "h", "n_bytes"])

    return surfaces(spark, sf_dir).select("tex_id", "v").repartition(spark.sparkContext.defaultParallelism, F.col("tex_id")).mapInArrow(run, "tex_id long, code long, w long, h long, n_bytes long")
