"""What surfaces hold: channel statistics, classes of content, smaller versions, and what halving them would lose.

Surfaces are rows of arrays, RGBA pixel by pixel; no pixel is ever a row. A large surface may come as several rows, its
tiles: each gives a profile of fixed size, and profiles of one surface add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assetspark.functions import blocks

CHANNELS = ("r", "g", "b", "a")
#: Values that a channel holds are bits of so many words.
WORDS = 4
#: Surfaces counted at once.
ROWS = 512
_STATE = [*(f"{what}_{c}" for what in ("lo", "hi", "sum") for c in CHANNELS), "n", *(f"seen_{c}_{i}" for c in CHANNELS for i in range(WORDS))]


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _histograms(column: pa.Array) -> np.ndarray:
    """(rows, 4, 256) counts of the values of each channel."""
    values, lengths = _values(column)
    row = np.repeat(np.arange(len(lengths)), lengths)
    channel = (np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) % 4
    return np.bincount((row * 4 + channel) * 256 + values, minlength=len(lengths) * 1024).reshape(-1, 4, 256)


def profiles(surfaces: DataFrame, whole: bool = False) -> DataFrame:
    """surfaces (tex_id, v, ...) -> tex_id, the state of its profile: least and greatest value, sum and set of values of each channel, pixels.

    Tiles of one surface are brought together by their states, and other columns left out; with whole each row is a
    surface of its own, nothing is shuffled, and other columns stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = _histograms(part.column("v"))
                held = counts > 0
                lo, hi, sums = held.argmax(2), 255 - held[:, :, ::-1].argmax(2), counts @ np.arange(256)
                words = np.packbits(held, axis=2, bitorder="little").reshape(-1, 4, WORDS, 8).view("<i8")[..., 0]
                state = [*lo.T, *hi.T, *sums.T, counts[:, 0].sum(1), *words.reshape(-1, 4 * WORDS).T]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(x), pa.int64()) for x in state)], [*part.schema.names, *_STATE])

    each = surfaces.filter(F.size("v") > 0).mapInArrow(run, StructType([*surfaces.schema.fields, *(StructField(c, LongType()) for c in _STATE)]))
    if whole:
        return each
    merge = {"lo": F.min, "hi": F.max, "sum": F.sum, "n": F.sum, "seen": F.bit_or}
    return each.groupBy("tex_id").agg(*(merge[c.split("_")[0]](c).alias(c) for c in _STATE))


def _distinct(channel: str):
    return sum((F.bit_count(f"seen_{channel}_{i}") for i in range(1, WORDS)), F.bit_count(f"seen_{channel}_0")).cast("long")


def channel_stats(profiled: DataFrame) -> DataFrame:
    """Per surface and channel, from profiles: least, most, exact number of distinct values, mean."""
    rows = [F.struct(F.lit(i).cast("long").alias("ch"), F.col(f"lo_{c}").alias("min_v"), F.col(f"hi_{c}").alias("max_v"), _distinct(c).alias("n_distinct"), (F.col(f"sum_{c}") / F.col("n")).alias("mean_v")) for i, c in enumerate(CHANNELS)]
    return profiled.select("tex_id", F.inline(F.array(*rows)))


def analyse(profiled: DataFrame) -> DataFrame:
    """Per surface, from profiles: solid, flat_alpha, alpha_detail, binary_alpha, the four least values, a_distinct; other columns stay."""
    constant = {c: F.col(f"lo_{c}") == F.col(f"hi_{c}") for c in CHANNELS}
    flat = constant["r"] & constant["g"] & constant["b"]
    out = {
        "solid": flat & constant["a"], "flat_alpha": flat & ~constant["a"], "alpha_detail": ~constant["a"] | (F.col("lo_a") != 255), "binary_alpha": (_distinct("a") == 2) & (F.col("lo_a") == 0) & (F.col("hi_a") == 255),
        **{c: F.col(f"lo_{c}") for c in CHANNELS}, "a_distinct": _distinct("a"),
    }
    return profiled.withColumns(out).drop(*_STATE)


def histogram(surfaces: DataFrame) -> DataFrame:
    """tex_id, ch, v, n: how often each value that a channel holds occurs, tiles added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = _histograms(part.column("v"))
                row, ch, v = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([part.column("tex_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (ch, v, counts[row, ch, v]))], ["tex_id", "ch", "v", "n"])

    each = surfaces.select("tex_id", "v").mapInArrow(run, "tex_id long, ch long, v long, n long")
    return each.groupBy("tex_id", "ch", "v").agg(F.sum("n").alias("n"))


def _resized(surfaces: DataFrame, resize) -> DataFrame:
    """surfaces (tex_id, v, w, h) with v, w and h of what resize makes of each batch of one size, (n, h, w, 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h = (batch.column(c).to_numpy() for c in ("w", "h"))
            for size in np.unique(np.stack([w, h], 1), axis=0):
                part = batch.filter(pa.array((w == size[0]) & (h == size[1])))
                made = resize(_values(part.column("v"))[0].reshape(-1, size[1], size[0], 4))
                n, to_h, to_w, _ = made.shape
                v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (to_h * to_w * 4)), pa.array(made.reshape(-1).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("tex_id"), v, pa.array(np.full(n, to_w)), pa.array(np.full(n, to_h))], ["tex_id", "v", "w", "h"])

    return surfaces.select("tex_id", "v", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h")).mapInArrow(run, "tex_id long, v array<long>, w long, h long")


def half_resolution(surfaces: DataFrame) -> DataFrame:
    """Surfaces (tex_id, v, w, h) at half size, each pixel the rounded mean of four. A last odd row or column is left out."""

    def half(x: np.ndarray) -> np.ndarray:
        x = x[:, : x.shape[1] // 2 * 2, : x.shape[2] // 2 * 2]
        return (x[:, 0::2, 0::2] + x[:, 0::2, 1::2] + x[:, 1::2, 0::2] + x[:, 1::2, 1::2] + 2) // 4

    return _resized(surfaces.filter("w > 1 AND h > 1"), half)


def box_resample(surfaces: DataFrame, to_w: int, to_h: int) -> DataFrame:
    """Area-average resampling with truncation: a target pixel is the mean of the source pixels whose span it covers."""
    return _resized(surfaces, lambda x: np.stack([blocks.resample(s, to_w, to_h) for s in x]))


def halving_loss(surfaces: DataFrame, width: int = 4, height: int = 4) -> DataFrame:
    """surfaces with mse and psnr, in place of v, of halving each and restoring it bilinearly, on the arrays themselves.

    The stencil is the same for every surface, so it is written out as arithmetic on array elements: no join, no shuffle.
    psnr is infinite where nothing is lost.
    """
    at = lambda x, y, c: F.get("v", F.lit((y * width + x) * 4 + c)).cast("double")
    hw, hh = width // 2, height // 2
    half = {(x, y, c): F.floor((at(2 * x, 2 * y, c) + at(2 * x + 1, 2 * y, c) + at(2 * x, 2 * y + 1, c) + at(2 * x + 1, 2 * y + 1, c) + 2) / 4).cast("double") for x in range(hw) for y in range(hh) for c in range(4)}
    df = surfaces.withColumn("__half", F.array(*(half[x, y, c] for y in range(hh) for x in range(hw) for c in range(4))))
    small = lambda x, y, c: F.get("__half", F.lit((y * hw + x) * 4 + c))

    def taps(i: int, n: int) -> tuple[int, int, float]:
        s = (i + 0.5) / 2 - 0.5
        lo = min(max(int(s // 1), 0), n - 1)
        return lo, min(lo + 1, n - 1), min(max(s - lo, 0.0), 1.0)

    errors = []
    for y in range(height):
        y0, y1, fy = taps(y, hh)
        for x in range(width):
            x0, x1, fx = taps(x, hw)
            for c in range(4):
                top = small(x0, y0, c) + (small(x1, y0, c) - small(x0, y0, c)) * fx
                bottom = small(x0, y1, c) + (small(x1, y1, c) - small(x0, y1, c)) * fx
                errors.append(at(x, y, c) - (top + (bottom - top) * fy))
    total = F.aggregate(F.array(*errors), F.lit(0.0), lambda acc, e: acc + e * e)
    df = df.withColumn("mse", total / (width * height * 4))
    psnr = F.when(F.col("mse") <= 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / F.col("mse")))
    return df.withColumn("psnr", psnr).drop("v", "__half")
