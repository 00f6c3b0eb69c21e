"""Pixels and 4x4 blocks as numpy arrays: decoding, encoding, resampling, statistics. Surfaces are (h, w, 4) uint8, RGBA.

Written from the public descriptions of the block formats. BC7 is read in all its modes (bc7.py) and written in the one
without partitions and with one index set (6).
"""

from __future__ import annotations

import numpy as np

from assetspark.formats import FORMATS
from assetspark.functions import bc7

WEIGHTS4 = np.array(bc7.WEIGHTS[4])
RGBA8, BGRA8 = (28, 29), (87, 91)
BC1, BC3, BC4, BC5, BC7 = (71, 72), (77, 78), (80,), (83,), (98, 99)
BLOCK_BYTES = {f[0]: f[2] for f in FORMATS if f[2]}


class UnsupportedFormat(ValueError):
    pass


def surface_size(w: int, h: int, code: int) -> int:
    """Bytes of one level; 0 for formats without a size."""
    block, pixel = next(((f[2], f[3]) for f in FORMATS if f[0] == code), (0, 0))
    return max(1, (w + 3) // 4) * max(1, (h + 3) // 4) * block if block else w * h * pixel


def to_blocks(surface: np.ndarray) -> np.ndarray:
    """(blocks, 16, channels), rows of blocks first; sides that aren't multiples of 4 repeat their last pixels."""
    h, w = surface.shape[:2]
    padded = np.pad(surface, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")
    rows, cols = padded.shape[0] // 4, padded.shape[1] // 4
    return padded.reshape(rows, 4, cols, 4, -1).transpose(0, 2, 1, 3, 4).reshape(rows * cols, 16, -1)


def from_blocks(blocks: np.ndarray, w: int, h: int) -> np.ndarray:
    cols, rows = max(1, (w + 3) // 4), max(1, (h + 3) // 4)
    return blocks.reshape(rows, cols, 4, 4, -1).transpose(0, 2, 1, 3, 4).reshape(rows * 4, cols * 4, -1)[:h, :w]


def _bits(words: np.ndarray, width: int, n: int) -> np.ndarray:
    return (words[:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)


def _expand565(c: np.ndarray) -> np.ndarray:
    r, g, b = (c >> 11) & 31, (c >> 5) & 63, c & 31
    return np.stack([(r << 3) | (r >> 2), (g << 2) | (g >> 4), (b << 3) | (b >> 2)], -1).astype(np.int64)


def _pack565(rgb: np.ndarray) -> np.ndarray:
    q = np.rint(rgb * np.array([31, 63, 31]) / 255).astype(np.int64)
    return (q[..., 0] << 11) | (q[..., 1] << 5) | q[..., 2]


def _colours(data: np.ndarray, cutout: bool) -> np.ndarray:
    """Colour halves of blocks, (n, 8) bytes -> (n, 16, 4)."""
    words = np.ascontiguousarray(data).view("<u2").astype(np.int64)
    a, b = _expand565(words[:, 0]), _expand565(words[:, 1])
    four = ((words[:, 0] > words[:, 1]) | (not cutout))[:, None]
    palette = np.zeros((len(data), 4, 4), np.int64)
    palette[..., 3] = 255
    palette[:, 0, :3], palette[:, 1, :3] = a, b
    palette[:, 2, :3] = np.where(four, (2 * a + b) // 3, (a + b) // 2)
    palette[:, 3, :3] = np.where(four, (a + 2 * b) // 3, 0)
    palette[:, 3, 3] = np.where(four[:, 0], 255, 0)
    index = _bits(np.ascontiguousarray(data[:, 4:8]).view("<u4")[:, 0].astype(np.uint64), 2, 16).astype(np.int64)
    return np.take_along_axis(palette, index[..., None], 1).astype(np.uint8)


def _ramp(data: np.ndarray) -> np.ndarray:
    """One-channel blocks, (n, 8) bytes -> (n, 16)."""
    a, b = data[:, 0].astype(np.int64), data[:, 1].astype(np.int64)
    eight = [a, b] + [((7 - k) * a + k * b) // 7 for k in range(1, 7)]
    six = [a, b] + [((5 - k) * a + k * b) // 5 for k in range(1, 5)] + [np.zeros_like(a), np.full_like(a, 255)]
    palette = np.where((a > b)[:, None], np.stack(eight, 1), np.stack(six, 1))
    words = np.zeros((len(data), 8), np.uint8)
    words[:, :6] = data[:, 2:8]
    return np.take_along_axis(palette, _bits(words.view("<u8")[:, 0], 3, 16).astype(np.int64), 1).astype(np.uint8)


def decode(payload: bytes, w: int, h: int, code: int) -> np.ndarray:
    """A surface of any format that can be shown as RGBA."""
    if code in RGBA8 or code in BGRA8:
        flat = np.frombuffer(payload, np.uint8, w * h * 4).reshape(h, w, 4)
        return flat[..., [2, 1, 0, 3]] if code in BGRA8 else flat
    n = max(1, (w + 3) // 4) * max(1, (h + 3) // 4)
    if code not in BLOCK_BYTES or code in (81, 84, 95, 96):
        raise UnsupportedFormat(f"format {code}")
    data = np.frombuffer(payload, np.uint8, n * BLOCK_BYTES[code]).reshape(n, -1)
    out = np.zeros((n, 16, 4), np.uint8)
    out[..., 3] = 255
    if code in BC1:
        out = _colours(data, True)
    elif code in BC3:
        out = _colours(data[:, 8:], False)
        out[..., 3] = _ramp(data)
    elif code in (74, 75):
        out = _colours(data[:, 8:], False)
        out[..., 3] = (_bits(np.ascontiguousarray(data[:, :8]).view("<u8")[:, 0], 4, 16) * np.uint64(17)).astype(np.uint8)
    elif code in BC4:
        out[..., 0] = _ramp(data)
    elif code in BC5:
        out[..., 0], out[..., 1] = _ramp(data), _ramp(data[:, 8:])
    else:
        out = bc7.decode(data)
    return from_blocks(out, w, h)


def _axis_ends(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two end points for each block's points, (n, 16, c): the extent along their main axis."""
    mean = points.mean(1, keepdims=True)
    d = points - mean
    axis = np.linalg.eigh(np.einsum("nki,nkj->nij", d, d))[1][..., -1]
    t = np.einsum("nki,ni->nk", d, axis)
    return tuple(np.clip(mean[:, 0] + e(t, 1)[:, None] * axis, 0, 255) for e in (np.max, np.min))


def _nearest(points: np.ndarray, palette: np.ndarray) -> np.ndarray:
    return ((points[:, :, None] - palette[:, None]) ** 2).sum(-1).argmin(-1)


def _packed(index: np.ndarray, width: int) -> np.ndarray:
    return (index.astype(np.uint64) << (np.arange(index.shape[1], dtype=np.uint64) * np.uint64(width))).sum(1, dtype=np.uint64)


def _encode_colours(blocks: np.ndarray, cutout: bool) -> np.ndarray:
    rgb = blocks[..., :3].astype(np.float64)
    hi, lo = _axis_ends(rgb)
    a, b = _pack565(hi), _pack565(lo)
    swap = (a > b) if cutout else (a < b)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    x, y = _expand565(a), _expand565(b)
    if cutout:  # a <= b: three colours and a transparent one
        palette = np.stack([x, y, (x + y) // 2], 1)
    else:  # equal ends would mean three colours, of which only the first is used
        palette = np.stack([x, y, (2 * x + y) // 3, (x + 2 * y) // 3], 1)
    index = _nearest(rgb, palette.astype(np.float64))
    if cutout:
        index[blocks[..., 3] < 128] = 3
    else:
        index[a == b] = 0
    out = np.zeros((len(blocks), 8), np.uint8)
    out[:, 0:2], out[:, 2:4] = a.astype("<u2").view(np.uint8).reshape(-1, 2), b.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[:, 4:8] = _packed(index, 2).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out


def _encode_ramp(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64)
    a, b = v.max(1), v.min(1)
    palette = np.stack([a, b] + [((7 - k) * a + k * b) // 7 for k in range(1, 7)], 1)
    index = np.abs(v[..., None] - palette[:, None]).argmin(-1)
    index[a == b] = 0
    out = np.zeros((len(v), 8), np.uint8)
    out[:, 0], out[:, 1] = a, b
    out[:, 2:8] = _packed(index, 3).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return out


def _encode_mode6(blocks: np.ndarray) -> np.ndarray:
    points = blocks.astype(np.float64)
    hi, lo = _axis_ends(points)
    best, best_error = None, None
    for p0, p1 in ((0, 0), (0, 1), (1, 0), (1, 1)):  # the shared lowest bits of either end
        q = [np.clip(np.rint((e - p) / 2), 0, 127).astype(np.int64) for e, p in ((lo, p0), (hi, p1))]
        ends = [q[0] * 2 + p0, q[1] * 2 + p1]
        palette = (ends[0][:, None] * (64 - WEIGHTS4[None, :, None]) + ends[1][:, None] * WEIGHTS4[None, :, None] + 32) // 64
        index = _nearest(points, palette.astype(np.float64))
        error = ((points - np.take_along_axis(palette, index[..., None], 1)) ** 2).sum((1, 2))
        fields = (q[0], q[1], np.full(len(points), p0), np.full(len(points), p1), index)
        if best is None:
            best, best_error = [f.copy() for f in fields], error
        else:
            better = error < best_error
            for mine, other in zip(best, fields, strict=True):
                mine[better] = other[better]
            best_error = np.minimum(error, best_error)
    q0, q1, p0, p1, index = best
    flip = index[:, 0] >= 8  # the first index is written without its top bit
    q0, q1, p0, p1 = np.where(flip[:, None], q1, q0), np.where(flip[:, None], q0, q1), np.where(flip, p1, p0), np.where(flip, p0, p1)
    index = np.where(flip[:, None], 15 - index, index)
    lo64 = np.full(len(points), 0x40, np.uint64)
    for c in range(4):
        for e, q in enumerate((q0, q1)):
            lo64 |= q[:, c].astype(np.uint64) << np.uint64(7 + 14 * c + 7 * e)
    lo64 |= p0.astype(np.uint64) << np.uint64(63)
    hi64 = p1.astype(np.uint64) | index[:, 0].astype(np.uint64) << np.uint64(1) | _packed(index[:, 1:], 4) << np.uint64(4)
    return np.stack([lo64, hi64], 1).astype("<u8").view(np.uint8).reshape(-1, 16)


def encode(surface: np.ndarray, code: int) -> bytes:
    """A surface in one of the formats offered: BC1, BC3, BC4, BC5, BC7 or plain RGBA. BC1 keeps a cutout where any pixel isn't opaque."""
    if code in RGBA8:
        return surface.tobytes()
    blocks = to_blocks(surface)
    if code in BC1:
        return _encode_colours(blocks, bool((surface[..., 3] != 255).any())).tobytes()
    if code in BC3:
        return np.concatenate([_encode_ramp(blocks[..., 3]), _encode_colours(blocks, False)], 1).tobytes()
    if code in BC4:
        return _encode_ramp(blocks[..., 0]).tobytes()
    if code in BC5:
        return np.concatenate([_encode_ramp(blocks[..., 0]), _encode_ramp(blocks[..., 1])], 1).tobytes()
    if code in BC7:
        return _encode_mode6(blocks).tobytes()
    raise UnsupportedFormat(f"no encoder for format {code}")


def resample(surface: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area average with truncation."""
    def edges(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.arange(to) * n // to
        return lo, np.maximum(lo + 1, (np.arange(to) + 1) * n // to)

    sums = np.zeros((surface.shape[0] + 1, surface.shape[1] + 1, 4), np.int64)
    sums[1:, 1:] = surface.astype(np.int64).cumsum(0).cumsum(1)
    (y0, y1), (x0, x1) = edges(surface.shape[0], h), edges(surface.shape[1], w)
    box = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return (box // ((y1 - y0)[:, None] * (x1 - x0)[None])[..., None]).astype(np.uint8)


def encode_chain(surface: np.ndarray, code: int, mips: int) -> bytes:
    """Every level of a chain, each from the one before, the largest first."""
    out = []
    for level in range(mips):
        if level:
            surface = resample(surface, max(1, surface.shape[1] // 2), max(1, surface.shape[0] // 2))
        out.append(encode(surface, code))
    return b"".join(out)


def halving_psnr(surface: np.ndarray) -> float:
    """Loss in dB of halving a surface and restoring it bilinearly; infinite if nothing is lost."""
    h, w = surface.shape[:2]
    if w < 2 or h < 2:
        return float("inf")
    s = surface[: h // 2 * 2, : w // 2 * 2].astype(np.int64)
    half = ((s[0::2, 0::2] + s[0::2, 1::2] + s[1::2, 0::2] + s[1::2, 1::2] + 2) // 4).astype(np.float64)

    def taps(n: int, small: int):
        at = (np.arange(n) + 0.5) / 2 - 0.5
        lo = np.clip(np.floor(at).astype(int), 0, small - 1)
        return lo, np.clip(lo + 1, 0, small - 1), np.clip(at - lo, 0, 1)

    (y0, y1, fy), (x0, x1, fx) = taps(h, h // 2), taps(w, w // 2)
    rows = half[:, x0] + (half[:, x1] - half[:, x0]) * fx[None, :, None]
    full = rows[y0] + (rows[y1] - rows[y0]) * fy[:, None, None]
    mse = float(((surface - full) ** 2).mean())
    return float("inf") if mse <= 0 else 10 * float(np.log10(65025 / mse))


def analyse(surface: np.ndarray) -> dict:
    """Channel statistics and classes of a surface in one pass; solid ones are spared the measure of their detail."""
    counts = [np.bincount(surface[..., c].ravel(), minlength=256) for c in range(4)]
    held = [np.flatnonzero(n) for n in counts]
    lo, hi = [int(x[0]) for x in held], [int(x[-1]) for x in held]
    solid = lo == hi
    varies = lo[3] != hi[3]
    return {
        "solid": solid, "flat_alpha": lo[:3] == hi[:3] and varies, "alpha_detail": varies or lo[3] != 255, "binary_alpha": len(held[3]) == 2 and lo[3] == 0 and hi[3] == 255,
        **dict(zip("rgba", lo, strict=True)), "psnr": None if solid else halving_psnr(surface),
    }
