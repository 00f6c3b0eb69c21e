"""Blocks of the 128-bit format with eight modes, decoded for whole arrays of blocks, one mode after the other.

Written from the public description of the format. A mode says how a block's bits are dealt: subsets of its pixels,
bits of their end points, of shared lowest bits, and of the indices that mix the two ends of a subset for each pixel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: the subset of each pixel, a bit a pixel in shapes of two, two bits a pixel in shapes of three.
TWO = (
    0xCCCC, 0x8888, 0xEEEE, 0xECC8, 0xC880, 0xFEEC, 0xFEC8, 0xEC80, 0xC800, 0xFFEC, 0xFE80, 0xE800, 0xFFE8, 0xFF00, 0xFFF0, 0xF000,
    0xF710, 0x008E, 0x7100, 0x08CE, 0x008C, 0x7310, 0x3100, 0x8CCE, 0x088C, 0x3110, 0x6666, 0x366C, 0x17E8, 0x0FF0, 0x718E, 0x399C,
    0xAAAA, 0xF0F0, 0x5A5A, 0x33CC, 0x3C3C, 0x55AA, 0x9696, 0xA55A, 0x73CE, 0x13C8, 0x324C, 0x3BDC, 0x6996, 0xC33C, 0x9966, 0x0660,
    0x0272, 0x04E4, 0x4E40, 0x2720, 0xC936, 0x936C, 0x39C6, 0x639C, 0x9336, 0x9CC6, 0x817E, 0xE718, 0xCCF0, 0x0FCC, 0x7744, 0xEE22,
)
THREE = (
    0xAA685050, 0x6A5A5040, 0x5A5A4200, 0x5450A0A8, 0xA5A50000, 0xA0A05050, 0x5555A0A0, 0x5A5A5050, 0xAA550000, 0xAA555500, 0xAAAA5500, 0x90909090, 0x94949494, 0xA4A4A4A4, 0xA9A59450, 0x2A0A4250,
    0xA5945040, 0x0A425054, 0xA5A5A500, 0x55A0A0A0, 0xA8A85454, 0x6A6A4040, 0xA4A45000, 0x1A1A0500, 0x0050A4A4, 0xAAA59090, 0x14696914, 0x69691400, 0xA08585A0, 0xAA821414, 0x50A4A450, 0x6A5A0200,
    0xA9A58000, 0x5090A0A8, 0xA8A09050, 0x24242424, 0x00AA5500, 0x24924924, 0x24499224, 0x50A50A50, 0x500AA550, 0xAAAA4444, 0x66660000, 0xA5A0A5A0, 0x50A050A0, 0x69286928, 0x44AAAA44, 0x66666600,
    0xAA444444, 0x54A854A8, 0x95809580, 0x96969600, 0xA85454A8, 0x80959580, 0xAA141414, 0x96960000, 0xAAAA1414, 0xA05050A0, 0xA0A5A5A0, 0x96000000, 0x40804080, 0xA9A8A9A8, 0xAAAAAA44, 0x2A4A5254,
)
#: Fixed values of the format: the pixel of each further subset whose index is written without its top bit.
SECOND_OF_TWO = (
    15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 2, 8, 2, 2, 8, 8, 15, 2, 8, 2, 2, 8, 8, 2, 2,
    15, 15, 6, 8, 2, 8, 15, 15, 2, 8, 2, 2, 2, 15, 15, 6, 6, 2, 6, 8, 15, 15, 2, 2, 15, 15, 15, 15, 15, 2, 2, 15,
)
SECOND_OF_THREE = (
    3, 3, 15, 15, 8, 3, 15, 15, 8, 8, 6, 6, 6, 5, 3, 3, 3, 3, 8, 15, 3, 3, 6, 10, 5, 8, 8, 6, 8, 5, 15, 15,
    8, 15, 3, 5, 6, 10, 8, 15, 15, 3, 15, 5, 15, 15, 15, 15, 3, 15, 5, 5, 5, 8, 5, 10, 5, 10, 8, 13, 15, 12, 3, 3,
)
THIRD_OF_THREE = (
    15, 8, 8, 3, 15, 15, 3, 8, 15, 15, 15, 15, 15, 15, 15, 8, 15, 8, 15, 3, 15, 8, 15, 8, 3, 15, 6, 10, 15, 15, 10, 8,
    15, 3, 15, 10, 10, 8, 9, 10, 6, 15, 8, 15, 3, 6, 6, 8, 15, 3, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 3, 15, 15, 8,
)
#: Fixed values of the format: how far an index goes from one end to the other, out of 64.
WEIGHTS = {2: (0, 21, 43, 64), 3: (0, 9, 18, 27, 37, 46, 55, 64), 4: (0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64)}


@dataclass(frozen=True)
class Mode:
    subsets: int
    shape: int
    rotation: int
    choice: int
    colour: int
    alpha: int
    own: int
    shared: int
    index: int
    index2: int


#: Fixed values of the format: bits of each field by mode; own and shared are lowest bits of each end point or of each subset.
MODES = (
    Mode(3, 4, 0, 0, 4, 0, 1, 0, 3, 0), Mode(2, 6, 0, 0, 6, 0, 0, 1, 3, 0), Mode(3, 6, 0, 0, 5, 0, 0, 0, 2, 0), Mode(2, 6, 0, 0, 7, 0, 1, 0, 2, 0),
    Mode(1, 0, 2, 1, 5, 6, 0, 0, 2, 3), Mode(1, 0, 2, 0, 7, 8, 0, 0, 2, 2), Mode(1, 0, 0, 0, 7, 7, 1, 0, 4, 0), Mode(2, 6, 0, 0, 5, 5, 1, 0, 2, 0),
)

_PIXELS = np.arange(16)
SUBSETS = {1: np.zeros((64, 16), np.int64), 2: np.array(TWO)[:, None] >> _PIXELS & 1, 3: np.array(THREE)[:, None] >> 2 * _PIXELS & 3}
_ANCHORS = {1: [np.zeros(64, np.int64)], 2: [np.zeros(64, np.int64), np.array(SECOND_OF_TWO)], 3: [np.zeros(64, np.int64), np.array(SECOND_OF_THREE), np.array(THIRD_OF_THREE)]}
#: Whether a pixel is the one of its subset whose index is shorter, by number of subsets, shape and pixel.
SHORTER = {n: np.stack([a[:, None] == _PIXELS for a in anchors]).any(0) for n, anchors in _ANCHORS.items()}


class _Bits:
    """The bits of blocks, read on field by field."""

    def __init__(self, data: np.ndarray, at: int):
        self.bits = np.unpackbits(data, axis=1, bitorder="little")
        self.at = at

    def take(self, width: int) -> np.ndarray:
        if not width:
            return np.zeros(len(self.bits), np.int64)
        field = self.bits[:, self.at : self.at + width].astype(np.int64) << np.arange(width)
        self.at += width
        return field.sum(1)

    def indices(self, width: int, shorter: np.ndarray) -> np.ndarray:
        """An index for each pixel, a bit shorter where said."""
        widths = width - shorter.astype(np.int64)
        start = self.at + widths.cumsum(1) - widths
        self.at += int(widths[0].sum()) if len(widths) else 0
        out = np.zeros(shorter.shape, np.int64)
        for k in range(width):
            bit = np.take_along_axis(self.bits, np.minimum(start + k, 127), 1).astype(np.int64)
            out |= np.where(k < widths, bit << k, 0)
        return out


def _widened(v: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits over the range of eight, the top bits repeated below."""
    return v << 8 - bits | v >> 2 * bits - 8


def decode_mode(data: np.ndarray, number: int) -> np.ndarray:
    """Blocks of one mode, (n, 16) bytes -> (n, 16, 4)."""
    m, n = MODES[number], len(data)
    bits = _Bits(data, number + 1)
    shape, rotation, choice = bits.take(m.shape), bits.take(m.rotation), bits.take(m.choice)
    ends = np.full((n, m.subsets, 2, 4), 255, np.int64)
    for c in range(4 if m.alpha else 3):
        for s in range(m.subsets):
            for e in range(2):
                ends[:, s, e, c] = bits.take(m.alpha if c == 3 else m.colour)
    lowest = np.zeros((n, m.subsets, 2), np.int64)
    for s in range(m.subsets):
        if m.own:
            lowest[:, s, 0], lowest[:, s, 1] = bits.take(1), bits.take(1)
        elif m.shared:
            lowest[:, s] = bits.take(1)[:, None]
    extra = m.own or m.shared
    for c in range(4 if m.alpha else 3):
        v = ends[..., c] << 1 | lowest if extra else ends[..., c]
        ends[..., c] = _widened(v, (m.alpha if c == 3 else m.colour) + extra)
    shorter = SHORTER[m.subsets][shape]
    weights = np.array(WEIGHTS[m.index])[bits.indices(m.index, shorter)]
    both = np.stack([weights, weights], -1)  # for colours and for alpha
    if m.index2:
        second = np.array(WEIGHTS[m.index2])[bits.indices(m.index2, SHORTER[1][np.zeros(n, int)])]
        swap = (choice == 1)[:, None]
        both = np.stack([np.where(swap, second, weights), np.where(swap, weights, second)], -1)
    subset = SUBSETS[m.subsets][shape]
    a, b = (np.take_along_axis(ends[:, :, e], subset[..., None], 1) for e in (0, 1))
    w = both[..., [0, 0, 0, 1]]
    out = (a * (64 - w) + b * w + 32) // 64
    for r in (1, 2, 3):
        turned = np.flatnonzero(rotation == r)
        swapped = out[turned]
        swapped[..., [r - 1, 3]] = swapped[..., [3, r - 1]]
        out[turned] = swapped
    return out.astype(np.uint8)


def decode(data: np.ndarray) -> np.ndarray:
    """Blocks of any mode, (n, 16) bytes -> (n, 16, 4). The lowest set bit tells the mode; blocks without one are transparent black."""
    out = np.zeros((len(data), 16, 4), np.uint8)
    first = data[:, 0].astype(np.int64)
    number = np.where(first == 0, 8, np.log2(np.maximum(first & -first, 1)).astype(np.int64))
    for mode in range(8):
        at = np.flatnonzero(number == mode)
        for part in np.split(at, range(1 << 16, len(at), 1 << 16)):
            if len(part):
                out[part] = decode_mode(np.ascontiguousarray(data[part]), mode)
    return out
