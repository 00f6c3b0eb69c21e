"""The image headers of textures and their streaming prefixes, rewritten in place for whole columns of them.

Fields are at fixed places from the image's magic, which stands behind a prefix of the container's own. A header never
changes its length, so neither do the offsets of what follows it.
"""

from __future__ import annotations

import numpy as np

from assetspark.formats import FORMATS
from assetspark.functions.records import Records

#: Fixed values of the image header: places from its magic, and bits.
AT = {"flags": 0x08, "height": 0x0C, "width": 0x10, "size": 0x14, "mips": 0x1C, "four_cc": 0x54, "caps": 0x6C, "format": 0x80}
PITCH, LINEAR = 0x8, 0x80000
COMPLEX, TEXTURE, MIPMAP = 0x8, 0x1000, 0x400000
MAGIC, DX10 = b"DDS ", 0x30315844
CORE, EXTENSION = 128, 20
#: Fixed values of the streaming prefix: places from its start, and bytes of a level.
ID, FLAG, RESIDENT, TOTAL, LEVELS, LEVEL = 0, 4, 8, 16, 20, 12

_MOST = max(f[0] for f in FORMATS) + 1
_BLOCK, _PIXEL = (np.bincount([f[0] for f in FORMATS], [f[i] for f in FORMATS], _MOST).astype(np.int64) for i in (2, 3))


def _of(table: np.ndarray, code) -> np.ndarray:
    code = np.asarray(code, np.int64)
    return np.where((code >= 0) & (code < _MOST), table[np.clip(code, 0, _MOST - 1)], 0)


def surface_bytes(code, w, h) -> np.ndarray:
    """Bytes of one level; 0 for formats without a size."""
    w, h = np.asarray(w, np.int64), np.asarray(h, np.int64)
    return np.where(_of(_BLOCK, code) > 0, np.maximum(1, (w + 3) // 4) * np.maximum(1, (h + 3) // 4) * _of(_BLOCK, code), w * h * _of(_PIXEL, code))


def chain_bytes(code, w, h, mips) -> np.ndarray:
    """Bytes of each level of each row, (rows, most levels), 0 past its last."""
    w, h, mips = (np.asarray(x, np.int64)[:, None] for x in (w, h, mips))
    level = np.arange(max(1, int(mips.max(initial=1))))[None]
    sizes = surface_bytes(np.asarray(code, np.int64)[:, None], np.maximum(1, w >> level), np.maximum(1, h >> level))
    return np.where(level < np.maximum(mips, 1), sizes, 0)


def patch(cpu: Records, at, w, h, code, size, mips, rows: np.ndarray | None = None) -> None:
    """Dimensions, format, size field and flags of the headers at `at`; level count and caps where mips isn't negative.

    Block formats are described by the size of their first level, others by the bytes of a row. Only headers with the
    extension can be rewritten.
    """
    rows = np.ones(len(cpu), bool) if rows is None else rows
    at = np.broadcast_to(at, len(cpu))
    w, h, code, size, mips = (np.broadcast_to(np.asarray(x, np.int64), len(cpu)) for x in (w, h, code, size, mips))
    if (cpu.get(at + AT["four_cc"], 4, rows) != DX10).any():
        raise ValueError("only headers with the extension can be rewritten")
    block = _of(_BLOCK, code) > 0
    flags = np.zeros(len(cpu), np.int64)
    flags[rows] = cpu.get(at + AT["flags"], 4, rows)
    flags = np.where(block, flags & ~PITCH | LINEAR, flags & ~LINEAR | PITCH)
    for field, value in (("flags", flags), ("height", h), ("width", w), ("size", np.where(block, size, w * _of(_PIXEL, code))), ("format", code)):
        cpu.put(at + AT[field], 4, value, rows)
    counted = rows & (mips >= 0)
    caps = np.zeros(len(cpu), np.int64)
    caps[counted] = cpu.get(at + AT["caps"], 4, counted)
    cpu.put(at + AT["mips"], 4, np.maximum(mips, 0), counted)
    cpu.put(at + AT["caps"], 4, np.where(mips > 1, caps | TEXTURE | COMPLEX | MIPMAP, (caps | TEXTURE) & ~(COMPLEX | MIPMAP)), counted)


def patch_streamed(cpu: Records, at, w, code, rows: np.ndarray | None = None) -> None:
    """The conventions of a streamed texture, whose resident payload is a tail: neither size flag, a row's bytes where there are no blocks."""
    rows = np.ones(len(cpu), bool) if rows is None else rows
    at, w, code = (np.broadcast_to(np.asarray(x, np.int64), len(cpu)) for x in (at, w, code))
    flags = np.zeros(len(cpu), np.int64)
    flags[rows] = cpu.get(at + AT["flags"], 4, rows)
    cpu.put(at + AT["flags"], 4, flags & ~(LINEAR | PITCH), rows)
    cpu.put(at + AT["size"], 4, np.where(_of(_BLOCK, code) > 0, 0, w * _of(_PIXEL, code)), rows)


def write_prefix(cpu: Records, prefix, w, h, code, mips, resident, rows: np.ndarray | None = None) -> None:
    """The streaming prefix before the magic at `prefix`: all but the id cleared, then flag, first resident level, total and a row for each level."""
    rows = np.ones(len(cpu), bool) if rows is None else rows
    prefix, w, h, code, mips, resident = (np.broadcast_to(np.asarray(x, np.int64), len(cpu)) for x in (prefix, w, h, code, mips, resident))
    if (rows & ((mips < 1) | (resident < 0) | (resident >= mips) | (LEVELS + LEVEL * mips > prefix))).any():
        raise ValueError("a level table doesn't fit its prefix, or its first resident level isn't one")
    chain = chain_bytes(code, w, h, np.where(rows, mips, 1))
    total = chain.sum(1)
    ids = np.zeros(len(cpu), np.int64)
    ids[rows] = cpu.get(ID, 4, rows)
    cpu.clear(FLAG, prefix, rows)
    for at, value in ((FLAG, np.where(ids == 0, 2, 1)), (RESIDENT, resident), (TOTAL, total)):
        cpu.put(at, 4, value, rows)
    upto = chain.cumsum(1)
    for level in range(chain.shape[1]):
        here, last = rows & (level < mips), level == mips - 1
        at = LEVELS + LEVEL * level
        cpu.put(at, 2, np.maximum(1, w >> level) & 0xFFFF, here)
        cpu.put(at + 2, 2, np.maximum(1, h >> level) & 0xFFFF, here)
        cpu.put(at + 4, 4, np.where(last, 0, upto[:, level]), here)
        cpu.put(at + 8, 4, np.where(last, 0, total - upto[:, level]), here)


def standalone(cpu: bytes, surface: bytes) -> bytes:
    """An image file of its own: the header in a CPU payload, with its extension if it has one, before the surface."""
    at = cpu.find(MAGIC)
    if at < 0 or at + CORE > len(cpu):
        raise ValueError("no image header")
    extended = int.from_bytes(cpu[at + AT["four_cc"] : at + AT["four_cc"] + 4], "little") == DX10
    return cpu[at : at + CORE + EXTENSION * extended] + surface
