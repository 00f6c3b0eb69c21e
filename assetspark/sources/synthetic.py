"""Small bundles made of listed entries, for tests."""

from __future__ import annotations

import struct
from pathlib import Path

from assetspark.sources.container import ALIGNMENT, GPU, HEADER_BYTES, MAGIC, NOT_STREAMED, STREAM, TEXTURE, TYPE_BYTES, TYPE_NAMES

UNIT = next(k for k, v in TYPE_NAMES.items() if v == "unit")


def texture_header(w: int, h: int, code: int, mips: int = 1, linear: int = 0, flags: int = 0x0002100F, prefix_id: int = 0x0172E796, first_resident: int = NOT_STREAMED) -> bytes:
    """The CPU payload of a texture: 192 bytes of prefix, the image header and its extension."""
    prefix = bytearray(192)
    struct.pack_into("<I", prefix, 0, prefix_id)
    struct.pack_into("<I", prefix, 8, first_resident)
    dds = bytearray(148)
    dds[0:4] = b"DDS "
    for at, v in ((4, 124), (8, flags), (0xC, h), (0x10, w), (0x14, linear), (0x18, 1), (0x1C, mips), (0x6C, 0x1000), (0x80, code), (0x84, 3), (0x8C, 1)):
        struct.pack_into("<I", dds, at, v)
    dds[0x54:0x58] = b"DX10"
    return bytes(prefix + dds)


def write_bundle(path: str | Path, entries: list[tuple[int, bytes, bytes]], stream: bytes | None = b"", streamed: dict[int, tuple[int, int]] | None = None) -> None:
    """entries: (type id, CPU payload, GPU payload), grouped by type in the file as they first come; streamed: places in the stream file by entry."""
    places = streamed or {}
    order = list(dict.fromkeys(t for t, _, _ in entries))
    entries = sorted(enumerate(entries), key=lambda e: order.index(e[1][0]))
    tables = bytearray(struct.pack("<IIQ", MAGIC, len(order), len(entries)) + bytes(HEADER_BYTES - 16))
    for t in order:
        tables += struct.pack("<QQQII", 0, t, sum(e[0] == t for _, e in entries), 16, 64)
    at = HEADER_BYTES + TYPE_BYTES * len(order) + 80 * len(entries)
    cpu, gpu = bytearray(), bytearray()
    for slot, (number, (t, header, payload)) in enumerate(entries):
        gpu += bytes(-len(gpu) % ALIGNMENT)
        tables += struct.pack("<QQQQQQQIIIIII", 0x1000 + number, t, at + len(cpu), places.get(number, (0, 0))[0], len(gpu), 0, 0, len(header), places.get(number, (0, 0))[1], len(payload), 16, 64, slot)
        cpu += header
        gpu += payload
    Path(path).write_bytes(bytes(tables + cpu))
    Path(str(path) + GPU).write_bytes(bytes(gpu))
    if stream is not None:
        Path(str(path) + STREAM).write_bytes(stream)


def opaque(size: int, seed: int) -> tuple[int, bytes, bytes]:
    return UNIT, bytes(64), bytes((seed + i) % 256 for i in range(size))


def plain_texture(w: int, h: int, pixel) -> tuple[int, bytes, bytes]:
    return TEXTURE, texture_header(w, h, 28, linear=4 * w), b"".join(bytes(pixel(x, y)) for y in range(h) for x in range(w))


def chained_texture(w: int, h: int, code: int, mips: int, level, prefix_id: int = 0x0172E796) -> tuple[int, bytes, bytes]:
    """A texture with a chain, level(i) giving the bytes of each."""
    levels = [level(i) for i in range(mips)]
    return TEXTURE, texture_header(w, h, code, mips, len(levels[0]), prefix_id=prefix_id), b"".join(levels)
