"""Fields of binary columns, and headers and prefixes built by hand."""

import struct

import numpy as np
import pyarrow as pa
import pytest

from assetspark.functions import headers
from assetspark.functions.records import Records
from assetspark.sources.synthetic import texture_header

ROWS = [bytes(range(20)), b"", None, b"\xff" * 9, bytes(300)]


def test_fields_of_ragged_rows():
    r = Records(pa.array([b"skipped", *ROWS], pa.binary()).slice(1))
    long = r.lengths >= 9
    assert r.lengths.tolist() == [20, 0, 0, 9, 300] and r.get(1, 4, long).tolist() == [0x04030201, 0xFFFFFFFF, 0]
    r.put(np.array([0, 0, 0, 5, 296]), 4, np.array([1, 9, 9, 0xFFFFFFFE, 7]), long)
    r.clear(2, 4, long)
    out = r.column().to_pylist()
    assert out[0] == b"\x01\0\0\0" + bytes(range(4, 20)) and out[1:3] == [b"", b""] and out[3] == b"\xff\xff\0\0\xff\xfe\xff\xff\xff" and out[4][296:] == b"\x07\0\0\0"
    with pytest.raises(ValueError, match="outside"):
        r.get(18, 4, long)
    with pytest.raises(ValueError, match="fit"):
        r.put(0, 2, 70000, long)
    assert Records(pa.array([], pa.binary())).column().to_pylist() == []
    assert Records(pa.array([b"xDDS DDS ", b"DDS", b"", b"DDS "], pa.binary())).find(b"DDS ").tolist() == [1, -1, -1, 0]


def test_header_of_blocks_and_of_pixels():
    cpu = Records(pa.array([texture_header(64, 64, 28, linear=256, flags=0x100F)] * 3, pa.binary()))
    headers.patch(cpu, 192, [64, 32, 7], [32, 32, 5], [71, 28, 98], [64 * 32 // 2, 999, 64], [-1, 6, 1])
    for row, (w, h, code, size, mips, caps, flags) in zip(cpu.column().to_pylist(), [(64, 32, 71, 1024, 1, 0x1000, 0x81007), (32, 32, 28, 128, 6, 0x401008, 0x100F), (7, 5, 98, 64, 1, 0x1000, 0x81007)], strict=True):
        expected = bytearray(texture_header(w, h, code, mips, size, flags))
        struct.pack_into("<I", expected, 192 + 0x6C, caps)
        assert row == bytes(expected)
    legacy = bytearray(texture_header(4, 4, 71))
    legacy[192 + 0x54 : 192 + 0x58] = b"DXT1"
    with pytest.raises(ValueError, match="extension"):
        headers.patch(Records(pa.array([bytes(legacy)], pa.binary())), 192, 4, 4, 71, 8, -1)


def test_prefix_by_hand():
    old = bytearray(texture_header(32, 16, 98, prefix_id=7))
    old[20:190] = b"\xaa" * 170
    cpu = Records(pa.array([bytes(old)] * 2, pa.binary()))
    headers.write_prefix(cpu, 192, 32, 16, 98, 3, 1, np.array([True, False]))
    sizes = [8 * 4 * 16, 4 * 2 * 16, 2 * 1 * 16]
    expected = struct.pack("<IIIII", 7, 1, 1, 0, sum(sizes)) + struct.pack("<HHII", 32, 16, sizes[0], sum(sizes[1:])) + struct.pack("<HHII", 16, 8, sum(sizes[:2]), sizes[2]) + struct.pack("<HHII", 8, 4, 0, 0)
    got = cpu.column().to_pylist()
    assert got[0] == expected.ljust(192, b"\0") + bytes(old[192:]) and got[1] == bytes(old)
    for mips, resident in ((15, 1), (3, 3), (0, 0), (3, -1)):
        with pytest.raises(ValueError, match="level table"):
            headers.write_prefix(cpu, 192, 32, 16, 98, mips, resident)
    headers.patch_streamed(cpu, 192, 32, [98, 28])
    assert [struct.unpack_from("<I", x, 192 + 0x14)[0] for x in cpu.column().to_pylist()] == [0, 128]


def test_standalone_files():
    cpu = texture_header(8, 8, 98)
    assert headers.standalone(cpu, b"pixels") == cpu[192:] + b"pixels"
    legacy = bytearray(cpu)
    legacy[192 + 0x54 : 192 + 0x58] = b"DXT1"
    assert headers.standalone(bytes(legacy), b"x") == bytes(legacy[192:320]) + b"x"
    with pytest.raises(ValueError, match="no image header"):
        headers.standalone(b"DDS", b"")
