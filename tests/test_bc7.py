"""Blocks of every mode against a decoder that reads one bit after the other."""

import numpy as np
import pytest

from assetspark.functions import bc7, blocks


def plain(block: bytes) -> list[list[int]]:
    """16 pixels, decoded bit by bit."""
    number = int.from_bytes(block, "little")
    mode = next(i for i in range(8) if number >> i & 1)
    m = bc7.MODES[mode]
    at = mode + 1

    def take(width):
        nonlocal at
        v = number >> at & (1 << width) - 1
        at += width
        return v

    shape, rotation, choice = take(m.shape), take(m.rotation), take(m.choice)
    count = 2 * m.subsets
    channels = [[take(m.colour) for _ in range(count)] for _ in range(3)]
    channels.append([take(m.alpha) for _ in range(count)] if m.alpha else [255] * count)
    low = [take(1) for _ in range(count)] if m.own else [b for b in [take(1) for _ in range(m.subsets)] for _ in range(2)] if m.shared else None
    for c in range(4 if m.alpha else 3):
        width = m.alpha if c == 3 else m.colour
        for e in range(count):
            v = channels[c][e]
            if low:
                v = 2 * v + low[e]
            w = width + bool(low)
            v <<= 8 - w
            channels[c][e] = v | v >> w
    shapes = {1: [0] * 16, 2: [bc7.TWO[shape] >> i & 1 for i in range(16)], 3: [bc7.THREE[shape] >> 2 * i & 3 for i in range(16)]}[m.subsets]
    anchors = {1: {0}, 2: {0, bc7.SECOND_OF_TWO[shape]}, 3: {0, bc7.SECOND_OF_THREE[shape], bc7.THIRD_OF_THREE[shape]}}[m.subsets]
    first = [bc7.WEIGHTS[m.index][take(m.index - (i in anchors))] for i in range(16)]
    second = [bc7.WEIGHTS[m.index2][take(m.index2 - (i == 0))] for i in range(16)] if m.index2 else first
    assert at == 128
    if choice:
        first, second = second, first
    out = []
    for i in range(16):
        pixel = []
        for c in range(4):
            w = second[i] if c == 3 else first[i]
            pixel.append((channels[c][2 * shapes[i]] * (64 - w) + channels[c][2 * shapes[i] + 1] * w + 32) >> 6)
        if rotation:
            pixel[rotation - 1], pixel[3] = pixel[3], pixel[rotation - 1]
        out.append(pixel)
    return out


@pytest.mark.parametrize("mode", range(8))
def test_random_blocks_of_each_mode(mode):
    rng = np.random.default_rng(mode)
    data = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    data[:, 0] = data[:, 0] >> (mode + 1) << (mode + 1) & 0xFF | 1 << mode
    assert (bc7.decode(data) == np.array([plain(bytes(b)) for b in data])).all()


def test_hand_built_blocks():
    """One block of two subsets with given ends, one solid block of each mode without shapes, and one of no mode."""
    number, at = 0, 0

    def put(v, width):
        nonlocal number, at
        number |= v << at
        at += width

    put(0b1000, 4)  # mode 3
    put(13, 6)  # the upper half and the lower half
    for ends in ((127, 127, 0, 0), (0, 0, 127, 127), (64, 64, 0, 0)):  # red, green, blue of both subsets
        for v in ends:
            put(v, 7)
    put(0b0011, 4)
    got = bc7.decode(np.frombuffer(number.to_bytes(16, "little"), np.uint8)[None])[0]
    assert got[:8].tolist() == [[255, 1, 129, 255]] * 8 and got[8:].tolist() == [[0, 254, 0, 255]] * 8
    assert (bc7.decode(np.zeros((1, 16), np.uint8)) == 0).all()


def test_shapes_are_consistent():
    """Pixels with short indices lie in their subset, each subset has pixels, and the first pixel is in the first."""
    for i in range(64):
        two, three = bc7.SUBSETS[2][i], bc7.SUBSETS[3][i]
        assert set(two) == {0, 1} and set(three) == {0, 1, 2} and two[0] == three[0] == 0
        assert (two[bc7.SECOND_OF_TWO[i]], three[bc7.SECOND_OF_THREE[i]], three[bc7.THIRD_OF_THREE[i]]) == (1, 1, 2)


def test_any_payload_decodes_to_its_size():
    data = np.random.default_rng(1).integers(0, 256, 16 * 40, dtype=np.uint8).tobytes()
    assert blocks.decode(data, 30, 18, 98).shape == (18, 30, 4)
