"""Block formats, resampling and analysis on numpy surfaces and in Spark."""

import numpy as np
import pytest

from assetspark.bindings import surfaces
from assetspark.functions import blocks
from assetspark.operators import codec, profile


def ramp(w, h):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 255 // max(1, w - 1), y * 255 // max(1, h - 1), (x + y) * 255 // max(1, w + h - 2), np.full_like(x, 255)], -1).astype(np.uint8)


def psnr(a, b, channels):
    mse = ((a[..., channels].astype(float) - b[..., channels]) ** 2).mean()
    return 99.0 if mse == 0 else 10 * np.log10(65025 / mse)


@pytest.mark.parametrize(("code", "channels", "least"), [(71, [0, 1, 2], 30), (77, [0, 1, 2, 3], 30), (80, [0], 40), (83, [0, 1], 40), (98, [0, 1, 2, 3], 36)])
def test_round_trips(code, channels, least):
    s = ramp(64, 32)
    data = blocks.encode(s, code)
    assert len(data) == 64 * 32 // 16 * blocks.BLOCK_BYTES[code]
    assert psnr(s, blocks.decode(data, 64, 32, code), channels) > least


def test_solid_colours_are_exact():
    for rgba, code in (((8, 4, 8, 255), 71), ((127, 127, 255, 255), 98), ((0, 0, 0, 255), 71), ((12, 34, 56, 78), 98)):
        s = np.full((16, 16, 4), rgba, np.uint8)
        assert np.abs(blocks.decode(blocks.encode(s, code), 16, 16, code).astype(int) - s).max() <= (0 if code == 71 else 1)


def test_cutout_survives_bc1():
    s = ramp(64, 64)
    s[:, :32, 3] = 0
    assert (blocks.decode(blocks.encode(s, 71), 64, 64, 71)[..., 3] == s[..., 3]).all()


def test_chain_sizes_and_odd_sides():
    assert len(blocks.encode_chain(ramp(64, 64), 98, 7)) == sum(max(1, (64 >> i) // 4) ** 2 * 16 for i in range(7))
    assert blocks.decode(blocks.encode(ramp(6, 5), 71), 6, 5, 71).shape == (5, 6, 4)


def test_detail_of_smooth_and_rough():
    assert blocks.halving_psnr(ramp(128, 128)) > 40
    rough = np.zeros((128, 128, 4), np.uint8)
    rough[::2, ::2] = rough[1::2, 1::2] = 255
    assert blocks.halving_psnr(rough) < 20 and blocks.halving_psnr(ramp(1, 9)) == float("inf")


def test_analysis_in_spark_equals_sql(spark, sf_dir):
    raw = surfaces(spark, sf_dir)
    rows = [(str(r.tex_id), bytes(r.v), 4, 4, 28) for r in raw.limit(200).collect()]
    rows += [("bad", b"123", 4, 4, 28), ("hdr", bytes(16), 4, 4, 95), rows[0]]
    got = {r.key: r for r in codec.analyse_payloads(spark.createDataFrame(rows, "key string, payload binary, w int, h int, format int")).collect()}
    assert got["bad"].reason and got["hdr"].reason and len(got) == len(rows) - 1
    loss = {r.tex_id: r.psnr for r in profile.halving_loss(raw).collect()}
    for r in profile.analyse(profile.profiles(raw)).filter("tex_id < 200").collect():
        if str(r.tex_id) in got:
            x = got[str(r.tex_id)]
            assert (x.solid, x.flat_alpha, x.alpha_detail, x.binary_alpha, x.r, x.g, x.b, x.a) == (r.solid, r.flat_alpha, r.alpha_detail, r.binary_alpha, r.r, r.g, r.b, r.a)
            assert x.solid or abs(x.psnr - loss[r.tex_id]) < 1e-9


def test_encoding_in_spark(spark):
    s = ramp(32, 32)
    rows = [("a", s.tobytes(), 32, 32, 28, 98, 16, 16, 5), ("a", s.tobytes(), 32, 32, 28, 98, 16, 16, 5), ("b", s.tobytes(), 32, 32, 28, 95, 32, 32, 1)]
    got = {r.key: r for r in codec.encode_payloads(spark.createDataFrame(rows, "key string, payload binary, w int, h int, format int, to_format int, to_w int, to_h int, to_mips int")).collect()}
    assert len(got) == 2 and len(got["a"].encoded) == (16 + 4 + 1 + 1 + 1) * 16 and got["b"].reason
    assert psnr(blocks.decode(got["a"].encoded[:256], 16, 16, 98), blocks.resample(s, 16, 16), [0, 1, 2]) > 25


def test_tiles_add_up_and_sizes_mix(spark):
    """A surface in tiles has the profile of the whole, and surfaces of several sizes are resized in one frame."""
    rng = np.random.default_rng(7)
    held = {i: rng.integers(0, 256, (h, w, 4)) // (1 if i % 2 else 100) for i, (w, h) in enumerate([(8, 4), (6, 6), (5, 7), (64, 32)])}
    tiles = [(i, x.tolist()) for i, s in held.items() for x in np.array_split(s.reshape(-1, 4), 3) for x in [x.reshape(-1)]]
    whole = [(i, s.reshape(-1).tolist(), s.shape[1], s.shape[0]) for i, s in held.items()]
    pieces, rows = spark.createDataFrame(tiles, "tex_id long, v array<long>"), spark.createDataFrame(whole, "tex_id long, v array<long>, w int, h int")
    stats = sorted(profile.channel_stats(profile.profiles(pieces)).collect())
    assert stats == sorted(profile.channel_stats(profile.profiles(rows, whole=True)).collect())
    assert [(r.min_v, r.max_v, r.n_distinct) for r in stats] == [(s[..., c].min(), s[..., c].max(), len(np.unique(s[..., c]))) for s in held.values() for c in range(4)]
    counts = {(r.tex_id, r.ch, r.v): r.n for r in profile.histogram(pieces).collect()}
    assert counts == {(i, c, int(v)): n for i, s in held.items() for c in range(4) for v, n in zip(*np.unique(s[..., c], return_counts=True), strict=True)}
    small = {r.tex_id: np.array(r.v).reshape(r.h, r.w, 4) for r in profile.half_resolution(rows).collect()}
    for i, s in held.items():
        x = s[: s.shape[0] // 2 * 2, : s.shape[1] // 2 * 2]
        assert (small[i] == (x[0::2, 0::2] + x[1::2, 0::2] + x[0::2, 1::2] + x[1::2, 1::2] + 2) // 4).all()
    boxed = {r.tex_id: r.v for r in profile.box_resample(rows, 3, 2).collect()}
    assert all(boxed[i] == blocks.resample(s, 3, 2).reshape(-1).tolist() for i, s in held.items())
