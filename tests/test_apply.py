"""Plans applied to bundles on disk, read again and verified."""

import os
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetspark.functions import blocks, headers
from assetspark.operators import library, plan
from assetspark.operators.apply import apply_plan
from assetspark.operators.plan import Options
from assetspark.sources import container, synthetic
from assetspark.sources.container import GPU, STREAM


def noise(w, h, code, seed):
    rng = np.random.default_rng(seed)
    return lambda i: rng.integers(0, 256, blocks.surface_size(max(1, w >> i), max(1, h >> i), code), dtype=np.uint8).tobytes()


def photo(x, y):
    return (x * 3 % 256, y * 5 % 256, (x ^ y) % 256, 255)


PLAIN = synthetic.plain_texture(64, 32, photo)
SOLID = synthetic.plain_texture(64, 64, lambda x, y: (8, 4, 8, 255))
CHAIN = synthetic.chained_texture(256, 128, 98, 9, noise(256, 128, 98, 1))
RAW_CHAIN = synthetic.chained_texture(64, 64, 28, 7, noise(64, 64, 28, 2), prefix_id=0)
OTHER = [synthetic.opaque(8192, 5), synthetic.opaque(8192, 5), synthetic.opaque(333, 1)]


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "in/Mods/One").mkdir(parents=True)
    synthetic.write_bundle(tmp_path / "in/Mods/One/a.patch_0", [*OTHER, PLAIN, CHAIN, SOLID, PLAIN, RAW_CHAIN], stream=b"tail" * 50)
    synthetic.write_bundle(tmp_path / "in/Mods/b.patch_1", [OTHER[0], PLAIN], stream=None)
    return str(tmp_path / "in")


def run(spark, root, out, options, **kwargs):
    entries = library.entries_of(spark, root)
    made = library.plan_of(entries, options)
    done = {os.path.relpath(r.bundle, root): r for r in library.optimise(entries, made, root, out, **kwargs).collect()}
    return done, made


def read(spark, root):
    return {(os.path.relpath(r.bundle, root), r.name): r for r in library.entries_of(spark, root).collect()}


def payload(r, ending=GPU, offset="gpu_offset", size="gpu_size"):
    with open(r.bundle + ending, "rb") as f:
        f.seek(getattr(r, offset))
        return f.read(getattr(r, size))


def name(number):
    return f"{0x1000 + number:016X}"


def no_leftovers(folder):
    return not [f for _, _, files in os.walk(folder) for f in files if f.endswith(".tmp")]


def test_shrinks_and_verifies_and_a_second_run_changes_nothing(spark, root, tmp_path):
    out = str(tmp_path / "out")
    done, made = run(spark, root, out, Options())
    assert library.verify_library(spark, out, original=root).collect() == [] and no_leftovers(out)
    a = done["Mods/One/a.patch_0"]
    assert a.n_planned == 3 and a.n_shared == 2 and a.bytes_after == os.path.getsize(f"{out}/Mods/One/a.patch_0{GPU}") < a.bytes_before
    expected = {os.path.relpath(r.bundle, root): r.file_after for r in library.predicted(library.entries_of(spark, root), made).collect()}
    assert expected == {b: r.bytes_after for b, r in done.items()}
    before, after = read(spark, root), read(spark, out)
    assert before.keys() == after.keys()
    for k, b in before.items():
        n = after[k]
        assert (b.cpu_offset, b.cpu_size, b.file_id, b.prefix_id, b["index"]) == (n.cpu_offset, n.cpu_size, n.file_id, n.prefix_id, n["index"])
        if b.type_name != "texture":
            assert payload(b) == payload(n)
    t = after[("Mods/One/a.patch_0", name(3))]
    assert (t.w, t.h, t.format, t.mips, t.linear_size) == (64, 32, 71, 1, 64 * 32 // 2) and t.flags & 0x80000 and not t.flags & 0x8
    s = after[("Mods/One/a.patch_0", name(5))]
    assert (s.w, s.h, s.format, s.gpu_size) == (16, 16, 71, 128) and (blocks.decode(payload(s), 16, 16, 71) == [8, 4, 8, 255]).all()
    assert Path(f"{out}/Mods/One/a.patch_0{STREAM}").read_bytes() == b"tail" * 50 and not os.path.exists(f"{out}/Mods/b.patch_1{STREAM}")
    again, _ = run(spark, out, str(tmp_path / "twice"), Options())
    assert again == {} and not os.path.exists(tmp_path / "twice")


def test_writes_over_its_source(spark, root):
    before = read(spark, root)
    done, _ = run(spark, root, root, Options(strategy="smallest"))
    assert set(done) == {"Mods/One/a.patch_0", "Mods/b.patch_1"} and no_leftovers(root)
    assert library.verify_library(spark, root).collect() == []
    after = read(spark, root)
    assert sum(r.gpu_size for r in after.values()) < sum(r.gpu_size for r in before.values())
    assert Path(f"{root}/Mods/One/a.patch_0{STREAM}").read_bytes() == b"tail" * 50


def test_without_sharing_each_entry_has_its_place(spark, root, tmp_path):
    done, _ = run(spark, root, str(tmp_path / "out"), Options(), share=False)
    after = [r for r in read(spark, str(tmp_path / "out")).values() if r.gpu_size]
    assert done["Mods/One/a.patch_0"].n_shared == 0 and len({(r.bundle, r.gpu_offset) for r in after}) == len(after)


@pytest.mark.parametrize("single", [False, True])
def test_dropped_levels_are_slices(spark, root, tmp_path, single):
    out = str(tmp_path / "out")
    run(spark, root, out, Options(cap=64, single=single))
    t = read(spark, out)[("Mods/One/a.patch_0", name(4))]
    levels = [blocks.surface_size(max(1, 256 >> i), max(1, 128 >> i), 98) for i in range(9)]
    skip = sum(levels[:2])
    keep = levels[2] if single else sum(levels[2:])
    assert payload(t) == CHAIN[2][skip : skip + keep] and (t.w, t.h, t.format, t.mips, t.linear_size) == (64, 32, 98, 1 if single else 7, levels[2])
    cpu = payload(t, "", "cpu_offset", "cpu_size")
    caps = struct.unpack_from("<I", cpu, t.prefix + 0x6C)[0]
    assert caps == (0x1000 if single else 0x401008) and library.verify_library(spark, out, original=root).collect() == []


def test_a_chain_moves_to_the_stream_file(spark, root, tmp_path):
    out = str(tmp_path / "out")
    done, _ = run(spark, root, out, Options(floor=32))
    after = read(spark, out)
    for number, (_, _, data), w, h, code, flag in ((4, CHAIN, 256, 128, 98, 1), (7, RAW_CHAIN, 64, 64, 28, 2)):
        t = after[("Mods/One/a.patch_0", name(number))]
        mips = 9 if number == 4 else 7
        levels = [blocks.surface_size(max(1, w >> i), max(1, h >> i), code) for i in range(mips)]
        resident = 3 if number == 4 else 1
        assert payload(t, STREAM, "stream_offset", "stream_size") == data and payload(t) == data[sum(levels[:resident]) :]
        assert (t.w, t.h, t.format, t.mips, t.first_resident) == (w, h, code, mips, resident) and t.stream_offset % 64 == 0
        assert not t.flags & 0x80008 and t.linear_size == (0 if code == 98 else 4 * w)
        cpu = payload(t, "", "cpu_offset", "cpu_size")
        upto = np.cumsum(levels)
        expected = struct.pack("<IIIII", (0x0172E796, 0)[number == 7], flag, resident, 0, sum(levels))
        for i in range(mips):
            expected += struct.pack("<HHII", max(1, w >> i), max(1, h >> i), *((0, 0) if i == mips - 1 else (upto[i], sum(levels) - upto[i])))
        assert cpu[:192] == expected.ljust(192, b"\0")
    assert library.verify_library(spark, out, original=root).collect() == []
    again, _ = run(spark, out, str(tmp_path / "twice"), Options(floor=32))
    assert again == {}


def test_a_generated_chain_is_streamed_and_earlier_streams_are_carried(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    levels = [blocks.surface_size(32 >> i, 32 >> i, 98) for i in range(4)]
    whole = np.random.default_rng(3).integers(0, 256, sum(levels), dtype=np.uint8).tobytes()
    held = (container.TEXTURE, synthetic.texture_header(32, 32, 98, 4, 0, flags=0x2100F & ~0x80008, first_resident=2), whole[sum(levels[:2]) :])
    big = synthetic.plain_texture(128, 128, photo)
    synthetic.write_bundle(root / "x", [big, held, OTHER[0]], stream=bytes(128) + whole, streamed={1: (128, len(whole))})
    done, _ = run(spark, str(root), out, Options(generate=True, floor=32))
    after = read(spark, out)
    t, kept = after[("x", name(0))], after[("x", name(1))]
    chain = [blocks.surface_size(max(1, 128 >> i), max(1, 128 >> i), 71) for i in range(8)]
    assert (t.w, t.h, t.format, t.mips, t.first_resident, t.stream_size, t.gpu_size) == (128, 128, 71, 8, 2, sum(chain), sum(chain[2:]))
    made = payload(t, STREAM, "stream_offset", "stream_size")
    assert made[sum(chain[:2]) :] == payload(t) and made == blocks.encode_chain(blocks.decode(big[2], 128, 128, 28), 71, 8)
    assert payload(kept, STREAM, "stream_offset", "stream_size") == whole and payload(kept) == held[2] and kept.stream_offset % 64 == 0
    found = library.verify_library(spark, out).collect()
    assert {(r.category, r.pos) for r in found} == {("stream-table", kept.pos)}  # that header never had a level table


def test_excluded_edited_and_reset_textures(spark, root, tmp_path):
    entries = library.entries_of(spark, root)
    made = library.plan_of(entries, Options())
    first = made.filter(F.col("bundle").endswith("b.patch_1")).first()
    edits = spark.createDataFrame([(r.bundle, r.pos, r.bundle == first.bundle, 98) for r in made.select("bundle", "pos").collect()], "bundle string, pos long, include boolean, to_format long")
    edited = library.override(made, edits)
    assert plan.is_recommended(edited).filter("NOT recommended AND mips > 1").count() == 0
    done = {os.path.basename(r.bundle): r for r in library.optimise(entries, edited, root, str(tmp_path / "out")).collect()}
    after = read(spark, str(tmp_path / "out"))
    assert after[("Mods/b.patch_1", name(1))].format == 98 and done["b.patch_1"].n_planned == 1
    assert done["a.patch_0"].n_planned == 0 and {r.format for (b, _), r in after.items() if r.format and b.endswith("a.patch_0")} == {28, 98}
    back = plan.reset(edited)
    columns = ["bundle", "pos", "include", "to_format", "to_w", "to_h", "predicted_size"]
    assert sorted(back.select(columns).collect()) == sorted(made.select(columns).collect())


def test_a_payload_past_its_file_fails_and_leaves_nothing(spark, root, tmp_path):
    path = f"{root}/Mods/One/a.patch_0"
    entries = library.entries_of(spark, root)
    made = library.plan_of(entries, Options())
    os.truncate(path + GPU, os.path.getsize(path + GPU) - 100)
    with pytest.raises(Exception, match="past"):
        apply_plan(entries, made, root, str(tmp_path / "out")).collect()
    assert not [f for _, _, files in os.walk(tmp_path / "out") for f in files]


def test_textures_as_image_files(spark, root, tmp_path):
    entries = library.entries_of(spark, root)
    files = {(os.path.relpath(r.bundle, root), r.pos): r.file for r in library.export_images(entries, str(tmp_path / "images")).collect()}
    held = {(b, r.pos): r for (b, _), r in read(spark, root).items() if r.type_name == "texture"}
    assert files.keys() == held.keys() and no_leftovers(tmp_path / "images")
    for k, r in held.items():
        assert (tmp_path / "images" / files[k]).read_bytes() == headers.standalone(payload(r, "", "cpu_offset", "cpu_size"), payload(r))
