"""Bundles on disk: reading, rejecting, packing, verifying."""

import os
import struct
import tracemalloc
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assetspark.operators import layout, verify
from assetspark.sources import container, synthetic
from assetspark.sources.container import GPU, BundleSource


@pytest.fixture()
def root(tmp_path):
    for folder in ("Alpha", "R-36/Shorty", "R-36/Long boi", "Alpha/backup"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
    entries = [synthetic.opaque(8192, 5), synthetic.opaque(8192, 5), synthetic.opaque(8192, 6), synthetic.plain_texture(16, 8, lambda x, y: (x, y, x ^ y, 255)), synthetic.opaque(100, 1)]
    for name in ("Alpha/test.patch_0", "R-36/Shorty/a.patch_0", "R-36/Long boi/b.patch_0", "Alpha/backup/test.patch_0"):
        synthetic.write_bundle(tmp_path / name, entries)
    (tmp_path / "Alpha/impostor").write_text("not a bundle")
    (tmp_path / f"Alpha/impostor{GPU}").write_text("x")
    return str(tmp_path)


def read(spark, root, **options):
    spark.dataSource.register(BundleSource)
    return spark.read.format("bundle").options(**options).load(root)


def test_reads_entries_of_bundles_only(spark, root):
    rows = read(spark, root).orderBy("bundle", "pos").collect()
    assert [os.path.relpath(b, root) for b in sorted({r.bundle for r in rows})] == ["Alpha/test.patch_0", "R-36/Long boi/b.patch_0", "R-36/Shorty/a.patch_0"]
    first = rows[:5]
    assert [r.type_name for r in first] == ["unit"] * 4 + ["texture"] and [r.gpu_size for r in first] == [8192, 8192, 8192, 100, 512]
    assert all(r.gpu_offset % 64 == 0 for r in rows) and first[0].name == "0000000000001000" and int(first[4].type_id) == container.TEXTURE
    t = first[4]
    assert (t.w, t.h, t.format, t.mips, t.linear_size, t.has_dx10, t.prefix_id, t.first_resident) == (16, 8, 28, 1, 64, True, 0x0172E796, 0xFFFFFFFF)


def test_payloads_pack_and_verify(spark, root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    entries = container.with_payload_hash(read(spark, root)).withColumn("size", F.col("gpu_size"))
    placed = layout.pack(entries, ["hash"])
    sizes = container.write_layout(placed, out, root).collect()
    assert {(r.bytes_before, r.bytes_after) for r in sizes} == {(3 * 8192 + 128 + 512, 2 * 8192 + 128 + 512)}
    assert not [f for _, _, files in os.walk(out) for f in files if f.endswith(".tmp")]
    after = container.with_payload_hash(read(spark, out)).withColumn("size", F.col("gpu_size"))
    strip = lambda df, r: df.withColumn("bundle", F.expr(f"substring(bundle, {len(r) + 1})"))
    columns = ["cpu_offset", "cpu_size", "prefix_id", "size", "hash", "file_id", "type_name"]
    b, a = (strip(df, r).select("bundle", "pos", *columns) for df, r in ((entries, root), (after, out)))
    assert verify.compare(b, a).count() == 0
    lengths = spark.createDataFrame([(r.bundle, os.path.getsize(r.bundle + GPU)) for r in after.select("bundle").distinct().collect()], "bundle string, file_length long")
    assert verify.check_alignment(after).count() == verify.check_bounds(after, lengths).count() == verify.check_overlap(after).count() == verify.check_slack(after, lengths).count() == 0
    assert {(r.n_regions, r.n_aliased) for r in verify.report(after, lengths).collect()} == {(4, 1)}


def test_rejects_what_is_no_bundle(spark, root):
    with pytest.raises(container.ContainerError):
        container.parse(bytes(256))
    good = Path(root, "Alpha/test.patch_0").read_bytes()
    with pytest.raises(container.ContainerError):
        container.parse(good[:0x50])
    wrong = bytearray(good)
    struct.pack_into("<Q", wrong, container.HEADER_BYTES + 16, 99)
    Path(root, "Alpha/test.patch_0").write_bytes(bytes(wrong))
    with pytest.raises(Exception, match="count 100 files"):
        read(spark, root).count()
    assert read(spark, root, mode="skip").select("bundle").distinct().count() == 2
    with pytest.raises(FileNotFoundError):
        container.bundle_files(root + "/none")


def test_unknown_types_and_missing_headers(spark, tmp_path):
    synthetic.write_bundle(tmp_path / "x", [(0xABCDEF, b"", b"123"), (container.TEXTURE, bytes(200), b"")])
    rows = read(spark, str(tmp_path)).orderBy("pos").collect()
    assert rows[0].type_name == "0000000000ABCDEF" and rows[1].w is None


def test_backup_never_overwrites(root):
    path = os.path.join(root, "R-36/Shorty/a.patch_0")
    assert len(container.backup(path)) == 3
    with pytest.raises(FileExistsError):
        container.backup(path)


def test_backups_by_tasks_copy_all_or_nothing(spark, root, tmp_path_factory):
    bundles = read(spark, root).select("bundle")
    with pytest.raises(FileExistsError):  # one bundle has an earlier copy beside it
        container.backup_all(bundles)
    assert not os.path.exists(f"{root}/R-36/Shorty/backup")
    others = bundles.filter("bundle NOT LIKE '%Alpha%'")
    made = {r.bundle: (r.n_files, r.bytes) for r in container.backup_all(others).collect()}
    assert len(made) == 2 and {n for n, _ in made.values()} == {3}
    for path in made:
        there = os.path.join(os.path.dirname(path), "backup")
        assert all(Path(there, os.path.basename(path) + e).read_bytes() == Path(path + e).read_bytes() for e in ("", GPU, ".stream")) and len(os.listdir(there)) == 3


def test_ranges_past_the_end_are_told_without_reading(tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    length = 1 << 26
    os.truncate(tmp_path / "x", length)
    tracemalloc.start()
    try:
        assert container.read_range(tmp_path / "x", 3, length) == (None, f"read past end: 3 of {length} bytes at 3 are missing")
        assert container.read_range(tmp_path / "x", length + 7, 5) == (None, f"read past end: 5 of 5 bytes at {length + 7} are missing")
        assert container.read_range(tmp_path / "x", 0, 3) == (b"abc", None) and container.read_range(tmp_path / "x", length - 2, 2) == (b"\0\0", None)
        assert container.read_range(tmp_path / "x", length, 0) == container.read_range(tmp_path / "x", length + 7, 0) == (b"", None)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()
    assert container.read_range(tmp_path / "none", 0, 1) == (None, "No such file or directory")


def test_tables_and_payloads_of_many_entries(spark, tmp_path):
    """Tables longer than a block and an Arrow batch; one payload in five is asked for past the end of the file."""
    n = 10_003
    synthetic.write_bundle(tmp_path / "x", [synthetic.opaque(i % 7, i % 256) for i in range(n)])
    length = os.path.getsize(tmp_path / f"x{GPU}")
    entries, errors = container.entries_at(spark.createDataFrame([(str(tmp_path / "x"),)], "bundle string"))
    asked = entries.withColumn("gpu_size", F.expr(f"gpu_size + if(pos % 5 = 0, {length}, 0)"))
    rows = {r.pos: r for r in container.with_payloads(asked, at_once=1000).select("pos", "gpu_offset", "gpu_size", "payload", "payload_error").collect()}
    assert errors.isEmpty() and sorted(rows) == list(range(n))
    held = (tmp_path / f"x{GPU}").read_bytes()
    for pos, r in rows.items():
        missing = r.gpu_offset + r.gpu_size - length
        if pos % 5 == 0 and missing > 0:
            assert r.payload is None and r.payload_error == f"read past end: {missing} of {r.gpu_size} bytes at {r.gpu_offset} are missing"
        else:
            assert bytes(r.payload) == held[r.gpu_offset : r.gpu_offset + r.gpu_size] and r.payload_error is None


def test_copies_in_chunks(tmp_path):
    (tmp_path / "x").write_bytes(bytes(range(200)))
    with open(tmp_path / "x", "rb") as old, open(tmp_path / "y", "wb") as new:
        old.seek(10)
        container.copy_range(old, new, 100, chunk=7)
        with pytest.raises(container.ContainerError, match="before its payload"):
            container.copy_range(old, new, 100, chunk=7)
    assert (tmp_path / "y").read_bytes()[:100] == bytes(range(10, 110))
