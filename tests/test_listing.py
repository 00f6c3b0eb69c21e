"""Folders listed in tasks, entries read by range, and what can't be read."""

import os

import pytest
from pyspark.sql import functions as F

from assetspark.operators import library
from assetspark.sources import container, listing, synthetic
from assetspark.sources.container import GPU, BundleSource


@pytest.fixture()
def root(tmp_path):
    for folder in ("A/deep/er", "B/Backup", "C", "empty"):
        (tmp_path / folder).mkdir(parents=True)
    entries = [synthetic.opaque(500, 3), synthetic.plain_texture(8, 8, lambda x, y: (x, y, 0, 255))]
    for name in ("top.patch_0", "A/deep/er/x.patch_1", "B/y.patch_0", "B/Backup/y.patch_0"):
        synthetic.write_bundle(tmp_path / name, entries, stream=b"12345" if name[0] == "B" else None)
    for name, data in (("C/impostor", b"nope"), (f"C/impostor{GPU}", b"x"), ("C/alone", b"x"), (f"C/orphan{GPU}", b"x"), ("C/tiny", b"\x11"), (f"C/tiny{GPU}", b"")):
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_discovers_by_levels(spark, root):
    bundles, unreadable = listing.discover(spark, root)
    got = {os.path.relpath(r.path, root): (r.mod_name, r.file_name, r.relative_folders, r.gpu_size, r.stream_size) for r in bundles.collect()}
    size = 512 + 256
    assert got == {"top.patch_0": ("top.patch_0", "top.patch_0", [], size, 0), "A/deep/er/x.patch_1": ("er", "x.patch_1", ["A", "deep", "er"], size, 0), "B/y.patch_0": ("B", "y.patch_0", ["B"], size, 5)}
    assert unreadable.collect() == [] and listing.discover(spark, f"{root}/empty")[0].count() == 0
    with pytest.raises(FileNotFoundError):
        listing.scan(spark, root + "/none")


def test_what_cannot_be_read_is_listed(spark, root):
    """A file named as a bundle that is a dangling link, and a folder that vanishes while it is listed (a link to none is no folder)."""
    os.symlink(f"{root}/gone", f"{root}/C/locked")
    with open(f"{root}/C/locked{GPU}", "w") as f:
        f.write("x")
    os.symlink(f"{root}/A", f"{root}/A/deep/again")  # links to folders aren't followed
    bundles, unreadable = listing.discover(spark, root)
    assert {os.path.relpath(r.path, root): r.error for r in unreadable.collect()} == {"C/locked": "No such file or directory"}
    assert bundles.count() == 3
    gone = spark.createDataFrame([(f"{root}/vanished",), (root,)], "path string").mapInArrow(listing._list, listing.LISTED).filter("error IS NOT NULL").collect()
    assert [(os.path.relpath(r.path, root), r.error) for r in gone] == [("vanished", "No such file or directory")]


@pytest.mark.skipif(os.geteuid() == 0, reason="the superuser may read everything")
def test_a_locked_folder_is_listed(spark, root):
    os.chmod(f"{root}/A/deep", 0)
    try:
        _, unreadable = listing.discover(spark, root)
        assert [(os.path.relpath(r.path, root), r.error) for r in unreadable.collect()] == [("A/deep", "Permission denied")]
    finally:
        os.chmod(f"{root}/A/deep", 0o755)


def test_payloads_within_bounds(spark, root):
    path = f"{root}/B/y.patch_0"
    os.truncate(path + GPU, 600)
    entries = library.entries_of(spark, path)
    rows = {r.type_name: r for r in container.with_payloads(entries, at_once=1).collect()}
    assert bytes(rows["unit"].payload) == synthetic.opaque(500, 3)[2] and rows["unit"].payload_error is None
    assert rows["texture"].payload is None and rows["texture"].payload_error == "read past end: 168 of 256 bytes at 512 are missing" and rows["texture"].hash is None


def test_schema_and_filters_leave_out_what_is_not_asked(spark, root):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BundleSource)
    whole = spark.read.format("bundle").option("pushdown", "true").schema("pos long, bundle string, type_name string, payload binary, payload_error string").load(root)
    some = whole.filter((F.col("type_name") == "unit") & F.col("bundle").isin(f"{root}/B/y.patch_0", "other") & (F.col("pos") >= 0))
    assert [(r.pos, len(r.payload)) for r in some.collect()] == [(0, 500)]
    os.truncate(f"{root}/top.patch_0", container.HEADER_BYTES)  # not to be opened
    assert some.count() == 1 and whole.filter(F.col("bundle") == f"{root}/B/y.patch_0").count() == 2
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("bundle").schema("nothing long").load(root).count()


def test_bad_bundles_are_named(spark, root):
    os.truncate(f"{root}/top.patch_0", 100)
    bundles = spark.createDataFrame([(f"{root}/top.patch_0",), (f"{root}/B/y.patch_0",), (f"{root}/none",)], "bundle string")
    entries, errors = container.entries_at(bundles)
    assert entries.count() == 2 and {os.path.relpath(r.bundle, root) for r in errors.collect()} == {"top.patch_0", "none"}
    with pytest.raises(container.ContainerError, match="top.patch_0"):
        library.entries_of(spark, root)
