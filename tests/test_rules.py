"""Rules against listed values."""

import pytest

from assetspark.functions.dialect import SPARK
from assetspark.operators import rules
from assetspark.operators.plan import Options
from pyspark.sql import functions as F


def value(spark, expression):
    return spark.sql(f"SELECT {expression} AS v").collect()[0].v


@pytest.mark.parametrize(("w", "mips", "cap", "drop"), [(4096, 13, 2048, 1), (4096, 13, 1024, 2), (4096, 13, 512, 3), (1024, 11, 2048, 0), (1024, 11, 0, 0), (16, 3, 1, 2)])
def test_levels_to_drop(spark, w, mips, cap, drop):
    assert value(spark, SPARK.levels_to_drop(f"{w}L", f"{w}L", f"{mips}L", f"{cap}L")) == drop


@pytest.mark.parametrize(("w", "h", "n"), [(4096, 4096, 13), (1024, 512, 11), (16, 16, 5), (1, 1, 1)])
def test_full_chain(spark, w, h, n):
    assert value(spark, SPARK.bits(f"greatest({w}L, {h}L)")) == n


@pytest.mark.parametrize(("w", "h", "cap", "to"), [(4096, 2048, 2048, (2048, 1024)), (2048, 4096, 2048, (1024, 2048)), (512, 512, 0, (512, 512)), (4096, 4096, 1024, (1024, 1024)), (4098, 4098, 16, (2049, 2049)), (64, 8, 4, (32, 4))])
def test_downscale(spark, w, h, cap, to):
    k = SPARK.halvings(f"{w}L", f"{h}L", f"{cap}L")
    assert (value(spark, SPARK.shr(f"{w}L", k)), value(spark, SPARK.shr(f"{h}L", k))) == to


def test_chain_of_4096_bc7(spark):
    c = SPARK.chain("98L", "4096L", "4096L", "13L")
    assert value(spark, SPARK.total(c)) == 22369648 and value(spark, SPARK.total(SPARK.cut(c, "1", "1"))) == 4 << 20
    assert value(spark, SPARK.surface("71L", "4096L", "4096L")) == 8 << 20


@pytest.mark.parametrize(("rgba", "exact"), [((0, 0, 0, 255), True), ((255, 255, 255, 255), True), ((8, 4, 8, 255), True), ((127, 127, 255, 255), False), ((0, 0, 0, 254), False)])
def test_exact_565(spark, rgba, exact):
    assert value(spark, SPARK.exact_565(*(f"{x}L" for x in rgba))) is exact


@pytest.mark.parametrize(("n", "shown"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (22369648, "21.3 MiB"), (1 << 41, "2048.0 GiB")])
def test_human_bytes(spark, n, shown):
    assert value(spark, SPARK.human_bytes(f"{n}L")) == shown


@pytest.mark.parametrize(("levels", "fits"), [(14, True), (15, False)])
def test_prefix_holds_fourteen_levels(spark, levels, fits):
    assert value(spark, SPARK.can_describe("192", str(levels))) is fits


OPAQUE = dict(solid=False, flat_alpha=False, alpha_detail=False, binary_alpha=False, r=0, g=0, b=0, a=255)
CUTOUT = OPAQUE | dict(alpha_detail=True, binary_alpha=True, a=0)
GRADED = OPAQUE | dict(alpha_detail=True, a=0)
SOLID = OPAQUE | dict(solid=True)


@pytest.mark.parametrize(
    ("texture", "surface", "options", "expected"),
    [
        ((64, 28, 1), OPAQUE, {}, ("R6", 71, 64, 0, 1, None)),
        ((64, 28, 1), OPAQUE, {"strategy": "quality"}, ("R7", 98, 64, 0, 1, None)),
        ((64, 29, 1), OPAQUE, {}, ("R6", 72, 64, 0, 1, None)),
        ((64, 28, 1), CUTOUT, {}, ("R7", 98, 64, 0, 1, None)),
        ((64, 28, 1), CUTOUT, {"strategy": "smallest"}, ("R6", 71, 64, 0, 1, None)),
        ((64, 28, 1), GRADED, {"strategy": "smallest"}, ("R7", 98, 64, 0, 1, None)),
        ((32, 28, 1), SOLID, {}, ("R5", 71, 16, 0, 1, None)),
        ((32, 28, 1), SOLID | dict(r=127, g=127, b=255), {}, ("R5", 98, 16, 0, 1, None)),
        ((4096, 98, 1), SOLID, {}, ("R3", 98, 16, 0, 1, None)),
        ((4096, 98, 1), OPAQUE, {"cap": 1024}, ("R4", 98, 1024, 0, 1, None)),
        ((256, 98, 9), OPAQUE, {}, ("R2a", 98, 256, 0, 9, None)),
        ((256, 98, 9), OPAQUE, {"cap": 64}, ("R2b", 98, 64, 2, 7, None)),
        ((256, 98, 9), OPAQUE, {"cap": 64, "single": True}, ("R2b", 98, 64, 2, 1, None)),
        ((256, 98, 9), OPAQUE, {"floor": 32}, ("R1", 98, 256, 0, 9, 3)),
        ((256, 98, 9), OPAQUE, {"cap": 64, "floor": 16}, ("R1", 98, 64, 2, 7, 2)),
        ((256, 98, 9), OPAQUE, {"floor": 2048}, ("R2a", 98, 256, 0, 9, None)),
        ((64, 28, 1), OPAQUE, {"generate": True}, ("R0", 71, 64, 0, 7, None)),
        ((128, 28, 1), OPAQUE, {"generate": True, "floor": 16}, ("R0", 71, 128, 0, 8, 3)),
        ((64, 28, 1), SOLID, {"generate": True}, ("R5", 71, 16, 0, 1, None)),
        ((64, 28, 1), OPAQUE, {"generate": True, "prefix": 100}, ("R6", 71, 64, 0, 1, None)),
    ],
)
def test_recommendations(spark, texture, surface, options, expected):
    w, code, mips = texture
    names = {"w": "long", "h": "long", "format": "long", "mips": "long"} | {k: "boolean" if isinstance(v, bool) else "long" for k, v in surface.items()}
    df = spark.createDataFrame([(w, w, code, mips, *surface.values())], ", ".join(f"{k} {t}" for k, t in names.items()))
    r = rules.recommend(df.withColumns(Options(**options).columns())).collect()[0]
    assert (r.rule, r.to_format, r.to_w, r.drop_levels, r.to_mips, r.resident) == expected
