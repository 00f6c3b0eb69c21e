"""The pixel formats of texture payloads, as a dimension table and as expressions.

Expressions come as SQL text for a dialect (see functions.dialect), so that the engine's columns and the statements
that check them share one statement of each rule; the rules themselves are tested against listed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Code, name shown (None: DXGI_ and the code), bytes of a 4x4 block, bytes of a pixel, blue first, sRGB.
FORMATS = (
    (28, "R8G8B8A8_UNORM", 0, 4, False, False),
    (29, "R8G8B8A8_UNORM_SRGB", 0, 4, False, True),
    (49, "R8G8_UNORM", 0, 2, False, False),
    (61, "R8_UNORM", 0, 1, False, False),
    (71, "BC1_UNORM", 8, 0, False, False),
    (72, "BC1_UNORM_SRGB", 8, 0, False, True),
    (74, None, 16, 0, False, False),
    (75, None, 16, 0, False, True),
    (77, "BC3_UNORM", 16, 0, False, False),
    (78, None, 16, 0, False, True),
    (80, "BC4_UNORM", 8, 0, False, False),
    (81, None, 8, 0, False, False),
    (83, "BC5_UNORM", 16, 0, False, False),
    (84, None, 16, 0, False, False),
    (87, "B8G8R8A8_UNORM", 0, 4, True, False),
    (91, "B8G8R8A8_UNORM_SRGB", 0, 4, True, True),
    (95, None, 16, 0, False, False),
    (96, None, 16, 0, False, False),
    (98, "BC7_UNORM", 16, 0, False, False),
    (99, "BC7_UNORM_SRGB", 16, 0, False, True),
)
#: Block formats that can be decoded.
DECODABLE = (71, 72, 74, 75, 77, 78, 80, 83, 98, 99)
BC1, BC7 = 71, 98


def _codes(test) -> str:
    return ", ".join(str(f[0]) for f in FORMATS if test(f))


def format_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, n or f"DXGI_{c}", b, p, b > 0, b > 0 or p > 0, p == 4, bgra, srgb) for c, n, b, p, bgra, srgb in FORMATS],
        "code long, name string, block_bytes long, pixel_bytes long, is_block boolean, is_sizable boolean, is_rgba32 boolean, is_bgra boolean, is_srgb boolean",
    )


def format_dim_sql() -> str:
    rows = ", ".join(f"({c}, '{n or f'DXGI_{c}'}', {b}, {p}, {b > 0}, {b > 0 or p > 0}, {p == 4}, {bgra}, {srgb})" for c, n, b, p, bgra, srgb in FORMATS)
    return f"format_dim(code, name, block_bytes, pixel_bytes, is_block, is_sizable, is_rgba32, is_bgra, is_srgb) AS (VALUES {rows})"


def is_block(code: str) -> str:
    return f"({code} IN ({_codes(lambda f: f[2] > 0)}))"


def is_sizable(code: str) -> str:
    return f"({code} IN ({_codes(lambda f: f[2] > 0 or f[3] > 0)}))"


def is_rgba32(code: str) -> str:
    return f"({code} IN ({_codes(lambda f: f[3] == 4)}))"


def can_decode(code: str) -> str:
    return f"({code} IN ({', '.join(map(str, DECODABLE))}))"


def block_bytes(code: str) -> str:
    return f"(CASE WHEN {code} IN ({_codes(lambda f: f[2] == 8)}) THEN 8 WHEN {code} IN ({_codes(lambda f: f[2] == 16)}) THEN 16 ELSE 0 END)"


def pixel_bytes(code: str) -> str:
    return f"(CASE WHEN {code} IN ({_codes(lambda f: f[3] == 4)}) THEN 4 WHEN {code} = 49 THEN 2 WHEN {code} = 61 THEN 1 ELSE 0 END)"


def format_name(code: str) -> str:
    cases = " ".join(f"WHEN {c} THEN '{n}'" for c, n, *_ in FORMATS if n)
    return f"(CASE {code} {cases} ELSE concat('DXGI_', CAST({code} AS {{string}})) END)"


def match_colour_space(target: str, source: str) -> str:
    """An sRGB source keeps block targets sRGB."""
    return f"(CASE WHEN {source} IN ({_codes(lambda f: f[5])}) THEN CASE {target} WHEN 71 THEN 72 WHEN 74 THEN 75 WHEN 77 THEN 78 WHEN 98 THEN 99 ELSE {target} END ELSE {target} END)"
