"""SQL written by hand for the rules, chains and sizes of textures, to check the engine's own expressions against.

Nothing here comes from functions/dialect.py or operators/rules.py: the same results are reached by other formulas, such
as the least shift that brings a side under a cap in place of counting levels over it.
"""

from __future__ import annotations

from assetspark import formats

FORMATS = formats.format_dim_sql()


def chain(w: str, h: str, mips: str, block: str, pixel: str) -> str:
    """Bytes of each level."""
    side = lambda x: f"greatest(1, {x} >> CAST(i AS INTEGER))"
    return f"list_transform(range(0, greatest({mips}, 1)), lambda i: CAST(CASE WHEN {block} > 0 THEN (({side(w)} + 3) // 4) * (({side(h)} + 3) // 4) * {block} ELSE {side(w)} * {side(h)} * {pixel} END AS BIGINT))"


BLOCK, PIXEL = formats.block_bytes("format"), formats.pixel_bytes("format")


def surface(w: str, h: str, block: str = BLOCK, pixel: str = PIXEL) -> str:
    """Bytes of one level, null for formats without a size."""
    return f"CAST(CASE WHEN {block} > 0 THEN (({w} + 3) // 4) * (({h} + 3) // 4) * {block} WHEN {pixel} > 0 THEN {w} * {h} * {pixel} END AS BIGINT)"


def own_chain() -> str:
    """The chain of a texture as it is, null for formats without a size."""
    return f"CASE WHEN {BLOCK} + {PIXEL} > 0 THEN {chain('w', 'h', 'mips', BLOCK, PIXEL)} END"


def total(values: str) -> str:
    return f"CAST(coalesce(list_sum({values}), 0) AS BIGINT)"


def least_shift(side: str, cap: str) -> str:
    """How often a side is halved until it is no longer over a cap."""
    return f"list_min(list_filter(range(0, 32), lambda d: ({side} >> CAST(d AS INTEGER)) <= {cap}))"


def drop(w: str, h: str, mips: str, cap: str) -> str:
    """Levels over a cap, all but one of the chain at most."""
    return f"CASE WHEN {cap} > 0 AND {mips} > 1 THEN least({mips} - 1, {least_shift(f'greatest({w}, {h})', cap)}) ELSE 0 END"


def halvings(w: str, h: str, cap: str) -> str:
    """Halvings towards a cap, up to the first that would leave a side odd or under 4."""
    stop = f"list_min(list_filter(range(0, 32), lambda d: ({w} >> CAST(d AS INTEGER)) & 1 = 1 OR ({h} >> CAST(d AS INTEGER)) & 1 = 1 OR least({w}, {h}) >> CAST(d AS INTEGER) <= 4))"
    return f"CASE WHEN {cap} > 0 THEN least({least_shift(f'greatest({w}, {h})', cap)}, {stop}) ELSE 0 END"


def levels(side: str) -> str:
    """Levels of a full chain down to one pixel."""
    return f"1 + {least_shift(side, '1')}"


CLASSIFIED = f"""{FORMATS},
formatted AS (SELECT t.*, coalesce(f.is_block, false) AS is_block, coalesce(f.is_sizable, false) AS is_sizable, coalesce(f.is_rgba32, false) AS is_rgba32, coalesce(f.is_srgb, false) AS is_srgb, f.block_bytes, f.pixel_bytes FROM textures t LEFT JOIN format_dim f ON f.code = t.format),
chained AS (SELECT *, CASE WHEN is_sizable THEN {chain('w', 'h', 'mips', 'block_bytes', 'pixel_bytes')} END AS chain FROM formatted),
measured AS (SELECT *, CASE WHEN is_sizable THEN {total('chain')} END AS expected_size FROM chained),
classified AS (
  SELECT *, CASE WHEN NOT has_dx10 THEN 'legacy-header' WHEN is_block AND format NOT IN ({', '.join(map(str, formats.DECODABLE))}) THEN 'cannot-decode' WHEN NOT is_block AND NOT is_rgba32 THEN 'unsupported-format'
    WHEN w & 3 <> 0 OR h & 3 <> 0 THEN 'dimensions' WHEN stream_size > 0 THEN 'streamed' WHEN expected_size <> gpu_size THEN 'payload-size' END AS unsupported
  FROM measured)"""

#: Needs textures, analysis and options(option, strategy, collapse, cap, single, floor, prefix, generate).
SIZED = f"""{CLASSIFIED},
looked AS (
  SELECT o.*, c.*, a.solid, a.flat_alpha, a.alpha_detail, a.binary_alpha, a.r, a.g, a.b, a.a, {drop('w', 'h', 'mips', 'o.cap')} AS d, {halvings('w', 'h', 'o.cap')} AS n,
    a.a = 255 AND (((a.r >> 3) << 3) | (a.r >> 5)) = a.r AND (((a.g >> 2) << 2) | (a.g >> 6)) = a.g AND (((a.b >> 3) << 3) | (a.b >> 5)) = a.b AS in_565
  FROM classified c LEFT JOIN analysis a ON a.tex_id = c.vec_id CROSS JOIN options o),
cut AS (SELECT *, greatest(1, w >> CAST(d AS INTEGER)) AS cut_w, greatest(1, h >> CAST(d AS INTEGER)) AS cut_h, mips - d AS cut_mips, coalesce(solid AND collapse, false) AS shrinks FROM looked),
surfaced AS (
  SELECT *, {drop('cut_w', 'cut_h', 'cut_mips', 'floor')} AS cut_resident,
    CASE WHEN shrinks AND is_block THEN 'R3' WHEN is_block THEN 'R4' WHEN shrinks THEN 'R5' WHEN strategy <> 'quality' AND (NOT alpha_detail OR binary_alpha AND strategy = 'smallest') THEN 'R6' ELSE 'R7' END AS one,
    CASE WHEN shrinks THEN 16 ELSE w >> CAST(n AS INTEGER) END AS one_w, CASE WHEN shrinks THEN 16 ELSE h >> CAST(n AS INTEGER) END AS one_h
  FROM cut),
targeted AS (
  SELECT *, CASE WHEN is_block THEN format WHEN one = 'R6' OR one = 'R5' AND in_565 THEN 71 + CAST(is_srgb AS INTEGER) ELSE 98 + CAST(is_srgb AS INTEGER) END AS one_format, {levels('greatest(one_w, one_h)')} AS full_mips FROM surfaced),
built AS (SELECT *, {drop('one_w', 'one_h', 'full_mips', 'floor')} AS full_resident FROM targeted),
ruled AS (
  SELECT *, CASE WHEN generate AND mips = 1 AND is_sizable AND NOT shrinks AND full_mips > 1 AND 12 * full_mips <= prefix - 20 THEN 'R0'
    WHEN mips <= 1 OR NOT is_sizable THEN one WHEN floor > 0 AND cut_resident > 0 AND 12 * cut_mips <= prefix - 20 THEN 'R1' WHEN d = 0 AND NOT single THEN 'R2a' ELSE 'R2b' END AS rule
  FROM built),
recommended AS (
  SELECT *, left(rule, 2) IN ('R1', 'R2') AS slices, rule = 'R0' AS generates, rule IN ('R2a', 'R3', 'R5') OR rule = 'R1' AND d = 0 AS lossless,
    CASE WHEN rule = 'R0' THEN full_mips WHEN rule IN ('R1', 'R2a') OR rule = 'R2b' AND NOT single THEN cut_mips ELSE 1 END AS to_mips_,
    CASE WHEN rule = 'R0' AND full_resident > 0 THEN full_resident WHEN rule = 'R1' THEN cut_resident END AS resident_
  FROM ruled),
placed AS (
  SELECT *, CAST(CASE WHEN slices THEN format ELSE one_format END AS BIGINT) AS to_format, CAST(CASE WHEN slices THEN cut_w ELSE one_w END AS BIGINT) AS to_w, CAST(CASE WHEN slices THEN cut_h ELSE one_h END AS BIGINT) AS to_h,
    CAST(CASE WHEN slices THEN d ELSE 0 END AS BIGINT) AS drop_levels, CAST(to_mips_ AS BIGINT) AS to_mips, CAST(resident_ AS BIGINT) AS resident
  FROM recommended),
made AS (SELECT p.*, {chain('to_w', 'to_h', 'to_mips', 'f.block_bytes', 'f.pixel_bytes')} AS made FROM placed p LEFT JOIN format_dim f ON f.code = p.to_format),
sized AS (
  SELECT *, CASE WHEN generates THEN {total('made[coalesce(resident, 0) + 1:]')} WHEN resident IS NOT NULL THEN {total('chain[drop_levels + resident + 1:]')} WHEN mips > 1 THEN {total('chain[drop_levels + 1:drop_levels + to_mips]')} ELSE made[1] END AS predicted_size,
    CASE WHEN resident IS NULL THEN 0 WHEN generates THEN {total('made')} ELSE {total('chain[drop_levels + 1:]')} END AS predicted_stream_size
  FROM made)"""
