"""The rules that recommend a format, a size and a mip layout for a texture, as layers of columns.

Input columns: w, h, format, mips, solid, flat_alpha, alpha_detail, binary_alpha, r, g, b, a, and the options strategy
('balanced', 'quality', 'smallest'), collapse, cap, single (keep one level only), floor, prefix, generate. Output:
rule, to_format, to_w, to_h, drop_levels, to_mips, resident (null: nothing streamed), generates, lossless.
The first rule that holds decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from assetspark import formats
from assetspark.functions.dialect import SPARK, Dialect

#: Fixed value: the side of a collapsed solid surface.
SOLID = 16
NOTHING = "CAST(NULL AS BIGINT)"


def layers(d: Dialect) -> list[list[str]]:
    sizable, block = formats.is_sizable("format"), formats.is_block("format")
    smaller = ["*", f"{d.levels_to_drop('w', 'h', 'mips', 'cap')} AS capped", f"{d.halvings('w', 'h', 'cap')} AS halved", f"{d.exact_565('r', 'g', 'b', 'a')} AS exact"]
    flat_rule = (
        f"CASE WHEN solid AND collapse AND {block} THEN 'R3' WHEN {block} THEN 'R4' WHEN solid AND collapse THEN 'R5' "
        "WHEN (NOT alpha_detail OR strategy = 'smallest' AND binary_alpha) AND strategy <> 'quality' THEN 'R6' ELSE 'R7' END"
    )
    rules = [
        "*", f"greatest(1, {d.shr('w', 'capped')}) AS capped_w", f"greatest(1, {d.shr('h', 'capped')}) AS capped_h", "mips - capped AS capped_mips",
        f"{flat_rule} AS flat_rule",
    ]
    bc1, bc7 = formats.match_colour_space("71", "format"), formats.match_colour_space("98", "format")
    flat = [
        "*", f"{d.levels_to_drop('capped_w', 'capped_h', 'capped_mips', 'floor')} AS capped_resident",
        f"CASE WHEN flat_rule IN ('R3', 'R4') THEN format WHEN flat_rule = 'R5' AND exact OR flat_rule = 'R6' THEN {bc1} ELSE {bc7} END AS flat_format",
        f"CASE WHEN flat_rule IN ('R3', 'R5') THEN {SOLID} ELSE {d.shr('w', 'halved')} END AS flat_w", f"CASE WHEN flat_rule IN ('R3', 'R5') THEN {SOLID} ELSE {d.shr('h', 'halved')} END AS flat_h",
    ]
    levels = ["*", f"{d.bits('greatest(flat_w, flat_h)')} AS flat_levels"]
    resident = ["*", f"{d.levels_to_drop('flat_w', 'flat_h', 'flat_levels', 'floor')} AS flat_resident"]
    chosen = [
        "*",
        f"CASE WHEN generate AND mips = 1 AND {sizable} AND NOT (solid AND collapse) AND flat_levels > 1 AND {d.can_describe('prefix', 'flat_levels')} THEN 'R0' "
        f"WHEN floor > 0 AND mips > 1 AND {sizable} AND capped_resident > 0 AND {d.can_describe('prefix', 'capped_mips')} THEN 'R1' "
        f"WHEN mips > 1 AND {sizable} AND capped = 0 AND NOT single THEN 'R2a' WHEN mips > 1 AND {sizable} THEN 'R2b' ELSE flat_rule END AS rule",
    ]
    sliced = "('R1', 'R2a', 'R2b')"
    result = [
        "*", f"CASE WHEN rule IN {sliced} THEN format ELSE flat_format END AS to_format", f"CASE WHEN rule IN {sliced} THEN capped_w ELSE flat_w END AS to_w", f"CASE WHEN rule IN {sliced} THEN capped_h ELSE flat_h END AS to_h",
        f"CASE WHEN rule IN {sliced} THEN CAST(capped AS BIGINT) ELSE CAST(0 AS BIGINT) END AS drop_levels",
        "CASE WHEN rule = 'R0' THEN flat_levels WHEN rule IN ('R1', 'R2a') THEN CAST(capped_mips AS BIGINT) WHEN rule = 'R2b' AND NOT single THEN CAST(capped_mips AS BIGINT) ELSE CAST(1 AS BIGINT) END AS to_mips",
        f"CASE WHEN rule = 'R0' AND flat_resident > 0 THEN CAST(flat_resident AS BIGINT) WHEN rule = 'R1' THEN CAST(capped_resident AS BIGINT) ELSE {NOTHING} END AS resident",
        "rule = 'R0' AS generates", "rule IN ('R2a', 'R3') OR rule = 'R5' OR rule = 'R1' AND capped = 0 AS lossless",
    ]
    return [smaller, rules, flat, levels, resident, chosen, result]


def predicted(d: Dialect) -> list[list[str]]:
    """Sizes that follow from a recommendation, include and the chain of classify: predicted_size, predicted_stream_size."""
    chains = ["*", f"CASE WHEN {formats.is_sizable('to_format')} THEN {d.chain('to_format', 'to_w', 'to_h', 'to_mips')} END AS to_chain"]
    sizes = [
        "*",
        f"CASE WHEN NOT include THEN gpu_size WHEN generates THEN {d.total(d.cut('to_chain', 'coalesce(resident, 0)'))} WHEN resident IS NOT NULL THEN {d.total(d.cut('chain', '(drop_levels + resident)'))} "
        f"WHEN mips > 1 THEN {d.total(d.cut('chain', 'drop_levels', 'to_mips'))} ELSE CAST({d.surface('to_format', 'to_w', 'to_h')} AS BIGINT) END AS predicted_size",
        f"CASE WHEN resident IS NULL THEN CAST(0 AS BIGINT) WHEN generates THEN {d.total('to_chain')} ELSE {d.total(d.cut('chain', 'drop_levels'))} END AS predicted_stream_size",
    ]
    return [chains, sizes]


def apply(df: DataFrame, steps: list[list[str]]) -> DataFrame:
    for step in steps:
        df = df.selectExpr(*step)
    return df


def recommend(df: DataFrame) -> DataFrame:
    return apply(df, layers(SPARK))


def predict(df: DataFrame) -> DataFrame:
    """df, a recommendation with include and gpu_size, with the sizes it leads to."""
    return apply(df, predicted(SPARK))


def classify(d: Dialect) -> list[list[str]]:
    """The texture's chain, once, and why it can't be optimised, or null: the first reason that holds."""
    sizable, block = formats.is_sizable("format"), formats.is_block("format")
    chain = ["*", f"CASE WHEN {sizable} THEN {d.chain('format', 'w', 'h', 'mips')} END AS chain"]
    expected = ["*", f"CASE WHEN {sizable} THEN {d.total('chain')} END AS expected_size"]
    reason = [
        "*",
        f"CASE WHEN NOT has_dx10 THEN 'legacy-header' WHEN {block} AND NOT {formats.can_decode('format')} THEN 'cannot-decode' WHEN NOT {block} AND NOT {formats.is_rgba32('format')} THEN 'unsupported-format' "
        "WHEN w % 4 <> 0 OR h % 4 <> 0 THEN 'dimensions' WHEN stream_size > 0 THEN 'streamed' WHEN expected_size <> gpu_size THEN 'payload-size' END AS unsupported",
    ]
    return [chain, expected, reason]
