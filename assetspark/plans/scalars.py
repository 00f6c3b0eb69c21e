"""Scalar rules over textures and entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetspark import formats
from assetspark.bindings import ASSETS, TEXTURES, asset_rows, read, textures
from assetspark.functions.dialect import DUCK, SPARK
from assetspark.plans import checking
from assetspark.plans.registry import projected, query

KEY = ["bundle", "pos"]


def _on_textures(name: str, columns, sql: list[str] | None = None) -> None:
    """columns: dialect -> expressions with names, run on the textures; sql: the same written by hand (see checking), for rules of the engine."""
    projected(name, textures, TEXTURES, "textures", [*KEY, *columns(SPARK)], [*KEY, *(sql or columns(DUCK))])


def _big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def _joined(d, values: str) -> str:
    if d is SPARK:
        return f"array_join(transform({values}, v -> CAST(v AS STRING)), ',')"
    return f"array_to_string(list_transform({values}, lambda v: CAST(v AS VARCHAR)), ',')"


def _patched(d) -> list[str]:
    """The header of a rewritten surface: compressed ones tell level 0's size, others the bytes of a row."""
    block = formats.is_block("format")
    return [
        f"CASE WHEN {block} THEN 528391 + CASE WHEN mips > 1 THEN 131072 ELSE 0 END ELSE 4111 + CASE WHEN mips > 1 THEN 131072 ELSE 0 END END AS flags",
        _big(f"CASE WHEN {block} THEN {d.surface('format', 'w', 'h')} ELSE w * {formats.pixel_bytes('format')} END", "pitch_or_linear"),
        "CASE WHEN mips > 1 THEN 4198408 ELSE 4096 END AS caps",
    ]


def _joined_where(d, cap: str) -> str:
    floors = [0, 2048, 1024, 512, 256, 128, 64]
    shown = [f"CASE WHEN {f} = 0 OR {cap} = 0 OR {f} < least({cap}, w) THEN '{f}' END" for f in floors]
    return f"concat_ws(',', {', '.join(shown)}) AS floors_{cap}"


_on_textures("surface_size", lambda d: ["format", _big(d.surface("format", "w", "h"), "surface_size")], ["format", f"{checking.surface('w', 'h')} AS surface_size"])
_on_textures("mip_chain", lambda d: ["mips", f"CASE WHEN {formats.is_sizable('format')} THEN {_joined(d, d.chain('format', 'w', 'h', 'mips'))} END AS chain"], ["mips", f"{_joined(DUCK, checking.own_chain())} AS chain"])
_on_textures("levels_to_drop", lambda d: [_big(d.levels_to_drop("w", "h", "mips", c), f"drop_{c}") for c in ("0", "256", "1024", "2048")], [_big(checking.drop("w", "h", "mips", c), f"drop_{c}") for c in ("0", "256", "1024", "2048")])
_on_textures("apply_downscale", lambda d: [_big(d.shr(s, d.halvings("w", "h", c)), f"{s}_{c}") for s in ("w", "h") for c in ("0", "64", "512", "2048")], [_big(f"{s} >> CAST({checking.halvings('w', 'h', c)} AS INTEGER)", f"{s}_{c}") for s in ("w", "h") for c in ("0", "64", "512", "2048")])
_on_textures("full_mip_count", lambda d: [_big(d.bits("greatest(w, h)"), "full_mips")], [_big(checking.levels("greatest(w, h)"), "full_mips")])
_on_textures("format_name", lambda d: [f"{d.text(formats.format_name('format'))} AS format_name"])
_on_textures("match_colour_space", lambda d: [_big(formats.match_colour_space(str(t), "format"), f"to_{t}") for t in (71, 77, 98)], [_big(f"{t} + CASE WHEN format IN (29, 72, 75, 78, 91, 99) THEN 1 ELSE 0 END", f"to_{t}") for t in (71, 77, 98)])
_on_textures("can_describe", lambda d: [f"{d.can_describe('192', d.bits('greatest(w, h)'))} AS fits", f"{d.can_describe('100', d.bits('greatest(w, h)'))} AS fits_100"], [f"12 * ({checking.levels('greatest(w, h)')}) <= 172 AS fits", f"12 * ({checking.levels('greatest(w, h)')}) <= 80 AS fits_100"])
_on_textures("chain_suffix_sum", lambda d: ["mips", *(f"CASE WHEN {formats.is_sizable('format')} THEN {d.total(d.cut(d.chain('format', 'w', 'h', 'mips'), str(k)))} END AS from_{k}" for k in (0, 1, 3)), f"CASE WHEN {formats.is_sizable('format')} THEN {d.total(d.cut(d.chain('format', 'w', 'h', 'mips'), '1', '2'))} END AS two_from_1"], ["mips", *(f"CASE WHEN len({checking.own_chain()}) > 0 THEN {checking.total(f'({checking.own_chain()})[{k + 1}:]')} END AS from_{k}" for k in (0, 1, 3)), f"CASE WHEN len({checking.own_chain()}) > 0 THEN {checking.total(f'({checking.own_chain()})[2:3]')} END AS two_from_1"])
_on_textures("stream_flag", lambda d: ["CASE WHEN pos % 9 = 0 THEN 2 ELSE 1 END AS flag"])
_on_textures("dds_patch_fields", lambda d: _patched(d))
_on_textures("dds_stream_fields", lambda d: [f"CASE WHEN {formats.is_block('format')} THEN 0 ELSE w * {formats.pixel_bytes('format')} END AS pitch", _big("4111", "flags")])
_on_textures("floors_for_cap", lambda d: [_joined_where(d, c) for c in ("0", "1024", "256")])
_on_textures("pow2_check", lambda d: [f"(w >= 4 AND w = CAST(pow(2, {d.bits('w')} - 1) AS BIGINT)) AS w_ok", f"(h >= 4 AND h = CAST(pow(2, {d.bits('h')} - 1) AS BIGINT)) AS h_ok"])
def _grid(d) -> list[str]:
    """What a grid shows of a texture capped at 512: its size, the size it gets and its share of pixels, and whether that is risky."""
    text = lambda v: f"CAST({v} AS {d.string})"
    side = lambda w, h: f"CASE WHEN {w} = {h} THEN {text(w)} ELSE concat({text(w)}, 'x', {text(h)}) END"
    steps = d.halvings("w", "h", "512")
    small = [d.shr(x, steps) for x in ("w", "h")]
    return [
        f"{side('w', 'h')} AS shown", f"CASE WHEN {steps} > 0 THEN {side(*small)} END AS resized",
        f"CASE WHEN {steps} > 0 THEN {_long(d.div(f'(100 * {small[0]} * {small[1]})', '(w * h)'))} END AS percent_left", f"({steps} > 1 OR mips > 1 AND {steps} > 0) AS risky",
    ]


def _long(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


_on_textures("grid_dimensions", _grid)


projected("align64", asset_rows, ASSETS, "assets", [*KEY, _big(SPARK.align("size"), "aligned")], [*KEY, _big(DUCK.align("size"), "aligned")])
projected("human_bytes", asset_rows, ASSETS, "assets", [*KEY, f"{SPARK.human_bytes('size * size')} AS shown", f"{SPARK.human_bytes('size')} AS shown_small"], [*KEY, f"{DUCK.human_bytes('size * size')} AS shown", f"{DUCK.human_bytes('size')} AS shown_small"])
projected("payload_sha256", asset_rows, ASSETS, "assets", [*KEY, "size", "hash"], [*KEY, "size", "hash"])
projected("entry_name_hex", asset_rows, ASSETS, "assets", [*KEY, "lpad(hex(pos * 2654435761 + 4096), 16, '0') AS name"], [*KEY, "upper(lpad(to_hex(pos * 2654435761 + 4096), 16, '0')) AS name"])
projected("entry_flags", asset_rows, ASSETS, "assets", [*KEY, "size > 0 AS has_gpu", "pos % 5 = 0 AS has_stream", "type_name = 'texture' AS is_texture"], [*KEY, "size > 0 AS has_gpu", "pos % 5 = 0 AS has_stream", "type_name = 'texture' AS is_texture"])
@query("filter_gpu_backed", f"WITH {TEXTURES} SELECT 'gpu' AS subset, bundle, pos FROM textures WHERE gpu_size > 0 UNION ALL SELECT 'stream', bundle, pos FROM textures WHERE stream_size > 0 UNION ALL SELECT 'texture', bundle, pos FROM textures WHERE has_dx10 AND gpu_size > 0")
def filter_gpu_backed(spark, sf_dir):
    """The three subsets that work runs on, each entry once for each that it is in."""
    inside = {"gpu": F.col("gpu_size") > 0, "stream": F.col("stream_size") > 0, "texture": F.col("has_dx10") & (F.col("gpu_size") > 0)}
    subsets = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in inside.items())), lambda x: x.isNotNull())
    return textures(spark, sf_dir).select(F.explode(subsets).alias("subset"), "bundle", "pos")


@query("skipped_rows", f"WITH {TEXTURES} SELECT bundle, pos, CASE WHEN has_dx10 THEN concat(CAST(w AS VARCHAR), 'x', CAST(h AS VARCHAR), ' ', {DUCK.text(formats.format_name('format'))}) ELSE concat(format('{{:,}}', gpu_size), ' bytes') END AS description FROM textures WHERE NOT has_dx10 OR format IN (61, 95)")
def skipped_rows(spark, sf_dir):
    """Skipped entries: size and format where a header tells them, else the bytes of the payload, grouped by thousands."""
    shown = f"CASE WHEN has_dx10 THEN concat(CAST(w AS STRING), 'x', CAST(h AS STRING), ' ', {SPARK.text(formats.format_name('format'))}) ELSE concat(format_number(gpu_size, 0), ' bytes') END AS description"
    return textures(spark, sf_dir).filter("NOT has_dx10 OR format IN (61, 95)").selectExpr("bundle", "pos", shown)


@query("format_dim_join", f"WITH {TEXTURES}, {formats.format_dim_sql()} SELECT t.bundle, t.pos, t.format, f.name, f.block_bytes, f.pixel_bytes, f.is_block, f.is_srgb FROM textures t LEFT JOIN format_dim f ON f.code = t.format")
def format_dim_join(spark, sf_dir):
    dim = formats.format_dim(spark)  # the list of formats: 20 rows
    t = textures(spark, sf_dir)
    return t.join(F.broadcast(dim), t["format"] == dim["code"], "left").select("bundle", "pos", "format", "name", "block_bytes", "pixel_bytes", "is_block", "is_srgb")


@query("format_dim", f"WITH {TEXTURES}, {formats.format_dim_sql()} SELECT f.*, count(t.pos) AS n_textures FROM format_dim f LEFT JOIN textures t ON f.code = t.format GROUP BY ALL")
def format_dim(spark, sf_dir):
    counts = textures(spark, sf_dir).groupBy(F.col("format").alias("code")).agg(F.count("*").alias("n"))
    return formats.format_dim(spark).join(counts, "code", "left").withColumn("n_textures", F.coalesce("n", F.lit(0))).drop("n")


@query("locale_tag", "SELECT event_id, CASE WHEN lower(string_split(replace(string_split(string_split(event_type || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.UTF-8' WHEN 2 THEN '@x' ELSE '_CN' END, '.')[1], '@')[1], '_', '-'), '-')[1]) = 'view' THEN 'zh' ELSE 'en' END AS language FROM events")
def locale_tag(spark, sf_dir):
    """Languages of locale tags: what stands before encoding, modifier and region, in any case. One event type plays the known language."""
    suffix = F.element_at(F.array(F.lit(""), F.lit(".UTF-8"), F.lit("@x"), F.lit("_CN")), (F.col("event_id") % 4 + 1).cast("int"))
    tag = F.concat("event_type", suffix)
    primary = F.substring_index(F.translate(F.substring_index(F.substring_index(tag, ".", 1), "@", 1), "_", "-"), "-", 1)
    return read(spark, sf_dir, "events").select("event_id", F.when(F.lower(primary) == "view", "zh").otherwise("en").alias("language"))
