"""Joins, aggregations, windows and set operations over entries, payloads and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetspark.bindings import ASSETS, PIXELS, asset_rows, assets, read, surfaces
from assetspark.functions.dialect import DUCK, SPARK
from assetspark.operators import layout, profile, verify
from assetspark.plans.registry import query

BIG = "CAST({} AS BIGINT)".format
START = f"CAST(coalesce(sum({DUCK.align('size')}) OVER (PARTITION BY bundle ORDER BY gpu_offset, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


@query("type_census", f"WITH {ASSETS} SELECT bundle, type_name, count(*) AS n, {BIG('sum(size)')} AS bytes FROM assets GROUP BY ALL")
def type_census(spark, sf_dir):
    return asset_rows(spark, sf_dir).groupBy("bundle", "type_name").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("type_name_lookup", f"WITH {ASSETS}, names(type_name, shown) AS (VALUES ('texture', 'Texture'), ('material', 'Material'), ('unit', 'Unit')) SELECT a.bundle, a.pos, coalesce(n.shown, upper(lpad(to_hex(length(a.type_name)), 16, '0'))) AS shown FROM assets a LEFT JOIN names n USING (type_name)")
def type_name_lookup(spark, sf_dir):
    names = spark.createDataFrame([("texture", "Texture"), ("material", "Material"), ("unit", "Unit")], "type_name string, shown string")
    return asset_rows(spark, sf_dir).join(F.broadcast(names), "type_name", "left").select("bundle", "pos", F.coalesce("shown", F.expr("lpad(hex(length(type_name)), 16, '0')")).alias("shown"))


@query("check_type_counts", f"WITH {ASSETS}, counted AS (SELECT bundle, type_name, count(*) AS c FROM assets GROUP BY bundle, type_name), declared AS (SELECT bundle, c + CASE WHEN bundle = 'src3' AND type_name = 'unit' THEN 1 ELSE 0 END AS n FROM counted), held AS (SELECT bundle, count(*) AS n_entries FROM assets GROUP BY ALL) SELECT h.bundle, {BIG('sum(d.n)')} AS n_declared, h.n_entries, sum(d.n) = h.n_entries AS sound FROM declared d JOIN held h USING (bundle) GROUP BY h.bundle, h.n_entries")
def check_type_counts(spark, sf_dir):
    """Whether the type table's counts add up to the entries; one table is off by one here."""
    a = asset_rows(spark, sf_dir)
    declared = a.groupBy("bundle", "type_name").agg((F.count("*") + F.when((F.first("bundle") == "src3") & (F.first("type_name") == "unit"), 1).otherwise(0)).alias("n"), F.count("*").alias("held"))
    return declared.groupBy("bundle").agg(F.sum("n").alias("n_declared"), F.sum("held").alias("n_entries")).withColumn("sound", F.col("n_declared") == F.col("n_entries"))


@query("dup_groups", f"WITH {ASSETS} SELECT hash, count(DISTINCT concat(bundle, ':', CAST(gpu_offset AS VARCHAR))) AS n_regions, max(size) AS size FROM assets GROUP BY hash HAVING count(DISTINCT concat(bundle, ':', CAST(gpu_offset AS VARCHAR))) > 1")
def dup_groups(spark, sf_dir):
    return _dup_groups(assets(spark, sf_dir))


def _dup_groups(a):
    """Payloads that occupy several regions. Entries that share a region are one already."""
    return a.groupBy("hash").agg(F.countDistinct("bundle", "gpu_offset").alias("n_regions"), F.max("size").alias("size")).filter("n_regions > 1")


@query("dup_totals", f"WITH {ASSETS}, g AS (SELECT bundle, hash, count(DISTINCT gpu_offset) AS n, max(size) AS size FROM assets GROUP BY ALL HAVING count(DISTINCT gpu_offset) > 1) SELECT bundle, {BIG('sum((n - 1) * size)')} AS redundant_bytes, {BIG('sum(n - 1)')} AS duplicate_entries FROM g GROUP BY bundle")
def dup_totals(spark, sf_dir):
    g = assets(spark, sf_dir).groupBy("bundle", "hash").agg(F.countDistinct("gpu_offset").alias("n"), F.max("size").alias("size")).filter("n > 1")
    return g.groupBy("bundle").agg(F.sum((F.col("n") - 1) * F.col("size")).alias("redundant_bytes"), F.sum(F.col("n") - 1).alias("duplicate_entries"))


@query("dedup_first", f"WITH {ASSETS} SELECT bundle, pos, row_number() OVER (PARTITION BY bundle, hash ORDER BY gpu_offset, pos) = 1 AS is_first, min(gpu_offset) OVER (PARTITION BY bundle, hash) AS kept_offset FROM assets")
def dedup_first(spark, sf_dir):
    marked = layout.mark_first(assets(spark, sf_dir), ["hash"], ["gpu_offset", "pos"])
    return marked.select("bundle", "pos", "is_first", F.col("first.gpu_offset").alias("kept_offset"))


@query("pack_plain", f"WITH {ASSETS} SELECT bundle, pos, {START} AS new_offset FROM assets")
def pack_plain(spark, sf_dir):
    return layout.pack(assets(spark, sf_dir)).select("bundle", "pos", "new_offset")


PACKED = f"""{ASSETS}, marked AS (SELECT *, row_number() OVER (PARTITION BY bundle, hash ORDER BY gpu_offset, pos) = 1 AS is_first FROM assets),
placed AS (SELECT *, CAST(coalesce(sum(CASE WHEN is_first THEN {DUCK.align('size')} ELSE 0 END) OVER (PARTITION BY bundle ORDER BY gpu_offset, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS own FROM marked),
packed AS (SELECT *, min(CASE WHEN is_first THEN own END) OVER (PARTITION BY bundle, hash) AS new_offset FROM placed)"""


@query("pack_layout", f"WITH {PACKED} SELECT bundle, pos, is_first, new_offset FROM packed")
def pack_layout(spark, sf_dir):
    return layout.pack(assets(spark, sf_dir), ["hash"]).select("bundle", "pos", "is_first", "new_offset")


@query("predicted_gpu_size", f"WITH {PACKED}, plain AS (SELECT bundle, max(gpu_offset + size) AS current_size FROM assets GROUP BY bundle) SELECT p.bundle, plain.current_size, arg_max(new_offset + size, new_offset * 1000000000 + pos) AS packed_size FROM packed p JOIN plain USING (bundle) WHERE is_first GROUP BY ALL")
def predicted_gpu_size(spark, sf_dir):
    a = assets(spark, sf_dir)
    now = a.groupBy("bundle").agg(F.max(F.col("gpu_offset") + F.col("size")).alias("current_size"))
    return now.join(layout.packed_size(a, ["hash"]), "bundle")


@query("stream_layout", f"WITH {ASSETS}, t AS (SELECT *, row_number() OVER (PARTITION BY bundle, hash ORDER BY pos) = 1 AS is_first FROM assets WHERE type_name = 'texture' OR pos % 5 = 0), o AS (SELECT *, CAST(coalesce(sum(CASE WHEN is_first THEN {DUCK.align('size')} ELSE 0 END) OVER (PARTITION BY bundle ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS own FROM t) SELECT bundle, pos, min(CASE WHEN is_first THEN own END) OVER (PARTITION BY bundle, hash) AS stream_offset, size AS stream_size FROM o")
def stream_layout(spark, sf_dir):
    """Streamed payloads lie in table order: what already was streamed and what is converted."""
    targets = asset_rows(spark, sf_dir).filter("type_name = 'texture' OR pos % 5 = 0")
    return layout.pack(targets, ["hash"], order=("pos",)).select("bundle", "pos", F.col("new_offset").alias("stream_offset"), F.col("size").alias("stream_size"))


@query("distinct_regions", f"WITH {ASSETS}, shared AS (SELECT bundle, gpu_offset - gpu_offset % 4096 AS gpu_offset, size - size % 1024 AS size FROM assets) SELECT bundle, gpu_offset, size, count(*) AS n_entries FROM shared GROUP BY ALL")
def distinct_regions(spark, sf_dir):
    """Regions (offset, size) and how many entries name each; offsets and sizes are rounded so that some do."""
    e = assets(spark, sf_dir).select("bundle", "pos", F.expr("gpu_offset - gpu_offset % 4096").alias("gpu_offset"), F.expr("size - size % 1024").alias("size"))
    return verify.regions(e).drop("pos")


@query("batch_union", f"WITH {ASSETS} SELECT bundle, pos, 'planned' AS part FROM assets WHERE type_name = 'texture' UNION ALL SELECT bundle, pos, 'skipped' FROM assets WHERE type_name <> 'texture' AND size > 500")
def batch_union(spark, sf_dir):
    a = asset_rows(spark, sf_dir)
    return a.filter("type_name = 'texture'").select("bundle", "pos", F.lit("planned").alias("part")).unionByName(a.filter("type_name <> 'texture' AND size > 500").select("bundle", "pos", F.lit("skipped").alias("part")))


UNEVEN = "gpu_offset + CASE WHEN pos % 3 = 1 THEN 8 ELSE 0 END"


@query("first_issues", f"WITH {ASSETS}, issues AS (SELECT bundle, pos, {UNEVEN} AS detail FROM assets WHERE ({UNEVEN}) % 64 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY pos) AS k, count(*) OVER (PARTITION BY bundle) AS n_issues FROM issues) SELECT bundle, pos, CAST(detail AS VARCHAR) AS detail, k, n_issues FROM r WHERE k <= 3")
def first_issues(spark, sf_dir):
    """The first three issues of each bundle and how many it has. Only three a bundle and task reach the shuffle."""
    found = verify.check_alignment(assets(spark, sf_dir).withColumn("gpu_offset", F.expr(UNEVEN)))
    return verify.first_of(found)


@query("analyse_once_join", f"WITH {ASSETS}, once AS (SELECT hash, min(pos) AS first_pos, count(*) AS uses FROM assets GROUP BY hash) SELECT a.bundle, a.pos, o.first_pos, o.uses FROM assets a JOIN once o USING (hash)")
def analyse_once_join(spark, sf_dir):
    """What is computed per distinct payload, given back to each entry that holds it."""
    a = asset_rows(spark, sf_dir).select("bundle", "pos", "hash")
    once = a.groupBy("hash").agg(F.min("pos").alias("first_pos"), F.count("*").alias("uses"))
    return a.join(once, "hash").select("bundle", "pos", "first_pos", "uses")


LABELLED = "SELECT doc_id, toxic, quality FROM labels"


@query("footprint_left_join", f"WITH {ASSETS} SELECT a.bundle, {BIG('sum(a.size)')} AS before, {BIG('sum(CASE WHEN l.quality = 1 THEN a.size // 2 ELSE a.size END)')} AS after FROM assets a LEFT JOIN labels l ON l.doc_id = a.pos GROUP BY a.bundle")
def footprint_left_join(spark, sf_dir):
    """Resident bytes before and after a plan that has a row for some entries: those without keep their size."""
    a = asset_rows(spark, sf_dir).select("bundle", "pos", "size")
    plan = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("pos"), F.lit(True).alias("planned"))
    after = F.expr("CASE WHEN planned THEN size div 2 ELSE size END")
    return a.join(plan, "pos", "left").groupBy("bundle").agg(F.sum("size").alias("before"), F.sum(after).alias("after"))


@query("pending_anti", f"WITH {ASSETS} SELECT a.bundle, count(*) AS n_pending FROM assets a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.pos) GROUP BY a.bundle")
def pending_anti(spark, sf_dir):
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"))
    return asset_rows(spark, sf_dir).select("bundle", "pos").join(done, "pos", "left_anti").groupBy("bundle").agg(F.count("*").alias("n_pending"))


@query("overrides_join", f"WITH {ASSETS} SELECT a.bundle, a.pos, CASE WHEN l.toxic = 1 THEN 0 ELSE coalesce(l.quality, 1) END AS include, l.doc_id IS NOT NULL AS edited FROM assets a LEFT JOIN labels l ON l.doc_id = a.pos")
def overrides_join(spark, sf_dir):
    """Edits kept beside a plan apply last."""
    edits = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), "toxic", "quality", F.lit(True).alias("known"))
    j = asset_rows(spark, sf_dir).select("bundle", "pos").join(edits, "pos", "left")
    return j.select("bundle", "pos", F.when(F.col("toxic") == 1, 0).otherwise(F.coalesce("quality", F.lit(1))).alias("include"), F.col("known").isNotNull().alias("edited"))


@query("incremental_pending", f"WITH {ASSETS} SELECT DISTINCT hash FROM assets WHERE hash NOT IN (SELECT a.hash FROM assets a JOIN labels l ON l.doc_id = a.pos)")
def incremental_pending(spark, sf_dir):
    """Distinct payloads that no earlier analysis covers, however many entries hold them."""
    a = asset_rows(spark, sf_dir).select("pos", "hash")
    known = a.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos")), "pos", "left_semi").select("hash")
    return a.select("hash").join(known, "hash", "left_anti").distinct()


@query("outcome_counts", "SELECT user_id, event_type AS outcome, count(*) AS n, round(sum(value), 2) AS saved FROM events GROUP BY ALL")
def outcome_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("saved"))


@query("result_ratio", "WITH r AS (SELECT user_id, count(*) AS before, count(*) FILTER (WHERE event_type <> 'error') AS after FROM events GROUP BY user_id) SELECT user_id, before - after AS saved, CASE WHEN before = 0 THEN 1.0 ELSE round(CAST(after AS DOUBLE) / before, 6) END AS ratio FROM r")
def result_ratio(spark, sf_dir):
    r = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("before"), F.count_if(F.col("event_type") != "error").alias("after"))
    return r.select("user_id", (F.col("before") - F.col("after")).alias("saved"), F.when(F.col("before") == 0, 1.0).otherwise(F.round(F.col("after") / F.col("before"), 6)).alias("ratio"))


@query("selection_state", "WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS analysed, count(*) FILTER (WHERE event_type = 'signup') AS pending FROM events GROUP BY user_id) SELECT user_id, CASE WHEN analysed = 0 AND pending = 0 THEN 'nothing' WHEN analysed = 0 THEN 'selected' WHEN pending = 0 THEN 'analysed' ELSE 'partly' END AS state FROM s")
def selection_state(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("analysed"), F.count_if(F.col("event_type") == "signup").alias("pending"))
    a, p = F.col("analysed") == 0, F.col("pending") == 0
    return s.select("user_id", F.when(a & p, "nothing").when(a, "selected").when(p, "analysed").otherwise("partly").alias("state"))


@query("batch_totals", f"WITH {ASSETS} SELECT bundle, type_name, count(*) AS n, {BIG('sum(size)')} AS bytes, {BIG('grouping(type_name)')} AS whole FROM assets GROUP BY ROLLUP (bundle, type_name)")
def batch_totals(spark, sf_dir):
    """Totals of each bundle's types, of each bundle and of the batch."""
    return asset_rows(spark, sf_dir).rollup("bundle", "type_name").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.grouping("type_name").cast("long").alias("whole"))


@query("analysis_chunks", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum((CAST(floor(l_extendedprice + 0.5) AS BIGINT) + 63) // 64 * 64) AS BIGINT) AS aligned_bytes FROM lineitem GROUP BY ALL")
def analysis_chunks(spark, sf_dir):
    """Aligned bytes of many small payloads, summed in one pass: what a layout without dedup would take."""
    size = F.floor(F.col("l_extendedprice") + 0.5).cast("long")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.shiftright(size + 63, 6) * 64).alias("aligned_bytes"))


# --- surfaces ------------------------------------------------------------------------------------


@query("channel_histogram", f"WITH {PIXELS} SELECT tex_id, ch, v, count(*) AS n FROM pixels GROUP BY ALL")
def channel_histogram(spark, sf_dir):
    return profile.histogram(surfaces(spark, sf_dir))


STATS = f"{PIXELS}, stats AS (SELECT tex_id, ch, min(v) AS min_v, max(v) AS max_v, count(DISTINCT v) AS n_distinct, avg(v) AS mean_v FROM pixels GROUP BY ALL)"
ANALYSIS = f"""{STATS}, wide AS (
  SELECT tex_id, bool_and(min_v = max_v) AS solid, bool_and(min_v = max_v) FILTER (WHERE ch < 3) AS flat_rgb, max(min_v) FILTER (WHERE ch = 0) AS r, max(min_v) FILTER (WHERE ch = 1) AS g,
         max(min_v) FILTER (WHERE ch = 2) AS b, max(min_v) FILTER (WHERE ch = 3) AS a, max(max_v) FILTER (WHERE ch = 3) AS a_max, max(n_distinct) FILTER (WHERE ch = 3) AS a_distinct FROM stats GROUP BY tex_id),
analysis AS (
  SELECT tex_id, solid, flat_rgb AND a <> a_max AS flat_alpha, a <> a_max OR a <> 255 AS alpha_detail, a_distinct = 2 AND a = 0 AND a_max = 255 AS binary_alpha, r, g, b, a, a_distinct FROM wide)"""


def analysed(spark, sf_dir):
    """The surfaces with what they hold."""
    return profile.analyse(profile.profiles(surfaces(spark, sf_dir), whole=True))


def as_pixels(small):
    """Surfaces as one row per channel value, as they are reported."""
    flat = small.select("tex_id", "w", F.posexplode("v").alias("i", "v"))
    return flat.selectExpr("tex_id", "CAST(i % 4 AS BIGINT) AS ch", "(i div 4) % w AS x", "(i div 4) div w AS y", "v")


@query("channel_stats", f"WITH {STATS} SELECT tex_id, ch, min_v, max_v, n_distinct, round(mean_v, 6) AS mean_v FROM stats")
def channel_stats(spark, sf_dir):
    return profile.channel_stats(profile.profiles(surfaces(spark, sf_dir), whole=True)).withColumn("mean_v", F.round("mean_v", 6))


@query("solid_flag", f"WITH {ANALYSIS} SELECT tex_id, solid FROM analysis")
def solid_flag(spark, sf_dir):
    return analysed(spark, sf_dir).select("tex_id", "solid")


@query(
    "content_class",
    f"WITH {ANALYSIS}, kinds AS (SELECT *, CASE WHEN solid THEN 0 WHEN flat_alpha THEN 1 WHEN alpha_detail THEN 2 ELSE 3 END AS k FROM analysis) "
    "SELECT tex_id, binary_alpha, ['one-value', 'one-colour', 'transparent', 'opaque'][k + 1] AS class, CASE WHEN k < 2 THEN r END AS r, CASE WHEN k < 2 THEN g END AS g, CASE WHEN k < 2 THEN b END AS b, CASE WHEN k = 0 THEN a END AS a, CASE WHEN k = 1 THEN a_distinct END AS n_alpha FROM kinds",
)
def content_class(spark, sf_dir):
    """A code for what a surface holds, with the values that the class is about."""
    solid, flat = F.col("solid"), F.col("flat_alpha") & ~F.col("solid")
    kind = F.when(solid, "one-value").when(flat, "one-colour").when(F.col("alpha_detail"), "transparent").otherwise("opaque")
    colour = [F.when(solid | flat, F.col(c)).alias(c) for c in "rgb"]
    return analysed(spark, sf_dir).select("tex_id", "binary_alpha", kind.alias("class"), *colour, F.when(solid, F.col("a")).alias("a"), F.when(flat, F.col("a_distinct")).alias("n_alpha"))


@query("exact_565", f"WITH {ANALYSIS} SELECT tex_id, {DUCK.exact_565('r', 'g', 'b', '255')} AS exact_opaque, {DUCK.exact_565('(r // 8 * 8 + r // 32)', '(g // 4 * 4 + g // 64)', '(b // 8 * 8 + b // 32)', 'a')} AS exact_rounded FROM analysis")
def exact_565(spark, sf_dir):
    a = analysed(spark, sf_dir)
    return a.selectExpr("tex_id", f"{SPARK.exact_565('r', 'g', 'b', '255')} AS exact_opaque", f"{SPARK.exact_565('(r div 8 * 8 + r div 32)', '(g div 4 * 4 + g div 64)', '(b div 8 * 8 + b div 32)', 'a')} AS exact_rounded")


@query("half_res", f"WITH {PIXELS} SELECT tex_id, ch, x // 2 AS x, y // 2 AS y, CAST((sum(v) + 2) // 4 AS BIGINT) AS v FROM pixels GROUP BY ALL")
def half_res(spark, sf_dir):
    return as_pixels(profile.half_resolution(surfaces(spark, sf_dir).withColumns({"w": F.lit(4), "h": F.lit(4)})))


@query("box_resample", f"WITH {PIXELS}, spans(t, s) AS (VALUES (0, 0), (1, 1), (2, 2), (2, 3)) SELECT tex_id, CAST(sx.t AS BIGINT) AS x, CAST(sy.t AS BIGINT) AS y, ch, CAST(sum(v) // count(v) AS BIGINT) AS v FROM pixels JOIN spans sx ON sx.s = x JOIN spans sy ON sy.s = y GROUP BY tex_id, sx.t, sy.t, ch")
def box_resample(spark, sf_dir):
    """4x4 surfaces to 3x3."""
    return as_pixels(profile.box_resample(surfaces(spark, sf_dir).withColumns({"w": F.lit(4), "h": F.lit(4)}), 3, 3))


@query("bgra_swizzle", f"WITH {PIXELS} SELECT tex_id, x, y, CASE ch WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE ch END AS ch, v FROM pixels")
def bgra_swizzle(spark, sf_dir):
    order = [i - i % 4 + (2, 1, 0, 3)[i % 4] for i in range(64)]
    turned = surfaces(spark, sf_dir).select("tex_id", F.posexplode(F.array(*(F.get("v", F.lit(i)) for i in order))).alias("i", "v"))
    return turned.selectExpr("tex_id", "CAST((i div 4) % 4 AS BIGINT) AS x", "CAST(i div 16 AS BIGINT) AS y", "CAST(i % 4 AS BIGINT) AS ch", "v")


# Taps of the bilinear restore of a line of 4 from a line of 2.
TAPS = "taps(i, lo, hi, f) AS (VALUES (0, 0, 1, 0.0), (1, 0, 1, 0.25), (2, 0, 1, 0.75), (3, 1, 1, 0.25))"
LOSS = f"""{PIXELS}, {TAPS}, half AS (SELECT tex_id, ch, x // 2 AS x, y // 2 AS y, CAST((sum(v) + 2) // 4 AS DOUBLE) AS v FROM pixels GROUP BY ALL),
restored AS (
  SELECT p.tex_id, CAST(p.v AS DOUBLE) - ((a.v + (b.v - a.v) * tx.f) + ((c.v + (d.v - c.v) * tx.f) - (a.v + (b.v - a.v) * tx.f)) * ty.f) AS e
  FROM pixels p JOIN taps tx ON tx.i = p.x JOIN taps ty ON ty.i = p.y
  JOIN half a ON a.tex_id = p.tex_id AND a.ch = p.ch AND a.x = tx.lo AND a.y = ty.lo JOIN half b ON b.tex_id = p.tex_id AND b.ch = p.ch AND b.x = tx.hi AND b.y = ty.lo
  JOIN half c ON c.tex_id = p.tex_id AND c.ch = p.ch AND c.x = tx.lo AND c.y = ty.hi JOIN half d ON d.tex_id = p.tex_id AND d.ch = p.ch AND d.x = tx.hi AND d.y = ty.hi),
loss AS (SELECT tex_id, sum(e * e) / 64 AS mse FROM restored GROUP BY tex_id)"""


@query("psnr_half", f"WITH {LOSS} SELECT tex_id, round(mse, 4) AS mse, CASE WHEN mse <= 0 THEN 999.0 ELSE round(10 * log10(65025.0 / mse), 4) END AS psnr FROM loss")
def psnr_half(spark, sf_dir):
    """An infinite value is shown as 999."""
    lost = profile.halving_loss(surfaces(spark, sf_dir))
    return lost.select("tex_id", F.round("mse", 4).alias("mse"), F.when(F.col("mse") <= 0, 999.0).otherwise(F.round("psnr", 4)).alias("psnr"))


@query("detail_verdict", f"WITH {LOSS}, p AS (SELECT tex_id, CASE WHEN mse <= 0 THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(65025.0 / mse) END AS db FROM loss) SELECT tex_id, {DUCK.verdict('db')} AS verdict, coalesce(db >= 45, false) AS halving_is_safe FROM p")
def detail_verdict(spark, sf_dir):
    return profile.halving_loss(surfaces(spark, sf_dir)).selectExpr("tex_id", f"{SPARK.verdict('psnr')} AS verdict", "psnr >= 45 AS halving_is_safe")


@query("analyse_surface", f"WITH {ANALYSIS}, {LOSS.split(TAPS + ', ', 1)[1].join([TAPS + ', ', ''])} SELECT a.tex_id, a.solid, a.flat_alpha, a.alpha_detail, a.binary_alpha, a.r, a.g, a.b, a.a, CASE WHEN a.solid OR l.mse <= 0 THEN 999.0 ELSE round(10 * log10(65025.0 / l.mse), 4) END AS psnr FROM analysis a JOIN loss l USING (tex_id)")
def analyse_surface(spark, sf_dir):
    """Classes of content and the loss of halving, which solid surfaces are spared."""
    return profile.halving_loss(analysed(spark, sf_dir)).select("tex_id", "solid", "flat_alpha", "alpha_detail", "binary_alpha", "r", "g", "b", "a", F.when(F.col("solid") | (F.col("mse") <= 0), 999.0).otherwise(F.round("psnr", 4)).alias("psnr"))
