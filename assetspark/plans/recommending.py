"""Recommendations, plans and their totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetspark.bindings import TEXTURES, textures
from assetspark.functions.dialect import DUCK, SPARK
from assetspark.operators import layout, plan, rules
from assetspark.operators.plan import Options
from assetspark.plans import checking
from assetspark.plans.registry import query
from assetspark.plans.relational import ANALYSIS, analysed

#: The grid over which rules are compared: options by name.
GRID = {
    "plain": Options(),
    "quality": Options(strategy="quality", collapse=False),
    "smallest": Options(strategy="smallest", cap=1024),
    "single": Options(cap=512, single=True),
    "stream": Options(floor=256),
    "capped-stream": Options(cap=1024, floor=128),
    "generate": Options(generate=True, floor=256),
    "generate-capped": Options(generate=True, strategy="smallest", cap=256, prefix=140),
}
COLUMNS = ["option", "bundle", "pos", "rule", "to_format", "to_w", "to_h", "drop_levels", "to_mips", "resident", "generates", "lossless"]
SIZES = ["gpu_size", "predicted_size", "predicted_stream_size"]


def _options_sql(names) -> str:
    rows = ", ".join(f"('{n}', '{o.strategy}', {o.collapse}, CAST({o.cap} AS BIGINT), {o.single}, CAST({o.floor} AS BIGINT), CAST({o.prefix} AS BIGINT), {o.generate})" for n, o in GRID.items() if n in names)
    return f"options(option, strategy, collapse, cap, single, floor, prefix, generate) AS (VALUES {rows})"


def _candidates_sql(names) -> str:
    return f"{TEXTURES}, {ANALYSIS}, {_options_sql(names)}, {checking.SIZED}"


def grid(spark, sf_dir, names):
    """The textures under each option of the grid: options are a short list, dealt beside each row."""
    c = plan.candidates(textures(spark, sf_dir), analysed(spark, sf_dir).drop("a_distinct", "v"))
    options = [F.struct(F.lit(n).alias("option"), *(v.alias(k) for k, v in GRID[n].columns().items())) for n in names]
    return c.withColumn("o", F.explode(F.array(*options))).select("*", "o.*").drop("o")


def _register(name: str, names) -> None:
    @query(name, f"WITH {_candidates_sql(names)} SELECT {', '.join(COLUMNS)} FROM sized WHERE unsupported IS NULL")
    def run(spark, sf_dir):
        return rules.recommend(grid(spark, sf_dir, names).filter("unsupported IS NULL")).select(*COLUMNS)


_register("recommend", ("plain", "quality", "smallest", "single", "stream", "capped-stream"))
_register("recommend_generate", ("generate", "generate-capped"))
ALL = tuple(GRID)


@query("classify_texture", f"WITH {TEXTURES}, {checking.CLASSIFIED} SELECT bundle, pos, expected_size, unsupported FROM classified")
def classify_texture(spark, sf_dir):
    return rules.apply(textures(spark, sf_dir), rules.classify(SPARK)).select("bundle", "pos", "expected_size", "unsupported")


@query("texture_rows", f"WITH {TEXTURES} SELECT bundle, pos, w, h, format, mips, gpu_size, stream_size, first_resident FROM textures WHERE gpu_size > 0")
def texture_rows(spark, sf_dir):
    return textures(spark, sf_dir).filter("gpu_size > 0").select("bundle", "pos", "w", "h", "format", "mips", "gpu_size", "stream_size", "first_resident")


def planned(spark, sf_dir, names=ALL):
    supported = grid(spark, sf_dir, names).filter("unsupported IS NULL")
    return rules.predict(rules.recommend(supported).withColumn("include", F.lit(True)))


@query("predicted_size", f"WITH {_candidates_sql(ALL)} SELECT option, bundle, pos, {', '.join(SIZES)} FROM sized WHERE unsupported IS NULL")
def predicted_size(spark, sf_dir):
    return planned(spark, sf_dir).select("option", "bundle", "pos", *SIZES)


@query("predicted_stream_size", f"WITH {_candidates_sql(ALL)} SELECT option, bundle, {'CAST(sum(predicted_stream_size) AS BIGINT)'} AS stream_bytes, count(resident) AS n_streamed FROM sized WHERE unsupported IS NULL GROUP BY option, bundle")
def predicted_stream_size(spark, sf_dir):
    return planned(spark, sf_dir).groupBy("option", "bundle").agg(F.sum("predicted_stream_size").alias("stream_bytes"), F.count("resident").alias("n_streamed"))


SAVING = "gpu_size - predicted_size AS saving, to_format = format AND to_w = w AND to_h = h AS unchanged"


@query("plan_saving", f"WITH {_candidates_sql(ALL)} SELECT option, bundle, pos, {SAVING} FROM sized WHERE unsupported IS NULL")
def plan_saving(spark, sf_dir):
    return planned(spark, sf_dir).selectExpr("option", "bundle", "pos", *SAVING.split(", "))


@query("no_saving_gate", f"WITH {_candidates_sql(ALL)} SELECT option, count(*) FILTER (WHERE predicted_size < gpu_size) AS n_planned, count(*) FILTER (WHERE predicted_size >= gpu_size) AS n_efficient FROM sized WHERE unsupported IS NULL GROUP BY option")
def no_saving_gate(spark, sf_dir):
    saves = F.col("predicted_size") < F.col("gpu_size")
    return planned(spark, sf_dir).groupBy("option").agg(F.count_if(saves).alias("n_planned"), F.count_if(~saves).alias("n_efficient"))


TOTALS = {
    "n_textures": "count(*)", "n_planned": "count(*) FILTER (WHERE kept)", "n_skipped": "count(*) FILTER (WHERE NOT kept)", "bytes_before": "CAST(sum(gpu_size) AS BIGINT)",
    "bytes_after": "CAST(sum(CASE WHEN kept THEN predicted_size ELSE gpu_size END) AS BIGINT)", "n_generated": "count(*) FILTER (WHERE kept AND generates)", "n_streamed": "count(*) FILTER (WHERE kept AND resident IS NOT NULL)",
    "n_chained": "count(*) FILTER (WHERE mips > 1)", "n_chainless": "count(*) FILTER (WHERE mips <= 1)", "added_stream_bytes": "CAST(sum(CASE WHEN kept THEN predicted_stream_size ELSE 0 END) AS BIGINT)",
}


def _totals_sql(name: str, columns) -> str:
    return f"WITH {_candidates_sql((name,))}, judged AS (SELECT *, unsupported IS NULL AND predicted_size < gpu_size AS kept FROM sized) SELECT bundle, {', '.join(f'{TOTALS[c]} AS {c}' for c in columns)} FROM judged GROUP BY bundle"


def built(spark, sf_dir, name: str):
    analysis = analysed(spark, sf_dir).drop("a_distinct", "v")
    return plan.build(textures(spark, sf_dir), analysis, GRID[name])


@query("build_plan", _totals_sql("plain", TOTALS))
def build_plan(spark, sf_dir):
    """The flagship: per bundle, what the plan does and what it saves."""
    return plan.totals(built(spark, sf_dir, "plain"))


@query("plan_counts", _totals_sql("generate", ("n_textures", "n_planned", "n_generated", "n_streamed", "n_chained", "n_chainless")))
def plan_counts(spark, sf_dir):
    return plan.totals(built(spark, sf_dir, "generate")).select("bundle", "n_textures", "n_planned", "n_generated", "n_streamed", "n_chained", "n_chainless")


@query("added_stream", _totals_sql("capped-stream", ("added_stream_bytes", "n_streamed")))
def added_stream(spark, sf_dir):
    return plan.totals(built(spark, sf_dir, "capped-stream")).select("bundle", "added_stream_bytes", "n_streamed")


@query("gpu_footprint", _totals_sql("smallest", ("bytes_before", "bytes_after")))
def gpu_footprint(spark, sf_dir):
    return plan.totals(built(spark, sf_dir, "smallest")).select("bundle", "bytes_before", "bytes_after")


@query("plan_totals", _totals_sql("single", TOTALS))
def plan_totals(spark, sf_dir):
    return plan.totals(built(spark, sf_dir, "single"))


#: A payload of the plan is a surface with what becomes of it: entries that share both share its place.
PLAN_KEY = ["vec_id", "w", "h", "format", "mips", "to_format", "to_w", "to_h", "to_mips", "drop_levels", "resident", "kept"]


def _plan_size_sql(name: str) -> str:
    return f"""WITH {_candidates_sql((name,))}, judged AS (SELECT *, unsupported IS NULL AND predicted_size < gpu_size AS kept FROM sized),
written AS (SELECT *, CASE WHEN kept THEN predicted_size ELSE gpu_size END AS size FROM judged),
firsts AS (SELECT *, row_number() OVER (PARTITION BY bundle, {', '.join(PLAN_KEY)}, size ORDER BY pos) AS k FROM written),
ends AS (SELECT bundle, sum(({DUCK.align('size')})) OVER (PARTITION BY bundle ORDER BY pos) - ({DUCK.align('size')}) + size AS upto, row_number() OVER (PARTITION BY bundle ORDER BY pos DESC) AS back FROM firsts WHERE k = 1)
SELECT b.bundle, CAST(e.upto AS BIGINT) AS bytes_after, b.bytes_before FROM ends e JOIN (SELECT bundle, CAST(sum(gpu_size) AS BIGINT) AS bytes_before FROM written GROUP BY bundle) b USING (bundle) WHERE back = 1"""


def plan_sizes(spark, sf_dir, name: str):
    """Per bundle the bytes of its payloads now and the length of the file that the plan leads to, payloads shared by content and target."""
    planned_ = built(spark, sf_dir, name).withColumn("kept", F.col("include")).withColumn("size", F.when(F.col("include"), F.col("predicted_size")).otherwise(F.col("gpu_size")))
    before = planned_.groupBy("bundle").agg(F.sum("gpu_size").alias("bytes_before"))
    return layout.packed_size(planned_, [*PLAN_KEY, "size"], order=("pos",)).withColumnRenamed("packed_size", "bytes_after").join(before, "bundle")


@query("predicted_file_size", _plan_size_sql("smallest"))
def predicted_file_size(spark, sf_dir):
    return plan_sizes(spark, sf_dir, "smallest").select("bundle", "bytes_after", "bytes_before")


@query("worth_writing", f"WITH m AS ({_totals_sql('plain', ('bytes_before', 'bytes_after'))}), f AS ({_plan_size_sql('plain')}) SELECT m.bundle, m.bytes_after < m.bytes_before AS saves_memory, f.bytes_after < f.bytes_before AS saves_disk, m.bytes_after < m.bytes_before OR f.bytes_after < f.bytes_before AS worth_writing FROM m JOIN f USING (bundle)")
def worth_writing(spark, sf_dir):
    """A plan is worth writing if it saves memory, entry by entry, or disk, where equal payloads share their place."""
    memory = plan.totals(built(spark, sf_dir, "plain")).select("bundle", (F.col("bytes_after") < F.col("bytes_before")).alias("saves_memory"))
    disk = plan_sizes(spark, sf_dir, "plain").select("bundle", (F.col("bytes_after") < F.col("bytes_before")).alias("saves_disk"))
    return memory.join(disk, "bundle").withColumn("worth_writing", F.col("saves_memory") | F.col("saves_disk"))


@query("plan_targets", f"WITH {_candidates_sql(('smallest',))} SELECT bundle, pos, CASE WHEN mips > 1 THEN format ELSE to_format END AS target_format, to_w, to_h, mips <= 1 AS free_choice, unsupported IS NULL AND lossless AND to_w <> w AS risky FROM sized WHERE unsupported IS NULL")
def plan_targets(spark, sf_dir):
    """A sliced chain keeps its format; the choice is free for single levels."""
    return planned(spark, sf_dir, ("smallest",)).selectExpr("bundle", "pos", "CASE WHEN mips > 1 THEN format ELSE to_format END AS target_format", "to_w", "to_h", "mips <= 1 AS free_choice", "unsupported IS NULL AND lossless AND to_w <> w AS risky")


def _slices(d) -> list[str]:
    upto = lambda n: d.total(d.cut("chain", "0", n))
    return ["option", "bundle", "pos", f"{upto('drop_levels')} AS dropped_bytes", f"{upto('(drop_levels + coalesce(resident, 0))')} AS resident_from", f"{d.total(d.cut('chain', '(drop_levels + coalesce(resident, 0))', 'to_mips'))} AS resident_bytes"]


_RESIDENT = "drop_levels + coalesce(resident, 0)"
SLICES = f"option, bundle, pos, {checking.total('chain[:drop_levels]')} AS dropped_bytes, {checking.total(f'chain[:{_RESIDENT}]')} AS resident_from, {checking.total(f'chain[{_RESIDENT} + 1:{_RESIDENT} + to_mips]')} AS resident_bytes"


@query("apply_slices", f"WITH {_candidates_sql(ALL)} SELECT {SLICES} FROM sized WHERE unsupported IS NULL AND mips > 1")
def apply_slices(spark, sf_dir):
    """Byte ranges of a sliced chain: what is dropped, where the resident part begins and how long it is."""
    return planned(spark, sf_dir).filter("mips > 1").selectExpr(*_slices(SPARK))


LEVELS = f"""WITH {TEXTURES}, {checking.CLASSIFIED}, c AS (SELECT * FROM classified WHERE has_dx10 AND mips > 1),
l AS (SELECT bundle, pos, w, h, mips, {checking.total('chain')} AS total, unnest(chain) AS level_size, unnest(range(0, len(chain))) AS level FROM c),
s AS (SELECT *, CAST(sum(level_size) OVER (PARTITION BY bundle, pos ORDER BY level) AS BIGINT) AS upto FROM l)
SELECT bundle, pos, level, greatest(1, w >> CAST(level AS INT)) AS level_w, greatest(1, h >> CAST(level AS INT)) AS level_h, level_size, CASE WHEN level = mips - 1 THEN 0 ELSE upto END AS next_offset, CASE WHEN level = mips - 1 THEN 0 ELSE total - upto END AS rest FROM s"""


@query("level_table", LEVELS)
def level_table(spark, sf_dir):
    return layout.level_table(textures(spark, sf_dir).filter("has_dx10 AND mips > 1"))
