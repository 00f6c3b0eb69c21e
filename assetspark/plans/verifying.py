"""The verifier's checks over layouts with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetspark import formats
from assetspark.bindings import ASSETS, FILES, TEXTURES, assets, files, textures
from assetspark.functions.dialect import DUCK, SPARK
from assetspark.operators import layout, verify
from assetspark.plans import checking
from assetspark.plans.registry import query

#: Planted: some entries moved off their alignment, some into the one before, files cut short or left long.
MOVED = "gpu_offset + CASE WHEN pos % 37 = 5 THEN 8 WHEN pos % 41 = 7 THEN -128 ELSE 0 END"
FAULTY = f"{ASSETS}, faulty AS (SELECT bundle, pos, size, hash, type_name, greatest(0, {MOVED}) AS gpu_offset FROM assets WHERE size > 0), lengths AS (SELECT bundle, max(gpu_offset + size) + CASE WHEN length(bundle) = 5 THEN 128 ELSE -100 END AS file_length FROM faulty GROUP BY bundle)"
REGIONS = f"{FAULTY}, regions AS (SELECT bundle, gpu_offset, size, min(pos) AS pos, count(*) AS n_entries FROM faulty GROUP BY ALL)"


def faulty(spark, sf_dir):
    return assets(spark, sf_dir).filter("size > 0").withColumn("gpu_offset", F.expr(f"greatest(0, {MOVED})"))


def lengths(entries):
    return entries.groupBy("bundle").agg((F.max(F.col("gpu_offset") + F.col("size")) + F.when(F.length(F.first("bundle")) == 5, 128).otherwise(-100)).alias("file_length"))


def issue_sql(category: str, source: str, when: str, detail: str, pos: str = "pos") -> str:
    return f"SELECT bundle, '{category}' AS category, {pos} AS pos, CAST({detail} AS VARCHAR) AS detail FROM {source} WHERE {when}"


@query("verify_alignment", f"WITH {FAULTY} {issue_sql('alignment', 'faulty', 'gpu_offset % 64 <> 0', 'gpu_offset')}")
def verify_alignment(spark, sf_dir):
    return verify.check_alignment(faulty(spark, sf_dir))


@query("verify_bounds", f"WITH {FAULTY} {issue_sql('bounds', 'faulty JOIN lengths USING (bundle)', 'gpu_offset + size > file_length', 'gpu_offset + size - file_length')}")
def verify_bounds(spark, sf_dir):
    e = faulty(spark, sf_dir)
    return verify.check_bounds(e, lengths(e))


BEFORE = "lag(gpu_offset + size) OVER (PARTITION BY bundle ORDER BY gpu_offset, pos)"
STRICT = "max(gpu_offset + size) OVER (PARTITION BY bundle ORDER BY gpu_offset, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("verify_overlap", f"WITH {REGIONS}, w AS (SELECT *, {BEFORE} AS before FROM regions) {issue_sql('overlap', 'w', 'gpu_offset < before', 'before - gpu_offset')}")
def verify_overlap(spark, sf_dir):
    return verify.check_overlap(faulty(spark, sf_dir))


@query("verify_overlap_strict", f"WITH {REGIONS}, w AS (SELECT *, {STRICT} AS before FROM regions) {issue_sql('overlap', 'w', 'gpu_offset < before', 'before - gpu_offset')}")
def verify_overlap_strict(spark, sf_dir):
    return verify.check_overlap(faulty(spark, sf_dir), strict=True)


@query("verify_slack", f"WITH {REGIONS}, ends AS (SELECT bundle, arg_max(gpu_offset + size, gpu_offset * 1000000000 + pos) AS last_end FROM regions GROUP BY bundle) {issue_sql('slack', 'ends JOIN lengths USING (bundle)', 'file_length - last_end >= 64', 'file_length - last_end', 'CAST(NULL AS BIGINT)')}")
def verify_slack(spark, sf_dir):
    e = faulty(spark, sf_dir)
    return verify.check_slack(e, lengths(e))


@query("verify_report", f"WITH {REGIONS}, r AS (SELECT bundle, count(*) AS n_regions, CAST(sum(n_entries) - count(*) AS BIGINT) AS n_aliased, CAST(sum(size) AS BIGINT) AS covered FROM regions GROUP BY bundle) SELECT bundle, n_regions, n_aliased, covered, file_length - covered AS padding FROM r JOIN lengths USING (bundle)")
def verify_report(spark, sf_dir):
    e = faulty(spark, sf_dir)
    return verify.report(e, lengths(e))


def _header_columns(d) -> list[str]:
    """What the headers of textures say, with planted faults."""
    return ["*", f"coalesce({d.surface('format', 'w', 'h')}, 0) + CASE WHEN pos % 29 = 3 THEN 16 ELSE 0 END AS linear_size", f"CASE WHEN {formats.is_block('format')} AND pos % 31 <> 4 THEN CAST(528391 AS BIGINT) ELSE CAST(4111 AS BIGINT) END AS flags"]


HEADERS = f"{TEXTURES}, headers AS (SELECT {', '.join(_header_columns(DUCK))} FROM textures), sized AS (SELECT *, {checking.total(checking.own_chain())} AS expected, {checking.surface('w', 'h')} AS level0, {formats.is_block('format')} AND mips <= 1 AS single FROM headers WHERE {formats.is_sizable('format')} AND has_dx10 AND stream_size = 0)"


def headers(spark, sf_dir):
    return textures(spark, sf_dir).selectExpr(*_header_columns(SPARK))


@query("verify_size", f"WITH {HEADERS} {issue_sql('texture-size', 'sized', 'expected <> gpu_size', 'gpu_size - expected')}")
def verify_size(spark, sf_dir):
    return verify.check_headers(headers(spark, sf_dir)).filter("category = 'texture-size'")


@query("verify_linear", f"WITH {HEADERS} {issue_sql('texture-linearsize', 'sized', 'single AND linear_size <> level0', 'linear_size - level0')} UNION ALL {issue_sql('texture-flags', 'sized', 'single AND (flags & 524288) = 0', 'flags')}")
def verify_linear(spark, sf_dir):
    return verify.check_headers(headers(spark, sf_dir)).filter("category <> 'texture-size'")


@query("verify_header", f"WITH {TEXTURES} {issue_sql('texture-header', 'textures', 'NOT has_dx10 OR gpu_size = 0', 'format')}")
def verify_header(spark, sf_dir):
    """Textures without a readable header or without data."""
    return verify.check_texture_headers(textures(spark, sf_dir), F.col("has_dx10"), F.col("format"))


#: Planted in streamed textures: a first level outside the chain, wrong sizes, offsets off alignment or past the file.
STREAM_FAULTS = [
    "CASE WHEN pos % 7 = 2 THEN mips ELSE first_resident END AS first_resident", "stream_size + CASE WHEN pos % 7 = 3 THEN 1 ELSE 0 END AS stream_size", "gpu_size + CASE WHEN pos % 7 = 4 THEN 4 ELSE 0 END AS gpu_size",
    "CASE WHEN pos % 7 = 5 THEN 32 ELSE 64 * (pos % 1000) END AS stream_offset", "64 * (pos % 1000) + stream_size - CASE WHEN pos % 7 = 6 THEN 10 ELSE 0 END AS stream_length",
]
STREAMED = f"{TEXTURES}, s AS (SELECT bundle, pos, w, h, format, mips, has_dx10, {', '.join(STREAM_FAULTS)} FROM textures WHERE stream_size > 0), c AS (SELECT *, {checking.own_chain()} AS chain, first_resident < greatest(mips, 1) AS inside FROM s WHERE {formats.is_sizable('format')} AND has_dx10), z AS (SELECT *, {checking.total('chain')} AS total, CASE WHEN inside THEN {checking.total('chain[first_resident + 1:]')} END AS tail FROM c)"


@query(
    "verify_streamed",
    f"WITH {STREAMED} "
    + " UNION ALL ".join((
        issue_sql("stream-resident", "z", "NOT inside", "first_resident"), issue_sql("stream-size", "z", "inside AND stream_size <> total", "stream_size - total"),
        issue_sql("stream-resident-size", "z", "inside AND gpu_size <> tail", "gpu_size - tail"), issue_sql("stream-alignment", "z", "inside AND stream_offset % 64 <> 0", "stream_offset"),
        issue_sql("stream-bounds", "z", "inside AND stream_offset + stream_size > stream_length", "stream_offset + stream_size - stream_length"),
    )),
)
def verify_streamed(spark, sf_dir):
    s = textures(spark, sf_dir).filter("stream_size > 0").selectExpr("bundle", "pos", "w", "h", "format", "mips", "has_dx10", *STREAM_FAULTS)
    return verify.check_streamed(s)


#: Planted in the level tables of streamed textures: a wrong size, a wrong offset, a missing level.
TABLE_FAULTS = {"level_size": "level_size + CASE WHEN pos % 11 = 3 AND level >= 2 THEN 4 ELSE 0 END", "next_offset": "next_offset + CASE WHEN pos % 13 = 4 AND level = 1 THEN 16 ELSE 0 END"}
LOST_LEVEL = "pos % 17 = 5 AND level = 3"
STREAM_TABLES = f"""{TEXTURES}, st AS (SELECT bundle, pos, w, h, format, mips FROM textures WHERE stream_size > 0 AND has_dx10 AND {formats.is_sizable('format')}),
lv AS (SELECT bundle, pos, mips, w, h, format, unnest(range(0, mips)) AS level FROM st),
sz AS (SELECT *, {checking.surface('greatest(1, w >> CAST(level AS INT))', 'greatest(1, h >> CAST(level AS INT))')} AS level_size FROM lv),
ok AS (SELECT *, CASE WHEN level = mips - 1 THEN 0 ELSE CAST(sum(level_size) OVER (PARTITION BY bundle, pos ORDER BY level) AS BIGINT) END AS next_offset FROM sz),
bad AS (SELECT bundle, pos, level FROM ok WHERE {LOST_LEVEL} OR level_size <> {TABLE_FAULTS['level_size']} OR next_offset <> {TABLE_FAULTS['next_offset']})"""


@query("verify_stream_table", f"WITH {STREAM_TABLES} SELECT bundle, 'stream-table' AS category, pos, CAST(min(level) AS VARCHAR) AS detail FROM bad GROUP BY bundle, pos")
def verify_stream_table(spark, sf_dir):
    """The first bad level of streamed textures whose level table is wrong."""
    t = textures(spark, sf_dir).filter("stream_size > 0")
    read = layout.level_table(t.filter(F.expr(formats.is_sizable("format")) & F.col("has_dx10"))).withColumns({c: F.expr(x) for c, x in TABLE_FAULTS.items()}).filter(f"NOT ({LOST_LEVEL})")
    return verify.check_stream_tables(t, read)


#: Entries of listed bundles: every one has a payload in the first companion, some have one in the second.
@query("verify_missing_file", f"WITH {FILES}, b AS (SELECT path AS bundle, size % 2 = 0 AS streamed FROM files WHERE path LIKE '%.patch_0'), w AS (SELECT bundle, '.gpu_resources' AS detail FROM b UNION ALL SELECT bundle, '.stream' FROM b WHERE streamed) SELECT bundle, 'missing-file' AS category, CAST(NULL AS BIGINT) AS pos, detail FROM w WHERE bundle || detail NOT IN (SELECT path FROM files)")
def verify_missing_file(spark, sf_dir):
    listed = files(spark, sf_dir)
    entries = listed.filter("path LIKE '%.patch_0'").select(F.col("path").alias("bundle"), F.lit(1).alias("gpu_size"), F.when(F.col("size") % 2 == 0, 1).otherwise(0).alias("stream_size"))
    return verify.check_files(entries, listed)


BEFORE_COLUMNS = ["bundle", "pos", "type_name", "pos + 4096 AS file_id", "pos * 340 AS cpu_offset", "CAST(340 AS BIGINT) AS cpu_size", "pos * 7 AS prefix_id", "size", "hash"]
#: Planted in the rewritten bundle: changed ids, moved CPU payloads, lost prefix ids, changed sizes and data, a lost entry.
AFTER_COLUMNS = [
    "bundle", "pos", "type_name", "pos + 4096 + CASE WHEN pos % 53 = 1 THEN 1 ELSE 0 END AS file_id", "pos * 340 + CASE WHEN pos % 59 = 2 THEN 16 ELSE 0 END AS cpu_offset", "CAST(340 AS BIGINT) AS cpu_size",
    "CASE WHEN pos % 61 = 3 THEN 0 ELSE pos * 7 END AS prefix_id", "size + CASE WHEN pos % 67 = 4 THEN 64 ELSE 0 END AS size", "CASE WHEN pos % 71 = 5 THEN 'changed' ELSE hash END AS hash",
]
LOST = "bundle <> 'src2' OR pos % 10 <> 2"
VERSIONS = f"""{ASSETS}, b AS (SELECT {', '.join(BEFORE_COLUMNS)} FROM assets), a AS (SELECT {', '.join(AFTER_COLUMNS)} FROM assets WHERE {LOST}),
nb AS (SELECT bundle, count(*) AS nb FROM b GROUP BY bundle), na AS (SELECT bundle, count(*) AS na FROM a GROUP BY bundle),
counts AS (SELECT nb.bundle, nb, coalesce(na, 0) AS na FROM nb LEFT JOIN na USING (bundle)),
z AS (SELECT b.bundle, b.pos, b.file_id = a.file_id AND b.type_name = a.type_name AS same, a.type_name, a.file_id, a.cpu_offset, b.cpu_offset <> a.cpu_offset OR b.cpu_size <> a.cpu_size AS moved,
  a.prefix_id, b.prefix_id <> a.prefix_id AS lost_prefix, a.size, b.size AS b_size, a.hash, b.hash AS b_hash FROM b JOIN a USING (bundle, pos) JOIN counts c ON c.bundle = b.bundle AND c.nb = c.na)"""
PLAIN = "same AND type_name <> 'texture' AND size > 0"


def versions(spark, sf_dir):
    from assetspark.bindings import asset_rows

    a = asset_rows(spark, sf_dir)
    return a.selectExpr(*BEFORE_COLUMNS), a.filter(LOST).selectExpr(*AFTER_COLUMNS)


@query(
    "verify_vs_original",
    f"WITH {VERSIONS} "
    + " UNION ALL ".join((
        issue_sql("entry-count", "counts", "nb <> na", "na - nb", "CAST(NULL AS BIGINT)"), issue_sql("entry-identity", "z", "NOT same", "file_id"), issue_sql("cpu-payload", "z", "same AND moved", "cpu_offset"),
        issue_sql("texture-prefix", "z", "same AND type_name = 'texture' AND lost_prefix", "prefix_id"), issue_sql("passthrough-size", "z", f"{PLAIN} AND size <> b_size", "size - b_size"), issue_sql("passthrough-data", "z", f"{PLAIN} AND size = b_size AND hash <> b_hash", "hash"),
    )),
)
def verify_vs_original(spark, sf_dir):
    return verify.compare(*versions(spark, sf_dir))


@query("verify_zip", f"WITH {VERSIONS} SELECT bundle, pos, b.size AS before_size, a.size AS after_size, coalesce(b.hash = a.hash, false) AS equal FROM b FULL OUTER JOIN a USING (bundle, pos)")
def verify_zip(spark, sf_dir):
    b, a = versions(spark, sf_dir)
    z = b.select("bundle", "pos", F.col("size").alias("before_size"), F.col("hash").alias("bh")).join(a.select("bundle", "pos", F.col("size").alias("after_size"), F.col("hash").alias("ah")), ["bundle", "pos"], "full_outer")
    return z.select("bundle", "pos", "before_size", "after_size", F.coalesce(F.col("bh") == F.col("ah"), F.lit(False)).alias("equal"))


@query("refresh_changes", f"WITH {VERSIONS} SELECT bundle, pos, b.size AS was, a.size AS now FROM b JOIN a USING (bundle, pos) WHERE b.size IS DISTINCT FROM a.size")
def refresh_changes(spark, sf_dir):
    """Only what a second listing shows changed."""
    b, a = versions(spark, sf_dir)
    z = b.select("bundle", "pos", F.col("size").alias("was")).join(a.select("bundle", "pos", F.col("size").alias("now")), ["bundle", "pos"])
    return z.filter(~F.col("was").eqNullSafe(F.col("now")))
