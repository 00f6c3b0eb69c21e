"""Assets, textures, surfaces and folders read off the given tables: the same relation for Spark and in SQL.

Each binding is deterministic and derived row by row from a whole table, so queries over it grow with that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspark.functions.dialect import DUCK, SPARK, Dialect
from assetspark.operators import ranges

NOT_STREAMED = 4294967295


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What an entry is, by the language of its text.
TYPES = {"en": "texture", "fr": "material", "de": "unit", "es": "bones"}


def asset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of bundles: bundle, pos, size, hash, type_name."""
    kind = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in TYPES.items()), F.col("lang"))
    return read(spark, sf_dir, "documents").select(F.col("source").alias("bundle"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"), F.upper(F.sha2("text", 256)).alias("hash"), kind.alias("type_name"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_rows with gpu_offset, as they were laid out."""
    return ranges.sum_before(asset_rows(spark, sf_dir), ["bundle"], ["pos"], F.expr(SPARK.align("size")), "gpu_offset")


ASSETS = f"""assets AS (
  SELECT source AS bundle, doc_id AS pos, n_chars AS size, upper(sha256(text)) AS hash,
         CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())} ELSE lang END AS type_name,
         CAST(coalesce(sum({DUCK.align('n_chars')}) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gpu_offset
  FROM documents)"""


def _texture_steps(d: Dialect) -> list[list[str]]:
    """Columns of the textures binding, in layers of which each reads the one before."""
    fmt = "CASE WHEN p_partkey % 97 = 13 THEN 0 WHEN p_partkey % 41 = 5 THEN 95 WHEN p_partkey % 43 = 6 THEN 61 ELSE CASE p_type WHEN 'ECONOMY' THEN 28 WHEN 'STANDARD' THEN 29 WHEN 'PROMO' THEN 87 WHEN 'SMALL' THEN 71 WHEN 'MEDIUM' THEN 98 ELSE 99 END END"
    side = d.each("0", "12", "i", "CAST(pow(2, i) AS BIGINT)")
    nth = f"element_at({side}, CAST(5 + p_size % 9 AS INT))" if d.name == "spark" else f"({side})[5 + p_size % 9]"
    first = [
        "p_brand AS bundle", "p_partkey AS pos", "p_partkey", f"{nth} + CASE WHEN p_partkey % 47 = 8 THEN 2 ELSE 0 END AS w",
        f"CAST({fmt} AS BIGINT) AS format", "p_partkey % 500 AS vec_id", "p_partkey % 97 <> 13 AS has_dx10",
    ]
    second = ["*", f"CASE WHEN p_partkey % 4 = 0 THEN greatest(4, {d.div('w', '2')}) ELSE w END AS h"]
    third = ["*", f"CASE WHEN p_partkey % 3 = 0 THEN {d.bits('greatest(w, h)')} ELSE CAST(1 AS BIGINT) END AS mips"]
    fourth = ["*", f"CASE WHEN format = 0 THEN NULL ELSE {d.chain('format', 'w', 'h', 'mips')} END AS chain", "p_partkey % 50 = 11 AND mips > 2 AS streamed"]
    fifth = [
        "bundle", "pos", "w", "h", "format", "mips", "vec_id", "has_dx10",
        f"CASE WHEN format = 0 THEN w * h WHEN streamed THEN {d.total(d.cut('chain', '2'))} ELSE {d.total('chain')} + CASE WHEN p_partkey % 50 = 7 THEN 64 ELSE 0 END END AS gpu_size",
        f"CASE WHEN streamed AND format <> 0 THEN {d.total('chain')} ELSE CAST(0 AS BIGINT) END AS stream_size",
        f"CASE WHEN streamed AND format <> 0 THEN CAST(2 AS BIGINT) ELSE {NOT_STREAMED} END AS first_resident",
    ]
    return [first, second, third, fourth, fifth]


def textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures of bundles: bundle, pos, w, h, format, mips, vec_id (their surface), has_dx10, gpu_size, stream_size, first_resident."""
    df = read(spark, sf_dir, "part")
    for step in _texture_steps(SPARK):
        df = df.selectExpr(*step)
    return df


def layered(name: str, source: str, steps: list[list[str]]) -> str:
    """Common table expressions, one for each layer of columns; the last is called name."""
    out = []
    for i, step in enumerate(steps):
        this = name if i == len(steps) - 1 else f"{name}_{i}"
        out.append(f"{this} AS (SELECT {', '.join(step)} FROM {source})")
        source = this
    return ",\n".join(out)


TEXTURES = layered("textures", "part", _texture_steps(DUCK))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of 4x4 pixels: tex_id and v, 64 channel values, pixel by pixel and RGBA in each."""
    q = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 0.6) / 1.2, F.lit(0.0)), F.lit(1.0)) * 255).cast("long"))
    raw = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tex_id"), q.alias("q"))
    kind, alpha = F.col("tex_id") % 5, lambda i: i % 4 == 3
    value = lambda x, i: (
        F.when(kind == 0, F.get("q", i % 4)).when((kind == 1) & ~alpha(i), F.get("q", i % 4))
        .when((kind == 2) & alpha(i), F.lit(255).cast("long")).when((kind == 3) & alpha(i), F.when(x >= 128, 255).otherwise(0).cast("long")).otherwise(x)
    )
    return raw.select("tex_id", F.transform("q", value).alias("v"))


#: Surfaces as rows of channel values: tex_id, x, y, ch, v.
PIXELS = """q AS (
  SELECT vec_id AS tex_id, unnest(embedding) AS e, unnest(range(0, 64)) AS i FROM embeddings),
raw AS (
  SELECT tex_id, i, i % 4 AS ch, (i // 4) % 4 AS x, i // 16 AS y,
         CAST(floor(least(greatest((CAST(e AS DOUBLE) + 0.6) / 1.2, 0.0), 1.0) * 255) AS BIGINT) AS q FROM q),
base AS (SELECT tex_id, ch, q AS b FROM raw WHERE i < 4),
pixels AS (
  SELECT r.tex_id, r.x, r.y, r.ch,
         CASE WHEN r.tex_id % 5 = 0 THEN b WHEN r.tex_id % 5 = 1 AND r.ch <> 3 THEN b WHEN r.tex_id % 5 = 2 AND r.ch = 3 THEN 255
              WHEN r.tex_id % 5 = 3 AND r.ch = 3 THEN CASE WHEN q >= 128 THEN 255 ELSE 0 END ELSE q END AS v
  FROM raw r JOIN base ON base.tex_id = r.tex_id AND base.ch = r.ch)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing: path, size. Bundles, companions of two in three of them, some in backup folders."""
    page = read(spark, sf_dir, "pages").filter(F.col("url").isNotNull())
    rest = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    folders = F.filter(F.split(rest, "/"), lambda x: x != "")
    placed = F.when(F.col("page_id") % 7 == 0, F.concat(folders, F.array(F.lit("Backup")))).otherwise(folders)
    name = F.concat(F.array_join(placed, "/"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".patch_0"))
    b = page.select("page_id", name.alias("path"), F.length("html").cast("long").alias("size"))
    gpu = b.filter(F.col("page_id") % 3 != 0).select("page_id", F.concat("path", F.lit(".gpu_resources")).alias("path"), (F.col("size") * 2).alias("size"))
    stream = b.filter(F.col("page_id") % 6 == 1).select("page_id", F.concat("path", F.lit(".stream")).alias("path"), (F.col("size") * 3).alias("size"))
    return b.unionByName(gpu).unionByName(stream).select("path", "size")


FILES = r"""listed AS (
  SELECT page_id, length(html) AS size, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS f
  FROM pages WHERE url IS NOT NULL),
named AS (
  SELECT page_id, size, array_to_string(CASE WHEN page_id % 7 = 0 THEN list_append(f, 'Backup') ELSE f END, '/') || '/p' || CAST(page_id AS VARCHAR) || '.patch_0' AS path FROM listed),
files AS (
  SELECT path, size FROM named
  UNION ALL SELECT path || '.gpu_resources', size * 2 FROM named WHERE page_id % 3 <> 0
  UNION ALL SELECT path || '.stream', size * 3 FROM named WHERE page_id % 6 = 1)"""
