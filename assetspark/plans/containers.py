"""Containers written from the tables and read back: entries, payloads within bounds and past the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspark.bindings import ASSETS, TYPES, read
from assetspark.functions.dialect import DUCK
from assetspark.operators import ranges
from assetspark.plans.registry import query
from assetspark.sources import listing
from assetspark.sources.compose import compose
from assetspark.sources.container import TYPE_NAMES, entries_at, with_payloads
from assetspark.sources.shared import local_path, place
from assetspark.sources.synthetic import texture_header

_IDS = {name: number - (1 << 64 if number >> 63 else 0) for number, name in TYPE_NAMES.items()}
_WIDTH = 16


def written(spark, sf_dir: str) -> tuple[DataFrame, str]:
    """(the entries of containers of all documents, a container for each source, their folder), read from the files.

    The payload of an entry is its text; textures have a header whose width is that of their text's first WIDTH bytes.
    """
    folder = local_path(place(spark, "containers"))
    kind = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in TYPES.items()), F.lit("unit"))
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("library/"), "source", F.lit(".patch_0")).alias("bundle"), F.col("doc_id").alias("pos"), kind.alias("kind"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    number = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v).cast("long")) for k, v in _IDS.items()))
    cpu = F.when(F.col("kind") == "texture", F.lit(texture_header(_WIDTH, 4, 98, prefix_id=7))).otherwise(F.lit(bytes(8)))
    compose(docs.select("bundle", "pos", F.col("pos").alias("file_id"), number.alias("type_id"), cpu.alias("cpu"), "payload"), folder)
    bundles = listing.discover(spark, folder)[0].select(F.col("path").alias("bundle"))
    entries, errors = entries_at(bundles.repartition(spark.sparkContext.defaultParallelism, "bundle"))
    if bad := errors.first():
        raise ValueError(f"{bad['bundle']}: {bad['error']}")
    return entries, folder


def _source(folder: str):
    return F.expr(f"substring(bundle, {len(folder) + len('/library/') + 1}, length(bundle) - {len(folder) + len('/library/') + len('.patch_0')})")


#: The documents as they stand in their containers.
LAID = f"""raw AS (SELECT source AS bundle, doc_id, CASE WHEN lang IN ({', '.join(f"'{k}'" for k in TYPES)}) THEN CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())} END ELSE 'unit' END AS type_name, coalesce(text, '') AS t FROM documents),
sized AS (SELECT *, CAST(strlen(t) AS BIGINT) AS gpu_size, CASE WHEN type_name = 'texture' THEN 340 ELSE 8 END AS cpu_size FROM raw),
laid AS (
  SELECT *, row_number() OVER w - 1 AS pos, CAST(coalesce(sum({DUCK.align('gpu_size')}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gpu_offset,
    72 + 32 * n_types + 80 * n_files + CAST(coalesce(sum(cpu_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cpu_offset
  FROM sized JOIN (SELECT bundle, count(*) AS n_files, count(DISTINCT type_name) AS n_types FROM sized GROUP BY bundle) USING (bundle) WINDOW w AS (PARTITION BY bundle ORDER BY doc_id))"""


@query("container_entries", f"WITH {LAID} SELECT bundle, pos, upper(format('{{:016x}}', doc_id)) AS name, type_name, cpu_offset, CAST(cpu_size AS BIGINT) AS cpu_size, gpu_offset, gpu_size, CASE WHEN type_name = 'texture' THEN CAST({_WIDTH} AS BIGINT) END AS w, CASE WHEN type_name = 'texture' THEN CAST(98 AS BIGINT) END AS format, CASE WHEN type_name = 'texture' THEN CAST(7 AS BIGINT) END AS prefix_id FROM laid")
def container_entries(spark, sf_dir):
    """Tables and headers, decoded from files that were composed of the documents."""
    entries, folder = written(spark, sf_dir)
    return entries.select(_source(folder).alias("bundle"), "pos", "name", "type_name", "cpu_offset", "cpu_size", "gpu_offset", "gpu_size", "w", "format", "prefix_id")


_MORE = "CASE WHEN pos % 5 = 0 THEN 1000000000 ELSE 0 END"


@query(
    "container_payloads",
    f"""WITH {LAID}, ends AS (SELECT bundle, max(gpu_offset + gpu_size) AS file_length FROM laid GROUP BY bundle), asked AS (SELECT *, gpu_size + {_MORE} AS asked FROM laid JOIN ends USING (bundle))
SELECT bundle, pos, CASE WHEN pos % 5 <> 0 THEN upper(sha256(t)) END AS payload_sha256, CASE WHEN pos % 5 = 0 THEN concat('read past end: ', CAST(asked - (file_length - gpu_offset) AS VARCHAR), ' of ', CAST(asked AS VARCHAR), ' bytes at ', CAST(gpu_offset AS VARCHAR), ' are missing') END AS problem FROM asked""",
)
def container_payloads(spark, sf_dir):
    """Payloads read by range; every fifth is asked for past the end of its file, which is told in its row."""
    entries, folder = written(spark, sf_dir)
    dealt = entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bundle", ranges.bucket_of("gpu_offset"))  # a bundle's payloads are read by many tasks
    asked = with_payloads(dealt.withColumn("gpu_size", F.col("gpu_size") + F.expr(_MORE)), at_once=ranges.BYTES)
    return asked.select(_source(folder).alias("bundle"), "pos", F.upper(F.sha2("payload", 256)).alias("payload_sha256"), F.col("payload_error").alias("problem"))
