"""Discovery of bundles in a listing of files, and the tree of their folders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetspark.bindings import FILES, files
from assetspark.operators import discovery
from assetspark.plans.registry import query
from assetspark.sources.shared import stored

PARTS = f"""{FILES},
split AS (SELECT path, size, list_filter(string_split(path, '/')[:-2], lambda x: x <> '') AS folders, string_split(path, '/')[-1] AS file_name FROM files),
kept AS (SELECT * FROM split WHERE len(list_filter(folders, lambda x: lower(x) = 'backup')) = 0),
found AS (SELECT k.* FROM kept k WHERE NOT lower(k.path) LIKE '%.gpu_resources' AND NOT lower(k.path) LIKE '%.stream' AND EXISTS (SELECT 1 FROM files f WHERE f.path = k.path || '.gpu_resources')),
bundles AS (SELECT b.path, CASE WHEN len(b.folders) > 0 THEN b.folders[-1] ELSE b.file_name END AS mod_name, b.file_name, b.folders, coalesce(g.size, 0) AS gpu_size, coalesce(s.size, 0) AS stream_size
  FROM found b LEFT JOIN files g ON g.path = b.path || '.gpu_resources' LEFT JOIN files s ON s.path = b.path || '.stream')"""
NODES = f"""{PARTS}, each AS (SELECT unnest(list_transform(range(1, len(folders) + 1), lambda n: folders[1:n])) AS k, gpu_size, stream_size FROM bundles),
nodes AS (SELECT array_to_string(k, '/') AS key, k[-1] AS name, CASE WHEN len(k) > 1 THEN array_to_string(k[1:-2], '/') END AS parent, CAST(len(k) AS BIGINT) AS depth, count(*) AS n_bundles, CAST(sum(gpu_size + stream_size) AS BIGINT) AS bytes FROM each GROUP BY ALL)"""


@query("scan_prune_backup", f"WITH {PARTS} SELECT path, size FROM kept")
def scan_prune_backup(spark, sf_dir):
    return discovery.without_backups(files(spark, sf_dir))


@query("scan_companion_semi", f"WITH {PARTS} SELECT s.path, s.size FROM split s WHERE NOT lower(s.path) LIKE '%.gpu_resources' AND NOT lower(s.path) LIKE '%.stream' AND EXISTS (SELECT 1 FROM files f WHERE f.path = s.path || '.gpu_resources')")
def scan_companion_semi(spark, sf_dir):
    return discovery.candidates(files(spark, sf_dir))


def bundles(spark, sf_dir):
    return discovery.describe(files(spark, sf_dir))


@query("scan_bundles", f"WITH {PARTS} SELECT path, gpu_size, stream_size FROM bundles")
def scan_bundles(spark, sf_dir):
    return bundles(spark, sf_dir).select("path", "gpu_size", "stream_size")


@query("scan_describe", f"WITH {PARTS} SELECT path, mod_name, file_name, array_to_string(folders, '|') AS folders, gpu_size, stream_size FROM bundles")
def scan_describe(spark, sf_dir):
    return bundles(spark, sf_dir).select("path", "mod_name", "file_name", F.array_join("relative_folders", "|").alias("folders"), "gpu_size", "stream_size")


@query("scan_folders", f"WITH {PARTS} SELECT path, array_to_string(folders, '|') AS folders, CAST(len(folders) AS BIGINT) AS depth FROM split")
def scan_folders(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.array_join(discovery.folders(), "|").alias("folders"), F.size(discovery.folders()).cast("long").alias("depth"))


@query("scan_order", f"WITH {PARTS} SELECT path, row_number() OVER (ORDER BY upper(array_to_string(folders, '/')), upper(file_name), path) AS k FROM bundles")
def scan_order(spark, sf_dir):
    """Places in reading order, from places within ranges of an ordered listing and the sizes of the ranges before."""
    order = {"o1": F.upper(F.array_join("relative_folders", "/")), "o2": F.upper("file_name")}
    # Kept as a table: range bounds are sampled, and both readers must see the same.
    ranged = stored(bundles(spark, sf_dir).select("path", *(c.alias(n) for n, c in order.items())).repartitionByRange("o1", "o2", "path").withColumn("part", F.spark_partition_id()), "order")
    inside = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("o1", "o2", "path")))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("part", "before")), "part").select("path", (F.col("k") + F.col("before")).alias("k"))


@query("tree_nodes", f"WITH {NODES} SELECT key, name, parent, depth, n_bundles FROM nodes")
def tree_nodes(spark, sf_dir):
    return discovery.tree_nodes(bundles(spark, sf_dir)).drop("bytes")


@query("tree_rollup", f"WITH {NODES} SELECT key, depth, n_bundles, bytes FROM nodes")
def tree_rollup(spark, sf_dir):
    return discovery.tree_nodes(bundles(spark, sf_dir)).select("key", "depth", "n_bundles", "bytes")


ABSORB = f"""{NODES}, own AS (SELECT *, array_to_string(folders, '/') AS key FROM bundles), direct AS (SELECT key, count(*) AS n_direct FROM own GROUP BY key),
inner_folders AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
lines AS (SELECT o.*, d.n_direct = 1 AND i.n IS NULL AND len(o.folders) > 0 AS absorbed FROM own o JOIN direct d USING (key) LEFT JOIN inner_folders i USING (key)),
titled AS (SELECT path, absorbed, CASE WHEN absorbed THEN folders[-1] ELSE file_name END AS title, CASE WHEN absorbed AND len(folders) = 1 THEN NULL ELSE folders[1] END AS owner FROM lines)"""


@query("tree_absorb", f"WITH {ABSORB} SELECT path, absorbed, title FROM titled")
def tree_absorb(spark, sf_dir):
    return discovery.absorbed(bundles(spark, sf_dir)).select("path", "absorbed", "title")


@query("mod_attribution", f"WITH {ABSORB} SELECT path, coalesce(owner, title) AS mod_title, CASE WHEN owner IS NULL THEN '' ELSE title END AS mod_detail, CASE WHEN owner IS NULL THEN title ELSE concat(owner, ' > ', title) END AS tooltip FROM titled")
def mod_attribution(spark, sf_dir):
    t = discovery.absorbed(bundles(spark, sf_dir))
    own = F.col("owner").isNull()
    return t.select("path", F.coalesce("owner", "title").alias("mod_title"), F.when(own, "").otherwise(F.col("title")).alias("mod_detail"), F.when(own, F.col("title")).otherwise(F.concat("owner", F.lit(" > "), "title")).alias("tooltip"))


TICKED = "gpu_size % 3 <> 0"


@query("tri_state", f"WITH {PARTS}, t AS (SELECT *, {TICKED} AS ticked FROM bundles), each AS (SELECT unnest(list_transform(range(1, len(folders) + 1), lambda n: array_to_string(folders[1:n], '/'))) AS key, ticked FROM t) SELECT key, CASE WHEN bool_and(ticked) THEN 'all' WHEN NOT bool_or(ticked) THEN 'none' ELSE 'some' END AS state FROM each GROUP BY key")
def tri_state(spark, sf_dir):
    return discovery.tick_states(bundles(spark, sf_dir).withColumn("ticked", F.expr(TICKED)))


@query("tick_propagate", f"WITH {NODES}, chosen AS (SELECT key FROM nodes WHERE depth = 1 AND n_bundles % 2 = 0) SELECT b.path, EXISTS (SELECT 1 FROM chosen c WHERE c.key = b.folders[1]) AS ticked FROM bundles b")
def tick_propagate(spark, sf_dir):
    """A tick on a folder ticks all that is below it; here on the top folders with an even number of bundles."""
    b = bundles(spark, sf_dir)
    chosen = discovery.tree_nodes(b).filter("depth = 1 AND n_bundles % 2 = 0").select(F.col("key").alias("top"), F.lit(True).alias("on"))
    return b.withColumn("top", F.get("relative_folders", F.lit(0))).join(chosen, "top", "left").select("path", F.coalesce("on", F.lit(False)).alias("ticked"))


@query("name_contains", f"WITH {PARTS} SELECT path FROM bundles WHERE contains(lower(mod_name), '7') OR contains(lower(path), 'blog')")
def name_contains(spark, sf_dir):
    return bundles(spark, sf_dir).filter(F.contains(F.lower("mod_name"), F.lit("7")) | F.contains(F.lower("path"), F.lit("blog"))).select("path")
