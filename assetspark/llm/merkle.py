"""A Merkle manifest of a table of documents, with an inclusion proof for each row.

Each row is a leaf; the leaves of a language, by doc_id, are hashed together two by two until one node, the subroot, is
left, and the subroots likewise give the root. A row's rank within its language is cut into digits: the lowest ones
tell its place within a block of SPAN leaves, the rest tell the block. Each digit is grouped away in turn, a group's
children nested as structs in its row together with the levels of nodes between them, so a block ends as one row of
bounded size that holds all that its proofs need. One transform over the nested structs, exploded, emits the proofs of
all its leaves. The nodes of blocks are the leaves of the next, SPAN times smaller manifest; only a row for each block
meets its path there, leaves meet nothing.

Ranks come from one range partitioning: a sorted partition numbers its rows, and the rows of a language before a
partition are summed over one row for each partition and language.

Null fields are leaves' fields too. Rows without doc_id come first in their language; rows that share a doc_id follow
each other by leaf; equal rows have equal leaves and a place each. Rows without lang are a language of their own, the
first. One row alone is its language's subroot, and one language's subroot the root; such a proof is empty. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetspark.llm.common import partitions, stored

#: Binary digits of the rank that one grouping takes away, and groupings of a block.
BITS, DIGITS = 4, 2
SPAN = 1 << (BITS * DIGITS)
#: Paths of so many blocks or languages may be broadcast.
BROADCAST_PATHS = 20_000
STEP = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field as hashed: its length in bytes and itself, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(n_chars: Column | None = None) -> Column:
    parts = (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text"))
    return F.sha2(F.concat(*map(field, parts)), 256)


def ranked(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with rank, from 0 within each value of by, and n, the rows of that value. No group needs to fit a task."""
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), by, *order, "tie")
    placed = stored(spread.sortWithinPartitions(by, *order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    placed = placed.select("*", part.alias("part"), within.alias("within"))
    held = placed.groupBy(by, "part").agg(F.count("*").alias("held"), F.min("within").alias("first"))
    parts = Window.partitionBy(by).orderBy("part")  # a row for each partition
    before = F.coalesce(F.sum("held").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(held.select(by, "part", (before - F.col("first")).alias("start"), F.sum("held").over(Window.partitionBy(by)).alias("n")), "starts")
    return placed.join(lookup(starts), [by, "part"]).withColumn("rank", F.col("within") + F.col("start")).drop("at", "part", "within", "start")


def lookup(df: DataFrame) -> DataFrame:
    """df broadcast if it has few rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS else df


def level_above(level: Column, several: Column) -> Column:
    """The nodes above those of a level: every two become one, and a last one alone too. A level of one node in all stays."""
    pair = lambda j: F.sha2(F.concat(F.get(level, 2 * j), F.coalesce(F.get(level, 2 * j + 1), F.lit(""))), 256)
    return F.when(several, F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)).otherwise(level)


def levels(df: DataFrame, nodes: Column, base: int) -> DataFrame:
    """df with l0, l1, ...: the nodes of a group's children, BITS levels between them and the group's own, and hash."""
    df = df.withColumn("l0", nodes)
    for i in range(BITS):
        df = df.withColumn(f"l{i + 1}", level_above(F.col(f"l{i}"), F.col("n") > (1 << (base + i))))
    return df.withColumn("hash", F.get(f"l{BITS}", F.lit(0))).drop(f"l{BITS}")


def steps(digit: Column, held: list[Column], n: Column, base: int) -> Column:
    """What stands before and after the node of a child at each level of its group: nodes or nothing."""

    def step(i: int) -> Column:
        place = F.shiftright(digit, i)
        odd = place % 2 == 1
        before = F.when(odd, F.get(held[i], place - 1)).otherwise(F.lit(""))
        after = F.when(odd, F.lit("")).otherwise(F.coalesce(F.get(held[i], place + 1), F.lit("")))
        return F.when(n > (1 << (base + i)), F.struct(before.alias("before"), after.alias("after")))

    return F.filter(F.array(*map(step, range(BITS))), lambda s: s.isNotNull())


def blocks_of(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """group, n, block, hash, kids, l0, l1, ...: nodes (group, n, rank, hash, payload) rolled up into a row for each block."""
    digits = [F.shiftright("rank", BITS * i).bitwiseAND((1 << BITS) - 1).cast("int").alias(f"d{i}") for i in range(DIGITS)]
    rows = nodes.select("group", "n", F.shiftright("rank", BITS * DIGITS).alias("block"), *digits, "hash", F.struct(*payload).alias("held"))
    rows = rows.repartition("group", "block")  # all groupings below keep this partitioning
    kid = ["d0", "hash", "held"]
    for i in range(DIGITS):
        left = ["group", "n", "block", *(f"d{j}" for j in range(i + 1, DIGITS))]
        rolled = rows.groupBy(*left).agg(F.sort_array(F.collect_list(F.struct(*kid))).alias("kids"))
        rows = levels(rolled, F.col("kids.hash"), BITS * i)
        kid = [f"d{i + 1}", "hash", *(f"l{j}" for j in range(BITS)), "kids"]
    return rows


def unrolled(n: Column, above: Column):
    """kids of a block -> an array of (held, steps) of its leaves: a nested transform, one level for each digit."""

    def walk(kids: Column, held: list[Column], i: int, path: Column) -> Column:
        def visit(kid: Column) -> Column:
            longer = F.concat(steps(kid[f"d{i}"], held, n, BITS * i), path)
            if i == 0:
                return F.struct(kid["held"].alias("held"), longer.alias("steps"))
            return walk(kid["kids"], [kid[f"l{j}"] for j in range(BITS)], i - 1, longer)

        each = F.transform(kids, visit)
        return each if i == 0 else F.flatten(each)

    return walk(F.col("kids"), [F.col(f"l{j}") for j in range(BITS)], DIGITS - 1, above)


def proofs(nodes: DataFrame, most: int, payload: list[str], top: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(group, payload, steps, root of each node; group, root): nodes (group, n, rank, hash, payload), n being at most `most`.

    top: group, above, root: where the path goes on from a group's root.
    """
    blocks = stored(blocks_of(nodes, payload), "blocks")
    if most > SPAN:
        below = blocks.select("group", F.ceil(F.col("n") / SPAN).alias("n"), F.col("block").alias("rank"), "hash", "block")
        paths, roots = proofs(below, -(-most // SPAN), ["block"])
        paths = stored(paths.select("group", "block", F.col("steps").alias("above"), "root"), "paths")
        blocks = blocks.join(lookup(paths), ["group", "block"])
    else:
        blocks = blocks.withColumns({"above": F.array().cast(STEP), "root": F.col("hash")})
        roots = blocks.select("group", "root")
    each = blocks.select("group", "root", F.explode(unrolled(F.col("n"), F.col("above"))).alias("leaf"))
    return each.select("group", *(F.col(f"leaf.held.{c}").alias(c) for c in payload), F.col("leaf.steps").alias("steps"), "root"), roots


def most_of(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def tree(leaves: DataFrame, by: str, order: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """A tree for each value of the string column `by`: (group, payload, steps, root of each leaf; group, root). Leaves hold a column hash."""
    nodes = ranked(leaves.withColumnRenamed(by, "group"), "group", *order)
    return proofs(nodes, most_of(nodes), payload)


def manifest(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, altered, below, above: the manifest of documents.

    below and above: the steps from the leaf to its subroot and from there to the root, each with the siblings before
    and after. altered: the leaf with `changed` in place of n_chars where `tampered` holds, else null.
    """
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))  # null first, then by bytes
    altered = F.when(tampered & changed.isNotNull(), leaf_hash(changed))
    leaves = stored(docs.select(group.alias("lang"), "doc_id", leaf_hash().alias("hash"), altered.alias("altered")), "leaves").withColumn("leaf", F.col("hash"))
    below, roots = tree(leaves, "lang", ["doc_id", "hash"], ["doc_id", "leaf", "altered"])
    subroots = stored(roots.select(F.col("group").alias("lang"), F.col("root").alias("hash")).withColumn("all", F.lit("")), "subroots")
    tops, _ = tree(subroots, "all", ["lang"], ["lang"])
    tops = stored(tops.select("lang", F.col("steps").alias("above"), F.col("root").alias("top")), "tops")
    return below.join(lookup(tops), F.col("group") == F.col("lang")).select("doc_id", "leaf", F.col("root").alias("subroot"), F.col("top").alias("root"), "altered", F.col("steps").alias("below"), "above")


def siblings(*paths: str) -> Column:
    """The siblings of a path as one text, level by level and left to right."""
    return F.array_join(F.transform(F.concat(*paths), lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, *paths: str) -> Column:
    """The root that a leaf has with the siblings of a path."""
    return reduce(lambda node, path: F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256)), paths, leaf)


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; those whose crc32 of doc_id 7 divides are tampered with."""
    found = manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    root = folded(F.coalesce("altered", "leaf"), "below", "above")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("below", "above"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
