"""Exact top-k by inner product, best first through an M-tree.

Routing: the tree's inner nodes are split from a bounded sample of ROUTES vectors, FAN ways, until a node's share of
all vectors fits a page or MOST_LEAVES are reached. Every vector goes down to the nearest child; each node then covers
the vectors below it with a radius, and knows its distance to its parent. A leaf's vectors are paged by their stored
distance to its centre, so a page is a ring of nearly equal distances, however many a leaf has.

Search: for a query q at distance d from a node, every vector x below is at least d - radius away, at least the
distance of d from its ring, and one with stored distance p at least |d - p|; with |x|^2 that bounds the inner product
from above. A query starts from the k-th best of its own page. Nodes are visited from the root down; a child is passed
over by the stored distance to its parent before its own distance is computed. Queries travel in blocks of neighbours
to the leaves that any of them reaches, there visit the pages in the order of their bounds, and compute only the
vectors that may still enter.

Components are rounded to longs (beyond their range, to its ends). Scores are exact: products that double precision
may not hold are computed on whole numbers; sums beyond a long count as its ends. Vectors of different lengths meet as
if the shorter ended in zeros; empty vectors are zero. Null vectors, null or non-finite components and null ids take no
part. Every row counts: rows that repeat an id, or are equal, are candidates of one another and queries of their own. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetspark.llm.common import stored

ROUTES, MOST_LEAVES, FAN = 4096, 512, 8
PAGE = 1024
BLOCK = 1024
GROUP = 8
RINGS = 4096
SLACK = 1e-6
EXACT = float(1 << 53)
#: Scores beyond a long are ranked in parts of this unit.
UNIT = 10**30
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the integer vector, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite).select("vec_id", quantised(F.col("embedding")).alias("v"))


def _matrix(vectors, dim: int) -> np.ndarray:
    """Vectors as rows of longs, padded with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


@dataclass
class Tree:
    """Inner nodes and leaves, parents before children; the root is node 0. radius and norm are set once vectors are routed."""

    centre: np.ndarray
    parent: np.ndarray
    to_parent: np.ndarray
    children: list[list[int]]
    radius: np.ndarray | None = None
    norm: np.ndarray | None = None

    def route(self, x: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(rows of x, node, their distances to it) for each node that rows pass on their way to their leaves."""
        out, todo = [], [(0, np.arange(len(x)), np.sqrt(((x - self.centre[0]) ** 2).sum(1)))] if len(x) else []
        while todo:
            node, at, d = todo.pop()
            out.append((at, node, d))
            below = self.children[node]
            if below:
                each = _distances(x[at], self.centre[below])
                near = each.argmin(1)
                todo += [(child, at[near == i], each[near == i, i]) for i, child in enumerate(below) if (near == i).any()]
        return out

    def reached(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether each query may find at least its least score below each node: queries by nodes."""
        alive = np.zeros((len(q), len(self.centre)), bool)
        dist = np.zeros((len(q), len(self.centre)))
        qq = (q * q).sum(1)
        for node in range(len(self.centre)):
            at = np.arange(len(q)) if node == 0 else np.flatnonzero(alive[:, self.parent[node]])
            if node:  # by the stored distance of the two centres, before any new distance
                gap = np.abs(dist[at, self.parent[node]] - self.to_parent[node]) - self.radius[node]
                at = at[_may(qq[at], self.norm[node], gap, least[at])]
            dist[at, node] = np.sqrt(((q[at] - self.centre[node]) ** 2).sum(1))
            at = at[_may(qq[at], self.norm[node], dist[at, node] - self.radius[node], least[at])]
            alive[at, node] = True
        return alive


def _upper(qq, norm, gap):
    """The most that the inner product of vectors of squared norms qq and norm can be at a distance of gap or more."""
    return (qq + norm - np.maximum(gap, 0) ** 2) / 2 + SLACK * (1 + qq + norm)


def _may(qq, norm, gap, least):
    return _upper(qq, norm, gap) >= least


def split(sample: np.ndarray, leaves: int) -> Tree:
    """A tree over the sample: the node of most vectors is split until there are so many leaves."""
    centre, parent, to_parent, children, held = [sample[0]], [-1], [0.0], [[]], {0: np.arange(len(sample))}
    while len(held) < leaves:
        node = max(held, key=lambda n: (len(held[n]), -n))
        at = held[node]
        x = sample[at]
        picks, gap = [0], np.sqrt(((x - x[0]) ** 2).sum(1))
        while len(picks) < FAN and gap.max() > 0:  # each pivot is the farthest from those before
            picks.append(int(gap.argmax()))
            gap = np.minimum(gap, np.sqrt(((x - x[picks[-1]]) ** 2).sum(1)))
        if len(picks) < 2:
            break
        near = _distances(x, x[picks]).argmin(1)
        del held[node]
        for i, p in enumerate(picks):
            if (near == i).any():
                held[len(centre)] = at[near == i]
                children[node].append(len(centre))
                centre.append(x[p])
                parent.append(node)
                to_parent.append(float(np.sqrt(((x[p] - centre[node]) ** 2).sum())))
                children.append([])
    return Tree(np.stack(centre), np.array(parent), np.array(to_parent), children)


def build(rows: DataFrame, page: int = PAGE) -> tuple[DataFrame, Tree | None]:
    """The pages (leaf, ring, n, dim, ids, rows, vectors, parents, lo, hi, norm, most) and the tree above them."""
    rows = stored(rows, "vectors").withColumn("row", F.monotonically_increasing_id())
    total, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(1, dim)
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(ROUTES).collect()  # at most ROUTES vectors
    tree = split(_matrix([r["v"] for r in sample], dim).astype(np.float64), min(MOST_LEAVES, -(-total // page))) if sample else None

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"], dim).astype(np.float64)
            leaf, p, path = np.zeros(len(x), np.int32), np.zeros(len(x)), [[] for _ in range(len(x))]
            for at, node, d in tree.route(x):
                leaf[at], p[at] = node, d
                for i, gap in zip(at.tolist(), d.tolist(), strict=True):
                    path[i].append((node, gap))
            yield batch.assign(leaf=leaf, p=p, norm=(x * x).sum(1), path=path)

    routed = stored(rows.mapInPandas(route, "vec_id long, v array<long>, row long, leaf int, p double, norm double, path array<struct<node:int,d:double>>"), "routed")
    if tree:
        tree.radius, tree.norm = np.zeros(len(tree.centre)), np.zeros(len(tree.centre))
        below = routed.select("norm", F.explode("path").alias("n")).groupBy("n.node").agg(F.max("n.d").alias("radius"), F.max("norm").alias("norm"))
        for r in below.collect():  # a row for each node, of which there are a bounded number
            tree.radius[r["node"]], tree.norm[r["node"]] = r["radius"] * (1 + SLACK), r["norm"]
    leaves = routed.groupBy("leaf").agg(F.count("*").alias("of_leaf"), F.max("p").alias("radius"))
    rings = F.least(F.lit(RINGS), 4 * F.ceil(F.col("of_leaf") / page))
    placed = routed.drop("path").join(leaves, "leaf").withColumn("b", F.when(F.col("radius") > 0, F.floor(F.col("p") / F.col("radius") * rings)).otherwise(0).cast("int")).drop("of_leaf", "radius")
    counts = placed.groupBy("leaf", "b").agg(F.count("*").alias("in_b"))
    upto = F.sum("in_b").over(Window.partitionBy("leaf").orderBy("b"))
    counts = counts.select("leaf", "b", F.floor((upto - F.col("in_b")) / page).cast("int").alias("ring"), F.ceil(F.col("in_b") / page).alias("parts"))
    placed = placed.join(counts, ["leaf", "b"]).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0).cast("int"))

    def close(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["p", "vec_id", "row"], kind="stable")
        x = _matrix(group["v"], dim)
        row = (key[0], key[1], len(x), dim, group["vec_id"].to_numpy(np.int64).tobytes(), group["row"].to_numpy(np.int64).tobytes(), x.tobytes(), group["p"].to_numpy(np.float64).tobytes(), float(group["p"].min()), float(group["p"].max()), float(group["norm"].max()), float(np.abs(x.astype(np.float64)).max()))
        return pd.DataFrame([row], columns=["leaf", "ring", "n", "dim", "ids", "rows", "vectors", "parents", "lo", "hi", "norm", "most"])

    return stored(placed.groupBy("leaf", "ring", "part").applyInPandas(close, "leaf int, ring int, n long, dim long, ids binary, rows binary, vectors binary, parents binary, lo double, hi double, norm double, most double"), "pages"), tree


def _products(x: np.ndarray, q: np.ndarray, most_x: float) -> np.ndarray:
    """Exact inner products of rows of longs with q: in double precision where it holds them, else on whole numbers."""
    if len(q) * max(1.0, most_x) * max(1.0, float(np.abs(q.astype(np.float64)).max(initial=0))) < EXACT:
        return x.astype(np.float64) @ q.astype(np.float64)
    return np.array([sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in x.tolist()], dtype=object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def starts(pages: DataFrame, every: int, k: int) -> DataFrame:
    """The queries, each with its leaf and the k-th best score of its own page: row, query_id, v (binary), leaf, bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch.itertuples():
                ids, rows, x = np.frombuffer(p.ids, np.int64), np.frombuffer(p.rows, np.int64), np.frombuffer(p.vectors, np.int64).reshape(p.n, p.dim)
                for i in np.flatnonzero(ids % every == 0):
                    s = np.delete(_products(x, x[i], p.most), i)
                    bound = float(sorted(s.tolist())[-k]) if len(s) >= k else -np.inf
                    out.append((rows[i], ids[i], x[i].tobytes(), p.leaf, bound - abs(bound) / EXACT * 4 if bound > -np.inf and abs(bound) >= EXACT else bound))
            yield pd.DataFrame(out, columns=["row", "query_id", "v", "leaf", "bound"])

    return stored(pages.mapInPandas(run, "row long, query_id long, v binary, leaf int, bound double"), "queries")


def blocked(queries: DataFrame) -> DataFrame:
    """queries with their block: BLOCK at most of neighbouring leaves, those of one leaf dealt by hash."""
    leaves = queries.groupBy("leaf").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("leaf"))  # a row for each leaf, of which there are a bounded number
    first = leaves.select("leaf", F.floor((upto - F.col("n")) / BLOCK).alias("first"), F.ceil(F.col("n") / BLOCK).alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0)
    return queries.join(F.broadcast(first), "leaf").select("row", "query_id", "v", "bound", F.struct("first", part.cast("long").alias("part")).alias("block"))


def reach(blocks: DataFrame, tree: Tree) -> DataFrame:
    """(block, leaf): the leaves that a query of the block may still need."""
    ends = np.array([not c for c in tree.children])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            q = np.stack([np.frombuffer(v, np.int64) for v in batch["v"]]).astype(np.float64)
            alive = tree.reached(q, batch["bound"].to_numpy(np.float64)) & ends[None]
            block = pd.DataFrame(list(batch["block"]))
            for (first, part), rows in block.groupby(["first", "part"]).groups.items():
                leaves = np.flatnonzero(alive[np.asarray(rows)].any(0))
                yield pd.DataFrame({"first": first, "part": part, "leaf": leaves.astype(np.int32)})

    return blocks.mapInPandas(run, "first long, part long, leaf int").distinct()


def _search(k: int, tree: Tree):
    def run(key, pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(queries):
            nodes = [(p.leaf, np.frombuffer(p.rows, np.int64), np.frombuffer(p.ids, np.int64), np.frombuffer(p.vectors, np.int64).reshape(p.n, p.dim), np.frombuffer(p.parents), p.most) for p in pages.itertuples()]
            norms = [(x[3].astype(np.float64) ** 2).sum(1) for x in nodes]
            whole = np.stack([np.frombuffer(v, np.int64) for v in queries["v"]])
            q = whole.astype(np.float64)
            d, qq = _distances(q, tree.centre[[x[0] for x in nodes]]), (q * q).sum(1)
            lo, hi = pages["lo"].to_numpy(np.float64), pages["hi"].to_numpy(np.float64)
            bound = _upper(qq[:, None], pages["norm"].to_numpy(np.float64)[None], np.maximum(d - hi[None], lo[None] - d))
            for i, (own, query, least) in enumerate(zip(queries["row"], queries["query_id"], queries["bound"], strict=True)):
                ids, scores = np.zeros(0, np.int64), np.zeros(0)
                for j in np.argsort(-bound[i], kind="stable"):
                    if bound[i, j] < least:
                        break
                    _, rows, page_ids, x, parents, most = nodes[j]
                    may = np.flatnonzero(_may(qq[i], norms[j], np.abs(d[i, j] - parents), least) & (rows != own))
                    ids, scores = np.concatenate((ids, page_ids[may])), np.concatenate((scores, _products(x[may], whole[i], most)))
                    top = _best(ids, scores, k)
                    ids, scores = ids[top], scores[top]
                    if len(scores) == k:
                        least = max(least, float(scores[-1]) * (1 - np.sign(float(scores[-1])) * SLACK) if scores.dtype == object else scores[-1])
                out += [(own, query, int(a), min(max(int(b), LEAST_LONG), MOST_LONG), int(b) // UNIT, str(int(b) % UNIT)) for a, b in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score", "high", "low"])

    return run


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best rows by inner product, ties to the smaller id."""
    pages, tree = build(usable(embeddings))
    if tree is None:
        return pages.select(F.col("n").alias("query_id"), F.col("leaf").alias("rank"), F.col("n").alias("vec_id"), F.col("n").alias("score")).limit(0)
    blocks = stored(blocked(starts(pages, every, k)), "blocks")
    wanted = stored(reach(blocks, tree).select(F.struct("first", "part").alias("block"), "leaf"), "reach")
    by = ["block", "leaf", "g"]
    dealt = pages.withColumn("g", F.floor(F.col("ring") / GROUP)).join(wanted, "leaf")
    asking = blocks.join(wanted, "block").join(pages.select("leaf", F.floor(F.col("ring") / GROUP).alias("g")).distinct(), "leaf")
    found = dealt.groupBy(by).cogroup(asking.groupBy(by)).applyInPandas(_search(k, tree), "row long, query_id long, vec_id long, score long, high long, low string")
    # Sums beyond a long rank by their whole value, in two parts.
    best = Window.partitionBy("row").orderBy(F.desc("high"), F.desc(F.col("low").cast("decimal(38,0)")), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
