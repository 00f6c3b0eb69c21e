"""Hard negatives by threshold joins over an inverted index with suffix bounds.

An anchor's positives are its best rows of the same label; the hard negatives of an anchor and a positive are the best
rows of other labels in the window of scores from 0.8 of the positive's up to the positive's.

Index: rows stand in blocks of similar norm, their dimensions in one order of falling energy, cut in SLICES slices. What
a row can still add from a slice on is bounded by the norm of its suffix times the anchor's. So for a threshold r of
score over the anchor's norm, a row is in the lists of its first slices only, up to where its suffix norm falls under
r: the rest is left out of the index. Within a block rows are sorted by the number of slices they need, so each list is
a run of rows. Blocks whose largest norm is under r are passed over whole.

Join: anchors travel in blocks and meet each index block once a round. Partial scores accumulate list by list; after
each, rows and anchors of which no pair can still reach its threshold by the norms that remain are dropped. Pairs left
are scored exactly, on the whole vectors, and each block pair returns only the first rows that its windows may need.

Rounds: a window of `k` rows starts at the highest threshold that a bounded sample of rows says should fill it, and is
searched again at a lower one, at last at its lower end, only if it isn't full. A full window at threshold t holds its
first rows, since all rows of t or more were seen. The sample of ROUTES rows serves thresholds alone.

Vectors of different lengths meet as if the shorter ended in zeros. Components beyond a long count as its ends, and so
do scores. Rows with a null label, vector, id or component, or one that isn't finite, take no part. Rows that repeat an
id, or are equal, each count: they are candidates of one another, and anchors each by themselves. Ties go to the
smaller vec_id. Anchors without positives, and windows without rows, have no result; an empty table gives none. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetspark.llm.common import stored
from assetspark.llm.topk import EXACT, LEAST_LONG, MOST_LONG, _matrix, quantised

EVERY, FLIPPED, LABELS, K = 100, 7, 10, 5
LEAST, SHARE = 80, 100
ROUTES = 2048
BLOCK, ANCHORS = 4096, 16384
#: Anchors whose scores are held at once.
CHUNK = 1024
SLICES = 8
#: A window's first threshold lets through so many times its rows by the sample, the next SLACKER times as many.
FIRST, SLACKER = 4, 8
ROUNDING = 1e-9
TYPES = {"row": "long", "w": "int", "vec_id": "long", "other": "long", "score": "long"}


def rows_of(embeddings: DataFrame, flipped: int = FLIPPED, labels: int = LABELS) -> DataFrame:
    """row (a number of its own), vec_id, label (turned where `flipped` divides vec_id), v: the rows that take part, as a table."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    held = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(finite)
    label = F.when(F.col("vec_id") % flipped == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return stored(held.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), quantised(F.col("embedding")).alias("v")), "rows")


def slices(dim: int) -> list[slice]:
    edges = [dim * i // SLICES for i in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def suffix_norms(x: np.ndarray, cut: list[slice]) -> np.ndarray:
    """The norm of what is left of each row from each slice on, and 0 behind the last."""
    squares = np.stack([(x[:, c] ** 2).sum(1) for c in cut] + [np.zeros(len(x))], 1)
    return np.sqrt(squares[:, ::-1].cumsum(1)[:, ::-1])


def pages_of(rows: DataFrame, order: np.ndarray) -> DataFrame:
    """bucket, page, n, ids, rows, labels, vectors, norm: rows in blocks of similar norm, dimensions in the given order."""
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    placed = rows.withColumn("bucket", F.floor(4 * F.log2(square + 1)).cast("int"))
    parts = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))  # a row for each of at most some thousand buckets
    placed = placed.join(F.broadcast(parts), "bucket").withColumn("page", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def close(key, group: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(group["v"], len(order))[:, order]
        norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max())
        row = (key[0], key[1], len(x), *(group[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "row", "label")), x.tobytes(), norm)
        return pd.DataFrame([row], columns=["bucket", "page", "n", "ids", "rows", "labels", "vectors", "norm"])

    return stored(placed.drop("parts").groupBy("bucket", "page").applyInPandas(close, "bucket int, page int, n long, ids binary, rows binary, labels binary, vectors binary, norm double"), "pages")


def candidates(q: np.ndarray, qs: np.ndarray, t: np.ndarray, x: np.ndarray, xs: np.ndarray, cut: list[slice]) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor, places of rows that may reach its threshold): q, x the vectors, qs, xs their suffix norms."""
    norm = np.maximum(qs[:, 0], 1e-300)
    slack = ROUNDING * norm[:, None]
    least = (t / norm).min() if len(t) else np.inf
    # The lists of a row end where what follows can't reach any threshold by itself.
    need = (xs[:, :-1] * (1 + ROUNDING) >= least).sum(1) if least > 0 else np.full(len(x), SLICES)
    place = np.argsort(-need, kind="stable")
    place = place[need[place] > 0]
    asks, need = np.arange(len(q)), need[place]
    part = np.zeros((len(asks), len(place)))
    alive = np.ones(part.shape, bool)
    for i, c in enumerate(cut):
        listed = int((need > i).sum())
        if not listed or not len(asks):
            break
        part[:, :listed] += q[asks, c] @ x[place[:listed], c].T
        ahead = np.minimum(need, i + 1)
        rest = qs[asks][:, ahead] * xs[place, ahead]
        alive = part + rest + slack[asks] * xs[place, 0] >= t[asks, None]
        if i + 1 < len(cut):
            ask, row = alive.any(1), alive.any(0)
            if ask.sum() * row.sum() * 2 < alive.size:
                asks, place, need, part, alive = asks[ask], place[row], need[row], part[np.ix_(ask, row)], alive[np.ix_(ask, row)]
    for i, ask in enumerate(asks.tolist()):
        yield ask, place[alive[i]]


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of longs with q as longs, those beyond a long as its ends."""
    if len(q) * max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0))) * max(1.0, float(np.abs(q.astype(np.float64)).max(initial=0))) < EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    sums = (sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in x.tolist())
    return np.array([min(max(s, LEAST_LONG), MOST_LONG) for s in sums], np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first rows: highest scores, then smaller ids."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((rows[at], ids[at], -scores[at]))[:k]]


def _search(dim: int, k: int, same: bool):
    cut = slices(dim)

    def run(key, pages: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(asks):
            whole = np.stack([np.frombuffer(v, np.int64) for v in asks["v"]])
            q = whole.astype(np.float64)
            qs, t, own, label, windows = suffix_norms(q, cut), asks["t"].to_numpy(np.float64), asks["row"].to_numpy(np.int64), asks["label"].to_numpy(np.int64), list(asks["windows"])
            for p in pages.itertuples():
                ids, rows, labels = (np.frombuffer(b, np.int64) for b in (p.ids, p.rows, p.labels))
                longs = np.frombuffer(p.vectors, np.int64).reshape(p.n, dim)
                x = longs.astype(np.float64)
                xs = suffix_norms(x, cut)
                for first in range(0, len(q), CHUNK):
                    some = slice(first, first + CHUNK)
                    for i, at in candidates(q[some], qs[some], t[some], x, xs, cut):
                        i += first
                        at = at[((labels[at] == label[i]) == same) & (rows[at] != own[i])]
                        scores = exact_scores(longs[at], whole[i])
                        for w in windows[i]:
                            inside = np.flatnonzero((scores >= w["lo"]) & (scores <= w["hi"]) & (scores >= t[i]))
                            best = inside[_first(scores[inside], ids[at[inside]], rows[at[inside]], k)]
                            out += [(own[i], w["w"], ids[at[b]], rows[at[b]], scores[b]) for b in best]
        return pd.DataFrame(out, columns=list(TYPES)).astype({c: "int32" if t == "int" else "int64" for c, t in TYPES.items()})

    return run


ASKS = "row long, vec_id long, label long, v binary, windows array<struct<w:int,lo:long,hi:long>>"


def searched(pages: DataFrame, asks: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """row, w, vec_id, other, score, rank, held: the first k rows of each window (w, lo, hi) of asks among those of score t or more; held: how many there are."""
    blocks = max(1, -(-asks.count() // ANCHORS))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    ratio = F.when(F.col("norm") > 0, F.col("t") / F.col("norm")).otherwise(F.when(F.col("t") <= 0, float("-inf")).otherwise(float("inf")))
    # A block pair is left out if no row of the one has the norm that any anchor of the other asks for.
    pairs = pages.select("bucket", "page", "norm", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = pairs.join(asks.groupBy("block").agg(F.min(ratio).alias("least")), "block").filter(F.col("norm") * (1 + ROUNDING) >= F.col("least"))
    pairs = stored(pairs.select("bucket", "page", "block"), "pairs")
    by = ["bucket", "page", "block"]
    dealt, asking = pages.join(pairs, ["bucket", "page"]), asks.select("row", "label", "v", "t", "windows", "block").join(pairs, "block")
    found = dealt.groupBy(by).cogroup(asking.groupBy(by)).applyInPandas(_search(dim, k, same), ", ".join(f"{c} {t}" for c, t in TYPES.items()))
    window = Window.partitionBy("row", "w")
    best = found.withColumn("rank", F.row_number().over(window.orderBy(F.desc("score"), "vec_id", "other"))).filter(F.col("rank") <= k)
    return stored(best.withColumn("held", F.max("rank").over(window)), "found")


def thresholds(asks: DataFrame, sample: list, total: int, order: np.ndarray, k: int, same: bool) -> DataFrame:
    """asks with ts, the thresholds of the rounds, and norm: from the scores of a bounded sample down to the lowest window's end."""
    x = _matrix([r["v"] for r in sample], len(order))[:, order].astype(np.float64)
    labels = np.array([r["label"] for r in sample], np.int64)
    places = [max(1, round(FIRST * k * len(x) * m / max(1, total))) for m in (1, SLACKER)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ts, norms = [], []
            for v, label, windows in zip(batch["v"], batch["label"], batch["windows"], strict=True):
                q = np.frombuffer(v, np.int64).astype(np.float64)
                scores = np.sort((x @ q)[(labels == label) == same])[::-1]
                least = min(w["lo"] for w in windows)
                end = float(least) if least > LEAST_LONG else -np.inf
                below = [scores[scores <= w["hi"]] for w in windows]
                ts.append([max(end, min(float(s[m - 1]) if len(s) >= m else end for s in below)) for m in places] + [end])
                norms.append(float(np.sqrt((q * q).sum())))
            yield batch.assign(ts=ts, norm=norms)

    return stored(asks.mapInPandas(run, f"{ASKS}, ts array<double>, norm double"), "asks")


def first_rows(pages: DataFrame, asks: DataFrame, dim: int, k: int, same: bool, rounds: int = 3) -> DataFrame:
    """row, w, vec_id, other, score, rank: the first k rows of each window of asks, thresholds lowered until windows are full."""
    done = []
    for i in range(rounds):
        last = F.col("ts")[i] <= F.col("ts")[rounds - 1]
        found = searched(pages, asks.withColumn("t", F.col("ts")[i]), dim, k, same)
        done.append(found.join(asks.select("row", last.alias("last")), "row").filter((F.col("held") == k) | F.col("last")).select("row", "w", "vec_id", "other", "score", "rank"))
        if i + 1 < rounds:
            full = found.filter(F.col("held") == k).groupBy("row").agg(F.collect_set("w").alias("full"))
            left = F.filter("windows", lambda w: ~F.coalesce(F.array_contains("full", w["w"]), F.lit(False)))
            asks = stored(asks.filter(~last).join(full, "row", "left").withColumn("windows", left).drop("full").filter(F.size("windows") > 0), "open")
            if asks.isEmpty():
                break
    return reduce(DataFrame.unionByName, done)


def anchors_of(rows: DataFrame, order: np.ndarray, every: int) -> DataFrame:
    """The anchors as asks: one window over all scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"], len(order))[:, order]
            yield batch.assign(v=[r.tobytes() for r in x], windows=[[(0, LEAST_LONG, MOST_LONG)]] * len(x))

    return stored(rows.filter(F.col("vec_id") % every == 0).mapInPandas(run, ASKS), "anchors")


def hard_negatives(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = rows_of(embeddings)
    total, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(ROUTES).select("label", "v").collect()  # at most ROUTES rows
    energy = (_matrix([r["v"] for r in sample], max(1, dim)).astype(np.float64) ** 2).sum(0)
    order = np.argsort(-energy, kind="stable")
    pages, anchors = pages_of(rows, order), anchors_of(rows, order, every)
    positives = first_rows(pages, thresholds(anchors, sample, total, order, k, True), len(order), k, True)
    positives = stored(positives.select("row", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * negative >= 80 * positive: the least such number is the positive's score less a fifth of it, rounded down.
    part = F.expr(f"CAST(positive_score AS DECIMAL(20, 0)) * {SHARE - LEAST} div {SHARE}")
    window = F.struct("w", (F.col("positive_score") - part).alias("lo"), F.col("positive_score").alias("hi"))
    windows = positives.filter("positive_score >= 0").groupBy("row").agg(F.collect_list(window).alias("windows"))
    asks = anchors.drop("windows").join(windows, "row").select("row", "vec_id", "label", "v", "windows")
    found = first_rows(pages, thresholds(asks, sample, total, order, k, False), len(order), k, False)
    named = found.join(positives, ["row", "w"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
