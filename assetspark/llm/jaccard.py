"""Exact Jaccard self-join of word shingle sets, and the components of its links.

Equal sets are one to begin with. Each distinct set then enters the index lists of its prefix, the rarest shingles of
it of which two similar sets must share one. A list is ordered in blocks of equal size and position; two blocks skip
each other whole by what their sizes and positions leave possible. Sets of the other blocks are compared by parity
bitmaps, which bound the difference from below; in large blocks a set's partners are derived from those of a pivot set,
as only sets about as far from the pivot as itself can be among them. What passes is nearly always a link, so a list is first answered by the likeliest links that span it, and transitivity covers
the other links of a component, which are never looked for: only sets still in different components are
compared in a second round, pair by pair as far as the same bounds allow. Every such pair is verified on whole sets,
so the components are exact.

A list whose spanning links all hold has no such sets, so only lists with a link that failed are looked at again. A
list longer than BLOCK is first answered in hashed blocks, each by itself and dealt anew in every list, so that a large
group of copies grows together over its lists. Only if its sets are still in several components are its blocks brought
together two by two, in places of bounded size; blocks of one and the same component never meet. The order of
shingles by rarity is taken from one document in SAMPLE and holds the COMMON_SHINGLES most frequent; it serves speed
alone.

Null and empty texts, and texts without words, have no shingles and are linked with nothing. Every row has its result:
one without doc_id takes part under a number of its own, of 2**62 or more, with a mark that it is no doc_id, and its
component is null where it reaches none. Texts that share a doc_id are linked through it. An empty table gives an empty result. Columns beside doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetspark.llm.common import BLANK, WordHasher, dropped, forget, in_slices, scramble, settle, stored, utf8

WORDS = 3
LEAST = (9, 10)  # numerator and denominator of the least similarity
SAMPLE, LEAST_SAMPLE = 32, 1000
COMMON_SHINGLES = 200_000
BLOCK = 1024
BITS = 512
#: Pairs compared at once; pairs of blocks with more are sorted out by a pivot first.
PAIRS, LARGE = 1 << 17, 1 << 12
#: Squares of list lengths that are worked on at once.
SLAB = 1 << 21
BROADCAST_IDS = 200_000
CHUNK = 1 << 18
_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingle_sets(texts: list[bytes], hasher: WordHasher, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; of shorter texts, of the whole sequence as one."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size += len(texts[to])
            to += 1
        words, counts, _ = hasher(texts[at:to])
        rolled = words.copy()
        for i in range(1, k):
            rolled[: len(words) - i] = scramble(rolled[: len(words) - i] * _K1 + words[i:] * _K2 + np.uint64(i))
        ends = np.cumsum(counts)
        for n, end in zip(counts, ends, strict=True):
            if n >= k:
                yield np.unique(rolled[end - n : end - k + 1])
            elif n:
                yield np.array([int.from_bytes(hashlib.blake2b(words[end - n : end].tobytes(), digest_size=8).digest(), "little")], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)
        at = to


def common_shingles(docs: DataFrame, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least three texts of the sample hold, with their counts: a hint for the order of prefixes."""
    total = docs.count()
    share = min(1.0, max(1 / SAMPLE, LEAST_SAMPLE / max(1, total)))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher = WordHasher(BLANK)
        for rows in in_slices(batches, 2048):
            sets = list(shingle_sets(utf8(rows.column("text")), hasher, k))
            held, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    counts = sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n >= 3")
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toPandas()
    shingles = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows["n"].to_numpy(np.int64)[order]


def profiles(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], k: int = WORDS, least=LEAST) -> DataFrame:
    """doc_id and real as they come, n (set size), digest of the set, its parity bitmap and its prefix in order of rarity."""
    shingles, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher = WordHasher(BLANK)
        for batch in in_slices(batches):
            sizes, digests, bitmaps, prefixes = [], [], [], []
            for s in shingle_sets(utf8(batch.column("text")), hasher, k):
                n = len(s)
                df = np.zeros(n, np.int64)
                if n and len(shingles):
                    at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
                    df = np.where(shingles[at] == s, counts[at], 0)
                p = n - -(-least[0] * n // least[1]) + 1 if n else 0
                parity = (np.bincount((s >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1).astype(np.uint8)
                sizes.append(n)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bitmaps.append(np.packbits(parity).tobytes())
                prefixes.append(s[np.argsort(df, kind="stable")[:p]].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("real"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bitmaps, pa.binary()), prefix], ["doc_id", "real", "n", "digest", "bitmap", "prefix"])

    return docs.mapInArrow(run, "doc_id long, real boolean, n long, digest binary, bitmap binary, prefix array<long>")


def small_or_not(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """df, an id or two a row, to be broadcast if it has few rows, as it is otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def postings(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("doc_id").alias("rid"), "n", F.posexplode("prefix").alias("at", "token"))


def _bitmaps(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("doc_id").alias("rid"), "bitmap")


def index_lists(sets: DataFrame) -> DataFrame:
    """token, lo, hi, b, rid, n, at, bitmap: the lists of two or more, long ones in blocks (lo = hi = b) that are lists of their own."""
    held = postings(sets)
    lengths = held.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid", "token"), blocks).cast("int")
    members = held.join(lengths, "token").join(_bitmaps(sets), "rid").withColumn("b", own)
    return members.select("token", F.col("b").alias("lo"), F.col("b").alias("hi"), "b", "rid", "n", "at", "bitmap")


def long_lists(sets: DataFrame) -> DataFrame:
    """token: the lists that index_lists cuts."""
    return postings(sets).groupBy("token").agg(F.count("*").alias("held")).filter(F.col("held") > BLOCK).select("token")


def block_pairs(sets: DataFrame, long: DataFrame, labels: DataFrame) -> DataFrame:
    """token, lo, hi, b, rid, n, at, label, bitmap: long lists with several components, in blocks that meet two by two.

    A component with BLOCK sets or more in a list has blocks of its own there, which don't meet one another.
    """
    held = postings(sets).join(small_or_not(long), "token")
    held = held.join(labels, held["rid"] == labels["id"], "left").select("token", "rid", "n", "at", F.coalesce("label", "rid").alias("label"))
    counts = settle(held.groupBy("token", "label").agg(F.count("*").alias("held")))
    several = counts.groupBy("token").agg(F.count("*").alias("n_labels")).filter("n_labels > 1").select("token")
    heavy = F.col("held") >= BLOCK
    classes = counts.join(several, "token").select("token", "label", "held", heavy.alias("heavy"), F.when(heavy, F.col("label")).otherwise(0).alias("part"))
    parts = classes.groupBy("token", "heavy", "part").agg(F.ceil(F.sum("held") / BLOCK).cast("int").alias("subs"))
    blocks = parts.select("token", "heavy", "part", "subs", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    blocks = settle(blocks.withColumn("b", F.row_number().over(Window.partitionBy("token").orderBy("heavy", "part", "sub"))))
    one, two = (blocks.select("token", *(F.col(c).alias(f"{c}_{end}") for c in ("heavy", "part", "b"))) for end in ("lo", "hi"))
    met = one.join(two, "token").filter("b_lo <= b_hi AND NOT (heavy_lo AND heavy_hi AND part_lo = part_hi)")
    met = met.select("token", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), F.explode(F.array_distinct(F.array("b_lo", "b_hi"))).alias("b"))
    dealt = held.join(classes.select("token", "label", "heavy", "part"), ["token", "label"]).join(parts, ["token", "heavy", "part"])
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("rid"), F.col("subs")).cast("int")).join(blocks.select("token", "heavy", "part", "sub", "b"), ["token", "heavy", "part", "sub"])
    placed = dealt.select("token", "b", "rid", "n", "at", "label").join(_bitmaps(sets), "rid").join(met, ["token", "b"])
    return placed.select("token", "lo", "hi", "b", "rid", "n", "at", "label", "bitmap")


def _expanded(lo_a, n_a, lo_b, n_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each block pair, block i being rows lo_a[i] on, n_a[i] of them; of a block with itself each pair once."""
    size = n_a * n_b
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    x, y = lo_a[which] + k // n_b[which], lo_b[which] + k % n_b[which]
    ok = (lo_a[which] != lo_b[which]) | (x < y)
    return x[ok], y[ok]


def _by_pivot(lo_a: int, n_a: int, lo_b: int, n_b: int, bitmap: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two large blocks that may be within `most` of each other.

    Their differences to one set, the pivot, are computed once; a set's answers follow from the pivot's: only sets whose
    difference to the pivot is within `most` of its own can be among them.
    """
    pivot = bitmap[lo_a]
    d_a = np.bitwise_count(bitmap[lo_a : lo_a + n_a] ^ pivot).sum(1, dtype=np.int64)
    d_b = np.bitwise_count(bitmap[lo_b : lo_b + n_b] ^ pivot).sum(1, dtype=np.int64)
    order = np.argsort(d_b, kind="stable")
    first, last = np.searchsorted(d_b[order], d_a - most, "left"), np.searchsorted(d_b[order], d_a + most, "right")
    size = last - first
    x = np.repeat(np.arange(n_a), size)
    y = order[np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
    x, y = x + lo_a, y + lo_b
    ok = x < y if lo_a == lo_b else slice(None)
    return x[ok], y[ok]


def _passing(list_id: np.ndarray, n: np.ndarray, at: np.ndarray, bitmap: np.ndarray, side: np.ndarray, label: np.ndarray, least) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one list that no bound rules out, and the least difference of their sets. Rows come by list, size, position, side.

    The rows of a list with one size, position and side are a block. Two blocks are held against each other once, by size
    and by what their positions leave possible, and skipped whole; sets of the others are compared by their bitmaps.
    Sides of 0 or more tell the halves of a list of which each meets only the other. Rows of one label aren't compared.
    """
    num, den = least
    edge = np.flatnonzero(np.concatenate(([True], (list_id[1:] != list_id[:-1]) | (n[1:] != n[:-1]) | (at[1:] != at[:-1]) | (side[1:] != side[:-1]))))
    held = np.diff(np.append(edge, len(n)))
    of, size, place, half = list_id[edge], n[edge], at[edge], side[edge]
    firsts, seconds, gaps = [], [], []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            gap = np.bitwise_count(bitmap[x] ^ bitmap[y]).sum(1, dtype=np.int64)
            ok = (num + den) * (n[x] + n[y] - gap) >= 2 * num * (n[x] + n[y])  # overlap = (sizes - difference) / 2
            firsts.append(x[ok])
            seconds.append(y[ok])
            gaps.append(gap[ok])

    live = np.arange(len(edge))
    step = 0
    while len(live):
        live = live[live + step < len(edge)]
        live = live[of[live] == of[live + step]]
        live = live[den * size[live] >= num * size[live + step]]  # sizes ascend: once too large, all further ones are
        i, j = live, live + step
        most = np.minimum(size[i] - place[i], size[j] - place[j]) + np.minimum(place[i], place[j])
        ok = ((num + den) * most >= num * (size[i] + size[j])) & ((step > 0) | (held[i] > 1)) & ((half[i] < 0) | (half[i] != half[j]))
        i, j = i[ok], j[ok]
        large = held[i] * held[j] > LARGE
        for a, b in zip(i[large].tolist(), j[large].tolist(), strict=True):
            compare(*_by_pivot(edge[a], held[a], edge[b], held[b], bitmap, (size[a] + size[b]) * (den - num) // (den + num)))
        i, j = i[~large], j[~large]
        cuts = np.flatnonzero(np.diff(np.cumsum(held[i] * held[j]) // PAIRS, prepend=0))
        for a, b in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
            if len(a):
                compare(*_expanded(edge[a], held[a], edge[b], held[b]))
        step += 1
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(firsts), cat(seconds), cat(gaps)


def _whole_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut between lists: a list's rows stay together. A list in a block pair is bounded, so is what is held back."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        key = batch[["token", "lo", "hi"]].to_numpy(np.int64)
        last = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
        if last:
            yield batch.iloc[:last].reset_index(drop=True)
        held = batch.iloc[last:]
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def _arrays(lists: pd.DataFrame):
    """list_id, n, at, bitmap and side of a batch's rows."""
    key = lists[["token", "lo", "hi"]].to_numpy(np.int64)
    list_id = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(1))))
    bitmap = np.frombuffer(b"".join(lists["bitmap"]), np.uint64).reshape(len(lists), BITS // 64)
    side = np.where(key[:, 1] != key[:, 2], lists["b"].to_numpy(np.int64), -1)
    return list_id, lists["n"].to_numpy(np.int64), lists["at"].to_numpy(np.int64), bitmap, side


def _slabs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole lists, as many at once as have about SLAB pairs. One list has at most the pairs of two blocks."""
    for lists in _whole_lists(batches):
        key = lists[["token", "lo", "hi"]].to_numpy(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        pairs = np.cumsum(np.diff(np.append(first, len(lists))) ** 2)
        cuts = first[np.flatnonzero(np.diff(pairs // SLAB, prepend=0))]
        for a, b in zip([0, *cuts], [*cuts, len(lists)], strict=True):
            if a < b:
                yield lists.iloc[a:b].reset_index(drop=True)


def spanning_forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """Places of the pairs (i, j) of a least spanning forest of m nodes; of equal weights the earlier pair is less.

    In each round every component takes its least pair to another one, so only pairs taken are looked at singly.
    """
    place = np.argsort(weight, kind="stable")
    parent = np.arange(m)
    taken = []
    while True:
        a, b = parent[i[place]], parent[j[place]]
        place, a, b = place[a != b], a[a != b], b[a != b]
        if not len(place):
            return np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        rank = np.arange(len(place))
        least = np.full((2, m), len(place))
        for side, end in zip(least, (a, b), strict=True):
            side[end[::-1]] = rank[::-1]
        chosen = np.unique(least.min(0))
        chosen = chosen[chosen < len(place)]
        taken.append(place[chosen])
        over = dict(zip(parent.tolist(), parent.tolist(), strict=True))

        def root(x: int, over: dict = over) -> int:
            while over[x] != x:
                over[x] = over[over[x]]
                x = over[x]
            return x

        for x, y in zip(a[chosen].tolist(), b[chosen].tolist(), strict=True):
            over[root(x)] = root(y)
        parent = np.array([root(x) for x in parent.tolist()], np.int64)


def _spanning(least):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each list the likeliest links that span it, and the members of lists of which other pairs passed."""
        for lists in _slabs(batches):
            list_id, n, at, bitmap, side = _arrays(lists)
            rid = lists["rid"].to_numpy(np.int64)
            i, j, gap = _passing(list_id, n, at, bitmap, side, rid, least)
            kept = spanning_forest(i, j, gap, len(n))
            more = np.zeros(int(list_id[-1]) + 1, bool)
            spared = np.ones(len(i), bool)
            spared[kept] = False
            more[list_id[i[spared]]] = True
            x, a, b = i[kept], rid[i[kept]], rid[j[kept]]
            out = lists.loc[x, ["token", "lo", "hi"]].reset_index(drop=True).assign(a=np.minimum(a, b), b=np.maximum(a, b), more=more[list_id[x]])
            if more.any():
                out = pd.concat([out, lists.loc[more[list_id], ["token", "lo", "hi", "b", "rid", "n", "at"]].rename(columns={"b": "block"})], ignore_index=True)
            numbers = ["token", "lo", "hi", "a", "b", "block", "rid", "n", "at"]
            yield out.reindex(columns=[*numbers, "more"]).astype({**dict.fromkeys(numbers, "Int64"), "more": "boolean"})

    return run


def _across(least):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All pairs of a list that pass and whose components differ."""
        for lists in _slabs(batches):
            list_id, n, at, bitmap, side = _arrays(lists)
            rid = lists["rid"].to_numpy(np.int64)
            i, j, _ = _passing(list_id, n, at, bitmap, side, lists["label"].to_numpy(np.int64), least)
            pairs = np.unique(np.stack([np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])], 1), axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def by_list(lists: DataFrame) -> DataFrame:
    return lists.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "at", "b", "rid")


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's hashes over four to eight bits for each element: differences of two sets show as set bits."""
    bits = max(64, 1 << (4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the difference of two sets from their sketches, the wider one folded to the other's width."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def verified(pairs: DataFrame, docs: DataFrame, k: int = WORDS, least=LEAST) -> DataFrame:
    """The pairs (a, b) whose sets reach the least similarity. Only texts in pairs are read again.

    Sketches of a sixteenth of a set's bytes rule out most false pairs; whole sets travel for the others alone.
    """
    pairs = stored(pairs.distinct(), "pairs")
    wanted = small_or_not(settle(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()))
    texts = docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(BLANK)
        for rows in in_slices(batches):
            held = list(shingle_sets(utf8(rows.column("text")), hasher, k))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(s) for s in held], pa.int64()), pa.array([sketch(s) for s in held], pa.binary()), pa.array([s.tobytes() for s in held], pa.binary())], ["id", "n", "sketch", "held"])

    held = stored(texts.mapInArrow(sets, "id long, n long, sketch binary, held binary"), "sets")

    def kept(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in in_slices(batches, 64):
                keep = [test(*x) for x in zip(*(rows.column(c).to_pylist() for c in rows.schema.names[2:]), strict=True)]
                yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return run

    def likely(n_a: int, sketch_a: bytes, n_b: int, sketch_b: bytes) -> bool:
        return (least[0] + least[1]) * (n_a + n_b - least_difference(sketch_a, sketch_b)) >= 2 * least[0] * (n_a + n_b)

    def alike(held_a: bytes, held_b: bytes) -> bool:
        s, t = np.frombuffer(held_a, np.uint64), np.frombuffer(held_b, np.uint64)
        common = len(s) + len(t) - len(np.unique(np.concatenate((s, t))))
        return least[1] * common >= least[0] * (len(s) + len(t) - common)

    def ends(pairs: DataFrame, *columns: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(held.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return pairs.select("a", "b", *(f"{c}_{end}" for end in ("a", "b") for c in columns))

    possible = stored(ends(pairs, "n", "sketch").mapInArrow(kept(likely), "a long, b long"), "likely")
    links = stored(ends(possible, "held").mapInArrow(kept(alike), "a long, b long"), "links")
    dropped(pairs, held, possible)
    return links


def components(links: DataFrame) -> DataFrame:
    """id, label: for each end of a link the least id that it reaches. Least labels of neighbours, then labels of labels, until none changes."""
    edges = settle(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")))
    labels = settle(edges.groupBy("x").agg(F.min("y").alias("least")).select(F.col("x").alias("id"), F.least("x", "least").alias("label")))
    while True:
        seen = edges.join(labels, edges["y"] == labels["id"]).groupBy("x").agg(F.min("label").alias("near"))
        stepped = labels.join(seen, labels["id"] == seen["x"]).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jumps = labels.select(F.col("id").alias("through"), F.col("label").alias("to"))
        jumped = stepped.join(jumps, stepped["label"] == jumps["through"], "left").select("id", "was", F.least("label", F.coalesce("to", "label")).alias("label"))
        now = settle(jumped)
        labels = now.select("id", "label")
        if now.filter("label < was").isEmpty():
            return labels


NUMBERED = 1 << 62


def numbered(doc_id: Column, text: Column) -> Column:
    """doc_id, or where it is null a number of the text's, greater than any doc_id."""
    return F.coalesce(doc_id.cast("long"), F.lit(NUMBERED) + F.pmod(F.xxhash64(text), F.lit(NUMBERED - 1)))


def through_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of texts that share a doc_id."""
    shared = known.filter("n > 0").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("doc_id")
    held = known.filter("n > 0").join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("of"), "digest").join(classes.select("digest", F.col("doc_id").alias("rid")), "digest").select("of", "rid").distinct()
    first = held.groupBy("of").agg(F.min("rid").alias("a"))
    return held.join(first, "of").filter("a < rid").select("a", F.col("rid").alias("b"))


def linked(docs: DataFrame, k: int = WORDS, least=LEAST, keep_numbers: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; with keep_numbers also those of rows without doc_id."""
    docs = docs.select(numbered(F.col("doc_id"), F.col("text")).alias("doc_id"), F.col("doc_id").isNotNull().alias("real"), "text")
    wide = stored(profiles(docs, common_shingles(docs, k), k, least), "profiles")
    classes = stored(wide.filter("n > 0").groupBy("digest").agg(F.min_by(F.struct("doc_id", "n", "bitmap", "prefix"), "doc_id").alias("r")).select("digest", "r.*"), "classes")
    # Bitmaps and prefixes are those of the classes from here on.
    known = stored(wide.select("doc_id", "real", "n", "digest"), "known")
    dropped(wide)
    lists = by_list(index_lists(classes))
    first = stored(lists.mapInPandas(_spanning(least), "token long, lo int, hi int, a long, b long, block int, rid long, n long, at long, more boolean"), "spanning")
    spanning = first.filter("a IS NOT NULL")
    links = verified(spanning.select("a", "b"), docs, k, least).union(through_ids(known, classes))
    labels = components(links)
    long = settle(long_lists(classes))
    crowded = not long.isEmpty()
    failed = spanning.filter("more").join(links, ["a", "b"], "left_anti").select("token", "lo", "hi").distinct()
    failed = settle(failed.join(long, "token", "left_anti") if crowded else failed)
    rest = []
    if not failed.isEmpty():
        again = first.filter("rid IS NOT NULL").select("token", "lo", "hi", F.col("block").alias("b"), "rid", "n", "at").join(failed, ["token", "lo", "hi"], "left_semi")
        again = again.join(classes.select(F.col("doc_id").alias("rid"), "bitmap"), "rid")
        again = again.join(labels, again["rid"] == labels["id"], "left").withColumn("label", F.coalesce("label", "rid")).drop("id")
        rest.append(again.select("token", "lo", "hi", "b", "rid", "n", "at", "label", "bitmap"))
    if crowded:
        rest.append(block_pairs(classes, long, labels))
    if rest:
        pairs = reduce(DataFrame.unionByName, rest)
        late = verified(by_list(pairs).mapInPandas(_across(least), "a long, b long"), docs, k, least)
        if not late.isEmpty():
            labels = components(links.union(late))
    named = classes.select("digest", F.col("doc_id").alias("rid")).join(labels, F.col("rid") == F.col("id"), "left").select("digest", F.coalesce("label", "rid").alias("component"))
    held = known.select("doc_id", "real", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left").withColumn("component", F.coalesce("component", "doc_id"))
    held = stored(held.select("doc_id", "real", "n", "component"), "members")
    dropped(known, classes, first)
    if keep_numbers:
        return held.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    # A component under NUMBERED is a doc_id; of the others, the least doc_id among their rows is looked up.
    high = F.col("component") >= NUMBERED
    least = settle(held.filter(high).groupBy("component").agg(F.min(F.when(F.col("real"), F.col("doc_id"))).alias("least")))
    held = held.join(small_or_not(least), "component", "left")
    return held.select(F.when(F.col("real"), F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(high, F.col("least")).otherwise(F.col("component")).alias("component_id"))
