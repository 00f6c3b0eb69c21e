"""Near duplicates by SimHash fingerprints, candidates filtered by chains of segments in a ring.

A fingerprint has 64 bits, in SEGMENTS segments of a byte set in a ring. If two fingerprints differ in `most` bits, some
chain of consecutive segments, started at the right place, stays within its proportional share of them at every length:
l segments hold at most l * most / SEGMENTS differences. With three bits the first two segments of that chain are
equal, five segments hold one difference, seven hold two. So two fingerprints that link share the first two segments of
a chain and all but one of the next three: these four bytes, with the chain's start and the segment left out, are the
keys of the index, 24 for each distinct fingerprint. The pairs of a list are then held against the budget of the chain
at each length where it grows, and only those left are compared as a whole.

Equal fingerprints are one to begin with. Of each list only the links that span it leave the task. A list longer than
BLOCK is first answered in hashed blocks; where its fingerprints are still in several components, its members meet
under longer keys, with one more segment equal, blocks of one and the same component never meeting (see jaccard).

Texts without words have fingerprint zero, which is linked like any other, so all of them are near duplicates; shorter
texts than a shingle are one shingle. Rows without doc_id take part, their component is the smallest doc_id reached or
null; rows that share a doc_id are linked by their texts alone. An empty table gives an empty result. Columns beside
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspark.llm import jaccard
from assetspark.llm.common import forget, in_slices, settle, stored, utf8

WORDS, MOST = 3, 3
SEGMENTS, WIDTH = 8, 8
SEED = 42
BLOCK = 2048
#: Pairs compared at once, and shingles of one text counted at once.
PAIRS, SHINGLES = 1 << 18, 1 << 15


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """The bits set in over half of the hashes of a text's k-word shingles, repeats included."""
    words = text.lower().split()  # on bytes: letters and white space of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    held = sum(np.unpackbits(hashes[at : at + SHINGLES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for at in range(0, n, SHINGLES))
    return int.from_bytes(np.packbits(2 * held > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows in in_slices(batches):
            fp = np.array([fingerprint(t, k) for t in utf8(rows.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# --- chains --------------------------------------------------------------------------------------


def budget(length: int, most: int = MOST) -> int:
    """Differences that a chain of so many segments may hold."""
    return length * most // SEGMENTS


def chain(start: int, length: int) -> list[int]:
    return [(start + i) % SEGMENTS for i in range(length)]


def mask(segments: list[int]) -> int:
    return sum(((1 << WIDTH) - 1) << (WIDTH * s) for s in segments)


def equal_parts(most: int = MOST) -> list[tuple[int, list[int]]]:
    """(start, segments) of each key: the chain as far as it may hold no difference, and all but one of where it may hold one."""
    none, one = (max(n for n in range(SEGMENTS + 1) if budget(n, most) <= d) for d in (0, 1))
    return [(s, [x for x in chain(s, one) if x != left]) for s in range(SEGMENTS) for left in chain(s, one)[none:]]


def keys(fp: np.ndarray, most: int = MOST) -> np.ndarray:
    """(fingerprints, keys) as longs: the number of the key's kind above its segments."""
    out = []
    for kind, (_, parts) in enumerate(equal_parts(most)):
        key = np.full(len(fp), kind, np.uint64)
        for s in parts:
            key = (key << np.uint64(WIDTH)) | ((fp >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1))
        out.append(key)
    return np.stack(out, 1).view(np.int64)


def start_of(key: np.ndarray, most: int = MOST) -> np.ndarray:
    parts = equal_parts(most)
    return np.array([s for s, _ in parts])[key >> (WIDTH * len(parts[0][1]))]


def passing(a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int = MOST) -> np.ndarray:
    """Places of the pairs whose chain stays within its budgets at every length, the whole ring last: these are linked."""
    at = np.arange(len(a))
    for length in range(1, SEGMENTS + 1):
        if length == SEGMENTS or budget(length, most) < budget(length + 1, most):
            masks = np.array([mask(chain(s, length)) for s in range(SEGMENTS)], np.uint64)
            at = at[np.bitwise_count((a[at] ^ b[at]) & masks[start[at]]) <= budget(length, most)]
    return at


# --- lists ---------------------------------------------------------------------------------------


def index(classes: DataFrame, most: int = MOST) -> DataFrame:
    """key, fp: a row for each key of each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_slices(batches, 4096):
            held = keys(rows.column("fp").to_numpy().view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(held.ravel()), pa.array(np.repeat(rows.column("fp").to_numpy(), held.shape[1]))], ["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, block, fp) of whole blocks, which come sorted; a block is bounded, so is what is held back."""
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(held, ("key", "b", "fp"), strict=True)]
        other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
        if len(other):
            cut = int(other[-1]) + 1
            yield tuple(x[:cut] for x in held)
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield tuple(held)


def _pairs(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside groups first[i], first[i] + 1, ... of size[i] rows, about PAIRS at a time."""
    last = np.repeat(first + size, size)
    row = np.arange(int(first[0]), int(first[0]) + len(last))
    ahead = last - row - 1
    cuts = np.flatnonzero(np.diff(np.cumsum(ahead) // PAIRS, prepend=0))
    for rows, n in zip(np.split(row, cuts), np.split(ahead, cuts), strict=True):
        if len(rows):
            i = np.repeat(rows, n)
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _spanning(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block the links that span it."""
        for key, block, fp in _groups(batches):
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            bits, start = fp.view(np.uint64), start_of(key, most)
            firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in _pairs(first, np.diff(np.append(first, len(fp)))):
                ok = passing(bits[i], bits[j], start[i], most)
                firsts.append(i[ok])
                seconds.append(j[ok])
            i, j = np.concatenate(firsts), np.concatenate(seconds)
            kept = jaccard.spanning_forest(i, j, np.zeros(len(i), np.int64), len(fp))
            a, b = fp[i[kept]], fp[j[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _across(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All pairs of a list that are linked and whose components differ, of two blocks those between them."""
        for lists in jaccard._slabs(batches):
            of = lists[["token", "lo", "hi"]].to_numpy(np.int64)
            first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]).any(1))))
            side = np.where(of[:, 1] != of[:, 2], lists["b"].to_numpy(np.int64), -1)
            label, fp = lists["label"].to_numpy(np.int64), lists["rid"].to_numpy(np.int64)
            bits = fp.view(np.uint64)
            for i, j in _pairs(first, np.diff(np.append(first, len(fp)))):
                ok = (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j])) & (np.bitwise_count(bits[i] ^ bits[j]) <= most)
                a, b = fp[i[ok]], fp[j[ok]]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def longer_keys(rows: DataFrame, most: int = MOST) -> DataFrame:
    """rows (key, fp) as the sets of jaccard.block_pairs: doc_id (fp), n, prefix (its tokens), bitmap.

    A token is a key with one more segment of those that it leaves out, if they are more than the differences: one of
    them is then equal. Tokens are hashed; lists that fall together by chance only compare more.
    """
    parts = [p for _, p in equal_parts(most)]
    left = [[x for x in range(SEGMENTS) if x not in p] for p in parts]
    each = f"array({', '.join('array(' + ', '.join(map(str, x)) + ')' for x in left)})[CAST(shiftright(key, {WIDTH * len(parts[0])}) AS INT)]"
    tokens = f"transform({each}, s -> xxhash64(key, s, shiftright(fp, {WIDTH} * s) & {(1 << WIDTH) - 1}))" if len(left[0]) > most else "array(xxhash64(key))"
    held = rows.selectExpr("fp AS doc_id", f"explode({tokens}) AS token").groupBy("doc_id").agg(F.collect_set("token").alias("prefix"))
    return held.selectExpr("doc_id", "0L AS n", "prefix", "CAST('' AS BINARY) AS bitmap")


def links(classes: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(key, held, fp, b of the lists of two fingerprints or more, in blocks; (a, b): links that span each block)."""
    held = index(classes, most)
    shared = held.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    block = F.pmod(F.xxhash64("fp", "key"), F.ceil(F.col("held") / BLOCK)).cast("long")
    lists = stored(held.join(shared, "key").select("key", "held", "fp", block.alias("b")), "lists")
    dealt = lists.select("key", "b", "fp").repartition("key", "b").sortWithinPartitions("key", "b", "fp")
    return lists, stored(dealt.mapInArrow(_spanning(most), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, k: int = WORDS, most: int = MOST) -> DataFrame:
    """doc_id, fp, component_id of every document: links are fingerprints that differ in at most `most` bits."""
    known = stored(fingerprints(docs, k), "fingerprints")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    lists, found = links(classes, most)
    labels = jaccard.components(found)
    long = lists.filter(F.col("held") > BLOCK)
    if not long.isEmpty():
        sets = stored(longer_keys(long, most), "longer")
        tokens = settle(jaccard.postings(sets).groupBy("token").agg(F.count("*").alias("held")).filter("held > 1").select("token"))
        pairs = jaccard.block_pairs(sets, tokens, labels)
        late = stored(jaccard.by_list(pairs).mapInPandas(_across(most), "a long, b long").distinct(), "late")
        if not late.isEmpty():
            labels = jaccard.components(found.union(late))
    named = stored(classes.join(labels, classes["fp"] == labels["id"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return known.join(named.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
