"""Packing token sequences by minimum bin slack.

Texts become token ids; documents longer than a sequence are cut from the end into whole sequences, so that the first
piece is the short one. Pieces of one length are interchangeable, so the bins are planned on the number of pieces of
each length: the longest piece left opens a bin, a bitset over reachable sums of the lengths left finds the fullest
combination beside it, and the combination is repeated as often as its lengths last. The plan's size depends on the
sequence length, not on the corpus. Pieces then find their places by rank within their length, ranks being running
sums over hash buckets, so that no length meets in one task.

Null and empty texts are one piece, the closing id. Rows that repeat a doc_id are packed each for itself. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetspark.llm.common import KEPT, in_slices, stored

LENGTH = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
IN_BUCKET = 20_000
#: So many stretches at most, of so many characters at most, are kept with their ids in a worker.
KNOWN, SHORT = 1_200_000, 64
AT_ONCE = 1000
#: Fixed value: how byte-level vocabularies write a space.
SPACE = "\u0120"
#: A space before white space or at the end, and the place before a space that other than white space follows.
LOOSE, LED = re.compile(r" (?:\s|\Z)"), re.compile(r"(?= \S)")


class Encoder:
    """Token ids of texts by the tokenizer itself, as little-endian 32-bit bytes.

    A byte-level tokenizer of this kind always starts a new word at a space that a character other than white space
    follows, so the stretches between such spaces are encoded each for itself and the ids of frequent ones are kept.
    New stretches are encoded many at once; where one begins again, a token begins with its space. Texts that hold one
    of the tokenizer's special tokens are encoded whole.
    """

    def __init__(self, path: str, most: int = KNOWN):
        # A task has one core; with threads of the tokenizer's own, each keeps memory of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.spaced = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
        self.spaced[[i for token, i in spec["model"]["vocab"].items() if token.startswith(SPACE)]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of stretches that each begin with their only space."""
        out = []
        for ids in self._whole(["".join(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)]):
            at = (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            held = ids.tobytes()
            out += [held[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    @staticmethod
    def stretches(text: str) -> list[str]:
        """text cut before each space that a character other than white space follows."""
        if "\x00" in text or LOOSE.search(text):
            return LED.split(text)
        return text.replace(" ", "\x00 ").split("\x00")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [[t] if any(s in t for s in self.special) else self.stretches(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        # Each stretch is looked up once; only the places of new ones are filled in later.
        out = [list(map(self.known.get, parts)) for parts in cut]
        gaps = [[k for k, ids in enumerate(held) if ids is None] if None in held else [] for held in out]
        new = {parts[k] for parts, at in zip(cut, gaps, strict=True) for k in at}
        words = [x for x in new if 1 < len(x) <= SHORT and x[0] == " " and x.count(" ") == 1 and not any(s in x for s in self.special)]
        self.known.update(zip(words, self._words(words), strict=True))
        others = list(new.difference(words))
        self.known.update(zip(others, (ids.tobytes() for ids in self._whole(others)), strict=True))
        for parts, held, at in zip(cut, out, gaps, strict=True):
            for k in at:
                held[k] = self.known[parts[k]]
        for x in others:
            del self.known[x]
        return [b"".join(held) for held in out]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


_ENCODERS: dict[tuple[str, int], Encoder] = {}
KEPT.append(_ENCODERS)


def encoder(path: str, most: int = KNOWN) -> Encoder:
    """One for each Python worker: loading takes longer than many texts. most: words that it keeps with their ids."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, most: int = KNOWN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    closing = np.asarray([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, most)
        for batch in in_slices(batches):
            whose, rows = [], []
            for i, ids in enumerate(enc.encode_batch([t or "" for t in batch.column("text").to_pylist()])):
                ids += closing
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = n % length or length if k == 0 else length
                    whose.append(i)
                    rows.append((k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(whose, pa.int32())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def minimum_slack_plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of bins, [(piece length, pieces of it in each bin)])] that uses up counts.

    Each bin holds the longest length left and, of all multisets of the others that fit beside it, a fullest one.
    """
    left, plan = {s: n for s, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        room = length - seed
        reach, mask, stages = 1, (1 << (room + 1)) - 1, []
        for size in sorted((s for s in left if s <= room), reverse=True):
            most = min(left[size] - (size == seed), room // size)
            if most <= 0:
                continue
            stages.append((size, reach))
            step = 1
            while most:
                take = min(step, most)
                reach |= (reach << (size * take)) & mask
                most -= take
                step *= 2
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        held = {seed: 1}
        for size, before in reversed(stages):
            while not before >> total & 1:
                held[size] = held.get(size, 0) + 1
                total -= size
        times = min(left[s] // m for s, m in held.items())
        plan.append((times, sorted(held.items(), reverse=True)))
        for s, m in held.items():
            left[s] -= times * m
            if not left[s]:
                del left[s]
    return plan


class Places:
    """From (length, rank) of a piece to its bin and offset. Rank runs over the pieces of one length."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = {}
        rows, bins = [], 0
        for times, held in plan:
            offset = 0
            for size, m in held:
                rows.append((size, used.get(size, 0), bins, m, offset))
                used[size] = used.get(size, 0) + times * m
                offset += size * m
            bins += times
        rows.sort()
        self.bins = bins
        self.size, self.first, self.bin, self.each, self.offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.size << 48) + self.first, (size << 48) + rank, side="right") - 1
        k = rank - self.first[at]
        return self.bin[at] + k // self.each[at], self.offset[at] + k % self.each[at] * size


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces (with a length each) with sequence_id and offset."""
    pieces = stored(pieces, "pieces")
    total = pieces.count()
    buckets = max(16, -(-total // IN_BUCKET))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row for each length
    places = Places(minimum_slack_plan(histogram, length))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    firsts = counts.select(F.col("length").alias("of"), F.col("bucket").alias("b"), before.alias("first"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(firsts, F.expr("length = of AND bucket = b")).withColumn("rank", F.col("rank") + F.col("first")).drop("of", "b", "first", "bucket")
    out = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins, offsets = places(batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64))
            yield batch[out].assign(sequence_id=bins, offset=offsets)

    kinds = dict(ranked.dtypes)
    return ranked.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in out) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, most: int = KNOWN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    most: words that a worker keeps with their ids, about 250 bytes each; fewer take time in place of memory.
    """
    return pack(cut(docs, path or tokenizer_path(), length, most=most), length)
