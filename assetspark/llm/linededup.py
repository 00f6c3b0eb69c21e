"""Repeated runs of lines, found by winnowing over line hashes.

Lines with words form a document's sequence. A window is a shortest run of lines with RUN words or more: a line with as
many, or some short ones together. The line of least hash in a window is its fingerprint, so whatever repeats RUN words
of whole lines has the same fingerprint at both places; the chosen positions alone are looked at first, and fingerprints
that occur at one position only are dropped. The positions that remain are joined and their matches extended both ways:
to the windows around them, which begin or end at each line, and of which two are the same run where all their lines
are. A window whose lines stand at an earlier place is a later repetition, and its lines are deleted. Windows overlap,
so together they cover runs of any length.

Lines are compared by two independent 64-bit hashes. Reading order is doc_id, then line. Blank lines belong to no run
and go only with a document's last line. Null and empty texts have no lines and stay as they are, as do rows without
doc_id. Rows that repeat a doc_id are read in the order of their texts' hashes; of equal rows each is judged like the
first. Other columns pass through unchanged, but for those named like the counts that are added, which they replace.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetspark.llm.common import dropped, stored

#: Words of the shortest run that counts as a repetition.
RUN = 3
#: More than the lines of a window.
SPANS = 1 << 20


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]++"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text) and lines: array of (at, words, h, g) of the lines with words, h and g their hashes."""
    split = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("at"), _words(line).alias("words"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")))
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.select("doc_id", F.xxhash64("text").alias("tie"), F.filter(split, lambda line: line["words"] > 0).alias("lines"))


def _reach(lines: Column, run: int) -> Column:
    """For each line, how many lines from it on hold run words; null where the rest has too few. Every line has a word."""

    def grow(acc, line):
        return F.when(acc["words"] >= run, acc).otherwise(F.struct((acc["words"] + line["words"]).alias("words"), (acc["n"] + 1).alias("n")))

    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    reached = F.transform(lines, lambda line, i: F.when(line["words"] >= run, F.struct(line["words"].alias("words"), F.lit(1).alias("n"))).otherwise(F.aggregate(F.slice(lines, i + 1, run), start, grow)))
    return F.transform(reached, lambda r: F.when(r["words"] >= run, r["n"]))


def windows_of(lines: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, tie and windows: array of (first, last, h, g, chosen, print): the lines' numbers, the hashes of all its lines, the fingerprint's line and hash."""
    # Turned once, as a column: inside the transforms below it would be turned for each line.
    lines = lines.withColumn("turned", F.reverse("lines"))
    every = F.col("lines")
    # Where each line is a window of its own there is nothing to grow.
    alone = F.transform(every, lambda x: F.struct(x["at"].alias("first"), x["at"].alias("last"), x["h"].alias("h"), x["g"].alias("g"), x["at"].alias("chosen"), x["h"].alias("print")))
    # A span is its first line and its number of lines in one number, whose repetitions are found by hashing.
    span = lambda i, n: i.cast("long") * SPANS + n
    ahead = F.transform(_reach(every, run), lambda n, i: span(i, n))
    behind = F.transform(F.reverse(_reach(F.col("turned"), run)), lambda n, i: span(i - n + 1, n))
    spans = F.filter(F.array_distinct(F.concat(ahead, behind)), lambda w: w.isNotNull())

    def window(held):
        """The window of lines held. Of one line it has that line's hashes, so it meets those of `alone`."""
        least = F.array_min(F.transform(held, lambda line: F.struct(line["h"].alias("print"), line["at"].alias("chosen"))))
        whole = [F.when(F.size(held) == 1, F.get(held, 0)[c]).otherwise(F.xxhash64(held[c])).alias(c) for c in ("h", "g")]
        return F.struct(F.get(held, 0)["at"].alias("first"), F.get(held, F.size(held) - 1)["at"].alias("last"), *whole, least["chosen"].alias("chosen"), least["print"].alias("print"))

    grown = F.transform(F.transform(spans, lambda w: F.slice(F.col("lines"), F.floor(w / SPANS).cast("int") + 1, (w % SPANS).cast("int"))), window)
    return lines.select("doc_id", "tie", F.when(F.forall(every, lambda x: x["words"] >= run), alone).otherwise(grown).alias("windows"))


def repeated_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, tie, gone: for each document with lines that repeat earlier ones, the numbers of those lines."""
    # explode would have the windows computed once more by a filter on their number.
    every = windows_of(lines_of(docs), run).select("doc_id", "tie", F.explode_outer("windows").alias("w")).filter("w IS NOT NULL")
    windows = stored(every.select("doc_id", "tie", "w.*"), "windows")
    # A fingerprint at one position can't be part of a repetition.
    place = F.struct("doc_id", "tie", "chosen")
    shared = stored(windows.groupBy("print").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo < hi").select("print"), "prints")
    # The positions of the others extend to the windows around them, and these meet by all their lines.
    place = F.struct("doc_id", "tie", "first")
    extended = windows.join(shared, "print", "left_semi").select("doc_id", "tie", "first", "last", "h", "g")
    firsts = stored(extended.groupBy("h", "g").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).filter("earliest < latest").select("h", "g", "earliest"), "firsts")
    later = extended.join(firsts, ["h", "g"]).filter(place > F.col("earliest"))
    lines = later.select("doc_id", "tie", F.explode(F.sequence("first", "last")).alias("at")).groupBy("doc_id", "tie").agg(F.collect_set("at").alias("gone"))
    # The numbers take a small part of the windows' disk, which is free again before the texts travel.
    gone = stored(lines, "gone")
    dropped(windows, shared, firsts)
    return gone


def dedup_lines(docs: DataFrame, run: int = RUN, spare: int = 0) -> DataFrame:
    """docs with text less the lines of later repeated runs, and n_lines, n_deleted (lines with words).

    A text of fewer than `spare` words that would lose all its lines stays as it is.
    """
    gone = repeated_lines(docs, run).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("gone").alias("__gone"))
    # Texts travel as their lines: split once, before the shuffle.
    held = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__lines", F.split("text", "\n", -1)).drop("text")
    held = held.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__tie")), "left")
    held = held.withColumn("__gone", F.filter("__gone", lambda i: _worded(F.get(F.col("__lines"), i))))
    if spare:
        whole = (F.size("__gone") == F.size(F.filter("__lines", _worded))) & (_words(F.array_join("__lines", " ")) < spare)
        held = held.withColumn("__gone", F.when(~F.coalesce(whole, F.lit(False)), F.col("__gone")))
    staying = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    held = held.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.transform(staying, lambda i: F.get(F.col("__lines"), i))).otherwise(F.col("__lines")))
    held = held.withColumn("n_lines", F.coalesce(F.size(F.filter("__lines", _worded)), F.lit(0))).withColumn("n_deleted", F.when(F.col("__gone").isNotNull(), F.size("__gone")).otherwise(0))
    text = F.when((F.col("n_deleted") > 0) & (F.col("n_deleted") == F.col("n_lines")), F.lit("")).otherwise(F.array_join("__kept", "\n"))
    return held.withColumn("text", text).drop("__id", "__tie", "__gone", "__hash", "__lines", "__kept").select(*(c for c in docs.columns if c not in ("n_lines", "n_deleted")), "n_lines", "n_deleted")


def _worded(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document: lines with words, how many of them repeat earlier runs, the text that stays and its digest."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
