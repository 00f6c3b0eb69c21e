"""Document fingerprints from spot signatures.

A common word anchors a signature: the chain of the next CHAIN content words after it, skipping other common words. A
text's fingerprint is the set of its signatures, hashed to 40 bits each. Sets are compared by Jaccard similarity,
pruned: a set of n signatures falls in length partition floor(log n / log 1/least), two sets whose partitions are
neither equal nor neighbours or whose lengths alone keep them under `least` count as 0 without a look at their
elements. In the join (near_pairs) sets are dealt to their partition and the next, and meet there through the
signatures of a prefix that similar sets must share.

A text in which no common word is followed by another word has no spot: its chains begin at each of its words, and a
text without words is one signature of its own; a null or empty text has none.
All of it is DataFrame operations. Every row has its result: rows without doc_id stand after the others, rows that
repeat a doc_id in the order of their texts' hashes, and equal rows have equal results. An empty table gives an empty
result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetspark.llm.common import ascii_lower, partitions, settle, stored

CHAIN = 3
BLOCK = 1024
#: Likeness under which two fingerprints count as unlike.
LEAST = 0.05
#: Hexadecimal digits of a signature.
DIGITS = 10
#: The common words of four languages that anchor signatures.
ANCHORS = (
    "the of and to in is that for it was on with as are be this by from at an a or not which have has had will would can "
    "le la les de des et un une du en que qui dans pour par sur est au avec pas ce se ne il elle on nous vous "
    "der die das und den von zu mit ist des im für auf nicht ein eine dem sich auch als an werden aus er hat dass sie nach wird bei "
    "el los las y por con su para al lo como más pero sus una del no es se ha o este sí porque"
).split()
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAPS), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """df with out: the sorted set of the text's hashed signatures, array<long>."""
    w, c, a = f"__{out}_w", f"__{out}_c", f"__{out}_a"
    df = df.withColumn(w, words(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(c, F.filter(w, lambda x: ~x.isin(ANCHORS)))
    # Places in the content words at which a chain begins: after a common word, its place less the common words before it.
    begins = F.transform(F.filter(F.transform(w, lambda x, i: F.when(x.isin(ANCHORS), i)), lambda i: i.isNotNull()), lambda i, j: i - j)
    df = df.withColumn(a, F.filter(F.array_distinct(begins), lambda i: i < F.size(c)))
    short = lambda h: h.bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))
    link = lambda at: short(F.xxhash64(*(F.coalesce(F.get(F.col(c), at + k), F.lit("")) for k in range(chain))))
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.when(whole == "", F.array().cast("array<long>")).otherwise(F.array(short(F.xxhash64(whole))))
    begun = F.when(F.size(a) > 0, F.col(a)).otherwise(F.transform(c, lambda x, i: i))
    chosen = F.when(F.size(c) > 0, F.transform(begun, link)).otherwise(bare)
    return df.withColumn(out, F.sort_array(F.array_distinct(chosen))).drop(w, c, a)


def as_text(signatures: Column) -> Column:
    """The fingerprint as text: its signatures in DIGITS hexadecimal digits each, in order."""
    return F.array_join(F.transform(signatures, lambda h: F.lpad(F.hex(h), DIGITS, "0")), "")


def partition_of(n: Column, least: float) -> Column:
    """The length partition of a set of n signatures. Sets of compatible lengths are in the same one or in neighbours."""
    return F.floor(F.log(n.cast("double")) / math.log(1 / least))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty sets are alike, an empty and another are not."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def pruned_jaccard(a: Column, b: Column, least: float) -> Column:
    """Similarity where it reaches least, or else 0: without looking at the elements where partitions or lengths rule it out."""
    na, nb = F.size(a), F.size(b)
    near = (na == 0) & (nb == 0) | (na > 0) & (nb > 0) & (F.abs(partition_of(na, least) - partition_of(nb, least)) <= 1)
    reachable = near & (F.least(na, nb) >= F.lit(least) * F.greatest(na, nb))
    found = F.when(reachable, jaccard(a, b)).otherwise(0.0)
    return F.when(found >= least, found).otherwise(0.0)


def index_groups(sets: DataFrame, least: float) -> DataFrame:
    """sig, band, lo, hi, block, doc_id, n, at: the sets whose prefixes share a signature in a length partition.

    Groups of more than BLOCK sets are dealt in hashed blocks, every two of which meet in one place.
    """
    sets = stored(sets, "sets")
    df = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    postings = sets.select("doc_id", "n", F.explode("sigs").alias("sig")).join(df, "sig")
    order = Window.partitionBy("doc_id").orderBy("df", "sig")
    prefix = postings.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1).filter("df > 1")
    band = partition_of(F.col("n"), least)
    prefix = prefix.withColumn("band", F.explode(F.array(band, band + 1)))
    held = prefix.groupBy("sig", "band").agg(F.count("*").alias("held")).filter("held > 1")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = prefix.join(held, ["sig", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("sig", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "n", "at")


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b, similarity: pairs of representatives of equal fingerprints (least doc_id) that reach least; with classes().

    Sets of n signatures fall in length partition floor(log n / log 1/least) and the next one up: two sets of compatible
    lengths share one. Inside it they meet by the signatures of their prefix in order of rarity, which similar sets share.
    """
    sets = classes(docs).filter("representative = doc_id AND n > 0").select("doc_id", "sigs", "n")
    groups, place = index_groups(sets, least), ["sig", "band", "lo", "hi"]
    a = groups.select(*place, F.col("block").alias("ba"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    b = groups.select(*place, F.col("block").alias("bb"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    possible = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    pairs = a.join(b, place).filter("a < b AND (ba <> bb OR lo = hi)").filter(F.least("na", "nb") >= least * F.greatest("na", "nb")).filter(possible >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb"))
    return pairs.join(x, "a").join(y, "b").withColumn("similarity", pruned_jaccard(F.col("sa"), F.col("sb"), least)).filter(F.col("similarity") >= least).select("a", "b", "similarity")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, sigs, n and the least doc_id with the same fingerprint as representative."""
    sets = with_signatures(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"), "text", "sigs").withColumn("n", F.size("sigs")).withColumn("key", F.md5(as_text(F.col("sigs"))))
    first = sets.groupBy("key").agg(F.min("doc_id").alias("representative"))
    return sets.join(first, "key").select("doc_id", "sigs", "n", "representative")


KEY = ("absent", "id", "tie")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of their order: rows without doc_id last, then doc_id, then the hash of the text."""
    return docs.withColumns({"absent": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "tie": F.xxhash64(F.coalesce("text", F.lit("")))})


def neighbours(keys: DataFrame) -> DataFrame:
    """keys, n with the key before each and its n: prev, prev_n; before the first comes the last.

    Keys are dealt to ranges; each range looks up its neighbours in itself and at its ends the last key of the range
    before, of which there are as many as partitions.
    """
    ranged = settle(keys.repartitionByRange(partitions(keys.sparkSession), *KEY).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*KEY)
    one = F.struct(*KEY, "n")
    ends = ranged.groupBy("part").agg(F.max(one).alias("last"))
    around = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("last").over(around), F.max("last").over(Window.partitionBy())).alias("before"))
    out = ranged.withColumn("prev", F.lag(one).over(inside)).join(F.broadcast(ends), "part")
    return out.select(*KEY, F.coalesce("prev", "before").alias("prev"))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike it is to that and to the next document.

    The edited text has its last quarter of code points replaced by as many first ones of the next document. Signatures
    are taken once and travel with the texts, which are shuffled once, by key; a document then sends its first code
    points and its fingerprint to the one before.
    """
    known = keyed(docs.select("doc_id", "text")).withColumn("text", F.coalesce("text", F.lit(""))).drop("doc_id")
    before = neighbours(known.groupBy(*KEY).agg(F.max(F.length("text")).alias("n")))
    rows = with_signatures(known, "text", "sigs").repartition(*KEY)
    to = [F.col(f"prev.{k}").alias(f"to_{k}") for k in KEY]
    sent = rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.first("sigs").alias("sigs")).join(before, list(KEY))
    sent = sent.select(*to, F.expr("left(text, cast(prev.n div 4 as int))").alias("head"), F.col("sigs").alias("next_sigs"))
    both = rows.join(sent, [rows[k] == sent[f"to_{k}"] for k in KEY]).withColumn("n_chars", F.length("text"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, n_chars - cast(n_chars div 4 as int))"), "head")).drop("text", "head")
    both = with_signatures(both.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sigs")
    return both.select(
        F.when(~F.col("absent"), F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("sigs"), F.col("edited_sigs"), LEAST).alias("near_edited"), pruned_jaccard(F.col("sigs"), F.col("next_sigs"), LEAST).alias("near_next"),
    )
