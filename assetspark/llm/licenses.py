"""License scans by diagonal voting.

Every run of K neighbouring words of a text is hashed and joined with the places of the same run in the license
templates; K is 5, and the whole template where that is shorter, so a text is hashed for each K in use. A match at word
i of the text and word j of a template whose words are equal too votes for the diagonal i - j; votes of a diagonal are
summed and diagonals within a template's slack merge into one span. A span is verified word by word: the words of the
template that its matches hold, each counted once, have to be a least share of the template. Phrases of the base list
have no slack and are one run, so their spans are exact occurrences.

Only matches leave the scan; the templates are a fixed list and are broadcast. Null texts count as empty. Every row
has its result: rows that repeat a doc_id, or have none, are told apart by their texts, and equal rows repeat the
result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetspark.llm.common import ascii_lower

#: What separates words, in a text without A-Z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False
    slack: int = 2
    least: float = 0.75


#: The base phrases, then the texts and notices of common licenses.
TEMPLATES = (
    Template("cc-by", "cc by", True, 0, 1.0),
    Template("gpl", "general public license", True, 0, 1.0),
    Template("reserved", "all rights reserved", True, 0, 1.0),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "released under the bsd license"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license"),
    Template("gpl", "licensed under the gnu general public license version"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "creative commons attribution 4 0 international"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("proprietary", "this document is confidential and proprietary"),
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""", slack=8, least=0.5),
    Template("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
        and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
        from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""", slack=8, least=0.5),
    Template("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not
        limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for
        any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or
        business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the
        use of this software even if advised of the possibility of such damage""", slack=8, least=0.5),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", slack=3, least=0.6),
    Template("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""", slack=8, least=0.5),
    Template("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general
        public license along with this program if not see""", slack=8, least=0.5),
    Template("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at""", slack=4, least=0.5),
    Template("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an
        acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being
        the original software this notice may not be removed or altered from any source distribution""", slack=8, least=0.5),
    Template("cc0", """to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work""", slack=4, least=0.5),
    Template("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
        either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", slack=6, least=0.5),
)
#: Words of a run, where the template has as many.
K = 5


def grams(template: Template) -> tuple[int, list[str]]:
    """The template's run length and words."""
    words = template.words.split()
    return min(K, len(words)), words


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """One row per run of each template. Its size is that of the template list."""
    rows = [(i, t.label, t.base, t.slack, float(t.least), k, w[p : p + k], p, len(w)) for i, t in enumerate(templates) for k, w in [grams(t)] for p in range(len(w) - k + 1)]
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, slack int, least double, k int, held array<string>, tpos int, tlen int")
    gram = F.coalesce(*(F.when(F.col("k") == k, _fold([F.xxhash64(F.get("held", i)) for i in range(k)])) for k in sorted({grams(t)[0] for t in templates})))
    return frame.withColumn("gram", gram)


def _fold(hashes):
    out = hashes[0]
    for h in hashes[1:]:
        out = F.xxhash64(out, h)
    return out


def votes(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, text_hash, n_words with each template position that a run of words matches, and one row without for each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.filter(F.split(ascii_lower(text), GAPS), lambda w: w != "").alias("words"))
    words = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lengths = sorted({grams(t)[0] for t in templates})
    # Runs of k words extend runs of k - 1 by the next word's hash; past the last word they are null.
    rolled = {1: F.col("hashes")}
    for k in range(2, max(lengths) + 1):
        words = words.withColumn(f"run{k}", F.zip_with(rolled[k - 1], F.slice("hashes", F.lit(k), F.greatest(F.size("hashes"), F.lit(1))), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))))
        rolled[k] = F.col(f"run{k}")
    every = F.arrays_zip(*(rolled[k].alias(f"g{k}") for k in lengths))
    runs = words.select("doc_id", "text_hash", "words", F.size("words").alias("n_words"), F.posexplode_outer(every).alias("pos", "g"))
    runs = runs.select("doc_id", "text_hash", "words", "n_words", "pos", F.explode(F.array(*(F.col(f"g.g{k}") for k in lengths), F.when(F.coalesce("pos", F.lit(0)) == 0, F.lit(OWN)))).alias("gram")).filter("gram IS NOT NULL")
    known = template_grams(docs.sparkSession, templates)
    own = docs.sparkSession.createDataFrame([(OWN,)], "gram long")
    joined = runs.join(F.broadcast(known.unionByName(own, allowMissingColumns=True)), "gram")
    return joined.filter(F.col("template").isNull() | (F.slice("words", F.coalesce("pos", F.lit(0)) + 1, F.coalesce("k", F.lit(1))) == F.col("held"))).drop("words", "gram", "held")


#: Stands for a text itself among the runs of its first word.
OWN = 0


def spans_of(voted: DataFrame) -> DataFrame:
    """Votes summed by diagonal, neighbouring diagonals merged, verified: one row per span, and one per text with a null label.

    first is the word of the text at which the template starts, coverage the share of its words that the span holds;
    of the row of a text, n_held is the number of equal rows.
    """
    text = ["doc_id", "text_hash", "n_words"]
    one = ["template", "label", "base", "slack", "least", "k", "tlen"]
    diagonals = voted.groupBy(*text, *one, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("held"), F.count("*").alias("n_rows"))
    by = Window.partitionBy(*text, "template").orderBy("diagonal")
    near = F.coalesce((F.col("slack") > 0) & (F.col("diagonal") - F.lag("diagonal").over(by) <= F.col("slack")), F.lit(False))
    merged = diagonals.withColumn("near", near).withColumn("span", F.sum(F.when(F.col("near"), 0).otherwise(1)).over(by))
    spans = merged.groupBy(*text, *one, "span").agg(F.max_by("diagonal", F.struct(F.size("held"), -F.col("diagonal"))).alias("first"), F.flatten(F.collect_list("held")).alias("held"), F.max("n_rows").alias("n_rows"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("held", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    spans = spans.withColumn("n_held", F.when(F.col("template").isNull(), F.col("n_rows")).otherwise(covered)).withColumn("coverage", F.when(F.col("template").isNotNull(), F.col("n_held") / F.col("tlen")))
    return spans.filter(F.col("template").isNull() | (F.col("coverage") >= F.col("least"))).withColumn("first", F.greatest("first", F.lit(0))).drop("held", "n_rows")


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: words, places of base phrases, first and last of them, labels, the best coverage as score."""
    base = F.when(F.col("base"), F.col("first").cast("long"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = spans_of(votes(docs)).groupBy("doc_id", "text_hash", "n_words").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"), F.max(F.when(F.col("template").isNull(), F.col("n_held"))).alias("n_rows"),
    )
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
