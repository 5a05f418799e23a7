"""License scans by diagonal voting, in DataFrame functions only.

Every run of k words of every text is hashed and joined with the runs of the templates. A hit votes for the
diagonal "place in the text - place in the template". Neighbouring diagonals are merged, so that words put in
or left out don't break a span, and spans are verified word by word against the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_join, table, text_of

#: The base phrases and their labels. A phrase counts where its words stand consecutively.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Notices that the method knows besides, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Whole license texts, and their labels.
BODIES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is "
        "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary "
        "or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd-2-clause",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
        "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any "
        "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
        "of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must "
        "not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be "
        "appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original "
        "software this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
)
#: Places of a template whose votes are the bits of one long; longer templates have several sections.
SECTION = 60
#: Ids up to which a counted table of row keys may be broadcast.
BROADCAST_KEYS = 500_000
#: A place of the join that every row passes once, for its own sake.
EVERY_ROW = -1


@dataclass(frozen=True)
class Scan:
    """phrase_words, notice_words: k for phrases and notices. gap: diagonals so near are merged. least: share of a
    notice's words that a span must hold; votes: share of its runs that must hit before a span is verified."""

    phrases: tuple[tuple[str, str], ...] = PHRASES
    notices: tuple[tuple[str, str], ...] = NOTICES + BODIES
    phrase_words: int = 2
    notice_words: int = 3
    gap: int = 3
    votes: float = 0.3
    least: float = 0.85

    def templates(self) -> list[tuple[int, bool, str, list[str]]]:
        """(number, is a phrase, label, words)."""
        rows = [(True, label, words.split()) for words, label in self.phrases] + [(False, label, words.split()) for words, label in self.notices]
        for phrase, label, words in rows:
            if len(words) < (self.phrase_words if phrase else self.notice_words):
                raise ValueError(f"the template of {label} has {len(words)} words")
        return [(i, *row) for i, row in enumerate(rows)]


def words_of(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null is empty.

    lower() changes other letters too, but never whether a character belongs to a word; the two characters that it
    would turn into ASCII letters are replaced first.
    """
    plain = F.replace(F.replace(text_of(text), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(plain), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _grams(words: Column, n: Column, k: int) -> Column:
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, runs).otherwise(F.array().cast("array<bigint>"))


def _template_tables(spark: SparkSession, scan: Scan) -> tuple[DataFrame, DataFrame]:
    """(gram, template, place) of all runs of all templates, and (template, phrase, label, words, runs). Fixed sizes."""
    rows = [
        F.struct(
            F.lit(i).alias("template"),
            F.lit(phrase).alias("phrase"),
            F.lit(label).alias("label"),
            F.split(F.lit(" ".join(words)), " ").alias("words"),
            F.lit(len(words) - (scan.phrase_words if phrase else scan.notice_words) + 1).alias("runs"),
        )
        for i, phrase, label, words in scan.templates()
    ]
    # literals of one task: a local list would come through a Python worker
    templates = spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    k = lambda phrase: _grams(F.col("words"), F.size("words"), scan.phrase_words if phrase else scan.notice_words)
    grams = templates.select("template", F.posexplode(F.when(F.col("phrase"), k(True)).otherwise(k(False))).alias("place", "gram"))
    every = spark.range(0, 1, 1, 1).select(F.lit(EVERY_ROW).cast("long").alias("gram"), F.lit(EVERY_ROW).alias("template"), F.lit(0).alias("place"))
    return grams.select("gram", "template", "place").union(every), templates


def license_spans(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """(doc_id, n_words, spans) of each row of docs (doc_id, text).

    spans: structs (phrase, label, start, end, coverage), words counted from 0, `end` behind the last; a phrase's
    have coverage 1, a notice's at least `least`. Repeated rows are scanned once and come back as often as they are;
    a null doc_id is kept. Texts without words have no spans. Other columns are ignored.
    """
    grams, templates = _template_tables(docs.sparkSession, scan)
    text = text_of("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), "doc_id", text).alias("k1"), F.xxhash64(F.lit(2), "doc_id", text).alias("k2"))
    worded = keyed.withColumn("words", words_of(F.col("text")))
    sized = worded.select("doc_id", "k1", "k2", "words", F.size("words").alias("n_words"))
    n = F.col("n_words")
    runs = F.concat(F.array(F.lit(EVERY_ROW).cast("long")), _grams(F.col("words"), n, scan.phrase_words), _grams(F.col("words"), n, scan.notice_words))
    rolled = sized.select("doc_id", "k1", "k2", "n_words", F.posexplode(runs).alias("at", "gram"))
    first = F.greatest(n - scan.phrase_words + 1, F.lit(0))
    place = F.when(F.col("at") <= first, F.col("at") - 1).otherwise(F.col("at") - 1 - first)
    hits = rolled.join(F.broadcast(grams), "gram")
    # a bit for each place of a template's section, so that repeated rows count once; the rows themselves are counted
    diagonal = F.when(F.col("template") == EVERY_ROW, 0).otherwise(place - F.col("place"))
    votes = hits.groupBy("k1", "k2", "template", diagonal.alias("diagonal"), F.floor(F.col("place") / SECTION).alias("section")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, place % {SECTION})")).alias("mask"), F.count("*").alias("copies"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words")
    )
    votes = table(votes, "votes")
    rows = votes.where(F.col("template") == EVERY_ROW).select("k1", "k2", "doc_id", F.col("n_words").cast("long").alias("n_words"), "copies")

    known = F.broadcast(templates)
    cast = votes.where(F.col("template") != EVERY_ROW).select("k1", "k2", "template", "diagonal", "section", "mask").join(known.drop("words"), "template")
    hit = F.sum(F.bit_count("mask")).alias("hit")
    phrases = cast.where("phrase").groupBy("k1", "k2", "template", "diagonal").agg(hit, F.first("runs").alias("runs"))
    phrases = phrases.where("hit = runs").select("k1", "k2", "template", F.array("diagonal").alias("diagonals"))
    by_diagonal = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > scan.gap).cast("int"), F.lit(0))
    merged = cast.where(~F.col("phrase")).withColumn("apart", apart).withColumn("span", F.sum("apart").over(by_diagonal))
    merged = merged.groupBy("k1", "k2", "template", "span", "section").agg(F.bit_or("mask").alias("mask"), F.first("runs").alias("runs"), F.collect_set("diagonal").alias("diagonals"))
    merged = merged.groupBy("k1", "k2", "template", "span").agg(hit, F.first("runs").alias("runs"), F.array_distinct(F.flatten(F.collect_list("diagonals"))).alias("diagonals"))
    notices = merged.where(F.col("hit") >= scan.votes * F.col("runs")).select("k1", "k2", "template", "diagonals")
    spans = phrases.union(notices).groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "diagonals")).alias("found"))
    spans = table(spans, "spans")

    # the words themselves, of the rows that have spans
    chosen = small_join(keyed.select("k1", "k2", "text"), spans, ["k1", "k2"], rows=BROADCAST_KEYS)
    chosen = chosen.select("k1", "k2", words_of(F.col("text")).alias("text_words"), F.explode("found").alias("f")).select("k1", "k2", "text_words", "f.template", "f.diagonals").join(known, "template")
    there = F.expr("filter(sequence(0, size(words) - 1), i -> exists(diagonals, d -> get(text_words, d + i) = words[i]))")
    checked = chosen.withColumn("there", there).where(F.size("there") > 0)
    coverage = F.size("there") / F.size("words")
    start = F.array_min("diagonals") + F.element_at("there", 1)
    end = F.array_max("diagonals") + F.element_at("there", -1) + 1
    checked = checked.where(F.when(F.col("phrase"), coverage == 1).otherwise(coverage >= scan.least))
    checked = checked.select("k1", "k2", F.struct("phrase", "label", start.cast("long").alias("start"), end.cast("long").alias("end"), coverage.alias("coverage")).alias("span"))
    verified = checked.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    # of notices that overlap, those with the largest coverage count
    better = "exists(spans, o -> not o.phrase and o.coverage > s.coverage and o.start < s.end and s.start < o.end)"
    verified = verified.withColumn("spans", F.expr(f"filter(spans, s -> s.phrase or s.coverage = 1 or not {better})"))
    out = rows.join(verified, ["k1", "k2"], "left")
    none = F.array().cast("array<struct<phrase:boolean,label:string,start:bigint,end:bigint,coverage:double>>")
    return out.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def license_labels(spans: DataFrame) -> DataFrame:
    """What license_spans() found in each row, as counts and labels: see op5."""
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))), ",")
    return spans.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
