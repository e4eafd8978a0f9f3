"""License scan: an exact set-similarity join of text blocks with license templates, in SQL functions only.

Templates fall into two classes by length (``SHORT`` words), L being the longest of a class.  A text is cut into blocks
for each class: windows of 2L words at steps of L, so any L consecutive words lie whole in some block.  A block matches
a template when it holds at least the template's threshold share of the template's distinct words (containment); base
phrases are templates with threshold 1 whose words must also stand consecutively.

The join is exact.  The templates' words are ordered by their frequency over the whole corpus, rarest first, and so are
those of them that a block holds, V.  A block that meets threshold t holds alpha = ceil(t * |T|) words of T, so the
rarest word that they share is one of T's |T| - alpha + 1 rarest and of V's |V| - alpha + 1 rarest (prefix filter); V
has alpha words or more (length filter); and if that word stands at place i of T and j of V, the overlap is at most
min(|T| - i, |V| - j), which must be alpha or more (positional filter).  Survivors are verified.

Template words are few, so their counts (not the corpus's) come to the driver and the prefix table is broadcast:
its size depends on the templates given alone.  Blocks are keyed by (doc_id, digest of the text), so repeated rows
and repeated ids are safe; equal keys have equal texts, hence equal matches.  Null texts count as empty and match
nothing; very long texts are dealt as rows of ``SEGMENT`` words and a block more; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words up to which a template is of the short class, and words of a text that are dealt as one row.
SHORT, SEGMENT = 64, 4096


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    threshold: float
    phrase: bool = False


def _template(label: str, text: str, threshold: float = 0.8) -> Template:
    return Template(label, tuple(text.split()), threshold)


#: The phrases that the contract names.
PHRASES = (
    Template("mit", ("under", "the", "mit", "license"), 1.0, True),
    Template("apache-2", ("apache", "license", "version", "2"), 1.0, True),
    Template("cc-by-nc", ("cc", "by", "nc"), 1.0, True),
)
#: Opening sentences of public licenses and notices, as words.
NOTICES = (
    _template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    _template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    _template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    _template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    _template("cc-by", "this work is licensed under a creative commons attribution international license"),
    _template("unlicense", "this is free and unencumbered software released into the public domain"),
    _template("boost", "distributed under the boost software license version 1 0"),
)
#: Whole texts of public licenses, as words.
LICENSES = (
    _template("mit", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
        without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages
        or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
        software"""),
    _template("bsd", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source
        code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
        this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
        merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
        interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of
        the use of this software even if advised of the possibility of such damage"""),
    _template("isc", """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever
        resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software"""),
    _template("zlib", """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this
        software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to
        the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in
        a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not
        be misrepresented as being the original software this notice may not be removed or altered from any source distribution"""),
    _template("unlicense", """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in
        source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain"""),
)
TEMPLATES = PHRASES + NOTICES + LICENSES


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with letters lower-cased; none for null.  Lower-casing
    beyond A-Z changes no word that a template holds: of all other letters only the Kelvin sign becomes one of a-z."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(lower, SPLIT), "")


def classes(templates: tuple[Template, ...]) -> dict[int, list[int]]:
    """Longest length to the numbers of the templates, for the short and the long ones."""
    sides = ([k for k, t in enumerate(templates) if (len(t.words) <= SHORT) == short] for short in (True, False))
    return {max(len(templates[k].words) for k in side): side for side in sides if side}


def frequencies(df: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts of the whole corpus each vocabulary word stands."""
    terms = F.array(*(F.lit(w) for w in vocabulary))
    found = df.select(F.explode(F.array_intersect(words(F.col(text_col)), terms)).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def prefixes(templates: tuple[Template, ...], count: dict[str, int]) -> tuple[list[str], list[tuple]]:
    """The vocabulary, rarest first, and the prefix table: (length of the class, word, template, place, label, alpha,
    distinct words, words, phrase)."""
    ranked = sorted({w for t in templates for w in t.words}, key=lambda w: (count.get(w, 0), w))
    rank, table = {w: i for i, w in enumerate(ranked)}, []
    for longest, members in classes(templates).items():
        for k in members:
            t = templates[k]
            ordered = sorted(set(t.words), key=rank.__getitem__)
            alpha = math.ceil(t.threshold * len(ordered) - 1e-9)
            table += [(longest, w, k, i, t.label, alpha, len(ordered), list(t.words), t.phrase) for i, w in enumerate(ordered[: len(ordered) - alpha + 1])]
    return ranked, table


def candidates(df: DataFrame, templates: tuple[Template, ...], count: dict[str, int], doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, template) pairs that pass the three filters, more than once where several words let them: doc, digest,
    start, block, own (V, rarest first), place_v, and the columns of the prefix table."""
    ranked, rows = prefixes(templates, count)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rare = F.array(*(F.lit(w) for w in sorted({r[1] for r in rows})))
    docs = df.select(F.col(doc_col).alias("doc"), F.md5(text).alias("digest"), words(text).alias("words")).where(F.arrays_overlap("words", rare))

    def dealt(longest: int) -> Column:
        least, step = min(r[5] for r in rows if r[0] == longest), longest * max(1, SEGMENT // longest)
        facts = [F.lit(longest).alias("longest"), F.lit(step).alias("step"), F.lit(least).alias("least")]
        begins = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))
        return F.transform(begins, lambda at: F.struct(*facts, at.alias("at"), F.slice("words", at + 1, step + longest).alias("words")))

    segments = docs.select("doc", "digest", F.explode(F.concat(*map(dealt, classes(templates)))).alias("s")).select("doc", "digest", "s.*").where(F.arrays_overlap("words", rare))
    starts = F.sequence(F.lit(0), F.greatest(F.least(F.col("step"), F.size("words")) - 1, F.lit(0)), F.col("longest"))
    cut = F.transform(starts, lambda i: F.struct((F.col("at") + i).alias("start"), F.slice("words", i + 1, 2 * F.col("longest")).alias("block")))
    blocks = segments.select("doc", "digest", "longest", "least", F.explode(cut).alias("b")).select("doc", "digest", "longest", "least", "b.*").where(F.arrays_overlap("block", rare))
    owned = blocks.withColumn("own", F.array_intersect(F.array(*(F.lit(w) for w in ranked)), "block")).where(F.size("own") >= F.col("least"))
    probes = owned.select("doc", "digest", "longest", "start", "block", "own", F.posexplode(F.slice("own", 1, F.size("own") - F.col("least") + 1)).alias("place_v", "w"))
    table = df.sparkSession.createDataFrame(rows, "longest int, w string, template int, place int, label string, alpha int, length int, terms array<string>, phrase boolean")
    near = probes.join(F.broadcast(table), ["longest", "w"])
    return near.where((F.size("own") >= F.col("alpha")) & (F.least(F.col("length") - F.col("place"), F.size("own") - F.col("place_v")) >= F.col("alpha")))


def matches(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct (doc_id, text) and template that meet: doc, digest, template (its number), label,
    containment (largest over blocks), starts (sorted word numbers, of phrases only)."""
    count = frequencies(df, text_col, sorted({w for t in templates for w in t.words}))
    near = candidates(df, templates, count, doc_col, text_col)
    shared = F.size(F.array_intersect("own", "terms"))
    begins = F.filter(F.transform("block", lambda _, i: i), lambda i: (i < F.col("longest")) & (F.slice("block", i + 1, F.size("terms")) == F.col("terms")))
    found = (
        near.withColumn("shared", shared)
        .where(F.col("shared") >= F.col("alpha"))
        .withColumn("begins", F.when(F.col("phrase"), F.transform(begins, lambda i: F.col("start") + i)).otherwise(F.array().cast("array<int>")))
        .where(~F.col("phrase") | (F.size("begins") > 0))
    )
    return found.groupBy("doc", "digest", "template", "label").agg(
        F.max(F.col("shared") / F.col("length")).alias("containment"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("begins")))).alias("starts")
    )


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with n_words, n_base (long: places of phrases), first_word, last_word (their smallest and largest start;
    null without one), base_labels, labels (distinct, sorted, comma-joined; empty without one), score (the largest
    containment met, 0 without one).  Columns of ``df`` with these names are replaced; all others stay."""
    phrase = F.col("template").isin([k for k, t in enumerate(templates) if t.phrase])
    by_text = (
        matches(df, templates, doc_col, text_col)
        .groupBy("doc", "digest")
        .agg(
            F.sum(F.size("starts")).alias("n"),
            F.min(F.array_min("starts")).alias("first"),
            F.max(F.array_max("starts")).alias("last"),
            F.array_join(F.sort_array(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.max("containment").alias("score"),
        )
        .select(F.struct("doc", "digest").alias("_found"), F.struct("n", "first", "last", "base", "labels", "score").alias("_facts"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    new = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    kept = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in df.columns if c not in new))
    rows = df.select(kept.alias("_row"), F.struct(F.col(doc_col).alias("doc"), F.md5(text).alias("digest")).alias("_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    out = rows.join(by_text, F.col("_key.doc").eqNullSafe(F.col("_found.doc")) & (F.col("_key.digest") == F.col("_found.digest")), "left")
    fact = lambda name: F.col(f"_facts.{name}")
    return out.select(
        *(F.col(f"_row.`{c}`") for c in df.columns if c not in new), "n_words", F.coalesce(fact("n"), F.lit(0)).cast("long").alias("n_base"), fact("first").cast("long").alias("first_word"), fact("last").cast("long").alias("last_word"),
        F.coalesce(fact("base"), F.lit("")).alias("base_labels"), F.coalesce(fact("labels"), F.lit("")).alias("labels"), F.coalesce(fact("score"), F.lit(0.0)).alias("score"),
    )
