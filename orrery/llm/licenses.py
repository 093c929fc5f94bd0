"""License scans by diagonal voting.

Base: the places of fixed phrases among a text's words. Method: all rolling 3-word grams of the
texts are named by hashes and joined to the positions of the same grams in license templates. A
match votes for its diagonal, the text position minus the template position; a copied template
gives many votes on one diagonal, one with added, misspelled or left out words on a few neighbouring ones.
Neighbouring diagonals are merged to spans, and a span counts if it is about as long as the
template, holds enough of its words in the template's order (their longest common subsequence), holds all
words that tell the license from its kin, and none that tell of another one. Short notices have
templates too, so that a misspelled one gets the label that the phrases miss, and a version or a restriction its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.vectors import let
from orrery.plans.storage import cut, small_side

# Phrases of the base, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Wording of common notices (quoted from the licenses), each with its label, the words
# that a span must hold, and words that it must not hold.
TEMPLATES = (
    ("mit", "", "", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "mit", "", "released under the mit license"),
    ("apache", "", "", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "", "", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "apache 2", "", "licensed under the apache license version 2 0"),
    ("gpl", "general", "lesser affero", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "gnu 2", "lesser affero", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "gnu 3", "lesser affero", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "lesser", "", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero", "", "this work is licensed under the gnu affero general public license version 3"),
    ("bsd", "", "", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "", "", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "attribution", "sharealike noncommercial noderivatives noderivs", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "attribution sharealike", "noncommercial", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "attribution noncommercial", "sharealike noderivatives noderivs", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "cc by", "nc nd sa", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc sa", "nc", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc nd", "nc", "licensed under cc by nd 4 0"),
    ("cc-by-nc", "cc nc", "nd sa", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "cc nc sa", "", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc nc nd", "", "licensed under cc by nc nd 4 0"),
    ("isc", "", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "mozilla", "", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "", "", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
GRAM = 3
#: Diagonals of one span lie at most this far apart, each from the next; in short templates a third of their words.
SLACK = 6
#: Least share of a template's words in a span, in their order; the share for templates of up to SHORT words; the
#: most words of a span per template word.
COVERAGE, SHORT_COVERAGE, SHORT, STRETCH = 0.6, 0.75, 14, 1.5
#: Words of a template at most: one bit of a long for each.
TEMPLATE_WORDS = 62

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """A-Z lower-cased, then maximal runs of a-z, 0-9 and characters from U+0080 on. The two other
    characters whose lower case holds an ASCII letter (U+0130, U+212A) stay outside ASCII."""
    plain = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(plain, _BREAK), lambda w: w != "")


def grams(words: Column) -> Column:
    """64-bit names of the GRAM-word grams of an array of words, which is bound once: it is computed
    once however often the expression refers to it."""
    starts = lambda w: F.slice(w, 1, F.greatest(F.size(w) - (GRAM - 1), F.lit(0)))
    return let(words, lambda w: F.transform(starts(w), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, GRAM)])))


def _places(words: Column, text: Column, phrase: str) -> Column:
    """Starts (from 0) of a phrase among the words; texts without its rarest word are not walked."""
    parts = phrase.split()
    rare = "cc" if "cc" in parts else "license"
    last = F.size(words) - len(parts)
    at = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    found = F.filter(F.sequence(F.lit(0), last), at)
    return F.when((last >= 0) & F.contains(F.lower(text), F.lit(rare)), found).otherwise(F.array().cast("array<int>"))


def template_table(spark: SparkSession) -> DataFrame:
    """(template, label, need, ban, words, masks) for each template: a small fixed table. masks maps a
    word to its places, a bit for each."""

    def masks(words: list[str]) -> Column:
        bits = {w: sum(1 << i for i, x in enumerate(words) if x == w) for w in words}
        return F.create_map(*[F.lit(x) for item in bits.items() for x in item]).cast("map<string,long>")

    def entry(i: int, label: str, need: str, ban: str, words: list[str]) -> Column:
        if len(words) > TEMPLATE_WORDS:
            raise ValueError(f"template {i} has over {TEMPLATE_WORDS} words")
        names = lambda x: F.array(*[F.lit(w) for w in x]).cast("array<string>")
        return F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), names(need.split()).alias("need"), names(ban.split()).alias("ban"), names(words).alias("words"), masks(words).alias("masks"))

    entries = F.array(*[entry(i, label, need, ban, text.split()) for i, (label, need, ban, text) in enumerate(TEMPLATES)])
    return spark.range(1).select(F.explode(entries).alias("t")).select("t.*")


def in_order(words: Column, masks: Column) -> Column:
    """Length of the longest common subsequence of an array of words and a template (bit-parallel: a
    zero in the state for each template word matched so far)."""
    full = F.expr(f"shiftleft(1L, {TEMPLATE_WORDS}) - 1").cast("long")

    def step(v: Column, w: Column) -> Column:
        return let(F.coalesce(F.try_element_at(masks, w), F.lit(0).cast("long")), lambda m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full))

    return F.lit(TEMPLATE_WORDS) - F.bit_count(F.aggregate(words, full, step))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (1 with a base
    label, else the best verified coverage of a template, else 0) for each row of ``docs`` (doc_id, text).

    Null and empty texts have no words and no labels. Rows that repeat doc_id and text get equal
    results; rows without a doc_id are told apart by their texts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    words = docs.select("doc_id", "text").withColumns({"th": F.xxhash64("text"), "words": license_words(F.col("text"))})
    templates = template_table(spark)
    placed = templates.select("template", F.size("words").alias("size"), F.posexplode(grams(F.col("words"))).alias("tpos", "g"))
    # the grams of some dozen fixed templates, some hundred numbers
    known = [r.g for r in placed.select("g").distinct().collect()]
    hits = words.withColumns({label: _places(F.col("words"), F.col("text"), phrase) for phrase, label in PHRASES})
    every = F.flatten(F.array(*[F.col(f"`{label}`") for _, label in PHRASES]))
    base_labels = F.array_distinct(F.filter(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, F.lit(label)) for _, label in PHRASES]), lambda x: x.isNotNull()))
    base = hits.select(
        "doc_id",
        "th",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(base_labels).alias("base"),
    )
    # texts without any gram of a template give no rows; as a filter the test would be computed twice
    fixed = F.array(*[F.lit(g) for g in known])
    hit = let(grams(F.col("words")), lambda g: F.when(F.arrays_overlap(g, fixed), g))
    votes = words.select("doc_id", "th", F.posexplode(hit).alias("pos", "g")).join(F.broadcast(placed), "g")
    key = ["doc_id", "th", "template"]
    diagonals = votes.groupBy(*key, "size", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.min("pos").alias("low"), F.max("pos").alias("high"), F.countDistinct("pos").alias("votes")
    )
    order = Window.partitionBy(*key).orderBy("diagonal")
    slack = F.least(F.lit(SLACK), F.floor(F.col("size") / 3))
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(order) > slack, 1).otherwise(0)
    merged = diagonals.withColumn("step", step).withColumn("run", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*key, "size", "run").agg(F.min("low").alias("low"), (F.max("high") + GRAM).alias("high"), F.sum("votes").alias("votes"))
    spans = spans.where(F.col("votes") + GRAM - 1 >= COVERAGE / 2 * F.col("size"))
    spans = cut(spans.where(F.col("high") - F.col("low") <= STRETCH * F.col("size") + GRAM).drop("size"), "spans")
    # verify on the words themselves
    them = words.join(small_side(spans.select("doc_id", "th").distinct()), (words.doc_id.eqNullSafe(spans.doc_id)) & (words.th == spans.th), "left_semi").dropDuplicates(["doc_id", "th"])
    s, t = spans.join(F.broadcast(templates), "template").alias("s"), them.alias("t")
    both = s.join(t, F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("s.th") == F.col("t.th")))
    part, size = F.slice("t.words", F.col("s.low") + 1, F.col("s.high") - F.col("s.low")), F.size("s.words")
    told = (F.size(F.array_except("s.need", part)) == 0) & ~F.arrays_overlap("s.ban", part)
    least = F.when(size <= SHORT, SHORT_COVERAGE).otherwise(COVERAGE)
    verified = both.where(told).select("s.doc_id", "s.th", "s.label", (in_order(part, F.col("s.masks")) / size).alias("coverage"), least.alias("least"))
    verified = verified.where("coverage >= least")
    found = verified.groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    b, f = base.alias("b"), found.alias("f")
    out = b.join(f, F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("b.th").eqNullSafe(F.col("f.th")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("b.base", F.coalesce("f.more", F.array().cast("array<string>")))))
    return out.select(
        "b.doc_id",
        "b.n_words",
        "b.n_base",
        "b.first_word",
        "b.last_word",
        F.array_join("b.base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("b.n_base") > 0, 1.0).otherwise(F.coalesce("f.coverage", F.lit(0.0))).alias("score"),
    )
