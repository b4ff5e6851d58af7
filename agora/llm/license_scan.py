"""License scans by a trained paragraph classifier, in DataFrame functions only.

A multinomial logistic regression over sparse word n-grams (words and word
pairs of the templates) tells license families from other paragraphs. It is
trained here by gradient descent with momentum as joins and groupings: on the
templates, variants of them with words left out, and other paragraphs: a fixed
list of near misses and a bounded sample of the documents' own. The unknown
class is calibrated on rows kept from training: a notice of any family needs a
probability that their other paragraphs reach in one of a hundred cases at
most. The classifier names the family. A template of that family, and of no
other, may confirm it: some span of the unit as long as the template (and a
quarter) holds ``share`` of its n-grams, and the words that tell sibling
licences apart (``MARKS``) are the same in both, if the template has any.

Paragraphs without any of the templates' key words are not scored. The key
words are chosen so that a paragraph without them misses more than
1 - ``share`` of every template's n-grams and could never be confirmed.

Scored are lines with a key word, and spans of paragraphs with one. A paragraph
is what stands between lines without letters or digits; its lines are joined,
and comment marks are no words. For each length n of ``SPANS``, up to the
longest template's, all spans of n + n // 4 words of a paragraph, n // 4 + 1
apart, are scored, so every n words in a row stand in one whole. So neither
wrapped lines nor a long line hide a notice. ``n_paragraphs`` counts lines with
a visible character; the other counts are of lines and spans, which overlap.
``families`` has the confirmed ones. Defined results: null and empty texts have no paragraphs. Rows that repeat doc_id and text give a row each.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import shared_table

SHARE = 0.8
OTHER = "none"
SAMPLE_DOCS = 600     # documents, in expectation, that give one paragraph each to train on
BLOCK_WORDS = 256     # a long paragraph is cut into blocks of so many words, which overlap by a span
STEPS = 25
RATE = 20.0
MOMENTUM = 0.9
SPANS = (6, 10, 17, 28)  # lengths of spans beside the longest template's
SHRINK = 1e-3

# Notices of license families, as their licences word them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("lgpl-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal dedication."),
    ("mit", "MIT License"),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("epl-2.0", "Eclipse Public License v2.0"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
TEMPLATES += [(family, f"SPDX-License-Identifier: {family}") for family in dict(TEMPLATES)]  # families are named by these identifiers
# Paragraphs with the words of notices that are none.
NEAR_MISSES = [
    "He was licensed to drive under the old rules.", "The public version of this work is free of charge.",
    "Click here to read the terms and conditions of use.", "The general public may use the library without restriction.",
    "You may not use this file.", "Under the terms of the treaty the source was to be made public.",
    "A license is required in order to sell food in public.", "Version 2.0 of the program was released in May.",
    "This software is subject to change without notice.", "Commons and universal suffrage were the work of a generation.",
    "All rights reserved.", "Permission to enter is granted to any person with a copy of the ticket.",
    "The attribution of the work to the school is not certain.", "The foundation was published as a free source.",
]
# Words that tell sibling licences apart.
MARKS = "0 1 2 3 4 5 sa nd nc sharealike noderivatives noderivs noncommercial lesser library affero".split()
# Words too common to be key words.
COMMON = set("a an the of to in is it and or you can this that be under use may by any with without as are not free".split())


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams_of(words: Column) -> Column:
    """Distinct words and word pairs."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
                       F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def constants(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A small (label, text) table of fixed values."""
    return spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("text")) for a, b in rows])).alias("x")).select("x.label", "x.text")


def key_words(share: float) -> list[str]:
    """Words of which every paragraph has one that holds ``share`` of a template's n-grams."""
    keys: set[str] = set()
    for _, text in TEMPLATES:
        words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        grams = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        missing: set[str] = set()
        for word in sorted(set(words), key=lambda w: (w in COMMON or len(w) < 2, w not in keys, -len(w), w)):
            if len(missing) > (1 - share) * len(grams):
                break
            keys.add(word)
            missing |= {g for g in grams if word in g.split()}
    return sorted(keys)


def training_rows(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(row, label, grams): templates and their variants, near misses, and a sample of paragraphs."""
    spark = docs.sparkSession
    leave = F.explode(F.array(*map(F.lit, range(-1, 9))))
    known = constants(spark, TEMPLATES).select("label", words_of(F.col("text")).alias("words"), leave.alias("leave"))
    known = known.select("label", F.when(F.col("leave") < 0, F.col("words")).otherwise(
        F.filter("words", lambda w, k: (k + F.col("leave")) % 9 != 0)).alias("words"))
    misses = constants(spark, [(OTHER, t) for t in NEAR_MISSES]).select("label", words_of(F.col("text")).alias("words"))
    spread = 1 << 30
    bound = int(spread * min(1.0, sample_docs / max(docs.count(), 1)))
    own = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(spread)) < bound).select(
        "doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: p != "").alias("p")).where("size(p) > 0")
    own = own.select(F.lit(OTHER).alias("label"), words_of(F.get("p", F.pmod(F.xxhash64("doc_id"), F.size("p")).cast("int"))).alias("words"))
    similar = constants(spark, TEMPLATES).select(ngrams_of(words_of(F.col("text"))).alias("template"))
    own = own.withColumn("grams", ngrams_of(F.col("words")))
    own = own.join(F.broadcast(similar), F.size(F.array_intersect("grams", "template")) >= 0.5 * F.size("template"), "left_anti")
    rows = known.unionByName(misses).unionByName(own.select("label", "words")).where("size(words) > 0")
    rows = rows.select(F.xxhash64("label", "words").alias("row"), "label", ngrams_of(F.col("words")).alias("grams")).distinct()
    return shared_table(rows.coalesce(1), "license-rows")  # about sample_docs and the fixed texts


def features(rows: DataFrame, vocabulary: DataFrame, *keep: str) -> DataFrame:
    """(keep..., gram, x): known n-grams of each row, scaled by the number of all its n-grams; '' is the bias."""
    grams = rows.select(*keep, F.explode(F.concat("grams", F.array(F.lit("")))).alias("gram"),
                        (1 / F.sqrt(F.greatest(F.size("grams"), F.lit(1)))).alias("scale"))
    return grams.join(F.broadcast(vocabulary), "gram").select(
        *keep, "gram", F.when(F.col("gram") == "", F.lit(0.3)).otherwise(F.col("scale")).alias("x"))


def classes() -> list[str]:
    return [OTHER, *dict(TEMPLATES)]


def probabilities(found: DataFrame, model: DataFrame, *keep: str) -> DataFrame:
    """(keep..., p): class probabilities, from the features (keep..., gram, x)."""
    n = len(classes())
    sums = found.join(F.broadcast(model), "gram").groupBy(*keep).agg(
        F.array(*[F.sum(F.col("x") * F.get("w", F.lit(k))) for k in range(n)]).alias("s"))
    exps = sums.withColumn("e", F.transform("s", lambda v: F.exp(v - F.array_max("s"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    return exps.select(*keep, F.transform("e", lambda v: v / total).alias("p"))


def train(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(gram, w): a weight for each class, by gradient descent on balanced classes."""
    names = classes()
    fit = rows.where("pmod(row, 4) <> 0 or label <> 'none'")
    share = fit.groupBy("label").agg((1 / F.count(F.lit(1)) / len(names)).alias("weight"))
    labels = fit.select("row", "label").join(F.broadcast(share), "label").select(
        "row", "weight", F.array(*[(F.col("label") == c).cast("double") for c in names]).alias("y"))
    x = shared_table(features(fit, vocabulary, "row").join(labels, "row").coalesce(1), "license-features")
    zeros = F.array(*[F.lit(0.0)] * len(names))
    model = shared_table(vocabulary.select("gram", zeros.alias("w"), zeros.alias("v")).coalesce(1), "license-model")
    for _ in range(STEPS):
        p = probabilities(x.select("row", "gram", "x"), model, "row")
        slope = x.join(p, "row").groupBy("gram").agg(F.array(*[
            F.sum(F.col("weight") * F.col("x") * (F.get("p", F.lit(k)) - F.get("y", F.lit(k)))) for k in range(len(names))]).alias("g"))
        step = model.join(F.broadcast(slope), "gram", "left").select("gram", "w", F.when(F.col("g").isNull(), F.transform(
            "v", lambda v: MOMENTUM * v)).otherwise(F.zip_with("v", "g", lambda v, g: MOMENTUM * v - RATE * g)).alias("v"))
        model = shared_table(step.select("gram", F.zip_with("w", "v", lambda w, v: w * (1 - SHRINK) + v).alias("w"), "v"), "license-model")
    return model.select("gram", "w")


def family_of(p: Column) -> tuple[Column, Column]:
    """(the likeliest family, the probability of any: siblings share theirs)."""
    families = F.slice(p, 2, len(classes()) - 1)
    likeliest = F.get(F.array(*map(F.lit, classes()[1:])), F.array_position(families, F.array_max(families)).cast("int") - 1)
    return likeliest, F.lit(1.0) - F.get(p, F.lit(0))


def slices(words: Column, n: int) -> Column:
    """Slices of n + n // 4 words, so far apart that every n words in a row stand in one whole; the last with the end."""
    size, step = n + n // 4, n // 4 + 1
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - F.lit(size - step)), F.lit(step))
    return F.transform(starts, lambda k: F.slice(words, k, F.lit(size)))


def confirms(words: Column, family: Column, share: float) -> Column:
    """A slice of ``words`` holds ``share`` of a template of ``family``, with the same marks."""
    marks = F.array(*map(F.lit, MARKS))
    found = F.lit(False)
    for name in classes()[1:]:
        fits = F.lit(False)
        for text in (t for f, t in TEMPLATES if f == name):
            template = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
            grams = sorted(set(template) | {f"{a} {b}" for a, b in zip(template, template[1:])})
            fits = fits | F.exists(slices(words, len(template)), holder(grams, sorted(set(template) & set(MARKS)), marks, share))
        found = F.when(family == name, fits).otherwise(found)
    return found


def holder(grams: list[str], own_marks: list[str], marks: Column, share: float):
    """Whether a slice holds ``share`` of ``grams`` and, if there are any, just ``own_marks`` of the marks."""
    def holds(part: Column) -> Column:
        enough = F.size(F.array_intersect(ngrams_of(part), F.array(*map(F.lit, grams)))) >= share * len(grams)
        return enough & (F.array_sort(F.array_intersect(part, marks)) == F.array(*map(F.lit, own_marks))) if own_marks else enough
    return holds


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, float]:
    """The model (gram, w) and the probability that a family needs."""
    vocabulary = constants(docs.sparkSession, TEMPLATES + [("", "")]).select(
        F.explode(F.concat(ngrams_of(words_of(F.col("text"))), F.array(F.lit("")))).alias("gram")).distinct()
    vocabulary = shared_table(vocabulary.coalesce(1), "license-grams")  # of the templates: some hundreds
    rows = training_rows(docs, sample_docs)
    model = train(rows, vocabulary)
    kept = features(rows.where("pmod(row, 4) = 0 and label = 'none'"), vocabulary, "row")
    reached = probabilities(kept, model, "row").select(family_of(F.col("p"))[1].alias("best"))
    level = reached.agg(F.percentile("best", 0.99)).first()[0]
    return model, max(0.5, level if level is not None and not math.isnan(level) else 0.5)


def spans(paragraphs: DataFrame, share: float, *keep: str) -> DataFrame:
    """(keep..., words) of the paragraphs' spans with a key word; distinct."""
    words, keys = words_of(F.col("paragraph")), F.array(*map(F.lit, key_words(share)))
    most = max(len([w for w in re.split("[^a-z0-9]+", text.lower()) if w]) for _, text in TEMPLATES)
    reach = most + most // 4

    # blocks first, so that no row carries a long paragraph; each span stands in one whole
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.lit(reach)), F.lit(BLOCK_WORDS))
    blocks = paragraphs.select(*keep, F.explode(F.array(words)).alias("words")).select(
        *keep, F.explode(F.transform(starts, lambda k: F.slice("words", k, F.lit(BLOCK_WORDS + reach)))).alias("words"))
    rows = blocks.where(F.arrays_overlap("words", keys)).select(*keep, F.explode(F.concat(*[
        slices(F.col("words"), n) for n in (*[n for n in SPANS if n < most], most)])).alias("words"))
    return rows.where(F.arrays_overlap("words", keys)).distinct()


def scan_paragraphs(docs: DataFrame, share: float = SHARE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, text_key, line, family, probability, confirmed) of lines with a key word, and of spans (line: -1); family null: unknown."""
    model, level = fit(docs, sample_docs)
    pattern = r"(?<![a-z0-9])(?:" + "|".join(key_words(share)) + r")(?![a-z0-9])"
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), lower.alias("text")).where(F.rlike("text", F.lit(pattern))).distinct()
    lines = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(
        F.rlike("text", F.lit(pattern)))
    lines = lines.select("doc_id", "text_key", F.col("line").cast("long").alias("line"), words_of(F.col("text")).alias("words"))
    parts = texts.select("doc_id", "text_key", F.explode(F.split("text", r"\n(?:[^a-z0-9\n]*\n)+")).alias("paragraph")).where(
        F.rlike("paragraph", F.lit(pattern)))
    found = spans(parts, share, "doc_id", "text_key").select("doc_id", "text_key", F.lit(-1).cast("long").alias("line"), "words")
    units = shared_table(lines.unionByName(found).withColumn("unit", F.monotonically_increasing_id()), "license-units")
    scored = probabilities(features(units.select("unit", ngrams_of(F.col("words")).alias("grams")), model.select("gram"), "unit"), model, "unit")
    family, any_family = family_of(F.col("p"))
    scored = scored.select("unit", any_family.alias("probability"), F.when(any_family >= level, family).alias("family"))
    out = units.join(scored, "unit")
    return out.select("doc_id", "text_key", "line", "family", "probability",
                      F.when(F.col("family").isNull(), False).otherwise(confirms(F.col("words"), F.col("family"), share)).alias("confirmed"))


def scan(docs: DataFrame, share: float = SHARE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per document row: (doc_id, n_paragraphs, n_scored, n_predicted, n_confirmed, families)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scan_paragraphs(docs, share, sample_docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
        F.count(F.lit(1)).alias("n_scored"), F.count("family").alias("n_predicted"),
        F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: F.rlike(p, F.lit(r"\S")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(lines).cast("long").alias("n_paragraphs"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_paragraphs", zero("n_scored"), zero("n_predicted"), zero("n_confirmed"),
                      F.coalesce("families", F.array().cast("array<string>")).alias("families"))
