"""License scans by diagonal voting.

Every pair of neighbouring words of a text is hashed and joined to the positions of the same pair in the templates
(notices and names, a fixed and small table that is broadcast). A match at word p of the text and word q of a template
votes for the diagonal p - q; a passage that follows a template puts all its votes on one diagonal, or on neighbouring
ones where a word was put in or left out. Votes are counted by diagonal. Each diagonal takes in its neighbours up to
`NEAR` places away; where these hold enough of the template's pairs together, the span is verified: the longest chain
of votes whose places rise both in the text and in the template has to cover the template's share. Words in another
order make no chain, and a chain within these diagonals is at most 2 * `NEAR` words longer than the template. Of spans
of one template that overlap, the one with most votes counts. Built-in column expressions only.

The hash only finds candidates: the two words are compared in the same join, so a span's words are the template's.
Votes of one text are at most its words times the fixed number of template places, a diagonal has at most one for each
pair of its template, and votes of all texts are dealt by a key made for each row, so no license, source or repeated
row makes a hot group.

Defined results: a null or empty text has no words, no spans and score 0; repeated rows are scanned one by one; an
empty table gives an empty result; other columns, whatever their names, are kept inside a struct until the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import check_columns

#: Everything that is not part of a word, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this near to a span's own give it their votes.
NEAR = 3


@dataclass(frozen=True)
class Template:
    """`share`: of the template's word pairs that a span has to cover."""

    name: str
    label: str
    text: str
    share: float = 0.75


# The phrases whose places are counted, in the order of their labels.
PHRASES = (
    Template("phrase-apache", "apache", "apache license", 1.0),
    Template("phrase-cc-by", "cc-by", "cc by", 1.0),
    Template("phrase-gpl", "gpl", "gnu general public license", 1.0),
    Template("phrase-mit", "mit", "mit license", 1.0),
)

# Names and passages of public license notices.
NOTICES = (
    Template("apache-name", "apache-2.0", "apache license version 2.0", 1.0),
    Template("apache-short", "apache-2.0", "apache license 2.0", 1.0),
    Template("apache-notice", "apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    Template("apache-warranty", "apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("gpl-3-name", "gpl-3.0", "gnu general public license version 3", 1.0),
    Template("gpl-2-name", "gpl-2.0", "gnu general public license version 2", 1.0),
    Template("gpl-free", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl-later", "gpl", "either version 2 of the license or at your option any later version", 1.0),
    Template("gpl-warranty", "gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    Template("lgpl-name", "lgpl", "gnu lesser general public license", 1.0),
    Template("lgpl-notice", "lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl-name", "agpl", "gnu affero general public license", 1.0),
    Template("mit-notice", "mit", "released under the mit license"),
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("mit-short", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("mit-notice-stays", "mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd-source", "bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("bsd-binary", "bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    Template("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-name", "mpl-2.0", "mozilla public license", 1.0),
    Template("mpl-notice", "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one"),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
    Template("zlib-grant", "zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    Template("cc-by-nc", "cc-by-nc", "cc by nc", 1.0),
    Template("cc-by-sa", "cc-by-sa", "cc by sa", 1.0),
    Template("cc-by-nd", "cc-by-nd", "cc by nd", 1.0),
    Template("cc-name", "cc", "creative commons attribution", 1.0),
    Template("cc-notice", "cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    Template("cc-zero", "cc0", "creative commons zero", 1.0),
    Template("reserved", "all-rights-reserved", "all rights reserved", 1.0),
)


def text_words(text: Column) -> Column:
    """Words of a text, with A-Z in lower case.

    `lower` also changes other letters, which changes no word's bounds and makes no template word: the one sign
    outside ASCII that it turns into an ASCII letter, the Kelvin sign, is replaced first.
    """
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), NOT_WORD), "")


def _template_words(t: Template) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in t.text.lower()).split()


def _places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """All word pairs of the templates: their hash, words and place."""
    rows = []
    for k, t in enumerate(templates):
        w = _template_words(t)
        if len(w) < 2:
            raise ValueError(f"{t.name}: a template needs two words")
        rows += [(k, q, w[q], w[q + 1]) for q in range(len(w) - 1)]
    each = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(q).alias("q"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, q, a, b in rows])
    return spark.range(1).select(F.inline(each)).withColumn("t_hash", F.xxhash64("a", "b"))


def spans(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """Each row of `docs` (as struct `doc`) with n_words and `spans`, an array of the verified places of templates.

    A span has template (its number), first and last (words of the text), votes and share (of the template's pairs).
    """
    check_columns(docs, text)
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("doc"), text_words(F.col(text)).alias("words")) if len(docs.columns) > 1 else docs.select(F.struct(F.lit(0).alias("none")).alias("doc"), text_words(F.col(text)).alias("words"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # a place of its own (the last) stands for the document, so that texts without matches stay
    at = rows.select("row", "doc", "words", F.size("words").alias("n_words"), F.explode(F.sequence(F.lit(0), F.size("words"))).alias("p"))
    a, b = F.get("words", F.col("p")), F.get("words", F.col("p") + 1)
    hit = at.withColumn("hash", F.xxhash64(a, b)).join(
        F.broadcast(_places(spark, templates)), (F.col("hash") == F.col("t_hash")) & (a == F.col("a")) & (b == F.col("b")), "left"
    )
    last = F.col("p") == F.col("n_words")
    votes = hit.where(last | F.col("template").isNotNull()).select("row", F.when(last, F.col("doc")).alias("doc"), "n_words", "template", "p", "q")

    every = lambda f: F.get(F.array(*[F.lit(f(t)) for t in templates]), F.col("template"))
    pairs = every(lambda t: len(_template_words(t)) - 1)
    needed = every(lambda t: math.ceil(t.share * (len(_template_words(t)) - 1) - 1e-9))
    reach = every(lambda t: 0 if t.share == 1.0 else NEAR)

    dealt = votes.repartition("row")
    diagonals = dealt.groupBy("row", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.first("doc", ignorenulls=True).alias("doc"), F.max("n_words").alias("n_words"), F.collect_list("q").alias("qs"),
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    around = diagonals.withColumn("around", F.collect_list(F.struct("diagonal", "qs")).over(near))
    around = around.withColumn("around", F.filter("around", lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= reach))
    # enough different pairs of the template, in any order, before their order is looked at
    seen = F.size(F.array_distinct(F.flatten(F.transform("around", lambda x: x["qs"]))))
    matches = F.array_sort(F.flatten(F.transform("around", lambda x: F.transform(x["qs"], lambda q: F.struct((q + x["diagonal"]).alias("p"), q.alias("q"))))))
    spans_ = around.select("row", "doc", "n_words", "template", pairs.alias("pairs"), needed.alias("needed"), F.when(seen >= needed, _longest_chain(matches)).alias("chain"))
    found = spans_.withColumn("span", F.when(F.col("chain.votes") >= F.col("needed"), F.struct("template", F.col("chain.first").alias("first"), (F.col("chain.last") + 1).alias("last"), F.col("chain.votes").alias("votes"), (F.col("chain.votes") / F.col("pairs")).alias("share"))))
    # of the spans of an inexact template that overlap, the best: a span meets those that begin within its reach
    longest = max(len(_template_words(t)) for t in templates) + 2 * NEAR
    within = Window.partitionBy("row", "template").orderBy(F.col("span.first")).rangeBetween(-longest, longest)
    inexact = F.col("template").isin([k for k, t in enumerate(templates) if t.share < 1.0])
    beaten = F.exists(F.collect_set("span").over(within), lambda x: _beats(x, F.col("span")))
    best = found.withColumn("span", F.when(~(inexact & beaten), F.col("span")))
    rows = best.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"))
    return rows.select("doc", "n_words", "spans")


def _beats(x: Column, s: Column) -> Column:
    """Whether a span of the same template overlaps another and has more votes, or as many and an earlier start."""
    return (x["first"] <= s["last"]) & (x["last"] >= s["first"]) & ((x["votes"] > s["votes"]) | ((x["votes"] == s["votes"]) & (x["first"] < s["first"])))


def _longest_chain(matches: Column) -> Column:
    """Of (p, q) sorted by p, the longest chain that rises in both: votes, first and last p. Ties: the first to end, then the latest start."""
    empty = F.array().cast("array<struct<votes:int,start:int,p:int,q:int>>")

    def step(chains: Column, m: Column) -> Column:
        before = F.array_max(F.transform(F.filter(chains, lambda c: (c["p"] < m["p"]) & (c["q"] < m["q"])), lambda c: F.struct(c["votes"], c["start"])))
        here = F.struct((F.coalesce(before["votes"], F.lit(0)) + 1).alias("votes"), F.coalesce(before["start"], m["p"]).cast("int").alias("start"), m["p"].cast("int").alias("p"), m["q"].cast("int").alias("q"))
        return F.concat(chains, F.array(here))

    ranked = lambda c: F.array_max(F.transform(c, lambda x: F.struct(x["votes"].alias("votes"), (-x["p"]).alias("end"), x["start"].alias("first"))))
    best = F.aggregate(matches, empty, step, ranked)
    return F.struct(best["votes"].alias("votes"), best["first"].alias("first"), (-best["end"]).alias("last"))


def scan(docs: DataFrame, text: str = "text", phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """`spans` with the labels of all spans, those of the phrases alone, and a score.

    score: 0 without a label, else the largest share of a notice's pairs that a span covers (a phrase alone: 0.5).
    """
    every = phrases + notices
    label = lambda s: F.get(F.array(*[F.lit(t.label) for t in every]), s["template"])
    base = F.filter("spans", lambda s: s["template"] < len(phrases))
    more = F.filter("spans", lambda s: s["template"] >= len(phrases))
    return spans(docs, text, every).select(
        "doc", "n_words", "spans", base.alias("phrases"),
        F.array_sort(F.array_distinct(F.transform(base, label))).alias("base_labels"),
        F.array_sort(F.array_distinct(F.transform("spans", label))).alias("labels"),
        F.greatest(F.when(F.size(base) > 0, F.lit(0.5)).otherwise(0.0), F.coalesce(F.array_max(F.transform(more, lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )
