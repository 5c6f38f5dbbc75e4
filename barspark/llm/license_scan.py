"""License scans by diagonal voting, in DataFrame operations alone.

All rolling word k-grams of the texts are hashed and joined with the k-gram hashes of
license templates. A match of document position p with template position q votes for
the diagonal p - q, the place where the template would begin. Votes are added up per
(document, template, diagonal); diagonals at most ``SLACK`` apart merge, so a few
inserted or missing words do no harm; a merged span is verified by the share of the
template's different k-grams it holds. K-grams count as equal when two hashes of 64 and
32 bits are. Where verified spans of different labels overlap, the one with the best
coverage is kept (then the one with more k-grams; equals are all kept), so the k-grams
that tell two licenses apart decide. Beside that, fixed phrases are found where their
words stand consecutively.

The templates are names, notices and opening clauses of the usual licenses; the rest of a
license text plays no part.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
Null and empty texts have no words, no labels and score 0. Rows with the same id and
text are judged once and each returned. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import BROADCAST_ROWS

# Phrases of the base, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of well-known licenses, as templates.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met",
    ),
]
# Names, notices and opening clauses of further licenses, which compete with those above.
_GNU = "it under the terms of the GNU {} as published by the Free Software Foundation"
_CC = {
    "cc-by": ("BY", "Attribution"),
    "cc-by-sa": ("BY-SA", "Attribution-ShareAlike"),
    "cc-by-nd": ("BY-ND", "Attribution-NoDerivatives"),
    "cc-by-nc": ("BY-NC", "Attribution-NonCommercial"),
    "cc-by-nc-sa": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "cc-by-nc-nd": ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
}
RIVALS = [
    *[(x, f"Licensed under CC {short} 4.0") for x, (short, _) in _CC.items() if x != "cc-by-nc"],
    *[(x, f"This work is licensed under a Creative Commons {name} 4.0 International License") for x, (_, name) in _CC.items() if x != "cc-by-nc"],
    *[(x, f"This work is licensed under a Creative Commons {name} 3.0 Unported License") for x, (_, name) in _CC.items()],
    *[(x, f"conditions of this Creative Commons {name} 4.0 International Public License") for x, (_, name) in _CC.items()],
    *[(x, f"creativecommons.org/licenses/{short}/{version}") for x, (short, _) in _CC.items() for version in ("4.0", "3.0")],
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("cc0", "creativecommons.org/publicdomain/zero/1.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "GNU Library General Public License"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl", f"This library is free software; you can redistribute it and/or modify {_GNU.format('Lesser General Public License')}"),
    ("lgpl", f"This program is free software: you can redistribute it and/or modify {_GNU.format('Lesser General Public License')}"),
    ("lgpl", f"This library is free software; you can redistribute it and/or modify {_GNU.format('Library General Public License')}"),
    (
        "lgpl",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General"
        " Public License, supplemented by the additional permissions listed below",
    ),
    ("agpl", "GNU Affero General Public License"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("agpl", f"This program is free software: you can redistribute it and/or modify {_GNU.format('Affero General Public License')}"),
    (
        "agpl",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically"
        " designed to ensure cooperation with the community in the case of network server software",
    ),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    (
        "gpl",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General"
        " Public License is intended to guarantee your freedom to share and change free software",
    ),
    ("fdl", "GNU Free Documentation License"),
    (
        "fdl",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation"
        " License as published by the Free Software Foundation",
    ),
    ("mpl", "Mozilla Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("epl", "Eclipse Public License"),
    ("epl", "The accompanying program is provided under the terms of this Eclipse Public License"),
    ("apache", "Terms and conditions for use, reproduction, and distribution"),
    ("bsd", "Use of this source code is governed by a BSD-style license"),
    ("isc", "under the ISC License"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "0bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
        " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    ),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("bsl", "Boost Software License"),
    (
        "bsl",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("wtfpl", "Do What The Fuck You Want To Public License"),
]
K = 3
SLACK = 2
#: Least share of a template's k-grams in a span.
COVERAGE = 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, null for null; the pattern is applied after lower-casing."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _SEPARATORS), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Two hashes of each k-gram of an array of words; null for fewer words than K."""

    def at(i: Column) -> Column:
        gram = [F.get(words, i + j) for j in range(K)]
        return F.struct(F.xxhash64(*gram).alias("gram"), F.hash(*gram).alias("proof"))

    return F.when(F.size(words) >= K, F.transform(F.sequence(F.lit(0), F.size(words) - K), at))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, label, grams, q, gram, proof) for each k-gram of each template, made from literals."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(x).alias("label"), F.lit(t).alias("text")) for i, (x, t) in enumerate(templates)])
    words = spark.range(1).select(F.inline(rows)).select("template", "label", words_of(F.col("text")).alias("words"))
    return words.select("template", "label", (F.size("words") - K + 1).alias("grams"), F.posexplode(_grams(F.col("words"))).alias("q", "own")).select(
        "template", "label", "grams", "q", "own.gram", "own.proof"
    )


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """(at, label) wherever the words of a phrase stand consecutively."""

    def label_at(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in phrases.items():
            here = F.lit(True)
            for j, w in enumerate(phrase.split(" ")):
                here = here & (F.coalesce(F.get(words, i + j), F.lit("")) == w)
            found = F.coalesce(F.when(here, label), found)
        return found

    last = sorted({p.split(" ")[-1] for p in phrases})
    places = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("at"), label_at(i).alias("label")))
    none = F.array().cast("array<struct<at:int,label:string>>")
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, last))), F.filter(places, lambda p: p["label"].isNotNull())).otherwise(none)


def votes(keyed: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(id, hash, template, label, grams, diagonal, p, q) for each k-gram of a text that stands in a template; ``keyed`` has words."""
    known = template_grams(keyed.sparkSession, templates)
    count = sum(len(t) for _, t in templates)  # more than its k-grams
    exploded = keyed.select("id", "hash", F.posexplode(_grams(F.col("words"))).alias("p", "own"))
    exploded = exploded.select("id", "hash", "p", F.col("own.gram").alias("gram"), F.col("own.proof").alias("proof"))
    met = exploded.join(F.broadcast(known) if count <= BROADCAST_ROWS else known, ["gram", "proof"])
    return met.select("id", "hash", "template", "label", "grams", (F.col("p") - F.col("q")).alias("diagonal"), "p", "q")


def spans(found: DataFrame) -> DataFrame:
    """Verified spans (id, hash, label, first, last, coverage) from votes."""
    own = ["id", "hash", "template", "label", "grams"]
    diagonals = found.groupBy(*own, "diagonal").agg(F.collect_set("q").alias("qs"), F.min("p").alias("first"), F.max("p").alias("last"))
    order = Window.partitionBy(*own).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order)) <= SLACK
    cut = diagonals.withColumn("fresh", F.when(fresh, 0).otherwise(1))
    merged = cut.withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.size(F.array_distinct(F.flatten(F.collect_list("qs"))))
    out = merged.groupBy(*own, "span").agg(held.alias("held"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"))
    return out.withColumn("coverage", F.col("held") / F.col("grams")).filter(F.col("coverage") >= COVERAGE).drop("span")


def winners(verified: DataFrame) -> DataFrame:
    """(id, hash, spans, share): the spans of each text that no better one of another label overlaps by half of the shorter.

    Spans compete only within a stretch of spans that overlap one after the other, best first.
    """
    order = Window.partitionBy("id", "hash").orderBy("first", "last", "label", "template")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = verified.withColumn("fresh", F.when(F.col("first") <= reached, 0).otherwise(1))
    placed = fresh.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct((-F.col("coverage")).alias("coverage"), (-F.col("held")).alias("held"), "first", "last", "label")
    rivals = placed.groupBy("id", "hash", "stretch").agg(F.array_sort(F.collect_set(one)).alias("rivals"))

    def beaten(s: Column, k: Column) -> Column:
        shared = F.least(s["last"], k["last"]) - F.greatest(s["first"], k["first"]) + 1
        shorter = F.least(s["last"] - s["first"], k["last"] - k["first"]) + 1
        better = (k["coverage"] < s["coverage"]) | (k["held"] < s["held"])  # k comes first
        return (k["label"] != s["label"]) & (2 * shared >= shorter) & better

    none = F.filter("rivals", lambda s: F.lit(False))
    kept = F.aggregate("rivals", none, lambda kept, s: F.when(F.exists(kept, lambda k: beaten(s, k)), kept).otherwise(F.concat(kept, F.array(s))))
    spans_of = F.transform("kept", lambda s: F.struct(s["label"].alias("label"), s["first"].alias("first"), s["last"].alias("last")))
    own = rivals.withColumn("kept", kept).select("id", "hash", spans_of.alias("spans"), (-F.array_min("kept.coverage")).alias("share"))
    return own.groupBy("id", "hash").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.max("share").alias("share"))


def scan_licenses(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES + RIVALS,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """(id, n_words, places, found, score, spans) per row: places of phrases, labels of verified spans, the best share matched, and the spans.

    A phrase is a template that its place covers whole, so any place scores 1.
    """
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = df.select(F.col(id).alias("id"), F.xxhash64(plain).alias("hash"), words_of(plain).alias("words"))
    base = keyed.select("id", "hash", F.size("words").cast("long").alias("n_words"), phrase_places(F.col("words"), phrases).alias("places"))
    verified = winners(spans(votes(keyed, templates))).withColumn("found", F.array_sort(F.array_distinct("spans.label")))
    same = base["id"].eqNullSafe(verified["id"]) & (base["hash"] == verified["hash"])
    out = base.join(verified, same, "left").select(
        base["id"].alias(id),
        "n_words",
        "places",
        F.coalesce("found", F.array().cast("array<string>")).alias("found"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<label:string,first:int,last:int>>")).alias("spans"),
    )
    return out


def labels(places: str = "places", spans: str = "spans") -> Column:
    """All labels of a text: those of the phrases and those of the spans (the name of the LGPL holds the GPL's phrase, so it gets both)."""
    return F.array_sort(F.array_union(F.transform(places, lambda p: p["label"]), F.transform(spans, lambda s: s["label"])))
