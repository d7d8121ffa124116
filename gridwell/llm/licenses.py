"""Licence scans with DataFrame functions alone: MinHash bands over overlapping windows find templates, shingle containment verifies them.

Texts and templates become lower-case words and shingles of five words. Templates are taken by size: those
of more than B/2 and at most B shingles are looked for in windows of 2B shingles that start every
B, so that any run of B shingles lies wholly in a window. A window and a template are compared where
they agree in a band: in the minima of all of the band's hash functions. Where a template is contained, the two
sets' Jaccard similarity s is known from below, and a band of r functions agrees with a probability of s**r at
least; the number of bands is chosen so that none does with a probability of at most MISS.

Windows are not signed one by one. A window's minimum can only be a template's if the window has the shingle that
gives it, so the index holds the shingle of each band's first minimum, the text's shingles are joined with it,
and only around these places is a window's minimum taken under each function of the bands that start there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SHINGLE, CONTAINED, MISS = 5, 0.8, 1e-6
#: Hash functions of a band: one for templates of a shingle or two, whose windows have four at most, two for longer ones.
SHORT_BLOCK, BAND_ROWS = 2, 2
#: Shingles of all templates up to which the index is broadcast; a larger one is joined by shuffles, with the same result.
KNOWN_SHINGLES = 20_000
#: Signs of a text that are cut into words at once; shingles that are joined at once.
PIECE, CHUNK = 1 << 18, 2048

#: Notices of public licences, as projects state them.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """texts as a DataFrame (template, text), without a job on Python's side."""
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in texts.items()])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.text")


def _plain(text: Column) -> Column:
    """Lower-case words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _words(text: Column) -> Column:
    return F.split(_plain(text), " ")


def _shingled(words: Column, size: int = SHINGLE) -> Column:
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of size words, in order; none for shorter or null texts."""
    words = F.coalesce(_words(text), F.array())
    return F.transform(F.array(words), lambda w: _shingled(w, size))[0]  # the words stand in a lambda's variable, so that they are split once


def band_rows(block: int) -> int:
    return 1 if block <= SHORT_BLOCK else BAND_ROWS


def bands(block: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands with which templates of over block/2 shingles are missed with a probability of at most miss."""
    least = block // 2 + 1
    need = math.ceil(contained * least)
    agrees = (need / (2 * block + least - need)) ** band_rows(block)
    return math.ceil(math.log(miss) / math.log(1 - agrees)) if agrees < 1 else 1


def _minimum(hashes: Column, function: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, function)))


def _index(forms: DataFrame) -> DataFrame:
    """forms (template, parts, block, bands, rows) by the shingle of each band's first minimum: part, template, block, and the bands there as lists of (function, low)."""
    band = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda j: F.col("band") * F.col("rows") + j)
    signed = forms.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1))).withColumn("functions", band)
    first = F.array_min(F.transform("parts", lambda h: F.struct(F.xxhash64(h, F.col("functions")[0]).alias("low"), h.alias("part"))))["part"]
    lows = F.transform("functions", lambda f: F.struct(f.alias("function"), _minimum(F.col("parts"), f).alias("low")))
    return signed.select(first.alias("part"), "template", "block", lows.alias("lows")).groupBy("part", "template", "block").agg(F.collect_list("lows").alias("lows"))


def _pieces(docs: DataFrame, block: int, longest: int) -> DataFrame:
    """docs by parts of their texts: doc_id, base (words before), own (shingles that windows may start at) and hashes, which go on for two blocks.

    A row that is exploded is copied for each part, so rows carry no more than a part each. Words of a text in
    parts that are longer than longest, the longest of the templates, are shortened to a sign more than that: no
    template has them before or after. So it is known how many signs the two blocks of words take at most.
    """
    size, reach = F.lit(PIECE), F.lit(min((longest + 2) * (2 * block + SHINGLE + 1), 1 << 30))
    plain = docs.where(F.col("text").isNotNull()).select("doc_id", _plain(F.col("text")).alias("text"))
    short = F.regexp_replace("text", f"([^ ]{{{longest + 1}}})[^ ]+", "$1")
    spaced = plain.select("doc_id", F.concat(F.lit(" "), F.when(F.length("text") > size, short).otherwise(F.col("text"))).alias("text"))
    last = F.greatest(F.ceil((F.length("text") - 1) / size), F.lit(1)).cast("int") - 1
    # each part begins with the sign before it, so that a word starts in the part wherever a space stands in its first signs
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("text"), i * size + 1, size + 1 + reach))
    counted = F.transform(parts, lambda p: F.struct(p.alias("text"), (size - F.length(F.replace(F.substring(p, F.lit(1), size), F.lit(" "), F.lit("")))).alias("own")))
    listed = spaced.select("doc_id", F.length("text").alias("signs"), F.when(last > 0, counted).otherwise(F.array(F.struct(F.col("text"), F.lit(None).cast("int").alias("own")))).alias("parts"))
    cut = listed.withColumn("counts", F.transform("parts", lambda p: p["own"])).select("doc_id", "signs", "counts", F.posexplode("parts").alias("i", "part"))
    i, words = F.col("i"), F.split(F.trim("part.text"), " ")
    torn_first, torn_last = (~F.startswith("part.text", F.lit(" "))).cast("int"), (i * size + size + 1 + reach < F.col("signs")).cast("int")
    whole = F.when(F.size("counts") == 1, words).otherwise(F.slice(words, torn_first + 1, F.greatest(F.size(words) - torn_first - torn_last, F.lit(0))))
    base = F.when(i > 0, F.aggregate(F.slice("counts", 1, i), F.lit(0), lambda a, x: a + x)).otherwise(0)
    hashed = cut.select("doc_id", base.alias("base"), F.when(i + 1 < F.size("counts"), F.col("part.own")).alias("own"), whole.alias("words")).select("doc_id", "base", "own", _shingled(F.col("words")).alias("hashes"))
    owned = hashed.withColumn("own", F.least(F.coalesce("own", F.size("hashes")), F.size("hashes")))
    chunk = owned.withColumn("s", F.explode(F.sequence(F.lit(0), F.greatest(F.col("own") - 1, F.lit(0)), F.lit(CHUNK))))
    return chunk.select("doc_id", (F.col("base") + F.col("s")).alias("base"), F.least(F.col("own") - F.col("s"), F.lit(CHUNK)).alias("own"), F.slice("hashes", F.col("s") + 1, CHUNK + 2 * block).alias("hashes"))


def _looked_up(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """pieces beside the places of them that index has. The shingles are shuffled alone; what meets the index finds its piece again by digest."""
    keyed = pieces.withColumn("digest", F.xxhash64("hashes"))
    found = keyed.select("doc_id", "base", "own", "digest", F.posexplode("hashes").alias("at", "part")).join(index, "part").alias("found")
    whole = keyed.distinct().alias("whole")  # repeated rows of docs would meet each other's places
    same = [F.col(f"found.{c}").eqNullSafe(F.col(f"whole.{c}")) for c in ("doc_id", "base", "own", "digest")]
    return found.join(whole, same[0] & same[1] & same[2] & same[3]).select("whole.doc_id", "whole.base", "whole.own", "whole.hashes", "found.at", "found.template", "found.block", "found.lows")


def scan(docs: DataFrame, forms: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """docs (doc_id, text) against forms (template, text): doc_id, template, found, shingles, containment, start.

    A template is in a document if one of the windows has at least contained of its distinct shingles; the
    row tells the best window (the first of equals): how many it has and the word that it starts at. A
    null or short text and a template of fewer words than a shingle match nothing. Rows of docs with the
    same doc_id count as one document, null ids among them; other columns are ignored; an empty table gives none.
    A very long text is cut into words in parts of PIECE signs; windows go on into the next part, however long the
    words there are.
    """
    forms = forms.select("template", F.array_distinct(shingles(F.col("text"))).alias("parts"), F.array_max(F.transform(_words(F.col("text")), F.length)).alias("longest")).where(F.size("parts") > 0)
    forms = forms.withColumn("block", F.pow(F.lit(2), F.ceil(F.log2(F.size("parts")))).cast("int"))
    known = forms.groupBy("block").agg(F.sum(F.size("parts")).alias("n"), F.max("longest").alias("longest")).collect()  # one row for each power of two
    sizes = {r.block: r.n for r in known}
    if not sizes:
        return docs.select("doc_id", F.lit("").alias("template"), F.lit(0).alias("found"), F.lit(0).alias("shingles"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("start")).where(F.lit(False))
    few = sum(sizes.values()) <= KNOWN_SHINGLES

    def checked(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    def by_block(f) -> Column:
        return F.create_map(*[F.lit(x) for b in sizes for x in (b, f(b))])[F.col("block")]

    forms = forms.withColumns({"bands": by_block(lambda b: bands(b, contained)), "rows": by_block(band_rows)})
    pieces, index = _pieces(docs, max(sizes), max(r.longest for r in known)), _index(forms)
    if few:
        hits = pieces.select("doc_id", "base", "own", "hashes", F.posexplode("hashes").alias("at", "part")).join(F.broadcast(index), "part")
    else:
        hits = _looked_up(pieces, index)
    home = F.floor((F.col("base") + F.col("at")) / F.col("block")) * F.col("block")
    near = hits.withColumn("start", F.explode(F.array(home, home - F.col("block"))))
    near = near.where((F.col("start") >= F.col("base")) & (F.col("start") < F.col("base") + F.col("own")))
    windows = near.select("doc_id", "template", "start", "lows", F.slice("hashes", (F.col("start") - F.col("base") + 1).cast("int"), 2 * F.col("block")).alias("window"))
    agree = F.exists("lows", lambda band: F.forall(band, lambda x: _minimum(F.col("window"), x["function"]) == x["low"]))
    met = windows.where(agree).select("doc_id", "template", "start", "window").join(checked(forms.select("template", "parts")), "template")
    found = met.select("doc_id", "template", "start", F.size(F.array_intersect("window", "parts")).alias("found"), F.size("parts").alias("shingles"))
    matched = found.where(F.col("found") >= F.lit(contained) * F.col("shingles"))
    best = matched.groupBy("doc_id", "template").agg(F.max(F.struct("found", (-F.col("start")).alias("before"))).alias("best"), F.max("shingles").alias("shingles"))
    return best.select("doc_id", "template", F.col("best.found").alias("found"), "shingles", (F.col("best.found") / F.col("shingles")).alias("containment"), (-F.col("best.before")).alias("start"))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """The licence notices in all documents."""
    return scan(read(spark, sf_dir, "documents"), templates(spark))


def _oracle() -> str:
    """The same scan in SQL, with every window held against every template."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())

    def parts(table: str, key: str) -> str:
        words = f"SELECT {key}, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table} WHERE text IS NOT NULL"
        return f"SELECT {key}, CAST(i - 1 AS BIGINT) AS at, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 1))) AS i FROM ({words}))"

    return f"""
        WITH forms(template, text) AS (VALUES {values}),
        t AS (SELECT DISTINCT template, s FROM ({parts("forms", "template")})),
        n AS (SELECT template, count(*) AS shingles, CAST(power(2, ceil(log2(count(*)))) AS BIGINT) AS block FROM t GROUP BY template),
        d AS (SELECT * FROM ({parts("documents", "doc_id")}) WHERE s IN (SELECT s FROM t)),
        hits AS (
            SELECT d.doc_id, t.template, n.shingles, n.block, d.s, unnest([d.at // n.block, d.at // n.block - 1]) AS win
            FROM d JOIN t USING (s) JOIN n USING (template)
        ),
        found AS (
            SELECT doc_id, template, CAST(shingles AS INTEGER) AS shingles, win * block AS start, CAST(count(DISTINCT s) AS INTEGER) AS found
            FROM hits WHERE win >= 0 GROUP BY ALL
        )
        SELECT doc_id, template, found, shingles, CAST(found AS DOUBLE) / shingles AS containment, start
        FROM found WHERE found >= {CONTAINED} * shingles
        QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY found DESC, start) = 1
    """


ORACLES = {"op7_licenses": _oracle()}
