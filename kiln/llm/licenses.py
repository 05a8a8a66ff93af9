"""Licence scans by Dice coefficient over word bigrams (DataFrame functions only).

The units of a text are its lines, its paragraphs (between blank lines) and the
whole text.  A unit and a licence template are normalised to lower-case words;
they match when the Dice coefficient of their distinct word bigrams reaches the
threshold.  Size bounds prune first: with Dice t, the smaller bigram set has at
least t / (2 - t) times the members of the larger.  So a unit that matches a
template has about two thirds of the template's bigrams, and at least one word
of any set of words that touches the other third; texts without such a word are
left out after one look at their words.  Matches are then counted by a hash
join of bigrams, so no unit is compared with every template.

Cases: null and blank texts and units of one word match nothing; a unit that
comes twice in a text counts once, under the licence whose template is closest
(the first by name, if two are as close); repeated rows give their licence once
for each id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import let

THRESHOLD = 0.8
SLACK = 1e-9                    # of the size bounds, against rounding
BROADCAST_BIGRAMS = 200_000     # template bigrams sent to every task (some 20 MB); beyond, a shuffle join
# fixed values: licence notices as their licences word them (id, text)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
     Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
     option) any later version."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
     option) any later version."""),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
     MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met:"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    # the lesser and Affero notices differ from the general ones in few words; the closest template names the licence
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.0", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
     Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
     your option) any later version."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
     Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
     (at your option) any later version."""),
    ("LGPL-2.1", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
     Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
     (at your option) any later version."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
     your option) any later version."""),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU
     Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
     your option) any later version."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
     your option) any later version."""),
)


def normalised(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{Nd}]+"), "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(let(words, lambda w: F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b))))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)], "template long, license string, text string")


def units(text: Column) -> Column:
    """Distinct lines, paragraphs and the whole text."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.contains("\n"), F.array_distinct(F.concat(
        F.split(t, "\n"), F.split(t, "\n[\\x20\\x09\\r]*\n"), F.array(t)))).otherwise(F.array(t)))


def anchors(templates: dict[int, list[str]], threshold: float) -> list[str]:
    """Words of which every text that matches a template has at least one.

    A match has at least threshold * (1 + ratio) / 2 of the template's bigrams.
    For each template the longest words are taken until they touch more bigrams
    than a match may lack.
    """
    share = threshold * (1 + threshold / (2 - threshold)) / 2
    out: set[str] = set()
    for own in templates.values():
        may_lack = len(own) - math.ceil(share * len(own) - 1e-9)
        left = {b: set(b.split(" ")) for b in own}
        for word in sorted({w for b in own for w in b.split(" ")}, key=lambda w: (w not in out, -len(w), w)):
            if len(own) - len(left) > may_lack:
                break
            left = {b: ws for b, ws in left.items() if word not in ws}
            out.add(word)
    return sorted(out)


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (of the best unit), n_units (that match), unit_bigrams (of the best unit)."""
    templates = default_templates(docs.sparkSession) if templates is None else templates
    own = templates.select("template", "license", bigrams(normalised(F.col("text"))).alias("b")).withColumn(
        "n", F.size("b")).filter("n > 0")
    low, high, total = own.agg(F.min("n"), F.max("n"), F.sum("n")).first()
    ratio = threshold / (2 - threshold)
    text = F.col(text_col).cast("string")
    if (total or 0) <= BROADCAST_BIGRAMS:
        needed = anchors({r["template"]: r["b"] for r in own.select("template", "b").collect()}, threshold)
        docs = docs.filter(F.arrays_overlap(normalised(text), F.array(*map(F.lit, needed)).cast("array<string>")))
        own = F.broadcast(own.select("template", "license", "n", F.explode("b").alias("bigram")))
    else:
        own = own.select("template", "license", "n", F.explode("b").alias("bigram"))
    # the row number tells repeated rows apart; it is the same whenever a task reads its split again
    d = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                    units(text).alias("units"))
    d = d.select("doc_id", "row", F.posexplode("units").alias("unit", "t"))
    d = d.select("doc_id", "row", "unit", normalised(F.col("t")).alias("w"))
    # a set of m bigrams comes from more than m words; only long repetitive units have many words for few bigrams
    d = d.filter(F.size("w") > F.lit((low or 0) * ratio - SLACK)).select("doc_id", "row", "unit", bigrams(F.col("w")).alias("b"))
    d = d.withColumn("size", F.size("b")).filter(F.col("size").between((low or 0) * ratio - SLACK, (high or 0) / ratio + SLACK))
    pairs = d.select("doc_id", "row", "unit", "size", F.explode("b").alias("bigram")).join(own, "bigram").filter(
        F.col("size").between(F.col("n") * ratio - SLACK, F.col("n") / ratio + SLACK))
    dice = 2 * F.count(F.lit(1)) / (F.max("size") + F.max("n"))
    found = pairs.groupBy("doc_id", "row", "unit", "license", "template").agg(
        dice.alias("dice"), F.max("size").alias("size")).filter(F.col("dice") >= threshold)
    # a unit is under the licence that it is closest to (by name, if two are as close)
    best = found.groupBy("doc_id", "row", "unit").agg(F.min(F.struct((-F.col("dice")).alias("far"), "license", "size"))
                                                      .alias("m")).select("doc_id", "row", "m.*")
    best = best.groupBy("doc_id", "row", "license").agg(F.min(F.struct("far", "size")).alias("m"),
                                                        F.count(F.lit(1)).alias("n_units"))
    return best.groupBy("doc_id", "license").agg(F.min("m").alias("m"), F.max("n_units").alias("n_units")).select(
        "doc_id", "license", (-F.col("m.far")).alias("dice"), F.col("m.size").cast("long").alias("unit_bigrams"), "n_units")
