"""License scan by MinHash bands over overlapping windows, in DataFrame functions only (operator 10).

Texts and license templates become sequences of 5-word shingle hashes. Templates of c to 2c - 1 shingles form a class,
for c a power of two (all short ones are of the class 8); for each class a text is cut into overlapping windows, so that
every run as long as a template of the class lies whole in one. Windows and templates are signed by their BANDS least
hashes (MinHash with one permutation), each a band's value, and a window meets a template where they share one.

A window and a template with 0.8 of its shingles have a Jaccard similarity of 0.29 or more, so each of the BANDS least
hashes of both together is shared with that probability, and such a pair misses each other with at most 0.71^32, below
0.0001; windows of the class 8 are signed by all they hold and miss none. A window that met a template is then compared
with it exactly. Signatures are made within generated code, a window at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import computed, materialise
from helixframe.llm.decontamination import plain_words

WORDS = 5
BANDS = 32
#: The class of all templates of fewer than twice as many shingles.
LEAST = 8
CONTAINMENT = 0.8
#: Band values of templates looked up in one pass over the documents: bounds what is broadcast; more are taken in blocks.
BLOCK = 1_000_000

# Wording of public license notices; of licenses with versions or variants the part that tells them apart.
TEMPLATES = {
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT short": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0 short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0 notice": "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-2.1 notice": "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "LGPL-3.0 notice": "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0 notice": "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0.",
    "OFL-1.1 notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Zlib grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def templates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license_id string, text string")


def _shingles(df: DataFrame) -> DataFrame:
    """Add ``shingles``: the hash of every run of WORDS words (null where there is none)."""
    words = computed(df, "words", plain_words(F.col("text")))
    own = F.transform(F.sequence(F.lit(0), F.size("words") - WORDS), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WORDS))))
    return computed(words, "shingles", F.when(F.size("words") >= WORDS, own))


def size_class(m: int) -> int:
    """The power of two c with c <= m < 2c, LEAST at least."""
    return max(LEAST, 1 << (m.bit_length() - 1))


def window_shape(c: int) -> tuple[int, int]:
    """(step, width) of the windows for templates of the class ``c``."""
    step = c if c == LEAST else c // 2
    return step, 2 * c - 2 + step


def signature(values: Column) -> Column:
    return F.slice(F.sort_array(values), 1, BANDS)


def _key() -> Column:
    """A band's value, apart for each class."""
    return F.col("low").bitwiseXOR(F.col("c").cast("long"))


def scan(docs: DataFrame, templates: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and license found in it: doc_id, license_id, containment (best window), first_word.

    ``first_word`` is where the first best window's first shared shingle starts, counted in words from 0. Null, empty
    and shorter texts hold no shingle and match nothing; templates of fewer than WORDS words never match; rows with a
    null doc_id are left out. Repeated rows give one row; extra columns are ignored; empty tables give an empty result.
    """
    m = F.size("shingles")
    c = F.greatest(F.lit(LEAST), F.pow(F.lit(2), F.floor(F.log2(m + 0.5))).cast("int"))
    wanted = materialise(_shingles(templates.select("license_id", "text")).where("shingles is not null").select("license_id", F.array_distinct("shingles").alias("template"), c.alias("c")).distinct(), "license-templates")
    classes = sorted(r[0] for r in wanted.select("c").distinct().collect())  # 20 for templates of a million words
    if not classes:
        return docs.sparkSession.createDataFrame([], "doc_id long, license_id string, containment double, first_word long")
    bands = materialise(wanted.select("license_id", "c", F.explode(signature(F.col("template"))).alias("low")).select("license_id", _key().alias("key")).distinct(), "license-bands")
    blocks = -(-bands.count() // block)
    rows = _shingles(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).where("shingles is not null").select("doc_id", "shingles")
    shapes = F.array(*(F.struct(F.lit(c).alias("c"), *(F.lit(x).alias(n) for x, n in zip(window_shape(c), ("step", "width"), strict=True))) for c in classes))
    rows = rows.select("doc_id", "shingles", F.explode_outer(shapes).alias("s")).select("doc_id", "shingles", "s.*")
    last = F.greatest(F.lit(0), F.ceil((F.size("shingles") - F.col("width")) / F.col("step")).cast("int"))
    rows = rows.select("doc_id", "shingles", "c", "step", "width", F.explode_outer(F.sequence(F.lit(0), last)).alias("k")).withColumn("start", F.col("k") * F.col("step"))
    rows = rows.withColumn("own", signature(F.slice("shingles", F.col("start") + 1, F.col("width"))))
    rows = rows.select("doc_id", "shingles", "c", "width", "start", F.explode_outer("own").alias("low")).select("doc_id", "shingles", "width", "start", _key().alias("key"))

    def found(part: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("license_id"), F.lit(blocks)) == part
        met = rows.join(F.broadcast(bands.where(mine)), "key")
        met = met.select("doc_id", "license_id", "start", F.slice("shingles", F.col("start") + 1, F.col("width")).alias("window"))
        met = met.join(F.broadcast(wanted.where(mine).select("license_id", "template")), "license_id")
        shared = F.size(F.array_intersect("template", "window")) / F.size("template")
        first = F.array_min(F.filter(F.transform("window", lambda h, i: F.when(F.array_contains("template", h), i)), lambda i: i.isNotNull()))
        return met.select("doc_id", "license_id", shared.alias("containment"), (F.col("start") + first).cast("long").alias("at")).where(F.col("containment") >= CONTAINMENT)

    checked = found(0)
    for part in range(1, blocks):
        checked = checked.unionByName(found(part))
    best = checked.groupBy("doc_id", "license_id").agg(F.max(F.struct("containment", (-F.col("at")).alias("back"))).alias("b"))
    return best.select("doc_id", "license_id", F.col("b.containment").alias("containment"), (-F.col("b.back")).alias("first_word"))


def license_sql() -> str:
    """The same in DuckDB's SQL, by comparing each window with each template that shares a shingle with it."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT license_id, {words} AS w FROM (VALUES {values}) AS v(license_id, text)),
ts AS (SELECT license_id, len(w) - {WORDS - 1} AS m, unnest(range(1, len(w) - {WORDS - 2})) AS i, w FROM t WHERE len(w) >= {WORDS}),
tsh AS (SELECT DISTINCT license_id, m, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s FROM ts),
tn AS (SELECT license_id, count(*) AS n FROM tsh GROUP BY 1),
tc AS (SELECT DISTINCT license_id, c, step, 2 * c - 2 + step AS width FROM (SELECT *, CASE WHEN c = {LEAST} THEN c ELSE c // 2 END AS step FROM (SELECT license_id, greatest({LEAST}, (2 ** floor(log2(m + 0.5)))::BIGINT) AS c FROM tsh))),
d AS (SELECT doc_id, {words} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
dsh AS (SELECT doc_id, i, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, WORDS))}) AS s FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT doc_id, i, license_id, step, width, s FROM dsh JOIN tsh USING (s) JOIN tc USING (license_id)),
win AS (SELECT *, unnest(range(greatest(0, ceil((i - width + 1) / step)::BIGINT), i // step + 1)) AS k FROM hit),
agg AS (SELECT doc_id, license_id, k, count(DISTINCT s) AS shared, min(i) AS first FROM win GROUP BY ALL),
ok AS (SELECT doc_id, license_id, shared / n AS containment, first FROM agg JOIN tn USING (license_id) WHERE shared / n >= {CONTAINMENT})
SELECT doc_id, license_id, containment, first::BIGINT AS first_word FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, license_id ORDER BY containment DESC, first) = 1
"""
