"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

#: Words per shingle; shingles per window; step between windows; bands of one MinHash each.
SHINGLE, WINDOW, STEP, BANDS = 5, 4, 2, 24
#: Share of a template's shingles that a document must hold.
CONTAINMENT = 0.8
#: Windows of all templates together up to which their bands are sent to every task; more are joined by a shuffle.
MAX_TEMPLATE_WINDOWS = 20_000

#: Names and wording of license notices as their publishers give them.
TEMPLATES = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "mit": "Released under the MIT License.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
#: ASCII white space and punctuation, between words.
_GAP = r"[\x09-\x0D -/:-@\[-`{-~]+"


def license_words(text: Column) -> Column:
    """Lower-case words between ASCII white space and punctuation; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _starts(words: Column, n: int = SHINGLE) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))


def shingle_hashes(words: Column) -> Column:
    """A hash for each run of five hashed words; fewer words are one shingle; no words, none."""
    return F.when(F.size(words) > 0, F.transform(_starts(words), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(F.array().cast("array<long>"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_texts(words: Column) -> Column:
    return F.array_distinct(F.when(F.size(words) > 0, F.transform(_starts(words), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))).otherwise(F.array().cast("array<string>")))


def _windows(hashes: Column, step: int) -> Column:
    """Windows of four shingles, a step apart, the last one shorter; every run of three lies in one of them."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - (WINDOW - step), F.lit(1)), F.lit(step)), lambda i: F.slice(hashes, i, WINDOW))


def _bands(windows: DataFrame, keep: str) -> DataFrame:
    """(keep, win) → (keep, band): the MinHash of a window under each band's hash function.

    The band's number is hashed with each shingle. A row per window and band, not a column per band: the
    expression stays small enough to be compiled.
    """
    item = [f"w{j}" for j in range(WINDOW)]
    flat = windows.select(keep, *[F.get("win", F.lit(j)).alias(w) for j, w in enumerate(item)])
    each = flat.select(keep, *item, F.explode(F.array(*map(F.lit, range(BANDS)))).alias("b"))
    return each.select(keep, F.least(*[F.when(F.col(w).isNotNull(), F.xxhash64(w, "b")) for w in item]).alias("band"))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license_id, n_matched, n_shingles, containment of every template that a document holds.

    A template of up to three shingles lies whole in some window; the window agrees with it in one band with the
    share of their common shingles, at least a quarter, so that none of 24 bands agrees with probability 0.001
    at most. Longer templates are indexed by all their windows, some of which equal a window of the text. Windows
    that agree name the pair; exact containment of the template's distinct shingles in the document decides.

    Null or empty text, no rows. Rows with one doc_id, or none, count as one document's texts: the best of them
    decides. Repeated rows change nothing. Empty table: no rows. Other columns of docs aren't read. Templates
    beyond MAX_TEMPLATE_WINDOWS are joined by a shuffle instead of a broadcast, with the same result.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license_id string, template string").withColumn("w", license_words(F.col("template"))).where(F.size("w") > 0)
    hashed = table.select("license_id", _hashed(F.col("w")).alias("w")).select("license_id", shingle_hashes(F.col("w")).alias("h"))
    own = _bands(hashed.select("license_id", F.explode(_windows(F.col("h"), 1)).alias("win")), "license_id")
    index = staged(own.distinct(), "license-index")
    few = index.limit(MAX_TEMPLATE_WINDOWS * BANDS + 1).count() <= MAX_TEMPLATE_WINDOWS * BANDS

    # words and hashes are columns of their own: inside a lambda their expressions would be evaluated per shingle
    worded = docs.select("doc_id", license_words(F.col("text")).alias("w")).select("doc_id", _hashed(F.col("w")).alias("w")).where(F.size("w") > 0)
    hashed = worded.select("doc_id", shingle_hashes(F.col("w")).alias("h"))
    windows = hashed.select("doc_id", F.explode(_windows(F.col("h"), STEP)).alias("win"))
    banded = _bands(windows, "doc_id")
    found = banded.join(F.broadcast(index) if few else index.hint("shuffle_hash"), "band")
    pairs = staged(found.select("doc_id", "license_id").distinct(), "license-pairs")

    texts = table.select("license_id", shingle_texts(F.col("w")).alias("t"))
    checked = (
        docs.select("doc_id", "text").alias("d")
        .join(pairs.groupBy("doc_id").agg(F.collect_set("license_id").alias("ids")).alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")))
        .select("d.doc_id", license_words(F.col("d.text")).alias("w"), "p.ids")
        .select("doc_id", shingle_texts(F.col("w")).alias("s"), F.explode("ids").alias("license_id"))
        .join(F.broadcast(texts) if few else texts, "license_id")
        .select("doc_id", "license_id", F.size(F.array_intersect("t", "s")).cast("long").alias("n_matched"), F.size("t").cast("long").alias("n_shingles"))
        .where(F.col("n_matched") >= F.lit(containment) * F.col("n_shingles"))
    )
    best = checked.groupBy("doc_id", "license_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_shingles").alias("n_shingles"))
    return best.withColumn("containment", F.col("n_matched") / F.col("n_shingles"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all license templates: a row for each license that a document holds.

    Null and empty texts hold none; a document without licenses has no row. Of rows with one doc_id the best
    containment counts, null ids as one id. Empty table: no rows.
    """
    return license_matches(read_table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPLIT_SQL = r"""list_filter(regexp_split_to_array(lower({text}), '[\x09-\x0D !-/:-@\[-`{{-~]+'), lambda w: w <> '')"""
_SHINGLE_SQL = "list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))"
OP4_SQL = f"""
WITH templates AS (
  SELECT license_id, {_SHINGLE_SQL} AS t FROM (
    SELECT license_id, {_SPLIT_SQL.format(text="template")} AS w
    FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}) AS x(license_id, template))),
docs AS (
  SELECT doc_id, {_SHINGLE_SQL} AS s FROM (SELECT doc_id, {_SPLIT_SQL.format(text="coalesce(text, '')")} AS w FROM documents) WHERE len(w) > 0),
pairs AS (
  SELECT doc_id, license_id, max(len(list_intersect(t, s))) AS n_matched, max(len(t)) AS n_shingles
  FROM docs CROSS JOIN templates GROUP BY ALL)
SELECT doc_id, license_id, CAST(n_matched AS BIGINT) AS n_matched, CAST(n_shingles AS BIGINT) AS n_shingles, n_matched / n_shingles AS containment
FROM pairs WHERE n_matched >= 0.8 * n_shingles
"""
