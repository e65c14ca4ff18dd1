"""License scan: MinHash bands over overlapping text windows.

A document's words (lower case, letters and digits) are cut into windows of
``SPAN`` shingles that overlap by half.  Templates are cut into pieces of at
most half a window, so every piece lies whole inside some window.  Windows
and pieces are compared by one-row MinHash bands; a band match retrieves the
template, and exact containment of the template's shingles, counted in the
document around the window, decides.

Shingles are five words; a template of fewer words is one shingle of its own
length, and those documents' shingles are taken at that width too.  With
BANDS one-row bands a window that holds a piece with Jaccard similarity s is
retrieved with probability 1 - (1 - s) ** BANDS: a notice of a single shingle
has s >= 1 / SPAN, hence 0.99999, and a longer one has several chances.

A window without a template shingle can match no band (a one-row band's
value is itself a shingle), and a shingle is only there if its longest word
is.  So documents without any such word are left out first, by a hash lookup
per word, and windows without a template shingle before MinHash.
The templates are a fixed list, which bounds everything joined against it.
DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import doc_key, let
from panelkit.session import scratch_path

SHINGLE, SPAN, BANDS, MIN_PERCENT, SHORT = 5, 4, 40, 75, 16
BROADCAST_SHINGLES = 50_000     # template shingles up to which the bands are broadcast (about 100 MB)
# A notice of fewer than SHORT words must be there whole: versions differ in the last
# word ("... version 2", "... version 3"), which leaves three of four shingles.
# Other wordings are templates of their own.

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software"),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


# Names as they stand in "under the ..." notices and after SPDX tags.
_NAMES = {
    "Apache-2.0": ("Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 License", "Apache 2.0",
                   "Apache-2.0", "Apache License v2.0", "Apache 2 License"),
    "MIT": ("MIT License", "MIT", "Expat License", "MIT/X11 License"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License",
                     "Modified BSD License", "Revised BSD License"),
    "BSD": ("BSD License", "BSD-style license"),
    "ISC": ("ISC License", "ISC"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "WTFPL": ("WTFPL",),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License 1.0", "EPL-1.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "Eclipse Public License 2.0", "EPL-2.0"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License v2.0", "Mozilla Public License v. 2.0", "Mozilla Public License Version 2.0",
                "MPL 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero"),
    **{f"{short}-{v}.0": tuple(
        f"{base}{join}{v}{end}" for base in (f"GNU {long}", long, f"GNU {short}", short)
        for join in (" version ", " v", " ", "v") for end in ("", ".0"))
        + tuple(f"{short}-{v}.0{end}" for end in ("-only", "-or-later", "+"))
       for short, long, vs in (("GPL", "General Public License", (2, 3)),
                               ("LGPL", "Lesser General Public License", (2, 3)),
                               ("AGPL", "Affero General Public License", (3,))) for v in vs},
    "LGPL-2.1": ("GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1",
                 "GNU LGPL v2.1", "LGPL v2.1", "LGPL 2.1", "LGPL-2.1"),
    **{f"CC-{kind}-{v}.0": (f"CC {kind} {v}.0", f"CC-{kind} {v}.0",
                            f"Creative Commons {long} {v}.0 International License",
                            f"Creative Commons {long} {v}.0 International", f"Creative Commons {long} {v}.0",
                            f"Creative Commons {long} {v}.0 Unported License")
       for kind, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"),
                          ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                          ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                          ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in (3, 4)},
}
# What may stand before a name that says itself that it is a license, and
# before a short one, which is an ordinary word elsewhere ("under MIT rules").
_PHRASES = ("under {}", "under the {}", "under a {}", "terms of the {}", "SPDX-License-Identifier {}")
_SHORT_PHRASES = tuple(f"{verb} under {article}{{}}" for verb in ("licensed", "released", "distributed", "available")
                       for article in ("", "the ", "a ")) + ("SPDX-License-Identifier {}",)

# Sentences of the license texts and of their standard headers, each a piece
# that stands alone: files often hold a part of a text.
_TEXTS = {
    "MIT-notice": ("The above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the Software",),
    "MIT-permission": ("Permission is hereby granted, free of charge, to any person obtaining a copy",
                       "and to permit persons to whom the Software is furnished to do so, subject to the following "
                       "conditions",),
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    "BSD-conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission"),
    "BSD-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE"),
    "ISC-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "ISC-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    "Apache-2.0-text": (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
        "worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
        "Derivative Works of",
        "You must give any other recipients of the Work or Derivative Works a copy of this License",
        "You must cause any modified files to carry prominent notices stating that You changed the files",
        "Licensor provides the Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
        "ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License"),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "You should have received a copy of the GNU General Public License along with this program"),
    "GPL-text": (
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is "
        "not allowed",
        "The licenses for most software and other practical works are designed to take away your freedom to share "
        "and change the works",
        "The licenses for most software are designed to take away your freedom to share and change it"),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",),
    "AGPL-notice": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "MPL-2.0": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "EPL-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License", ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software",),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work",),
}


def _phrases(name: str) -> tuple[str, ...]:
    """A name of four words and more ("CC BY-SA 4.0") is clear by itself."""
    clear = "licen" in name.lower() or len([w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]) >= 4
    return _PHRASES if clear else _SHORT_PHRASES


def all_templates() -> dict[str, str]:
    """Every wording; those of one notice differ after ``#``."""
    found = dict(TEMPLATES)
    for name, names in _NAMES.items():
        for k, wording in enumerate(p.format(n) for n in names for p in _phrases(n)):
            found[f"{name}#n{k}"] = wording
    for name, pieces in _TEXTS.items():
        found |= {f"{name}#t{k}": piece for k, piece in enumerate(pieces)}
    return found


def notice_words(text: Column) -> Column:
    """Lower-case words: runs of digits, letters a-z and non-ASCII characters;
    "licence" and "licenced" are spelt with an s."""
    spelt = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\blicence(d?)\\b", "license$1")
    return F.array_remove(F.split(spelt, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingles(words: Column, width: int) -> Column:
    """Shingle hashes in text order, one per start."""
    n = F.size(words)
    runs = words if width == 1 else F.arrays_zip(words, *[F.slice(words, k + 1, n) for k in range(1, width)])
    return F.when(n < width, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice(runs, 1, n - (width - 1)), lambda s: F.xxhash64(F.lit(width), s)))


def _minhash(grams: Column) -> Column:
    """The shingle that is smallest under each band's order."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(
        F.transform(grams, lambda g: F.struct(F.xxhash64(k, g).alias("o"), g.alias("g"))))["g"])


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """name, ws (words) of the templates that have any."""
    rows = spark.createDataFrame(list(templates.items()), "name string, notice string")
    words = rows.select("name", notice_words(F.col("notice")).alias("ws")).where(F.size("ws") > 0)
    # Wordings of one notice may have the same words.
    return words.groupBy(F.substring_index("name", "#", 1).alias("of"), "ws").agg(F.min("name").alias("name")) \
        .select("name", "ws")


def template_table(spark: SparkSession, templates: dict[str, str], width: int) -> DataFrame:
    """name, m (words), ws, grams (distinct shingles) of the width's templates."""
    mine = (F.size("ws") >= SHINGLE) if width == SHINGLE else (F.size("ws") == width)
    return _templates(spark, templates).where(mine).select(
        "name", F.size("ws").alias("m"), "ws", F.array_distinct(shingles(F.col("ws"), width)).alias("grams"))


def _scan(docs: DataFrame, temps: DataFrame, lookup: list[int], width: int, reach: int, shingled: int) -> DataFrame:
    """name, doc_id, key, start, percent of the verified places."""
    span, stride = SPAN, (width + SPAN - 1) // 2        # shingles of a window; words between windows
    known = F.split(F.lit(" ".join(map(str, lookup))), " ").cast("array<bigint>")   # folded to one literal
    held = docs.select("doc_id", "key", shingles(F.col("ws"), width).alias("all")) \
        .where(F.arrays_overlap("all", known))

    def windows_of(grams):
        starts = F.sequence(F.lit(0), F.size(grams) - 1, F.lit(stride))
        hit = let(F.array_intersect(grams, known), lambda mine: F.filter(
            starts, lambda a: F.arrays_overlap(F.slice(grams, a + 1, F.lit(span)), mine)))
        return F.transform(hit, lambda a: F.struct(
            a.alias("at"), F.slice(grams, a + 1, F.lit(span)).alias("grams"),
            F.greatest(F.lit(0), a - reach).alias("lo"),
            F.slice(grams, F.greatest(F.lit(0), a - reach) + 1, F.lit(span + 2 * reach)).alias("near")))
    windows = held.select("doc_id", "key", F.explode(let(F.col("all"), windows_of)).alias("w"))
    bands = windows.select("doc_id", "key", "w.at", "w.lo", "w.near",
                           F.posexplode(_minhash(F.col("w.grams"))).alias("band", "value"))
    step = max(1, stride // 2)
    piece = temps.select("name", "m", "grams", "ws", F.explode(F.sequence(
        F.lit(0), F.greatest(F.lit(0), F.floor((F.col("m") - 1) / step)) * step, F.lit(step)).cast("array<int>")).alias("from")) \
        .withColumn("part", shingles(F.slice("ws", F.col("from") + 1, stride + 1), width)) \
        .where(F.size("part") > 0)
    piece_bands = piece.select("name", "m", F.col("grams").alias("t_grams"),
                               F.posexplode(_minhash(F.col("part"))).alias("band", "value")) \
        .dropDuplicates(["name", "band", "value"])
    # Verified where they are found: the near shingles are never shuffled,
    # and equal places fall together in license_places.
    side = F.broadcast(piece_bands) if shingled <= BROADCAST_SHINGLES else piece_bands
    found = bands.join(side, ["band", "value"])
    # Count the template's shingles in the document around the window.
    skip = F.greatest(F.lit(0), F.col("at") - F.col("m")) - F.col("lo")
    region = F.slice("near", skip + 1, F.col("at") - F.col("lo") - skip + span + F.col("m"))
    share = F.size(F.array_intersect("t_grams", region)) * 100.0 / F.size("t_grams")
    first = F.array_min(F.filter(F.transform("t_grams", lambda g: F.array_position(region, g)), lambda p: p > 0))
    return found.select("doc_id", "key", "name", "m", share.alias("percent"),
                        (F.col("lo") + skip + first - 1).cast("int").alias("start")) \
        .where(F.col("percent") >= F.when(F.col("m") < SHORT, 100).otherwise(MIN_PERCENT)).drop("m")


def _needed_words(spark: SparkSession, templates: dict[str, str]) -> list[str]:
    """The longest word of every template shingle (a fixed list)."""
    found = set()
    for row in _templates(spark, templates).collect():
        width = min(SHINGLE, len(row.ws))
        for k in range(len(row.ws) - width + 1):
            found.add(max(row.ws[k:k + width], key=lambda w: (len(w), w)))
    return sorted(found)


def license_places(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, key, name, percent, start (word) of every notice found.

    Null, empty or wordless texts have none.  Repeated rows give one row per
    place.  Very long texts are scanned whole, window by window.
    """
    templates = all_templates() if templates is None else templates
    spark = docs.sparkSession
    words = docs.select("doc_id", doc_key(F.col("text")).alias("key"), notice_words(F.col("text")).alias("ws"))
    needed = F.split(F.lit(" ".join(_needed_words(spark, templates))), " ")
    path = scratch_path(spark, "license-candidates")
    words.where(F.arrays_overlap("ws", needed)).write.parquet(path)
    words = spark.read.schema(words.schema).parquet(path)
    out = None
    for width in range(1, SHINGLE + 1):
        temps = template_table(spark, templates, width)
        fixed = temps.select("m", "grams").collect()        # the fixed list
        if not fixed:
            continue
        lookup = sorted({g for r in fixed for g in r.grams})
        part = _scan(words, temps, lookup, width, max(r.m for r in fixed), sum(len(r.grams) for r in fixed))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return words.select("doc_id", "key", F.lit("").alias("name"), F.lit(0.0).alias("percent"),
                            F.lit(0).alias("start")).where(F.lit(False))
    out = out.withColumn("name", F.substring_index("name", "#", 1))
    return out.groupBy("doc_id", "key", "name", "start").agg(F.max("percent").alias("percent"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Every document row with its notices: n_licenses and licenses (sorted
    distinct names); 0 and [] where there is none."""
    found = license_places(docs, templates).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set("name")).alias("licenses")) \
        .select(F.col("doc_id").alias("l_doc"), F.col("key").alias("l_key"), "licenses")
    rows = docs.select("doc_id", doc_key(F.col("text")).alias("key"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("key") == F.col("l_key")), "left")
    names = F.coalesce("licenses", F.array().cast("array<string>"))
    return out.select("doc_id", F.size(names).cast("long").alias("n_licenses"), names.alias("licenses"), "key")
