"""Licence scans (DataFrame functions only).

Templates are public licence texts and notices: every text as a whole, and every paragraph of
one that no other licence has, is a unit vector of TF-IDF weights.  They are a constant of this module,
so the table of their weights has a fixed size.

Texts are cut into segments at line and sentence ends.  A segment that holds a gate word
becomes a sparse TF-IDF vector, and so does a header: the run of segments with a gate word that
is no everyday word, with up to ``GAP`` others between two of them, and so does a title: the first such
segment with the next one that has words (a licence's name and its version stand on two lines).  They are compared by cosine
with the templates.  Gate words are derived from the templates (:func:`gate_words`): what is left of
any template without them is shorter than ``LEAST``, so no segment that reaches it is missed.
A unit is only taken apart into tokens if a bound of its cosine, from the numbers of its
distinct words inside and outside of all templates, reaches ``least`` (:func:`could_reach`).
Each unit that reaches ``least`` speaks for its best template's licence with its cosine times the words
that the two can share (the shorter's number), ``TITLE`` times that if it begins in the text's first lines, and a
document's own licence is the one that most speaks for.  A file as a whole speaks only for a template of its size.
So a notice or a title with its version decides against a single line on rights, and against a text that only
resembles another licence's notice; the cosine of the result is the licence's best.

A licence file covers its directory and everything below.  Licence files are
documents named like one (LICENSE, COPYING, ...), compared as a whole as well,
and documents of whose words the licence segments, or one licence header, make up at least
``file_share``.  A document without a licence of its own inherits from the nearest
ancestor directory that has a licence file.  The search runs once per distinct
directory (its ancestors joined to the licensed ones by path); documents then join
their directory, a join whose hot side Spark's skew join can split.

Defined results: null or empty texts have no licence of their own; a null path is
in no directory and inherits nothing; equal cosines go to the first licence in
alphabetical order, in a directory, and equal voices in a document; repeated rows give repeated
results; texts of any length are read whole; other columns don't pass; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts and their usual notices, by licence identifier.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."
_CC = {"CC-BY": "Attribution", "CC-BY-NC": "Attribution-NonCommercial", "CC-BY-SA": "Attribution-ShareAlike"}
_GFDL = "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {version} or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."
TEMPLATES = {
    "AGPL-3.0": [_GNU.format(name="Affero ", version=3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0.\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0.", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "SPDX-License-Identifier: Apache-2.0.",
    ],
    "BSD-2-Clause": [_BSD + _BSD_AS_IS, "SPDX-License-Identifier: BSD-2-Clause."],
    "BSD-3-Clause": [_BSD + _BSD_THIRD + _BSD_AS_IS, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", "SPDX-License-Identifier: BSL-1.0."],
    "Artistic-1.0": ["The \"Artistic License\"", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.", "SPDX-License-Identifier: Artistic-1.0."],
    **{f"{k}-4.0": [f"Licensed under {k.replace('CC-', 'CC ')} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License."] for k, name in _CC.items()},
    **{f"{k}-3.0": [f"Licensed under {k.replace('CC-', 'CC ')} 3.0.", f"This work is licensed under a Creative Commons {name} 3.0 Unported License."] for k, name in _CC.items()},
    "CC0-1.0": ["Released under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https www.eclipse.org legal epl-2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.", "SPDX-License-Identifier: EPL-2.0."],
    "GFDL-1.2": [_GFDL.format(version="1.2"), "GNU Free Documentation License Version 1.2, November 2002"],
    "GFDL-1.3": [_GFDL.format(version="1.3"), "GNU Free Documentation License Version 1.3, 3 November 2008"],
    "GPL-1.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "GPL-2.0": [_GNU.format(name="", version=2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0."],
    "GPL-3.0": [_GNU.format(name="", version=3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "SPDX-License-Identifier: ISC."],
    "LGPL-2.0": [_LIBRARY.format(name="Library", version="2"), "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-2.1": [_LIBRARY.format(name="Lesser", version="2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": [_GNU.format(name="Lesser ", version=3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0."],
    "MIT": [_GRANT + "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS, "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.mozilla.org MPL", "MOZILLA PUBLIC LICENSE Version 1.1", "SPDX-License-Identifier: MPL-1.1."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla.org MPL 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0."],
    "Proprietary": ["Copyright. All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.", "SPDX-License-Identifier: Zlib."],
}
for _name in ("AGPL-3.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0"):
    TEMPLATES[_name] += [f"SPDX-License-Identifier: {_name}{suffix}" for suffix in ("-only", "-or-later")]
# Everyday words, the last to become gate words.
COMMON = frozenset("a all an and any are as at be by can do for from has i if in is it its may more must no not of on one or out so such that the them then this to under use was which will with without you your http https www 1 2 3".split())

TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([._-][^/]*)?$"
LEAST = 0.6
FILE_SHARE = 0.25
GAP = 1
#: Units that begin in so many first segments are a title, and count so often.
TITLE_LINES, TITLE = 8, 8
#: Units are numbered by their first segment: segments from 0, headers from -2 and titles from -TITLES down.
TITLES = 1 << 30
#: Words that most templates have keep this little of a weight.
SMOOTH = 0.1


def template_texts(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    """(licence, number, words): every text as a whole, and every paragraph that no other licence has."""
    out = []
    owners = Counter(u for many in templates.values() for u in {u for t in many for u in t.split("\n\n")})
    for name, many in sorted(templates.items()):
        units = [u for t in many for u in dict.fromkeys([t, *[x for x in t.split("\n\n") if owners[x] == 1]])]
        out += [(name, i, re.findall(TOKEN, u.lower())) for i, u in enumerate(units)]
    return out


def template_weights(templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[tuple[str, str, int, float]], dict[str, float], float]:
    """(token, licence, template, unit weight) rows, idf by token, idf of other tokens."""
    texts = template_texts(templates)
    df = Counter(w for _, _, words in texts for w in set(words))
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + SMOOTH for w, n in df.items()}
    rows = []
    for name, i, words in texts:
        tf = Counter(words)
        norm = math.sqrt(sum(((1 + math.log(n)) * idf[w]) ** 2 for w, n in tf.items()))
        rows += [(w, name, i, (1 + math.log(n)) * idf[w] / norm) for w, n in sorted(tf.items())]
    return rows, idf, math.log(1 + len(texts)) + SMOOTH


def gate_words(templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> list[str]:
    """Words of which every unit with a cosine of ``least`` or more holds one.

    A unit without them meets only the rest of a template, and its cosine is at most that
    rest's length.  Of each template words are taken, everyday ones last, until that is below ``least``."""
    vectors: dict[tuple[str, int], dict[str, float]] = {}
    for word, name, i, weight in template_weights(templates)[0]:
        vectors.setdefault((name, i), {})[word] = weight
    gate: set[str] = set()
    for vector in vectors.values():
        rest = sum(x * x for w, x in vector.items() if w not in gate)
        for word in sorted(vector, key=lambda w: (w in COMMON, -vector[w], w)):
            if rest < least * least:
                break
            if word not in gate:
                gate.add(word)
                rest -= vector[word] ** 2
    return sorted(gate)


def segments(text: str) -> Column:
    return F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"([.;!?]) +", "$1\n"), "\n")


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def best_template(units: DataFrame, keys: list[str], tokens: str, least: float) -> DataFrame:
    """(keys, licence, cosine, words) of the best template of each unit that reaches ``least``; words is the template's number."""
    spark = units.sparkSession
    rows, idf, other = template_weights()
    sizes = spark.createDataFrame([(name, i, len(words)) for name, i, words in template_texts()], "licence string, template int, words int")
    weights = spark.createDataFrame(rows, "token string, licence string, template int, weight double")
    known = spark.createDataFrame(list(idf.items()), "token string, idf double")
    tf = units.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(known), "token", "left").withColumn("x", (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(other)))
    norms = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = tf.join(F.broadcast(weights), "token").groupBy(*keys, "licence", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, keys).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    best = scored.groupBy(*keys).agg(F.min(F.struct(-F.col("cosine"), F.col("licence"), F.col("template"))).alias("best"))
    best = best.select(*keys, F.col("best.licence").alias("licence"), F.col("best.template").alias("template"), (-F.col("best.col1")).alias("cosine"))
    return best.join(F.broadcast(sizes), ["licence", "template"]).drop("template")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def could_reach(tokens: Column, least: float) -> Column:
    """False only if no template's cosine can be ``least``: what the unit has in common with
    all templates together is too short beside the rest of it.

    The rest has at least the weight of each distinct other word once.  (1 + ln tf) squared is concave,
    so the common part is longest if its occurrences are spread evenly over its distinct words;
    words are bounded by the largest idf of their class (frequent in templates, or not)."""
    _, idf, other = template_weights()
    many = sorted(w for w, x in idf.items() if x <= other / 2)
    # Words of a unit are looked up in a hash set each; set operations on arrays would build theirs anew for each unit.
    distinct = F.array_distinct(tokens)
    within = lambda some: F.size(F.filter(distinct, lambda t: t.isin(some)))
    common, rare = within(many), within(sorted(set(idf) - set(many)))
    strangers = F.size(distinct) - common - rare
    seen = (F.size(tokens) - strangers).cast("double")
    part = lambda distinct, top: F.when(distinct > 0, top * top * distinct * F.pow(1 + F.log(seen / distinct), F.lit(2.0))).otherwise(0.0)
    known = part(common, max((idf[w] for w in many), default=0.0)) + part(rare, max(idf.values()))
    return known >= strangers * (other * other * least * least / (1 - least * least) * 0.999)


def units_of(text: str, gate: list[str], least: float) -> Column:
    """(unit, tokens) of the gated segments (numbered from 0) and headers (from -2 downwards) of a text."""
    strong = [w for w in gate if w not in COMMON]

    def headers(toks: Column, at: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda k: (k == 0) | (F.get(at, k) - F.get(at, k - 1) > GAP + 1))
        ends = lambda k, j: F.struct(F.get(at, k).alias("a"), F.get(at, j - 1).alias("b"))
        runs = _once(heads, lambda h: F.transform(h, lambda k, n: ends(k, F.coalesce(F.get(h, n + 1), F.size(at)))))
        long = F.filter(runs, lambda r: r["a"] < r["b"])
        return F.transform(long, lambda r: F.struct((-r["a"] - 2).alias("unit"), F.flatten(F.slice(toks, r["a"] + 1, r["b"] - r["a"] + 1)).alias("tokens")))

    def title(toks: Column, a: Column) -> Column:
        after = F.get(F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: (i > a) & (F.size(F.get(toks, i)) > 0)), 0)
        both = F.concat(F.get(toks, a), F.coalesce(F.get(toks, after), F.array().cast("array<string>")))
        return F.array(F.struct((-a - TITLES).cast("int").alias("unit"), both.alias("tokens")))

    def gated(toks: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.exists(F.get(toks, i), lambda t: t.isin(gate)))
        lines = F.transform(at, lambda i: F.struct(i.alias("unit"), F.get(toks, i).alias("tokens")))
        leads = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.exists(F.get(toks, i), lambda t: t.isin(strong)))
        found = F.concat(lines, _once(leads, lambda x: F.when(F.size(x) > 0, F.concat(headers(toks, x), title(toks, F.get(x, 0)))).otherwise(F.array().cast("array<struct<unit: int, tokens: array<string>>>"))))
        close = F.filter(found, lambda u: could_reach(u["tokens"], least))
        return _once(close, lambda x: F.when(F.size(x) > 0, x))

    return _once(F.transform(segments(text), words_of), lambda toks: F.struct(F.size(F.flatten(toks)).alias("n_words"), gated(toks).alias("units")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "path", least: float = LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per document: key, path, licence, origin (own, inherited, none), cosine,
    licence_dir (the directory that it inherits from)."""
    from .staging import staged

    named = F.coalesce(F.col(path).rlike(FILE_NAME), F.lit(False))
    base = docs.select(F.col(key).alias("key"), F.col(path).alias("path"), units_of(text, gate_words(least=least), least).alias("found"), named.alias("named"), F.when(named, words_of(F.coalesce(F.col(text), F.lit("")))).alias("whole"), F.xxhash64(key, path, text).alias("hash"))
    base = base.select("key", "path", "named", "whole", F.col("found.n_words").alias("n_words"), F.col("found.units").alias("units"), F.when(named | F.col("found.units").isNotNull(), F.col("hash")).alias("row"))
    slim = staged(base, "licences")
    held = slim.where(F.col("row").isNotNull()).dropDuplicates(["row"])
    parts = held.select("row", "path", "named", "n_words", F.explode("units").alias("u")).select("row", "path", "named", "n_words", "u.unit", "u.tokens")
    whole = held.where("named").select("row", "path", "named", "n_words", F.lit(-1).alias("unit"), F.col("whole").alias("tokens"))
    units = parts.unionByName(whole).withColumn("size", F.size("tokens"))
    found = best_template(units.select("row", "unit", "tokens"), ["row", "unit"], "tokens", least)
    hits = found.join(units.select("row", "unit", "path", "named", "n_words", "size"), ["row", "unit"]).where((F.col("unit") != -1) | (2 * F.col("words") >= F.col("size")))
    begins = F.when(F.col("unit") <= -TITLES, -F.col("unit") - TITLES).when(F.col("unit") < -1, -F.col("unit") - 2).when(F.col("unit") >= 0, F.col("unit"))
    times = F.when(begins < TITLE_LINES, TITLE).otherwise(1)
    # Whole numbers, so that the order of a sum doesn't matter.
    voices = hits.groupBy("row", "licence").agg(F.sum(F.round(F.col("cosine") * 1_000_000).cast("long") * F.least("size", "words") * times).alias("voice"), F.max("cosine").alias("cosine"))
    chosen = voices.groupBy("row").agg(F.min(F.struct(-F.col("voice"), F.col("licence"), F.col("cosine"))).alias("best"))
    own = hits.groupBy("row").agg(
        F.first("path").alias("file"),
        F.first("named").alias("is_named"),
        F.first("n_words").alias("n_words"),
        F.greatest(F.sum(F.when(F.col("unit") >= 0, F.col("size")).otherwise(0)), F.max(F.when(F.col("unit") < -1, F.col("size")).otherwise(0))).alias("covered"),
    )
    own = staged(own.join(chosen, "row").select("row", F.col("best.licence").alias("own"), F.col("best.cosine").alias("own_cosine"), "file", (F.col("is_named") | (F.col("covered") >= file_share * F.col("n_words"))).alias("is_file")), "own")

    parent = lambda c: F.when(F.col(c).contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.when(F.col(c).isNotNull(), F.lit("")))
    licensed = own.where("is_file AND file IS NOT NULL").groupBy(parent("file").alias("licence_dir")).agg(F.min(F.struct(-F.col("own_cosine"), F.col("own"))).alias("best"))
    licensed = licensed.select("licence_dir", F.col("best.own").alias("dir_licence"), (-F.col("best.col1")).alias("dir_cosine"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = slim.where(F.col("path").isNotNull()).select(parent("path").alias("dir")).distinct()
    ancestors = dirs.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("licence_dir"))
    nearest = ancestors.join(licensed, "licence_dir").groupBy("dir").agg(F.max(F.struct(F.length("licence_dir").alias("depth"), "licence_dir", "dir_licence", "dir_cosine")).alias("near"))
    joined = slim.select("key", "path", "row", parent("path").alias("dir")).join(own.select("row", "own", "own_cosine"), "row", "left").join(nearest, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        F.col("key").alias(key),
        "path",
        F.coalesce("own", "near.dir_licence").alias("licence"),
        origin.alias("origin"),
        F.coalesce("own_cosine", "near.dir_cosine").alias("cosine"),
        F.when(F.col("own").isNull(), F.col("near.licence_dir")).alias("licence_dir"),
    )
