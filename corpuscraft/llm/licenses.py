"""Licence families of paragraphs by sparse word n-gram logistic regression, in DataFrame functions only.

The classifier is trained on the driver from the notices below: names of licences in phrases, notices and whole permission texts
of public licences. The unknown class is trained on names of licences outside the families, on agreements without a name and on
plain sentences that share their words. Held-out names (never seen in any phrase) give the temperature that calibrates the
probabilities and the figures in ``model()``. Weights of words and word pairs travel as a literal table bounded by these notices;
documents meet it in a broadcast join. A prediction is confirmed by comparing the paragraph with the family's notices: the share
of a notice's n-grams that the paragraph holds, each weighed by how few families use it, so that what many licences say confirms
none of them.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, notices and permission texts of public licences, by family.
NAMES = {
    "mit": ["the MIT License", "MIT License", "the MIT licence", "the Expat License", "the MIT/X11 License", "MIT"],
    "apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 license", "Apache-2.0", "the Apache Software License", "ASL 2.0"],
    "gpl": ["the GNU General Public License", "the GNU GPL", "the GPL", "GNU General Public Licence"],
    "gpl-3.0": ["the GNU General Public License, version 3", "GNU General Public License v3.0", "the GPL version 3", "GPLv3", "GPL-3.0", "GNU GPL v3", "GPL-3.0-or-later"],
    "gpl-2.0": ["the GNU General Public License, version 2", "GNU General Public License v2.0", "the GPL version 2", "GPLv2", "GPL-2.0", "GNU GPL v2", "GPL-2.0-only"],
    "lgpl": ["the GNU Lesser General Public License", "GNU Lesser General Public License v2.1", "the LGPL", "LGPL-3.0", "LGPLv3", "the GNU Library General Public License", "LGPL-2.1"],
    "agpl-3.0": ["the GNU Affero General Public License, version 3", "GNU Affero General Public License", "the AGPL", "AGPL-3.0", "AGPLv3", "the Affero GPL"],
    "bsd": ["the BSD License", "the 3-Clause BSD License", "the BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "the New BSD License", "the Simplified BSD License"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "the MPL 2.0", "MPL-2.0", "Mozilla Public Licence"],
    "epl": ["the Eclipse Public License 2.0", "Eclipse Public License v1.0", "EPL-2.0", "the Eclipse Public Licence"],
    "eupl": ["the European Union Public Licence", "EUPL-1.2", "the EUPL", "European Union Public License v1.2"],
    "bsl-1.0": ["the Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "zlib": ["the zlib License", "the zlib/libpng License", "Zlib"],
    "artistic": ["the Artistic License 2.0", "Artistic-2.0", "the Perl Artistic License"],
    "cddl": ["the Common Development and Distribution License", "CDDL-1.0", "the CDDL"],
    "ofl": ["the SIL Open Font License, Version 1.1", "OFL-1.1", "the Open Font License"],
    "wtfpl": ["the Do What The Fuck You Want To Public License", "the WTFPL"],
    "cc-by": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0", "CC-BY-4.0", "Creative Commons BY 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0", "Creative Commons Attribution Share Alike", "Creative Commons BY-SA"],
    "cc-by-nc": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "Creative Commons Attribution Non Commercial", "CC BY-NC-SA 4.0", "CC-BY-NC-ND-4.0"],
    "cc0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication", "CC0-1.0", "Creative Commons Zero", "the Creative Commons CC0 waiver"],
    "isc": ["the ISC License", "ISC License", "the ISC licence"],
    "unlicense": ["the Unlicense", "The Unlicense public domain dedication", "Unlicense"],
}
GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
BODIES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-3.0": ["This program " + GNU.format("", 3), "This file " + GNU.format("", 3)],
    "gpl-2.0": ["This program " + GNU.format("", 2), "This file " + GNU.format("", 2)],
    "gpl": ["This program " + WARRANTY.format(""), "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."],
    "lgpl": ["This library " + GNU.format("Lesser ", "2.1"), "This library " + WARRANTY.format("Lesser "), "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "agpl-3.0": ["This program " + GNU.format("Affero ", 3), "This program " + WARRANTY.format("Affero "), "You should have received a copy of the GNU Affero General Public License along with this program."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "eupl": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL. You may not use this work except in compliance with the Licence."],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at https://scripts.sil.org/OFL"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
}
PHRASES = ["{}", "Licensed under {}.", "This work is licensed under {}.", "Released under {}.", "Distributed under the terms of {}.", "This software is available under {}.", "This project is made available under {}; see the file LICENSE for details.", "SPDX-License-Identifier: {}", "The text is published under {}.", "Code in this repository is covered by {}."]
OTHERS = ["an agreement with the vendor", "the terms of use of this site", "a commercial license", "a proprietary license", "the company license", "a custom license", "version 2.0 of the plan", "the general conditions", "the terms agreed with the author", "a permissive license", "version 3 of the work", "an open license", "a public agreement", "the laws of the state", "the usual terms", "the Server Side Public License", "the Business Source License 1.1", "the Elastic License 2.0", "the Commons Clause", "the Beerware License", "the Open Government Licence v3.0", "the Academic Free License", "the PHP License, version 3.01", "the OpenSSL License", "the Q Public License", "the Common Public License", "the IBM Public License", "the CERN Open Hardware Licence", "the Python Software Foundation License", "the Microsoft Public License", "the Open Data Commons Attribution License", "the Community Data License Agreement", "the Nokia Open Source License", "the Ruby License", "the Vim License", "a public license of our own", "the Sun Public License", "the Open Software License 3.0", "the Llama Community License"]
PLAIN = ["All rights reserved.", "Copyright by the author.", "See the license file for details.", "See the file for the terms of the work.", "A driving license is needed.", "The general public is welcome.", "This software is provided as is.", "Use of this work needs permission of the author.", "The foundation published a new version.", "Free of charge for any person.", "The source was modified.", "The mozilla project and the apache helicopter.", "He studied at MIT in Boston.", "Mit.", "Mit der Zeit.", "und mit den", "mit, von", "The common good of creative people.", "Permission was granted.", "The software was released in May.", "Terms and conditions apply.", "The university of Berkeley.", "Copy of this file.", "The eclipse of the sun.", "A boost for the economy.", "The European Union and the public.", "An artistic work.", "The font is open.", "Attribution of the quotation.", "The library is open to the public.", "A lesser man would have left."]
UNKNOWN = "unknown"
STOP = frozenset("a an and any are as at be by for from if in is it of on or that the this to was with you can not may de la le der die das que en el un und et les des".split())
CUT, CONFIRM = r"[^a-z0-9]+", 0.45
#: A paragraph that no family confirms counts as unknown only if it speaks of a licence.
#: Families whose notices name the GNU licence in general too.
SPECIAL = ("gpl-2.0", "gpl-3.0", "lgpl", "agpl-3.0")
CUE = r"(?i)licen[cs]e|spdx|copyright|redistribut|public domain"
#: Paragraphs end at lines without letters and digits (blank, or comment marks alone) and at lines that end a sentence.
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*\n|(?<=[.!?])[ \t\r]*\n"


def ngrams(text: str) -> set[str]:
    """Words and pairs of neighbouring words, but those made of stop words or single digits alone."""
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]
    plain = lambda w: w in STOP or (len(w) == 1 and w.isdigit())
    return {w for w in words if not plain(w)} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not (plain(a) and plain(b))}


def examples() -> list[tuple[str, str, int]]:
    """text, family, fold: a name is in one fold with all its phrases, so a held-out name was seen in none."""
    out = []
    for family, names in [*NAMES.items(), (UNKNOWN, OTHERS)]:
        out += [(p.format(n), family, k % 4) for k, n in enumerate(names) for p in PHRASES]
    out += [(b, family, -1) for family, bodies in BODIES.items() for b in bodies for _ in range(4)]
    return out + [(x, UNKNOWN, k % 4) for k, x in enumerate(PLAIN) for _ in range(4)]


def descend(rows: list[np.ndarray], y: np.ndarray, n_features: int, n_classes: int, rounds: int = 160, rate: float = 1.0, ridge: float = 3e-4) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient descent over the rows' feature lists; the last feature is the
    intercept."""
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    order = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[order], return_index=True)
    w, gold = np.zeros((n_features, n_classes)), np.eye(n_classes)[y]
    ahead = w
    for k in range(rounds):
        z = np.add.reduceat(ahead[flat], starts, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = (p - gold) / len(rows)
        grad = np.zeros_like(w)
        grad[used] = np.add.reduceat(step[row[order]], first, axis=0)
        new = ahead - rate * (grad + ridge * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


@lru_cache(maxsize=1)
def model() -> dict:
    """classes, features, weights (scaled by the fitted temperature), bias; the weighed templates of each family; of the held-out
    names: accuracy, unknown (the share of unknown examples found unknown) and loss."""
    data = examples()
    classes = [*NAMES, UNKNOWN]
    features = sorted(set().union(*[ngrams(t) for t, _, _ in data]))
    at = {f: i for i, f in enumerate(features)}
    rows = [np.array([at[f] for f in sorted(ngrams(t))] + [len(features)]) for t, _, _ in data]
    y = np.array([classes.index(c) for _, c, _ in data])
    fold = np.array([f for _, _, f in data])
    learn, test = np.flatnonzero(fold != 3), np.flatnonzero(fold == 3)
    w = descend([rows[i] for i in learn], y[learn], len(features) + 1, len(classes))
    z = np.stack([w[rows[i]].sum(0) for i in test])

    def loss(t: float) -> float:
        a = z * t
        a = a - a.max(1, keepdims=True)
        return float((np.log(np.exp(a).sum(1)) - a[np.arange(len(test)), y[test]]).mean())

    scale = min((0.25 * 1.1**k for k in range(40)), key=loss)
    hit = z.argmax(1) == y[test]
    rest = y[test] == classes.index(UNKNOWN)
    w = descend(rows, y, len(features) + 1, len(classes)) * scale
    notices = [(f, sorted(ngrams(t))) for f in NAMES for t in [*NAMES[f], *BODIES.get(f, [])]]
    notices = [(f, n) for f, n in notices if n]
    families: dict[str, set] = {}
    for f, n in notices:
        for g in n:
            families.setdefault(g, set()).add(f)
    for t, _, _ in (x for x in data if x[1] == UNKNOWN):
        for g in ngrams(t):
            families.setdefault(g, set()).add(UNKNOWN)
    rare = {g: float(np.log((len(classes) + 1) / len(fs))) ** 2 for g, fs in families.items()}
    templates = [(f, [(g, rare[g] / sum(rare[x] for x in n)) for g in n]) for f, n in notices]
    return {"classes": classes, "features": features, "weights": w[:-1], "bias": w[-1], "templates": templates, "accuracy": float(hit.mean()), "unknown": float(hit[rest].mean()), "scale": scale, "loss": loss(scale)}


def literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from a literal: a local relation of the plan itself."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy (a hash of the text), paragraph (from 0), family, probability, similarity, confirmed, cue: the paragraphs that
    hold a feature of the model.

    A paragraph's lines are read as one, comment marks left out, and each by itself too. Confirmed lines stand for a paragraph that is
    not confirmed as a whole; beside one that is, only a line that holds a whole notice of another family has a row. Paragraphs
    without any feature, empty and null texts have no row; a row whose best class is unknown has family "unknown". ``cue``: the
    paragraph speaks of a licence. Rows equal in id and text are read once.
    """
    spark, m = df.sparkSession, model()
    single = [f for f in m["features"] if " " not in f]
    plain = [*STOP, *map(str, range(10))]
    words = lambda c: F.filter(F.split(F.lower(c), CUT), lambda w: w != "")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    likely = docs.filter(F.exists(F.split(F.lower("text"), CUT), lambda w: w.isin(single))).withColumn("copy", F.xxhash64("text"))
    wrapped = likely.select("doc_id", "copy", F.posexplode(F.split("text", PARAGRAPH)).alias("paragraph", "block")).filter(F.exists(F.split(F.lower("block"), CUT), lambda w: w.isin(single)))
    units = F.when(F.col("block").contains("\n"), F.concat(F.array("block"), F.split("block", "\n"))).otherwise(F.array("block"))  # the first is the whole
    lines = wrapped.select("doc_id", "copy", "paragraph", F.posexplode(units).alias("line", "unit")).withColumn("words", words(F.col("unit"))).filter(F.exists("words", lambda w: w.isin(single)))
    # no lambda reads the whole array: Spark may put its definition there, and would compute it for every element
    pair = lambda a, b: F.when(~(a.isin(plain) & b.isin(plain)), F.concat_ws(" ", a, b))
    pairs = F.filter(F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), pair(a, b))), lambda p: p.isNotNull())
    key = ["doc_id", "copy", "paragraph", "line"]
    grams = lines.select(*key, F.col("unit").rlike(CUE).alias("cue"), F.array_distinct(F.concat(F.filter("words", lambda w: ~w.isin(plain)), pairs)).alias("grams"))
    weights = literal_table(spark, [{"gram": f, "w": [round(float(x), 6) for x in w]} for f, w in zip(m["features"], m["weights"], strict=True)], "gram string, w array<double>")
    hits = grams.select(*key, "cue", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")  # bounded by the notices
    summed = hits.groupBy(*key).agg(F.max("cue").alias("cue"), F.array_sort(F.collect_set(F.struct("gram", "w"))).alias("hits"))
    z = F.aggregate("hits", F.array(*[F.lit(float(b)) for b in m["bias"]]), lambda a, h: F.zip_with(a, h["w"], lambda x, y: x + y))
    top = F.array_max("z")
    scored = summed.withColumn("z", z).select(*key, "cue", F.col("hits.gram").alias("grams"), F.element_at(F.array(*map(F.lit, m["classes"])), F.array_position("z", top).cast("int")).alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("probability"))
    templates = literal_table(spark, [{"family": f, "template": [{"g": g, "w": round(w, 6)} for g, w in n]} for f, n in m["templates"]], "family string, template array<struct<g:string,w:double>>").groupBy("family").agg(F.collect_list("template").alias("templates"))
    alike = F.array_max(F.transform("templates", lambda t: F.aggregate(t, F.lit(0.0), lambda a, x: a + F.when(F.array_contains(F.col("grams"), x["g"]), x["w"]).otherwise(0.0))))
    similarity = F.coalesce(alike, F.lit(0.0))
    read = scored.join(F.broadcast(templates), "family", "left").select("doc_id", "copy", "paragraph", F.struct("line", "family", "probability", similarity.alias("similarity"), ((F.col("family") != UNKNOWN) & (similarity >= CONFIRM)).alias("confirmed"), "cue").alias("u"))
    both = read.groupBy("doc_id", "copy", "paragraph").agg(F.max(F.when(F.col("u.line") == 0, F.col("u"))).alias("whole"), F.collect_list(F.when((F.col("u.line") > 0) & F.col("u.confirmed"), F.col("u"))).alias("sure"))
    other = F.filter("sure", lambda u: (u["family"] != F.col("whole.family")) & (u["similarity"] >= 0.999) & ~((u["family"] == "gpl") & F.col("whole.family").isin(*SPECIAL)))
    kept = F.when(F.col("whole.confirmed"), F.concat(F.array("whole"), other)).when(F.size("sure") > 0, F.col("sure")).otherwise(F.array("whole"))
    return both.select("doc_id", "copy", "paragraph", F.inline(kept)).select("doc_id", "copy", "paragraph", "family", "probability", "similarity", "confirmed", "cue")


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, families (of confirmed paragraphs, sorted), n_paragraphs (confirmed), n_unknown (paragraphs that speak of a licence
    but confirm no family), probability (the greatest of a confirmed paragraph), a row for each row. Null and empty texts have
    none; rows of one id are told apart by their texts."""
    found, sure = scan(df, id_col, text_col), F.col("confirmed")
    per = found.groupBy(F.col("doc_id").alias("of"), F.col("copy").alias("text_of")).agg(
        F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("families"),
        F.sum(sure.cast("long")).alias("n_paragraphs"),
        F.count_distinct(F.when(~sure & F.col("cue"), F.col("paragraph"))).alias("n_unknown"),
        F.max(F.when(sure, F.col("probability"))).alias("probability"),
    )
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("own"))
    out = rows.join(per, rows["doc_id"].eqNullSafe(F.col("of")) & (F.col("own") == F.col("text_of")), "left")
    return out.select("doc_id", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), "probability")
