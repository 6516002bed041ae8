"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Each passage of a file that is as long as a template is compared with it; inverse document frequencies come from all
files. Passages are runs of words, so line breaks, comment marks and what stands beside a notice don't matter. A file
without a licence of its own takes that of the nearest directory above it that holds a licence file. DataFrame
operations only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vestige.llm.common import staged, text_of
from vestige.llm.license_texts import FULL


class Template(NamedTuple):
    license: str
    notice: str
    #: Words that a passage must hold: those that tell the licence from the ones worded like it.
    needs: str = ""
    #: Whether it tells the licence; other passages only count as covered by it.
    tells: bool = True
    #: Words of a full text that it stands for, where these are more than its own.
    stands: int = 0


# What the licences' notices say.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_NEEDS = {"Apache-2.0": "apache 2", "MIT": "mit", "GPL-3.0": "gnu general 3", "CC-BY-NC-4.0": "cc by nc 4", "CC-BY-4.0": "cc by 4", "BSD-3-Clause": "redistribution binary", "MPL-2.0": "mozilla 2"}
_GNU = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.0": ("Library", "2"), "LGPL-2.1": ("Lesser", "2.1"), "LGPL-3.0": ("Lesser", "3"), "AGPL-3.0": ("Affero", "3")}
_CC = {"": "Attribution", "-NC": "Attribution-NonCommercial", "-SA": "Attribution-ShareAlike", "-ND": "Attribution-NoDerivatives", "-NC-SA": "Attribution-NonCommercial-ShareAlike", "-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)",
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)


def templates() -> list[Template]:
    """Short notices, the usual headers, passages of full texts and SPDX ids."""
    out = [Template(k, v, _NEEDS[k]) for k, v in TEMPLATES.items()]
    out += [
        Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache 2"),
        Template("MIT", "Licensed under the MIT License.", "mit"),
        Template("MIT", _MIT[0]),
        *(Template("MIT", p, tells=False) for p in _MIT[1:]),
        *(Template("BSD-3-Clause", p, tells=False) for p in _BSD),
        Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla 2"),
    ]
    for name, (kind, version) in _GNU.items():
        needs = f"gnu general {kind.lower()} {version.replace('.', ' ')}"
        gnu = f"GNU {kind} General Public License"
        if name != "GPL-3.0":
            out.append(Template(name, f"This work is licensed under the {gnu}, version {version}.", needs))
        for what in ("program", "library"):
            out.append(Template(name, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {gnu} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.", needs))
    for name, title in _CC.items():
        mark = f"BY{name}"
        if f"CC-{mark}-4.0" not in TEMPLATES:
            out.append(Template(f"CC-{mark}-4.0", f"Licensed under CC {mark} 4.0.", f"cc {mark} 4".lower().replace("-", " ")))
        out.append(Template(f"CC-{mark}-4.0", f"This work is licensed under a Creative Commons {title} 4.0 International License.", f"creative commons {title} 4".lower().replace("-", " ")))
    for name, (stands, parts) in FULL.items():
        if name == "CC-BY-SA-4.0":  # all kinds have these passages, with their own title in the first
            for kind, title in _CC.items():
                words = title.lower().replace("-", " ")
                out.append(Template(f"CC-BY{kind}-4.0", parts[0].replace("attribution sharealike", words), f"creative commons {words} 4", stands=stands))
                out += [Template(f"CC-BY{kind}-4.0", p, tells=False, stands=stands) for p in parts[1:]]
            continue
        out.append(Template(name, parts[0], stands=stands))
        out += [Template(name, p, tells=False, stands=stands) for p in parts[1:]]
        if name == "GPL-3.0":
            out.append(Template("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation", "affero", stands=stands))
            out += [Template("AGPL-3.0", p, tells=False, stands=stands) for p in parts[1:]]
    for name in sorted({t.license for t in out} | {f"{g}-{tail}" for g in _GNU for tail in ("only", "or-later")}):
        licence = name.removesuffix("-only").removesuffix("-or-later")
        out.append(Template(licence, f"SPDX-License-Identifier: {name}", "spdx " + name.lower().replace("-", " ").replace(".", " ")))
    return out


LIKE = 0.7
#: Share of a licence file's words that lie in its licence's passages, at least, unless its name tells.
COVERED = 0.5
# Names of licence files, but for those of programs.
_NAMED = r"(?i)/([^/]*[._-])?((un)?licen[cs]es?|copying|copyright|notice)([._-][^/]*)?$"
_PROGRAM = r"(?i)\.(c|cc|cpp|cs|cxx|go|h|hpp|java|jsx?|kt|m?js|php|pl|py|r|rb|rs|scala|sh|sql|swift|tsx?)$"


def _tokens(column):
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda t: t != "")


def _templates(spark: SparkSession, known: list[Template]) -> list[list[str]]:
    """The words of each template, by the same rule as the files'."""
    rows = spark.createDataFrame([(k, t.notice) for k, t in enumerate(known)], "k int, notice string").select("k", _tokens(F.col("notice")).alias("words")).collect()
    return [r.words for r in sorted(rows, key=lambda r: r.k)]


def path_of(docs: DataFrame) -> DataFrame:
    """docs with the path that a corpus of this layout gives them: /source/lang/block of 100 ids/ten ids/id.txt, of
    which a hash of the id keeps one to all four directories. Without an id, a hash of the text names the file."""
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    above = F.array(F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(number / 100).cast("string"), F.floor(number / 10).cast("string"))
    kept = F.slice(above, F.lit(1), (F.pmod(F.xxhash64(number), F.lit(4)) + 1).cast("int"))
    return docs.withColumn("path", F.concat(F.lit("/"), F.array_join(kept, "/"), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none-"), F.hex(F.xxhash64(text_of())))), F.lit(".txt")))


def _anchors(unit: dict[str, float], idf: dict[str, float]) -> list[str]:
    """The rarest words of a template without all of which no passage is as near as LIKE: a passage's cosine is at
    most the length of the template's unit vector over the words that both have."""
    rest, out = 1.0, []
    for word in sorted(unit, key=lambda w: (-idf[w], -unit[w], w)):
        if rest < LIKE * LIKE - 1e-9:
            break
        out.append(word)
        rest -= unit[word] ** 2
    return out


def passages(files: DataFrame) -> DataFrame:
    """path, row (an id of the file's row), words (of the whole text), license, tells, needed, score, start, stop of each
    passage that is like a template. A passage of a full text stops where the words that it stands for do."""
    spark = files.sparkSession
    known = templates()
    words_of = _templates(spark, known)
    vocabulary = sorted({w for ws in words_of for w in ws})
    tokens = _tokens(F.col("text"))
    held = files.select(F.explode(F.array_distinct(F.filter(tokens, lambda t: t.isin(vocabulary)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = files.count()
    seen = {r.token: r.df for r in held.collect()}
    idf = {r.token: r.idf for r in spark.createDataFrame([(w, seen.get(w, 0)) for w in vocabulary], "token string, df long").select("token", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")).collect()}

    # The templates' unit vectors are constants of this module, some hundred weights.
    rows, of_template = [], []
    for k, (t, ws) in enumerate(zip(known, words_of)):
        raw = {w: ws.count(w) * idf[w] for w in ws}
        norm = sum(x * x for x in raw.values()) ** 0.5
        unit = {w: x / norm for w, x in raw.items()}
        of_template.append(unit)
        rows += [(a, k, t.license, t.tells, len(ws), max(len(ws), t.stands), t.needs.split(), unit) for a in _anchors(unit, idf)]
    anchored = F.broadcast(spark.createDataFrame(rows, "token string, k int, license string, tells boolean, n int, stands int, needs array<string>, unit map<string,double>"))
    anchors, longest = sorted({r[0] for r in rows}), max(map(len, words_of))

    # Every place of an anchor, with as many words on each side as a passage over it can hold.
    spots = files.select("path", tokens.alias("tokens")).where(F.exists("tokens", lambda t: t.isin(anchors))).withColumn("row", F.monotonically_increasing_id())
    place = lambda t, i: F.when(t.isin(anchors), F.struct(t.alias("token"), i.alias("at"), F.greatest(i - longest + 1, F.lit(0)).alias("first")))
    spots = spots.withColumn("places", F.filter(F.transform("tokens", place), lambda p: p.isNotNull()))
    spots = spots.select("path", "row", F.size("tokens").alias("words"), F.explode(F.transform("places", lambda p: F.struct(p.token.alias("token"), p["at"].alias("at"), p.first.alias("first"), F.slice("tokens", p.first + 1, F.lit(2 * longest - 1)).alias("near")))).alias("p"))
    near = spots.select("path", "row", "words", "p.*").join(anchored, "token")

    # Passages over the place begin at lo to hi, counted in near.
    lo = F.greatest(F.col("at") - F.col("n") + 1, F.lit(0)) - F.col("first")
    hi = F.greatest(F.least(F.col("at"), F.col("words") - F.col("n")), F.lit(0)) - F.col("first")
    near = near.withColumn("lo", lo).withColumn("hi", hi).withColumn("near", F.slice("near", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("n"))).withColumn("lo", F.col("first") + F.col("lo")).withColumn("hi", F.col("first") + F.col("hi"))
    shared = F.aggregate(F.array_intersect("near", F.map_keys("unit")), F.lit(0.0), lambda acc, t: acc + F.pow(F.element_at("unit", t), F.lit(2.0)))
    near = near.where((shared >= LIKE * LIKE - 1e-9) & (F.size(F.array_except("needs", "near")) == 0))
    each = near.withColumn("start", F.explode(F.sequence("lo", "hi"))).withColumn("words_in", F.slice("near", F.col("start") - F.col("lo") + 1, F.col("n"))).where(F.size(F.array_except("needs", "words_in")) == 0)
    each = staged(each.select("path", "row", "words", "k", "license", "tells", F.size("needs").alias("needed"), "start", F.least(F.col("start") + F.col("stands"), F.col("words")).alias("stop"), "words_in").distinct().withColumn("passage", F.monotonically_increasing_id()))

    # Both the cosine's sums run over the distinct words of a passage; the weights of words that no template has come
    # from all files too.
    counted = each.select("passage", "k", F.explode("words_in").alias("token")).groupBy("passage", "k", "token").agg(F.count(F.lit(1)).alias("n"))
    told = spark.createDataFrame(list(idf.items()), "token string, idf double")
    others = staged(counted.select("token").distinct().join(F.broadcast(told.select("token")), "token", "left_anti"))
    elsewhere = files.select(F.explode(F.array_distinct(tokens)).alias("token")).join(others, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weights = elsewhere.select("token", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")).unionByName(told)
    units = F.broadcast(spark.createDataFrame([(k, w, u) for k, unit in enumerate(of_template) for w, u in unit.items()], "k int, token string, u double"))
    weight = F.col("n") * F.col("idf")
    score = counted.join(weights, "token").join(units, ["k", "token"], "left").groupBy("passage").agg((F.sum(F.coalesce("u", F.lit(0.0)) * weight) / F.sqrt(F.sum(weight * weight))).alias("score"))
    return each.join(score.select("passage", F.round("score", 6).alias("score")), "passage").where(F.col("score") >= LIKE).select("path", "row", "words", "license", "tells", "needed", "score", "start", "stop").distinct()


def licenses(files: DataFrame) -> DataFrame:
    """One row per file (doc_id, path, text): doc_id, path, license, score, basis (own, file, inherited, none) and
    inherited_from, the directory.

    Null text counts as empty. The best cosine of at least LIKE decides, ties by the number of words that its template
    needs (a title that goes on, as that of CC BY-SA, also holds the shorter one), then by the license's name; a
    directory's licence is that of its best licence file, ties by name. A directory that holds none asks the one
    above. A licence file is one with a licence and a licence file's name, or with at least COVERED of its words in
    passages of its licence, however long it is."""
    files = files.select("doc_id", "path", text_of().alias("text"))
    found = staged(passages(files))
    told = found.where("tells").groupBy("path", "row").agg(F.min_by("license", F.struct(-F.col("score"), -F.col("needed"), F.col("license"))).alias("own"), F.max("score").alias("score"))
    # The words in passages of the file's licence: each passage adds what lies beyond those that began before it.
    before = Window.partitionBy("path", "row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    within = told.join(found, ["path", "row"]).where(F.col("license") == F.col("own")).select("path", "row", "own", told["score"].alias("score"), "words", "start", "stop")
    within = within.withColumn("added", F.greatest(F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))), F.lit(0)))
    best = within.groupBy("path", "row", "own", "score", "words").agg(F.sum("added").alias("covered"))
    named = F.col("path").rlike(_NAMED) & ~F.col("path").rlike(_PROGRAM)
    best = best.withColumn("whole", named | (F.col("covered") >= COVERED * F.col("words")))
    best = staged(best.groupBy("path").agg(F.min_by("own", F.struct(-F.col("score"), F.col("own"))).alias("own"), F.max("score").alias("score"), F.max("whole").alias("whole")))

    # Every directory once, with the directories above it, the nearest first.
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    by_directory = best.where("whole").select(directory.alias("directory"), "own", "score").groupBy("directory").agg(F.max_by("own", F.struct("score", "own")).alias("held"))
    above = F.expr("transform(sequence(size(split(d, '/')), 1, -1), k -> struct(size(split(d, '/')) - k as up, array_join(slice(split(d, '/'), 1, k), '/') as directory))")
    chain = files.select(directory.alias("d")).distinct().select("d", F.explode(above).alias("a")).select("d", "a.up", "a.directory")
    nearest = chain.join(by_directory, "directory").groupBy("d").agg(F.min_by(F.struct("held", "directory"), "up").alias("from"))

    out = files.select("doc_id", "path", directory.alias("d")).join(best, "path", "left").join(nearest, "d", "left")
    basis = F.when(F.col("own").isNotNull() & F.col("whole"), "file").when(F.col("own").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "from.held").alias("license"), "score", basis.alias("basis"), F.when(F.col("own").isNull(), F.col("from.directory")).alias("inherited_from"))
