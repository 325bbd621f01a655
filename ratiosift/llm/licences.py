"""License scans by TF-IDF cosine to templates, and inheritance along paths (operator 6, DataFrame functions only).

1. Templates are licence texts, headings, notices and SPDX lines. Every file whose text speaks of a licence (a word of
   ``TRIGGERS`` or ``OPENERS``) is cut into pieces: the whole file; around every trigger the windows of ``BEFORE`` and
   ``AFTER`` words, so that a notice inside a long line, a sentence or a wrapped comment has a window that fits it; and from
   every opener on, as far as licence texts reach (``REACH``), for texts at the head of a source file.
2. A piece's words are weighted by count times inverse document frequency over the scanned files; words of no template have
   the highest weight, so that foreign text counts against a piece. Its cosine with every template is computed. A file
   whose whole text reaches ``WHOLE`` is a licence file and has that licence; otherwise its own licence is that of its best
   window at ``LEAST`` or above, similarities taken by tenths and the earliest place of equals, since a file's head says
   what it is under and later words may speak of other licences (ties at one place: the higher similarity, then the
   alphabetically first licence).
3. A licence file, by its text or by its name, speaks for its directory; of several the one with the smallest path. A file
   without an own licence takes that of the nearest directory above it that has one. Directories, not files, are joined to
   their ancestors, so the join is as small as the directory tree.

The long licences (GNU, Apache, Mozilla, Creative Commons) are known by heading and notice, the short ones by their text
too; ``templates`` takes further full texts. Texts are read whole and once:
what later steps need of them is written. Windows are made block by block of the text, each different window is weighed
once however many files hold it, and no row holds more than one text's words: a text made of triggers only takes time.

Null or empty texts have no licence of their own; a null path lies in no directory and inherits nothing. Repeated rows are
scanned separately. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

#: The texts of short public licences.
_AS_IS = "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors"
_BSD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
TEXTS = [
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. " + _AS_IS + " or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("Zlib", "this software is provided as-is, without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution."),
    ("Unlicense", "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + " be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
]
#: How the public licences are headed and announced.
NOTICES = [
    ("Apache-2.0", "apache license version 2.0, january 2004 www.apache.org licenses"),
    ("Apache-2.0", "licensed under the apache license, version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license; you may obtain a copy of the license at apache.org"),
    ("MIT", "the mit license"),
    ("MIT", "released under the mit license"),
    ("ISC", "licensed under the isc license"),
    ("Zlib", "licensed under the zlib license"),
    ("BSD-3-Clause", "released under the bsd 3-clause license"),
    ("BSD-2-Clause", "released under the simplified bsd 2-clause license"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("MPL-2.0", "subject to the terms of the mozilla public license, v. 2.0"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-4.0", "licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC-BY-SA-4.0", "licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-NC-4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("CC-BY-ND-4.0", "licensed under cc by-nd 4.0"),
    ("CC-BY-ND-4.0", "licensed under a creative commons attribution-noderivatives 4.0 international license"),
    ("CC-BY-NC-SA-4.0", "licensed under cc by-nc-sa 4.0"),
    ("CC-BY-NC-SA-4.0", "licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license"),
    ("CC-BY-NC-ND-4.0", "licensed under cc by-nc-nd 4.0"),
    ("CC-BY-NC-ND-4.0", "licensed under a creative commons attribution-noncommercial-noderivatives 4.0 international license"),
    ("BSL-1.0", "boost software license version 1.0, august 17th, 2003"),
    ("BSL-1.0", "distributed under the boost software license, version 1.0"),
    ("EPL-2.0", "eclipse public license v 2.0"),
    ("EPL-2.0", "made available under the terms of the eclipse public license, version 2.0"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal"),
    ("CC0-1.0", "creative commons legal code cc0 1.0 universal"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Names, titles, versions and dates of the GNU licences.
GNU = [
    ("GPL-1.0", "gnu general public license", "1", "february 1989"),
    ("GPL-2.0", "gnu general public license", "2", "june 1991"),
    ("GPL-3.0", "gnu general public license", "3", "29 june 2007"),
    ("LGPL-2.1", "gnu lesser general public license", "2.1", "february 1999"),
    ("LGPL-3.0", "gnu lesser general public license", "3", "29 june 2007"),
    ("AGPL-3.0", "gnu affero general public license", "3", "19 november 2007"),
]
_FORMS = ("{title} version {version}, {date}", "licensed under the {title}, version {version}", "redistribute it and/or modify it under the terms of the {title} as published by the free software foundation, either version {version} of the license, or any later version")


def _templates() -> list[tuple[str, str]]:
    gnu = [(name, form.format(title=title, version=version, date=date)) for name, title, version, date in GNU for form in _FORMS]
    names = list(dict.fromkeys(n for n, _ in TEXTS + NOTICES + gnu))
    ids = [(n, i) for n in names for i in ((n,) if n not in {g[0] for g in GNU} else (n, f"{n}-only", f"{n}-or-later"))]
    return TEXTS + NOTICES + gnu + [(n, f"spdx-license-identifier: {i} {i} {i}") for n, i in ids]  # the name weighs more than the word before it


TEMPLATES = _templates()
TRIGGERS = ["license", "licensed", "licenses", "licence", "licenced", "licences", "spdx-license-identifier", "domain", "cc0"]
OPENERS = ["permission", "redistribution", "unencumbered", "as-is"]
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
WORD = "[a-z0-9]++(?:[.-]++[a-z0-9]++)*+"
BEFORE, AFTER, REACH = (0, 2, 4, 8), (1, 5, 8, 16), (110, 170, 220)
LEAST, WHOLE = 0.65, 0.8
#: Words of a block, and parts that equal windows are dealt to, since every file of a corpus may bring the same notice.
BLOCK, SALTS = 256, 16


def words_of(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits, inner dots and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _blocks(words: Column) -> Column:
    """(start, first, words): the words in blocks of ``BLOCK``, each with those before and after that its windows reach, so
    that no row grows with the text's number of triggers. ``first`` is the place of the block's first word in ``words``."""
    starts = F.sequence(F.lit(1), F.size(words), F.lit(BLOCK))

    def block(s: Column) -> Column:
        low = F.greatest(F.lit(1), s - max(BEFORE))
        return F.struct(s.alias("start"), (s - low + 1).alias("first"), F.slice(words, low, s - low + BLOCK + max(*AFTER, *REACH)).alias("words"))

    return F.transform(starts, block)


def _windows(block: Column) -> Column:
    """(at, text) of the windows around a block's own triggers and from its openers on; ``at`` is the place in the file."""
    words, first = block["words"], block["first"]
    own = F.sequence(first, F.least(F.size(words), first + BLOCK - 1))
    spot = lambda names: F.filter(own, lambda i: F.element_at(words, i).isin(names))

    def window(i: Column, before: Column, after: Column) -> Column:
        low = F.greatest(F.lit(1), i - before)
        return F.struct((block["start"] + i - first).alias("at"), F.array_join(F.slice(words, low, i + after - low + 1), " ").alias("text"))

    near = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in BEFORE for a in AFTER))
    around = F.flatten(F.transform(spot(TRIGGERS), lambda i: F.transform(near, lambda s: window(i, s["b"], s["a"]))))
    onward = F.flatten(F.transform(spot(OPENERS), lambda i: F.transform(F.array(*map(F.lit, REACH)), lambda a: window(i, F.lit(0), a))))
    return F.concat(around, onward)


def template_terms(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(term, template, tf)"""
    t = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(templates)], "template int, text string")
    return t.select("template", F.explode(words_of(F.col("text"))).alias("term")).groupBy("term", "template").agg(F.count("*").alias("tf"))


def scan(spark: SparkSession, files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST, whole: float = WHOLE) -> DataFrame:
    """``files`` needs ``doc_id``, ``path`` and ``text``. One row per file: ``doc_id``, ``path``, ``n_statements`` (places
    where a template matches), ``own_license``, ``similarity`` (of the best piece, six decimals, null without one),
    ``license`` (own or inherited) and ``inherited_from`` (the directory, where inherited)."""
    templates = TEMPLATES if templates is None else templates
    names, scratch = [name for name, _ in templates], Scratch(spark, "licences")
    known = template_terms(spark, templates)
    vocabulary = [r.term for r in known.select("term").distinct().collect()]  # as many as the templates have
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    says = F.array(*map(F.lit, TRIGGERS + OPENERS))
    held = _let(words_of(text), lambda w: F.struct(F.array_intersect(w, F.lit(vocabulary)).alias("terms"), F.when(F.arrays_overlap(w, says), w).alias("words")))
    rows = files.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("path").cast("string").alias("path"), held.alias("held"))
    rows = scratch.keep(rows.select("row", "doc_id", "path", "held.terms", "held.words"), "held")

    n = F.lit(float(rows.count()))
    idf = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = known.select("term").distinct().join(F.broadcast(idf), "term", "left").select("term", (F.log((1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf"))
    weighted = known.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    unit = weighted.join(weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "template").withColumn("w", F.col("w") / F.col("norm"))
    wide = unit.groupBy("term", "idf").agg(*(F.expr(f"sum(if(template = {k}, w, 0D)) as t{k}") for k in range(len(names))))
    wide = scratch.keep(wide.coalesce(1), "templates")

    order = {name: k for k, name in enumerate(sorted(set(names)))}
    best = [F.expr(f"struct(round(try_divide(d{k}, norm), 6) as similarity, {-order[name]} as order, {k} as k)") for k, name in enumerate(names)]
    dots = [F.expr(f"sum(coalesce(t{k}, 0D) * w) as d{k}") for k in range(len(names))]

    def alike(terms: DataFrame, key: list[str], from_: float) -> DataFrame:
        """The best template of each piece, a piece being the (key, term) rows of one key."""
        terms = terms.groupBy(*key, "term").agg(F.count("*").alias("tf")).join(F.broadcast(wide), "term", "left")  # as large as the templates' vocabulary
        terms = terms.withColumn("w", F.col("tf") * F.coalesce(F.col("idf"), F.log(1.0 + n) + 1.0))
        pieces = terms.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
        return pieces.select(*key, (F.greatest(*best) if len(best) > 1 else best[0]).alias("best")).where(F.col("best.similarity") >= from_)

    speaking = rows.where("words is not null")
    whole_file = alike(speaking.select("row", F.explode("words").alias("term")), ["row"], whole).select("row", F.lit(0).alias("at"), "best")
    blocks = speaking.select("row", F.explode(_blocks(F.col("words"))).alias("b")).where(F.arrays_overlap("b.words", says))
    windows = blocks.select("row", F.explode(_windows(F.col("b"))).alias("w")).select("row", "w.at", "w.text", F.md5("w.text").alias("key"), F.pmod("row", F.lit(SALTS)).alias("salt"))
    each = windows.groupBy("key", "salt").agg(F.first("text").alias("text"))  # equal windows are weighed once
    good = alike(each.select("key", "salt", F.explode(F.split("text", " ")).alias("term")), ["key", "salt"], least)
    placed = windows.select("row", "at", "key", "salt").join(good, ["key", "salt"]).select("row", "at", "best")
    tier = F.least(F.lit(9), F.floor(10 * F.col("best.similarity")))
    found = whole_file.union(placed).groupBy("row").agg(F.max(F.struct((F.col("at") == 0).alias("whole"), tier.alias("tier"), (-F.col("at")).alias("place"), "best.similarity", "best.order", "best.k")).alias("best"), F.count_distinct(F.when(F.col("at") > 0, F.col("at"))).alias("n_statements"))
    directory = F.when(F.col("path").isNotNull(), F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/+$", ""))
    own = rows.select("row", "doc_id", "path", directory.alias("dir")).join(found, "row", "left")
    own = own.select("doc_id", "path", F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"), F.when(F.col("best").isNotNull(), F.element_at(F.lit(names), F.col("best.k") + 1)).alias("own_license"), F.col("best.similarity").alias("similarity"), "dir", (F.col("path").rlike(FILE_NAME) | F.coalesce("best.whole", F.lit(False))).alias("is_file"))
    own = scratch.keep(own, "own", last=True)

    speaks = own.where(F.col("is_file") & F.col("own_license").isNotNull() & F.col("dir").isNotNull()).groupBy("dir").agg(F.min_by("own_license", F.struct("path", "own_license")).alias("license")).withColumnRenamed("dir", "above")
    parts = F.split("dir", "/")
    up = own.where("dir is not null").select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("above", F.when(F.col("depth") > 0, F.array_join(F.slice(parts, 1, F.col("depth")), "/")).otherwise(""))
    nearest = up.join(speaks, "above").groupBy("dir").agg(F.max_by(F.struct("above", "license"), "depth").alias("from"))
    out = own.join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull() & F.col("from").isNotNull()
    scratch.close()
    return out.select("doc_id", "path", "n_statements", "own_license", "similarity", F.coalesce("own_license", "from.license").alias("license"), F.when(inherits, F.col("from.above")).alias("inherited_from"))
