"""Licence scans: public licence texts, notices, and the SQL form on a planted directory tree."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratiosift.llm import licences, queries
from ratiosift.llm.licences import scan

TEXT = dict(licences.TEXTS)
CODE = "\n".join(f"def step_{k}(value, other):\n    return value * {k} + other  # adds" for k in range(60))
GNU = "                    GNU {}GENERAL PUBLIC LICENSE\n                       Version {}, {}\n\n Copyright (C) Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n"
GPL3 = GNU.format("", 3, "29 June 2007") + "The GNU General Public License is a free, copyleft license for software. Use with the GNU Affero General Public License: you have permission to link any covered work with a work licensed under version 3 of the GNU Affero General Public License. consider using the GNU Lesser General Public License instead of this License. " * 3
KEY = ["doc_id", "path", "n_statements", "own_license", "similarity", "license", "inherited_from"]


def comment(text, mark="// "):
    words = text.split()
    return "\n".join(mark + " ".join(words[k : k + 10]) for k in range(0, len(words), 10))


FILES = [
    (1, "a/b/x.py", "Released under the MIT License.\nfoo", "MIT", "MIT", None),
    (2, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", "Apache-2.0", "Apache-2.0", None),
    (3, "a/b/c/y.py", "code", None, "Apache-2.0", "a/b"),
    (4, "a/z.py", "no", None, None, None),
    (5, "a/b/c/d/w", "Licensed under CC BY-NC 4.0.\n" + "w " * 50, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
    (6, None, "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "GPL-3.0", None),
    (7, "a/q", None, None, None, None),
    (8, "a/b/k", "Copyright holder of things", None, "Apache-2.0", "a/b"),
    (8, "a/b/k", "Copyright holder of things", None, "Apache-2.0", "a/b"),
    (9, "top", "", None, None, None),
    (10, "g/COPYING", GPL3, "GPL-3.0", "GPL-3.0", None),
    (11, "g/sub/deep/x.c", CODE, None, "GPL-3.0", "g"),
    (12, "g/agpl/COPYING.txt", GPL3.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("29 June", "19 November"), "AGPL-3.0", "AGPL-3.0", None),
    (13, "g/agpl/s/t.c", "int main;", None, "AGPL-3.0", "g/agpl"),
    (14, "h/bsd3.txt", "Copyright (c) 1999, Jo Doe\nAll rights reserved.\n\n" + TEXT["BSD-3-Clause"], "BSD-3-Clause", "BSD-3-Clause", None),
    (15, "h/s/bsd2.txt", "Copyright (c) 1999, Jo Doe\n\n" + TEXT["BSD-2-Clause"].upper(), "BSD-2-Clause", "BSD-2-Clause", None),
    (16, "h/s/u.txt", "just prose", None, "BSD-2-Clause", "h/s"),
    (17, "h/v.txt", "more prose about the bus driver who lost his license in 1999 and the domain of the king", None, "BSD-3-Clause", "h"),
    (18, "i/isc.c", comment("Copyright 2001 Jo Doe " + TEXT["ISC"]) + "\n" + CODE, "ISC", "ISC", None),
    (19, "i/mit.c", comment("Copyright 2001 Jo Doe " + TEXT["MIT"], " * ") + "\n" + CODE, "MIT", "MIT", None),
    (20, "i/bsd3.c", comment("Copyright 2001 Jo Doe " + TEXT["BSD-3-Clause"], "# ") + "\n" + CODE, "BSD-3-Clause", "BSD-3-Clause", None),
    (21, "i/apache.py", "# SPDX-License-Identifier: Apache-2.0\n" + CODE, "Apache-2.0", "Apache-2.0", None),
    (22, "i/gpl.py", "# SPDX-License-Identifier: GPL-3.0-or-later\n" + CODE, "GPL-3.0", "GPL-3.0", None),
    (23, "i/bsd.py", "/* SPDX-License-Identifier: BSD-3-Clause */ " + CODE, "BSD-3-Clause", "BSD-3-Clause", None),
    (24, "i/eupl.py", "# SPDX-License-Identifier: EUPL-1.2\n" + CODE, None, None, None),
    (25, "i/long.txt", "word " * 3000 + "This program is licensed under the GNU General Public License, version 2, as they say. " + "other " * 3000, "GPL-2.0", "GPL-2.0", None),
    (26, "i/apache2.py", comment('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "# ") + CODE, "Apache-2.0", "Apache-2.0", None),
    (27, "j/UNLICENSE", TEXT["Unlicense"], "Unlicense", "Unlicense", None),
    (28, "j/zlib.h", "/*\n" + comment(TEXT["Zlib"], "  ") + "*/\n" + CODE, "Zlib", "Zlib", None),
    (29, "i/gplv3.py", comment("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "# ") + "\n" + CODE, "GPL-3.0", "GPL-3.0", None),
    (30, "k/LICENSE-APACHE", "Licensed under the Apache License, Version 2.0.", "Apache-2.0", "Apache-2.0", None),
    (31, "k/LICENSE-MIT", TEXT["MIT"], "MIT", "MIT", None),
    (32, "k/sub/x.c", "int x;", None, "Apache-2.0", "k"),  # of two files in one directory the one with the smaller path
    (34, "k/empty.c", "", None, "Apache-2.0", "k"),
    (35, "/root.c", " \n", None, None, None),
] + [(100 + k, f"z/f{k}", f"prose number {k} of the ordinary kind and nothing else in it", None, None, None) for k in range(60)]


def test_texts_notices_and_inheritance(spark):
    df = spark.createDataFrame([f[:3] for f in FILES], "doc_id long, path string, text string").repartition(3)
    out = scan(spark, df.selectExpr("*", "'x' as license", "1 as row", "2 as at", "3 as term")).toPandas()
    assert out.columns.tolist() == KEY
    got = {(int(i), o, l, f) for i, o, l, f in out[["doc_id", "own_license", "license", "inherited_from"]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False)}
    assert len(out) == len(FILES) and got == {(f[0], *f[3:]) for f in FILES}
    assert scan(spark, df.limit(0)).count() == 0


def test_installed_licence_files(spark):
    """The texts that the system's packages bring, where they do."""
    from pathlib import Path

    at = Path("/usr/share/common-licenses")
    known = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(name, (at / file).read_text()) for file, name in known.items() if (at / file).exists()]
    if not rows:
        pytest.skip("no licence texts here")
    prose = [(None, f"prose number {k} of the ordinary kind and nothing else in it") for k in range(100)]
    df = spark.createDataFrame([(k, f"d{k}/LICENSE", t) for k, (_, t) in enumerate(rows + prose)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in scan(spark, df).collect()}
    assert [got[k] for k in range(len(rows))] == [n for n, _ in rows]


def test_sql_form_on_planted_tree(spark, tmp_path):
    rows = [(f[0], f[2], f[1].rpartition("/")[0] or "top", f[1].rpartition("/")[2]) for f in FILES if f[1]]
    docs = pd.DataFrame([(i + 1000 * (k % 2), t, d, "l" if k % 3 else "m/n") for k, (i, t, d, _) in enumerate(rows)], columns=["doc_id", "text", "source", "lang"])
    docs = docs.drop_duplicates("doc_id")
    docs.to_parquet(tmp_path / "documents.parquet")
    want = duckdb.sql(queries.ORACLE_SQL["op6_licence_scan"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")).df()
    got = queries.op6_licence_scan(spark, str(tmp_path)).toPandas()
    for x in (got, want):
        x.sort_values("doc_id", inplace=True, ignore_index=True)
    pd.testing.assert_frame_equal(got[KEY].astype(object).where(got.notna(), None), want[KEY].astype(object).where(want.notna(), None), check_dtype=False)
    assert got.inherited_from.notna().sum() >= 3


def test_further_names_and_texts_of_triggers(spark):
    """Names that are parts of others, and a long text whose windows would not fit in one row."""
    named = [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989\n", "GPL-1.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n", "GPL-2.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"),
    ]
    prose = [(f"prose number {k} of the ordinary kind and nothing else in it", None) for k in range(60)]
    long = " ".join(f"permission license w{k % 7}" for k in range(4000)) + " Distributed under the Boost Software License, Version 1.0."
    rows = [(k, f"d{k}/f", t, n) for k, (t, n) in enumerate([*named, *prose, (long, "BSL-1.0")])]
    got = {r.doc_id: (r.own_license, r.n_statements) for r in scan(spark, spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: n for k, _, _, n in rows}


def test_blocks_give_the_windows_of_the_whole_text(spark):
    """Every window that a plain loop over the whole text makes, with its place, none twice."""
    words = [["w", "license", "permission", "x1", "as-is"][(k * k + k // 3) % 5] for k in range(3 * licences.BLOCK + 17)]
    df = spark.createDataFrame([(words,)], "words array<string>").select(F.explode(licences._blocks(F.col("words"))).alias("b")).select(F.explode(licences._windows(F.col("b"))).alias("w"))
    want = []
    for i, w in enumerate(words, 1):
        if w in licences.TRIGGERS:
            want += [(i, " ".join(words[max(1, i - b) - 1 : i + a])) for b in licences.BEFORE for a in licences.AFTER]
        if w in licences.OPENERS:
            want += [(i, " ".join(words[i - 1 : i + a])) for a in licences.REACH]
    assert sorted((r.at, r.text) for r in df.select("w.at", "w.text").collect()) == sorted(want)
