"""Licence scan: canonical forms and lookups."""

import hashlib

from llm_fixtures import docs_frame
from sigfolio.llm import licenses


def test_scan(spark):
    mit = "MIT Licence\n\nCopyright (c) 2019-2024 Some One <a@b.c>\nAll rights reserved.\n\n" + licenses.MIT.replace('"', "“").upper()
    rows = [
        (1, mit), (2, licenses.ISC), (3, "Some prose.\nLicenced under   the Apache-License, version 2.0!\nReleased under the MIT License."),
        (4, "The text says: licensed under the MIT License, as others do."), (5, None), (6, ""), (7, " .,;\n--"), (None, "SPDX-License-Identifier: MIT"),
        (8, licenses.MIT + " And more."), (9, "© 2020 Firm\n" + licenses.ZLIB), (9, "other text of this id"), (10, "x " * 50000),
    ]
    got = sorted(map(tuple, licenses.scan(docs_frame(spark, rows), licenses.known_licenses(spark)).collect()), key=repr)
    by = {(r[0], r[2], r[3], r[4]) for r in got}
    assert by >= {(1, "MIT", 0, ""), (2, "ISC", 0, ""), (3, None, 2, "Apache-2.0,MIT"), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""),
                  (7, None, 0, ""), (None, "MIT", 1, "MIT"), (8, None, 0, ""), (9, "Zlib", 0, ""), (9, None, 0, ""), (10, None, 0, "")}
    assert len(got) == len(rows)
    digests = {r[0]: r[1] for r in got}
    assert digests[5] is digests[6] is digests[7] is None
    assert digests[4] == hashlib.sha256(b"the text says licensed under the mit license as others do").hexdigest()


def test_empty_tables(spark):
    none = licenses.known_licenses(spark, [])
    assert [tuple(r)[2:] for r in licenses.scan(docs_frame(spark, [(1, licenses.MIT)]), none).collect()] == [(None, 0, "")]
    assert licenses.scan(docs_frame(spark, []), licenses.known_licenses(spark)).count() == 0


def test_known_forms_are_not_shared_between_licences(spark):
    rows = spark.createDataFrame(licenses.known_texts(), "license string, text string")
    forms = rows.select(licenses.canonical(rows["text"]).alias("f"), "license").distinct()
    assert forms.groupBy("f").count().filter("count > 1").count() == 0


def finds(spark, texts, known=None):
    docs = docs_frame(spark, list(enumerate(texts)))
    got = licenses.scan(docs, licenses.known_licenses(spark) if known is None else known).collect()
    return [r["license"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_lines_that_state_a_holder_are_no_part_of_the_form(spark):
    lines = ["Copyright OpenJS Foundation and other contributors", "Copyright Jane Doe 2020", "(C) Copyright 2019 IBM", "# Copyright (c) 2020 X",
             "Copyright Node.js contributors. All rights reserved.", "© Jane Doe", "Copyright: Some Firm, Inc."]
    assert finds(spark, [f"{x}\n\n{licenses.MIT}" for x in lines]) == ["MIT"] * len(lines)
    wrapped = licenses.MIT.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT").replace("The above copyright", "The above\ncopyright")
    assert finds(spark, [wrapped, licenses.MIT.replace("The above copyright", "The above\ncopyright\n")]) == ["MIT", "MIT"]
    said = ["Copyright law protects a work.", "Copyright is held by them.", "copyright notice, this list of conditions", "(c) You must keep it", "copyright\n"]
    assert finds(spark, [f"{x}\n{licenses.MIT}" for x in said]) == [None] * len(said)


def test_whole_texts(spark):
    bsd = licenses.BSD_3_TEXTS[0].replace("materials provided", "materials\nprovided").replace("the above copyright notice", "the above\ncopyright notice")
    texts = [f"BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n{bsd}", licenses.BSD_2_TEXTS[-1], licenses.ZERO_BSD,
             f"{licenses.UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>",
             "Copyright 2019 The Authors\n\n" + licenses.APACHE.format("file"), licenses.BSD_3_TEXTS[0] + " more"]
    assert finds(spark, texts) == ["BSD-3-Clause", "BSD-2-Clause", "0BSD", "Unlicense", "Apache-2.0", None]


def test_long_texts_by_their_digests(spark):
    import os

    import pytest
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    names = {k: v for k, v in names.items() if os.path.exists(f"{folder}/{k}")}
    if not names:
        pytest.skip("no licence texts on this machine")
    assert finds(spark, [open(f"{folder}/{k}", encoding="utf-8").read() for k in names]) == list(names.values())


def test_callers_texts(spark):
    more = spark.createDataFrame([("Own-1", "You may do all.\nBut that."), ("Zz", licenses.MIT)], "license string, text string")
    texts = ["YOU MAY DO ALL, but that", licenses.MIT, licenses.ISC]
    assert finds(spark, texts, licenses.known_licenses(spark, more=more)) == ["Own-1", "MIT", "ISC"]
    assert finds(spark, texts, licenses.known_licenses(spark, [], more)) == ["Own-1", "Zz", None]


def test_long_lines_and_many_repeats(spark):
    """A million marks on one line neither recurse nor backtrack, and a holder
    line of any length is left out."""
    marks = [f"{x}\n{licenses.MIT}" for x in ("copyright " * 1_000_000, "(c) copyright " * 300_000 + "2020 x", "©" * 1_000_000, "-" * 1_000_000,
                                              "Copyright " + "holder name " * 100_000, "\n" * 500_000)]
    assert finds(spark, marks) == ["MIT", "MIT", "MIT", "MIT", None, "MIT"]  # of the fifth, "holder" says more than who it is
    assert finds(spark, ["Copyright " + "Some Name, " * 100_000 + "\n" + licenses.MIT]) == ["MIT"]
    got = licenses.scan(docs_frame(spark, [(1, "Released under the MIT License.\n" * 20_000)]), licenses.known_licenses(spark)).collect()
    assert [tuple(r)[2:] for r in got] == [(None, 20_000, "MIT")]


def test_sql_has_the_same_patterns_and_texts(spark):
    import duckdb
    import pyarrow as pa

    from sigfolio.llm.queries import license_sql
    starts = ["copyright", "Copyright (c)", "©", "(C) copyright", " * Copyright", "All rights reserved.", "rights reserved", "copyrights", "copyright:"]
    goes = ["", " 2020", " Jane", " by Jane. All rights reserved", " of Jane", " and", " law", " the right reserved", " by by on", "\t<a>", " [x", " é", "\r\nx"]
    texts = [f"{s}{g}\n{t}" for s in starts for g in goes for t in ("a licence licence", licenses.MIT)]
    texts += [t for _, t in licenses.known_texts()] + ["copyright holder\nsub\nlicence copyright owner", "per cent per\ncent", None, "", "\n\n"]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [k for k, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}))
    want = sorted(con.execute(license_sql()).fetchall())
    assert sorted(map(tuple, licenses.scan(docs_frame(spark, rows), licenses.known_licenses(spark)).collect())) == want
    assert {r[2] for r in want} >= set(licenses.TEXTS)
