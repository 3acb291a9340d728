import textwrap

import pytest

from daypanel.llm import licences

BODY = {name: body for name, body in licences.KNOWN if len(body) > 300}
MIT = BODY["MIT"]
#: as a file has it: heading, copyright line and paragraphs stand apart
MIT_FILE = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + MIT.replace("\n", "\n\n")


def scanned(docs, known=None):
    return sorted(((r.doc_id, r.whole_licence, r.licences, r.n_notices) for r in licences.scan(docs, known=known).collect()), key=repr)


def test_texts_and_notices(table):
    rows = [
        (1, "copyright (c) 2020 Somebody\n" + MIT.upper().replace("LICENSE", "LICENCE").replace(",", " ,")), (2, f"prose\n\n{MIT}\n\nprose"),
        (3, "prose\nreleased under the mit licence!\nReleased under the MIT License.\nprose"), (4, None), (5, ""), (6, "Released under the MIT License. And more."),
        (7, "Licensed under the Apache License, v. 2.0\r\nThis work is licensed under the GNU General Public License (version 3)"), (8, "(c) all mine"),
        (9, "word " * 100_000 + "\nLicensed under CC-BY-NC 4.0"), (9, "word " * 100_000 + "\nLicensed under CC-BY-NC 4.0"), (None, "SPDX-License-Identifier: MIT"),
    ]
    want = [
        (1, "MIT", "MIT", 1), (2, None, "MIT", 1), (3, None, "MIT", 2), (4, None, "", 0), (5, None, "", 0), (6, None, "", 0),
        (7, None, "Apache-2.0,GPL-3.0", 2), (8, None, "", 0), (9, None, "CC-BY-NC-4.0", 1), (9, None, "CC-BY-NC-4.0", 1), (None, "MIT", "MIT", 1),
    ]
    assert scanned(table(rows)) == sorted(want, key=repr)


def test_whole_licences_in_any_form(table):
    wrapped = textwrap.fill(MIT.replace("\n", " "), 61)
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2021, Some Body\nAll rights reserved.\n\n" + textwrap.fill(BODY["BSD-3-Clause"], 80)
    rows = [
        (1, MIT_FILE), (2, f"A document.\n\n{MIT_FILE}\n\nIt goes on."), (3, MIT), (4, wrapped), (5, "// SPDX-License-Identifier: GPL-3.0-or-later"),
        (6, "SPDX-License-Identifier: BSD-2-Clause\nSPDX-License-Identifier: LGPL-2.1"), (7, bsd), (8, f"{bsd}\n\n{wrapped}\nprose"), (9, MIT[:-40]),
        (10, BODY["Unlicense"]), (11, BODY["Zlib"] + "\nand more"), (12, "Permission is hereby\n" * 50), (13, BODY["ISC"]), (14, BODY["0BSD"]),
    ]
    want = {
        1: ("MIT", "MIT", 1), 2: (None, "MIT", 1), 3: ("MIT", "MIT", 1), 4: ("MIT", "MIT", 1), 5: ("GPL-3.0", "GPL-3.0", 1),
        6: (None, "BSD-2-Clause,LGPL-2.1", 2), 7: ("BSD-3-Clause", "BSD-3-Clause", 1), 8: (None, "BSD-3-Clause,MIT", 2), 9: (None, "", 0),
        10: ("Unlicense", "Unlicense", 1), 11: (None, "Zlib", 1), 12: (None, "", 0), 13: ("ISC", "ISC", 1), 14: ("0BSD", "0BSD", 1),
    }
    assert {i: tuple(rest) for i, *rest in scanned(table(rows, more=("digest", "form", "_t", "licence")))} == want


def test_known_texts_are_an_argument(table, spark):
    known = spark.createDataFrame([("own", "All\ntexts may be read!"), ("own", "all texts may be read"), ("other", "all texts may be read"), ("word", "Gratis"), ("none", "---")], "licence string, body string")
    rows = [(1, "x\nALL texts\nmay be read.\ny"), (2, "gratis"), (3, "gratis, all"), (4, MIT), (5, "a\ngratis\ngratis\n"), (6, "all texts may be ready")]
    want = [(1, None, "other,own", 1), (2, "word", "word", 1), (3, None, "", 0), (4, None, "", 0), (5, None, "word", 2), (6, None, "", 0)]
    assert scanned(table(rows), known) == want
    assert scanned(table(rows), known.limit(0)) == [(i, None, "", 0) for i, _ in rows]


def test_too_many_known_texts(table, spark, monkeypatch):
    monkeypatch.setattr(licences, "MOST_KNOWN", 3)
    with pytest.raises(ValueError, match="known texts"):
        licences.scan(table([(1, "x")]))


def test_empty_table(table):
    assert licences.scan(table([])).count() == 0
