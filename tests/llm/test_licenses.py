from lintlake.llm import licenses
from tests.llm.edge import EDGE, documents, table

MIT = dict((k, v) for k, v in licenses.KNOWN if v.startswith("MIT License"))["MIT"]


def test_units_and_spellings(spark):
    folded = "Copyright (c) 2020 Some One\n\n" + MIT.replace(". ", ".\n").replace("license", "LICENCE").replace("sublicense", "sub-license").upper()
    rows = [
        (1, "prose\nLicensed under the Apache License, Version 2.0.\nprose"),
        (2, "Licensed under the Apache Licence  version 2.0"),
        (3, folded),
        (4, "intro\n\n" + MIT.replace(". ", ".\n") + "\n\noutro"),
        (5, "It says: Licensed under CC BY-NC 4.0. And more."),
        (6, "licensed under cc-by-nc 4.0\nLICENSED UNDER CC BY NC 4.0!"),
        (7, "© 2021 X. All rights reserved.\nReleased under the MIT Licence"),
    ]
    got = table(licenses.scan(documents(spark, rows)), "doc_id", "license", "scope", "n_units")
    assert got == sorted(
        [
            (1, "Apache-2.0", "line", 1),
            *((2, "Apache-2.0", s, 1) for s in ("line", "paragraph", "text")),
            *((3, "MIT", s, 1) for s in ("paragraph", "text")),
            (4, "MIT", "paragraph", 1),
            (6, "CC-BY-NC-4.0", "line", 2),
            *((7, "MIT", s, 1) for s in ("line", "paragraph", "text")),
        ],
        key=str,
    )


def test_edges(spark):
    docs = documents(spark, EDGE)
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs.limit(0)).count() == 0
    own = [("own", "the same row stands here twice and it has more than ten words in it")]
    assert table(licenses.scan(docs, own), "doc_id", "n_units") == [(6, 2), (6, 2), (6, 2), (7, 1), (7, 1), (7, 1)]
