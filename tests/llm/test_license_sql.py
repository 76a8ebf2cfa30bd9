"""The licence scan against its SQL on texts with padding, long texts, repeats, nulls, other columns, and an empty table."""

import duckdb
import pandas as pd
import pytest
from test_license_texts import CASES

from wakeline.llm import license_scan

DOCS = "doc_id long, text string, marked string, runs string, identifiers int"
COLUMNS = ["doc_id", "n_sentences", "identifiers", "licences", "licence", "verdict"]
MORE = [
    "Released under" + " " * 1200 + "the MIT License.",
    "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "Licensed under CC-BY-NC-SA 4.0\nLicensed under CC BY 4.0",
    "word " * 60_000 + ".\nAll rights reserved.\n" + "word " * 60_000,
    "This is free and unencumbered software released into the public domain.",
    "\x01\x02 all rights reserved", "All rights reserved.All rights reserved. All rights reserved", "", None, "no licence", "é Licensed under the\tMIT License!\r\nÉ",
]


def by_sql(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"text": object}))
    cur = con.execute(license_scan.OP1_SQL)
    names = [c[0] for c in cur.description]
    return sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("texts", [[c[0] for c in CASES] + MORE * 2, []])
def test_agrees(spark, texts):
    rows = list(enumerate(texts))
    df = license_scan.scan_licences(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)
    assert got == by_sql(rows)
    if rows:
        verdicts = {r[0]: r[4:] for r in got}
        at = len(CASES)
        assert verdicts[at] == ("MIT", "allow") and verdicts[at + 1] == ("MPL-2.0", "review") and verdicts[at + 2] == ("CC-BY-NC-SA-4.0", "deny") and verdicts[at + 3] == ("Proprietary", "deny")
