"""Operator 1, license scans by sentence rules, in SQL functions only.

Known licence sentences are looked up as runs of lower-case words inside a text, so a known sentence is found however its lines are
wrapped, indented or marked as comments.  A run starts where a sentence, a line or a clause (after ``:``, ``;``, ``)`` or ``|``) starts, ends
where one ends, and holds no sentence end (``.``, ``!`` or ``?`` and white space); of several the longest counts.  So copyright lines,
headings, blank lines and list marks around a sentence do not hide it, and a mention in the middle of prose is no licence.  The
identifiers found, in text order, are matched against ordered rules: a rule fits where its identifiers stand next to
each other.  The first rule that fits names the licence and the verdict; all that fit are listed in rule order.

A null or empty text has no sentence: licence null, verdict ``none``.  Known sentences that no rule uses have no verdict either.
Repeated rows are judged alike; only doc_id and text are read, so other columns may have any name.  Texts of any length are judged whole; an empty
table gives an empty result.  Of equal rules the first in order wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

#: Licence sentences as published, normalised: fixed values.
SENTENCES = {
    "mit.short": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache2.short": "licensed under the apache license version 2 0",
    "apache2.licensed": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2.basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3.short": "this work is licensed under the gnu general public license version 3",
    "gpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl3.details": "see the gnu general public license for more details",
    "bsd3.use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "ccbync4.short": "licensed under cc by nc 4 0",
    "ccby4.short": "licensed under cc by 4 0",
    "ccbysa4.short": "licensed under cc by sa 4 0",
    "cc0.short": "this work is dedicated to the public domain",
    "reserved": "all rights reserved",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl21.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2.subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2.copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2.copys": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "bsl1.short": "distributed under the boost software license version 1 0",
    "ccbynd4.short": "licensed under cc by nd 4 0",
    "ccbyncsa4.short": "licensed under cc by nc sa 4 0",
    "ccbyncnd4.short": "licensed under cc by nc nd 4 0",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4.work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
#: Rules in order: licence, identifiers next to each other, verdict.
RULES = (
    ("GPL-3.0-or-later", ("gpl3.free", "gpl3.hope", "gpl3.details"), "deny"),
    ("GPL-3.0-or-later", ("gpl3.free",), "deny"),
    ("GPL-3.0", ("gpl3.short",), "deny"),
    ("AGPL-3.0-or-later", ("agpl3.free",), "deny"),
    ("GPL-2.0-or-later", ("gpl2.free",), "deny"),
    ("LGPL-3.0-or-later", ("lgpl3.free",), "review"),
    ("LGPL-2.1-or-later", ("lgpl21.free",), "review"),
    ("MPL-2.0", ("mpl2.subject", "mpl2.copy"), "review"),
    ("MPL-2.0", ("mpl2.subject", "mpl2.copys"), "review"),
    ("MPL-2.0", ("mpl2.subject",), "review"),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4.short",), "deny"),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd4.short",), "deny"),
    ("CC-BY-ND-4.0", ("ccbynd4.short",), "deny"),
    ("CC-BY-NC-4.0", ("ccbync4.work",), "deny"),
    ("CC-BY-SA-4.0", ("ccbysa4.work",), "review"),
    ("CC-BY-NC-4.0", ("ccbync4.short",), "deny"),
    ("CC-BY-SA-4.0", ("ccbysa4.short",), "review"),
    ("Apache-2.0", ("apache2.licensed", "apache2.copy", "apache2.basis", "apache2.see"), "allow"),
    ("Apache-2.0", ("apache2.licensed",), "allow"),
    ("Apache-2.0", ("apache2.short",), "allow"),
    ("MIT", ("mit.grant", "mit.notice"), "allow"),
    ("MIT", ("mit.licensed",), "allow"),
    ("MIT", ("mit.short",), "allow"),
    ("BSD-3-Clause", ("bsd3.use",), "allow"),
    ("ISC", ("isc.grant",), "allow"),
    ("BSL-1.0", ("bsl1.short",), "allow"),
    ("CC-BY-4.0", ("ccby4.work",), "allow"),
    ("Unlicense", ("unlicense.free",), "allow"),
    ("CC-BY-4.0", ("ccby4.short",), "allow"),
    ("CC0-1.0", ("cc0.short",), "allow"),
    ("Proprietary", ("reserved",), "deny"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Marks in normalised text: a sentence ended; a line or clause ended.
_END, _CLAUSE = "\x01", "\x02"
#: A version ("v. 2.0") is no sentence end.
_VERSION = r"([ \t\n\r][vV])\.[ \t\n\r]+([0-9])"


def _known_runs() -> str:
    runs = "|".join(t.replace(" ", f"[ {_CLAUSE}]+") for t in sorted(SENTENCES.values(), key=len, reverse=True))
    return f"(?:^|[{_END}{_CLAUSE}]) ?({runs})(?= ?(?:[{_END}{_CLAUSE}]|$))"


def scan_licences(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_sentences, identifiers, licences, licence, verdict).

    identifiers and licences are comma-separated, in text order and rule order.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), _VERSION, "$1 $2")
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(text, r"([.!?])[ \t\n\r]+", "$1" + _END).alias("marked"))
    clauses = "\n\r:;)|"
    words = F.regexp_replace(F.translate("marked", _UPPER + clauses + _CLAUSE, _LOWER + _CLAUSE * len(clauses) + " "), f"[^a-z0-9{_END}{_CLAUSE}]+", " ")
    s = s.select("doc_id", F.size(F.filter(F.split("marked", _END), lambda x: F.length(x) > 0)).cast("long").alias("n_sentences"), F.regexp_extract_all(words, F.lit(_known_runs()), F.lit(1)).alias("runs"))
    known = F.create_map(*(F.lit(x) for name, text in SENTENCES.items() for x in (text, name)))
    s = s.select("doc_id", "n_sentences", F.concat_ws(",", F.transform("runs", lambda x: F.try_element_at(known, F.regexp_replace(x, f"[ {_CLAUSE}]+", " ")))).alias("identifiers"))
    row = F.concat(F.lit(","), "identifiers", F.lit(","))
    fits = [(name, row.contains("," + ",".join(seq) + ","), verdict) for name, seq, verdict in RULES]
    licences = F.array_distinct(F.filter(F.array(*(F.when(fit, name) for name, fit, _ in fits)), lambda x: x.isNotNull()))
    verdict = F.lit("none")
    for _, fit, what in reversed(fits):
        verdict = F.when(fit, what).otherwise(verdict)
    s = s.withColumn("names", licences)
    return s.select("doc_id", "n_sentences", "identifiers", F.concat_ws(",", "names").alias("licences"), F.expr("get(names, 0)").alias("licence"), verdict.alias("verdict"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in DuckDB.  It has no look-ahead: marks are doubled, so that the one that ends a run leaves another for the next."""
    e, c, runs = r"\x01", r"\x02", "|".join(t.replace(" ", r"[ \x02]+") for t in sorted(SENTENCES.values(), key=len, reverse=True))
    clauses = " || ".join(["chr(10)", "chr(13)", "':;)|'", "chr(2)"])
    known = "CASE regexp_replace(x, '[ \\x02]+', ' ', 'g') " + " ".join(f"WHEN '{t}' THEN '{k}'" for k, t in SENTENCES.items()) + " END"
    fit = lambda seq: f"contains(',' || identifiers || ',', ',{','.join(seq)},')"
    names = ", ".join(f"CASE WHEN {fit(seq)} THEN '{name}' END" for name, seq, _ in RULES)
    verdict = "CASE " + " ".join(f"WHEN {fit(seq)} THEN '{what}'" for _, seq, what in RULES) + " ELSE 'none' END"
    first = "CASE " + " ".join(f"WHEN {fit(seq)} THEN '{name}'" for name, seq, _ in RULES) + " END"
    return rf"""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_VERSION}', '\1 \2', 'g'), '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g') AS marked FROM documents),
w AS (SELECT doc_id, len(list_filter(string_split(marked, chr(1)), lambda x: x <> '')) AS n,
  regexp_replace(regexp_replace(translate(marked, '{_UPPER}' || {clauses}, '{_LOWER}' || repeat(chr(2), 6) || ' '), '[^a-z0-9{e}{c}]+', ' ', 'g'), '([{e}{c}])', '\1\1', 'g') AS words FROM s),
r AS (SELECT doc_id, n, regexp_extract_all(words, '(?:^|[{e}{c}]) ?({runs})(?: ?[{e}{c}]| ?$)', 1) AS runs FROM w),
d AS (SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, coalesce(array_to_string(list_transform(runs, lambda x: {known}), ','), '') AS identifiers FROM r)
SELECT doc_id, n_sentences, identifiers, (SELECT coalesce(string_agg(n, ',' ORDER BY o), '') FROM (SELECT n, min(o) AS o FROM (SELECT unnest([{names}]) AS n, generate_subscripts([{names}], 1) AS o) WHERE n IS NOT NULL GROUP BY n)) AS licences,
  {first} AS licence, {verdict} AS verdict FROM d
"""


OP1_SQL = _sql()
