"""Licence recognition from sentences.

Every sentence of a text is normalised and looked up among the known licence
sentences, also where signs inside it or the line breaks of a paragraph cut it into pieces
(comment marks of letters, as 'dnl' or 'rem', are words like any other); the identifiers found, in text order, are then matched against
ordered rules, each a sequence of identifiers. The first rule that matches
gives the verdict. All of it is one projection: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import need, text_of

# Known licence sentences, by identifier.
SENTENCES = {
    "apache2-short": ["Licensed under the Apache License, Version 2.0."],
    "apache2-grant": ['Licensed under the Apache License, Version 2.0 (the "License");', "Licensed under the Apache License, Version 2.0 (the License)."],
    "apache2-comply": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "as-is": ['distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3."],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2."],
    "gpl-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-warranty": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "bsd-short": ["Licensed under the BSD License.", "Licensed under the 3-Clause BSD License."],
    "reserved": ["All rights reserved."],
}

# Licence rules in order; the first whose identifiers occur in a row gives the verdict.
RULES = [
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-copy", "as-is"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-grant"]),
    ("BSD", ["bsd-grant", "bsd-warranty"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("Apache-2.0", ["apache2-short"]),
    ("MIT", ["mit-short"]),
    ("BSD", ["bsd-short"]),
    ("Proprietary", ["reserved"]),
]

#: Each known sentence holds one of these; texts without any are not split (tests hold this true).
ANCHORS = ["licens", "copyright", "warrant", "rights reserved", "redistribut", "permission"]

#: A piece ends at a newline, or at one of these signs before blanks; sentences are pieces in a row.
ENDS = "([.!?;:])[ \t\r]+"
OTHER = "[^a-z0-9]+"


def normalise(sentence: str) -> str:
    """The Python form of the normalisation, used to build the tables."""
    return re.sub(OTHER, " ", sentence.lower()).strip(" ")


def known() -> dict[str, str]:
    """Normalised sentence to identifier. A known text in which a piece ends early, as at ':', is one key all the same."""
    return {normalise(s): name for name, forms in SENTENCES.items() for s in forms}


def pieces(text: Column) -> Column:
    """The normalised pieces, lines and parts of lines, between '|'; no sentence goes on at '#', a line without letters or digits."""
    cut = F.regexp_replace(F.translate(F.lower(text), "|#", "  "), ENDS, "$1|")
    cut = F.regexp_replace(cut, "\n[^a-z0-9\n]*+\n[^a-z0-9]*+", "|#|")
    cut = F.concat(F.lit("|"), F.replace(cut, F.lit("\n"), F.lit("|")), F.lit("|"))
    return F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9|#]+", " "), r"[ |]*\|[ |]*", "|")


def sentence_ids(text: Column) -> Column:
    """Array of the identifiers of a text's known sentences, in order: each is one piece or several in a row, the longest that fits."""
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    forms = "|".join(s.replace(" ", "[ |]") for s in sorted(known(), key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(pieces(text), F.lit(rf"\|({forms})(?=\|)"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(table, F.translate(s, "|", " ")))


def _anchored(lowered: Column) -> Column:
    words = [a.split()[-1] for a in ANCHORS]  # the rest may stand beyond a line break
    found = lowered.contains(words[0])
    for a in words[1:]:
        found = found | lowered.contains(a)
    return found


def recognise(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_sentences, sentence_ids, licences, verdict``.

    ``n_sentences`` counts known licence sentences, ``sentence_ids`` joins their
    identifiers with '>' in text order, ``licences`` joins with ',' the licences
    of all rules that match, in the order of the rules, and ``verdict`` is the
    first of them, or 'none', or 'unknown' when sentences are known but no rule
    matches. Null and empty texts give 0, '', '', 'none'; repeated rows give
    repeated results; very long texts are searched whole; an empty table gives no
    rows; other columns are ignored.
    """
    need(df, id_col, text_col)
    text = text_of(text_col)
    ids = F.when(_anchored(F.lower(text)), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(">" + ">".join(seq) + ">").alias("seq")) for name, seq in RULES])
    rows = df.select(F.col(id_col).alias("doc_id"), ids.alias("ids"))
    chain = F.concat(F.lit(">"), F.array_join("ids", ">"), F.lit(">"))
    hits = F.when(F.size("ids") > 0, F.array_distinct(F.transform(F.filter(rules, lambda r: chain.contains(r["seq"])), lambda r: r["name"]))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "ids", hits.alias("hits"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ">").alias("sentence_ids"),
        F.array_join("hits", ",").alias("licences"),
        F.when(F.size("hits") > 0, F.get("hits", F.lit(0))).when(F.size("ids") > 0, "unknown").otherwise("none").alias("verdict"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL for ``recognise`` over ``documents`` in which each known sentence is one piece of one line."""
    sentences = ", ".join(f"({_quoted(s)}, {_quoted(name)})" for s, name in known().items())
    rules = ", ".join(f"({k}, {_quoted(name)}, {_quoted('>' + '>'.join(seq) + '>')})" for k, (name, seq) in enumerate(RULES))
    return f"""
    WITH known(s, name) AS (VALUES {sentences}), rules(k, licence, seq) AS (VALUES {rules}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT r, string_split(regexp_replace(lower(text), '([.!?;:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM docs),
    each_line AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM cut),
    found AS (SELECT r, i, name FROM each_line JOIN known ON s = trim(regexp_replace(line, '[^a-z0-9]+', ' ', 'g'), ' ')),
    chains AS (SELECT r, count(*) AS n, string_agg(name, '>' ORDER BY i) AS ids FROM found GROUP BY r),
    hits AS (SELECT r, licence, min(k) AS k FROM chains, rules WHERE contains('>' || ids || '>', seq) GROUP BY r, licence),
    named AS (SELECT r, string_agg(licence, ',' ORDER BY k) AS licences, arg_min(licence, k) AS verdict FROM hits GROUP BY r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences,
           CASE WHEN verdict IS NOT NULL THEN verdict WHEN n > 0 THEN 'unknown' ELSE 'none' END AS verdict
    FROM docs LEFT JOIN chains USING (r) LEFT JOIN named USING (r)
    """
