"""Licence scans by sentence rules.

Texts are cut into sentences, which are normalised and looked up among the sentences of known
licences. The identifiers of a document, in the order of its sentences, are matched against ordered
rules, each a sequence of identifiers that stands for a licence. Only DataFrame and SQL functions
run here; the table of sentences has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-link": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
                 "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                 "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
                 "following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                "portions of the Software",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                 "that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                  "following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                  "the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                 "promote products derived from this software without specific prior written permission",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl-free-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                  "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-free-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                  "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "reserved": "All rights reserved",
}
# Ordered rules, licence first.
RULES = [
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-obtain", "apache-link", "apache-as-is"]),
    ("Apache-2.0", ["apache-notice", "apache-comply"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-free-3"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-free-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("LicenseRef-reserved", ["reserved"]),
]
CUT = "\u0001"
STOPS, BLANK = "([.!?;:])[ \t\r\n]+", "\n[ \t\r]*\n"
OTHER = "[^a-z0-9+]+"


def normal(text: str) -> str:
    """What a sentence is compared by: letters and digits in small ASCII, one space between."""
    import re

    return re.sub(OTHER, " ", text.lower()).strip()


def sentences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, place, said): normalised sentences, and the lines of sentences that go over
    several. A sentence ends after .!?;: before white space, and at a blank line. A colon or
    semicolon thus ends one too, in texts and in the known sentences alike."""
    cut = F.split(F.regexp_replace(F.regexp_replace(F.col("text"), STOPS, "$1" + CUT), BLANK, CUT), CUT)
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
            .select("row", "doc_id", F.posexplode(cut).alias("place", "whole")))
    lines = F.when(F.instr("whole", "\n") > 0, F.array_union(F.array("whole"), F.split("whole", "\n"))).otherwise(F.array("whole"))
    said = F.trim(F.regexp_replace(F.lower("line"), OTHER, " "))
    return (rows.select("row", "doc_id", "place", F.posexplode(lines).alias("line_no", "line"))
            .select("row", "doc_id", "place", "line_no", said.alias("said")))


def _parts() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Known sentences with a stop inside are sequences: each part gets an identifier."""
    import re

    ids, split = {}, {}
    for name, text in SENTENCES.items():
        parts = [normal(p) for p in re.sub(STOPS, r"\1" + CUT, text).split(CUT)]
        split[name] = [ids.setdefault(p, name if len(parts) == 1 else f"{name}-{i}") for i, p in enumerate(parts)]
    return {i: p for p, i in ids.items()}, [(licence, [x for name in names for x in split[name]]) for licence, names in RULES]


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document and rule found in it: doc_id, licence, rule, n_sentences, first_sentence
    (the place of its first sentence) and n_found. A rule is found where its identifiers follow each
    other among the document's known sentences; one inside a longer rule of the same licence that is
    also found is left out. Documents without any, null and empty texts give no row; rows that repeat
    give rows that repeat."""
    spark = docs.sparkSession
    known, rules = _parts()
    table = spark.createDataFrame([(p, i) for i, p in known.items()], "said string, id string")
    found = sentences(docs).join(F.broadcast(table), "said")  # a fixed table of about forty rows
    chain = (found.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "line_no", "id"))).alias("seen"))
             .withColumn("chain", F.concat(F.lit("|"), F.array_join("seen.id", "|"), F.lit("|"))))
    out = []
    for k, (licence, ids) in enumerate(rules):
        sought = "|" + "|".join(ids) + "|"
        longer = ["|" + "|".join(o) + "|" for name, o in rules if name == licence and len(o) > len(ids)
                  and sought in "|" + "|".join(o) + "|"]
        # the bars between neighbours are doubled so that matches side by side are counted
        doubled = lambda c: F.replace(c, F.lit("|"), F.lit("||"))
        wide = sought.replace("|", "||")[1:-1]
        n = (F.length(doubled(F.col("chain"))) - F.length(F.replace(doubled(F.col("chain")), F.lit(wide), F.lit("")))) / len(wide)
        ahead = F.substring_index("chain", sought, 1)
        at = F.length(ahead) - F.length(F.replace(ahead, F.lit("|"), F.lit("")))
        covered = F.lit(False)
        for other in longer:
            covered = covered | F.contains("chain", F.lit(other))
        out.append(F.when(F.contains("chain", F.lit(sought)) & ~covered, F.struct(
            F.lit(licence).alias("licence"), F.lit(f"{licence}/{k}").alias("rule"), F.lit(len(ids)).alias("n_sentences"),
            F.get("seen.place", at).cast("long").alias("first_sentence"), n.cast("long").alias("n_found"))))
    return chain.select("doc_id", F.explode(F.array_compact(F.array(*out))).alias("x")).select("doc_id", "x.*")


def _sql() -> str:
    known, rules = _parts()
    values = ", ".join(f"('{p}', '{i}')" for i, p in known.items())
    hits = []
    for k, (licence, ids) in enumerate(rules):
        sought = "|" + "|".join(ids) + "|"
        longer = ["|" + "|".join(o) + "|" for name, o in rules if name == licence and len(o) > len(ids)
                  and sought in "|" + "|".join(o) + "|"]
        without = "".join(f" AND NOT contains(chain, '{x}')" for x in longer)
        hits.append(
            f"SELECT doc_id, '{licence}' AS licence, '{licence}/{k}' AS rule, CAST({len(ids)} AS INTEGER) AS n_sentences,\n"
            f"  CAST(places[len(string_split(split_part(chain, '{sought}', 1), '|'))] AS BIGINT) AS first_sentence,\n"
            f"  CAST(len(list_filter(range(1, len(ids) + 1), lambda i: list_slice(ids, i, i + {len(ids) - 1}) = {ids})) AS BIGINT) AS n_found\n"
            f"FROM chains WHERE contains(chain, '{sought}'){without}")
    return f"""
WITH known(said, id) AS (VALUES {values}),
texts AS (SELECT doc_id, row_number() OVER () AS row, text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, row, string_split(regexp_replace(regexp_replace(text, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'),
        '\\n[ \\t\\r]*\\n', chr(1), 'g'), chr(1)) AS s FROM texts),
said AS (SELECT doc_id, row, unnest(s) AS whole, generate_subscripts(s, 1) - 1 AS place FROM cut),
lines AS (SELECT doc_id, row, place, 0 AS line_no, whole AS line FROM said
    UNION ALL SELECT doc_id, row, place, 1 AS line_no, unnest(list_filter(list_distinct(string_split(whole, chr(10))), lambda x: x <> whole)) FROM said WHERE contains(whole, chr(10))),
found AS (SELECT doc_id, row, place, line_no, id FROM lines JOIN known ON known.said = trim(regexp_replace(lower(line), '[^a-z0-9+]+', ' ', 'g'))),
chains AS (SELECT doc_id, row, list(id ORDER BY place, line_no, id) AS ids, list(place ORDER BY place, line_no, id) AS places,
    '|' || string_agg(id, '|' ORDER BY place, line_no, id) || '|' AS chain FROM found GROUP BY doc_id, row)
{chr(10).join(("UNION ALL " if i else "") + h for i, h in enumerate(hits))}
"""


SQL = _sql()
