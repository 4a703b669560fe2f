"""License scans by sentence rules, in DataFrame functions only.

A text is cut into parts at sentence signs and line ends, and normalised
(lower case, signs to single spaces). A known licence sentence is one part or
several that follow one another, since known sentences contain signs and wrap
over lines; a blank line ends a sentence. An equi-join with a fixed table maps
the sentences found to identifiers. A document's identifiers, in order of
position, are matched against ordered rules: a rule holds if its identifiers
follow one another in the sequence. Where several rules hold, one whose
identifiers are a part of another's is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known sentences (already normalised) and their identifiers.
SENTENCES = {
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "licensed under the apache license version 2 0": "apache_2_ref",
    "licensed under the apache license version 2 0 the license": "apache_2_ref",
    "you may not use this file except in compliance with the license": "compliance",
    "you may obtain a copy of the license at": "copy_at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_as_is",
    "this work is licensed under the gnu general public license version 3": "gpl_3_ref",
    "licensed under the gnu general public license version 3": "gpl_3_ref",
    "this work is licensed under the gnu general public license version 2": "gpl_2_ref",
    "licensed under the gnu general public license version 2": "gpl_2_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl_3_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl_2_later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "licensed under cc by nc 4 0": "cc_by_nc_4_ref",
    "licensed under cc by 4 0": "cc_by_4_ref",
    "licensed under cc by sa 4 0": "cc_by_sa_4_ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc_by_4_ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "licensed under the mozilla public license version 2 0": "mpl_2_ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl_2_ref",
    "all rights reserved": "reserved",
}

#: Licence rules, each an ordered sequence of identifiers.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_ref",)),
    ("Apache-2.0", ("apache_2_ref", "compliance", "copy_at", "apache_as_is")),
    ("Apache-2.0", ("apache_2_ref", "compliance")),
    ("Apache-2.0", ("apache_2_ref",)),
    ("GPL-3.0-or-later", ("gpl_3_later",)),
    ("GPL-3.0-only", ("gpl_3_ref",)),
    ("GPL-2.0-or-later", ("gpl_2_later",)),
    ("GPL-2.0-only", ("gpl_2_ref",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("CC-BY-NC-4.0", ("cc_by_nc_4_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4_ref",)),
    ("CC-BY-4.0", ("cc_by_4_ref",)),
    ("MPL-2.0", ("mpl_2_ref",)),
    ("proprietary", ("reserved",)),
)

#: A text without any of these words has no known sentence (a test proves it of the table).
MARKERS = r"(?i)licens|permission|warrant|liable|redistribut|copyright|endorse|rights[^a-z0-9]+reserved"
#: Parts end at . ! ? ; : where white space or the text's end follows, and at a line's end.
PART_END = r"[.!?;:]+(?=\s|$)"
BLANK_LINE = r"\n[^\S\n]*(?=\n)"
#: Signs for a part's end, a blank line and the digits of a part's number; capitals cannot occur in a lowered text.
PART, BLANK, DIGITS = "Z", "Y", "ABCDEFGHIJ"


def known_sentences(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{sentence}', '{name}')" for sentence, name in sorted(SENTENCES.items()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known(sentence, id)")


def numbered_parts(text: Column) -> Column:
    """The words of a text with single spaces; every part starts with its number."""
    ended = F.regexp_replace(F.regexp_replace(F.lower(text), PART_END, PART), BLANK_LINE, PART + BLANK)
    words = F.regexp_replace(F.regexp_replace(ended, "\n", PART), f"[^a-z0-9{PART}{BLANK}]+", " ")
    parts = F.transform(F.split(words, PART), lambda part, at: F.concat(
        F.lit(PART), F.translate(at.cast("string"), "0123456789", DIGITS), part))
    return F.concat(F.array_join(parts, ""), F.lit(PART))


def sentence_pattern() -> str:
    """The known sentences, longest first, from a part's start to a part's end."""
    longest = sorted(SENTENCES, key=lambda s: (-len(s.split()), s))
    gap = f"[ {PART}{DIGITS}]+"
    return f"{PART}[{DIGITS}]+ ?(?:{'|'.join(s.replace(' ', gap) for s in longest)})(?= ?{PART})"


def sentence_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, position, id`` of every known sentence; the position is that of
    its first part, counted from 0. Of sentences that share words, the first
    and longest counts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(MARKERS))
    found = F.regexp_extract_all(numbered_parts(F.col("text")), F.lit(sentence_pattern()), F.lit(0))
    number = F.regexp_extract("found", f"^{PART}([{DIGITS}]+)", 1)
    own = rows.select("doc_id", F.explode(found).alias("found")).select(
        "doc_id", F.translate(number, DIGITS, "0123456789").cast("int").alias("position"),
        F.trim(F.regexp_replace("found", f"[ {PART}{DIGITS}]+", " ")).alias("sentence"))
    # the sentence table is fixed and holds a few dozen rows
    return own.join(F.broadcast(known_sentences(docs.sparkSession)), "sentence").select("doc_id", "position", "id")


def _holds(rule: tuple[str, ...]) -> Column:
    return F.col("path").contains(">" + ">".join(rule) + ">")


def _ids(text: Column) -> Column:
    """The identifiers of a text's known sentences in order, without a shuffle:
    the table is a literal map of a few dozen entries."""
    known = F.create_map(*(F.lit(x) for pair in sorted(SENTENCES.items()) for x in pair))
    found = F.regexp_extract_all(numbered_parts(text), F.lit(sentence_pattern()), F.lit(0))
    plain = F.transform(found, lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, f"[ {PART}{DIGITS}]+", " "))))
    return F.when(text.rlike(MARKERS), F.array_compact(plain)).otherwise(F.array().cast("array<string>"))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, ids, licenses`` of every row, judged by itself."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))
    rows = rows.withColumn("path", F.concat(F.lit(">"), F.array_join("ids", ">"), F.lit(">")))
    held = []
    for name, rule in RULES:
        larger = [other for label, other in RULES if label != name and len(other) > len(rule)
                  and ">".join(rule) in ">".join(other)]
        ok = _holds(rule)
        for other in larger:
            ok = ok & ~_holds(other)
        held.append(F.when(ok, F.lit(name)))
    return rows.select("doc_id", "ids", F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))).alias("licenses"))


def licenses_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, licenses`` of rows with a known sentence: the identifiers
    in order, and the licences whose rule holds, sorted. Sentences that no rule
    takes give ``licenses`` empty. Each row is a document, also one with a null
    id or an id that another row has."""
    return _judged(docs, id_col, text_col).filter(F.size("ids") > 0)


def op10_licenses(docs: DataFrame) -> DataFrame:
    """Every document: its sentence identifiers and licences, comma-joined
    (empty if none), and their numbers. Null texts have none."""
    return _judged(docs, "doc_id", "text").select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def op10_sql() -> str:
    """DuckDB twin: sentences by list functions, rules by text search."""
    known = ", ".join(f"({_sql_text(s)}, {_sql_text(i)})" for s, i in sorted(SENTENCES.items()))
    cases = []
    for name, rule in RULES:
        tests = [f"contains(path, '>{'>'.join(rule)}>')"]
        tests += [f"NOT contains(path, '>{'>'.join(o)}>')" for label, o in RULES
                  if label != name and len(o) > len(rule) and ">".join(rule) in ">".join(o)]
        cases.append(f"CASE WHEN {' AND '.join(tests)} THEN '{name}' END")
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[.!?;:]+(\\s)', chr(10) || '\\1', 'g'), '[.!?;:]+$', chr(10)) AS body
           FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS part,
                 generate_subscripts(string_split(body, chr(10)), 1) AS position FROM marked),
hits AS (SELECT p.doc_id, p.position, k.id FROM parts p JOIN known k
         ON trim(regexp_replace(lower(p.part), '[^a-z0-9]+', ' ', 'g')) = k.sentence),
paths AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY position) AS ids,
                 '>' || string_agg(id, '>' ORDER BY position) || '>' AS path FROM hits GROUP BY doc_id),
named AS (SELECT doc_id, n, ids, array_to_string(list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))), ',') AS licenses FROM paths)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN named USING (doc_id)"""
