"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, and these are normalised: lower case, only letters a-z, digits and inner dots, single spaces. A known
licence sentence is a pattern over such sentences; the text becomes the sequence of their identifiers. Licence rules, the more
specific first, are sequences of identifiers that must occur in their order; what a rule has matched is taken out before
the next rule looks. Everything is a projection of one row: no shuffle, and the size of nothing grows with the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, need_columns, text_or_empty

#: Every known sentence, once normalised, has one of these word beginnings; other sentences are not looked at.
HINT = r"licen|copyright|permi|warrant|redistribut|spdx|rights\s+reserved|public\s+domain|liab|endorse|names?\s+of|later\s+version|gpl|creative\s+commons|cc[ -]by|cc0"
#: The same in texts as they are, where comment marks and the like may stand between two words.
RAW_HINT = HINT.replace(r"\s+", "[^a-z0-9]+").replace("[ -]", "[^a-z0-9]+")

# fixed values: SPDX short identifiers that a tag can name
SPDX = (
    "0BSD", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
)

_GNU = r"(the )?(terms of the )?(gnu )?"

# fixed values: known licence sentences as patterns over normalised sentences with a space at either end
SENTENCES = [
    ("apache2_grant", r" licensed under (the )?(terms of the )?apache (software )?license (version )?(v )?2(\.0)? "),
    ("apache2_comply", r" you may not use this file except in compliance with the license "),
    ("apache2_copy", r" you may obtain a copy of the license at "),
    ("apache2_asis", r" software distributed under the license is distributed on an as is basis "),
    ("apache2_limits", r" see the license for the specific language governing permissions and limitations under the license "),
    ("mit_named", r" (released|licensed|distributed|available|provided) under (the )?(terms of the )?mit licen[sc]e "),
    ("mit_grant", r" permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "),
    ("mit_notice", r" the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "),
    ("mit_warranty", r" the software is provided as is without warranty of any kind express or implied "),
    ("mit_liability", r" in no event shall the authors or copyright holders be liable for any claim damages or other liability "),
    ("isc_grant", r" permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "),
    ("isc_warranty", r" the software is provided as is and the author disclaims all warranties "),
    ("bsd_grant", r" redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "),
    ("bsd_source", r" redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "),
    ("bsd_binary", r" redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "),
    ("bsd_endorse", r" neither the names? of .* may be used to endorse or promote products derived from this software "),
    ("bsd_warranty", r" this software is provided by the .* as is and any express or implied warranties "),
    ("bsd_named", r" (released|licensed|distributed|available) under (the )?(terms of the )?(new |modified |simplified |3 clause |2 clause )?bsd (3 clause |2 clause )?licen[sc]e "),
    ("gpl3_named", r" (released|licensed|distributed|available|redistribute it and or modify it) under " + _GNU + r"(gpl|general public licen[sc]e)( as published by the free software foundation)?" + r"( either)?( version| v)? ?v?3(\.0)? "),
    ("gpl2_named", r" (released|licensed|distributed|available|redistribute it and or modify it) under " + _GNU + r"(gpl|general public licen[sc]e)( as published by the free software foundation)?" + r"( either)?( version| v)? ?v?2(\.0)? "),
    ("lgpl3_named", r" (released|licensed|distributed|available|redistribute it and or modify it) under " + _GNU + r"(lgpl|lesser general public licen[sc]e)( as published by the free software foundation)?" + r"( either)?( version| v)? ?v?3(\.0)? "),
    ("lgpl2_named", r" (released|licensed|distributed|available|redistribute it and or modify it) under " + _GNU + r"(lgpl|lesser general public licen[sc]e)( as published by the free software foundation)?" + r"( either)?( version| v)? ?v?2\.1 "),
    ("agpl3_named", r" (released|licensed|distributed|available|redistribute it and or modify it) under " + _GNU + r"(agpl|affero general public licen[sc]e)( as published by the free software foundation)?" + r"( either)?( version| v)? ?v?3(\.0)? "),
    ("gnu_later", r" or at your option any later version "),
    ("gnu_warranty", r" without even the implied warranty of merchantability or fitness for a particular purpose "),
    ("mpl2_named", r" (subject to the terms of|licensed under|released under) (the )?mozilla public license (version |v ?)?2\.0 "),
    ("epl_named", r" (licensed|made available|released) under (the )?(terms of the )?eclipse public license "),
    ("boost_named", r" (distributed|licensed|released) under (the )?boost software license "),
    ("zlib_grant", r" permission is granted to anyone to use this software for any purpose including commercial applications "),
    ("unlicense_grant", r" this is free and unencumbered software released into the public domain "),
    ("public_domain", r" (released|placed|dedicated|is) (in|into|to) the public domain "),
    ("cc0_named", r" (cc0|creative commons zero)( 1\.0)?( universal)? "),
    ("ccbyncsa_named", r" (cc by nc sa|creative commons attribution non ?commercial share ?alike)( [1-4]\.0)?( international)? "),
    ("ccbync_named", r" (cc by nc|creative commons attribution non ?commercial)( [1-4]\.0)?( international)?( licen[sc]e)? "),
    ("ccbysa_named", r" (cc by sa|creative commons attribution share ?alike)( [1-4]\.0)?( international)? "),
    ("ccbynd_named", r" (cc by nd|creative commons attribution no ?deriv(ative)?s?)( [1-4]\.0)?( international)? "),
    ("ccby_named", r" (cc by [1-4]\.0|creative commons attribution( [1-4]\.0)?( international)? licen[sc]e) "),
    ("rights_reserved", r" all rights reserved "),
    ("copyright", r" copyright (c )?[0-9]{4} "),
    *((f"spdx_{x.lower().replace('.', '').replace('-', '')}", rf" spdx license identifier {x.lower().replace('-', ' ').replace('.', r'\.')}( only| or later)? ") for x in SPDX),
]

# fixed values: licences by the sequences of sentences that make them up, the more specific first
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]), ("MIT", ["mit_grant", "mit_notice"]), ("MIT", ["mit_grant"]), ("MIT", ["mit_named"]),
    ("Apache-2.0", ["apache2_grant", "apache2_comply", "apache2_copy", "apache2_asis", "apache2_limits"]), ("Apache-2.0", ["apache2_grant", "apache2_comply"]), ("Apache-2.0", ["apache2_grant"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]), ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]), ("BSD", ["bsd_grant"]), ("BSD", ["bsd_named"]),
    ("ISC", ["isc_grant", "isc_warranty"]), ("ISC", ["isc_grant"]), ("Zlib", ["zlib_grant"]), ("Unlicense", ["unlicense_grant"]),
    ("AGPL-3.0-or-later", ["agpl3_named", "gnu_later"]), ("AGPL-3.0", ["agpl3_named"]), ("LGPL-3.0-or-later", ["lgpl3_named", "gnu_later"]), ("LGPL-3.0", ["lgpl3_named"]),
    ("LGPL-2.1-or-later", ["lgpl2_named", "gnu_later"]), ("LGPL-2.1", ["lgpl2_named"]), ("GPL-3.0-or-later", ["gpl3_named", "gnu_later"]), ("GPL-3.0", ["gpl3_named"]),
    ("GPL-2.0-or-later", ["gpl2_named", "gnu_later"]), ("GPL-2.0", ["gpl2_named"]), ("MPL-2.0", ["mpl2_named"]), ("EPL", ["epl_named"]), ("BSL-1.0", ["boost_named"]),
    ("CC0-1.0", ["cc0_named"]), ("CC-BY-NC-SA", ["ccbyncsa_named"]), ("CC-BY-NC", ["ccbync_named"]), ("CC-BY-SA", ["ccbysa_named"]), ("CC-BY-ND", ["ccbynd_named"]), ("CC-BY", ["ccby_named"]),
    ("public-domain", ["public_domain"]), ("all-rights-reserved", ["copyright", "rights_reserved"]), ("all-rights-reserved", ["rights_reserved"]),
    *((x, [f"spdx_{x.lower().replace('.', '').replace('-', '')}"]) for x in SPDX),
]


def rule_pattern(ids: list[str]) -> str:
    """Over a sequence such as ",a,b,c,": the identifiers in order, others between them allowed."""
    return "," + ",(?:[a-z0-9_]+,)*?".join(ids) + ","


#: A sentence ends at a full stop and the like before white space, or at an empty line; a single line break does not end it, nor does "v." before a number.
CUT = r"((?<!\bv)[.!?]|(?<=\bv)[.](?!\s+[0-9])|(?<=\bv)[!?])\s+|\n\s*\n"
#: As the SQL has it, whose patterns can't look around: the full stop of a "v." before a number is made a space, which normalising does anyway; then any other cuts.
SQL_VERSION, SQL_CUT = r"\b(v)\.(\s+[0-9])", r"([.!?])\s+|\n\s*\n"
MARK = "\x1e"


def sentences(text):
    """Normalised sentences of a text that have a hint of a licence, each with a space at either end."""
    cut = F.split(F.regexp_replace(F.lower(text), CUT, "$1" + MARK), MARK)
    hinted = F.filter(cut, lambda s: s.rlike(RAW_HINT))
    clean = F.transform(hinted, lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.]+", " "), r"\.+( |$)|(^| )\.+", " ")), F.lit(" ")))
    return F.filter(F.transform(clean, lambda s: F.regexp_replace(s, " +", " ")), lambda s: s.rlike(HINT))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with sentence_ids (of the known sentences of the whole text, in order), licenses (in order of the rules) and unknown_sentences.

    A sentence in which several known ones occur gives them in the order of SENTENCES. unknown_sentences counts those that speak of a licence
    but are not known. Null and empty texts have empty arrays and 0. Every row comes out once, repeated ones too; of df's columns, those
    with the new names are replaced.
    """
    need_columns(df, text_col)
    kept = [c for c in df.columns if c not in ("sentence_ids", "licenses", "unknown_sentences")]
    text = text_or_empty(text_col)
    # most texts have nothing of the kind: one pass over them decides
    found = F.when(text.rlike("(?i)" + RAW_HINT), sentences(text)).otherwise(F.array().cast("array<string>"))
    known = lambda s: F.array_compact(F.array(*[F.when(s.rlike(p), F.lit(n)) for n, p in SENTENCES]))
    hits, ids, count = (fresh(df, x) for x in ("_hits", "_ids", "_unknown"))
    per_sentence = df.withColumn(hits, F.transform(found, known))
    unknown = F.size(F.filter(hits, lambda h: F.size(h) == 0)).cast("long")
    tagged = per_sentence.withColumn(ids, F.flatten(hits)).withColumn(count, unknown)
    sequence = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))

    def apply(state, rule):
        hit = F.rlike(state["rest"], rule["pattern"])
        rest = F.regexp_replace(state["rest"], rule["pattern"], F.lit(","))
        return F.when(hit, F.struct(rest.alias("rest"), F.concat(state["names"], F.array(rule["name"])).alias("names"))).otherwise(state)

    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(rule_pattern(own)).alias("pattern")) for n, own in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))
    names = F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(rules, start, apply, lambda s: s["names"]))).otherwise(F.array().cast("array<string>"))
    return tagged.select(*kept, F.col(ids).alias("sentence_ids"), names.alias("licenses"), F.col(count).alias("unknown_sentences"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "unknown_sentences"
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle() -> str:
    known = ", ".join(f"CASE WHEN regexp_matches(s, {_quoted(p)}) THEN {_quoted(n)} END" for n, p in SENTENCES)
    first = f"""
    WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
    b AS (SELECT doc_id, CASE WHEN regexp_matches(t, {_quoted(RAW_HINT)}) THEN list_filter(string_split(regexp_replace(regexp_replace(t, {_quoted(SQL_VERSION)}, '\\1 \\2', 'g'), {_quoted(SQL_CUT)}, '\\1' || chr(30), 'g'), chr(30)), lambda s: regexp_matches(s, {_quoted(RAW_HINT)})) ELSE [] END AS cut FROM a),
    c AS (SELECT doc_id, list_filter(list_transform(cut, lambda s: regexp_replace(' ' || trim(regexp_replace(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)|(^| )\\.+', ' ', 'g')) || ' ', ' +', ' ', 'g')), lambda s: regexp_matches(s, {_quoted(HINT)})) AS clean FROM b),
    d AS (SELECT doc_id, list_transform(clean, lambda s: list_filter([{known}], lambda x: x IS NOT NULL)) AS hits FROM c),
    r0 AS (SELECT doc_id, array_to_string(flatten(hits), ',') AS sentence_ids, len(list_filter(hits, lambda h: len(h) = 0)) AS unknown_sentences,
                  ',' || array_to_string(flatten(hits), ',') || ',' AS rest, []::VARCHAR[] AS names FROM d)"""

    def step(sql: str, i: int) -> str:
        name, ids = RULES[i]
        pattern = _quoted(rule_pattern(ids))
        hit = f"regexp_matches(rest, {pattern})"
        return sql + f""",
    r{i + 1} AS (SELECT doc_id, sentence_ids, unknown_sentences, CASE WHEN {hit} THEN regexp_replace(rest, {pattern}, ',', 'g') ELSE rest END AS rest,
                 CASE WHEN {hit} AND NOT list_contains(names, {_quoted(name)}) THEN list_append(names, {_quoted(name)}) ELSE names END AS names FROM r{i})"""

    return reduce(step, range(len(RULES)), first) + f"\nSELECT doc_id, sentence_ids, array_to_string(names, ',') AS licenses, unknown_sentences FROM r{len(RULES)}"


ORACLE = _oracle()
