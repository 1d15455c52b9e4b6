"""License scan by sentence rules, in native expressions only.

A text's sentences are brought to a plain form and looked up in a table of known license sentences;
the row of identifiers found is then read by ordered rules, longer ones first, each taking away what
it explains. Everything happens within a row: no join, no shuffle, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of licenses as sentences give them, in plain form; "/" separates spellings.
NAMES = {
    "Apache-2.0": "apache license version 2.0/apache license 2.0/apache 2.0 license/apache 2.0/apache license v2.0/apache license v2",
    "Apache-1.1": "apache software license version 1.1/apache license 1.1",
    "MIT": "mit license/mit/expat license/x11 license",
    "ISC": "isc license/isc",
    "BSD-2-Clause": "bsd 2 clause license/2 clause bsd license/simplified bsd license/freebsd license",
    "BSD-3-Clause": "bsd 3 clause license/3 clause bsd license/new bsd license/modified bsd license/revised bsd license",
    "BSD": "bsd license/bsd style license",
    "GPL-2.0": "gnu general public license version 2/gnu general public license v2.0/gnu gpl version 2/gpl version 2/gplv2/gpl v2/gpl 2.0",
    "GPL-3.0": "gnu general public license version 3/gnu general public license v3.0/gnu gpl version 3/gpl version 3/gplv3/gpl v3/gpl 3.0",
    "GPL": "gnu general public license/gnu gpl/gpl",
    "LGPL-2.1": "gnu lesser general public license version 2.1/gnu lgpl version 2.1/lgpl version 2.1/lgplv2.1/lgpl 2.1",
    "LGPL-3.0": "gnu lesser general public license version 3/gnu lgpl version 3/lgpl version 3/lgplv3/lgpl 3.0",
    "AGPL-3.0": "gnu affero general public license version 3/gnu agpl version 3/agpl version 3/agplv3/agpl 3.0",
    "MPL-2.0": "mozilla public license version 2.0/mozilla public license v. 2.0/mozilla public license 2.0/mpl 2.0",
    "EPL-2.0": "eclipse public license version 2.0/eclipse public license v2.0/eclipse public license 2.0/epl 2.0",
    "EPL-1.0": "eclipse public license version 1.0/eclipse public license v1.0/eclipse public license 1.0/epl 1.0",
    "CDDL-1.0": "common development and distribution license version 1.0/cddl 1.0",
    "BSL-1.0": "boost software license version 1.0/boost software license 1.0",
    "Zlib": "zlib license/zlib libpng license",
    "Unlicense": "unlicense/the unlicense",
    "WTFPL": "wtfpl/do what the fuck you want to public license",
    "CC0-1.0": "cc0/cc0 1.0/cc0 1.0 universal/creative commons zero v1.0 universal",
    "ODbL-1.0": "open database license/open database license v1.0/odbl 1.0",
    "OFL-1.1": "sil open font license version 1.1/sil open font license 1.1/ofl 1.1",
    "Artistic-2.0": "artistic license 2.0/artistic license version 2.0",
}
#: Parts of the names of the attribution licenses.
_CC_PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
_CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Identifiers that SPDX tags give besides the spellings above, with the name to report.
SPDX = {i.lower().replace("-", " "): i for i in (
    "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Artistic-2.0", *NAMES, "0BSD", "AFL-3.0", "APSL-2.0", "Artistic-1.0",
    "BSD-1-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause-Clear", "BSD-4-Clause", "BlueOak-1.0.0", "BUSL-1.1", "CDDL-1.1",
    "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EUPL-1.1", "EUPL-1.2", "FTL", "HPND", "IJG", "IPL-1.0", "LPPL-1.3c", "MIT-0",
    "MPL-1.0", "MPL-1.1", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODC-By-1.0", "OpenSSL", "OSL-3.0", "PDDL-1.0",
    "PHP-3.01", "PostgreSQL", "PSF-2.0", "QPL-1.0", "Ruby", "SSPL-1.0", "UPL-1.0", "Vim", "W3C", "X11", "ZPL-2.1",
    *(f"{family}{end}" for family in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-1.0",
                                      "AGPL-3.0", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3") for end in ("", "-only", "-or-later")))}

#: Sentences of license texts in plain form.
BODY = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction including without limitation the "
                 "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                 "persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
                  "of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
                 "warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether "
                     "in an action of contract tort or otherwise arising from out of or in connection with the software or the use "
                     "or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                 "following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following "
                  "disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                  "following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the holder nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                 "granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation either version 2 of the license or at your option any "
                   "later version",
    "gpl-3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation either version 3 of the license or at your option any "
                   "later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
                "warranty of merchantability or fitness for a particular purpose",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
                    "on an as is basis without warranties or conditions of any kind either express or implied",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public-domain": "this work is in the public domain",
    "all-rights": "all rights reserved",
}

#: Rules in order: what the row of identifiers must hold, one after the other, and the license that says.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("Apache-2.0", ("under:Apache-2.0", "apache-comply", "apache-as-is")),
    ("Apache-2.0", ("under:Apache-2.0", "apache-comply")),
    ("MPL-2.0", ("mpl-2",)),
    ("Unlicense", ("unlicense",)),
    ("Public-domain", ("public-domain",)),
    ("Proprietary", ("copyright", "all-rights")),
    ("Proprietary", ("all-rights",)),
]

#: What a text must hold for any known sentence to be in it, and how sentences are brought to plain form.
HINT = "(?i)licen[sc]|copyright|permi|rights reserved|redistribut|free software|merchantability|noninfringement|warrant|liable|public domain"
SENTENCE_END = r"([.!?])[ \t\r]+([^0-9 \t\r])"  # "v. 2.0" is no end
#: How lines of a paragraph come to stand for joined sentences: comment marks go, a blank line ends every sentence.
PARAGRAPHS = [
    (r"(?md)^[ \t\r/*#;%|!<>\"'`~=_-]+", ""),
    (r"(?imd)^(rem|dnl)(?=[ \t\r]|$)[ \t\r]*", ""),
    (r"(?i)(?<!version)\n(?=\(?[0-9a-z]{1,2}[.)][ \t]+[a-z])", "\n\n"),  # items of a list
    (SENTENCE_END, "$1\n\n$2"),
    (r"(?d)\n\n\(?[0-9A-Za-z]{1,2}\)[ \t]+", "\n\n"),
    (r"([.!?:][\"')]*[ \t\r]*)\n(?![0-9])", "$1\n\n"),
    (r"(?imd)^(copyright[ \t]*(?:\(c\)|\u00a9|[0-9]{4}).*)$", "\n$1\n"),
]
PLAIN = [
    (r"[^a-z0-9.+]+", " "),
    (r"^[ .]+|[ .]+$", ""),
    (r"^spdx license identifier ", "licensed under "),
    (r"^((this|the) (work|software|project|file|program|code|document|package|library|dataset|content) is )?"
     r"(licensed|released|distributed|published|available|made available|provided|covered) (under|by)( the terms of)?( the)? ", "licensed under "),
    (r"^neither the name of .* nor the names of (its|any) contributors ", "neither the name of the holder nor the names of its contributors "),
    (r"^copyright .*$", "copyright"),
]


def known_sentences() -> dict[str, str]:
    """Identifier of every known sentence in plain form."""
    names = {spelling: name for name, spellings in NAMES.items() for spelling in spellings.split("/")}
    for kind in _CC_KINDS:
        parts = kind.split("-")
        for version in _CC_VERSIONS:
            name = f"CC-{kind.upper()}-{version}"
            long = " ".join(_CC_PARTS[p] for p in parts)
            for spelling in (f"cc {' '.join(parts)} {version}", f"creative commons {long} {version}",
                             f"creative commons {long} {version} international", f"creative commons {long} {version} license",
                             f"creative commons {long} {version} international license"):
                names[spelling] = name
    out = {f"licensed under {spelling}{end}": f"under:{name}" for spelling, name in names.items() for end in ("", " the license")}
    out |= {f"licensed under {spelling} {later}": f"under:{name}-or-later" for spelling, name in names.items()
            if "GPL-" in name for later in ("or later", "or any later version", "or at your option any later version")}
    return out | {text: key for key, text in BODY.items()} | {"copyright": "copyright"}


def all_sentences() -> dict[str, str]:
    """The known sentences and those that SPDX tags make."""
    return {f"licensed under {spelling}": f"under:{name}" for spelling, name in SPDX.items()} | known_sentences()


def rules(sentences: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(license, identifiers as they stand in a row of identifiers), in the order they are tried."""
    named = sorted({v for v in (sentences or known_sentences()).values() if v.startswith("under:")})
    return [(name, "".join(f" {i} " for i in ids)) for name, ids in RULES] + [(v[6:], f" {v} ") for v in named]


def plain_form(sentence: Column) -> Column:
    out = F.lower(sentence)
    for pattern, by in PLAIN:
        out = F.regexp_replace(out, pattern, by)
    return out


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; an empty array if it has none.

    A sentence is looked up with its lines joined; if it isn't known, its parts at ";" and ":" are, and
    of a part that isn't known the lines each. A line known as a whole is not cut.
    """
    known = all_sentences()
    table = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values())))

    def looked_up(s: Column) -> Column:
        return F.try_element_at(table, plain_form(s))

    def lines(s: Column) -> Column:
        return F.split(s, "\n")

    def joined(s: Column, otherwise) -> Column:
        """The identifier of the whole; a copyright line doesn't take in the lines after it."""
        whole = F.filter(F.array(looked_up(s)), lambda i: i.isNotNull() & ((i != "copyright") | ~F.contains(s, F.lit("\n"))))
        return F.flatten(F.transform(F.array(whole), lambda w: F.when(F.size(w) > 0, w).otherwise(otherwise(s))))

    def parts(s: Column) -> Column:
        uncut = F.array_join(F.transform(lines(s), lambda x: F.when(
            looked_up(x).isNotNull(), F.translate(x, ";:", "  ")).otherwise(x)), "\n")
        return F.flatten(F.transform(F.split(uncut, "[;:]"), lambda p: joined(p, lambda p: F.transform(lines(p), looked_up))))

    for pattern, by in PARAGRAPHS:
        paragraphs = F.regexp_replace(text if pattern == PARAGRAPHS[0][0] else paragraphs, pattern, by)
    found = F.flatten(F.transform(F.split(paragraphs, "\n{2,}"), lambda s: joined(s, parts)))
    hint = HINT.replace(" ", "[^a-z0-9]+")  # its words may stand on two lines
    return F.when(text.rlike(hint), F.filter(found, lambda i: i.isNotNull())).otherwise(F.array().cast("array<string>"))


def licenses_of(ids: Column) -> Column:
    """(licenses in the order of the rules, identifiers that no rule explains)."""
    told = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern")) for name, pattern in rules(all_sentences())])
    row = F.array_join(F.transform(ids, lambda i: F.concat(F.lit(" "), i, F.lit(" "))), "")
    start = F.struct(row.alias("row"), F.array().cast("array<string>").alias("names"))

    def apply(state, rule):
        hit = F.contains(state["row"], rule["pattern"])
        return F.struct(F.replace(state["row"], rule["pattern"], F.lit("  ")).alias("row"),
                        F.when(hit, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    return F.when(F.size(ids) > 0, F.aggregate(told, start, apply)).otherwise(start)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with sentence_ids, licenses (distinct, in the order of the rules) and unexplained.

    Null and empty texts have none of either. Rows are judged each by themselves; an empty table
    gives an empty result. A column that already has one of the three names is replaced. Sentences
    end with a paragraph, or with . ! or ? and white space, unless a digit follows; a line known by itself
    counts too. Case, punctuation, spacing and comment marks don't matter.
    """
    rows = docs.withColumn("sentence_ids", F.coalesce(sentence_ids(F.col(text_col)), F.array().cast("array<string>")))
    rows = rows.withColumn("__told", licenses_of(F.col("sentence_ids")))
    return rows.withColumn("licenses", F.array_distinct("__told.names")).withColumn(
        "unexplained", F.filter(F.split(F.trim("__told.row"), " +"), lambda i: i != "")).drop("__told")


def oracle() -> str:
    """The scan of documents in SQL: the same tables and rules, written out, for sentences that don't wrap."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    plain = "lower(s)"
    for pattern, by in PLAIN:
        plain = f"regexp_replace({plain}, {quote(pattern)}, {quote(by)}, 'g')"
    known = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known_sentences().items())
    sql = f"""WITH known(plain, id) AS (VALUES {known}),
    parts AS (SELECT doc_id, unnest(string_split(regexp_replace(text, {quote(SENTENCE_END)}, '\\1' || chr(10) || '\\2', 'g'), chr(10))) AS s,
        generate_subscripts(string_split(regexp_replace(text, {quote(SENTENCE_END)}, '\\1' || chr(10) || '\\2', 'g'), chr(10)), 1) AS n
        FROM documents WHERE regexp_matches(text, {quote(HINT)})),
    hits AS (SELECT doc_id, n, id FROM parts JOIN known ON known.plain = {plain}),
    r0 AS (SELECT doc_id, string_agg(id, ',' ORDER BY n) AS sentence_ids, string_agg(' ' || id || ' ', '' ORDER BY n) AS row_,
        CAST([] AS VARCHAR[]) AS names FROM hits GROUP BY doc_id)"""
    for k, (name, pattern) in enumerate(rules()):
        sql += f""", r{k + 1} AS (SELECT doc_id, sentence_ids, replace(row_, {quote(pattern)}, '  ') AS row_,
        CASE WHEN contains(row_, {quote(pattern)}) AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)})
        ELSE names END AS names FROM r{k})"""
    return sql + f""" SELECT d.doc_id, coalesce(r.sentence_ids, '') AS sentence_ids,
        coalesce(array_to_string(r.names, ','), '') AS licenses,
        coalesce(regexp_replace(trim(r.row_), ' +', ',', 'g'), '') AS unexplained
        FROM documents d LEFT JOIN r{len(rules())} r USING (doc_id)"""
