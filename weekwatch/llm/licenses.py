"""Find licences by their sentences.

A text is normalised and cut into sentences; a sentence becomes the identifiers of all known
wordings it holds as whole words, by position; those that lie within a longer one do not count. What an SPDX tag
declares is read as whole names, each an identifier of its own. The identifiers of a text, in order, are then matched
against licence rules, the first rule first; what a rule has matched is not matched again.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.llm.text import whole

# Wordings of licence sentences after ``normalise``, each with its identifier.
SENTENCES = (
    ("mit_ref", "released under the mit license"),
    ("mit_ref", "licensed under the mit license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included"),
    ("apache2_ref", "licensed under the apache license version 2.0"),
    ("apache2_ref", "licenses this file to you under the apache license version 2.0"),
    ("apache2_obtain", "you may obtain a copy of the license at"),
    ("apache2_comply", "you may not use this file except in compliance with the license"),
    ("agpl3_or_later", "gnu affero general public license version 3 or at your option any later version"),
    ("lgpl3_or_later", "gnu lesser general public license version 3 or at your option any later version"),
    ("lgpl21_or_later", "gnu lesser general public license version 2.1 or at your option any later version"),
    ("gpl3_or_later", "gnu general public license version 3 or at your option any later version"),
    ("gpl2_or_later", "gnu general public license version 2 or at your option any later version"),
    ("agpl3_ref", "gnu affero general public license version 3"),
    ("lgpl3_ref", "gnu lesser general public license version 3"),
    ("lgpl21_ref", "gnu lesser general public license version 2.1"),
    ("gpl3_ref", "gnu general public license version 3"),
    ("gpl2_ref", "gnu general public license version 2"),
    ("gpl_later", "or at your option any later version"),
    ("gpl_redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl_redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl_redistribute", "you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("agpl_redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("version_3", "version 3 of the license"),
    ("version_21", "version 2.1 of the license"),
    ("version_2", "version 2 of the license"),
    ("bsd_redistribute", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd3_ref", "bsd 3 clause license"),
    ("bsd2_ref", "bsd 2 clause license"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_notice", "the above copyright notice and this permission notice appear in all copies"),
    ("zlib_as_is", "this software is provided as is without any express or implied warranty"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsl_grant", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mpl2_ref", "mozilla public license version 2.0"),
    ("mpl11_ref", "mozilla public license version 1.1"),
    ("epl2_ref", "eclipse public license version 2.0"),
    ("epl2_ref", "eclipse public license 2.0"),
    ("epl1_ref", "eclipse public license version 1.0"),
    ("cc_by_nc_sa", "licensed under cc by nc sa 4.0"),
    ("cc_by_nc_nd", "licensed under cc by nc nd 4.0"),
    ("cc_by_nc", "licensed under cc by nc 4.0"),
    ("cc_by_sa", "licensed under cc by sa 4.0"),
    ("cc_by_nd", "licensed under cc by nd 4.0"),
    ("cc_by", "licensed under cc by 4.0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("cc0", "cc0 1.0 universal"),
    ("as_is", "the software is provided as is without warranty of any kind"),
    ("as_is", "this software is provided by the copyright holders and contributors as is"),
    ("no_warranty", "without warranties or conditions of any kind"),
    ("no_warranty", "without any warranty"),
    ("no_liability", "in no event shall"),
    ("all_rights", "all rights reserved"),
    *(
        ("cc_by" + end, " ".join(("creative commons attribution", *words, "4.0")))
        for end, parts in (
            ("", ()),
            ("_sa", (("sharealike", "share alike"),)),
            ("_nd", (("noderivatives", "no derivatives", "noderivs"),)),
            ("_nc", (("noncommercial", "non commercial"),)),
            ("_nc_sa", (("noncommercial", "non commercial"), ("sharealike", "share alike"))),
            ("_nc_nd", (("noncommercial", "non commercial"), ("noderivatives", "no derivatives", "noderivs"))),
        )
        for words in product(*parts)
    ),
)

# Names that SPDX tags declare.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause "
    "BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 "
    "ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later "
    "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 "
    "MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA OFL-1.1 OpenSSL OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby SSPL-1.0 "
    "Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
# A plus stands for "or later" in older tags; a name is matched whole, in any case.
SPDX_NAMES = {
    **{n.lower(): n for n in SPDX},
    **{f"{n[: -len('-or-later')]}+".lower(): n for n in SPDX if n.endswith("-or-later")},
}

# Licences and the identifiers that make them up, in the order they are tried.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is", "no_liability")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse", "as_is", "no_liability")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "as_is", "no_liability")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2_ref", "apache2_comply", "apache2_obtain", "no_warranty")),
    ("Apache-2.0", ("apache2_ref", "apache2_comply", "apache2_obtain")),
    ("Apache-2.0", ("apache2_ref",)),
    ("GPL-3.0-or-later", ("gpl_redistribute", "gpl3_ref", "gpl_later", "no_warranty")),
    ("GPL-3.0-or-later", ("gpl3_ref", "gpl_later")),
    ("GPL-2.0-or-later", ("gpl2_ref", "gpl_later")),
    ("AGPL-3.0-or-later", ("agpl3_ref", "gpl_later")),
    ("LGPL-3.0-or-later", ("lgpl3_ref", "gpl_later")),
    ("LGPL-2.1-or-later", ("lgpl21_ref", "gpl_later")),
    ("GPL-3.0-or-later", ("gpl3_or_later",)),
    ("GPL-2.0-or-later", ("gpl2_or_later",)),
    ("AGPL-3.0-or-later", ("agpl3_or_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_or_later",)),
    ("LGPL-2.1-or-later", ("lgpl21_or_later",)),
    ("GPL-3.0-or-later", ("gpl_redistribute", "version_3", "gpl_later")),
    ("GPL-2.0-or-later", ("gpl_redistribute", "version_2", "gpl_later")),
    ("AGPL-3.0-or-later", ("agpl_redistribute", "version_3", "gpl_later")),
    ("LGPL-3.0-or-later", ("lgpl_redistribute", "version_3", "gpl_later")),
    ("LGPL-2.1-or-later", ("lgpl_redistribute", "version_21", "gpl_later")),
    ("LGPL-2.0-or-later", ("lgpl_redistribute", "version_2", "gpl_later")),
    ("GPL-3.0", ("gpl_redistribute", "version_3")),
    ("GPL-2.0", ("gpl_redistribute", "version_2")),
    ("AGPL-3.0", ("agpl_redistribute", "version_3")),
    ("LGPL-3.0", ("lgpl_redistribute", "version_3")),
    ("LGPL-2.1", ("lgpl_redistribute", "version_21")),
    ("LGPL-2.0", ("lgpl_redistribute", "version_2")),
    ("AGPL-3.0", ("agpl3_ref",)),
    ("LGPL-3.0", ("lgpl3_ref",)),
    ("LGPL-2.1", ("lgpl21_ref",)),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL-2.0", ("gpl2_ref",)),
    ("ISC", ("isc_grant", "isc_notice")),
    ("0BSD", ("isc_grant",)),
    ("MIT-0", ("mit_grant", "as_is")),
    ("Zlib", ("zlib_as_is", "no_liability", "zlib_grant")),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("BSL-1.0", ("bsl_grant",)),
    ("Unlicense", ("unlicense",)),
    ("MPL-2.0", ("mpl2_ref",)),
    ("MPL-1.1", ("mpl11_ref",)),
    ("EPL-2.0", ("epl2_ref",)),
    ("EPL-1.0", ("epl1_ref",)),
    ("BSD-3-Clause", ("bsd3_ref",)),
    ("BSD-2-Clause", ("bsd2_ref",)),
    ("MIT", ("mit_ref",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa",)),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-ND-4.0", ("cc_by_nd",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC0-1.0", ("cc0",)),
    *((licence, (f"spdx:{name}",)) for name, licence in SPDX_NAMES.items()),
)
# Told only of a text in which no rule matches: other licences have this sentence as well.
LAST_RULE = ("proprietary", "all_rights")

SENTENCE_END = r"[.!?;]+( |$)"
NO_WORD = r"[^a-z0-9.!?;]+"
# "v2", "v. 2.0", "ver 2": the point ends no sentence.
VERSION = r"(^| )v(?:er(?:s(?:ion)?)?)?\.? ?([0-9])"
SPDX_TAG = r"spdx-license-identifier:[ \t]*"
SPDX_LINE = r"^[a-z0-9.+() \t-]*"
SPDX_WORD = r"[a-z0-9][a-z0-9.+-]*"
SPDX_OPERATORS = ("and", "or", "with")


def normalise(text: Column) -> Column:
    """Lower case, one space for whatever is no ASCII letter, digit or mark that ends a sentence, versions written out."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), NO_WORD, " "), VERSION, "$1version $2")


def wordings_pattern(wordings: list[str]) -> str:
    """A pattern that finds, at every position of a sentence between two spaces, the longest wording that starts there.

    Wordings are whole words and may overlap, so they are looked ahead for. One that lies within a longer one
    is passed over there: what comes before it and what follows are compared with the longer one's.
    """

    def alone(wording: str) -> str:
        inside = [
            f"(?!(?<={re.escape(before)}){re.escape(after)})"
            for longer in wordings
            if longer != wording
            for at in re.finditer(f"(?= {re.escape(wording)} )", f" {longer} ")
            if at.start()
            for before, after in [(f" {longer} "[: at.start() + 1], f" {longer} "[at.start() + 1 :])]
        ]
        return "".join(inside) + re.escape(wording)

    return f"(?<= )(?=({'|'.join(alone(w) for w in sorted(wordings, key=lambda w: (-len(w), w)))}) )"


def telling_words(wordings: list[str]) -> list[str]:
    """A few words of which each wording holds at least one, long ones where there is a choice."""
    words: list[str] = []
    left = set(wordings)
    while left:
        held = {w: {x for x in left if w in x.split()} for x in left for w in x.split()}
        long = {w for w in held if len(w) > 5} or set(held)
        words.append(min(long, key=lambda w: (-len(held[w]), w)))
        left -= held[words[-1]]
    return words


def sentence_ids(text: Column) -> Column:
    """The identifiers of what SPDX tags declare and of the known wordings of a text, in order."""
    wordings = [wording for _, wording in SENTENCES]
    names = F.create_map(*(F.lit(x) for name, wording in SENTENCES for x in (wording, name)))
    declared = F.create_map(*(F.lit(x) for name in SPDX_NAMES for x in (name, f"spdx:{name}")))
    none = F.array().cast("array<string>")
    # Most sentences hold none: plain search comes first, for words and then for the wordings that hold no other.
    least = [w for w in wordings if not any(other != w and f" {other} " in f" {w} " for other in wordings)]
    any_of = lambda x, some: reduce(lambda a, b: a | b, (F.contains(x, F.lit(f" {w} ")) for w in some))

    def known(sentence: Column) -> Column:
        found = F.regexp_extract_all(sentence, F.lit(wordings_pattern(wordings)), F.lit(1))
        holds = F.when(any_of(sentence, telling_words(wordings)), any_of(sentence, least))
        return F.when(holds, F.transform(found, lambda w: names[w])).otherwise(none)

    def of_part(part: Column, i: Column) -> Column:
        """A part begins behind a tag, but for the first one.

        Names are joined by operators; where none follows a name, the rest of the line is no part of it.
        """
        words = F.transform(F.regexp_extract_all(F.regexp_extract(part, SPDX_LINE, 0), F.lit(SPDX_WORD), F.lit(0)), lambda x: F.rtrim(x, F.lit(".")))
        ends = F.array_position(F.transform(words, lambda x, n: (n % 2 == 1) & ~x.isin(*SPDX_OPERATORS)), True)
        declaration = F.slice(words, F.lit(1), F.when(ends == 0, F.size(words)).otherwise((ends - 1).cast("int")))
        said = F.filter(declaration, lambda _, n: n % 2 == 0)
        tagged = F.filter(F.transform(said, lambda name: declared[name]), lambda name: name.isNotNull())
        sentences = F.transform(F.split(normalise(part), SENTENCE_END), lambda x: known(F.concat(F.lit(" "), x, F.lit(" "))))
        return F.concat(F.when(i > 0, tagged).otherwise(none), F.flatten(sentences))

    return F.flatten(F.transform(F.split(F.lower(text), SPDX_TAG), of_part))


def licences_of(ids: Column) -> Column:
    """The licences whose rules match a list of identifiers, in the order of the rules."""

    def matched(state: Column, rule: Column) -> Column:
        holds = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.replace(state["left"], rule["ids"], F.lit("|#|")).alias("left"),
            F.when(holds, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("|" + "|".join(i) + "|").alias("ids")) for n, i in RULES))
    start = F.struct(
        F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|")).alias("left"),
        F.array().cast("array<string>").alias("found"),
    )
    found = F.array_distinct(F.aggregate(rules, start, matched)["found"])
    licence, sentence = LAST_RULE
    left_over = (F.size(found) == 0) & F.array_contains(ids, sentence)
    return F.when(left_over, F.array(F.lit(licence))).otherwise(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentence_ids, licences`` of every row; both lists are empty where nothing is known.

    Null and empty texts hold no sentence, an empty table gives no rows. Unknown sentences between known
    ones do not break a rule. One row comes out per row, repeated rows and rows with a null id included, however
    long its text; other columns are not looked at. No row is moved between tasks.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(whole(text_col)).alias("sentence_ids"))
    return ids.withColumn(
        "licences",
        F.when(F.size("sentence_ids") > 0, licences_of(F.col("sentence_ids"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
