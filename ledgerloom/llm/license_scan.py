"""Ordered licence signatures, in DataFrame functions only.

A cheap keyword test gates each text.  Where it holds, the words around every
keyword form a window; the rules whose own keyword stands in that window run
their pattern on it, and what they find becomes an interval of words.  One
ordered sweep then drops each interval that lies inside an interval of equal
or higher priority.  All of this happens inside the row: no shuffle, and work
that follows the number of keywords.

There are two kinds of signatures: written ones, each a phrase of a licence's
text, notice or title with its own priority, and those that every pair of a
licence name and a sentence form makes.

Defined cases: a null text is an empty one, with no words and no labels; an
empty table stays empty; repeated rows are scanned row by row; other columns
are kept, but for those of the result, which are set.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words on both sides of a keyword that a signature may cover.
REACH = 14

# Base phrases: words in order, and label.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

# Label, and a pattern of its name over lower-case words joined by one space.
NAMES = (
    ("mit", r"mit"),
    ("x11", r"x11"),
    ("isc", r"isc"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", r"bsd"),
    ("zero-bsd", r"(?:0bsd|zero clause bsd)"),
    ("agpl-3.0", r"(?:agpl|(?:gnu )?affero general public license)(?: version| v)? ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", r"(?:lgpl|(?:gnu )?(?:lesser|library) general public license)(?: version| v)? ?v?2(?: 1)?(?: only| or later)?"),
    ("lgpl-3.0", r"(?:lgpl|(?:gnu )?lesser general public license)(?: version| v)? ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", r"(?:gpl|(?:gnu )?general public license)(?: version| v)? ?v?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", r"(?:gpl|(?:gnu )?general public license)(?: version| v)? ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", r"(?:gpl|(?:gnu )?general public license)(?: version| v)? ?v?3(?: 0)?(?: only| or later)?"),
    ("mpl-1.1", r"(?:mpl|mozilla public license)(?: version| v)? ?1 1"),
    ("mpl-2.0", r"(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", r"(?:epl|eclipse public license)(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", r"(?:epl|eclipse public license)(?: version| v)? ?2(?: 0)?"),
    ("cddl-1.0", r"(?:cddl|common development and distribution license)(?: version)? ?1(?: 0)?"),
    ("cpl-1.0", r"common public license(?: version)? ?1(?: 0)?"),
    ("eupl-1.2", r"(?:eupl|european union public licen[cs]e)(?: version| v)? ?1(?: 2)?"),
    ("artistic-2.0", r"artistic license(?: version)? ?2(?: 0)?"),
    ("artistic-1.0", r"artistic license(?: version)? ?1(?: 0)?"),
    ("boost-1.0", r"(?:boost software license|bsl)(?: version)? ?1(?: 0)?"),
    ("zlib", r"zlib"),
    ("libpng", r"libpng"),
    ("openssl", r"openssl"),
    ("python-2.0", r"(?:python software foundation|psf) license(?: version)? ?2?"),
    ("postgresql", r"postgresql"),
    ("ruby", r"ruby"),
    ("php-3.01", r"php license(?: version)? ?3(?: 01)?"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl"),
    ("cc0-1.0", r"(?:cc0|creative commons zero)(?: 1 0)?"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution noncommercial noderiv\w*)(?: \d \d)?"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution noncommercial sharealike)(?: \d \d)?"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution noncommercial)(?: \d \d)?"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution noderiv\w*)(?: \d \d)?"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution sharealike)(?: \d \d)?"),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)(?: \d \d)?"),
    ("gfdl-1.3", r"(?:gfdl|(?:gnu )?free documentation license)(?: version| v)? ?1(?: 3)?"),
    ("ofl-1.1", r"(?:ofl|sil open font license)(?: version)? ?1(?: 1)?"),
    ("odbl-1.0", r"(?:odbl|open database license)(?: version| v)? ?1?(?: 0)?"),
    ("ms-pl", r"(?:ms pl|microsoft public license)"),
    ("ncsa", r"(?:ncsa|university of illinois)"),
    ("afl-3.0", r"academic free license(?: version)? ?3?(?: 0)?"),
    ("osl-3.0", r"open software license(?: version)? ?3?(?: 0)?"),
    ("upl-1.0", r"universal permissive license(?: version| v)? ?1?(?: 0)?"),
)
# Priority, confidence, and how a sentence names a licence.
FORMS = (
    (5, 1.0, r"spdx license identifier {}(?: license)?"),
    (4, 0.98, r"(?:is|are) (?:licensed|distributed|released|provided|available) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?(?: version \d(?: \d)?)?"),
    (3, 0.95, r"(?:licensed|distributed|released|provided|available|redistributed) under (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?{}(?: licen[cs]e)?(?: version \d(?: \d)?)?"),
    (2, 0.9, r"licen[cs]e (?:is )?(?:the )?{}(?: licen[cs]e)?"),
    (2, 0.9, r"subject to (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (1, 0.8, r"(?:the )?{}(?: software)? licen[cs]e"),
)
# Written signatures: label, priority, confidence, a keyword of every match, and a pattern over lower-case words.
# At most REACH words stand on either side of a match's anchor.
WRITTEN = (
    # Titles and bare families.
    ("apache", 0, 0.7, "apache", r"apache license"),
    ("gpl", 0, 0.7, "general", r"general public license"),
    ("lgpl", 1, 0.75, "general", r"(?:lesser|library) general public license"),
    ("agpl", 1, 0.75, "affero", r"affero general public license"),
    ("mpl", 1, 0.75, "mozilla", r"mozilla public license"),
    ("epl", 1, 0.75, "eclipse", r"eclipse public license"),
    ("cddl", 1, 0.75, "common", r"common development and distribution license"),
    ("eupl", 1, 0.75, "european", r"european union public licen[cs]e"),
    ("artistic", 1, 0.75, "artistic", r"artistic license"),
    ("creative-commons", 0, 0.6, "creative", r"creative commons (?:public )?licen[cs]e"),
    ("gfdl", 1, 0.75, "documentation", r"free documentation license"),
    ("ofl", 1, 0.75, "font", r"open font license"),
    ("ms-rl", 2, 0.9, "reciprocal", r"microsoft reciprocal license"),
    ("ibm-public", 2, 0.9, "ibm", r"ibm public license"),
    ("qpl", 2, 0.9, "q public", r"q public license"),
    ("npl", 2, 0.9, "netscape", r"netscape public license"),
    ("sspl-1.0", 2, 0.9, "server", r"server side public license(?: version 1)?"),
    ("bsl-1.1", 2, 0.9, "business", r"business source license(?: 1 1)?"),
    ("elastic-2.0", 2, 0.9, "elastic", r"elastic license(?: 2 0)?"),
    ("commons-clause", 2, 0.9, "commons clause", r"commons clause license condition"),
    ("polyform", 2, 0.9, "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) license"),
    ("openrail", 2, 0.9, "rail", r"(?:creativeml )?open rail(?: m)? license"),
    ("hippocratic", 2, 0.9, "hippocratic", r"hippocratic license"),
    ("blueoak-1.0.0", 2, 0.9, "oak", r"blue oak model license(?: 1 0 0)?"),
    ("mulan-psl-2.0", 2, 0.9, "mulan", r"mulan permissive software license(?: v ?2)?"),
    ("cecill", 2, 0.9, "cecill", r"cecill(?: b| c)? (?:free software )?licen[cs]e"),
    ("vim", 2, 0.9, "vim", r"vim license"),
    ("w3c", 2, 0.9, "w3c", r"w3c software (?:notice and |and document )?license"),
    ("unicode", 2, 0.9, "unicode", r"unicode (?:license agreement|license v3)"),
    ("curl", 2, 0.9, "curl", r"curl license"),
    ("icu", 2, 0.9, "icu", r"icu license"),
    ("beerware", 2, 0.9, "beer", r"(?:beer ware|beerware) license"),
    ("ogl-uk", 2, 0.9, "government", r"open government licen[cs]e(?: v ?[123](?: 0)?)?"),
    ("etalab", 2, 0.9, "ouverte", r"licence ouverte(?: open licence)?"),
    ("odc-by", 2, 0.9, "commons attribution", r"open data commons attribution license"),
    ("pddl", 2, 0.9, "dedication", r"public domain dedication and license"),
    ("wtfpl", 2, 0.9, "what the", r"do what the \w+ you want to public license"),
    ("eula", 2, 0.9, "end user", r"end user licen[cs]e agreement"),
    ("commercial", 1, 0.7, "commercial", r"commercial licen[cs]e(?: agreement)?"),
    ("proprietary", 2, 0.8, "proprietary", r"proprietary and confidential"),
    ("proprietary", 2, 0.8, "proprietary", r"proprietary licen[cs]e"),
    ("proprietary", 1, 0.7, "reserved", r"all rights reserved"),
    # Grants and conditions of licence texts.
    ("mit", 3, 0.95, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 3, 0.9, "permission", r"above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 2, 0.8, "warranty", r"the software is provided as is without warranty of any kind express or implied"),
    ("ncsa", 4, 0.95, "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and documentation to deal"),
    ("boost-1.0", 4, 0.95, "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("boost-1.0", 3, 0.9, "boost", r"boost software license version 1 0"),
    ("isc", 3, 0.95, "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 2, 0.85, "warranties", r"the author disclaims all warranties with regard to this software"),
    ("postgresql", 3, 0.9, "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("hpnd", 2, 0.85, "permission", r"permission to use copy modify and distribute this software and its documentation"),
    ("bsd", 3, 0.9, "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", 2, 0.85, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 2, 0.85, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 3, 0.92, "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 4, 0.95, "advertising", r"all advertising materials mentioning features or use of this software"),
    ("bsd", 1, 0.8, "warranties", r"any express or implied warranties including but not limited to the implied warranties"),
    ("zlib", 3, 0.9, "implied", r"provided as is without any express or implied warranty"),
    ("zlib", 3, 0.95, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 3, 0.95, "misrepresented", r"plainly marked as such and must not be misrepresented as being the original software"),
    ("json", 4, 0.95, "evil", r"the software shall be used for good not evil"),
    ("unlicense", 3, 0.95, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", 2, 0.9, "unlicense", r"unlicense org"),
    ("public-domain", 2, 0.8, "domain", r"(?:dedicated to|released into|in) the public domain"),
    ("cc0-1.0", 3, 0.95, "waived", r"to the extent possible under law .{1,60} waived all copyright"),
    ("cc0-1.0", 2, 0.9, "cc0", r"cc0 1 0 universal(?: public domain dedication| license)?"),
    ("fsf-all-permissive", 3, 0.95, "permitted", r"with or without modification are permitted in any medium without royalty"),
    ("gpl", 1, 0.7, "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("perl", 3, 0.9, "perl", r"(?:under|distributed under|licensed under) the same terms as perl(?: itself)?"),
    ("ofl-1.1", 3, 0.95, "font", r"font software is licensed under the sil open font license(?: version 1 1)?"),
    # Notices in source files.
    ("apache-2.0", 4, 0.98, "apache", r"licensed under the apache license version 2 0 the license"),
    ("apache-2.0", 2, 0.9, "compliance", r"may not use this file except in compliance with the license"),
    ("apache-2.0", 3, 0.95, "apache", r"apache org licenses license 2 0"),
    ("apache-2.0", 1, 0.85, "basis", r"distributed under the license is distributed on an as is basis"),
    ("apache-1.1", 3, 0.9, "apache", r"apache software license version 1 1"),
    ("gpl-2.0-or-later", 4, 0.95, "version 2", r"free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 4, 0.95, "version 3", r"free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", 3, 0.9, "version 2", r"free software foundation (?:either )?version 2 of the license"),
    ("gpl-3.0", 3, 0.9, "version 3", r"free software foundation (?:either )?version 3 of the license"),
    ("gpl", 2, 0.85, "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 3, 0.85, "redistribute", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", 3, 0.85, "redistribute", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 2, 0.85, "received", r"you should have received a copy of the gnu general public license"),
    ("lgpl", 2, 0.85, "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", 2, 0.85, "received", r"you should have received a copy of the gnu affero general public license"),
    ("gpl", 1, 0.7, "warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-2.0", 4, 0.95, "1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", 4, 0.95, "2007", r"gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", 4, 0.95, "1999", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", 4, 0.95, "2007", r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", 4, 0.95, "2007", r"gnu affero general public license version 3 19 november 2007"),
    ("classpath-exception", 3, 0.9, "permission", r"copyright holders of this library give you permission to link this library"),
    ("mpl-2.0", 4, 0.95, "mozilla", r"subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 3, 0.9, "mpl", r"copy of the mpl was not distributed with this file"),
    ("mpl-1.1", 3, 0.9, "mozilla", r"subject to the mozilla public license version 1 1"),
    ("epl-1.0", 3, 0.9, "eclipse", r"available under the terms of the eclipse public license v ?1 0"),
    ("epl-2.0", 3, 0.9, "eclipse", r"available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("gfdl", 3, 0.9, "documentation", r"under the terms of the gnu free documentation license"),
    ("cc-by-4.0", 3, 0.95, "attribution", r"creative commons attribution 4 0 international(?: public)? license"),
    ("cc-by-sa-4.0", 3, 0.95, "sharealike", r"creative commons attribution sharealike 4 0 international(?: public)? license"),
    ("cc-by-nc-4.0", 3, 0.95, "noncommercial", r"creative commons attribution noncommercial 4 0 international(?: public)? license"),
    ("cc-by-nd-4.0", 3, 0.95, "noderiv", r"creative commons attribution noderivatives 4 0 international(?: public)? license"),
    ("cc-by-nc-sa-4.0", 3, 0.95, "sharealike", r"creative commons attribution noncommercial sharealike 4 0 international(?: public)? license"),
    ("cc-by-nc-nd-4.0", 3, 0.95, "noderiv", r"creative commons attribution noncommercial noderivatives 4 0 international(?: public)? license"),
    ("python-2.0", 3, 0.9, "python", r"psf license agreement for python"),
    ("python-2.0", 3, 0.9, "python", r"python software foundation license version 2"),
    ("ruby", 2, 0.85, "ruby", r"(?:under the )?same license as ruby"),
)

# Words around which windows are cut: every match holds one of them.
ANCHORS = (
    "license", "licence", "licensed", "licenses", "spdx", "subject", "distributed", "released", "provided", "available", "redistributed", "permission", "redistribution", "redistributions",
    "redistribute", "reserved", "domain", "unencumbered", "unlicense", "warranty", "warranties", "endorse", "advertising", "misrepresented", "evil", "waived", "cc0", "permitted", "perl", "proprietary",
)
# Parts of the anchors that a text is searched for before anything else.
PREFILTER = ("licen", "spdx", "permission", "redistribut", "unencumbered", "warrant", "endorse", "misrepresented", "cc0")
# Anchors too common to open the gate alone, with the words that a signature has beside them.
PHRASES = ("subject to", "distributed under", "released under", "provided under", "available under", "provided as is", "rights reserved", "public domain", "advertising materials", "not evil", "waived all", "proprietary and", "as perl", "modification are permitted")
# Words of name patterns that don't tell one licence from another.
GENERIC = frozenset("license licen version public software gnu only or later clause free of and v3 v2 v1 by nc nd sa".split())


def _gates(pattern: str) -> list[str]:
    """The telling words of a name pattern; every match holds one of them."""
    plain = re.sub(r"\\[a-z]\*?|\[[^]]*\]", " ", pattern.replace("(?:", " "))
    return sorted({w for w in re.findall(r"[a-z0-9]{2,}", plain) if w not in GENERIC and not w.isdigit()})


def signature_count() -> int:
    return len(FORMS) * len(NAMES) + len(WRITTEN)


def _rule(label: str, priority: int, confidence: float, gates: list[str], pattern: str) -> Column:
    return F.struct(
        F.lit(label).alias("label"),
        F.lit(priority).alias("priority"),
        F.lit(confidence).alias("confidence"),
        F.array(*(F.lit(g) for g in gates)).alias("gates"),
        F.lit(pattern).alias("pattern"),
    )


def _window_hits(window: Column, first: Column) -> Column:
    """What the signatures find in one window, as structs in the order of the sweep."""
    names = F.array(*(_rule(label, 0, 0.0, _gates(name), name) for label, name in NAMES))
    forms = F.array(*(_rule("", p, c, ["-"], rf"(?:^| ){form}(?= |$)") for p, c, form in FORMS))
    others = F.array(*(_rule(label, p, c, [gate], rf"(?:^| ){pattern}(?= |$)") for label, p, c, gate, pattern in WRITTEN))

    def open_rules(rules: Column) -> Column:
        return F.filter(rules, lambda r: F.exists(r["gates"], lambda g: F.contains(window, g)))

    def formed(name: Column) -> Column:
        return F.transform(
            forms,
            lambda f: F.struct(
                name["label"].alias("label"),
                f["priority"].alias("priority"),
                f["confidence"].alias("confidence"),
                f["gates"].alias("gates"),
                F.replace(f["pattern"], F.lit("{}"), F.concat(F.lit("(?:"), name["pattern"], F.lit(")"))).alias("pattern"),
            ),
        )

    def hits(rule: Column) -> Column:
        """Every match of the rule in the window, as intervals of words."""
        texts = F.regexp_extract_all(window, rule["pattern"], F.lit(0))

        def interval(parts: Column, text: Column, k: Column) -> Column:
            # What stands before a match: the parts between matches, and the matches before it.
            before = F.concat(F.array_join(F.slice(parts, 1, k + 1), ""), F.array_join(F.slice(texts, 1, k), ""))
            lead = F.when(text.startswith(" "), " ").otherwise("")
            start = first + F.size(F.split(F.concat(before, lead), " ")) - 1
            return F.struct(
                start.cast("long").alias("start"),
                (-(start + F.size(F.split(F.trim(text), " ")))).cast("long").alias("minus_end"),
                (-rule["priority"]).alias("minus_priority"),
                rule["label"].alias("label"),
                rule["confidence"].alias("confidence"),
            )

        def located(found: Column) -> Column:
            return let(F.split(window, rule["pattern"], -1), lambda parts: F.transform(found, lambda t, k: interval(parts, t, k)))

        kind = "array<struct<start:bigint,minus_end:bigint,minus_priority:int,label:string,confidence:double>>"
        return let(texts, lambda found: F.when(F.size(found) > 0, located(found)).otherwise(F.array().cast(kind)))

    rules = F.concat(F.flatten(F.transform(open_rules(names), formed)), open_rules(others))
    return F.flatten(F.transform(rules, hits))


def _sweep(hits: Column) -> Column:
    """Drops hits inside a hit of equal or higher priority; gathers labels and the best confidence.

    Hits come by start, longest first, so a hit is inside an earlier one just
    if that one ends no sooner: one running end for each priority is enough.
    """
    top = max(p for p, *_ in FORMS)
    start = F.struct(
        F.array_repeat(F.lit(-1).cast("long"), top + 1).alias("ends"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0.0).alias("confidence"),
    )

    def step(acc: Column, x: Column) -> Column:
        end, priority = -x["minus_end"], -x["minus_priority"]
        fresh = F.get(acc["ends"], priority) < end
        return F.struct(
            F.transform(acc["ends"], lambda v, k: F.when(k <= priority, F.greatest(v, end)).otherwise(v)).alias("ends"),
            F.when(fresh, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(fresh, F.greatest(acc["confidence"], x["confidence"])).otherwise(acc["confidence"]).alias("confidence"),
        )

    return F.aggregate(F.sort_array(hits), start, step)


def _base_places(words: Column) -> Column:
    """(start, label) of every base phrase."""
    return F.flatten(
        F.transform(
            words,
            lambda w, i: F.when(
                w == "license",
                F.filter(
                    F.array(
                        *(
                            F.when(
                                _all(F.get(words, i - (len(p) - 1 - k)) == p[k] for k in range(len(p) - 1)),
                                F.struct((i - (len(p) - 1)).cast("long").alias("at"), F.lit(label).alias("label")),
                            )
                            for p, label in BASE
                        )
                    ),
                    lambda x: x.isNotNull(),
                ),
            ).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")),
        )
    )


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _scanned(words: Column) -> Column:
    """All that one gated text gives: words, base places, labels, confidence."""
    anchors = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(*ANCHORS), i)), lambda i: i.isNotNull()
    )
    hits = F.flatten(
        F.transform(
            anchors,
            lambda i: let(
                F.greatest(i - REACH, F.lit(0)),
                lambda first: let(
                    F.array_join(F.slice(words, first + 1, 2 * REACH + 1), " "), lambda window: _window_hits(window, first)
                ),
            ),
        )
    )
    return F.struct(
        F.size(words).cast("long").alias("n_words"), _base_places(words).alias("base"), _sweep(hits).alias("found")
    )


#: Columns that a scan sets.
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, base places and labels, the signatures' labels and a score to every row."""
    raw = text_or_empty(text)
    low = F.lower(raw)  # only to open the gate; the words are lowered A-Z alone
    gate = F.lit(False)
    for part in PREFILTER:
        gate = gate | F.contains(F.col("low"), F.lit(part))
    for phrase in PHRASES:  # its words may stand apart by anything that parts words
        first, *_ = parts = phrase.split()
        gate = gate | (F.contains(F.col("low"), F.lit(first)) & F.col("low").rlike(NOT_WORD_ANY_CASE.join(parts)))
    words = F.filter(F.split(F.translate("raw", UPPER, LOWER), NOT_WORD), lambda w: w != "")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT))
    out = docs.select(row.alias("row"), raw.alias("raw"), low.alias("low"))
    out = out.select("row", "raw", gate.alias("gate"))
    out = out.select("row", "raw", F.when(F.col("gate"), let(words, _scanned)).alias("scan"))
    base, found = F.col("scan.base"), F.col("scan.found")
    empty = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), empty)
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(found["labels"], empty)))
    n_words = F.size(F.filter(F.split("raw", NOT_WORD_ANY_CASE), lambda w: w != "")).cast("long")
    return out.select(
        "row.*",
        F.coalesce(F.col("scan.n_words"), n_words).alias("n_words"),
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["at"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(found["confidence"], F.lit(0.0)).alias("score"),
    )
