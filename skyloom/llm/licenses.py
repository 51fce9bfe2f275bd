"""License detection in the words of texts: ordered signature rules, as SQL expressions only.

A text becomes a line of words with one blank around each. A rule is a sequence of patterns, one per word, so that a match
has a known number of words and its place is counted in words. Rules are tried only in texts that hold their keywords.
Of overlapping matches, one that lies within a match of the same or a higher priority is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases of the base, with their labels and the keyword that a text with them must hold.
BASE = [
    ("under the mit license", "mit", "license"),
    ("apache license version 2", "apache-2", "license"),
    ("cc by nc", "cc-by-nc", "cc"),
]

# Names of licenses: label, keyword, and the ways to write the name, one pattern per word.
NAMES = [
    ("mit", "mit", ["mit", "expat", "mit x11"]),
    ("mit-0", "mit", ["mit 0", "mit no attribution"]),
    ("apache-1", "apache", ["apache 1", "apache 1 [01]", "apache software 1 1"]),
    ("apache-2", "apache", ["apache", "apache 2", "apache v2", "apache 2 0", "apache v2 0", "apache software"]),
    ("bsd-2", "bsd", ["bsd 2", "bsd 2 clause", "(?:2|two) clause bsd", "simplified bsd", "freebsd"]),
    ("bsd-3", "bsd", ["bsd 3", "bsd 3 clause", "(?:3|three) clause bsd", "(?:new|modified|revised) bsd"]),
    ("bsd-4", "bsd", ["bsd 4 clause", "(?:4|four) clause bsd", "(?:original|old) bsd"]),
    ("bsd", "bsd", ["bsd", "bsd style", "berkeley software distribution"]),
    ("isc", "isc", ["isc", "internet systems consortium"]),
    ("gpl-2", "gpl", ["gpl 2", "gpl v2", "gplv2", "gpl version 2", "gpl 2 0"]),
    ("gpl-3", "gpl", ["gpl 3", "gpl v3", "gplv3", "gpl version 3", "gpl 3 0"]),
    ("gpl", "gpl", ["gpl", "gnu gpl"]),
    ("gpl", "general public", ["gnu general public", "general public"]),
    ("lgpl-2", "lgpl", ["lgpl 2", "lgpl v2", "lgplv2", "lgpl 2 [01]"]),
    ("lgpl-3", "lgpl", ["lgpl 3", "lgpl v3", "lgplv3", "lgpl 3 0"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"]),
    ("lgpl", "lesser", ["gnu lesser general public", "lesser general public"]),
    ("agpl-3", "agpl", ["agpl 3", "agpl v3", "agplv3", "agpl 3 0"]),
    ("agpl", "affero", ["gnu affero general public", "affero general public", "affero gpl"]),
    ("gfdl", "documentation", ["gnu free documentation", "free documentation"]),
    ("mpl-1", "mozilla", ["mozilla public 1 [01]", "mozilla 1 [01]"]),
    ("mpl-2", "mozilla", ["mozilla public 2 0", "mozilla 2 0"]),
    ("mpl", "mozilla", ["mozilla public", "mozilla"]),
    ("mpl", "mpl", ["mpl 1 [01]", "mpl 2 0", "mpl v2"]),
    ("epl", "eclipse", ["eclipse public", "eclipse public 1 0", "eclipse public 2 0", "eclipse distribution"]),
    ("cddl", "cddl", ["cddl", "cddl 1 [01]"]),
    ("cddl", "common development", ["common development and distribution"]),
    ("cpl", "common public", ["common public", "ibm public"]),
    ("eupl", "european", ["european union public"]),
    ("eupl", "eupl", ["eupl", "eupl 1 [12]"]),
    ("artistic", "artistic", ["artistic", "artistic 1 0", "artistic 2 0", "perl artistic", "clarified artistic"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"]),
    ("unlicense", "unlicense", ["unlicense", "the unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl", "do what the fuck you want to public"]),
    ("boost", "boost", ["boost software", "boost software 1 0", "boost"]),
    ("python", "python", ["python software foundation", "psf", "python 2 0"]),
    ("php", "php", ["php", "php 3 0[01]"]),
    ("ruby", "ruby", ["ruby"]),
    ("openssl", "openssl", ["openssl", "openssl ssleay"]),
    ("ofl", "open font", ["open font", "sil open font", "sil open font 1 1"]),
    ("odbl", "open database", ["open database", "open data commons open database"]),
    ("odc-by", "open data", ["open data commons attribution"]),
    ("cc0", "cc0", ["cc0", "cc0 1 0", "creative commons zero"]),
    ("cc-by", "cc", ["cc by", "cc by 4 0", "cc by 3 0"]),
    ("cc-by-sa", "cc", ["cc by sa", "cc by sa 4 0", "cc by sa 3 0"]),
    ("cc-by-nd", "cc", ["cc by nd", "cc by nd 4 0"]),
    ("cc-by-nc", "cc", ["cc by nc", "cc by nc 4 0", "cc by nc 3 0"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa", "cc by nc sa 4 0"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd", "cc by nc nd 4 0"]),
    ("cc-by", "creative", ["creative commons attribution", "creative commons attribution 4 0", "creative commons by"]),
    ("cc-by-sa", "creative", ["creative commons attribution share ?alike", "creative commons attribution share alike"]),
    ("cc-by-nc", "creative", ["creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    ("cc", "creative", ["creative commons", "creative commons public"]),
    ("public-domain", "public", ["public domain"]),
    ("proprietary", "proprietary", ["proprietary", "commercial proprietary"]),
    ("ms-pl", "microsoft", ["microsoft public", "microsoft reciprocal"]),
    ("ncsa", "ncsa", ["ncsa", "university of illinois ncsa open source"]),
    ("postgresql", "postgresql", ["postgresql"]),
    ("w3c", "w3c", ["w3c", "w3c software"]),
    ("elastic", "elastic", ["elastic", "elastic 2 0"]),
    ("sspl", "server side", ["server side public"]),
    ("busl", "business source", ["business source", "business source 1 1"]),
    ("openrail", "openrail", ["openrail", "openrail m", "bigscience openrail m", "creativeml openrail m"]),
    ("llama", "llama", ["llama [23] community", "llama 2"]),
]

# What stands around a name: priority, score, keyword, and the words, {} for the name.
FORMS = [
    (5, 1.0, "identifier", "spdx license identifier {}"),
    (4, 0.95, "under", "(?:licensed|released|distributed|published|available|provided) under (?:the|an|a) {} licen[sc]es?"),
    (4, 0.95, "under", "(?:licensed|released|distributed|published|available|provided) under {} licen[sc]es?"),
    (3, 0.9, "under", "(?:licensed|released|distributed|published|available|provided) under (?:the|an|a) {}"),
    (3, 0.9, "under", "(?:licensed|released|distributed|published|available|provided) under {}"),
    (3, 0.8, "terms", "terms of the {} licen[sc]es?"),
    (2, 0.7, "licen", "{} licen[sc]es?"),
]

# Wordings of license texts and notices: label, priority, score, keyword (all of its words must be there), and the sentences,
# one pattern per word. Those of one license come first, then those of families, then clauses that many licenses share.
WORDINGS = [
    ("mit", 7, 1.0, "permission granted", [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ]),
    ("mit", 7, 1.0, "permit furnished", ["to permit persons to whom the software is furnished to do so subject to the following conditions"]),
    ("mit", 7, 1.0, "sublicense", [
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ]),
    ("mit", 7, 0.95, "copyright notice", [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice shall be included in all copies",
    ]),
    ("isc", 7, 1.0, "permission granted", [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ]),
    ("0bsd", 7, 0.9, "permission granted", [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ]),
    ("isc", 6, 0.8, "author disclaims", [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ]),
    ("postgresql", 7, 1.0, "permission granted", [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    ]),
    ("hpnd", 7, 0.9, "permission granted", [
        "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted",
        "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee",
    ]),
    ("ncsa", 7, 0.9, "sublicense", [
        "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ]),
    ("ofl", 7, 1.0, "permission granted", [
        "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software",
    ]),
    ("boost", 7, 1.0, "permission granted", [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ]),
    ("zlib", 7, 1.0, "permission granted", [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ]),
    ("zlib", 6, 0.9, "origin misrepresented", [
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    ]),
    ("gfdl", 7, 1.0, "permission granted", [
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
    ]),
    ("bsd", 6, 0.9, "redistribut condition", [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ]),
    ("bsd-3", 7, 1.0, "endorse promote", [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ]),
    ("bsd-4", 7, 1.0, "advertising acknowledg", [
        "all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
    ]),
    ("bsd-3-clear", 7, 1.0, "patent granted", [
        "no express or implied licenses to any party s patent rights are granted by this license",
    ]),
    ("apache-1", 7, 1.0, "developed apache", [
        "this product includes software developed by the apache software foundation",
        "this product includes software developed by the apache group for use in the apache http server project",
    ]),
    ("apache-2", 7, 1.0, "apache licen", [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at https? www apache org licenses license 2 0",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "the asf licenses this file to you under the apache license version 2 0",
    ]),
    ("apache-2", 6, 0.85, "under the license", [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    ]),
    ("gpl-1", 7, 1.0, "gnu general", [
        "under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version",
    ]),
    ("gpl-2", 7, 1.0, "gnu general", [
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "under the terms of the gnu general public license version 2 as published by the free software foundation",
        "under the terms of version 2 of the gnu general public license as published by the free software foundation",
        "gnu general public license version 2 june 1991",
        "(?:licensed|released|distributed) under the gnu general public license version 2",
        "gnu general public license version 2 only",
    ]),
    ("gpl-3", 7, 1.0, "gnu general", [
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "under the terms of the gnu general public license version 3 as published by the free software foundation",
        "under the terms of version 3 of the gnu general public license as published by the free software foundation",
        "gnu general public license version 3 29 june 2007",
        "(?:licensed|released|distributed) under the gnu general public license version 3",
        "gnu general public license version 3 only",
    ]),
    ("gpl", 6, 0.9, "gnu general", [
        "you should have received a copy of the gnu general public license along with this (?:program|file|package|library)",
        "see the gnu general public license for more details",
        "the gnu general public license is a free copyleft license for software and other kinds of works",
        "the gnu general public license does not permit incorporating your (?:program|work) into proprietary programs",
    ]),
    ("lgpl-2", 7, 1.0, "gnu general", [
        "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "gnu lesser general public license version 2 1 february 1999",
        "gnu library general public license version 2 june 1991",
    ]),
    ("lgpl-3", 7, 1.0, "gnu general", [
        "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu lesser general public license version 3 29 june 2007",
    ]),
    ("lgpl", 6, 0.9, "gnu general", [
        "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|file|package|library)",
        "see the gnu (?:lesser|library) general public license for more details",
    ]),
    ("agpl-3", 7, 1.0, "affero general", [
        "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu affero general public license version 3 19 november 2007",
    ]),
    ("agpl", 6, 0.9, "affero general", [
        "you should have received a copy of the gnu affero general public license along with this program",
        "see the gnu affero general public license for more details",
    ]),
    ("mpl-1", 7, 1.0, "mozilla licen", [
        "the contents of this file are subject to the mozilla public license version 1 [01]",
    ]),
    ("mpl-2", 7, 1.0, "source form", [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ]),
    ("mpl-2", 7, 1.0, "mozilla org", [
        "if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0",
    ]),
    ("mpl-2", 6, 0.8, "source form", [
        "this source code form is incompatible with secondary licenses",
    ]),
    ("epl", 7, 1.0, "eclipse licen", [
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "the accompanying program is provided under the terms of this eclipse public license agreement",
    ]),
    ("cddl", 7, 1.0, "development distribution", [
        "the contents of this file are subject to the terms of the common development and distribution license",
        "you may not use this file except in compliance with the common development and distribution license",
    ]),
    ("cpl", 7, 1.0, "accompanying program", [
        "the accompanying program is provided under the terms of this common public license agreement",
    ]),
    ("eupl", 7, 1.0, "eupl licen", [
        "licensed under the eupl version 1 [12] or as soon they will be approved by the european commission subsequent versions of the eupl",
    ]),
    ("artistic", 7, 1.0, "package artistic", [
        "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control",
    ]),
    ("artistic", 6, 0.9, "redistribute modify terms", [
        "this library is free software you can redistribute it and or modify it under the same terms as perl itself",
        "you can redistribute it and or modify it under the terms of the artistic license",
    ]),
    ("unlicense", 7, 1.0, "released domain", [
        "this is free and unencumbered software released into the public domain",
    ]),
    ("unlicense", 6, 0.9, "anyone compile", [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
    ]),
    ("wtfpl", 7, 1.0, "what you want", [
        "you just do what the fuck you want to",
    ]),
    ("beerware", 7, 1.0, "stuff", [
        "as long as you retain this notice you can do whatever you want with this stuff",
        "if we meet some day and you think this stuff is worth it you can buy me a beer in return",
    ]),
    ("json", 7, 1.0, "evil", ["the software shall be used for good not evil"]),
    ("cc0", 7, 1.0, "waive", [
        "to the extent possible under law the (?:person|author) who associated cc0 with this work has waived all copyright",
        "has waived all copyright and related or neighboring rights to this work",
        "overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright",
    ]),
    ("cc-by", 7, 1.0, "creative commons", [
        "this (?:work|article|content|document) is licensed under a creative commons attribution 4 0 international license",
        "this (?:work|article|content|document) is licensed under a creative commons attribution 3 0 unported license",
        "this is an open access article distributed under the terms of the creative commons attribution license",
        "text is available under the creative commons attribution license",
    ]),
    ("cc-by-sa", 7, 1.0, "creative commons", [
        "this (?:work|article|content|document) is licensed under a creative commons attribution sharealike 4 0 international license",
        "this (?:work|article|content|document) is licensed under a creative commons attribution sharealike 3 0 unported license",
        "text is available under the creative commons attribution sharealike license",
    ]),
    ("cc-by-nc", 7, 1.0, "creative commons", [
        "this (?:work|article|content|document) is licensed under a creative commons attribution noncommercial 4 0 international license",
        "distributed under the terms of the creative commons attribution noncommercial license",
    ]),
    ("cc-by-nc-sa", 7, 1.0, "creative commons", [
        "this (?:work|article|content|document) is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    ]),
    ("cc-by-nc-nd", 7, 1.0, "creative commons", [
        "this (?:work|article|content|document) is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    ]),
    ("cc-by-nd", 7, 1.0, "creative commons", [
        "this (?:work|article|content|document) is licensed under a creative commons attribution noderivatives 4 0 international license",
    ]),
    ("odbl", 7, 1.0, "open database", ["is made available under the open database license"]),
    ("odbl", 6, 0.9, "database contents", ["any rights in individual contents of the database are licensed under the database contents license"]),
    ("pddl", 7, 1.0, "domain dedication", ["is made available under the public domain dedication and license"]),
    ("python", 7, 1.0, "licensee psf", [
        "this license agreement is between the python software foundation psf and the individual or organization licensee",
        "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly",
    ]),
    ("openssl", 7, 1.0, "openssl toolkit", [
        "this product includes software developed by the openssl project for use in the openssl toolkit",
    ]),
    ("openssl", 7, 1.0, "cryptographic eric", [
        "this product includes cryptographic software written by eric young",
    ]),
    ("php", 7, 1.0, "php", ["this source file is subject to version 3 0[01] of the php license", "this product includes php software freely available from"]),
    ("ruby", 7, 1.0, "ruby copyrighted", ["ruby is copyrighted free software by yukihiro matsumoto"]),
    ("sspl", 7, 1.0, "server side", ["under the terms of the server side public license version 1 as published by mongodb inc"]),
    ("busl", 7, 1.0, "business source", ["use of this software is governed by the business source license", "the business source license this document or the license is not an open source license"]),
    ("elastic", 6, 0.9, "hosted managed", ["you may not provide the software to third parties as a hosted or managed service"]),
    ("elastic", 7, 1.0, "elastic licen", [
        "licensed under the elastic license 2 0 you may not use this file except in compliance with the elastic license 2 0",
    ]),
    ("ms-pl", 7, 1.0, "governs accompanying", ["this license governs use of the accompanying software if you use the software you accept this license"]),
    ("public-domain", 6, 0.9, "domain", [
        "this (?:work|file|code|software|document|text) is in the public domain",
        "this (?:work|file|code|software|document|text) has been released into the public domain",
        "place this (?:work|file|code|software) (?:into|in) the public domain",
    ]),
    ("proprietary", 6, 0.9, "reserved", ["all rights reserved unauthorized copying of this file via any medium is strictly prohibited"]),
    ("proprietary", 6, 0.9, "confidential", [
        "this (?:software|file|document) contains confidential and proprietary information",
        "proprietary and confidential",
        "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",
    ]),
    ("as-is", 1, 0.5, "warrant", [
        "the software is provided as is without warranty of any kind express or implied",
        "this software is provided as is without any express or implied warranty",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
        "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ]),
    ("as-is", 1, 0.5, "liable damages", [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        "in no event will the authors be held liable for any damages arising from the use of this software",
    ]),
]


@dataclass(frozen=True)
class Rule:
    id: int
    label: str
    priority: int
    score: float
    base: bool
    keywords: tuple[str, str]
    pattern: str

    @property
    def words(self) -> int:
        return self.pattern.count(" ") + 1


def rules() -> list[Rule]:
    """The base's phrases first, then every name in every form, then the wordings of license texts, in a fixed order."""
    out = [(label, 4, 0.9, True, (keyword, keyword), phrase) for phrase, label, keyword in BASE]
    out += [
        (label, priority, score, False, (keyword, other), form.format(name))
        for label, keyword, names in NAMES for name in names for priority, score, other, form in FORMS
    ]
    out += [(label, priority, score, False, (keyword, keyword), text) for label, priority, score, keyword, texts in WORDINGS for text in texts]
    return [Rule(i, *r) for i, r in enumerate(out)]


def matches(line: Column, found: Column, table: Column) -> Column:
    """All matches in a line of words of the rules whose keywords were found: array of (id, start, end, ...)."""

    def places(rule: Column) -> Column:
        # the blank before each match gets a mark, which no word can hold
        marked = F.split(F.regexp_replace(line, F.concat(F.lit("(?i) (?="), rule["pattern"], F.lit(" )")), F.lit(" \u0001")), " ")
        at = F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")), i - 1))
        return F.transform(F.array_compact(at), lambda start: F.struct(
            rule["id"].alias("id"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["score"].alias("score"),
            rule["base"].alias("base"), start.cast("long").alias("start"), (start + rule["words"]).cast("long").alias("end"),
        ))

    gated = F.filter(table, lambda r: F.array_contains(found, r["first"]) & F.array_contains(found, r["second"]))
    tried = F.filter(gated, lambda r: F.regexp_like(line, F.concat(F.lit("(?i) "), r["pattern"], F.lit(" "))))
    return F.flatten(F.transform(tried, places))


def detections(docs: DataFrame, signatures: list[Rule]) -> DataFrame:
    """(doc_id, row, n_words, id, label, priority, score, base, start, end, kept): every match of every row of ``docs``,
    a row with nulls where a text has none. ``kept`` is false for suppressed matches."""
    keywords = sorted({k for r in signatures for k in r.keywords})
    # one SQL text: hundreds of separate literals take a call each
    table = F.expr("array({})".format(", ".join(
        f"named_struct('id', {r.id}, 'label', '{r.label}', 'priority', {r.priority}, 'score', {r.score}D, 'base', {str(r.base).lower()}, "
        f"'first', '{r.keywords[0]}', 'second', '{r.keywords[1]}', 'pattern', '{r.pattern}', 'words', {r.words})"
        for r in signatures
    )))
    # keywords of two words are met when both are there, whatever stands between them
    low = F.col("low")
    there = [F.when(F.forall(F.array(*map(F.lit, k.split())), lambda w: F.contains(low, w)) if " " in k else F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]
    rows = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"),
        F.lower(F.coalesce("text", F.lit(""))).alias("low"),
    ).select("doc_id", "row", "text", F.array_compact(F.array(*there)).alias("found"))
    line = F.regexp_replace(F.concat(F.lit(" "), "text", F.lit(" ")), NOT_WORD, " ")
    all_matches = F.flatten(F.transform(F.array(line), lambda x: matches(x, F.col("found"), table)))
    out = rows.select(
        "doc_id", "row", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.explode_outer(F.when(F.size("found") > 0, all_matches)).alias("match"),
    ).select("doc_id", "row", "n_words", "match.*")
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "id").rowsBetween(Window.unboundedPreceding, -1)
    within = F.lit(False)
    for p in sorted({r.priority for r in signatures}):
        within = within | ((F.col("priority") == p) & (F.coalesce(F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before), F.lit(-1)) >= F.col("end")))
    return out.withColumn("kept", ~within)


def licenses(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per document.

    Words are runs of digits, letters A-Z (as a-z) and characters above ASCII. ``n_base`` counts all places where a
    phrase of the base stands, ``first_word`` and ``last_word`` are the smallest and largest of their starts (null
    without any), ``base_labels`` the base's labels; suppression does not touch these. ``labels`` adds the labels of
    all other matches that are not suppressed; ``score`` is the highest of theirs, 0.9 for a phrase of the base, 0
    without labels. Labels are distinct, sorted and joined by commas; none is an empty string.

    Null and empty texts have no words. A null doc_id stays null; repeated rows give repeated rows, each with its own
    matches; an empty table gives none. Other columns are not read.
    """
    found = detections(docs, signatures or rules())
    base, kept = F.col("base"), F.col("kept") | F.col("base")
    label = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return found.groupBy("doc_id", "row").agg(
        F.first("n_words").alias("n_words"), F.count(F.when(base, F.lit(1))).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        label(base).alias("base_labels"), label(kept).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.col("score"))), F.lit(0.0)).alias("score"),
    ).drop("row")
