"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into pieces at line breaks and after ``. ; : ! ?`` with white space. Pieces are normalised (lower case, runs of other
characters than letters and digits, so comment leaders too, become one space; marks of list items go). A known sentence is a
piece, or a run of pieces that follow each other: a single line break or a ``;`` or ``:`` may lie inside it, a blank line or
an end of sentence may not. Names of holders inside a sentence count as the words that stand for them in the licence's text.
Of known sentences that begin alike, the longest that is there counts. A notice may stand in a sentence such as "This project is
licensed under ..., see ...", in simple markup, or be an expression of identifiers.

The sequence of identifiers in a text is then matched against ordered rules: a rule holds if its sentences occur in its order,
others between them or not. A rule takes the sentences that it matched from shorter rules which they contain (so a text with
the names clause isn't a licence without it too), and a notice with "or any later version" settles its licence's text.

Edge cases: null and empty texts have no sentences and no licences; repeated sentences are listed each time; licences are
listed in the order of the rules, each once; repeated rows are each scanned; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis.software": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache.licensed": "licensed under the apache license version 2 0",
    "apache.header": "licensed under the apache license version 2 0 the license",
    "apache.may": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at",
    "apache.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mit0.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc.disclaim": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd.advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd.asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache.copyright": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache.patent": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work where such license applies only to those patent claims licensable by such contributor that are necessarily infringed by their contribution s alone or by combination of their contribution s with the work to which such contribution s was submitted",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib.origin": "the origin of this software must not be misrepresented",
    "zlib.altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "bsl.grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "gpl2.text": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl2.texts": "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    "gpl3.text": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "agpl3.text": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl21.text": "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
    "lgpl3.text": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "gpl2.only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3.only": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "mpl2.copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2.copys": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl1.made": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl2.made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc0.waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this software",
    "cc0.work": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "wtfpl.changed": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "postgresql.grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "artistic2.terms": "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software",
    "gpl3.either": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.either": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl.free": "this library is free software",
    "mpl2.form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccbync4.licensed": "licensed under cc by nc 4 0",
    "ccby4.licensed": "licensed under cc by 4 0",
    "ccbysa4.licensed": "licensed under cc by sa 4 0",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "unlicense.public": "this is free and unencumbered software released into the public domain",
}
#: Licences and the sentences that they need, in order; longer rules before those that they contain.
RULES = (
    ("MIT", ("mit.released",)), ("MIT", ("mit.licensed",)), ("MIT", ("mit.grant", "mit.notice")), ("MIT-0", ("mit0.grant",)),
    ("ISC", ("isc.grant",)), ("0BSD", ("0bsd.grant",)),
    ("Apache-2.0", ("apache.licensed",)), ("Apache-2.0", ("apache.header", "apache.may")), ("Apache-2.0", ("apache.copyright", "apache.patent")),
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert", "bsd.names")), ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("GPL-3.0-only", ("gpl3.work",)), ("GPL-3.0-or-later", ("gpl.free", "gpl3.either")), ("GPL-2.0-or-later", ("gpl.free", "gpl2.either")),
    ("GPL-2.0-only", ("gpl.free", "gpl2.only")), ("GPL-3.0-only", ("gpl.free", "gpl3.only")), ("GPL-2.0-only", ("gpl2.text", "gpl2.texts")), ("GPL-3.0-only", ("gpl3.text",)),
    ("AGPL-3.0-or-later", ("gpl.free", "agpl3.either")), ("AGPL-3.0-only", ("agpl3.text",)),
    ("LGPL-2.1-only", ("lgpl21.text",)), ("LGPL-3.0-only", ("lgpl3.text",)),
    ("MPL-2.0", ("mpl2.form",)), ("MPL-2.0", ("mpl2.copy",)), ("MPL-2.0", ("mpl2.copys",)), ("EPL-1.0", ("epl1.made",)), ("EPL-2.0", ("epl2.made",)),
    ("Zlib", ("zlib.grant", "zlib.origin", "zlib.altered")), ("BSL-1.0", ("bsl.grant",)), ("CC0-1.0", ("cc0.waived",)), ("CC0-1.0", ("cc0.work",)),
    ("WTFPL", ("wtfpl.changed",)), ("PostgreSQL", ("postgresql.grant",)), ("Artistic-2.0", ("artistic2.terms",)),
    ("CC-BY-NC-4.0", ("ccbync4.licensed",)), ("CC-BY-4.0", ("ccby4.licensed",)), ("CC-BY-4.0", ("ccby4.work",)),
    ("CC-BY-SA-4.0", ("ccbysa4.licensed",)), ("CC-BY-SA-4.0", ("ccbysa4.work",)),
    ("Unlicense", ("unlicense.public",)),
)
#: How short notices call licences.
CALLED = {
    "MIT": ("the mit license", "an mit license", "mit"), "Apache-2.0": ("the apache license 2 0", "the apache license version 2 0", "apache 2 0"), "BSD-2-Clause": ("the bsd 2 clause license", "the 2 clause bsd license"),
    "BSD-3-Clause": ("the bsd 3 clause license", "the 3 clause bsd license"), "ISC": ("the isc license",), "MPL-2.0": ("the mozilla public license 2 0", "the mozilla public license version 2 0"),
    "GPL-2.0-only": ("the gnu general public license version 2", "the gnu gpl v2"), "GPL-3.0-only": ("the gnu general public license version 3", "the gnu gpl v3"), "BSL-1.0": ("the boost software license version 1 0",),
    "AGPL-3.0-only": ("the gnu affero general public license version 3",), "Zlib": ("the zlib license",), "Unlicense": ("the unlicense",), "CC0-1.0": ("cc0 1 0",),
}
#: Parts of the names of the Creative Commons licences.
COMMONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
#: The words of a sentence before and after a holder's name, and what stands for the name in SENTENCES.
HOLDERS = (("neither the name of", "the copyright holder", "nor the names of its contributors may"), ("to the extent possible under law", "the author", "has waived all copyright"), ("this software is provided by", "the copyright holders and contributors", "as is and any express"))
#: What a notice calls the thing that it licenses, and how it says so.
NOUNS = ("project", "software", "code", "source code", "library", "package", "file", "program", "module", "repository", "script", "plugin", "tool")
VERBS = ("licensed", "released", "distributed")
#: Each known sentence holds one of these inside a word, so that a text without any has none of them.
ANCHORS = ("licens", "software", "copyright", "distribut", "warrant", "gpl", "cc0", "apache", "misrepresent")
_JOINT = "||"


def _more() -> tuple[dict[str, str], tuple]:
    """Sentences and rules that follow from names: versions of the library licences, short notices, identifiers in file headers."""
    known, rules = {}, []

    def add(name: str, ident: str, sentence: str, before: tuple[str, ...] = ()) -> None:
        if sentence not in SENTENCES.values() and sentence not in known.values():
            known[ident] = sentence
            rules.append((name, (*before, ident)))

    for version, kind, of in (("2.0", "library", "LGPL"), ("2.1", "lesser", "LGPL"), ("3.0", "lesser", "LGPL"), ("3.0", "affero", "AGPL")):
        ident, said = f"{of.lower()}{version[0]}{version[2:].strip('0')}.either", version.removesuffix(".0").replace(".", " ")
        known[ident] = f"you can redistribute it and or modify it under the terms of the gnu {kind} general public license as published by the free software foundation either version {said} of the license or at your option any later version"
        rules += [(f"{of}-{version}-or-later", (free, ident)) for free in (("lgpl.free", "gpl.free") if of == "LGPL" else ())]
    for verb in VERBS:
        for name, calls in CALLED.items():
            for k, call in enumerate(dict.fromkeys((*calls, *(c.removeprefix("the ") for c in calls)))):
                if any(a in f"{verb} {call}" for a in ANCHORS):
                    add(name, f"{name.lower()}.{verb}{k}", f"{verb} under {call}")
    for short, long in COMMONS.items():
        for version, ported in (("4.0", "international"), ("3.0", "unported")):
            name, said = f"CC-{short}-{version}", version.replace(".", " ")
            add(name, f"{name.lower()}.licensed", f"licensed under cc {short.lower().replace('-', ' ')} {said}")
            for k, the in enumerate(("a", "the")):
                add(name, f"{name.lower()}.work{k}", f"this work is licensed under {the} creative commons {long} {said} {ported} license")
    for name in dict.fromkeys([n for n, _ in RULES] + [n for n, _ in rules]):
        add(name, f"{name.lower()}.spdx", "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()))
    return known, tuple(rules)


MORE, MORE_RULES = _more()
ALL, ALL_RULES = SENTENCES | MORE, RULES + MORE_RULES
assert all(any(a in word for a in ANCHORS for word in s.split()) for s in ALL.values())


def _steps(gap: str) -> list[tuple[str, str]]:
    """The replacements that give the normalised pieces; ``gap`` is the pattern of what may lie between two words."""
    white = r"[\x09-\x0D\x20]"
    steps = [
        (r"</?(?:p|div|li|ul|td|tr|h[1-6]|br|footer)(?:[\x09\x20][^<>\n]{0,200})?/?>", "\n\n"), (r"</?(?:a|b|i|em|strong|span|small|code)(?:[\x09\x20][^<>\n]{0,200})?>", ""),
        *[(r"(spdx-license-identifier:\x20?)([^\n]*?)[\x20)]+(?:or|and)[\x20(]+", "$1$2\n\n$1")] * 3,
        (rf"\bv\.{white}+", "v "), (rf"([.!?]){white}+", "$1\n\n"), (r"[\x09\x0B-\x0D\x20]+\n", "\n"), (r"([;:])[\x09\x0B-\x0D\x20]+", "$1\n"),
        (r"(?m)^[\x09\x20]*(?:rem|dnl)[\x09\x20]+", ""), (r"(?m)^[^\p{L}\p{N}\n(]*\(?(?:[0-9]{1,2}|[a-z])\)[\x09\x20]+", ""), (r"[^\p{L}\p{N}\n]+", " "), (r" ?\n ?", "\n"),
        (rf"(?m)^(?:this|the|our){gap}(?:{'|'.join(x.replace(' ', gap) for x in NOUNS)}){gap}(?:is|are){gap}(?:(?:also|hereby|currently){gap})?({'|'.join(VERBS)}){gap}under", "$1 under"),
        (rf"(?m)^((?:{'|'.join(VERBS)}){gap}under(?:{gap}[^ \n]+){{1,8}}?){gap}(?:see|refer{gap}to|as{gap}found{gap}in)(?:{gap}[^ \n]+){{0,12}}? ?$", "$1"),
    ]
    return steps + [(gap.join(a.split()) + gap + r"(?:[^ \n]+" + gap + "){1,12}?" + gap.join(b.split()), f"{a} {holder} {b}") for a, holder, b in HOLDERS]


def _contained(name: str, need: tuple[str, ...], rules: tuple) -> list[tuple[str, ...]]:
    """The longer rules of other licences that hold the sentences of a rule in its order; the longest first."""
    def holds(more: tuple[str, ...]) -> bool:
        left = iter(more)
        return all(x in left for x in need)

    return sorted((more for other, more in rules if other != name and len(more) > len(need) and holds(more)), key=lambda m: -len(m))


def _taken(need: tuple[str, ...]) -> tuple[str, str]:
    """Pattern and replacement that take a rule's sentences from a sequence and leave those between them."""
    return "(.*?)".join(rf"\|{re.escape(x)}\|" for x in need), "".join(f"${k}" for k in range(1, len(need)))


def pieces(text: Column) -> Column:
    """The normalised pieces, each between line feeds; a blank line or an end of sentence leaves two."""
    out = F.lower(text)
    for pattern, to in _steps(r"[ \n]"):
        out = F.regexp_replace(out, pattern, to)
    return F.concat(F.lit("\n"), F.trim(out), F.lit("\n"))


def _either(known: dict[str, str], gap: str) -> str:
    """The known sentences as one pattern; the longer of two that begin alike comes first, so a sentence that is wrapped where the shorter ends is still itself."""
    return "|".join(s.replace(" ", gap) for s in sorted(known.values(), key=lambda s: (-len(s), s)))


def identify(text: Column, known: dict[str, str]) -> Column:
    """Array of identifiers of the known sentences in a text, in order."""
    lookup = F.create_map(*[F.lit(x) for ident, s in known.items() for x in (s, ident)])
    found = F.regexp_extract_all(pieces(text), F.lit(rf"(?<=\n)({_either(known, '[ \\n]')})(?=\n)"), 1)
    low = F.lower(text)
    likely = F.lit(False)
    for a in ANCHORS:
        likely = likely | F.contains(low, F.lit(a))
    return F.when(F.coalesce(likely, F.lit(False)), F.transform(found, lambda s: lookup[F.translate(s, "\n", " ")])).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: tuple = ALL_RULES) -> DataFrame:
    """One row per document: (id, n_known, sentence_ids joined by spaces, licenses joined by spaces). No shuffle, no Python on the rows."""
    ids = identify(F.col(text_col).cast("string"), known or ALL)
    found = docs.select(F.col(id_col).alias("id"), ids.alias("ids")).withColumn("seq", F.concat(F.lit("|"), F.array_join("ids", _JOINT), F.lit("|")))
    held: dict[str, Column] = {name: F.lit(False) for name, _ in rules}
    for name, need in rules:
        seq = F.col("seq")
        for more in _contained(name, need, rules):
            seq = F.regexp_replace(seq, *_taken(more))
        held[name] = held[name] | seq.like("%|" + "|%|".join(need) + "|%")
    for name in held:
        later = name.removesuffix("-only") + "-or-later"
        if later in held and name.endswith("-only"):
            held[name] = held[name] & ~held[later]
    licenses = F.when(F.size("ids") > 0, F.array_join(F.array(*[F.when(c, F.lit(n)) for n, c in held.items()]), " ")).otherwise("")
    return found.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("sentence_ids"), licenses.alias("licenses"))


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


def oracle(id_col: str = "doc_id", text_col: str = "text", table: str = "documents") -> str:
    """The same in DuckDB's SQL, whose patterns can't look around: line feeds are doubled before the sentences are looked for."""
    text = f"lower(coalesce({text_col}, ''))"
    for pattern, to in _steps(r"[ \n]"):
        said = to.replace("$", chr(92)).replace("\n", "' || chr(10) || '")
        text = f"regexp_replace({text}, '{_duck(pattern)}', '{said}', 'g')"
    names, values = [f"'{s}'" for s in ALL.values()], [f"'{i}'" for i in ALL]
    held: dict[str, list[str]] = {}
    for name, need in ALL_RULES:
        seq = "seq"
        for more in _contained(name, need, ALL_RULES):
            pattern, to = _taken(more)
            seq = f"regexp_replace({seq}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        held.setdefault(name, []).append(f"{seq} LIKE '%|{'|%|'.join(need)}|%'")
    tests = {n: "(" + " OR ".join(c) + ")" for n, c in held.items()}
    for n in tests:
        later = n.removesuffix("-only") + "-or-later"
        if n.endswith("-only") and later in tests:
            tests[n] += f" AND NOT {tests[later]}"
    cases = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in tests.items())
    return f"""
WITH cut AS (SELECT {id_col}, chr(10) || replace(trim({text}), chr(10), chr(10) || chr(10)) || chr(10) AS parts FROM {table}),
likely AS (SELECT *, {" OR ".join(f"contains(parts, '{a}')" for a in ANCHORS)} AS maybe FROM cut),
found AS (SELECT {id_col}, CASE WHEN maybe THEN regexp_extract_all(parts, '\n({_either(ALL, "(?: |" + chr(92) + "n" + chr(92) + "n)")})\n', 1) ELSE [] END AS said FROM likely),
named AS (SELECT {id_col}, list_transform(said, lambda s: list_extract([{", ".join(values)}], list_position([{", ".join(names)}], replace(s, chr(10) || chr(10), ' ')))) AS ids FROM found),
seqs AS (SELECT {id_col}, ids, '|' || coalesce(array_to_string(ids, '{_JOINT}'), '') || '|' AS seq FROM named)
SELECT {id_col}, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
       CASE WHEN len(ids) > 0 THEN coalesce(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ' '), '') ELSE '' END AS licenses FROM seqs
"""
