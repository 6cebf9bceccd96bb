"""License scans by sentence rules.

Known licence sentences carry identifiers. A text is cut into sentences, each is normalised (lower case,
letters and digits only) and mapped to the identifier of a known sentence, if it is one; what is left of
a text is a sequence of identifiers with their places. A licence rule is an ordered sequence of
identifiers; it holds where they occur in this order with at most ``GAP`` other sentences between
neighbours. A rule that another one of more sentences covers at the same places is not reported.

Line ends and marks are ambiguous: a wrapped sentence runs over line ends, a heading or notice line ends
with them, and some known sentences have a colon, semicolon or abbreviation inside. The text is therefore
cut at all of them, and every run of pieces whose words are those of a known sentence counts. Of several
runs from one piece the longest does, unless it only joins two that are known by themselves.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import table

GAP = 3

#: Names of public licences by identifier, as notices write them.
NAMES = {
    "MIT": ["MIT License", "MIT License (MIT)", "MIT Licence", "MIT", "Expat License", "MIT/Expat License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0"],
    "X11": ["X11 License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache Licence, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache Software License, Version 2.0", "Apache License v2.0", "ASL 2.0"],
    "Apache-1.1": ["Apache Software License, Version 1.1", "Apache License 1.1"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License", "FreeBSD License", "two-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "three-clause BSD license", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "ISC": ["ISC License", "ISC Licence"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPLv2", "Mozilla Public License Version 2.0"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0", "Eclipse Public License, Version 2.0", "EPL 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0", "Eclipse Public License, Version 1.0", "EPL 1.0"],
    "EUPL-1.2": ["European Union Public Licence, Version 1.2", "European Union Public Licence 1.2", "EUPL 1.2", "EUPL, Version 1.2"],
    "EUPL-1.1": ["European Union Public Licence, Version 1.1", "EUPL 1.1"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0", "CDDL 1.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost License 1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "WTFPL": ["WTFPL", "Do What The F*ck You Want To Public License"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "AFL-3.0": ["Academic Free License 3.0", "Academic Free License version 3.0"],
    "OSL-3.0": ["Open Software License 3.0", "Open Software License version 3.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License 1.1"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA Open Source License"],
    "PostgreSQL": ["PostgreSQL License", "PostgreSQL Licence"],
    "PSF-2.0": ["Python Software Foundation License Version 2", "PSF License"],
    "MS-PL": ["Microsoft Public License", "Ms-PL"],
    "UPL-1.0": ["Universal Permissive License v 1.0", "Universal Permissive License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal License"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License v1.0", "ODbL 1.0"],
    "BUSL-1.1": ["Business Source License 1.1", "Business Source License, Version 1.1"],
    "SSPL-1.0": ["Server Side Public License, version 1", "Server Side Public License v1"],
}
#: Identifiers that only lines with identifiers name.
MORE_IDS = "AFL-2.1 Artistic-1.0 BlueOak-1.0.0 Beerware curl ECL-2.0 Elastic-2.0 FTL GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later HPND IJG libpng-2.0 LPPL-1.3c OLDAP-2.8 OpenSSL PHP-3.01 Python-2.0 QPL-1.0 Ruby Sleepycat TCL Unicode-DFS-2016 Vim W3C ZPL-2.1".split()
#: The GNU licences and Creative Commons' parts, from which their names follow.
GNU = {"GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")), "AGPL": ("GNU Affero General Public License", ("3.0",))}
GNU_DATES = {"GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
LATER = ("or later", "or any later version", "or (at your option) any later version", "or later version", "and later")
EXCEPTIONS = ("Classpath-exception-2.0", "LLVM-exception", "GCC-exception-3.1", "Linux-syscall-note", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0")
#: How a notice begins.
SUBJECTS = ("", "this work is", "this project is", "this software is", "this program is", "this file is", "this code is", "this library is", "this package is", "this document is", "this source code is", "the code is", "the source code is", "all code is")
VERBS = ("licensed", "released", "distributed", "published", "available", "made available", "provided", "licenced", "dual licensed")
LINKS = ("under", "under the", "under a", "under the terms of the", "under the terms of", "under the terms and conditions of the", "under the conditions of the", "subject to the terms of the")

#: Sentences of public licences, by identifier. "{}" stands for up to eight words.
SENTENCES = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache2-use": ["you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at {}"],
    "apache2-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl-warranty": ["This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-endorse": ["Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl2-name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl2-made": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {}", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "epl1-made": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "wtfpl-copy": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "ofl-name": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}
#: Licence identifiers and their rules, each an ordered sequence of sentence identifiers. One of its name or identifier is a rule of every licence besides.
RULES = {
    "MIT": [["mit-grant", "mit-notice"], ["mit-grant", "mit-notice", "mit-warranty"]],
    "MIT-0": [["mit-0-grant", "mit-warranty"]],
    "Apache-2.0": [["apache2-use", "apache2-copy"], ["apache2-use", "apache2-copy", "apache2-warranty"], ["name:Apache-2.0", "apache2-use", "apache2-copy", "apache2-warranty"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]],
    "ISC": [["isc-grant"]],
    "0BSD": [["0bsd-grant"]],
    "MPL-2.0": [["mpl2-name"]],
    "EPL-2.0": [["epl2-made"]],
    "EPL-1.0": [["epl1-made"]],
    "Zlib": [["zlib-warranty", "zlib-grant"], ["zlib-warranty", "zlib-grant", "zlib-origin"]],
    "BSL-1.0": [["boost-grant"]],
    "WTFPL": [["wtfpl-copy"]],
    "OFL-1.1": [["ofl-name"]],
    "Unlicense": [["unlicense"]],
}


def _all_names() -> dict[str, list[str]]:
    """NAMES with those of the GNU and Creative Commons licences, which follow from their parts."""
    out = {k: list(v) for k, v in NAMES.items()}
    for short, (long, versions) in GNU.items():
        for v in versions:
            major = v.removesuffix(".0")
            stem = long.replace("GNU ", "")
            plain = [f"{name} {form}" for name in (long, stem, f"GNU {short}", short) for form in dict.fromkeys((f"version {major}", f"version {v}", f"v{major}", f"v{v}", f"v {major}", v, major))]
            plain += [f"{short}v{major}", f"GNU {short}v{major}", f"{short}v{v}"]
            plain += [f"{p} license" for p in plain if not p.startswith((long, stem))]
            out[f"{short}-{v}-only"] = [*plain, f"{short}-{v}", *(f"{p} only" for p in plain)]
            if date := GNU_DATES.get(f"{short}-{v}"):
                out[f"{short}-{v}-only"] += [f"{long} version {form}, {date}" for form in (v, major)]
            out[f"{short}-{v}-or-later"] = [f"{p} {late}" for p in plain for late in LATER]
    for part, words in CC_PARTS.items():
        for v in CC_VERSIONS:
            out[f"CC-{part}-{v}"] = [f"CC {part} {v}", f"CC {part} {v} license", f"Creative Commons {words} {v} International License", f"Creative Commons {words} {v} License", f"Creative Commons {words} {v}", f"Creative Commons {words} {v} Unported License", f"Creative Commons {part} {v} license", f"Creative Commons {part} {v}"]
    return out


def _all_sentences() -> dict[str, list[str]]:
    """SENTENCES with the notices of the GNU licences, which follow from name and version."""
    out = {k: list(v) for k, v in SENTENCES.items()}
    for short, (long, versions) in GNU.items():
        for v in versions:
            begin = [f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation" for thing in ("program", "library", "software", "file")]
            begin += [b.replace("Foundation", "Foundation, Inc.") for b in begin]
            for form in dict.fromkeys((v, v.removesuffix(".0"))):
                out.setdefault(f"free:{short}-{v}-or-later", []).extend(f"{b}; either version {form} of the License, or (at your option) any later version" for b in begin)
                out.setdefault(f"free:{short}-{v}-only", []).extend(f"{b}; version {form} of the License" for b in begin)
                out[f"free:{short}-{v}-only"] += [f"{b}, version {form}" for b in begin]
    return out


def _all_rules() -> dict[str, list[list[str]]]:
    """RULES with a licence's name, identifier and, of the GNU licences, notice, alone and with the warranty's denial."""
    out = {k: [list(r) for r in v] for k, v in RULES.items()}
    for licence in (*_all_names(), *MORE_IDS):
        out.setdefault(licence, []).extend(([f"name:{licence}"], [f"spdx:{licence}"]))
    for short, (_, versions) in GNU.items():
        for v in versions:
            for kind in ("only", "or-later"):
                licence = f"{short}-{v}-{kind}"
                out[licence] += [[f"free:{licence}"], [f"free:{licence}", "gpl-warranty"]]
    return out


_ENDS = re.compile(r"[.!?;:]+(?=\s|\Z)|[\r\n]+|\*/|-->")
_WORD = re.compile(r"[^\W_]+")
_PLUS = re.compile(r"(?<=[0-9A-Za-z])\+(?![0-9A-Za-z])")
#: One of these stems stands in every known sentence: texts without any of them are done.
_STEMS = re.compile(r"licen[cs]ed?|permi(?:ssion|tted)|copyright|warrant|redistribut|endorse|released|domain|reserved|software|acknowledgement|(?:distributed|published|available|provided)[\W_]+(?:under|subject)|made[\W_]+available", re.I)
_SPDX = "spdx license identifier"


def normalise(sentence: str) -> str:
    """Lower-case words of letters and digits, joined by one space; a plus sign after a word is "or later"."""
    return " ".join(_WORD.findall(_PLUS.sub(" or later", sentence).lower()))


def _starts(forms: Iterable[str]) -> set[str]:
    """All beginnings of the forms, word by word."""
    return {" ".join(w[:k]) for w in map(str.split, forms) for k in range(1, len(w) + 1)}


class SentenceBook:
    """Normalised known sentences: whole ones by text, those with a gap by their two ends, notices by how they begin and the licence's name."""

    def __init__(self, sentences: dict[str, list[str]] | None = None, names: dict[str, list[str]] | None = None):
        self.whole: dict[str, str] = {}
        self.gapped: dict[str, list[tuple[str, str, str]]] = {}
        self.starts: set[str] = set()  # of known sentences, up to the gap
        for name, forms in (_all_sentences() if sentences is None else sentences).items():
            for form in forms:
                if "{}" not in form:
                    self.whole.setdefault(normalise(form), name)
                else:
                    head, tail = map(normalise, form.split("{}"))
                    self.gapped.setdefault(head.split()[0], []).append((head, tail, name))
                self.starts |= _starts([normalise(form.split("{}")[0])])
        names = _all_names() if names is None else names
        self.names = {normalise(form): licence for licence, forms in names.items() for form in forms}
        for form in [f for f in self.names if f.startswith(("gnu ", "mozilla ", "apache ", "mit licen", "eclipse "))]:  # long enough to stand alone, as headings
            for alone in (form, f"the {form}"):
                self.whole.setdefault(alone, f"name:{self.names[form]}")
                self.starts |= _starts([alone])
        self.leads = {" ".join(f"{s} {v} {k}".split()) for s in SUBJECTS for v in VERBS for k in LINKS}
        self.lead_starts, self.name_starts = _starts(self.leads), _starts(self.names)
        self.ids = {normalise(x): x for x in (*names, *MORE_IDS)}
        for licence in names:  # identifiers before "only" came into use
            if licence.endswith("-only"):
                self.ids[normalise(licence.removesuffix("-only"))] = licence
            if licence.endswith("-or-later"):
                self.ids[normalise(licence.removesuffix("-or-later") + "+")] = licence
        self.extras = set(map(normalise, EXCEPTIONS))
        self.id_starts = _starts([*self.ids, *self.extras])

    def _led(self, sentence: str) -> Iterator[str]:
        """What follows each beginning of a notice."""
        at = sentence.find(" ")
        while 0 <= at:
            if sentence[:at] in self.leads:
                yield sentence[at + 1 :]
            elif sentence[:at] not in self.lead_starts:
                return
            at = sentence.find(" ", at + 1)

    def identify(self, sentence: str) -> tuple[str, ...]:
        """The identifiers of a normalised sentence; several of a line with several licences, none of an unknown one."""
        if name := self.whole.get(sentence):
            return (name,)
        for head, tail, name in self.gapped.get(sentence.split(" ", 1)[0], ()):
            if sentence.startswith(head + " ") and (not tail or sentence.endswith(" " + tail)):
                middle = sentence[len(head) : len(sentence) - len(tail)].split()
                if 1 <= len(middle) <= 8:
                    return (name,)
        for rest in self._led(sentence):
            if licence := self.names.get(rest):
                return (f"name:{licence}",)
        if sentence.startswith(_SPDX + " "):
            parts = re.split(r" (?:or(?! later)|and|with) ", sentence[len(_SPDX) + 1 :])
            if all(p in self.ids or p in self.extras for p in parts):
                return tuple(dict.fromkeys(f"spdx:{self.ids[p]}" for p in parts if p in self.ids))
        return ()

    def goes_on(self, words: str) -> bool:
        """Whether a known sentence may start with these normalised words and have more."""
        if words in self.starts or words in self.lead_starts or any(rest in self.name_starts for rest in self._led(words)):
            return True
        if words.startswith("spdx"):
            if _SPDX.startswith(words):
                return True
            if words.startswith(_SPDX + " "):
                last = re.split(r" (?:or(?! later)|and|with)(?: |$)", words[len(_SPDX) + 1 :])[-1]
                return not last or last in self.id_starts
        forms = self.gapped.get(words.split(" ", 1)[0], ())
        return any(words.startswith(head + " ") and words.count(" ") < len(head.split()) + 7 + len(tail.split()) for head, tail, _ in forms)


def _cut(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _ENDS.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def known_sentences(text: str, book: SentenceBook) -> list[tuple[int, int, int, int, str]]:
    """(start, end, first and last place among all sentences, identifier) of the known sentences, in order; several for one place where a line names several licences."""
    if not _STEMS.search(text):
        return []
    lines = list(_cut(text))
    words = [normalise(text[a:b]) for a, b in lines]
    full = [i for i, w in enumerate(words) if w]
    runs: list[dict[int, tuple[str, ...]]] = []  # of each piece with words: the last pieces of known sentences from there, by number in full
    for first in range(len(full)):
        sentence, ends = "", {}  # a sentence grows only while some known one goes on, so it has a bounded length
        for last in range(first, len(full)):
            sentence = f"{sentence} {words[full[last]]}".lstrip()
            if names := book.identify(sentence):
                ends[last] = names
                if sentence not in book.whole and not names[0].startswith(("name:", "spdx:")):
                    break  # a gap at its shortest
            if not book.goes_on(sentence):
                break
        runs.append(ends)
    found: dict[tuple[int, int], tuple[str, ...]] = {}
    for first, ends in enumerate(runs):
        single = [e for e in ends if not any(m < e and e in runs[m + 1] for m in ends)]
        if single:
            a, b = lines[full[first]][0], lines[full[max(single)]][1]
            a += len(text[a:b]) - len(text[a:b].lstrip())
            found[a, b] = ends[max(single)]
    starts = [a for a, _ in lines]
    place = lambda x: bisect.bisect_right(starts, x) - 1
    return sorted((a, b, place(a), place(b - 1), name) for (a, b), names in found.items() for name in names)


def rule_matches(sequence: list[tuple[int, int, int, int, str]], rules: dict[str, list[list[str]]], gap: int = GAP) -> list[tuple[int, int, str, int]]:
    """(start, end, licence, sentences) of the rules that hold; covered ones are left out. Linear in the sequence: a rule looks no farther than its gaps."""
    by_first: dict[str, list[tuple[str, list[str]]]] = {}
    for licence, variants in rules.items():
        for rule in variants:
            by_first.setdefault(rule[0], []).append((licence, rule))
    hits: list[tuple[int, int, str, frozenset[int]]] = []
    at: dict[int, list[int]] = {}  # by the first sentence
    for i, (start, end, _, last, name) in enumerate(sequence):
        for licence, rule in by_first.get(name, ()):
            want, used, stop, before = 1, [i], end, last
            for j in range(i + 1, len(sequence)):
                if want == len(rule) or sequence[j][2] - before > gap + 1:
                    break
                if sequence[j][4] == rule[want]:
                    stop, before = sequence[j][1], sequence[j][3]
                    want += 1
                    used.append(j)
            if want == len(rule):
                at.setdefault(i, []).append(len(hits))
                hits.append((start, stop, licence, frozenset(used)))
    covered = {h for _, _, _, v in hits if len(v) > 1 for i in v for h in at.get(i, ()) if hits[h][3] < v}
    return sorted({(s, e, x, len(u)) for h, (s, e, x, u) in enumerate(hits) if h not in covered})


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_sentences (known ones), licenses (sorted, comma-joined), spans (licence:start:end by start, code points, end exclusive).

    Null and empty texts have none. Null ids and repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, rules = SentenceBook(), _all_rules()
        for batch in batches:
            n, licences, spans = [], [], []
            for text in batch.column(1):
                sequence = known_sentences(text.as_py() or "", book)
                hits = rule_matches(sequence, rules)
                n.append(len(sequence))
                licences.append(",".join(sorted({h[2] for h in hits})))
                spans.append(",".join(f"{x}:{a}:{b}" for a, b, x, _ in hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(licences, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_sentences", "licenses", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_sentences long, licenses string, spans string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
