"""Licence recognition by sentences.

A text is cut into sentences, each is normalised to its lower-case words, and a known sentence
becomes its identifier. The identifiers, in the order of the text, are then matched against
ordered rules: a rule is a sequence of identifiers, rules are tried from the most to the least
specific, and the first that fits at a place takes its sentences. Other known sentences may come
in between. Where no rule fits whole, one of three sentences or more may be missing, but not the
first. Sentences that no rule takes are reported as incomplete.

A known sentence has several spellings, all with one identifier. A notice that names a licence
("This file is released under the MIT license", "SPDX-License-Identifier: MIT") is a sentence made
of a beginning and one of the licence's names.

Sentences are cut twice, once with line ends as borders and once with only blank lines as
borders, because licence lines stand alone and licence texts are wrapped; a sentence's place is
the number of words before it, which is the same for both. Comment marks at the ends of lines are
taken off first, and between blank lines a sentence may also start where a line starts, since the
line before it (a copyright notice, a heading) often ends without a full stop.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentences of well-known licences and of the notices that name them.
SENTENCES: dict[str, str] = {
    "apache-2-line": "Licensed under the Apache License, Version 2.0",
    "apache-2-grant": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-2-comply": "you may not use this file except in compliance with the License",
    "apache-2-obtain": "You may obtain a copy of the License at",
    "apache-2-unless": (
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied"
    ),
    "mit-line": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software"
    ),
    "mit-as-is": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT"
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer"
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution"
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission"
    ),
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version"
    ),
    "gpl-2-free": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version"
    ),
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ),
    "lgpl-2-free": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
        "the License, or (at your option) any later version"
    ),
    "agpl-3-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version"
    ),
    "mpl-2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies"
    ),
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-line": "This work is dedicated to the public domain under CC0 1.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "all-rights": "All rights reserved",
    "apache-2-head": "Apache License Version 2.0, January 2004",
    "apache-2-head-url": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "gpl-3-head": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2-head": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-3-head": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2-head": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl-3-head": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl-2-head": "Mozilla Public License Version 2.0",
    "epl-2-head": "Eclipse Public License - v 2.0",
    "bsl-head": "Boost Software License - Version 1.0 - August 17th, 2003",
    "artistic-2-head": "The Artistic License 2.0",
    "cc0-head": "CC0 1.0 Universal",
    "mit-head": "The MIT License (MIT)",
    "isc-head": "ISC License",
    "bsl-grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        'software and accompanying documentation covered by this license (the "Software") to use, reproduce, '
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following"
    ),
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "isc-as-is": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"
    ),
    "bsd-as-is": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
}

# Other spellings of words in known sentences.
SPELLINGS = {"sublicense": "sub license", "noninfringement": "non infringement", "license": "licence"}

# The names that notices call licences by; "license" after them may be left out.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "Expat"),
    "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache-2", "Apache License v2.0", "ASL 2.0"),
    "GPL-3.0-only": ("GPL 3.0", "GPLv3", "GPL v3", "GPL-3.0-only", "GNU GPL v3", "GNU General Public License version 3", "GNU General Public License v3.0"),
    "GPL-3.0-or-later": ("GPL-3.0-or-later", "GPL 3.0+", "GPLv3 or later", "GNU General Public License version 3 or later"),
    "GPL-2.0-only": ("GPL 2.0", "GPLv2", "GPL v2", "GPL-2.0-only", "GNU GPL v2", "GNU General Public License version 2", "GNU General Public License v2.0"),
    "GPL-2.0-or-later": ("GPL-2.0-or-later", "GPLv2 or later", "GNU General Public License version 2 or later"),
    "LGPL-2.1-only": ("LGPL 2.1", "LGPLv2.1", "LGPL-2.1-only", "GNU Lesser General Public License version 2.1"),
    "LGPL-3.0-only": ("LGPL 3.0", "LGPLv3", "LGPL-3.0-only", "GNU Lesser General Public License version 3"),
    "AGPL-3.0-only": ("AGPL 3.0", "AGPLv3", "AGPL-3.0-only", "GNU Affero General Public License version 3"),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "EPL-2.0": ("EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License - v 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause", "Simplified BSD", "FreeBSD"),
    "BSD-3-Clause": ("BSD 3-Clause", "New BSD", "Modified BSD", "Revised BSD"),
    "BSL-1.0": ("BSL 1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "ISC": ("ISC",),
    "Zlib": ("zlib", "zlib/libpng"),
    "Unlicense": ("Unlicense",),
    "Artistic-2.0": ("Artistic 2.0", "Artistic License 2.0"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
}
_notice = re.compile(
    r"(?:(?:this|the) \w+(?: \w+)? (?:is|are) |all \w+ (?:is|are) )?(?:dual )?"
    r"(?:licen[sc]ed|released|distributed|available|made available|published|provided|covered) (?:to you )?(?:under|by) "
    r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?(.+)"
)
_identifier = re.compile(r"spdx licen[sc]e identifier (.+)")
_NOTICE_WORDS = 24

# Beginnings and ends of known sentences that name somebody in between.
NAMING: dict[str, tuple[str, str]] = {
    "bsd-endorse": (
        "Neither the name of",
        "contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission",
    ),
}
_NAME_WORDS = 24

# Licence names and the sentences that make them, the most specific first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-2-grant", "apache-2-comply", "apache-2-obtain", "apache-2-unless")),
    ("MIT", ("mit-head", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope")),
    ("Apache-2.0", ("apache-2-grant",)),
    ("Apache-2.0", ("apache-2-line",)),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-3.0-only", ("gpl-3-line",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("LGPL-2.1-or-later", ("lgpl-2-free",)),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("MPL-2.0", ("mpl-2-subject",)),
    ("ISC", ("isc-head", "isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0-line",)),
    ("Unlicense", ("unlicense-free",)),
    ("proprietary-notice", ("all-rights",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Apache-2.0", ("apache-2-head",)),
    ("Apache-2.0", ("apache-2-head-url",)),
    ("GPL-3.0-only", ("gpl-3-head",)),
    ("GPL-2.0-only", ("gpl-2-head",)),
    ("LGPL-3.0-only", ("lgpl-3-head",)),
    ("LGPL-2.1-only", ("lgpl-2-head",)),
    ("AGPL-3.0-only", ("agpl-3-head",)),
    ("MPL-2.0", ("mpl-2-head",)),
    ("EPL-2.0", ("epl-2-head",)),
    ("BSL-1.0", ("bsl-head",)),
    ("Artistic-2.0", ("artistic-2-head",)),
    ("CC0-1.0", ("cc0-head",)),
    *[(licence, (f"notice:{licence}",)) for licence in NAMES],
)

_word = re.compile(r"[^\W_]+").findall
# A semicolon or colon is no border: some known sentences hold one, and "the following
# conditions are met:" ends at the line's end or the next full stop.
_border = re.compile(r"[.!?]+(?=\s|$)|[;:](?=\s|$)")


_comment_marks = re.compile(r"^[ \t]*(?:#+|/\*+|\*+/?|//+|;+|--+|%+|<!--+)|(?:\*+/|--+>)[ \t]*$", re.M)
_blank_lines = re.compile(r"\n[ \t]*\n\s*")


@dataclass(frozen=True)
class Recognizer:
    """Known sentences by their normalised words, and rules by their first identifier."""

    by_words: dict[str, str]
    by_name: dict[str, str]
    naming: list[tuple[str, str, int, str]]
    longest: int
    anchors: re.Pattern
    rules: dict[str, list[tuple[str, tuple[str, ...]]]]

    def sentences(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, words, identifier) of the known sentences, by place and without overlap."""
        if not text or not self.anchors.search(text.lower()):
            return []
        text = _comment_marks.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
        found: set[tuple[int, int, str]] = set()
        for lines_end_sentences in (True, False):
            pieces = text.splitlines() if lines_end_sentences else _blank_lines.split(text)
            place = 0
            for piece in pieces:
                words: list[str] = []
                ends: list[int] = []
                for part in _border.split(piece):
                    words += _word(part.lower())
                    ends.append(len(words))
                starts, at = {0, *ends[:-1]}, 0
                for line in piece.splitlines():
                    starts.add(at)
                    at += len(_word(line.lower()))
                for start in sorted(starts):
                    first = bisect_right(ends, start)
                    # A known sentence may itself hold borders, so up to four parts are tried together.
                    for end in ends[first : first + 4]:
                        if end - start > self.longest:
                            break
                        if name := self.named(words[start:end]):
                            found.add((place + start, end - start, name))
                place += len(words)
        kept, end = [], 0
        for place, n, name in sorted(found, key=lambda f: (f[0], -f[1])):
            if place >= end:
                kept.append((place, n, name))
                end = place + n
        return kept

    def named(self, words: list[str]) -> str | None:
        """The identifier of the known sentence of these words."""
        sentence = " ".join(words)
        if sentence in self.by_words:
            return self.by_words[sentence]
        for start, end, n, name in self.naming:
            if n < len(words) <= n + _NAME_WORDS and sentence.startswith(start) and sentence.endswith(end):
                return name
        if len(words) <= _NOTICE_WORDS:
            match = _notice.fullmatch(sentence) or _identifier.fullmatch(sentence)
            if match and (licence := self.by_name.get(match[1])):
                return f"notice:{licence}"
        return None

    def licences(self, sentences: list[tuple[int, int, str]]) -> list[tuple[int, int, str, bool]]:
        """(first word, words, name, complete) of what the rules make of the sentences."""
        names = [name for _, _, name in sentences]
        found, taken = [], set()
        for i, (place, n, name) in enumerate(sentences):
            if i in taken:
                continue
            fitting = self._fitting(names, taken, i, 0) or self._fitting(names, taken, i, 1)
            if fitting:
                licence, places = fitting
                taken.update(places)
                last_place, last_n, _ = sentences[places[-1]]
                found.append((place, last_place + last_n - place, licence, True))
            else:
                found.append((place, n, name, False))
        return found

    def _fitting(self, names: list[str], taken: set[int], first: int, may_miss: int) -> tuple[str, list[int]] | None:
        """The first rule that fits from a sentence on, and the sentences that it takes."""
        for licence, rule in self.rules.get(names[first], ()):
            places, missing = [first], 0
            for name in rule[1:]:
                following = range(places[-1] + 1, len(names))
                # The same beginning once more is another text.
                other = next((k for k in following if names[k] == rule[0]), len(names))
                place = next((k for k in following if k < other and k not in taken and names[k] == name), None)
                if place is None:
                    missing += 1
                else:
                    places.append(place)
            if not missing or (missing <= may_miss and len(rule) > 2):
                return licence, places
        return None


def _spelled(words: str) -> list[str]:
    """A sentence's words in all spellings."""
    found = [words]
    for usual, other in SPELLINGS.items():
        found += [re.sub(rf"\b{usual}\b", other, w) for w in found if re.search(rf"\b{usual}\b", w)]
    return found


@lru_cache(maxsize=1)
def recognizer() -> Recognizer:
    by_words = {w: name for name, s in SENTENCES.items() for w in _spelled(" ".join(_word(s.lower())))}
    by_name = {}
    for licence, called in NAMES.items():
        for words in [" ".join(_word(c.lower())) for c in (*called, licence)]:
            by_name |= {w: licence for name in (words, f"{words} license") for w in _spelled(name)}
    rules: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
    for licence, rule in RULES:
        rules.setdefault(rule[0], []).append((licence, rule))
    # Every known sentence has one of these words, so other texts need no cutting.
    anchors = ("licen", "copyright", "warrant", "permi", "redistribut", "public", "rights", "name")
    anchors += ("cc0", " under ")
    assert all(any(a in words for a in anchors) for words in by_words)
    naming = []
    for name, (start, end) in NAMING.items():
        first, last = _word(start.lower()), _word(end.lower())
        naming.append((" ".join(first) + " ", " " + " ".join(last), len(first) + len(last), name))
    longest = max([len(w.split()) for w in by_words] + [n + _NAME_WORDS for _, _, n, _ in naming])
    return Recognizer(by_words, by_name, naming, longest, re.compile("|".join(anchors)), rules)


FOUND = (
    T.StructType()
    .add("first_word", "integer")
    .add("n_words", "integer")
    .add("name", "string")
    .add("complete", "boolean")
)


def find_licences(text: str | Column) -> Column:
    """struct(sentences, licences) of each whole text.

    ``sentences`` are the identifiers in order; ``licences`` are structs of first_word, n_words,
    name and complete. Both are empty for NULL, empty and other texts without known sentences.
    """
    schema = T.StructType().add("sentences", T.ArrayType(T.StringType())).add("licences", T.ArrayType(FOUND))

    @F.pandas_udf(schema)
    def found(texts: pd.Series) -> pd.DataFrame:
        known = recognizer()
        sentences = [known.sentences(t) for t in texts]
        keys = ("first_word", "n_words", "name", "complete")
        licences = [[dict(zip(keys, f)) for f in known.licences(s)] for s in sentences]
        return pd.DataFrame({"sentences": [[n for _, _, n in s] for s in sentences], "licences": licences})

    return found(text)


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, sentences, licences for every row, repeated rows included; nothing is shuffled."""
    scanned = docs.select(F.col(id_column), find_licences(F.col(text_column)).alias("found"))
    return scanned.select(id_column, "found.sentences", "found.licences")
