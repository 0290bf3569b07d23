import random
import textwrap

from oresmith.llm import licenses
from oresmith.llm.queries import QUERIES
from tests.conftest import SMALL

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def names(text):
    known = licenses.recognizer()
    return [(name, complete) for _, _, name, complete in known.licences(known.sentences(text))]


def test_a_wrapped_licence_text():
    assert names(MIT) == [("MIT", True)]
    assert names("prose before it\n" + MIT.replace("\n", "\r\n") + "\nprose after it") == [("MIT", True)]


def test_the_first_and_most_specific_rule_takes_its_sentences():
    s = licenses.SENTENCES
    two = ". ".join(s[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary"))
    assert names(two) == [("BSD-2-Clause", True)]
    assert names(f"{two}. {s['bsd-endorse']}.") == [("BSD-3-Clause", True)]
    assert names(s["bsd-source"]) == [("bsd-source", False)]
    assert names(f"{s['mit-line']}.\n{s['apache-2-line']}.") == [("MIT", True), ("Apache-2.0", True)]


def test_every_known_sentence_is_found_alone_and_in_prose():
    known = licenses.recognizer()
    for name, sentence in licenses.SENTENCES.items():
        for text in (sentence, f"Some words. {sentence.upper()}. More words.", f"no full stop\n{sentence}\nno more"):
            assert name in [n for _, _, n in known.sentences(text)], (name, text)


def test_licence_texts_in_comments_and_under_headings():
    for mark in ("#", " *", "//", "--", ";"):
        assert names("\n".join(f"{mark} {line}".rstrip() for line in MIT.splitlines())) == [("MIT", True)], mark
    assert names("/*\n" + "\n".join(f" * {line}".rstrip() for line in MIT.splitlines()) + "\n */\nint x;") == [("MIT", True)]
    assert names(MIT.replace("Somebody\n\n", "Somebody\n")) == [("MIT", True)]


def test_a_bsd_text_that_names_an_organisation():
    s = licenses.SENTENCES
    two = ". ".join(s[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary"))
    for who in ("Example Labs, Inc. nor the names of its", "the University of Somewhere nor the names of its", "Google LLC nor the names of"):
        endorse = s["bsd-endorse"].replace("the copyright holder nor the names of its", who)
        assert names(f"{two}. {endorse}.") == [("BSD-3-Clause", True)], who


def test_notices_that_name_a_licence():
    for text, licence in [
        ("This project is licensed under the MIT License.", "MIT"),
        ("Licensed under the Apache License 2.0.", "Apache-2.0"),
        ("This file is released under the MIT license.", "MIT"),
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("The source code is distributed under the terms of the GNU General Public License version 3.", "GPL-3.0-only"),
        ("All code is available under the BSD 3-Clause licence", "BSD-3-Clause"),
        ("                  Apache License\n            Version 2.0, January 2004\n         http://www.apache.org/licenses/\n\n1. Definitions.", "Apache-2.0"),
        ("   GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0-only"),
    ]:
        assert (licence, True) in names(text), text
        assert (licence, True) in names(f"Some prose.\n\n{text}\n\nMore prose."), text


def test_spellings_gaps_and_missing_sentences():
    assert names(MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("sublicense", "sub-license")) == [("MIT", True)]
    between = MIT.replace("furnished to do so, subject to the following conditions:", "furnished to do so, subject to the following conditions:\n\nAll rights reserved.")
    assert sorted(names(between)) == [("MIT", True), ("proprietary-notice", True)]
    start, end = MIT.index("The above"), MIT.index("THE SOFTWARE")
    assert names(MIT[:start] + MIT[end:]) == [("MIT", True)]
    # Two of three missing are too many, and a second beginning is another text.
    assert names(MIT[:start]) == [("mit-grant", False)]
    assert names(MIT + "\n\n" + MIT) == [("MIT", True), ("MIT", True)]
    s = licenses.SENTENCES
    assert names(f"{s['zlib-as-is']}. In no event. {s['zlib-grant']}:") == [("Zlib", True)]


def test_recall_on_a_made_corpus():
    """Every rule's sentences, wrapped, commented and spelled at random within other prose."""
    choose, found, asked, wrong = random.Random(7), 0, 0, 0
    for _ in range(400):
        licence, rule = choose.choice([r for r in licenses.RULES if not r[1][0].startswith("notice:")])
        sentences = [licenses.SENTENCES[name] for name in rule]
        if choose.random() < 0.3:
            sentences = [w for w in sentences for w in [w.replace("License", "Licence")]]
        text = "\n\n".join("\n".join(textwrap.wrap(x + choose.choice([".", ":"]), choose.choice([40, 72, 100]))) for x in sentences)
        if choose.random() < 0.3:
            mark = choose.choice(["#", " *", "//"])
            text = "\n".join(f"{mark} {line}".rstrip() for line in text.splitlines())
        text = f"A heading\n\nWords of prose before it.\n\n{text}\n\nWords after it."
        got = {name for name, complete in names(text) if complete}
        asked += 1
        found += licence in got
        wrong += bool(got - {licence})
    assert found >= 0.95 * asked and wrong <= 0.02 * asked


def test_clean_texts():
    for text in (None, "", "A license to drive. The public has rights.", "We walked under the bridge, released under the moon.", "x" * 100_000, "name " * 50_000):
        assert names(text) == []


def test_frames(spark, odd_docs):
    assert all(r["sentences"] == [] == r["licences"] for r in licenses.scan_documents(odd_docs).collect())
    assert licenses.scan_documents(odd_docs.where("false")).count() == 0


def test_query_against_a_search_for_the_lines(spark):
    lines = {"Apache-2.0": "apache-2-line", "MIT": "mit-line", "GPL-3.0-only": "gpl-3-line", "CC-BY-NC-4.0": "cc-by-nc-4"}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op4_license_sentences"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for row in rows:
        expected = {n for n, s in lines.items() if licenses.SENTENCES[s] + "." in docs[row["doc_id"]].splitlines()}
        assert expected == set(row["licences"].split()) - {"proprietary-notice"}
