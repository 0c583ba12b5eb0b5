import pytest

from cairnframe.llm import license_scan
from cairnframe.llm.license_scan import TEMPLATES

from .cases import edge_documents, no_documents


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner(TEMPLATES, 0.2, 0.1)


def found(scanner, text):
    longest = max(len(t) for texts in TEMPLATES.values() for t in texts)
    return [(f[0], f[1], f[2], f[5]) for f in license_scan.scan_text(scanner, text, longest)]


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_template_is_found_in_place(scanner, name):
    for i, text in enumerate(TEMPLATES[name]):
        shown = text.replace("<address>", "http://example.org/x")
        if not license_scan.re.search(license_scan.TERMS, shown):
            continue
        wrapped = license_scan.re.sub(r"(.{60,75}) ", r"\1\n", shown)
        for form in {shown, shown.upper(), wrapped if license_scan.re.search(license_scan.TERMS, wrapped.split("\n")[0]) else shown}:
            got = found(scanner, f"Some prose.\n{form}\nMore prose here.")
            assert [g[0] for g in got] == [name] and got[0][2] == 12 and got[0][3], (form, got)


def test_deciding_words_tell_licenses_apart(scanner):
    assert found(scanner, "Licensed under CC BY-NC 4.0.")[0][0] == "CC-BY-NC-4.0"
    assert found(scanner, "Licensed under CC BY 3.0")[0][0] == "CC-BY-3.0"
    assert found(scanner, "This work is licensed under the GNU Lesser General Public License, version 3.")[0][0] == "LGPL-3.0"
    assert found(scanner, "This work is licensed under the GNU General Public License, version 7.") == []
    assert found(scanner, "Licensed under the Apache License, Version 1.1.") == []
    assert found(scanner, "This work is not licensed under the GNU General Public License, version 3.") == []


def test_other_words_may_differ_a_little(scanner):
    text = "This text is licensed under the GNU General Public License, version 3."
    ((name, _, _, exact),) = found(scanner, text)
    assert name == "GPL-3.0" and not exact
    assert license_scan.differences(license_scan.words_of(TEMPLATES["GPL-3.0"][0]), license_scan.words_of(text)) == [("replace", "work", "text")]
    assert found(scanner, "A driver's license and the permission of the owner are needed here.") == []


def test_scan_against_lines_of_the_data(spark):
    """In the given documents every notice is one whole line."""
    names = {t.lower(): name for name, texts in TEMPLATES.items() for t in texts}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = []
    for r in docs.collect():
        at = 0
        for line in (r["text"] or "").split("\n"):
            if line.lower() in names:
                expected.append((r["doc_id"], names[line.lower()], at, len(line)))
            at += len(line) + 1
    got = license_scan.scan(docs).collect()
    assert expected and sorted((r["doc_id"], r["license"], r["start"], r["length"]) for r in got) == sorted(expected)
    assert all(r["exact"] and r["reduction"] >= 0.2 and not r["differences"] for r in got)


def test_edge_rows(spark):
    assert license_scan.scan(edge_documents(spark)).count() == 0
    assert license_scan.scan(no_documents(spark)).count() == 0
    text = "Released under the MIT License.\n" * 3 + "x" * 50_000 + "\nLicensed under CC BY 4.0."
    rows = [(1, text), (1, text), (None, text), (2, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS license", "1 AS start")).collect()
    assert len(got) == 12 and sum(r["doc_id"] is None for r in got) == 4


PROSE = "The river ran low that summer and nobody in the village could say when the rain would come again "


@pytest.mark.parametrize("before,after", [(300, 0), (1000, 1000), (6000, 400)])
def test_notices_are_found_within_a_long_line(scanner, before, after):
    """The reduction is measured on the notice, not on the line around it, and a line may hold several."""
    for name in ("GPL-3.0", "MIT", "CC-BY-4.0"):
        for text in TEMPLATES[name]:
            lead, rest = (PROSE * 80)[:before].rsplit(" ", 1)[0] + " ", " " + (PROSE * 80)[:after]
            line = f"{lead}{text}{rest} Licensed under CC BY-NC 3.0. {rest}"
            got = found(scanner, line)
            assert [(g[0], g[2], g[3]) for g in got] == [(name, len(lead), True), ("CC-BY-NC-3.0", line.index("Licensed under CC BY-NC 3.0"), True)], (text, got)


def _wrapped(text, width, mark):
    lines = [""]
    for word in text.split():
        if lines[-1] and len(lines[-1]) + len(word) >= width:
            lines.append("")
        lines[-1] += f" {word}" if lines[-1] else word
    return f"\n{mark}".join(lines)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "> "])
def test_every_wrapping_of_every_template_is_found(spark, scanner, mark):
    rows, names = [], []
    for name in sorted(TEMPLATES):
        for text in TEMPLATES[name]:
            shown = license_scan.re.sub(r"<[a-z ]+>", "http://example.org/x", text)
            for form in {_wrapped(shown, width, mark) for width in (1, 13, 28, 43, 58, 73)}:
                got = found(scanner, f"Some prose.\n{mark}{form}\nMore prose here.")
                assert [(g[0], g[2], g[3]) for g in got] == [(name, 12 + len(mark), True)], (form, got)
            rows.append((len(rows), f"Some prose.\n{mark}{_wrapped(shown, 1, mark)}\nMore prose here."))
            names.append(name)
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == list(enumerate(names))


def test_official_mpl_header_is_found(scanner):
    text = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    assert [(g[0], g[2], g[3]) for g in found(scanner, text)] == [("MPL-2.0", 3, True)]


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text,name",
    [
        ("Licensed under the MIT License", "MIT"),
        ("This project is licensed under the MIT Licence.", "MIT"),
        ("It is available under the Apache License 2.0.", "Apache-2.0"),
        ("Released under the 2-Clause BSD License.", "BSD-2-Clause"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("Licensed under GPLv3 or later", "GPL-3.0"),
        (GPL.format("General Public License", "2"), "GPL-2.0"),
        (GPL.format("Lesser General Public License", "2.1"), "LGPL-2.1"),
        (GPL.format("Library General Public License", "2"), "LGPL-2.0"),
        (GPL.format("Affero General Public License", "3"), "AGPL-3.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "CC-BY-NC-SA-3.0"),
        ("All rights reserved.", "All-rights-reserved"),
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0-or-later WITH Classpath-exception-2.0"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND X11", "(MIT OR Apache-2.0) AND X11"),
        ("SPDX-License-Identifier: LicenseRef-own." + "a" * 300, "LicenseRef-own." + "a" * 300),
    ],
)
def test_usual_forms_are_found(spark, scanner, text, name):
    assert [g[0] for g in found(scanner, f"// {text} */")] == [name]
    rows = license_scan.scan(spark.createDataFrame([(1, f"# {text}\n")], "doc_id long, text string")).collect()
    assert [(r["license"], r["exact"]) for r in rows] == [(name, True)]


def test_third_clause_tells_bsd_licenses_apart(scanner):
    texts = {name: max(TEMPLATES[name], key=len).replace("<holder>", "the copyright holder") for name in ("BSD-2-Clause", "BSD-3-Clause")}
    for name, text in texts.items():
        assert [(g[0], g[3]) for g in found(scanner, f"Copyright (c) 2001 A. Person\n\n{text}")] == [(name, True)]
    start = texts["BSD-2-Clause"].split(":")[0] + ":"
    assert [g[0] for g in found(scanner, f"{start} ask the owner first.")] == ["BSD"]


def test_denied_notices_are_none(scanner):
    for text in ("It is not licensed under the MIT License.", "It isn't yet released under the MIT License.", "never\n# released under the MIT License"):
        assert found(scanner, text) == []
    assert [g[0] for g in found(scanner, "Ask if you may not. Released under the MIT License.")] == ["MIT"]


OVERLAP = {
    "Short-words": ("permission is granted to all of us to do as we may",),
    "Long-words": ("we may redistribute unmodified documentation notwithstanding organisational responsibilities",),
}
BOTH = "permission is granted to all of us to do as we may redistribute unmodified documentation notwithstanding organisational responsibilities"


def test_the_bytes_saved_decide_between_templates(monkeypatch):
    """Both notices are there word by word and share two words; the other has more words, this one saves more bytes."""
    scanner = license_scan.Scanner(OVERLAP, 0.2, 0.1)
    assert [g[0] for g in found(scanner, BOTH)] == ["Long-words"]
    ranked = scanner.candidates(license_scan.words_of(BOTH))
    assert [scanner.entries[c[1]][0] for c in ranked] == ["Long-words", "Short-words"] and ranked[0][0] * license_scan.NEAR > ranked[1][0]
    monkeypatch.setattr(license_scan.Scanner, "saving", lambda self, entry, block: 1)
    assert [g[0] for g in found(license_scan.Scanner(OVERLAP, 0.2, 0.1), BOTH)] == ["Short-words"]


class EveryWindow(license_scan.Scanner):
    """Brute force: every template with the block around every word, without pieces."""

    def candidates(self, words):
        out = []
        for entry, (_, _, template, open_places) in enumerate(self.entries):
            slack = int(self.tolerated * len(template)) + license_scan.OPEN * len(open_places)
            for p in range(len(words)):
                first = max(0, p - slack)
                block = tuple(words[first : p + len(template) + slack])
                out.append((self.saving(entry, block), entry, first, block))
        return sorted(out, key=lambda c: (-c[0], self.entries[c[1]][:2], c[2]))


@pytest.mark.parametrize(
    "text",
    [
        "We took it. Licensed under the MIT License. The rest is licensed under the GNU General Public License, version 3.",
        "This text is licensed under the GNU General Public License, version 3, all of it, and the map is under CC BY 4.0, Licensed under CC BY 4.0.",
        "Nothing is granted here but the permission to read the copyright notice in the public library of the town.",
        "Not licensed under the MIT License, never released under CC BY 4.0. All rights reserved. Released under the MIT License",
        "",
    ],
)
def test_pieces_lose_no_template(text):
    few = {name: tuple(t for t in TEMPLATES[name] if len(t) < 90) for name in ("MIT", "GPL-3.0", "CC-BY-4.0", "All-rights-reserved")}
    assert found(license_scan.Scanner(few, 0.2, 0.1), text) == found(EveryWindow(few, 0.2, 0.1), text)
