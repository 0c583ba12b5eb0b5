"""License scan by conditional compression, confirmed by exact wording differences."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches

#: Words that texts are chosen by, as far as templates hold them; none goes over a line end.
TERMS = r"(?i)licen[cs]|copyright|permission|redistribut|warrant|reserved|creative|domain|spdx"
#: Words that change what a notice grants; one of them too many, too few or replaced is another license.
_DECIDING = re.compile(
    r"\d|^(?:by|sa|nd|nc|attribution|sharealike|share|alike|noncommercial|non|commercial|noderiv\w*|no|derivs|derivatives|gnu|a?l?gpl|lesser|library|affero|general|"
    r"apache|mit|bsd|isc|mozilla|mpl|eclipse|epl|boost|bsl|zlib|clause|neither|endorse|not|later|without)$"
)
_WORD = re.compile(r"<[a-z ]+>|[^\W_]+(?:\.\d+)*")
_ANY_CASE = re.compile(_WORD.pattern, re.I)
#: What denies the notice that follows, with one word between them at most.
_DENIED = re.compile(r"(?:\b(?:not|never|cannot)|n['\u2019]t)[\s*#/>]+(?:[^\W_]+[\s*#/>]+)?\Z", re.I)
#: Marks after the last word that belong to the notice.
_CLOSING = re.compile(r"[.)\]\"'\u201d\u2019]*")
#: An SPDX tag and its license expression, which is the license as it is written.
_SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.:-]*\+?"
_SPDX_TERM = rf"\(*[ \t]*{_SPDX_ID}(?:[ \t]+WITH[ \t]+{_SPDX_ID})?(?:[ \t]*\))*"
_SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*(?P<expression>{_SPDX_TERM}(?:[ \t]+(?:AND|OR)[ \t]+{_SPDX_TERM})*)", re.I)
#: Templates that save this share of what the best one saves are winners too: by chance a template also holds a few
#: letters of the words around a notice, so that smaller gaps tell nothing.
NEAR = 0.8
#: Words that an open place of a template stands for at most.
OPEN = 8
COLUMNS = (
    "doc_id long, license string, template int, start long, length long, reduction double, exact boolean, "
    "differences array<struct<kind: string, template_words: string, text_words: string>>, block string"
)
_DIFFERENCE = pa.struct([("kind", pa.string()), ("template_words", pa.string()), ("text_words", pa.string())])


def words_of(text: str) -> list[str]:
    return [_same(w) for w in _WORD.findall(text.lower())]


def _same(word: str) -> str:
    """Both spellings of license are one word."""
    return word.replace("licenc", "licens")


#: How a license is granted in a sentence, before one of its names.
_GRANTS = ("Licensed under", "Released under", "Distributed under", "Available under", "Published under", "Under the terms of")
#: Names that licenses go by in such sentences, with the article; those that are abbreviations stand without it too.
_NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License v2", "Apache 2.0 License", "Apache 2 License", "Apache-2.0", "Apache Software License, Version 2.0"),
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"),
    "BSD": ("BSD License", "BSD-style License"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL-1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "EPL-2.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL-1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "CC0"),
    "LGPL-2.0": ("GNU Library General Public License, version 2", "GNU Library General Public License, version 2.0"),
}
for _key, _long, _short, _versions in (
    ("GPL", "General Public License", "GPL", ("2.0", "3.0")),
    ("LGPL", "Lesser General Public License", "LGPL", ("2.1", "3.0")),
    ("AGPL", "Affero General Public License", "AGPL", ("3.0",)),
):
    for _version in _versions:
        _numbers = dict.fromkeys((_version.removesuffix(".0"), _version))
        _NAMES[f"{_key}-{_version}"] = tuple(
            form
            for n in _numbers
            for form in (f"GNU {_long}, version {n}", f"GNU {_long} v{n}", f"GNU {_long} {n}", f"GNU {_short}, version {n}", f"GNU {_short} v{n}", f"GNU {_short} {n}", f"GNU {_short}v{n}")
            + (f"{_short}, version {n}", f"{_short} v{n}", f"{_short}-{n}", f"{_short}v{n}")
        )

_SOFTWARE_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY <holder> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <holder> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1_2 = (
    "{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "{}Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
#: Clauses are numbered or have marks that are no words.
_CLAUSES = (("1. ", "2. ", "3. "), ("", "", ""))
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software."
)
_MIT_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu_headers(name: str, version: str) -> tuple[str, ...]:
    """The notice that the license itself asks for, with and without later versions, for a program and for a library."""
    out = []
    for subject in ("program", "library", "software"):
        start = f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License"
        out += [
            f"{start} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
            f"{start} as published by the Free Software Foundation, version {version} of the License.",
            f"{start} version {version} as published by the Free Software Foundation.",
        ]
    return tuple(" ".join(text.split()) for text in out)


# Notices as their licenses ask for them, and as they are usually shortened; <...> stands for up to eight words of any kind.
_OWN_WORDS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at <address> "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "MIT": ("Released under the MIT License.", _MIT, f"{_MIT} {_MIT_AS_IS}"),
    "ISC": (
        f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.",
        f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}",
    ),
    "0BSD": (f"{_ISC}. {_ISC_AS_IS}",),
    "BSD": (_BSD,),
    "BSD-2-Clause": tuple(f"{_BSD} {_BSD_1_2.format(*n)} {_SOFTWARE_AS_IS}" for n in _CLAUSES),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        *(f"{_BSD} {_BSD_1_2.format(*n)} {_BSD_3.format(n[2])}{rest}" for n in _CLAUSES for rest in ("", f" {_SOFTWARE_AS_IS}")),
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0. (See accompanying file <address> or copy at <address>"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu_headers("", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu_headers("", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.0": (*_gnu_headers("Library", "2"), "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-2.1": (*_gnu_headers("Lesser", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu_headers("Lesser", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu_headers("Affero", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "MPL-1.1": ("Mozilla Public License Version 1.1 1. Definitions",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at <address>",
        "Mozilla Public License Version 2.0 1. Definitions",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, <holder> has waived all copyright and related or neighboring rights to <work>",
        "Creative Commons Legal Code CC0 1.0 Universal",
        "Creative Commons Zero v1.0 Universal",
    ),
    "All-rights-reserved": ("All rights reserved.",),
}
_CC_KINDS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _creative_commons(kind: str, version: str) -> tuple[str, ...]:
    place = _CC_VERSIONS[version]
    out = [f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {kind} {version} License."]
    for name in dict.fromkeys((_CC_KINDS[kind], _CC_KINDS[kind].replace("Derivatives", "Derivs"))):
        for grant in ("This work is licensed under", *_GRANTS[:-1]):
            out += [f"{grant} {the} Creative Commons {name} {version} {rest}License." for the in ("a", "the") for rest in (f"{place} ", "")]
        out += [f"Creative Commons {name} {version} {place} {rest}" for rest in ("Public License", "License", "")]
    for grant in _GRANTS[:-1]:
        out += [f"{grant} {the}CC {kind} {version}." for the in ("", "a ", "the ", "Creative Commons ")]
        out += [f"{grant} {the} Creative Commons {kind} {version} License." for the in ("a", "the")]
    return tuple(out)


def _templates() -> dict[str, tuple[str, ...]]:
    """All templates of each license; those of equal words once."""
    out = {name: list(texts) for name, texts in _OWN_WORDS.items()}
    out |= {f"CC-{kind}-{version}": list(_creative_commons(kind, version)) for kind in _CC_KINDS for version in _CC_VERSIONS}
    for name, forms in _NAMES.items():
        articles = {form: ("the ",) if "License" in form else ("the ", "") for form in forms}
        out.setdefault(name, []).extend(f"{grant} {the}{form}." for form in forms for grant in _GRANTS for the in articles[form])
    unique: dict[str, dict[tuple[str, ...], str]] = {name: {} for name in out}
    for name, texts in out.items():
        for text in texts:
            unique[name].setdefault(tuple(words_of(text)), text)
    return {name: tuple(texts.values()) for name, texts in unique.items()}


TEMPLATES = _templates()


def _placed(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of a text as :func:`words_of` has them, where each starts and where it ends."""
    words, starts, ends = [], [], []
    lowered = text.lower()
    if len(lowered) == len(text):
        for m in _WORD.finditer(lowered):
            words.append(_same(m.group()))
            starts.append(m.start())
            ends.append(m.end())
        return words, starts, ends
    # Lower case can be longer, and hold other marks than letters; then a word has several parts in one place.
    for m in _ANY_CASE.finditer(text):
        for word in words_of(m.group()):
            words.append(word)
            starts.append(m.start())
            ends.append(m.end())
    return words, starts, ends


def _aligned(template: list[str], block: list[str]) -> tuple[int, int, int, list[tuple[str, str, str]]] | None:
    """The stretch of the block that fits a template, how many words are equal, and what differs; None if hardly anything fits."""
    codes = [list(c) for c in SequenceMatcher(None, template, block, autojunk=False).get_opcodes()]
    if codes and codes[0][0] == "insert":
        codes = codes[1:]
    if codes and codes[-1][0] == "insert":
        codes = codes[:-1]
    equal = sum(c[2] - c[1] for c in codes if c[0] == "equal")
    if not equal or equal * 2 < len(template):
        return None
    # Of what replaces the first or last words, as many as they are belong to the notice.
    kind, a, b, c, d = codes[0]
    if kind == "replace":
        codes[0][3] = max(c, d - (b - a))
    kind, a, b, c, d = codes[-1]
    if kind == "replace":
        codes[-1][4] = min(d, c + (b - a))
    out = []
    for kind, a, b, c, d in codes:
        open_place = b - a == 1 and template[a].startswith("<") and d - c <= OPEN
        if kind != "equal" and not open_place:
            out.append((kind, " ".join(template[a:b]), " ".join(block[c:d])))
    return codes[0][3], codes[-1][4], equal, out


def differences(template: list[str], block: list[str]) -> list[tuple[str, str, str]] | None:
    """What differs between a template and the stretch of the block that fits it; None if hardly anything fits.

    Words before the first and after the last that fit belong to the text around the notice.
    """
    found = _aligned(template, block)
    return None if found is None else found[3]


def _seeds(words: list[str], allowed: int) -> list[tuple[int, int]]:
    """Place and length of pieces of a template, without open places and one more than words that may differ.

    Each difference spoils one piece at most, so every notice holds one of them whole.
    """
    runs, at = [], 0
    for i, word in enumerate([*words, "<"]):
        if word.startswith("<"):
            runs.append((at, i - at))
            at = i + 1
    size = max((length for _, length in runs), default=0)
    while size > 1 and sum(length // size for _, length in runs) <= allowed:
        size -= 1
    return [(begin + k * size, size) for begin, length in runs for k in range(length // size)] if size else []


def needles(templates: Mapping[str, tuple[str, ...]], tolerated: float) -> str:
    """A pattern that every text with a notice or an SPDX tag matches: of each template one word more than may differ."""
    term, found = re.compile(TERMS[4:], re.I), {"spdx"}
    for texts in templates.values():
        for text in texts:
            words = [w for w in words_of(text) if not w.startswith("<")]
            by_use = sorted(words, key=lambda w: (not term.search(w), w not in found, not (_DECIDING.search(w) and len(w) > 2 and w[0].isalpha()), -len(w)))
            found.update(by_use[: int(tolerated * len(words_of(text))) + 1])
    stems = sorted({m.group().replace("licens", "licen[cs]") for w in found if (m := term.search(w))})
    whole = sorted(re.escape(w) for w in found if not term.search(w))
    return f"(?iu){'|'.join(stems)}" + (rf"|(?<![\p{{L}}\p{{N}}])(?:{'|'.join(whole)})(?![\p{{L}}\p{{N}}])" if whole else "")


class Scanner:
    """Finds blocks of words that may hold a notice, ranks their templates by what they save as dictionary, and confirms a block word by word."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], least: float, tolerated: float):
        self.least, self.tolerated = least, tolerated
        self.plain = zstandard.ZstdCompressor(level=19)
        self.entries = []
        self.saved: dict[tuple, int] = {}
        #: By first word, length and words of a piece: the templates that hold it, and where.
        self.seeds: dict[str, dict[int, dict[tuple[str, ...], list[tuple[int, int]]]]] = {}
        for name, texts in templates.items():
            for i, text in enumerate(texts):
                words = words_of(text)
                for at, size in _seeds(words, int(tolerated * len(words))):
                    piece = tuple(words[at : at + size])
                    self.seeds.setdefault(piece[0], {}).setdefault(size, {}).setdefault(piece, []).append((len(self.entries), at))
                self.entries.append((name, i, words, [k for k, w in enumerate(words) if w.startswith("<")]))
        self.kept: dict[tuple, tuple | None] = {}

    def fit(self, entry: int, block: tuple[str, ...]) -> tuple | None:
        """Begin and end in the block, equal words, reduction and differences, if a template is confirmed in it."""
        key = (entry, block)
        if key not in self.kept:
            if len(self.kept) > 20_000:
                self.kept.clear()
            self.kept[key] = self._fit(self.entries[entry][2], list(block))
        return self.kept[key]

    def _fit(self, template: list[str], block: list[str]) -> tuple | None:
        found = _aligned(template, block)
        if found is None:
            return None
        begin, end, equal, diff = found
        if any(_DECIDING.search(w) for _, a, b in diff for w in f"{a} {b}".split()):
            return None
        if sum(max(len(a.split()), len(b.split())) for _, a, b in diff) > self.tolerated * len(template):
            return None
        reduction = self.reduction(" ".join(template), " ".join(block[begin:end]))
        return None if reduction < self.least else (begin, end, equal, reduction, diff)

    def reduction(self, template: str, stretch: str) -> float:
        plain, with_template = self.sizes(template, stretch)
        return 1 - with_template / plain

    def sizes(self, template: str, stretch: str) -> tuple[int, int]:
        raw = zstandard.ZstdCompressionDict(template.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data = stretch.encode("utf-8", "surrogatepass")
        return len(self.plain.compress(data)), len(zstandard.ZstdCompressor(level=19, dict_data=raw).compress(data))

    def saving(self, entry: int, block: tuple[str, ...]) -> int:
        """Bytes by which a block gets smaller with the template as raw dictionary."""
        key = (entry, block)
        if key not in self.saved:
            if len(self.saved) > 20_000:
                self.saved.clear()
            plain, with_template = self.sizes(" ".join(self.entries[entry][2]), " ".join(block))
            self.saved[key] = plain - with_template
        return self.saved[key]

    def candidates(self, words: list[str]) -> list[tuple[int, int, int, tuple[str, ...]]]:
        """Bytes saved, template, begin and words of every block that may hold a notice; the greatest saving first.

        A template takes part where a text holds one of its pieces; without one it can't be confirmed, so none is lost.
        """
        tried, found = set(), []
        for p, word in enumerate(words):
            for size, pieces in self.seeds.get(word, {}).items():
                for entry, at in pieces.get(tuple(words[p : p + size]), ()):
                    if (entry, p - at) in tried:
                        continue
                    tried.add((entry, p - at))
                    _, _, template, open_places = self.entries[entry]
                    slack = int(self.tolerated * len(template))
                    before = slack + OPEN * sum(k < at for k in open_places)
                    after = slack + OPEN * sum(k > at for k in open_places)
                    first = max(0, p - at - before)
                    block = tuple(words[first : p - at + len(template) + after])
                    found.append((self.saving(entry, block), entry, first, block))
        return sorted(found, key=lambda c: (-c[0], self.entries[c[1]][:2], c[2]))


def _expression(found: str) -> str:
    """An SPDX expression without the full stop, or the closing parentheses, of the text around it."""
    found = found.rstrip()
    while found.endswith((".", ":")) or (found.endswith(")") and found.count(")") > found.count("(")):
        found = found[:-1].rstrip()
    return found


def scan_text(scanner: Scanner, text: str, longest: int | None = None) -> Iterator[tuple]:
    """Notices of a text: license, template, start and length in characters, reduction, differences, block.

    An SPDX tag stands for itself. Blocks are confirmed in the order of the bytes that their templates save. Where the
    confirmed stretches of several winners (see ``NEAR``) overlap, the exact wording tells which of them stays, and it
    keeps all later ones from its words. Lines play no part, nor does ``longest``.
    """
    chosen, tags = [], []
    for m in _SPDX.finditer(text):
        expression = _expression(m["expression"])
        end = m.start("expression") + len(expression)
        stretch = " ".join(words_of(text[m.start() : end]))
        tags.append((m.start(), end))
        chosen.append((m.start(), end, " ".join(expression.split()), 0, scanner.reduction("spdx license identifier", stretch), []))
    words, starts, ends = _placed(text)
    taken = bytearray(len(words))
    for begin, end in tags:
        first, last = bisect_left(starts, begin), bisect_left(starts, end)
        taken[first:last] = b"\1" * (last - first)
    ranked = scanner.candidates(words)
    at_place = sorted(range(len(ranked)), key=lambda r: ranked[r][2])
    places = [ranked[r][2] for r in at_place]
    widest = max((len(c[3]) for c in ranked), default=0)

    def confirmed(rank: int) -> tuple | None:
        """What orders winners, best first, and the stretch; None if the block has no notice, or one on taken words."""
        saved, entry, first, block = ranked[rank]
        fitted = None if all(taken[first : first + len(block)]) else scanner.fit(entry, block)
        if fitted is None:
            return None
        begin, end, equal, reduction, diff = fitted
        begin, end = first + begin, first + end
        if any(taken[begin:end]) or _DENIED.search(text, max(0, starts[begin] - 40), starts[begin]):
            return None
        name, i = scanner.entries[entry][:2]
        return (-equal, len(diff), -saved, name, i, begin), end, reduction, diff

    rank = 0
    while rank < len(ranked):
        top = confirmed(rank)
        if top is None:
            rank += 1
            continue
        first, last = top[0][-1], top[1]
        around = at_place[bisect_left(places, first - widest) : bisect_left(places, last)]
        winners = [c for r in around if ranked[r][0] >= NEAR * ranked[rank][0] and (c := confirmed(r)) and c[0][-1] < last and c[1] > first]
        (_, _, _, name, i, begin), end, reduction, diff = min([top, *winners], key=lambda c: c[0])
        taken[begin:end] = b"\1" * (end - begin)
        chosen.append((starts[begin], _CLOSING.match(text, ends[end - 1]).end(), name, i, reduction, diff))
    for start, end, name, i, reduction, diff in sorted(chosen, key=lambda c: c[0]):
        yield name, i, start, end - start, reduction, not diff, diff, text[start:end]


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = 0.2, tolerated: float = 0.1) -> DataFrame:
    """One row for each license notice in the texts.

    Each template is cut into pieces, one more than words of it may differ; wherever a text
    holds a piece, the words around it, as many as the template may span, are a candidate
    block of that template (no other template could be confirmed there). Each block is
    compressed without and with the template as raw dictionary, and the bytes saved rank
    the templates. In that order blocks are confirmed word by word: at most the share
    ``tolerated`` of the words may differ, and none of those that decide the license
    (numbers, ``nc``, ``lesser`` and the like). ``reduction`` is the share saved of the
    confirmed stretch alone, which must be ``least`` or more; ``differences`` has what differs.

    ``SPDX-License-Identifier:`` with any expression has a row of its own: ``license`` is the
    expression as written, ``template`` 0, and ``reduction`` that of the tag, whatever it is.

    * Stretches begin and end anywhere, within a line or over several; line ends, capitals
      and marks between words (as of comments) cost nothing.
    * Of confirmed stretches that overlap stays the one whose template saves most bytes; among
      those that save nearly as much (``NEAR``) the one with most words equal to its template's,
      fewer differences, more bytes saved, the license that sorts first.
    * A stretch after "not" or "never", one word between at most, is no notice.
    * Null, empty or blank text: no rows. Very long texts are read whole.
    * Null ``doc_id`` and repeated rows have rows of their own. Other columns play no part.
    """
    small_batches(docs.sparkSession)
    templates = dict(templates)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, tolerated)
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, template, start, length, reduction, exact, diff, block in scan_text(scanner, text):
                    told = [dict(zip(("kind", "template_words", "text_words"), d)) for d in diff]
                    rows.append((doc_id, name, template, start, length, round(reduction, 6), exact, told, block))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(_DIFFERENCE), pa.string())
            columns = list(zip(*rows)) or [()] * len(kinds)
            names = ["doc_id", "license", "template", "start", "length", "reduction", "exact", "differences", "block"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.filter(F.col("text").rlike(needles(templates, tolerated))).mapInArrow(search, COLUMNS)
