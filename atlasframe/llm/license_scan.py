"""License scan: notice templates, compiled to automata over words.

Template markup: [[ words ]] may be missing, {{name:low-high}} stands for low to high words of any kind, all other
wording is mandatory and must match exactly, word for word, letter case and punctuation aside. A template becomes a
nondeterministic automaton whose arcs read one word each; it starts only near its anchor, the mandatory word that
tells most, so that texts without the anchor cost no simulation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import ALNUM, Words, map_text, words_of

#: Phrases of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The wording of whole licenses as published.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
{{name:0-10}} to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the {{holder:1-12}} be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
BSD_3 = """[[3]] neither the name of {{holder:1-12}} nor the names of {{contributors:1-4}} may be used to endorse or promote products
derived from this software without specific prior written permission"""
BSD_END = """this software is provided by the {{holder:1-12}} as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the {{owner:1-12}} be liable for any
direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
the above copyright notice and this permission notice appear in all copies the software is provided as is and {{author:1-12}} disclaims all warranties
with regard to this software including all implied warranties of merchantability and fitness in no event shall {{owner:1-12}} be liable for any special
direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
negligence or other tortious action arising out of or in connection with the use or performance of this software"""
ZLIB = """this software is provided as is without any express or implied warranty in no event will the {{author:1-8}} be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications
and to alter it and redistribute it freely subject to the following restrictions"""
APACHE = """licensed under the Apache license version 2 0 the license you may not use {{what:1-4}} except in compliance with the license
you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org licenses license 2 0 [[unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license]]"""
UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
GPL = """is free software you can redistribute it and or modify it under the terms of the GNU general public license
[[version {{number:1-2}}]] as published by the free software foundation"""

#: Identifiers of the SPDX list, as words, with their labels.
SPDX = (
    ("MIT", "mit"), ("Apache 2 0", "apache-2"), ("BSD 2 Clause", "bsd-2"), ("BSD 3 Clause", "bsd-3"), ("ISC", "isc"), ("Zlib", "zlib"), ("Unlicense", "unlicense"), ("MPL 2 0", "mpl-2"), ("GPL 2 0", "gpl-2"), ("GPL 3 0", "gpl-3"), ("LGPL 2 1", "lgpl-2.1"),
    ("LGPL 3 0", "lgpl-3"), ("AGPL 3 0", "agpl-3"), ("CC0 1 0", "cc0"), ("CC BY 4 0", "cc-by"), ("CC BY SA 4 0", "cc-by-sa"), ("CC BY NC 4 0", "cc-by-nc"), ("CC BY NC SA 4 0", "cc-by-nc-sa"), ("CC BY NC ND 4 0", "cc-by-nc-nd"),
)

#: (label, anchor, template): whole licenses, then their notices.
TEMPLATES = (
    ("mit", "sublicense", MIT),
    ("bsd-2", "redistributions", f"{BSD} {BSD_END}"),
    ("bsd-3", "redistributions", f"{BSD} {BSD_3} {BSD_END}"),
    ("isc", "disclaims", ISC),
    ("zlib", "alter", ZLIB),
    ("apache-2", "apache", APACHE),
    ("unlicense", "unencumbered", UNLICENSE),
    ("gpl", "gnu", GPL),
    ("mit", "mit", "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] MIT license"),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{scope:0-60}} to deal in the software without restriction"),
    ("apache-2", "apache", "licensed under the Apache license [[the license]] version 2 [[0]]"),
    ("gpl-2", "gnu", "under the [[terms of the]] GNU general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3", "gnu", "under the [[terms of the]] GNU general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or any later version]]"),
    ("lgpl", "lesser", "under the [[terms of the]] GNU lesser general public license"),
    ("lgpl-2.1", "lesser", "under the [[terms of the]] GNU lesser general public license [[as published by the free software foundation]] [[either]] version 2 1"),
    ("lgpl-3", "lesser", "under the [[terms of the]] GNU lesser general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("agpl", "affero", "under the [[terms of the]] GNU Affero general public license"),
    ("agpl-3", "affero", "under the [[terms of the]] GNU Affero general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("mpl-2", "mozilla", "subject to the terms of the Mozilla public license [[v]] [[version]] 2 [[0]]"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]"),
    ("isc", "isc", "under the [[terms of the]] ISC license"),
    ("cc-by-nc", "cc", "licensed under [[a]] CC BY NC [[{{variant:0-1}} 4 0]]"),
    ("cc-by-nc-sa", "cc", "licensed under [[a]] CC BY NC SA [[4 0]]"),
    ("cc-by-nc-nd", "cc", "licensed under [[a]] CC BY NC ND [[4 0]]"),
    ("cc-by-nc", "noncommercial", "under [[a]] [[the]] creative commons attribution noncommercial [[4 0]] [[international]] [[public]] license"),
    ("cc-by-nc-sa", "noncommercial", "under [[a]] [[the]] creative commons attribution noncommercial sharealike [[4 0]] [[international]] [[public]] license"),
    ("cc-by-nc-nd", "noncommercial", "under [[a]] [[the]] creative commons attribution noncommercial noderivatives [[4 0]] [[international]] [[public]] license"),
    ("cc-by", "cc", "licensed under [[a]] CC BY 4 0"),
    ("cc-by-sa", "cc", "licensed under [[a]] CC BY SA [[4 0]]"),
    ("cc0", "cc0", "under [[the]] CC0 [[1 0]]"),
    *((label, "spdx", f"SPDX license identifier {name}") for name, label in SPDX),
)


@dataclass(frozen=True)
class Automaton:
    """arcs[s]: (word or None for any, next state); states are closed over optional regions."""

    label: str
    anchor: str
    arcs: tuple
    starts: frozenset
    final: frozenset
    most: int


def compile_template(label: str, anchor: str, template: str) -> Automaton:
    parts = re.findall(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|\w+", template)
    arcs: list[list] = [[]]
    skips: dict[int, set] = {}
    opened: list[int] = []
    for x in parts:
        here = len(arcs) - 1
        if x == "[[":
            opened.append(here)
        elif x == "]]":
            skips.setdefault(opened.pop(), set()).add(here)
        elif x.startswith("{{"):
            low, high = map(int, x[:-2].partition(":")[2].split("-"))
            for k in range(high):
                arcs[-1].append((None, len(arcs)))
                arcs.append([])
                if k >= low:
                    skips.setdefault(here + k, set()).add(here + high)
        else:
            arcs[-1].append((x.lower(), len(arcs)))
            arcs.append([])

    def closed(states: set) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for t in skips.get(todo.pop(), ()):
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    last = len(arcs) - 1
    final = frozenset(s for s in range(len(arcs)) if last in closed({s}))
    return Automaton(label, anchor, tuple(tuple((w, closed({t})) for w, t in x) for x in arcs), closed({0}), final, last)


class Scanner:
    """All phrases and templates over the words of a chunk."""

    def __init__(self, phrases=None, templates=TEMPLATES):
        def hashes(words: list[str]) -> np.ndarray:
            raw = np.frombuffer(" ".join(words).encode(), np.uint8)
            return words_of(raw, np.array([0, len(raw)]), ALNUM).hash

        self.phrases = [(hashes(p.split()), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.automata = [compile_template(*t) for t in templates]
        vocabulary = sorted({w for a in self.automata for arcs in a.arcs for w, _ in arcs if w} | {a.anchor for a in self.automata})
        self.code = dict(zip(map(int, hashes(vocabulary)), vocabulary, strict=True))
        self.known = np.array(sorted(self.code), np.uint64)

    def places(self, words: Words) -> list[tuple[np.ndarray, str]]:
        """For each phrase the indices of words where it begins."""
        found = []
        for own, label in self.phrases:
            at = np.flatnonzero(words.hash[: len(words.hash) - len(own) + 1] == own[0]) if len(words.hash) >= len(own) else np.zeros(0, int)
            for k in range(1, len(own)):
                at = at[words.hash[at + k] == own[k]]
            found.append((at[words.row[at] == words.row[at + len(own) - 1]] if len(at) else at, label))
        return found

    def templates(self, words: Words) -> list[tuple[int, int, str, float]]:
        """(first word, end word, label, mandatory share of the span) of the longest acceptance from each start."""
        where = np.searchsorted(self.known, words.hash)
        where[where == len(self.known)] = 0
        hit = np.flatnonzero(self.known[where] == words.hash) if len(words.hash) else []
        text = {int(i): self.code[int(words.hash[i])] for i in hit}
        by_anchor: dict[str, list[int]] = {}
        for i, w in text.items():
            by_anchor.setdefault(w, []).append(i)
        found = []
        for a in self.automata:
            tried: set[int] = set()
            heads = {w for s in a.starts for w, _ in a.arcs[s] if w}
            for i in by_anchor.get(a.anchor, ()):
                low, high = words.bounds[words.row[i]], words.bounds[words.row[i] + 1]
                for start in range(max(low, i - a.most), i + 1):
                    if start not in tried and text.get(start) in heads:
                        tried.add(start)
                        best = self._run(a, text, start, high)
                        if best:
                            found.append((start, best[0], a.label, best[1]))
        return found

    @staticmethod
    def _run(a: Automaton, text: dict, start: int, high: int) -> tuple[int, float] | None:
        now, best, at = {s: 0 for s in a.starts}, None, start
        while now and at < high:
            following: dict[int, int] = {}
            word = text.get(at)
            for s, said in now.items():
                for w, targets in a.arcs[s]:
                    if w is None or w == word:
                        for t in targets:
                            following[t] = max(following.get(t, 0), said + (w is not None))
            now, at = following, at + 1
            done = [said for s, said in now.items() if s in a.final]
            if done:
                best = (at, max(done) / (at - start))
        return best


def scan_licenses(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text", phrases: dict | None = None, templates: tuple = TEMPLATES) -> DataFrame:
    """keep columns and, per text: n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches holds each template's acceptances (label, first word, end word). labels joins those of phrases and
    templates. score is the largest mandatory share of a match: 1 for exact wording, less where replaceable regions
    were filled, 0 without a match. A null or empty text has no words, no labels and null first_word and last_word.
    """

    def make():
        scanner = Scanner(phrases, templates)

        def f(data, offsets):
            words = words_of(data, offsets, ALNUM)
            n = len(offsets) - 1
            count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            base: list[set] = [set() for _ in range(n)]
            score, own = np.zeros(n), [set() for _ in range(n)]
            matches: list[list] = [[] for _ in range(n)]
            for at, label in scanner.places(words):
                rows = words.row[at]
                np.add.at(count, rows, 1)
                np.minimum.at(first, rows, at - words.bounds[rows])
                np.maximum.at(last, rows, at - words.bounds[rows])
                for r in np.unique(rows):
                    base[r].add(label)
                    score[r] = 1.0
            for start, end, label, share in scanner.templates(words):
                r = words.row[start]
                own[r].add(label)
                score[r] = max(score[r], share)
                matches[r].append({"label": label, "first": start - words.bounds[r], "end": end - words.bounds[r]})
            none = count == 0
            return [
                pa.array(np.diff(words.bounds).astype(np.int64)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, own, strict=True)]), pa.array(score),
                pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))),
            ]

        return f

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,end:long>>"
    return map_text(docs, text, keep, fields, make)
