"""License scans by matching template markup.

A template is license wording with marked regions: ``<<opt>>...<</opt>>`` may be missing, ``<<var:N>>`` stands
for up to N replaceable words. Templates compile to token automata; a place in a text is accepted when the
mandatory wording matches word for word around such regions. One automaton runs all templates over a
text in one pass and starts only at words a template can begin with, in texts that have all its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.files import free_name
from hearthline.llm.words import covered, phrase, words_of

#: Plain phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by label: fixed wording of public licenses, with regions that may be missing or replaced.
TEMPLATES = {
    "apache-2.0": "<<opt>>licensed<</opt>> under the apache license <<opt>>version<</opt>> 2.0",
    "apache-2.0-header": "licensed under the apache license version 2.0 the license you may not use this file except in "
    "compliance with the license you may obtain a copy of the license at <<var:12>> unless required by applicable law or "
    "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
    "conditions of any kind either express or implied",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met",
    "bsd-notice": "<<opt>>licensed<</opt>> <<opt>>released<</opt>> under <<opt>>the<</opt>> <<opt>>2<</opt>> <<opt>>3<</opt>> "
    "<<opt>>clause<</opt>> bsd license",
    "cc-by-4.0": "creative commons attribution <<opt>>4.0<</opt>> international <<opt>>public<</opt>> license",
    "cc-by-sa": "cc by sa <<opt>>4.0<</opt>> <<opt>>3.0<</opt>>",
    "cc0-1.0": "cc0 1.0 universal",
    "copyright": "copyright <<opt>>c<</opt>> <<opt>>©<</opt>> <<var:12>> all rights reserved",
    "gpl-3.0": "gnu general public license <<opt>>as published by the free software foundation <<opt>>either<</opt>><</opt>> "
    "version 3",
    "gpl-2.0": "gnu general public license <<opt>>as published by the free software foundation <<opt>>either<</opt>><</opt>> "
    "version 2",
    "isc": "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee "
    "is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "gnu lesser general public license",
    "mit": "<<opt>>licensed<</opt>> <<opt>>released<</opt>> under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of <<var:6>> software and "
    "associated documentation files the software to deal in the software without restriction",
    "mpl-2.0": "subject to the terms of the mozilla public license <<opt>>v<</opt>> <<opt>>version<</opt>> 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Whole license texts, fixed wording: conditions and disclaimers are mandatory, names and list marks are regions.
BSD_OPENING = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met <<var:1>> redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer <<var:1>> redistributions in binary form must reproduce the above copyright notice
this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
BSD_CLOSING = """this software is provided by <<var:20>> as is and any express or implied warranties including but not limited to the
implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:20>> be
liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement
of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of
this software even if advised of the possibility of such damage"""
BODIES = {
    "bsd-2-clause-whole": f"{BSD_OPENING} {BSD_CLOSING}",
    "bsd-3-clause-whole": f"""{BSD_OPENING} <<var:1>> neither the name of <<var:20>> nor the names of <<opt>>its<</opt>>
<<opt>>the<</opt>> contributors may be used to endorse or promote products derived from this software without specific prior
written permission {BSD_CLOSING}""",
    "isc-whole": """permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without
fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is
provided as is and <<var:12>> disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall <<var:12>> be liable for any special direct indirect or consequential damages or
any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
action arising out of or in connection with the use or performance of this software""",
    "mit-whole": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to use
copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including
the next paragraph<</opt>> shall be included in all copies or substantial portions of the software the software is provided as
is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a
particular purpose and noninfringement in no event shall <<var:20>> be liable for any claim damages or other liability whether
in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
in the software""",
    "zlib-whole": """this software is provided as is without any express or implied warranty in no event will <<var:12>> be held
liable for any damages arising from the use of this software permission is granted to anyone to use this software for any
purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
<<var:1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you
use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<var:1>>
altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<var:1>>
this notice may not be removed or altered from any source distribution""",
}

#: Typographic quotes that stand against words, as in “as is”.
QUOTES = re.compile(b"|".join(q.encode() for q in "“”‘’«»„"))

MARK = re.compile(r"<<opt>>|<</opt>>|<<var:(\d+)>>")


@dataclass
class Automaton:
    """``steps[state]``: words that lead on; ``skips``: states reached without a word; ``wild``: by any word."""

    label: str
    steps: list[dict[bytes, int]]
    skips: list[list[int]]
    wild: list[int | None]
    end: int
    needed: frozenset[bytes]

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out


def compile_template(label: str, text: str) -> Automaton:
    """Token automaton of a template; optional regions nest. A template needs a mandatory word."""
    steps: list[dict[bytes, int]] = [{}]
    skips: list[list[int]] = [[]]
    wild: list[int | None] = [None]
    needed: set[bytes] = set()
    open_: list[int] = []

    def new() -> int:
        steps.append({})
        skips.append([])
        wild.append(None)
        return len(steps) - 1

    def add(words: str) -> None:
        for w in phrase(words):
            last = len(steps) - 1
            steps[last][w] = new()
            if not open_:
                needed.add(w)

    at = 0
    for mark in MARK.finditer(text):
        add(text[at:mark.start()])
        at = mark.end()
        if mark[0] == "<<opt>>":
            last = len(steps) - 1
            open_.append(last)
            skips[last].append(new())
        elif mark[0] == "<</opt>>":
            begin, last = open_.pop(), len(steps) - 1
            out = new()
            skips[last].append(out)
            skips[begin].append(out)
        else:
            first = len(steps) - 1
            ways = [first]
            for _ in range(int(mark[1])):
                last = len(steps) - 1
                wild[last] = new()
                ways.append(len(steps) - 1)
            out = new()
            for s in ways:
                skips[s].append(out)
    add(text[at:])
    if open_ or not needed:
        raise ValueError(f"template {label!r} has an open region or no mandatory word")
    return Automaton(label, steps, skips, wild, len(steps) - 1, frozenset(needed))


class Scanner:
    """All templates over one text."""

    def __init__(self, templates: dict[str, str] | None = None, base: dict[str, str] | None = None):
        self.base = [(phrase(p), label) for p, label in (BASE if base is None else base).items()]
        self.automata = [compile_template(k, v) for k, v in (TEMPLATES | BODIES if templates is None else templates).items()]
        self.starts = []
        for a in self.automata:
            first = a.closure({0})
            if any(a.wild[s] is not None for s in first) or a.end in first:
                raise ValueError(f"template {a.label!r} must begin with wording")
            self.starts.append((first, frozenset(w for s in first for w in a.steps[s])))

    def base_places(self, words: list[bytes], vocabulary: set[bytes]) -> Iterator[tuple[int, int, str]]:
        for p, label in self.base:
            if vocabulary.issuperset(p):
                at = -1
                while True:
                    try:
                        at = words.index(p[0], at + 1)
                    except ValueError:
                        break
                    if tuple(words[at:at + len(p)]) == p:
                        yield at, at + len(p), label

    def template_places(self, words: list[bytes], vocabulary: set[bytes]) -> Iterator[tuple[int, int, str]]:
        """Longest accepted places, leftmost first; places of one template do not overlap."""
        for a, (first, begins) in zip(self.automata, self.starts):
            if not vocabulary >= a.needed:
                continue
            live: dict[int, int] = {}  # state -> leftmost start
            best: tuple[int, int] | None = None
            for i, w in enumerate(words):
                if not live:
                    if best:
                        yield *best, a.label
                        best = None
                    if w not in begins:
                        continue
                if w in begins:
                    for s in first:
                        live.setdefault(s, i)
                moved: dict[int, int] = {}
                for s, start in live.items():
                    for t in (a.steps[s].get(w), a.wild[s]):
                        if t is not None:
                            for x in a.closure({t}):
                                if start < moved.get(x, i + 1):
                                    moved[x] = start
                live = moved
                if a.end in live:
                    start = live.pop(a.end)
                    if best and start >= best[1]:
                        yield *best, a.label
                        best = None
                    if not best or start <= best[0]:
                        best = (start, i + 1)
            if best:
                yield *best, a.label

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        words = words_of(text)
        vocabulary = set(words)
        base = list(self.base_places(words, vocabulary))
        if text and QUOTES.search(text):  # templates read words without quotes; places stay those of the words
            words = [QUOTES.sub(b"", w) for w in words]
            vocabulary = set(words)
        return len(words), base, list(self.template_places(words, vocabulary))


def scan_licenses(
    docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None,
    base: dict[str, str] | None = None,
) -> DataFrame:
    """Columns ``keep`` with n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Base places are all places of the plain phrases; first_word and last_word are their smallest and
    largest start (words from 0), null without one. labels adds the labels of accepted templates. score is the
    share of the text's words that lie in any place. places lists (label, first word, end word) of the
    accepted templates. Null and empty texts have no words, no labels and score 0. Rows are independent:
    repeated rows repeat their result, null ids pass through, an empty table gives none.
    """
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        places_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for x in batch.column(0):
                n, plain, found = scanner.scan(x.as_py())
                starts = [a for a, _, _ in plain]
                labels = {label for *_, label in plain}
                inside = covered([(a, b) for a, b, _ in plain + found])
                out.append((
                    n, len(plain), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(labels | {label for *_, label in found})), inside / n if n else 0.0,
                    [{"label": label, "first": a, "end": b} for a, b, label in found],
                ))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), places_type]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                [*batch.schema.names[1:], *"n_words n_base first_word last_word base_labels labels score places".split()],
            )

    return docs.select(F.col(text).cast("binary").alias(free_name(kept, "data")), *keep).mapInArrow(
        run, f"{schema}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, places array<struct<label: string, first: bigint, end: bigint>>",
    )
