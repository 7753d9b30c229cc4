"""License scan: phrases, and templates with optional and replaceable regions compiled to token automata."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segline.session import on_workers

from .arrow import batches_of, rows

#: Fixed values of the contract: a phrase's words and its label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Label and template. Words outside marks are mandatory; <<opt>>..<</opt>> may be missing as a whole;
#: <<var a-b>> takes any a to b words. Marks nest. A
#: licence's own text stands whole, with variables for names and holders and list marks optional. Wording is compared word by word, as the text's is cut.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license <<opt>>version<</opt>> 2 0"),
    ("mit", "<<opt>>released<</opt>> under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this <<var 1-4>> and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions <<opt>>1<</opt>> the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software "
        "<<opt>>2<</opt>> the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall <<var 1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("cc-by-nc-4.0", "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc <<opt>>version<</opt>> 4 0 <<opt>>international<</opt>> <<opt>>license<</opt>>"),
    ("cc-by-4.0", "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by <<opt>>version<</opt>> 4 0"),
    ("gpl-3.0", "licensed under the <<opt>>terms of the<</opt>> gnu <<opt>>affero<</opt>> <<opt>>lesser<</opt>> general public license <<opt>>as published by the free software foundation either<</opt>> version 3"),
    ("gpl-2.0", "licensed under the <<opt>>terms of the<</opt>> gnu <<opt>>lesser<</opt>> general public license <<opt>>as published by the free software foundation either<</opt>> version 2"),
    ("copyright-reserved", "copyright <<opt>>c<</opt>> <<var 1-8>> all rights reserved"),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<opt>>1<</opt>> <<opt>>a<</opt>> <<opt>>i<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<opt>>2<</opt>> <<opt>>b<</opt>> <<opt>>ii<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<opt>>3<</opt>> <<opt>>c<</opt>> <<opt>>iii<</opt>> neither the name of <<var 1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by <<var 1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall <<var 1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
]

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARK = re.compile(r"<<(/?)(opt|var)(?: (\d+)-(\d+))?>>")


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Automaton:
    """A template as a non-deterministic automaton over words.

    steps[state] are (word, next) with word None for any word; silent[state] are next states that cost no
    word: they skip an optional region or end a replaceable one. Every state is numbered in reading order,
    so all arcs go forward and a set of live states is advanced word by word.
    """

    def __init__(self, template: str):
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.silent: list[list[int]] = [[]]
        self.needed = 0
        opened: list[int] = []
        at = 0
        for found in [*_MARK.finditer(template), None]:
            for word in words_of(template[at : found.start() if found else len(template)]):
                self._add(word)
                self.needed += not opened
            if found is None:
                break
            at = found.end()
            close, kind, low, high = found.groups()
            if kind == "var":
                starts = []
                for k in range(int(high)):
                    if k >= int(low):
                        starts.append(len(self.steps) - 1)
                    self._add(None)
                for state in starts:
                    self.silent[state].append(len(self.steps) - 1)
            elif close:
                self.silent[opened.pop()].append(len(self.steps) - 1)
            else:
                opened.append(len(self.steps) - 1)
        if opened or not self.needed:
            raise ValueError(f"open region or no mandatory word: {template!r}")
        self.last = len(self.steps) - 1
        live, _ = self._closure({0})
        self.firsts = {w for s in live for w, _ in self.steps[s]}
        if None in self.firsts:
            raise ValueError(f"a template must start with wording: {template!r}")

    def _add(self, word: bytes | None) -> None:
        self.steps[-1].append((word, len(self.steps)))
        self.steps.append([])
        self.silent.append([])

    def _closure(self, states: set[int]) -> tuple[set[int], bool]:
        todo = list(states)
        while todo:
            for s in self.silent[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states, len(self.steps) - 1 in states

    def match(self, words: list[bytes], start: int) -> int:
        """Where the longest match from start ends; start if there is none."""
        live, done = self._closure({0})
        end = start
        for i in range(start, len(words)):
            live = {n for s in live for w, n in self.steps[s] if w is None or w == words[i]}
            if not live:
                break
            live, done = self._closure(live)
            if done:
                end = i + 1
        return end


class Scanner:
    """All templates at once: an index by first word names the automata worth trying at a place."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.automata = [(label, Automaton(t)) for label, t in templates]
        self.by_first: dict[bytes, list[int]] = defaultdict(list)
        for k, (_, a) in enumerate(self.automata):
            for w in a.firsts:
                self.by_first[w].append(k)
        self.phrases = [(words_of(p), label) for p, label in phrases]

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of every place of a phrase."""
        out = []
        for phrase, label in self.phrases:
            i, n = -1, len(phrase)
            while True:
                try:
                    i = words.index(phrase[0], i + 1)
                except ValueError:
                    break
                if words[i : i + n] == phrase:
                    out.append((i, label))
        return out

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, end, label) of every template's longest match at each place it starts from."""
        out = []
        present = set(words)
        for first, found in self.by_first.items():
            i = -1
            while first in present:
                try:
                    i = words.index(first, i + 1)
                except ValueError:
                    break
                for k in found:
                    label, a = self.automata[k]
                    if (end := a.match(words, i)) > i:
                        out.append((i, end, label))
        return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of docs.

    n_base counts all places of the phrases, first_word and last_word are their least and greatest start
    (else null). labels adds those of matched templates. score is the share of the text's words that lie
    in a phrase or a template's match: 1 for a bare license line, 0 for none or for an empty text.
    Null text: empty. Whole texts, no shuffle; repeated rows give repeated rows.
    """
    on_workers(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        scanner = Scanner()
        size = {label: len(p) for p, label in scanner.phrases}

        def found():
            for doc, text in rows(batches):
                words = words_of(text)
                base, more = scanner.places(words), scanner.matches(words)
                labels = {x for _, x in base}
                covered = {k for a, label in base for k in range(a, a + size[label])} | {k for a, b, _ in more for k in range(a, b)}
                yield (doc, len(words), len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None),
                       ",".join(sorted(labels)), ",".join(sorted(labels | {x for *_, x in more})), len(covered) / len(words) if words else 0.0)

        return batches_of(found(), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
