"""Licence texts in documents, found with a generalised suffix automaton of template tokens.

All templates go into one automaton over word ids. A document's words stream through it; at each word the automaton
knows the longest run of words ending there that occurs in any template (the matching statistics). Long runs are chained
per template, in order in both texts and cut where they would overlap in either. The share of the template that the best chain
covers is its score; the stretches of the document in that chain are its covered spans. Where templates of two labels claim the same
words (notices that differ in a version), the one with more of its words there has them. The automaton depends on the templates
alone and its size is linear in theirs; ``templates`` takes more of them.

Defined results: a null text counts as empty and has no words; a document without phrase or template has empty labels and spans, null
places and score 0; of several places where a template stands, its spans name one; ties between chains go to the earlier one, between
templates to the first in the list; repeated rows are scanned alike; an empty table gives an empty result; only the id and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tallyveer.llm.common import per_text, scored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases whose places are counted.
PHRASES = (
    ("mit", "the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Notices and opening passages of public licences.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "mit",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    (
        "apache-2",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License",
    ),
    (
        "bsd",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    (
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version",
    ),
    (
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version",
    ),
)

#: A run of this many words is worth chaining; a label needs this share of one template.
RUN_WORDS = 4
COVERED = 0.8


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8."""
    return WORD.findall(text.encode().lower())


class SuffixAutomaton:
    """Generalised suffix automaton of several sequences, with the places where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for s, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((s, i))
        # a state also ends wherever the states hanging below it end
        for state in sorted(range(1, len(self.length)), key=lambda x: -self.length[x]):
            if self.link[state] > 0:
                parent = self.link[state]
                self.ends[parent] = sorted({*self.ends[parent], *self.ends[state]})

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, before: int, token: int, old: int) -> int:
        copy = self._new(self.length[before] + 1, self.link[old], dict(self.next[old]))
        while before >= 0 and self.next[before].get(token) == old:
            self.next[before][token] = copy
            before = self.link[before]
        self.link[old] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:  # another sequence went this way
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        state, before = self._new(self.length[last] + 1, 0, {}), last
        while before >= 0 and token not in self.next[before]:
            self.next[before][token] = state
            before = self.link[before]
        if before >= 0:
            old = self.next[before][token]
            fits = self.length[old] == self.length[before] + 1
            self.link[state] = old if fits else self._split(before, token, old)
        return state

    def statistics(self, tokens: list[int]):
        """(state, longest run ending here) after each token."""
        state = run = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if token in self.next[state]:
                state, run = self.next[state][token], run + 1
            yield state, run


class Scanner:
    """Phrases and templates, ready to scan."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, run_words: int = RUN_WORDS, covered: float = COVERED):
        self.ids: dict[bytes, int] = {}
        number = lambda w: self.ids.setdefault(w, len(self.ids))
        self.phrases = [(label, [number(w) for w in words_of(p)]) for label, p in phrases]
        self.templates = [(label, [number(w) for w in words_of(t)]) for label, t in templates]
        self.automaton = SuffixAutomaton([t for _, t in self.templates])
        self.run_words, self.covered = run_words, covered
        self.shortest = min(run_words, *(len(p) for _, p in self.phrases))

    def runs(self, words: list[bytes]):
        """Stretches of known words that are long enough to hold a phrase or a run: (start, ids)."""
        get, start, ids = self.ids.get, 0, []
        for i, token in enumerate(map(get, words)):
            if token is None:
                if len(ids) >= self.shortest:
                    yield start, ids
                if ids:
                    ids = []
            else:
                if not ids:
                    start = i
                ids.append(token)
        if len(ids) >= self.shortest:
            yield start, ids

    def matches(self, start: int, ids: list[int]):
        """Longest runs as (first word, first template word, words, template)."""
        found = list(self.automaton.statistics(ids))
        for i, (state, run) in enumerate(found):
            longer = i + 1 < len(found) and found[i + 1][1] == run + 1
            if run >= self.run_words and not longer:
                for template, end in self.automaton.ends[state]:
                    yield start + i - run + 1, end - run + 1, run, template

    def chained(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, list[tuple[int, int]]]]:
        """Most template words that matches in order cover, and the stretches of words that do, per template."""
        per: dict[int, list[tuple[int, int, int]]] = {}
        for first, at, run, template in matches:
            per.setdefault(template, []).append((first, at, run))
        return {t: self._best_chain(sorted(own), len(self.templates[t][1])) for t, own in per.items()}

    @staticmethod
    def _best_chain(own: list[tuple[int, int, int]], size: int) -> tuple[int, list[tuple[int, int]]]:
        # by template word: words covered by the best chain so far that ends there or before, and its last stretch, where
        # a stretch is (stretch before, first word, end)
        reach: list[tuple[int, tuple | None]] = [(0, None)] * (size + 1)
        for first, at, run in own:
            total, chain = 0, None
            for end in range(at, at + run):
                covered, before = reach[end]
                cut = max(end - at, before[2] - first if before else 0)
                if cut < run and covered + run - cut > total:
                    total, chain = covered + run - cut, (before, first + cut, first + run)
            for end in range(at + run, size + 1):
                if reach[end][0] >= total:
                    break
                reach[end] = total, chain
        total, chain = reach[size]
        spans: list[tuple[int, int]] = []
        while chain:
            before, start, end = chain
            if spans and spans[-1][0] == end:  # went on in the next match
                start, end = start, spans.pop()[1]
            spans.append((start, end))
            chain = before
        return total, spans[::-1]

    def covering(self, chains: dict[int, tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, str]]:
        """Spans as (first word, end, label) of the templates that are covered enough and have most of their words to themselves."""
        enough = [(t, n, spans) for t, (n, spans) in chains.items() if n >= self.covered * len(self.templates[t][1])]
        owner: dict[int, str] = {}
        out = set()
        for t, n, spans in sorted(enough, key=lambda c: (-c[1], -c[1] / len(self.templates[c[0]][1]), c[0])):
            label = self.templates[t][0]
            words = [w for a, b in spans for w in range(a, b)]
            if 2 * sum(owner.get(w, label) != label for w in words) <= n:
                owner |= {w: owner.get(w, label) for w in words}
                out |= {(a, b, label) for a, b in spans}
        return sorted(out)

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float, str]:
        words = words_of(text)
        places, base, matches = [], set(), []
        for start, ids in self.runs(words):
            for label, phrase in self.phrases:
                n = len(phrase)
                hits = [start + i for i in range(len(ids) - n + 1) if ids[i : i + n] == phrase]
                if hits:
                    base.add(label)
                    places += hits
            if len(ids) >= self.run_words:
                matches += self.matches(start, ids)
        chains = self.chained(matches)
        spans = self.covering(chains)
        labels = base | {label for _, _, label in spans}
        return (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            max((n / len(self.templates[t][1]) for t, (n, _) in chains.items()), default=0.0),
            ",".join(f"{label}:{a}:{b}" for a, b, label in spans),
        )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Words, places of the phrases, labels, the best covered share and covered spans (label:first word:end) of each document."""
    fields = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans string"
    )
    return scored(docs, per_text(lambda: Scanner(**settings).scan, fields), key, text)
