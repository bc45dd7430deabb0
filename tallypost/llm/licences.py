"""Licence scans with a generalised suffix automaton over the words of licence templates.

A text is streamed through the automaton, which gives at each word the longest run ending
there that occurs in some template (matching statistics). Runs that cannot be lengthened are
matches; matches of a template that follow each other in text and template are chained, and
a chain that covers enough of its template is a span with the template's label. Phrases are
templates too: their places are read off the same states.

Words of a text that stand in no template, or next to each other in none, end every run, so
only stretches between them pass through the automaton.
"""

from __future__ import annotations

from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .staging import packed, prepared, unpacked
from .text import ALNUM, LOWER, Slice, slices, span_hashes, words

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as their licences ask to put them on works, and the paragraphs of short licences.
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
            "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
            "License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("mit", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
            "above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
            "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
            "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
            "OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
            "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
]

LEAST_MATCH, MOST_GAP, LEAST_COVER = 4, 12, 0.6


def _slice(text: str) -> Slice:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return Slice(0, data, np.array([0, len(data)]))


def word_hashes(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    low = Slice(s.row, LOWER[s.data], s.offsets)
    w = words(low, ALNUM)
    return span_hashes(low.data, w.start, w.end), w.first


class Match(NamedTuple):
    end: int
    length: int
    state: int


class Automaton:
    """Suffix automaton of several word sequences, with the places each state ends at."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        hashed = [word_hashes(_slice(text))[0] for _, text in templates]
        phrase_words = [word_hashes(_slice(text))[0] for text in phrases]
        self.vocabulary = np.unique(np.concatenate([*hashed, *phrase_words]))
        self.labels = [label for label, _ in templates]
        self.sizes = [len(h) for h in hashed]
        self.phrase_labels = list(phrases.values())
        number = lambda h: np.searchsorted(self.vocabulary, h).tolist()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        sequences = [number(h) for h in (*hashed, *phrase_words)]
        for t, sequence in enumerate(sequences):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for t, sequence in enumerate(sequences[: len(hashed)]):
            state = 0
            for place, word in enumerate(sequence):
                state = self.next[state][word]
                at = state
                while at > 0:
                    self.ends[at].append((t, place + 1))
                    at = self.link[at]
        # phrases that end where a state does, by length
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        own = {}
        for p, sequence in enumerate(sequences[len(hashed):]):
            state = 0
            for word in sequence:
                state = self.next[state][word]
            own.setdefault(state, []).append((len(sequence), p))
        for state in range(len(self.next)):
            at = state
            while at > 0:
                self.phrases[state] += own.get(at, [])
                at = self.link[at]
        size = len(self.vocabulary)
        pairs = {a * size + b for s in sequences for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs))
        self.phrase_pairs = np.array(sorted({s[0] * size + s[1] for s in sequences[len(hashed):]}))

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the runs as long as p's and one word; the shorter ones move to it."""
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def scan(self, stretch: list[int]) -> tuple[list[tuple[int, int]], list[Match]]:
        """(start, phrase) of all phrases, and the matches that cannot be lengthened, in order."""
        state, length = 0, 0
        places: list[tuple[int, int]] = []
        matches: list[Match] = []
        for i, word in enumerate(stretch):
            before = Match(i, length, state)
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if before.length and length <= before.length:
                matches.append(before)
            places += [(i + 1 - size, p) for size, p in self.phrases[state] if size <= length]
        if length:
            matches.append(Match(len(stretch), length, state))
        return places, matches

    def spans(self, matches: list[Match], least: int, gap: int, cover: float) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, covered share) of chains that cover enough."""
        chains: dict[int, list[int]] = {}  # template: first, end, end in the template, covered
        out = []

        def close(t: int) -> None:
            first, end, _, covered = chains.pop(t)
            share = covered / self.sizes[t]
            if share >= cover:
                out.append((t, first, end, share))

        for m in matches:
            # a short match counts only where it is a whole template
            places = [(t, x) for t, x in self.ends[m.state] if m.length >= min(least, self.sizes[t])]
            seen = set()
            for t, place in places:
                if t in seen:
                    continue
                chain = chains.get(t)
                if chain and (m.end - m.length - chain[1] > gap or place <= chain[2]):
                    later = [x for u, x in places if u == t and x > chain[2]]
                    if m.end - m.length - chain[1] <= gap and later:
                        place = min(later)
                    else:
                        close(t)
                        chain = None
                seen.add(t)
                if chain is None:
                    chains[t] = [m.end - m.length, m.end, place, m.length]
                else:
                    chain[3] += min(m.length, place - chain[2], m.end - chain[1])
                    chain[1], chain[2] = m.end, place
        for t in list(chains):
            close(t)
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _stretches(automaton: Automaton, numbers: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Word ranges worth a scan: neighbours that some template has, long enough or with a phrase's start."""
    size = len(automaton.vocabulary)
    known = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < len(numbers))]
    known[inner - 1] = False  # the next text begins there
    pair = np.where(known, numbers[:-1] * size + numbers[1:], -1)
    good = np.isin(pair, automaton.pairs)
    begins = np.flatnonzero(good & ~np.concatenate([[False], good[:-1]]))
    ends = np.flatnonzero(good & ~np.concatenate([good[1:], [False]]))
    starts_phrase = np.concatenate([[0], np.cumsum(np.isin(pair, automaton.phrase_pairs))])
    worth = (ends - begins + 2 >= least) | (starts_phrase[ends + 1] > starts_phrase[begins])
    return list(zip(begins[worth].tolist(), (ends[worth] + 2).tolist()))


_SPAN = T.ArrayType(
    T.StructType().add("label", T.StringType()).add("first_word", T.LongType()).add("end_word", T.LongType())
    .add("covered", T.DoubleType())
)
_ADDED = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("licence_spans", _SPAN),
]


def _scanned(templates, phrases, least: int, gap: int, cover: float):
    kinds = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("licence_spans", pa.list_(pa.struct([
            ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64()),
        ]))),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, phrases)
        vocabulary = automaton.vocabulary
        for b in batches:
            rows = []
            for s in slices(b.column("_text")):
                h, first = word_hashes(s)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                numbers = np.where(vocabulary[at] == h, at, -1)
                found: dict[int, tuple[list, list]] = {}
                for a, e in _stretches(automaton, numbers, first, least) if len(numbers) > 1 else ():
                    text = int(np.searchsorted(first, a, "right")) - 1
                    shift = a - int(first[text])
                    places, matches = automaton.scan(numbers[a:e].tolist())
                    own = found.setdefault(text, ([], []))
                    own[0].extend((start + shift, p) for start, p in places)
                    own[1].extend(Match(m.end + shift, m.length, m.state) for m in matches)
                for i, n in enumerate(np.diff(first).tolist()):
                    places, matches = found.get(i, ([], []))
                    spans = automaton.spans(matches, least, gap, cover)
                    base = {automaton.phrase_labels[p] for _, p in places}
                    starts = [start for start, _ in places]
                    rows.append({
                        "n_words": n, "n_base": len(places), "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {automaton.labels[t] for t, *_ in spans})),
                        "score": 1.0 if base else max((min(1.0, x[3]) for x in spans), default=0.0),
                        "licence_spans": [
                            {"label": automaton.labels[t], "first_word": x, "end_word": y, "covered": min(1.0, c)}
                            for t, x, y, c in spans
                        ],
                    })
            more = pa.RecordBatch.from_pylist(rows, schema=kinds)
            base_columns = b.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays(
                [*base_columns.columns, *more.columns], names=[*base_columns.schema.names, *more.schema.names]
            )

    return run


def scan_licences(
    docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None, least: int = LEAST_MATCH, gap: int = MOST_GAP, cover: float = LEAST_COVER,
) -> DataFrame:
    """All rows of `docs` without the text, and what licences it names or quotes.

    Words are runs of digits, letters and characters outside ASCII; A-Z count as a-z. Added:
    n_words; n_base, first_word, last_word: the places where a phrase's words stand one after
    the other, and the smallest and largest of their starts (null without any); base_labels;
    licence_spans: chains of matches of at least `least` words (or a whole template), at most
    `gap` words apart, that cover `cover` of a template; labels: those of phrases and spans,
    distinct, sorted, joined by commas; score: 1 with a phrase, else the best cover. Known are
    the phrases, the notices of GPL, Apache and Creative Commons, and the whole MIT, BSD and
    ISC terms; other paragraphs of long licences are not recognised. Null and
    empty texts have no words and no labels. Repeated rows are scanned each for itself. The
    added columns replace input columns of the same name.
    """
    prepared(docs.sparkSession)
    rows = packed(docs, text_col).select("_rest", F.col(text_col).alias("_text"))
    run = _scanned(templates or TEMPLATES, phrases or PHRASES, least, gap, cover)
    out = rows.mapInArrow(run, T.StructType([rows.schema["_rest"], *_ADDED]))
    return unpacked(out, docs.drop(text_col), [f.name for f in _ADDED])
