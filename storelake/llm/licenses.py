"""Licence scans: a generalised suffix automaton of licence templates.

Words are lower-cased (A-Z) runs of letters, digits and characters outside ASCII. The
automaton holds every run of words of every template; reading a document word by
word it gives the matching statistics: at each word the length of the longest run
ending there that some template contains, and which templates contain it. Maximal
matches of ``anchor`` words or more (or of a whole phrase) are chained along a template (order kept,
gaps of at most ``gap`` words) into spans; a template counts as present if its
chain covers ``cover`` of its words. The score is the best share covered.

Only words that occur in templates reach the automaton; runs of such words shorter
than the shortest anchor are passed over. Documents are scanned where they lie:
no shuffle, and the automaton's size is bounded by the templates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.llm.common import LOWER, STEP, buffers, plain, ship, slices, span_hashes, text_of, words

# Fixed values (contract): base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening passages and notices of public licences, by label.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
}

IS_WORD = np.ones(256, bool)
IS_WORD[:0x80] = False
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True

ANCHOR, GAP, COVER = 3, 3, 0.75


class SuffixAutomaton:
    """All runs of words of several sequences; each state knows the first place its run ends in each sequence."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # sequence -> ends of the state's run in it
        for number, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, []).append(end + 1)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            if self.link[state]:
                for number, ends in self.ends[state].items():
                    up[number] = sorted({*up.get(number, ()), *ends})

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # a run that an earlier sequence has already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        now, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return now

    def matches(self, sequence: list[int]) -> list[tuple[int, int]]:
        """Matching statistics: (state, length) after each word."""
        out, state, size = [], 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(word)
            state, size = (to, size + 1) if to is not None else (0, 0)
            out.append((state, size))
        return out


class Scanner:
    """The automaton of all templates and base phrases, and the scan of one run of words."""

    def __init__(self, templates: dict[str, list[str]], base: dict[str, str], anchor: int, gap: int, cover: float) -> None:
        self.anchor, self.gap, self.cover = anchor, gap, cover
        said = [(label, text, False) for label, texts in sorted(templates.items()) for text in texts]
        said += [(label, phrase, True) for phrase, label in base.items()]
        split = [[w for w in _words(text)] for _, text, _ in said]
        vocabulary = sorted({w for x in split for w in x})
        self.hashes = _hash(vocabulary)
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        number = {vocabulary[v]: i for i, v in enumerate(order.tolist())}
        self.spelling = [vocabulary[v] for v in order.tolist()]
        self.labels, self.is_base = [x[0] for x in said], [x[2] for x in said]
        self.sizes = [len(x) for x in split]
        self.automaton = SuffixAutomaton([[number[w] for w in x] for x in split])
        self.shortest = min([anchor, *self.sizes])

    def scan(self, run: list[int], at: int) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Base places (start, label) and anchors (template, start in it, start in the text, words) of a run that starts at word ``at``."""
        base, anchors = [], []
        found = self.automaton.matches(run)
        for i, (state, size) in enumerate(found):
            # a base phrase ends here if the state or one it links to is the whole phrase
            s, n = state, size
            while s:
                for number, ends in self.automaton.ends[s].items():
                    if self.is_base[number] and self.sizes[number] <= n and ends[-1] == self.sizes[number]:
                        base.append((at + i + 1 - self.sizes[number], self.labels[number], number))
                s = self.automaton.link[s]
                n = self.automaton.length[s] if s else 0
            if size and (i + 1 == len(found) or found[i + 1][1] <= size):  # a maximal match
                for number, ends in self.automaton.ends[state].items():
                    if not self.is_base[number] and size >= min(self.anchor, self.sizes[number]):
                        anchors += [(number, end - size, at + i + 1 - size, size) for end in ends]
        return sorted({(a, label, n) for a, label, n in base}), anchors

    def chains(self, anchors: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, share covered) of the best chains, one after another along the text."""
        out, by = [], {}
        for number, a, x, n in anchors:
            by.setdefault(number, []).append((x, a, n))
        for number, mine in by.items():
            mine.sort()
            best: list[tuple[int, int]] = []  # words covered, and the anchor before
            for i, (x, a, n) in enumerate(mine):
                top = (n, -1)
                for j in range(i - 1, -1, -1):
                    y, b, m = mine[j]
                    if x - (y + m) > self.gap + self.sizes[number]:
                        break
                    if b < a and y < x and x - (y + m) <= self.gap and abs((x - y) - (a - b)) <= self.gap:
                        fresh = n - max(0, b + m - a, y + m - x)
                        if fresh > 0 and best[j][0] + fresh > top[0]:
                            top = (best[j][0] + fresh, j)
                best.append(top)
            taken: set[int] = set()
            for i in sorted(range(len(mine)), key=lambda i: (-best[i][0], mine[i][0])):
                if best[i][0] < self.cover * self.sizes[number]:
                    break
                path, j = [], i
                while j >= 0 and j not in taken:
                    path.append(j)
                    j = best[j][1]
                if j < 0:
                    taken.update(path)
                    out.append((self.labels[number], mine[path[-1]][0], mine[i][0] + mine[i][2], min(1.0, best[i][0] / self.sizes[number])))
        return sorted(out)


def _words(text: str) -> list[str]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), IS_WORD)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _hash(said: list[str]) -> np.ndarray:
    data, offsets = buffers(plain(pa.array(said, pa.large_string())))
    return span_hashes(data, offsets[:-1], offsets[1:])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))


def _scan(templates: dict, base: dict, anchor: int, gap: int, cover: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base, anchor, gap, cover)
        for batch in batches:
            data, offsets = buffers(plain(batch.column(1)))
            for i, j in slices(offsets, STEP):
                low = LOWER[data[offsets[i] : offsets[j]]]
                starts, ends, ranges = words(low, offsets[i : j + 1] - offsets[i], IS_WORD)
                h = span_hashes(low, starts, ends)
                place = np.minimum(np.searchsorted(scanner.hashes, h), len(scanner.hashes) - 1)
                known = scanner.hashes[place] == h
                # runs of template words inside a document
                edge = np.zeros(len(h) + 1, bool)
                edge[ranges] = True
                before = np.concatenate([[False], known[:-1]])
                first = np.flatnonzero(known & (~before | edge[:-1]))
                after = np.concatenate([known[1:], [False]])
                last = np.flatnonzero(known & (~after | edge[1:])) + 1
                long_enough = last - first >= scanner.shortest
                first, last = first[long_enough], last[long_enough]
                doc = np.searchsorted(ranges, first, "right") - 1
                found: dict[int, tuple[list, list]] = {}
                raw = low.tobytes()
                for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
                    run = place[a:b].tolist()
                    if any(raw[starts[a + k] : ends[a + k]].decode() != scanner.spelling[w] for k, w in enumerate(run)):
                        continue  # a word of another spelling with a template word's hash
                    base_here, anchors = scanner.scan(run, a - int(ranges[d]))
                    if base_here or anchors:
                        held = found.setdefault(d, ([], []))
                        held[0].extend(base_here)
                        held[1].extend(anchors)
                rows = []
                for d, n in enumerate(np.diff(ranges).tolist()):
                    base_here, anchors = found.get(d, ((), ()))
                    spans = scanner.chains(list(anchors)) if anchors else []
                    mine = sorted({label for _, label, _ in base_here})
                    every = sorted({*mine, *(s[0] for s in spans)})
                    at = [a for a, _, _ in base_here]
                    score = 1.0 if base_here else max([s[3] for s in spans], default=0.0)
                    rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(mine), ",".join(every), score, [dict(zip(("label", "start", "end", "covered"), s, strict=True)) for s in spans]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return scan


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None, anchor: int = ANCHOR, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans``.

    Base phrases count at every place where their words stand consecutively; ``first_word`` and
    ``last_word`` are their smallest and largest start (words from 0; else null). ``labels`` adds the
    templates whose chains cover enough; ``spans`` gives each chain's words. ``score`` is 1 where a
    base phrase stands, else the largest share covered. Null and empty texts have no words.
    Ids may be null or repeated; other columns are not read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, BASE if base is None else base, anchor, gap, cover), SCHEMA)
