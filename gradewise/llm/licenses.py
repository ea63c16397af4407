"""Licence scan: seed words, a count of shared words, then banded alignment.

A text is reduced to its lower-case words of letters and digits.  A template of n words
may lose d = n - ceil(coverage * n) of them, so of any d + 1 of its words one must be in the
text, at its place up to the band, and of any d + m of them m must be: the 2d + 2 longest are
its seeds (all, if there are fewer).  An inverted index (seed word to templates) gives the
templates of which a text has enough seeds; shifts with enough of them on diagonals within the
band are candidates; those whose band does not hold enough of the template's words
are dropped, the others are aligned.  All steps only drop shifts that cannot reach the
coverage, so the result equals an alignment at every shift of every text; the alignment
gives the matched share of the template's words and the span in the text.  Of spans of one
template that overlap, the one with more matched words stays, then the shorter, then the first.

Templates are broadcast in blocks of at most ``BLOCK_BYTES`` of text; every
block is held against all texts, so any number of templates works.

Defined cases: null and empty texts have no matches; a template with no
letters or digits matches nothing; a template of fewer than ``SHORT`` letters and
digits is found only as its own whole run of words; repeated rows are reported each; several
copies of a template in one text are several rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.llm.words import Words, blocks, text_buffer, words_of

SHORT = 12  # templates of fewer letters and digits must be whole
COVERAGE = 0.8  # least matched share of a template's words
BAND = 12  # words that insertions may shift an alignment by
BLOCK_BYTES = 8 << 20
CELLS = 1 << 22  # template words times shifts looked at together

# Fixed texts: usual licence notices; ``license_texts`` has whole licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License "
                        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

# Further notices that the query looks for, close to those above.
NOTICES = {
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                   "Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "Affero General Public License as published by the Free Software Foundation",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                 "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def full_texts() -> dict[str, str]:
    """The whole licences that come with the package."""
    folder = resources.files("gradewise.llm") / "license_texts"
    return {f"{f.name.removesuffix('.txt')}-text": f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}


_KEPT = np.zeros(256, bool)
_KEPT[48:58] = _KEPT[65:91] = _KEPT[97:123] = _KEPT[128:] = True
_BREAKS = ~_KEPT


def align(template: list[bytes], text: list[bytes], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words, and the range [start, end) of matched text words, of the
    best alignment of the whole template with a part of ``text`` whose word i
    lies within ``band`` of place i + shift (match +1, gap -1/2)."""
    width = 2 * band + 1
    score = np.zeros(width)
    steps = []
    gap = 0.5
    for i, word in enumerate(template):
        new, step = np.full(width, -1e9), np.zeros(width, np.int8)
        for b in range(width):
            j = i + shift + b - band  # text word in this cell
            if not 0 <= j < len(text):
                new[b], step[b] = score[b] - gap, 4  # outside the text: no partner
                continue
            same = text[j] == word
            best, kind = score[b] + (1.0 if same else -gap), 1 if same else 4
            up = score[b + 1] - gap if b + 1 < width else -1e9
            if up > best:
                best, kind = up, 2
            if b and new[b - 1] - gap > best:
                best, kind = new[b - 1] - gap, 3
            new[b], step[b] = best, kind
        steps.append(step)
        score = new
    b, i = int(np.argmax(score)), len(template) - 1
    matched, places = 0, []
    while i >= 0:
        kind = steps[i][b]
        if kind in (1, 4):
            if kind == 1:
                matched += 1
                places.append(i + shift + b - band)
            i -= 1
        elif kind == 2:
            b, i = b + 1, i - 1
        else:
            b -= 1
    return matched, min(places, default=0), max(places, default=-1) + 1


def reach(template: np.ndarray, text: np.ndarray, lo: int, hi: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For the shifts lo to hi: how many of the template's words are in the
    text within ``band`` of their place, and the least diagonal of the band on
    which all of them are (or the greatest integer)."""
    n, width = len(template), 2 * band + 1
    diagonals = np.arange(lo - band, hi + band + 1)
    at = diagonals + np.arange(n)[:, None]
    same = (at >= 0) & (at < len(text)) & (text[np.clip(at, 0, len(text) - 1)] == template[:, None])
    total = np.zeros((n, len(diagonals) + 1), np.int32)
    np.cumsum(same, axis=1, out=total[:, 1:])
    found = (total[:, width:] > total[:, :-width]).sum(axis=0)
    whole = np.where(same.all(axis=0), diagonals, np.iinfo(np.int64).max)
    return found, np.lib.stride_tricks.sliding_window_view(whole, width).min(axis=1)


class TemplateIndex:
    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.names = sorted(n for n, t in templates.items() if t)
        words = words_of(pa.array([templates[n] for n in self.names], pa.string()), _BREAKS, lower=True)
        self.words = [[words.buf[a:b].tobytes() for a, b in zip(words.start[lo:hi], words.end[lo:hi])]
                      for lo, hi in zip(words.first[:-1], words.first[1:])]
        self.ids = {w: i for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.coded = [np.array([self.ids[w] for w in t], np.int64) for t in self.words]
        self.need = [max(math.ceil(coverage * len(t) - 1e-9), 1) for t in self.words]
        self.whole = {}  # short templates
        self.seeds: dict[int, dict[int, np.ndarray]] = {}  # template to word id to places
        self.least = np.zeros(len(self.names), np.int64)  # seeds that must be in a text
        codes = words.codes()
        counts: dict[int, dict[int, int]] = {}  # word code to template to number of places
        for i, t in enumerate(self.words):
            if t and sum(map(len, t)) < SHORT:
                self.whole[i] = t
            elif self.need[i] <= len(t):
                lost = len(t) - self.need[i]
                places = sorted(range(len(t)), key=lambda k: (-len(t[k]), k))[:2 * lost + 2]
                self.least[i] = len(places) - lost
                by: dict[int, list[int]] = {}
                for k in places:
                    by.setdefault(int(self.coded[i][k]), []).append(k)
                    owners = counts.setdefault(int(codes[words.first[i] + k]), {})
                    owners[i] = owners.get(i, 0) + 1
                self.seeds[i] = {w: np.array(ks, np.int64) for w, ks in by.items()}
        self.code = np.array(sorted(counts), np.uint64)
        flat = [(owner, n) for c in sorted(counts) for owner, n in sorted(counts[c].items())]
        self.owner, self.places = [np.array([x[k] for x in flat], np.int64) for k in (0, 1)]
        self.first = np.cumsum([0, *(len(counts[c]) for c in sorted(counts))])
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.code >> np.uint64(48)).astype(np.int64)] = True

    def _rows(self, w: Words) -> dict[int, list[int]]:
        """The templates of which a row has enough seeds, by row."""
        codes = w.codes()
        near = np.flatnonzero(self.seen[(codes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.code, codes[near])
        hit = np.flatnonzero(at < len(self.code))
        hit = hit[self.code[at[hit]] == codes[near[hit]]]
        row = np.searchsorted(w.first, near[hit], "right") - 1
        pairs = np.unique(row * max(len(self.code), 1) + at[hit])  # a word of a row, once
        row, word = np.divmod(pairs, max(len(self.code), 1))
        n = self.first[word + 1] - self.first[word]
        entry = np.repeat(self.first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keys, group = np.unique(np.repeat(row, n) * len(self.names) + self.owner[entry], return_inverse=True)
        total = np.bincount(group, weights=self.places[entry], minlength=len(keys))
        out: dict[int, list[int]] = {}
        for key in keys[total >= self.least[keys % max(len(self.names), 1)]].tolist():
            out.setdefault(key // len(self.names), []).append(key % len(self.names))
        return out

    def _aligned(self, template: int, text: list[bytes], coded: np.ndarray, band: int) -> Iterator[tuple]:
        """(matched, first word, end word) at every shift that reaches the coverage."""
        words, need, least = self.words[template], self.need[template], int(self.least[template])
        near = min(band, max(len(words) // 2, 1))
        step = max(CELLS // len(words), 1)
        diagonals = [(np.flatnonzero(coded == w)[:, None] - places).ravel() for w, places in self.seeds[template].items()]
        diagonals = np.sort(np.concatenate(diagonals))
        i = np.arange(max(len(diagonals) - least + 1, 0))
        i = i[diagonals[i + least - 1] - diagonals[i] <= 2 * near]
        done = -len(words) - near  # shifts up to here are done
        for lo, hi in zip((diagonals[i + least - 1] - near).tolist(), (diagonals[i] + near).tolist()):
            lo = max(lo, done + 1)
            for a in range(lo, hi + 1, step):
                b = min(a + step - 1, hi)
                found, whole = reach(self.coded[template], coded, a, b, near)
                for k in np.flatnonzero(found >= need):
                    if whole[k] < np.iinfo(np.int64).max:  # no alignment is better
                        yield len(words), int(whole[k]), int(whole[k]) + len(words)
                        continue
                    matched, first, end = align(words, text, a + int(k), near)
                    if matched >= need:
                        yield matched, first, end
            done = max(done, hi)

    def scan(self, part: pa.RecordBatch, band: int) -> Iterator[tuple]:
        """(row, template, matched, first word, end word, first byte, end byte)."""
        column = part.column("text")
        w = words_of(column, _BREAKS, lower=True)
        hits = self._rows(w)
        rows = set(hits)
        if self.whole:
            rows.update(range(part.num_rows))
        starts = text_buffer(column)[1]
        for r in sorted(rows):
            start, end = (x[w.first[r]:w.first[r + 1]] - starts[r] for x in (w.start, w.end))
            text = [w.buf[a + starts[r]:b + starts[r]].tobytes() for a, b in zip(start, end)]
            coded = np.array([self.ids.get(x, -1) for x in text], np.int64)
            found: dict[int, set[tuple[int, int, int]]] = {}
            for template in hits.get(r, []):
                found[template] = set(self._aligned(template, text, coded, band))
            for template, whole in self.whole.items():
                n = len(whole)
                found[template] = {(n, i, i + n) for i in range(len(text) - n + 1) if text[i:i + n] == whole}
            for template, spans in sorted(found.items()):
                for matched, a, z in apart(spans):
                    yield r, template, matched, a, z, int(start[a]), int(end[z - 1])


def apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping spans (matched, first word, end word) the best, in text order."""
    kept: list[tuple[int, int, int]] = []  # by first word
    for matched, a, z in sorted(spans, key=lambda s: (-s[0], s[2] - s[1], s[1])):
        at = bisect_left(kept, a, key=lambda s: s[1])
        if (at == 0 or kept[at - 1][2] <= a) and (at == len(kept) or z <= kept[at][1]):
            kept.insert(at, (matched, a, z))
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """``doc_id, license, coverage, matched_words, template_words, first_word,
    end_word, first_byte, end_byte``, a row for each notice found."""
    templates = TEMPLATES if templates is None else templates
    schema = ("doc_id long, license string, coverage double, matched_words int, template_words int, "
              "first_word int, end_word int, first_byte int, end_byte int")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.float64()] + [pa.int32()] * 6
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    block: dict[str, str] = {}
    every = []
    for name, text in templates.items():
        if block and sum(map(len, block.values())) + len(text or "") > BLOCK_BYTES:
            every.append(block)
            block = {}
        block[name] = text or ""
    for block in [*every, block] if block else []:
        shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(block, coverage))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in blocks(batch):
                    ids = part.column("doc_id").to_pylist()
                    found = [(ids[r], index.names[t], m / len(index.words[t]), m, len(index.words[t]), a, z, c, d)
                             for r, t, m, a, z, c, d in index.scan(part, band)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices and whole licences in ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), {**TEMPLATES, **NOTICES, **full_texts()})
