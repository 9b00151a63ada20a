r"""License scan with a positional rare-token index (operator 10).

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the A-Z-lowered whole text.

Base labels are places where a base phrase's words stand consecutively.  The
method's own labels come from licence texts and notices (templates), indexed by
word: a posting is a template and a place in it.  Of each file's words that a
template has, those with the highest inverse document frequency over the whole
table, and one of each mandatory key phrase, are looked up; the differences of
place in the file and place in the template propose starts.  At a start the
template is found if its key phrases stand there, all of them and in order (the
first exactly, the next within ``SLACK`` words of its place), and at least
``MIN_COVER`` of its IDF weight is in place.  A start within ``SLACK`` words
after one that was taken is the same span; a span whose head the file cuts off
starts before word 0.

Defined results: null and empty texts have no words, no places, null
first_word and last_word, empty labels and score 0.  Repeated rows each get a
result; an empty table gives an empty one; a null doc_id passes through;
words of equal IDF tie to the earlier one; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames, textbatch as tb

#: Base phrases and labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Licence notices and the openings of licence texts; brackets hold the mandatory key phrases.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": (
        "licensed under the GNU [Affero General Public License version 3]",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU Affero General Public License] as published by the Free Software Foundation, either [version 3 of the License], or (at your option) any later version.",
    ),
    "apache-2.0": (
        "licensed under the [Apache License version 2.0]",
        'Licensed under the Apache License, Version 2.0 (the "License"); [you may not use this file except in compliance with the License]. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "bsd": (
        "[Redistribution and use in source and binary forms], with or without modification, are permitted",
        "[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. [THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS] AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "boost-1.0": ("[Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation] covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",),
    "cc-by-4.0": ("licensed under [CC BY 4.0]", "This work is licensed under a [Creative Commons Attribution 4.0 International License]."),
    "cc-by-nc-4.0": ("licensed under [CC BY-NC 4.0]", "This work is licensed under a [Creative Commons Attribution-NonCommercial 4.0 International License]."),
    "cc-by-nc-sa-4.0": ("licensed under [CC BY-NC-SA 4.0]", "This work is licensed under a [Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License]."),
    "cc-by-nd-4.0": ("licensed under [CC BY-ND 4.0]", "This work is licensed under a [Creative Commons Attribution-NoDerivatives 4.0 International License]."),
    "cc-by-sa-4.0": ("licensed under [CC BY-SA 4.0]", "This work is licensed under a [Creative Commons Attribution-ShareAlike 4.0 International License]."),
    "cc0-1.0": ("dedicated to the public domain under [CC0 1.0]", "To the extent possible under law, the author has [waived all copyright and related or neighboring rights to this work]."),
    "gpl-2.0": (
        "this work is licensed under the [GNU General Public License version 2]",
        "This program is free software; you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation; either [version 2 of the License], or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "gpl-3.0": (
        "this work is licensed under the [GNU General Public License version 3]",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation, either [version 3 of the License], or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "isc": ("[Permission to use, copy, modify, and/or distribute this software] for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl-3.0": (
        "licensed under the GNU [Lesser General Public License version 3]",
        "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation; either [version 3 of the License], or (at your option) any later version.",
    ),
    "mit": (
        "released under the [MIT License]",
        "[Permission is hereby granted, free of charge, to any person obtaining a copy of this software] and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": ("subject to the terms of the [Mozilla Public License v. 2.0]", "This Source Code Form is [subject to the terms of the Mozilla Public License], v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "reserved": ("[All rights reserved]",),
    "unlicense": ("This is [free and unencumbered software] released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. [Permission is granted to anyone to use this software for any purpose], including commercial applications, and to alter it and redistribute it freely",),
}
#: A file's words of each template that are looked up: this many with the highest IDF among those that it has, and one of each key phrase.
RARE_WORDS = 6
#: Words by which a key phrase may stand off its place in the template (words put in or left out before it).
SLACK = 12
#: Least share of a template's IDF weight that must stand in place.
MIN_COVER = 0.3
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,words:int,cover:double>>"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Template:
    """Words of a licence text and its mandatory phrases, as (place, words)."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, int], ...]


def templates() -> list[Template]:
    out = []
    for label, texts in TEMPLATES.items():
        for text in texts:
            words: list[str] = []
            phrases = []
            for k, part in enumerate(re.split(r"[\[\]]", text)):
                own = WORD.findall(part.translate(LOW))
                if k % 2:
                    phrases.append((len(words), len(own)))
                words += own
            out.append(Template(label, tuple(words), tuple(phrases)))
    return out


def _words(ch: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (A-Z lowered) and bounds."""
    s, e = ch.spans(SEPARATORS)
    return ch.range_hash(s, e, tb.LOWER_VALUE), ch.word_offsets(s)


#: tb.NON_ALNUM keeps A-Z as word bytes: the text is lowered before it is split.
SEPARATORS = tb.NON_ALNUM


def vocabulary() -> list[str]:
    return sorted({w for t in templates() for w in t.words})


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many rows each template word stands, and the number of rows; over all rows."""
    words = vocabulary()
    hashes = np.array([tb.stable_hash(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    table = hashes[order]

    def count(b: pa.RecordBatch):
        df = np.zeros(len(words), np.int64)
        for ch in tb.chunks(b.column(0)):
            h, off = _words(ch)
            k = np.searchsorted(table, h)
            k[k == len(table)] = 0
            at = np.flatnonzero(table[k] == h)
            pairs = np.unique(tb.owner(off)[at] * len(words) + k[at])
            df += np.bincount(pairs % len(words), minlength=len(words))
        return pa.RecordBatch.from_arrays([pa.array(range(-1, len(words)), pa.int32()), pa.array(np.concatenate([[b.num_rows], df]))], ["k", "n"])

    got = {r["k"]: r["n"] for r in frames.map_arrow(docs.select("text"), count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return {words[order[k]]: int(n) for k, n in got.items() if k >= 0}, int(got.get(-1, 0))


class Index:
    """Postings of the templates' words (template and place of each), with IDF weights."""

    def __init__(self, df: dict[str, int], n: int):
        words = vocabulary()
        code = np.array([tb.stable_hash(w) for w in words], np.uint64)
        order = np.argsort(code)
        self.keys = code[order]
        rank = {words[k]: i for i, k in enumerate(order.tolist())}
        self.idf = np.array([math.log((n + 1) / (df.get(words[k], 0) + 1)) + 1 for k in order.tolist()])
        self.templates = templates()
        self.words = [np.array([rank[w] for w in t.words]) for t in self.templates]
        self.base = [([rank[w] for w in p.split()], label) for p, label in BASE_PHRASES.items()]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys & tb.U64(0xFFFF)).astype(np.int64)] = True
        # a template's words, each once with its places, rarest first; ties go to the earlier word
        self.rare = []
        for own in self.words:
            first = {int(w): k for k, w in reversed(list(enumerate(own.tolist())))}
            self.rare.append([(w, np.flatnonzero(own == w)) for w in sorted(first, key=lambda w: (-self.idf[w], first[w]))])

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The index of each word that is in the templates, else -1."""
        out = np.full(len(h), -1)
        at = np.flatnonzero(self.bits[(h & tb.U64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        out[at[ok]] = k[ok]
        return out

    def scan(self, ch: tb.Chunk) -> tuple[np.ndarray, dict[int, list], dict[int, list]]:
        """Bounds of words; by text the base places and the template spans."""
        h, off = _words(ch)
        rank = self.ranks(h)
        base: dict[int, list] = {}
        spans: dict[int, list] = {}
        for k in np.unique(tb.owner(off)[rank >= 0]).tolist():
            mine = rank[off[k] : off[k + 1]]
            if found := self._base(mine):
                base[k] = found
            if found := self._spans(mine):
                spans[k] = found
        return off, base, spans

    def _base(self, mine: np.ndarray) -> list[tuple[int, str]]:
        out = []
        for words, label in self.base:
            at = np.flatnonzero(mine[: len(mine) - len(words) + 1] == words[0]) if len(mine) >= len(words) else np.zeros(0, np.int64)
            for j in range(1, len(words)):
                at = at[mine[at + j] == words[j]]
            out += [(p, label) for p in at.tolist()]
        return out

    def _spans(self, mine: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, start, words, cover) of the templates in one file's words."""
        here = np.flatnonzero(mine >= 0)
        order = here[np.argsort(mine[here], kind="stable")]
        bounds = np.searchsorted(mine[order], np.arange(len(self.keys) + 1))
        has = np.diff(bounds) > 0
        out = []
        for t, own, rare in zip(self.templates, self.words, self.rare):
            # mandatory words that the file lacks rule a template out
            if not all(has[own[a : a + n]].all() for a, n in t.phrases):
                continue
            asked = [w for w, _ in rare if has[w]][:RARE_WORDS]
            asked += [max(own[a : a + n].tolist(), key=lambda w: self.idf[w]) for a, n in t.phrases]
            votes = [(order[bounds[w] : bounds[w + 1]][:, None] - places).reshape(-1) for w, places in rare if w in asked]
            taken = -len(own)
            for start in np.unique(np.concatenate(votes)).tolist():
                if start <= taken:
                    continue
                cover = self._cover(mine, start, t, own)
                if cover >= MIN_COVER:
                    out.append((t.label, start, len(own), cover))
                    taken = start + SLACK
        return out

    def _cover(self, mine: np.ndarray, start: int, t: Template, own: np.ndarray) -> float:
        """Share of the template's weight in place from ``start`` on; 0 unless every key phrase stands near its place.

        The first phrase stands exactly, each next one at the nearest shift
        from the one before; words between go with the phrase before them.
        """
        shift, weight, left = 0, 0.0, 0
        idf = self.idf[own]
        for k, (a, n) in enumerate(t.phrases):
            at = next((d for d in ([0] if k == 0 else sorted(range(-SLACK, SLACK + 1), key=abs)) if _stands(mine, start + a + shift + d, own[a : a + n])), None)
            if at is None:
                return 0.0
            weight += idf[left:a][_matches(mine, start + left + shift, own[left:a])].sum()
            shift, left = shift + at, a
        weight += idf[left:][_matches(mine, start + left + shift, own[left:])].sum()
        return float(weight / idf.sum())


def _matches(mine: np.ndarray, start: int, own: np.ndarray) -> np.ndarray:
    at = start + np.arange(len(own))
    ok = (at >= 0) & (at < len(mine))
    ok[ok] = mine[at[ok]] == own[ok]
    return ok


def _stands(mine: np.ndarray, start: int, own: np.ndarray) -> bool:
    return start >= 0 and start + len(own) <= len(mine) and bool((mine[start : start + len(own)] == own).all())


def license_scan(docs: DataFrame) -> DataFrame:
    """Labels, base places, template spans and a score for every row."""
    df, n = document_frequencies(docs)

    def run(b: pa.RecordBatch):
        if not b.num_rows:
            return None
        index = Index(df, n)
        cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for ch in tb.chunks(b.column(1)):
            off, base, spans = index.scan(ch)
            cols["n_words"] += np.diff(off).tolist()
            for d in range(ch.n):
                places, found = base.get(d, []), sorted(spans.get(d, []), key=lambda s: (s[1], s[0]))
                at = [p for p, _ in places]
                own = {label for _, label in places}
                cols["n_base"].append(len(at))
                cols["first_word"].append(min(at) if at else None)
                cols["last_word"].append(max(at) if at else None)
                cols["base_labels"].append(",".join(sorted(own)))
                cols["labels"].append(",".join(sorted(own | {s[0] for s in found})))
                cols["score"].append(max([0.0, 0.5 * bool(own), *(min(1.0, s[3]) for s in found)]))
                cols["spans"].append([{"label": s[0], "start": s[1], "words": s[2], "cover": s[3]} for s in found])
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("cover", pa.float64())]))}
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds[k]) for k, v in cols.items())], ["doc_id", *cols])

    return frames.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
