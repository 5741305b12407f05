"""Licence scan by a positional index of rare words.

Licence texts are indexed word by word: word -> postings ``(template, position)``, with the inverse document frequency
of the word among templates.  A template's key phrases must stand in the file; they are looked up by their rarest word.
The file's words are then looked up, rarest first: a posting ``(t, q)`` of a word at ``p`` gives its weight to the alignments
of ``t`` around ``p - q``, give or take ``SLACK`` words, so that postings meet by relative position.  A template is given up
when what its words still to come weigh cannot bring its best alignment to ``LEAST_SHARE``; no other cut is made, so no
template depends on what else the file holds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts

#: The contract's phrases and labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Label, text (openings, notices and characteristic clauses of public licences), phrases that must be there.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("hereby granted free of charge", "without restriction")),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache license", "in compliance with the license")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "free software foundation")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("source and binary forms", "permitted provided that")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("unencumbered software", "public domain")),
)
#: Label and name of further licences, found by their name, and label and identifier of those that a tag names.
NAMES = (
    ("agpl", "GNU Affero General Public License"), ("lgpl", "GNU Lesser General Public License"), ("gpl", "GNU GPL v2"), ("gpl", "GNU GPL v3"), ("gpl", "GPLv2"), ("gpl", "GPLv3"), ("mpl", "Mozilla Public License, version 2.0"),
    ("epl", "Eclipse Public License"), ("eupl", "European Union Public Licence"), ("boost", "Boost Software License"), ("artistic", "Artistic License 2.0"), ("cc0", "CC0 1.0 Universal"), ("cddl", "Common Development and Distribution License"),
    ("bsd", "BSD 2-Clause License"), ("bsd", "BSD 3-Clause License"), ("isc", "ISC License"), ("zlib", "zlib License"), ("wtfpl", "Do What The Fuck You Want To Public License"), ("ofl", "SIL Open Font License"), ("odbl", "Open Database License"),
    ("cc-by-nd", "CC BY-ND 4.0"), ("cc-by-nc-sa", "CC BY-NC-SA 4.0"), ("cc-by-nc-nd", "CC BY-NC-ND 4.0"),
)
TAGS = (
    ("mit", "MIT"), ("apache", "Apache-2.0"), ("gpl", "GPL-2.0"), ("gpl", "GPL-3.0"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl", "AGPL-3.0"), ("bsd", "BSD-2-Clause"), ("bsd", "BSD-3-Clause"), ("isc", "ISC"), ("mpl", "MPL-2.0"),
    ("epl", "EPL-2.0"), ("eupl", "EUPL-1.2"), ("boost", "BSL-1.0"), ("zlib", "Zlib"), ("cc0", "CC0-1.0"), ("unlicense", "Unlicense"), ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"),
)


def all_templates() -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """Clauses and notices, names, and tags; names and tags are phrases as a whole."""
    tagged = [(label, f"SPDX-License-Identifier: {tag}") for label, tag in TAGS]
    return (*TEMPLATES, *((label, text, (text,)) for label, text in (*NAMES, *tagged)))


#: Words that a word may stand away from its aligned place, and the weight share that verifies a template.
SLACK, LEAST_SHARE = 3, 0.7
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The contract's words, as UTF-8."""
    return text.encode().translate(_FOLD).split()


class Index:
    def __init__(self, templates: tuple) -> None:
        self.texts = [words_of(t) for _, t, _ in templates]
        self.labels = [label for label, _, _ in templates]
        self.keys = [[words_of(p) for p in phrases] for _, _, phrases in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.texts):
            for q, w in enumerate(words):
                self.postings[w].append((t, q))
        n = len(templates)
        self.idf = {w: math.log(1 + n / len({t for t, _ in p})) for w, p in self.postings.items()}
        self.weight = [sum(self.idf[w] for w in words) for words in self.texts]
        self.known = frozenset(self.postings)
        #: A file without any of these cannot verify a template, as each has a key phrase with one.
        self.signs = frozenset(min(p, key=lambda w: (len(self.postings.get(w, ())), w)) for keys in self.keys for p in keys)

    def places(self, words: list[bytes], phrase: list[bytes] | tuple, where: dict[bytes, list[int]]) -> list[int]:
        rare = min(range(len(phrase)), key=lambda i: len(where.get(phrase[i], ())))
        starts = [p - rare for p in where.get(phrase[rare], ())]
        n = len(phrase)
        return [s for s in starts if s >= 0 and words[s : s + n] == list(phrase)]

    def shares(self, keyed: set[int], n: int, where: dict[bytes, list[int]]) -> dict[int, float]:
        """For templates of ``keyed``, the greatest weight share over all alignments with a file of ``n`` words of the words
        that stand where the template has them, give or take ``SLACK``; those below ``LEAST_SHARE`` are left out.

        The alignment that has the template's first word at ``d`` is at ``d + last + SLACK``.
        """
        last = {t: len(self.texts[t]) - 1 for t in keyed}
        words = sorted((w for w in where if where[w]), key=lambda w: (-self.idf[w], w))
        ahead = dict.fromkeys(keyed, 0.0)  # weight of the template's words that are in the file and not yet looked up
        for w in words:
            for t, _ in self.postings[w]:
                if t in ahead:
                    ahead[t] += self.idf[w]
        got: dict[int, np.ndarray] = {}
        best = dict.fromkeys(keyed, 0.0)
        open_ = {t for t in keyed if ahead[t] >= LEAST_SHARE * self.weight[t] - 1e-9}
        for w in words:
            hits = [(t, q) for t, q in self.postings[w] if t in open_]
            if not hits:
                continue
            around = np.unique(np.add.outer(np.array(where[w]), np.arange(2 * SLACK + 1)))
            for t, q in hits:
                if t not in got:
                    got[t] = np.zeros(n + last[t] + 2 * SLACK)
                at = around + (last[t] - q)
                got[t][at] += self.idf[w]
                best[t] = max(best[t], float(got[t][at].max()))
                ahead[t] -= self.idf[w]
            open_ -= {t for t, _ in hits if best[t] + ahead[t] < LEAST_SHARE * self.weight[t] - 1e-9}
        found = {t: best[t] / self.weight[t] for t in open_}
        return {t: share for t, share in found.items() if share >= LEAST_SHARE}

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Places of base phrases, base labels, all labels, and the best share of a verified template."""
        own = set(words)
        if own.isdisjoint(self.signs) and b"license" not in own:
            return [], set(), set(), 0.0
        seen = own & self.known
        where: dict[bytes, list[int]] = {w: [] for w in seen}
        for p, w in enumerate(words):
            if w in seen:
                where[w].append(p)
        base, labels = [], set()
        for phrase, label in BASE.items():
            if at := self.places(words, [w.encode() for w in phrase], where):
                base += at
                labels.add(label)
        all_labels, best = set(labels), 0.0
        keyed = {t for t, keys in enumerate(self.keys) if all(self.places(words, p, where) for p in keys)}
        for t, share in self.shares(keyed, len(words), where).items():
            all_labels.add(self.labels[t])
            best = max(best, share)
        return base, labels, all_labels, min(1.0, best)


@cache
def index() -> Index:
    return Index(all_templates())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row.

    Null text is empty: no words, no places, null first and last word, empty labels, score 0.  Null and repeated ids
    stay as they are; columns other than ``doc_id`` and ``text`` are not read.  Texts of any length are read whole.  An
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index()
        for batch in batches:
            rows = []
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            for doc_id, t in zip(batch.column(0).to_pylist(), text, strict=True):
                words = t.as_py().translate(_FOLD).split()
                at, base, labels, score = known.scan(words)
                rows.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
