"""License scan: winnowed fingerprints of templates in an inverted index, then banded alignment.

The index maps a fingerprint to (template, position) and holds at most :data:`MAX_TEMPLATES` templates (checked),
so every task has it whole. All three-word windows of a document are looked up, so any run of ``GRAM + WINDOW - 1``
template words is found; a template of fewer than ``GRAM`` words is one fingerprint and is found where it stands
unchanged. Each hit proposes a diagonal; hits close to one another are aligned once, within a band.

One pass over the documents, no shuffle. Defined cases: null, empty and license-free texts give no row; repeated
rows give repeated results; an empty table gives an empty one; templates without words match nothing; only doc_id and
text of the input are read, so other columns cannot clash. Work grows with the words of a text, whole texts are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

GRAM, WINDOW = 3, 3
BAND = 12
MIN_COVERAGE = 0.7
MAX_TEMPLATES = 2000
TOKEN = re.compile("[A-Za-z0-9]+")

#: Public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def fingerprint(gram: tuple[str, ...]) -> int:
    return zlib.crc32(" ".join(gram).encode())


def winnow(tokens: list[str]) -> list[tuple[int, int]]:
    """(fingerprint, position): of each window of WINDOW grams the smallest, the rightmost of equals.

    The words of a short template are one gram.
    """
    gram = min(GRAM, len(tokens))
    prints = [fingerprint(tuple(tokens[i : i + gram])) for i in range(len(tokens) - gram + 1)] if gram else []
    picked = set()
    for start in range(max(1, len(prints) - WINDOW + 1)):
        window = prints[start : start + WINDOW]
        if window:
            picked.add(start + max(i for i, p in enumerate(window) if p == min(window)))
    return [(prints[i], i) for i in sorted(picked)]


def build_index(templates: dict[str, str]) -> tuple[dict[str, list[str]], dict[int, list[tuple[str, int]]], dict[str, set[int]]]:
    """Template words, the inverted index, and the first words of fingerprinted grams with the grams' lengths."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    tokens = {k: [w.lower() for w in TOKEN.findall(v)] for k, v in templates.items()}
    index: dict[int, list[tuple[str, int]]] = {}
    heads: dict[str, set[int]] = {}
    for name, words in tokens.items():
        for value, at in winnow(words):
            index.setdefault(value, []).append((name, at))
            heads.setdefault(words[at], set()).add(min(GRAM, len(words)))
    return tokens, index, heads


def align(template: list[str], doc: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last matched document word) of the best alignment within ``band`` of a diagonal.

    Matches count one, gaps and differences nothing; of equal scores the later start wins, so spans stay tight.
    """
    best = (0, -1, -1)
    row = [(0, -1, -1)] * (2 * band + 1)
    for i, word in enumerate(template):
        new = []
        for k in range(2 * band + 1):
            j = i + diagonal + k - band
            cell = row[k + 1] if k < 2 * band else (0, -1, -1)  # skip the template's word
            if k and new[k - 1][:2] > cell[:2]:
                cell = new[k - 1]  # skip the document's word
            if 0 <= j < len(doc):
                n, first, _ = row[k]
                hit = (n + 1, j if first < 0 else first, j) if doc[j] == word else row[k]
                if hit[:2] > cell[:2]:
                    cell = hit
            new.append(cell)
        row = new
    for cell in row:
        if cell[:2] > best[:2]:
            best = cell
    return best


def scan(text: str, built: tuple) -> list[tuple[str, float, int, int, int, int]]:
    """(template, coverage, matched words, template words, first character, end) of each license passage."""
    tokens, index, heads = built
    words = [w.lower() for w in TOKEN.findall(text)]
    hits: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for n in heads.get(w, ()):
            if i + n <= len(words):
                for name, at in index.get(fingerprint(tuple(words[i : i + n])), ()):
                    hits.setdefault(name, []).append(i - at)
    if not hits:
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    found = []
    for name, diagonals in hits.items():
        template, last = tokens[name], None
        band = min(BAND, len(template) // 3)  # a short notice may stand twice within a wide band
        best: list[tuple[int, int, int]] = []
        for d in sorted(set(diagonals)):
            if last is not None and d - last <= band:
                continue  # the alignment on that diagonal has this one in its band
            last = d
            n, first, end = align(template, words, d, band)
            if n >= MIN_COVERAGE * len(template):
                if best and first <= best[-1][2]:  # two alignments of one passage: the better stays
                    best[-1] = max(best[-1], (n, first, end))
                else:
                    best.append((n, first, end))
        found += [(name, n / len(template), n, len(template), spans[i][0], spans[j][1]) for n, i, j in best]
    return sorted(found, key=lambda x: (x[4], x[0], x[5]))


SCHEMA = "doc_id long, template string, coverage double, matched int, template_words int, start long, end long"
ARROW = pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("template_words", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES) -> DataFrame:
    """One row per license passage of ``docs(doc_id, text)``: template, matched coverage and character span.

    ``templates`` is a mapping, or a table (template, text) of at most :data:`MAX_TEMPLATES` rows.
    """
    if isinstance(templates, DataFrame):
        rows = templates.select("template", "text").limit(MAX_TEMPLATES + 1).collect()
        if len(rows) > MAX_TEMPLATES:
            raise ValueError(f"at most {MAX_TEMPLATES} templates")
        templates = {r[0]: r[1] or "" for r in rows}
    built = build_index(templates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for hit in scan(t, built)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op3_license_scan(docs: DataFrame) -> DataFrame:
    return license_scan(docs)
