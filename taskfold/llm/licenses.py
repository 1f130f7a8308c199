"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.minhash import band_buckets, one_permutation
from taskfold.llm.tables import table, whole_rows, with_row

#: Bytes of templates that are sent to the tasks, at most.
TEMPLATE_BYTES = 16 << 20
#: Public notices and permission texts (fixed values): license, text.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Further notices and families, short notices among them.
NOTICES = (
    ("All-Rights-Reserved", "All rights reserved."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
)


class Templates:
    """The templates' shingles, and the buckets of their MinHash bands for each window size."""

    def __init__(self, templates: Sequence[tuple[str, str]], k: int, bands: int, rows: int):
        self.k, self.bands, self.rows = k, bands, rows
        self.names, self.sets, sizes = [], [], []
        for name, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            h, owner, _, _ = bt.hashed_words(data, np.array([0, len(data)]), bt.BY_LETTERS)
            s, _ = bt.shingles(h, owner, 1, k)
            if len(s):
                self.names.append(name)
                self.sets.append(np.unique(s))
                sizes.append(len(s))
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.runs: dict[int, list[int]] = defaultdict(list)  # templates of one shingle
        for t, own in enumerate(self.sets):
            if len(own) == 1:
                self.runs[int(own[0])].append(t)
        self.runs = dict(self.runs)
        self.classes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, n in enumerate(sizes):
            for b in self.buckets([self.sets[t]])[0].tolist():
                self.classes[self.size_class(n)][b].append(t)
        self.classes = {m: dict(b) for m, b in self.classes.items()}

    @staticmethod
    def size_class(n: int) -> int:
        """The next size of a grid that grows by a quarter."""
        m = 1
        while m < n:
            m = max(m + 1, m * 5 // 4)
        return m

    @staticmethod
    def stride(m: int) -> int:
        return max(1, m // 4)

    def buckets(self, sets: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return band_buckets(one_permutation(np.concatenate(sets), owner, len(sets), self.bands * self.rows), self.rows)

    def windows(self, m: int, n: int, hits: np.ndarray) -> list[tuple[int, int]]:
        """Windows (first, end shingle) of a text of n shingles that hold one of the ``hits``.

        A window has m shingles and one stride more, and one begins at every stride, so wherever a template of m
        shingles or fewer stands, a window holds all of it. Windows without a template's shingle share no MinHash
        with one, so leaving them out changes nothing.
        """
        step = self.stride(m)
        size = m + step
        low, high = np.maximum(0, -((size - 1 - hits) // step)), hits // step
        numbers = np.unique(np.concatenate([low + i for i in range(int((high - low).max()) + 1)]))
        found = [(w * step, min(n, w * step + size)) for w in numbers.tolist() if w * step < n]
        at = np.searchsorted(hits, [a for a, _ in found]), np.searchsorted(hits, [b for _, b in found])
        return [x for x, i, j in zip(found, *at) if j > i]


def matches_of(t: Templates, texts: list[np.ndarray], least: float) -> list[list[tuple[int, int, int, float]]]:
    """(template, first shingle, last shingle, containment) in each text, given by its shingles in order; of
    overlapping places the fullest. The windows of all texts are sketched together."""
    windows: list[tuple[int, int, int, int]] = []  # text, size class, first shingle, end
    for i, shingles in enumerate(texts):
        at = np.minimum(np.searchsorted(t.known, shingles), len(t.known) - 1)
        hits = np.flatnonzero(t.known[at] == shingles)
        if len(hits):
            windows += [(i, m, a, b) for m in t.classes for a, b in t.windows(m, len(shingles), hits)]
    best: list[dict[int, list[tuple[int, int, int, float]]]] = [defaultdict(list) for _ in texts]
    buckets = t.buckets([np.unique(texts[i][a:b]) for i, _, a, b in windows]).tolist() if windows else ()
    for (i, m, a, b), own in zip(windows, buckets):
        table_of = t.classes[m]
        for template in {x for bucket in own for x in table_of.get(bucket, ())}:
            inside = np.isin(texts[i][a:b], t.sets[template])
            share = len(np.unique(texts[i][a:b][inside])) / len(t.sets[template])
            if share >= least:
                places = a + np.flatnonzero(inside)
                best[i][template].append((template, int(places[0]), int(places[-1]), share))
    return [_apart(found) for found in best]


def _runs_of(t: Templates, shingles: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The same in one text for templates that are one shingle of k words; places of a template don't overlap."""
    at = np.minimum(np.searchsorted(t.known, shingles), len(t.known) - 1)
    out, free = [], dict.fromkeys(range(len(t.sets)), 0)
    for i in np.flatnonzero(t.known[at] == shingles).tolist():
        for template in t.runs[int(shingles[i])]:
            if i >= free[template]:
                out.append((template, i, i, 1.0))
                free[template] = i + t.k
    return out


def _by_length(templates: Sequence[tuple[str, str]], k: int) -> dict[int, list[tuple[str, str]]]:
    """Templates by the words of their shingles: k, or all words of a template that has fewer."""
    out: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for name, text in templates:
        data = np.frombuffer(text.encode(), np.uint8)
        n = len(bt.hashed_words(data, np.array([0, len(data)]), bt.BY_LETTERS)[0])
        if n:
            out[min(n, k)].append((name, text))
    return dict(out)


def _fullest(found: list[dict]) -> list[dict]:
    """The places, in order, without those that lie by more than half inside a fuller one of another license: texts of a
    family differ in a word or two, so the one that is there holds most of the others' shingles too."""
    found = sorted(found, key=lambda x: (x["first"], x["end"], x["license"]))
    firsts = [x["first"] for x in found]
    longest = max(x["end"] - x["first"] for x in found)

    def beaten(x: dict) -> bool:
        half = (x["end"] - x["first"]) / 2
        near = found[bisect_left(firsts, x["first"] - longest) : bisect_left(firsts, x["end"])]
        return any(
            y["containment"] > x["containment"] and y["license"] != x["license"]
            and min(x["end"], y["end"]) - max(x["first"], y["first"]) > half
            for y in near
        )

    return [x for x in found if x["containment"] == 1 or not beaten(x)]


def _apart(best: dict[int, list[tuple[int, int, int, float]]]) -> list[tuple[int, int, int, float]]:
    out = []
    for found in best.values():
        found.sort(key=lambda x: (-x[3], x[2] - x[1], x[1]))
        kept: list[tuple[int, int, int, float]] = []
        for x in found:
            if all(x[2] < y[1] or x[1] > y[2] for y in kept):
                kept.append(x)
        out += kept
    return sorted(out, key=lambda x: (x[1], x[0]))


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))


def scanned(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = (*TEMPLATES, *NOTICES), k: int = 5, least: float = 0.8, bands: int = 64, rows: int = 2
) -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns), ``found``: an array of (license, containment, first, end).

    Texts are cut into words of letters and digits in lower case. A template is found where a window of a text
    holds at least ``least`` of its distinct shingles of k words; first and end are offsets of characters in the
    original text, from the first to the last of these. Windows overlap by four fifths, so one of them holds a
    template whole, and its similarity with it is at least 0.45: it shares a bucket in one of 64 bands of two
    with a chance above 1 - 1e-6. Containment is then counted exactly, so nothing is reported that isn't there.

    Templates are a parameter, with a bound on their bytes; texts are read as a whole. Null, empty and too short
    texts give an empty array. A template of fewer than k words is found wherever a text has just these words in a
    row. Of two licenses at a place the fuller one is reported. Rows are scanned one by one.
    """
    if sum(len(x.encode()) for _, x in templates) > TEMPLATE_BYTES:
        raise ValueError(f"more than {TEMPLATE_BYTES} bytes of templates; scan in several passes")
    shared = docs.sparkSession.sparkContext.broadcast([Templates(own, n, bands, rows) for n, own in _by_length(templates, k).items()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in bt.slices(batch.column(0).field("text").cast(pa.large_string())):
                h, owner, start, stop = bt.hashed_words(data, offsets, bt.BY_LETTERS)
                found: list[list] = [[] for _ in range(end - first)]
                for t in shared.value:
                    s, of, word = bt.placed_shingles(h, owner, end - first, t.k)
                    order = np.argsort(of, kind="stable")
                    s, of, word = s[order], of[order], word[order]
                    near = np.minimum(np.searchsorted(t.known, s), len(t.known) - 1)
                    some = np.unique(of[t.known[near] == s])
                    lows, highs = np.searchsorted(of, some), np.searchsorted(of, some + 1)
                    texts = [s[a:b] for a, b in zip(lows, highs)]
                    matches = matches_of(t, texts, least) if t.k == k else [_runs_of(t, x) for x in texts]
                    for i, low, own in zip(some.tolist(), lows, matches):
                        text = data[offsets[i] : offsets[i + 1]]
                        for template, a, b, share in own:
                            last = min(word[low + b] + t.k - 1, np.searchsorted(owner, i, "right") - 1)
                            from_, to = start[word[low + a]] - offsets[i], stop[last] - offsets[i]
                            chars = [int(((text[:x] & 0xC0) != 0x80).sum()) for x in (from_, to)]
                            found[i].append({"license": t.names[template], "containment": share, "first": chars[0], "end": chars[1]})
                found = [_fullest(x) if x else x for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(found, _FOUND)], ["row", "found"])

    whole = whole_rows(docs)
    return whole.mapInArrow(scan, with_row(whole, "found array<struct<license:string,containment:double,first:bigint,end:bigint>>"))


def op10_license_scans(spark, sf_dir) -> DataFrame:
    """The licenses and notices found in all documents; see ``scanned``."""
    return scanned(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        F.size("found").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.array_max("found.containment").alias("best"),
        F.to_json("found").alias("places"),
    )
