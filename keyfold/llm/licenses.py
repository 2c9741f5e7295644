"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Texts are cut into words (as in decontamination) and shingles of five words. Templates
are classed by width: W is the smallest power of two that holds a template's S shingles,
so W/2 < S <= W. A document's shingles are cut into blocks of W, and each two adjacent
blocks are a window: any run of up to W shingles lies within one window.

A window that contains a share c of a template has Jaccard similarity with it of at
least c S / (2W + (1 - c) S) > c / (4 + 2 (1 - c)): 0.18 for c = 0.8. With `BANDS` = 64
bands of one row it shares a band with probability 1 - (1 - 0.18)**64 > 0.99999; for an
exact copy (0.25) one minus 1e-8. Windows that share a band are checked exactly: the
share of the template's distinct shingles that the window has must reach `containment`.

Block minima of a width come from those of half the width, so all classes together
cost two passes per band. A map over rows: no shuffle. The templates come from the
caller, as a dictionary or a table, checked to be at most `MOST_BYTES`; the default has
notices of common licenses and the whole texts in the folder `templates`.

Of templates that have half of their shingles in common (headers that differ in the
license's name), only those with the greatest containment in a text are reported.

A copy is found if at most the double width of its template holds it: a template with so
many words put in between that the run outgrows its window is missed.

Defined results: null, empty and short texts match nothing; repeated rows are scanned
one by one; a template of fewer than five words is refused, as are null ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common as C
from keyfold.llm.decontaminate import Words

SHINGLE = 5
BANDS = 64
MOST_BYTES = 4 << 20
_U = np.uint64

# Notices of public licenses, by SPDX name and a number.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/1": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/2": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "0BSD/1": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "AGPL-3.0/1": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version"
    ),
    "BSD-2-Clause/1": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "BSD-3-Clause/1": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    "BSL-1.0/1": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "CC-BY-4.0/1": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-4.0/2": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0/1": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0/1": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "EPL-2.0/1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0/1": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version"
    ),
    "GPL-3.0/1": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0/2": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version"
    ),
    "ISC/1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1/1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version"
    ),
    "LGPL-3.0/1": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version"
    ),
    "MIT/1": "Released under the MIT License",
    "MIT/2": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "MPL-2.0/1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense/1": "This is free and unencumbered software released into the public domain",
    "Zlib/1": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
}


def whole_texts(folder: Path = Path(__file__).parent / "templates") -> dict[str, str]:
    """Name/text to text, of the license texts in a folder of the driver."""
    return {f"{f.stem}/text": f.read_text(encoding="utf-8") for f in sorted(folder.glob("*.txt"))}


def templates_of(table: DataFrame, name_col: str = "name", text_col: str = "text") -> dict[str, str]:
    """The templates of a table (names as License/anything), of which there may be MOST_BYTES."""
    rows = table.select(table[name_col].cast("string").alias("name"), table[text_col].alias("text")).dropna().distinct()
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of templates; {MOST_BYTES} are allowed")
    return {r["name"]: r["text"] for r in rows.orderBy("name", "text").collect()}


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, bounds of the rows)."""
    grams = words.grams(SHINGLE)
    at = np.flatnonzero(C.gram_rows(words.first, SHINGLE, len(words.hashes)))
    return grams[at], np.searchsorted(at, words.first)


def _halved(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pairs of blocks within each row, and bounds of the rows over the pairs."""
    count = -(-np.diff(bounds) // 2)
    new = np.concatenate(([0], np.cumsum(count)))
    starts = np.repeat(bounds[:-1] - 2 * new[:-1], count) + 2 * np.arange(new[-1])
    return starts, new


class Templates:
    """Distinct shingles and band values of each template, by class of width."""

    def __init__(self, templates: dict[str, str]) -> None:
        if sum(len(t.encode()) for t in templates.values()) > MOST_BYTES:
            raise ValueError(f"more than {MOST_BYTES} bytes of templates")
        self.factors = C.mix(np.arange(1, BANDS + 1, dtype=_U) * _U(C._STEP)) | _U(1)
        self.classes: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in templates.items():
            shingles, _ = _shingles(Words(pa.array([text])))
            if not len(shingles):
                raise ValueError(f"{name} has fewer than {SHINGLE} words")
            self.classes.setdefault(1 << (len(shingles) - 1).bit_length(), []).append((name, np.unique(shingles)))
        sets = {name: s for members in self.classes.values() for name, s in members}
        near = lambda a, b: 2 * len(np.intersect1d(a, b)) >= max(len(a), len(b))
        self.twins = {a: [b for b in sets if a != b and near(sets[a], sets[b])] for a in sets}
        self.bands, self.maps = {}, {}
        for width, members in self.classes.items():
            values = np.array([[(s * f).min() for _, s in members] for f in self.factors])
            flags = np.zeros((BANDS, 1 << 16), bool)
            flags[np.arange(BANDS)[:, None], (values >> _U(48)).astype(np.int64)] = True
            self.bands[width], self.maps[width] = values, flags

    def matches(self, column: pa.Array, containment: float) -> list[list[tuple[str, float]]]:
        """Of each text: templates found, with the best containment."""
        shingles, bounds = _shingles(Words(column))
        found: list[dict[str, float]] = [{} for _ in range(len(bounds) - 1)]
        if not len(shingles):
            return [[] for _ in found]
        levels = {1: bounds}  # bounds of the rows over the blocks of each width
        halves = {}
        for width in (1 << i for i in range(1, max(self.classes).bit_length())):
            halves[width], levels[width] = _halved(levels[width // 2])
        last = {w: np.append(b[1:][np.diff(b) > 0] - 1, -1) for w, b in levels.items()}
        pairs: dict[int, set[tuple[int, int]]] = {w: set() for w in self.classes}
        for band in range(BANDS):
            low = shingles * self.factors[band]
            for width in levels:
                if width > 1:
                    low = np.minimum.reduceat(low, halves[width])
                if width not in self.classes:
                    continue
                window = low.copy()
                np.minimum(low[:-1], low[1:], out=window[:-1])
                window[last[width]] = low[last[width]]  # a row's last block stands alone
                flagged = np.flatnonzero(self.maps[width][band][(window >> _U(48)).astype(np.int64)])
                if len(flagged):
                    w, t = np.nonzero(window[flagged][:, None] == self.bands[width][band][None, :])
                    pairs[width].update(zip(flagged[w].tolist(), t.tolist(), strict=True))
        for width, some in pairs.items():
            for block, t in some:
                row = int(np.searchsorted(levels[width], block, side="right")) - 1
                start = int(bounds[row]) + (block - int(levels[width][row])) * width
                name, wanted = self.classes[width][t]
                share = float(np.isin(wanted, shingles[start : min(start + 2 * width, int(bounds[row + 1]))]).mean())
                if share >= containment:
                    found[row][name] = max(share, found[row].get(name, 0.0))
        best = lambda f, name: all(f.get(twin, 0.0) <= f[name] for twin in self.twins[name])
        return [sorted((n, s) for n, s in f.items() if best(f, n)) for f in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None, containment: float = 0.8) -> DataFrame:
    """One row per document: matches (templates found, with their containment) and licenses (their names before the slash)."""
    if templates is None:
        templates = TEMPLATES | whole_texts()
    elif isinstance(templates, DataFrame):
        templates = templates_of(templates)
    Templates(templates)  # tells of bad templates before the job runs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64())]))
        for piece in C.pieces(batches, "__text"):
            found = known.matches(piece.column("__text"), containment)
            matches = pa.array([[{"template": n, "containment": s} for n, s in f] for f in found], kind)
            names = pa.array([sorted({n.split("/")[0] for n, _ in f}) for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([piece.column("__id"), matches, names], [id_col, "matches", "licenses"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(work, f"`{id_col}` {id_type}, matches array<struct<template:string,containment:double>>, licenses array<string>")
