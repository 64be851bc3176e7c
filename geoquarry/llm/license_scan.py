"""License scans: MinHash bands over text windows find templates, shingle containment proves them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cuts, gram_hashes, mix, word_hashes

SHINGLE = 5
MIN_CONTAINMENT = 0.8
#: Bands of one MinHash each. A window of two template lengths that holds 0.8 of a template's
#: shingles has a Jaccard similarity of 0.19 at least (see ``band_odds``), so 48 bands miss it with a
#: probability of (1 - 0.19) ** 48 < 5e-5.
BANDS = 48

#: License notices, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright",
}

_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_odds(bands: int = BANDS, containment: float = MIN_CONTAINMENT) -> float:
    """Least probability that a window meets a template that it holds.

    A template has more than half and at most all of the ``size`` shingles of its class; a window
    has twice as many words as the class, so at most ``2 * size`` shingles. Their Jaccard similarity
    is least for the shortest template: 0.5 c / (2 + 0.5 (1 - c)).
    """
    jaccard = 0.5 * containment / (2 + 0.5 * (1 - containment))
    return 1 - (1 - jaccard) ** bands


def signature(shingles: np.ndarray) -> np.ndarray:
    return mix(shingles[None, :] ^ _SEEDS[:, None]).min(axis=1)


class Index:
    """Templates by size class: shingles, and the templates of each band's value."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words, _, _, rows = word_hashes(pa.array(list(templates.values()), pa.string()))
        grams, whole = gram_hashes(words, rows, SHINGLE)
        self.shingles, self.order = [], []
        self.classes = defaultdict(lambda: defaultdict(list))
        for k, (first, last) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
            own = np.unique(grams[first:last][whole[first:last]])
            if not len(own):
                raise ValueError(f"template {self.names[k]} has fewer than {SHINGLE} words")
            self.shingles.append(own)
            places = defaultdict(list)
            for at, gram in enumerate(grams[first:last][whole[first:last]].tolist()):
                places[gram].append(at)
            self.order.append(places)
            size = 1 << int(last - first - 1).bit_length()
            for band, value in enumerate(signature(own).tolist()):
                self.classes[size][band, value].append(k)
        self.all = np.unique(np.concatenate(self.shingles)) if templates else np.empty(0, np.uint64)

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the windows of a class that hold a template shingle at the given words.

        Window k has the words from ``k * size`` to ``(k + 2) * size``, so every stretch of ``size``
        words lies in one. Windows without any shingle of a template can't meet one.
        """
        return np.unique(np.concatenate((at // size, at // size - 1)).clip(0))

    def matches(self, grams: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Template, containment, first and last shingle of each place of a text."""
        found = []
        for size, bands in self.classes.items():
            verified = defaultdict(list)
            for window in self.windows(hits, size).tolist():
                start, end = window * size, (window + 2) * size
                held = np.unique(grams[start:end])
                if not len(held):
                    continue
                values = enumerate(signature(held).tolist())
                for k in {k for pair in values for k in bands.get(pair, ())}:
                    if np.isin(self.shingles[k], held).mean() >= MIN_CONTAINMENT:
                        verified[k].append((start, end))
            for k, spans in verified.items():
                found += self._places(k, grams, hits, spans, 2 * size)
        return self._best(found)

    def _places(self, k, grams, hits, spans, reach) -> list[tuple[int, float, int, int]]:
        """Places of a template in the windows that hold it.

        A copy is a stretch of shingles in the template's order, a window long at most. A window
        without such a stretch, where parts are in another order, is a place as a whole.
        """
        near = np.unique(np.concatenate([hits[(hits >= a) & (hits < b)] for a, b in spans]))
        near = near[np.isin(grams[near], self.shingles[k])].tolist()
        order, runs, last = self.order[k], [], -1
        for at in near:
            places = order[int(grams[at])]
            later = next((t for t in places if t > last), None)
            if later is None or not runs or at - runs[-1][0] >= reach:
                runs.append([])
                later = places[0]
            runs[-1].append(at)
            last = later
        found = []
        for whole in (False, True):
            if whole:
                free = [s for s in spans if all(b < s[0] or a >= s[1] for _, _, a, b in found)]
                runs = [[at for at in near if a <= at < b] for a, b in free]
            for run in runs:
                share = len(set(grams[run].tolist())) / len(self.shingles[k])
                if share >= MIN_CONTAINMENT:
                    found.append((k, share, run[0], run[-1]))
        return found

    def _best(self, found: list[tuple[int, float, int, int]]) -> list[tuple[int, float, int, int]]:
        """Places that stay where some overlap.

        One inside a place of a longer template goes, whatever its containment; of others the better
        containment stays, then the longer place, then the earlier template.
        """

        def nested(one) -> bool:
            k, _, a, b = one
            return any(
                c <= a and b <= d and len(self.shingles[j]) > len(self.shingles[k]) for j, _, c, d in found
            )

        order = sorted(set(found), key=lambda m: (nested(m), -m[1], m[2] - m[3], m[0], m[2]))
        kept: list[tuple[int, float, int, int]] = []
        for one in order:
            if all(one[3] < c or one[2] > d for _, _, c, d in kept):
                kept.append(one)
        return sorted(kept, key=lambda m: (m[2], m[0]))


MATCHES = "doc_id long, license string, containment double, start long, end long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, license, containment, start, end)`` for each place of a template in a document.

    ``docs(doc_id, text)``. Templates fall into classes by length; windows of two class lengths,
    overlapping by half, are looked up by MinHash bands, and a template counts when at least 0.8 of
    its distinct 5-word shingles are in the window. Words are runs of letters and digits in lower
    case. Start and end are bytes of the lower-case text, around the shingles of the place. A template
    inside a longer one that counts is not named; of other templates in overlapping places the one with
    the better containment is. Null and empty texts hold none; equal rows give equal rows. No shuffle.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in cuts(batches):
            words, starts, ends, rows = word_hashes(batch.column("text"))
            grams, whole = gram_hashes(words, rows, SHINGLE)
            hits = np.flatnonzero(whole & np.isin(grams, index.all))
            row_of = np.searchsorted(rows, hits, side="right") - 1
            out = []
            for row in np.unique(row_of).tolist():
                first, last = rows[row], max(rows[row], rows[row + 1] - SHINGLE + 1)
                mine = hits[row_of == row] - first
                for k, share, a, b in index.matches(grams[first:last], mine):
                    span = int(starts[first + a]), int(ends[first + b + SHINGLE - 1])
                    out.append((row, index.names[k], share, *span))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array([o[0] for o in out], pa.int64())),
                    *(pa.array([o[k + 1] for o in out], kind) for k, kind in enumerate(kinds)),
                ],
                names=[c.split()[0] for c in MATCHES.split(", ")],
            )

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInArrow(run, MATCHES)
