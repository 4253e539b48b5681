"""License scans: MinHash bands over overlapping windows, verified by exact containment.

Texts become hashes of five-word shingles. A template of n shingles is sought
with blocks of 2**k >= n shingles: windows of two blocks, one block apart, so
that every passage of n shingles lies whole in one of them. With ``BANDS``
bands of one MinHash each, a passage that holds the wanted share of a template
has a Jaccard similarity of at least share * n / (4 n + n) = 0.16 with its
window, and is retrieved with a probability of at least
1 - (1 - 0.16) ** 96 > 1 - 6e-8. What is retrieved is verified over the whole
text by exact shingle containment.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import prepare
from colloquy.llm.hashing import RangeHashes, mixed

SHINGLE = 5
SHARE = 0.8
BANDS = 96
#: Shingles that are signed at once.
CHUNK = 1 << 15

#: Notices as their licenses word them. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's five-word shingles, in order; words are letters and digits, without ASCII case."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    inner = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    edge = np.diff(np.r_[0, inner.astype(np.int8), 0])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start) < SHINGLE:
        return np.zeros(0, np.uint64)
    word = RangeHashes(raw).of(start, end)
    n = len(word) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    return mixed(out)


def signatures(shingles: np.ndarray, bands: int) -> np.ndarray:
    """(bands, shingles) values whose minima are MinHashes."""
    odd = mixed(np.arange(1, bands + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    v = x[None] * odd[:, None]
    return (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


class Templates:
    """Templates by the level (power of two) of their blocks."""

    def __init__(self, texts: dict[str, str], bands: int = BANDS):
        self.bands = bands
        self.names = sorted(texts)
        self.shingles = [np.unique(shingle_hashes(texts[n])) for n in self.names]
        if any(not len(s) for s in self.shingles):
            raise ValueError(f"a template needs {SHINGLE} words")
        self.length = [len(shingle_hashes(texts[n])) for n in self.names]
        self.minima = [signatures(s, bands).min(axis=1) for s in self.shingles]
        self.levels: dict[int, list[int]] = {}
        for k, n in enumerate(self.length):
            self.levels.setdefault(math.ceil(math.log2(n)), []).append(k)

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Templates that share a band with a window of the text."""
        found: set[int] = set()
        top = 1 << max(self.levels)
        for at in range(0, max(1, len(shingles)), CHUNK):
            part = shingles[at : at + CHUNK + 2 * top]
            v = signatures(part, self.bands)
            pad = -len(part) % top
            if pad:
                v = np.pad(v, ((0, 0), (0, pad)), constant_values=np.iinfo(np.uint32).max)
            for level in range(max(self.levels) + 1):
                if level:
                    v = np.minimum(v[:, ::2], v[:, 1::2])
                wanted = [t for t in self.levels.get(level, ()) if t not in found]
                if wanted:
                    windows = np.minimum(v[:, :-1], v[:, 1:]) if v.shape[1] > 1 else v
                    for t in wanted:
                        if (windows == self.minima[t][:, None]).any():
                            found.add(t)
        return found

    def matches(self, shingles: np.ndarray, t: int, share: float) -> list[tuple[int, int, float]]:
        """(first shingle, shingles, containment) of the template's passages, from left to right.

        A passage starts at one of the template's shingles and is at most a
        quarter longer than it; it has at least ``share`` of its shingles.
        """
        own = self.shingles[t]
        k = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        hits = np.flatnonzero(own[k] == shingles)
        which = k[hits]
        width, need = self.length[t] + self.length[t] // 4, math.ceil(share * len(own) - 1e-9)
        out, i = [], 0
        while i < len(hits):
            j = int(np.searchsorted(hits, hits[i] + width))
            n = len(np.unique(which[i:j])) if j - i >= need else 0
            if n >= need:
                out.append((int(hits[i]), int(hits[j - 1] - hits[i] + 1), n / len(own)))
                i = j
            else:
                i += 1
        return out


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, n_matches, n_licenses, licenses (names with commas) and matches of every row.

    ``docs`` has doc_id and text; ``texts`` are the templates by name. A match
    is (license, start_word, n_words, containment). Null, empty and shorter
    texts than five words match nothing. Repeated rows are returned each.
    Extra columns are ignored. An empty table gives no rows.
    """
    templates = Templates(texts or TEMPLATES)
    prepare(docs.sparkSession)
    match = "array<struct<license:string,start_word:long,n_words:long,containment:double>>"
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])
    )

    def scan(batches):
        for batch in batches:
            all_found = []
            for text in batch["text"].to_pylist():
                shingles = shingle_hashes(text)
                found = []
                for t in sorted(templates.candidates(shingles)) if len(shingles) else ():
                    found += [
                        {"license": templates.names[t], "start_word": a, "n_words": n + SHINGLE - 1, "containment": c}
                        for a, n, c in templates.matches(shingles, t, share)
                    ]
                all_found.append(sorted(found, key=lambda m: (m["start_word"], m["license"])))
            names = [sorted({m["license"] for m in found}) for found in all_found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(f) for f in all_found], pa.int64()),
                    pa.array([len(n) for n in names], pa.int64()),
                    pa.array([",".join(n) for n in names], pa.string()),
                    pa.array(all_found, kind),
                ],
                ["doc_id", "n_matches", "n_licenses", "licenses", "matches"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        scan, f"doc_id long, n_matches long, n_licenses long, licenses string, matches {match}"
    )
