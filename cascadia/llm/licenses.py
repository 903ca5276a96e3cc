"""Scans whole texts for licence notices.

Overlapping windows of a text, of about the length of the templates sought, get MinHash signatures over their
five-word shingles. A window that agrees with a template in one band or more is a candidate; exact containment of the
template's shingles in the window decides. A template of m shingles lies whole in a window of at most 3 m, so that its
Jaccard similarity to the window is a third at least, a quarter if a fifth of its shingles is changed: with BANDS bands
of one row the chance to miss it is at most (1 - 1/4) ** BANDS, 0.0001. Templates of one shingle are found always.
Words are taken without punctuation and comment marks at their edges. Licences compete for a passage: the one with the
greatest containment has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cascadia.llm.words import Words, cut, shingles, slices

BANDS, WORDS = 32, 5

# fixed values: the notices sought
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "under the Apache License, Version 2.0", "under the Apache License 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "mit": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Words in a row that tell versions and families apart; a template that has them is found only with them.
KEYS: dict[str, list[str]] = {}

_GNU = {"gpl": ("", "program", ("2", "3")), "lgpl": ("Lesser ", "library", ("2.1", "3")), "agpl": ("Affero ", "program", ("3",))}
_DATES = {"gpl2": "2, June 1991", "gpl3": "3, 29 June 2007", "lgpl2.1": "2.1, February 1999", "lgpl3": "3, 29 June 2007", "agpl3": "3, 19 November 2007"}
for _name, (_kind, _what, _versions) in _GNU.items():
    for _v in _versions:
        _full = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES.setdefault(_full, []).extend(
            [f"This work is licensed under the GNU {_kind}General Public License, version {_v}.", f"under the GNU {_kind}General Public License, version {_v}", f"GNU {_kind}General Public License v{_v}", f"GNU {_kind}General Public License v{_v}.0", f"GNU {_kind}General Public License Version {_DATES[_name + _v]} Copyright"]
            + [f"This {x} is free software{c} you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version." for x in dict.fromkeys(("program", _what)) for c in (":",)]
        )
        KEYS[_full] = [f"gnu {_kind}general".lower(), f"version {_v}"]
_RIGHTS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for _name, _title in _RIGHTS.items():
    for _v, _port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES.setdefault(f"cc-{_name}-{_v}", []).extend([f"Licensed under CC {_name.upper()} {_v}", f"licensed under a CC {_name.upper()} {_v}", f"This work is licensed under a Creative Commons {_title} {_v} {_port} License.", f"under the Creative Commons {_title} {_v}", f"Creative Commons {_title} {_v} {_port} Public License"])
        KEYS[f"cc-{_name}-{_v}"] = [_v]
for _name, _title in {"mit": "MIT License", "bsd": "BSD License", "isc": "ISC License", "zlib": "zlib License", "unlicense": "The Unlicense"}.items():
    _title = _title.removeprefix("The ")
    TEMPLATES.setdefault(_name, []).extend(x for v in ("Licensed", "Released", "Distributed", "Available") if len((x := f"{v} under the {_title}").split()) >= WORDS)
    TEMPLATES[_name].append(f"under the terms of the {_title}")
for _name, _texts in {
    "bsd": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc": [f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for x in ("and", "and/or")],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0-1.0": ["Licensed under CC0 1.0 Universal", "released under the CC0 1.0", "licensed under the CC0 1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "Creative Commons CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Creative Commons Legal Code CC0 1.0 Universal"],
    "mpl-2.0": ["If a copy of the MPL was not distributed with this file, You can obtain one at", "under the Mozilla Public License 2.0", "Mozilla Public License Version 2.0 1. Definitions"],
    "mpl-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "epl-1.0": ["made available under the terms of the Eclipse Public License v1.0"],
    "epl-2.0": ["made available under the terms of the Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License v2.0"],
    "bsl-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
}.items():
    TEMPLATES.setdefault(_name, []).extend(_texts)


def trimmed(w: Words) -> tuple[Words, np.ndarray]:
    """The words without ASCII punctuation and quotation marks at their edges, and the place of each among all; words
    of nothing else are left out."""
    x = w.data
    word = (x >= 0x80) | (x >= 48) & (x <= 57) | (x >= 65) & (x <= 90) | (x >= 97) & (x <= 122)
    quote = np.flatnonzero((x[:-2] == 0xE2) & (x[1:-1] == 0x80) & (x[2:] >= 0x98) & (x[2:] <= 0x9F)) if len(x) > 2 else np.empty(0, np.int64)
    for i in range(3):
        word[quote + i] = False
    at = np.flatnonzero(word)
    lo, hi = np.searchsorted(at, w.starts), np.searchsorted(at, w.ends)
    keep = np.flatnonzero(hi > lo)
    return Words(x, at[lo[keep]], at[hi[keep] - 1] + 1, np.searchsorted(keep, w.first)), keep


def _windows(a: np.ndarray, size: int, mins: dict[int, np.ndarray]) -> np.ndarray:
    """Minima of each size consecutive values of a; mins keeps those of powers of two."""
    p = 1
    mins.setdefault(1, a)
    while p * 2 <= size:
        if p * 2 not in mins:
            mins[p * 2] = np.minimum(mins[p][:-p], mins[p][p:])
        p *= 2
    return mins[p] if p == size else np.minimum(mins[p][: len(a) - size + 1], mins[p][size - p : len(a) - p + 1])


def _repeats(a: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Places of shingles in passages that have each shingle once."""
    seen, edges = set(), [0]
    for i, x in enumerate(a[there].tolist()):
        if x in seen:
            edges.append(i)
            seen.clear()
        seen.add(x)
    return np.split(there, edges[1:])


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        rng = np.random.default_rng(9)
        self.factors = rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)
        self.threshold, self.templates, self.classes, self.keys = threshold, [], {}, []
        for name, texts in templates.items():
            for text in texts:
                w, _ = trimmed(cut(pa.array([text]), lower=True))
                found = shingles(w, w.hashes()[0], WORDS)[0]
                own = np.unique(found)
                said = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends, strict=True)]
                with_key = [[i for i in range(len(found)) if f" {k} " in f" {' '.join(said[i : i + WORDS])} "] for k in KEYS.get(name, ())]
                self.keys.append([found[i] for i in with_key if i])
                size = 1 << (len(own) - 1).bit_length()
                self.classes.setdefault(size, []).append(len(self.templates))
                self.templates.append((name, own))
        self.least = np.stack([(own[:, None] * self.factors[None, :]).min(axis=0) for _, own in self.templates])

    def _share(self, t: int, there: np.ndarray) -> float:
        """The share of a template's shingles among those there, 0 without its key words."""
        return len(np.unique(there)) / len(self.templates[t][1]) if all(np.isin(k, there).any() for k in self.keys[t]) else 0.0

    def scan(self, texts: pa.Array) -> list[tuple[int, str, float, int]]:
        """(text, licence, containment, first word) of the best match of each licence in each text."""
        whole = cut(texts, lower=True)
        w, place = trimmed(whole)
        a, first = shingles(w, w.hashes()[0], WORDS, whole=False)
        if not len(a):
            return []
        longest = 3 * max(self.classes)
        padded = np.r_[a, np.zeros(longest, np.uint64)]
        hits = set()
        for band in range(BANDS):
            v = padded * self.factors[band]
            v[len(a) :] = ~np.uint64(0)
            mins: dict[int, np.ndarray] = {}
            for size, members in self.classes.items():
                if size == 1 and band:
                    continue  # one band is exact
                step = max(1, size // 2)
                low = _windows(v, size + step - (size == 1), mins)[: len(a) : step]
                least = np.unique(self.least[members, band])
                some = np.flatnonzero(least[np.minimum(np.searchsorted(least, low), len(least) - 1)] == low)
                for t in members if len(some) else ():
                    hits.update((t, int(x) * step, size + step) for x in some[low[some] == self.least[t, band]])
        found: dict[int, dict[tuple[int, bytes], tuple[float, np.ndarray]]] = {}
        for t, at, size in sorted(hits):
            name, own = self.templates[t]
            d = int(np.searchsorted(first, at, "right")) - 1
            while d < len(first) - 1 and first[d] < at + size:  # a window that runs over a text's end is looked at in each text
                lo, hi = max(at, first[d]), min(at + size, first[d + 1])
                there = lo + np.flatnonzero(np.isin(a[lo:hi], own))
                if len(there) >= self.threshold * len(own):
                    runs = [(share, x) for x in _repeats(a, there) if (share := self._share(t, a[x])) >= self.threshold]
                    if not runs and (share := self._share(t, a[there])) >= self.threshold:
                        runs = [(share, there)]
                    for share, x in runs:
                        found.setdefault(d, {})[t, x.tobytes()] = share, x
                d += 1
        out = []
        for d, own in found.items():
            # the best and longest first; what another licence has taken most of is its passage
            taken: dict[int, str] = {}
            best: dict[str, tuple[float, int]] = {}
            for (t, _), (share, there) in sorted(own.items(), key=lambda x: (-x[1][0], -len(x[1][1]), x[1][1][0], x[0][0])):
                name = self.templates[t][0]
                if 2 * sum(taken.get(i, name) != name for i in there.tolist()) > len(there):
                    continue
                for i in there.tolist():
                    taken.setdefault(i, name)
                if share > best.get(name, (0, 0))[0]:
                    best[name] = share, int(place[w.first[d] + there[0] - first[d]] - whole.first[d])
            out += [(d, name, *x) for name, x in best.items()]
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """Per document and licence found in it: doc_id, license, containment (the share of the best template's shingles)
    and first_word (where it begins).

    Null and empty texts, and those shorter than five words, have no notices. Repeated doc_ids and rows are scanned
    each; a null doc_id is kept. Templates have five words or more. An empty table gives no rows. Other columns are
    ignored.
    """
    scanner = Scanner(templates or TEMPLATES, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            d, name, share, word = zip(*found, strict=True) if (found := scanner.scan(b.column("text"))) else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d, pa.int64())), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(word, pa.int64())], names=["doc_id", "license", "containment", "first_word"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, containment double, first_word long")


def op8_licenses(spark, sf_dir):
    """Licence notices in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
