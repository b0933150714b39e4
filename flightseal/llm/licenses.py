"""License notices in texts by patience alignment with templates.

Words that occur once in the text and once in the template are anchors; the
longest increasing run of them is kept, and the gaps between are aligned in the
same way. Where a gap has no anchors its longest common subsequence counts.
Coverage is the share of the template's words that are aligned. Of matches that
mostly share their words of the text only the one with the most words stays,
and the phrases that tell a template from similar ones must be there unbroken.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: A notice has this share of its template's words, within at most SPREAD times as many words of text.
COVERAGE, SPREAD = 0.8, 2.0

# Notices as they are commonly written.
TEMPLATES: dict[str, str] = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-2-clause-name": "Released under the BSD 2-Clause License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
    "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
    "bsd-3-clause-name": "Released under the BSD 3-Clause License.",
    "bsd-name": "Released under the BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-nd-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-sa-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nd-4.0-text": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or "
    "neighboring rights to this work.",
    "cc0-1.0-name": "Released under CC0 1.0 Universal.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License version 2 as published by the Free Software Foundation.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this '
    "file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
    "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely",
}

# The phrases that tell a notice from similar ones; a match has each of them unbroken.
KEYS: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("GNU Affero General Public License", "version 3"),
    "agpl-3.0-header": ("GNU Affero General Public License", "version 3"),
    "apache-2.0": ("Apache License", "2.0"),
    "apache-2.0-header": ("Apache License", "2.0"),
    "boost-1.0": ("Boost Software License",),
    "bsd-2-clause-name": ("BSD 2-Clause",),
    "bsd-3-clause": ("endorse or promote products",),
    "bsd-3-clause-name": ("BSD 3-Clause",),
    "bsd-name": ("BSD License",),
    "cc-by-4.0": ("CC BY 4.0",),
    "cc-by-4.0-text": ("Attribution 4.0",),
    "cc-by-nc-4.0": ("CC BY-NC 4.0",),
    "cc-by-nc-4.0-text": ("Attribution-NonCommercial 4.0",),
    "cc-by-nc-nd-4.0": ("CC BY-NC-ND 4.0",),
    "cc-by-nc-nd-4.0-text": ("Attribution-NonCommercial-NoDerivatives 4.0",),
    "cc-by-nc-sa-4.0": ("CC BY-NC-SA 4.0",),
    "cc-by-nc-sa-4.0-text": ("Attribution-NonCommercial-ShareAlike 4.0",),
    "cc-by-nd-4.0": ("CC BY-ND 4.0",),
    "cc-by-nd-4.0-text": ("Attribution-NoDerivatives 4.0",),
    "cc-by-sa-4.0": ("CC BY-SA 4.0",),
    "cc-by-sa-4.0-text": ("Attribution-ShareAlike 4.0",),
    "cc0-1.0": ("waived all copyright",),
    "cc0-1.0-name": ("CC0 1.0",),
    "epl-2.0": ("Eclipse Public License", "2.0"),
    "gpl-2.0": ("GNU General Public License", "version 2"),
    "gpl-2.0-header": ("GNU General Public License", "version 2"),
    "gpl-2.0-only": ("GNU General Public License", "version 2"),
    "gpl-3.0": ("GNU General Public License", "version 3"),
    "gpl-3.0-header": ("GNU General Public License", "version 3"),
    "isc": ("with or without fee",),
    "lgpl-2.1": ("Lesser General Public License", "version 2.1"),
    "lgpl-2.1-header": ("Lesser General Public License", "version 2.1"),
    "lgpl-3.0": ("Lesser General Public License", "version 3"),
    "lgpl-3.0-header": ("Lesser General Public License", "version 3"),
    "mit": ("MIT License",),
    "mpl-1.1": ("Mozilla Public License", "1.1"),
    "mpl-2.0": ("Mozilla Public License", "2.0"),
    "reserved": ("All rights reserved",),
    "unlicense": ("unencumbered software",),
}

_WORDS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lowered."""
    return (text or "").encode().lower().translate(_WORDS).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that increases in both; `pairs` come by rising first and, there, falling second."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before[i] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [b], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of the words that are unique in a and in b, by place in a."""
    once_a: dict = {}
    for i, w in enumerate(a):
        once_a[w] = -1 if w in once_a else i
    once_b: dict = {}
    for i, w in enumerate(b):
        once_b[w] = -1 if w in once_b else i
    return sorted((i, once_b[w]) for w, i in once_a.items() if i >= 0 and once_b.get(w, -1) >= 0)


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), both rising: patience alignment."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        low_a, high_a, low_b, high_b = todo.pop()
        while low_a < high_a and low_b < high_b and a[low_a] == b[low_b]:
            out.append((low_a, low_b))
            low_a, low_b = low_a + 1, low_b + 1
        while low_a < high_a and low_b < high_b and a[high_a - 1] == b[high_b - 1]:
            high_a, high_b = high_a - 1, high_b - 1
            out.append((high_a, high_b))
        if low_a == high_a or low_b == high_b:
            continue
        part_a, part_b = a[low_a:high_a], b[low_b:high_b]
        chain = _increasing(_anchors(part_a, part_b))
        if not chain:
            where: dict = {}
            for j, w in enumerate(part_b):
                where.setdefault(w, []).append(j)
            same = [(i, j) for i, w in enumerate(part_a) for j in reversed(where.get(w, ()))]
            out += [(low_a + i, low_b + j) for i, j in _increasing(same)]
            continue
        at_a, at_b = 0, 0
        for i, j in [*chain, (len(part_a), len(part_b))]:
            todo.append((low_a + at_a, low_a + i, low_b + at_b, low_b + j))
            if i < len(part_a):
                out.append((low_a + i, low_b + j))
            at_a, at_b = i + 1, j + 1
    return sorted(out)


def _places(template: list[bytes], phrase: list[bytes]) -> tuple[list[int], int]:
    """Where the phrase starts in the template, and its length."""
    starts = [i for i in range(len(template) - len(phrase) + 1) if template[i : i + len(phrase)] == phrase]
    if not starts:
        raise ValueError(f"{b' '.join(phrase).decode()!r} is not in its template")
    return starts, len(phrase)


def _unbroken(pairs: list[tuple[int, int]], keys: list[tuple[list[int], int]]) -> bool:
    """Whether every key phrase of the template is aligned with a run of neighbours in the text."""
    at = dict(pairs)
    return all(any(i in at and all(at.get(i + n) == at[i] + n for n in range(size)) for i in starts) for starts, size in keys)


def _tight(own: list[int], window: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The alignment within the shortest stretch that ends, then starts, where the aligned words allow.

    Words of the notice that stand by chance before or behind it do not stretch it.
    """
    end = -1
    for i, _ in pairs:
        end = window.index(own[i], end + 1)
    start = end + 1
    for i, _ in reversed(pairs):
        start = next(j for j in range(start - 1, -1, -1) if window[j] == own[i])
    again = [(i, start + j) for i, j in align(own, window[start : end + 1])]
    return again if len(again) >= len(pairs) else pairs


class Templates:
    """Templates as word numbers. keys: phrases by template name that a match must have unbroken."""

    def __init__(self, named: Mapping[str, str], coverage: float = COVERAGE, spread: float = SPREAD, keys: Mapping[str, tuple[str, ...]] = KEYS):
        self.coverage, self.spread = coverage, spread
        self.names = sorted(named)
        split = [words(named[n]) for n in self.names]
        self.numbers: dict[bytes, int] = {}
        for w in (w for s in split for w in s):
            self.numbers.setdefault(w, len(self.numbers))
        self.words = [[self.numbers[w] for w in s] for s in split]
        self.has = np.zeros((len(self.names), len(self.numbers) + 1), bool)  # the last: any other word
        for has, own in zip(self.has, self.words):
            has[own] = True
        self.keys = [[_places(w, words(key)) for key in keys.get(n, ())] for n, w in zip(self.names, split)]

    def find(self, text: str | None) -> tuple[int, list[tuple[str, float, int, int, int]]]:
        """(words in the text, notices as (name, coverage, aligned words, first word, last word)), by name and place.

        A window that holds too few of a template's words cannot reach the
        coverage and is passed over; all others are aligned, from left to right.
        A match goes if most of its words are in one with more words, then the
        higher coverage, then the earlier place.
        """
        numbers, other = self.numbers, len(self.numbers)
        split = words(text)
        ids = np.array([numbers.get(w, other) for w in split], np.int32)
        known = np.flatnonzero(ids != other)
        found = []
        for name, own, has, keys in zip(self.names, self.words, self.has, self.keys):
            if not own:
                continue
            need = int(np.ceil(self.coverage * len(own) - 1e-9))
            places = known[has[ids[known]]]
            if len(places) < need:
                continue
            width = max(len(own), int(self.spread * len(own)))
            enough = places[need - 1 :] - places[: len(places) - need + 1] < width
            free = 0
            for start in places[: len(enough)][enough].tolist():
                if start < free:
                    continue
                window = ids[start : start + width].tolist()
                if len(set(window).intersection(own)) < self.coverage * len(set(own)) - (len(own) - need):
                    continue
                pairs = align(own, window)
                if len(pairs) < need or pairs[0][1] != 0:
                    continue
                pairs = _tight(own, window, pairs)
                if _unbroken(pairs, keys):
                    found.append((name, len(pairs) / len(own), [start + j for _, j in pairs]))
                    free = found[-1][2][-1] + 1
        found.sort(key=lambda x: (-len(x[2]), -x[1], x[2][0], x[0]))
        taken: set[int] = set()
        kept = []
        for name, share, at in found:
            if 2 * sum(i in taken for i in at) <= len(at):
                kept.append((name, share, len(at), at[0], at[-1]))
                taken.update(at)
        return len(split), sorted(kept, key=lambda x: (x[0], x[3]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, spread: float = SPREAD, keys: Mapping[str, tuple[str, ...]] = KEYS) -> DataFrame:
    """(doc_id, n_words, n_notices, licenses, best, best_coverage, first_word, last_word) of every row.

    licenses: the names found, each once, comma-separated; best: the notice with
    the highest coverage, then the most words, then the first place. A text
    without a notice (null and empty too) has none and nulls; a null doc_id stays
    null; repeated rows keep a row each; an empty table gives no rows; other
    columns are not read. keys: see `Templates`; those of absent templates are ignored.
    """
    model = Templates(templates, coverage, spread, keys)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "n_words", "n_notices", "licenses", "best", "best_coverage", "first_word", "last_word"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, found = model.find(text)
                best = min(found, key=lambda x: (-x[1], -x[2], x[3], x[0])) if found else (None,) * 5
                rows.append((doc, n, len(found), ",".join(sorted({x[0] for x in found})) or None, best[0], best[1], best[3], best[4]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long, n_words long, n_notices long, licenses string, best string, best_coverage double, first_word long, last_word long"
    return texts(docs).mapInArrow(run, schema)
