"""Patience alignment: its rules, its bound, and notices in texts."""

import random
import re

import pytest

from flightseal.llm import licenses
from flightseal.llm.queries import op1_license
from tests.conftest import SF


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(14))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(14))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == lcs(a, b)
    assert licenses.align(list("xaybz"), list("aqb")) == [(1, 0), (3, 2)]
    assert len(licenses.align(list("aabb"), list("abab"))) == 3


def test_notices():
    find = licenses.Templates(licenses.TEMPLATES).find
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choice(["the", "under", "version", "is", "lorem", "2"]) + rng.choice(["", "x"]) for _ in range(n))
    for name, text in licenses.TEMPLATES.items():
        n, found = find(f"{noise(300)} {text.upper()} {noise(200)}\n{text}")
        assert [(x[1], x[4] - x[3] + 1) for x in found if x[0] == name] == [(1.0, len(licenses.words(text)))] * 2
    changed = licenses.TEMPLATES["mit-grant"].replace("free of charge", "gratis").replace("merge", "bring together")
    assert [x[0] for x in find(noise(50) + " " + changed)[1]] == ["mit-grant"]
    assert find(noise(5000))[1] == [] and find(None) == (0, []) and find("") == (0, [])
    assert find("licensed " + noise(40) + " under the apache " + noise(40) + " license version 2.0")[1] == []


@pytest.mark.parametrize("text, names", [
    ("Released under the BSD License.", ["bsd-name"]),
    ("Released under the Apache License.", []),
    ("Released under the GPL License.", []),
    ("Licensed under the MIT License.", ["mit"]),
    ("Licensed under Apache License 2.0", []),  # six of eight words
    ("Licensed under the Apache License 2.0", ["apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("Licensed under CC BY 4.0.", ["cc-by-4.0"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0"]),
    ("Licensed under CC BY-SA 3.0.", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["lgpl-2.1"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["cc-by-sa-4.0-text"]),
    ("This file is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gpl-3.0-header"]),
    ("All the rights are reserved by the people", []),
    ("Copyright X. All rights reserved. Licensed under the Apache License, Version 2.0.", ["apache-2.0", "reserved"]),
])
def test_names(text, names):
    """The right name and no other, also inside other words."""
    find = licenses.Templates(licenses.TEMPLATES).find
    for around in ("", "lorem ipsum dolor sit amet " * 20):
        assert [x[0] for x in find(around + text + " " + around)[1]] == names


def test_templates_name_themselves_alone():
    find = licenses.Templates(licenses.TEMPLATES).find
    for name, text in licenses.TEMPLATES.items():
        assert [(x[0], x[1]) for x in find(text)[1]] == [(name, 1.0)]
    with pytest.raises(ValueError):
        licenses.Templates({"a": "one two"}, keys={"a": ("three",)})


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op1_license(spark, SF).collect()}
    assert len(got) == len(rows)
    hits = 0
    for r in rows:
        line = re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", r.text.lower())
        for name, text in licenses.TEMPLATES.items():
            if f" {' '.join(w.decode() for w in licenses.words(text))} " in f" {line} ":
                hits += 1
                assert name in got[r.doc_id].licenses.split(",")
    assert hits


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (None, "All rights reserved.", "z"), (3, "x " * 60000 + "Released under the MIT License.", "z"), (3, "a", "z"), (3, "a", "z")], "doc_id long, text string, best string")
    got = sorted(((r.doc_id or 0, r.n_notices, r.best, r.first_word) for r in licenses.scan(docs).collect()), key=str)
    assert got == [(0, 1, "reserved", 0), (1, 0, None, None), (2, 0, None, None), (3, 0, None, None), (3, 0, None, None), (3, 1, "mit", 60000)]
    assert licenses.scan(docs.limit(0)).count() == 0
