"""Small cases of quality rules, line dedup, decontamination and licences: nulls, empty and very long texts, ties, clashing names."""

import itertools
import random

import pytest

from tests.oracle import connection, rows
from tidemark.llm import decontaminate, licences, lines, quality, queries

WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def table(spark, texts, extra=True):
    rows_ = [(i, t, "w", 1) for i, t in texts]
    return spark.createDataFrame(rows_, "doc_id long, text string, words string, __row int" if extra else "doc_id long, text string, a string, b int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert rows(got) == rows(connection(sf).sql(queries.SQL[name]).df())


def brute_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    live = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(live) - len(set(live)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_edges(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t", "a\x0bb\x1cc d", "é| ü# 😀", "x y z v w " * 6, "\n".join(["one line here"] * 4), " ".join(r.choice(WORDS) for _ in range(30_000)), " ".join(r.choice("ab") for _ in range(12))]
    texts += [" ".join(r.choice(WORDS[:3]) for _ in range(r.randrange(40))) for _ in range(40)]
    d = table(spark, list(enumerate(texts)) + [(None, "tie"), (0, None)])
    got = quality.score(d).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        if x.doc_id is not None:
            assert tuple(x)[1:7] == brute_quality(texts[x.doc_id])
    assert not quality.score(d.limit(0)).collect()
    good = " ".join(["the quick brown fox jumps over a lazy dog and goes home to sleep", "while others stay in the garden until late at night"])
    k = quality.keep(table(spark, [(1, good), (2, None), (3, "$ # " * 30), (4, good)]))
    assert sorted(x.doc_id for x in k.collect()) == [1, 4] and k.columns == ["doc_id", "text", "words", "__row"]


def edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True))
    s, l = sorted((a, b), key=len)
    return 1 if any(l[:i] + l[i + 1 :] == s for i in range(len(l))) else 2


def brute_lines(texts):
    """Places of lines that repeat an earlier one, all pairs."""
    import re

    all_ = [(-(2**63) if i is None else i, n, re.findall(r"[^\x20\x09-\x0D]+", x.lower())) for i, t in texts for n, x in enumerate((t or "").split("\n"))]
    all_ = sorted((x for x in all_ if x[2]), key=lambda x: x[:2])
    out = set()
    for (i, n, w), (j, m, v) in itertools.combinations(all_, 2):
        if (i, n) < (j, m) and (w == v or min(len(w), len(v)) >= 8 and edit(w, v) <= 1):
            out.add((j, m))
    return out


def test_lines_against_all_pairs(spark):
    r = random.Random(2)
    base = [[r.choice(WORDS) for _ in range(r.randrange(6, 14))] for _ in range(12)]

    def vary():
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = r.choice([[], [r.choice(WORDS)]])
        return " ".join(w)

    texts = [(i, "\n".join(r.choice([vary(), vary(), "", "short"]) for _ in range(5))) for i in range(50)]
    texts += [(60, None), (61, ""), (None, vary()), (62, " ".join(["word%d" % k for k in range(5000)])), (63, " ".join(["word%d" % k for k in range(5000) if k != 77]))]
    d = table(spark, texts)
    got = lines.repeats(d).collect()
    assert {(x.doc_id, x.line_no) for x in got} == brute_lines(texts)
    assert len(got) == len({(x.doc_id, x.line_no) for x in got})
    out = {x.doc_id: x.text for x in lines.dedupe(d).collect()}
    gone = brute_lines(texts)
    for i, t in texts:
        key = -(2**63) if i is None else i
        left = "\n".join(x for n, x in enumerate((t or "").split("\n")) if (key, n) not in gone)
        if t and left.strip():
            assert out[i] == left
    assert 63 not in out and 62 in out and 60 in out
    assert lines.dedupe(d).columns == d.columns and not lines.report(d.limit(0)).collect()
    twice = table(spark, [(1, "same text of more than a few words stands here"), (1, "same text of more than a few words stands here")])
    assert [x.n_exact for x in lines.report(twice).collect()] == [0, 0]


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "key", "id", "row", "line_no", "exact", "near", "__key", "__id", "half", "w", "a.b"]
    d = spark.createDataFrame([(1, "one line of words", *range(11)), (2, "one line of words\nanother", *range(11, 22)), (3, None, *range(11))], names)
    got = sorted(map(tuple, lines.dedupe(d).collect()))
    assert lines.dedupe(d).columns == names and got == [(1, "one line of words", *range(11)), (2, "another", *range(11, 22)), (3, None, *range(11))]


def test_a_line_too_short_for_near_repeats_stands_between_none(spark):
    foot = "all of this report is for readers"
    texts = [(1, foot), (2, f"{foot} 12"), (3, f"{foot} 13"), (4, f"page {foot}\nno {foot}"), (5, foot.replace(" is ", " is now ")), (6, foot.replace(" is ", " is not "))]
    got = {(x.doc_id, x.line_no) for x in lines.repeats(table(spark, texts)).collect()}
    assert got == brute_lines(texts) == {(3, 0), (4, 1), (6, 0)}


def test_decontamination_edges(spark):
    r = random.Random(3)
    passage = " ".join(r.choice(WORDS) + str(k) for k in range(30))
    cut = " ".join(x if k not in (3, 4) else "other" for k, x in enumerate(passage.split()))
    less = " ".join(x if k not in (3, 5) else "other" for k, x in enumerate(passage.split()))
    half = " ".join(passage.split()[:15])
    long = " ".join("w%d" % r.randrange(10**6) for _ in range(20_000))
    docs = table(spark, [(1, long + " " + passage.upper() + "! " + long), (2, half), (3, None), (4, ""), (5, "x " + cut), (7, less), (None, passage), (1, passage), (6, "a b c")])
    bench = spark.createDataFrame([(1, passage), (2, None), (3, "a b c"), (4, "never seen words in any of these texts at all"), (None, passage), (1, passage)], "item_id long, text string")
    assert {(x.doc_id, x.item_id, x.containment) for x in decontaminate.leaks(docs, bench).collect()} == {(1, 1, 1.0), (5, 1, 21 / 26), (6, 3, 1.0)}
    assert sorted((x.doc_id for x in decontaminate.clean(docs, bench).collect()), key=str) == [2, 3, 4, 7, None]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert not decontaminate.leaks(docs, bench.limit(0)).collect() and not decontaminate.leaks(docs.limit(0), bench).collect()


def brute_leaks(docs, bench):
    import re

    cut = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in docs:
        for j, u in bench:
            w = cut(u)
            if w:
                own = grams(w, min(5, len(w)))
                k = len(own & grams(cut(t), min(5, len(w))))
                if k >= 0.8 * len(own) - 1e-9:
                    out.add((i, j, len(own), k))
    return out


def test_decontamination_against_all_pairs_with_short_items(spark):
    r = random.Random(5)
    bench = [(k, " ".join(r.choice(WORDS) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 4, 5, 6, 8, 9, 16, 17, 40])] + [(50, "what is two plus")]
    docs = [(k, " ".join(r.choice([*WORDS, bench[r.randrange(12)][1]]) for _ in range(r.choice([1, 3, 30, 200])))) for k in range(60)] + [(99, "so what is two plus two then")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.n_shingles, x.n_found) for x in decontaminate.leaks(d, b).collect()}
    assert got == brute_leaks(docs, bench) and (99, 50, 1, 1) in got


def test_licences(spark):
    mit = 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright notice and this permission notice shall be included in all\ncopies. The software is provided "as is", without warranty of any kind.'
    d = table(spark, [(1, mit), (2, None), (3, ""), (None, "All rights reserved."), (4, "Licensed under the Foo licence."), (5, "no terms " * 20_000), (6, "SPDX-License-Identifier: Apache-2.0"), (6, "Licensed under the Apache License, Version 2.0.")])
    got = sorted(((x.doc_id, x.licences) for x in licences.scan(d).collect()), key=str)
    assert got == sorted([(1, "MIT"), (2, ""), (3, ""), (None, "proprietary"), (4, "unknown"), (5, ""), (6, "Apache-2.0"), (6, "Apache-2.0")], key=str)
    assert not licences.scan(d.limit(0)).collect()


def test_licence_phrases_over_line_ends(spark):
    texts = ["All rights\nreserved.", "All rights\treserved", "This is in the public\n * domain.", "// Released\n// under these terms", "Distributed   under terms", "Creative\nCommons Zero", "cc\nby 4.0", "All rights\n\nwere reserved"]
    got = {x.doc_id: x.sentences for x in licences.scan(table(spark, list(enumerate(texts)))).collect()}
    assert got == {0: "all-rights", 1: "all-rights", 2: "public-domain", 3: "released-under", 4: "distributed-under", 5: "cc0-name", 6: "cc-by-4", 7: ""}


BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
GPL = """
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
ZLIB = """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_licences_of_published_texts_and_near_misses(spark):
    import time

    cases = [
        (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (GPL, "GPL-3.0-or-later"), (GPL.replace("General", "Lesser General"), "LGPL-3.0-or-later"), (ZLIB, "Zlib"), (ISC, "ISC"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0"), ("under the Mozilla Public License, v. 2.0", "MPL-2.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("an acc0unt, accc0, cc0x", ""), ("permission is hereby given, free of charge", ""), ("smit license", ""), ("CC BY 4.0 and CC0 and cc0", "CC0-1.0,CC-BY-4.0"),
        (BSD + "\n" + ISC, "BSD-2-Clause,ISC"), ("neither the name of " * 20_000 + "may", ""), ("x " * 200_000 + "MIT Licence", "MIT"),
    ]
    start = time.time()
    assert [(licences.licences(licences.identify(licences.normalised(licences.pa.array([t]))[0].as_py()))) for t, _ in cases] == [x.split(",") if x else [] for _, x in cases]
    assert time.time() - start < 2
    got = {x.doc_id: x.licences for x in licences.scan(table(spark, list(enumerate(t for t, _ in cases)))).collect()}
    assert got == dict(enumerate(x for _, x in cases))
    r = random.Random(8)
    known = licences._known()
    some = [p.strip() for p in known]
    for _ in range(200):
        text = " " + " ".join(r.choice([r.choice(some), r.choice(WORDS), *r.choice(some).split()[:3]]) for _ in range(12)) + " "
        at = sorted((i, i + len(p), n) for p, n in known.items() for i in range(len(text)) if text.startswith(p, i))
        assert licences.identify(text) == [n for i, j, n in at if not any(a <= i and j <= b and b - a > j - i for a, b, _ in at)]


NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation; either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY. See the {name} for more details. You should have received a copy of the {name} along with this program."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (NOTICE.format(name="GNU General Public License", v="2"), "GPL-2.0-or-later"),
        (NOTICE.format(name="GNU Affero General Public License", v="3"), "AGPL-3.0-or-later"),
        (NOTICE.format(name="GNU Lesser General Public License", v="2.1"), "LGPL-2.1-or-later"),
        ("under the terms of version 2 of the GNU General Public License", "GPL-2.0"),
        ("GNU General Public License v3.0", "GPL-3.0"),
        ("GNU GPL v3", "GPL-3.0"),
        ("the GNU General Public License alone", "GPL"),
        ("License: Apache-2.0", "Apache-2.0"),
        ("this is GPL-3.0-only", "GPL-3.0-only"),
        (APACHE, "Apache-2.0"),
        ("see http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
        ('BSD 3-Clause "New" License', "BSD-3-Clause"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("Released under pressure, in the public domain of our hearts", "unknown"),
        ("It was placed in the public domain.", "public-domain"),
    ],
)
def test_licences_by_hand(text, want):
    assert ",".join(licences.licences(licences.identify(licences.normalised(licences.pa.array([text]))[0].as_py()))) == want
