"""Licence scans by sentence rules: known normalised licence sentences are found in a text, and ordered rules match runs of their identifiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences, or the unchanging part of them, as the licences and their published notices have them.
SENTENCES = (
    ("mit-name", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-notice-short", "The above copyright notice and this permission notice shall be included"),
    ("as-is", 'The software is provided "as is", without warranty of any kind'),
    ("as-is-short", 'is provided "as is", without'),
    ("isc-name", "ISC License"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-notice", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", 'The software is provided "as is" and the author disclaims all warranties with regard to this software'),
    ("0bsd-name", "BSD Zero Clause License"),
    ("bsd-2-name", "BSD 2-Clause License"),
    ("bsd-3-name", "BSD 3-Clause License"),
    ("bsd-2-simplified", 'BSD 2-Clause "Simplified" License'),
    ("bsd-3-new", 'BSD 3-Clause "New" License'),
    ("bsd-3-new-or-revised", 'BSD 3-Clause "New" or "Revised" License'),
    ("bsd-3-revised", 'BSD 3-Clause "Revised" License'),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties'),
    ("apache-2", "Apache License, Version 2.0"),
    ("apache-2-short", "Apache License 2.0"),
    ("apache-2-bare", "Apache 2.0 License"),
    ("apache-comply", "you may not use this file except in compliance with the License"),
    ("apache-url", "apache.org/licenses/LICENSE-2.0"),
    ("apache-basis", 'software distributed under the License is distributed on an "AS IS" BASIS'),
    ("gpl-name", "GNU General Public License"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-2-v", "GPLv2"),
    ("gpl-2-words", "GPL version 2"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-3-v", "GPLv3"),
    ("gpl-3-words", "GPL version 3"),
    ("gpl-2-name-v", "GNU General Public License v2"),
    ("gpl-2-name-v0", "GNU General Public License v2.0"),
    ("gpl-3-name-v", "GNU General Public License v3"),
    ("gpl-3-name-v0", "GNU General Public License v3.0"),
    ("gpl-2-short-v", "GPL v2"),
    ("gpl-3-short-v", "GPL v3"),
    ("gpl-2-of", "version 2 of the GNU General Public License"),
    ("gpl-3-of", "version 3 of the GNU General Public License"),
    ("lgpl-2-1-of", "version 2.1 of the GNU Lesser General Public License"),
    ("lgpl-3-of", "version 3 of the GNU Lesser General Public License"),
    ("agpl-3-of", "version 3 of the GNU Affero General Public License"),
    ("lgpl-2-1-v", "LGPL v2.1"),
    ("lgpl-2-1-vv", "LGPLv2.1"),
    ("lgpl-3-v", "LGPL v3"),
    ("lgpl-3-vv", "LGPLv3"),
    ("agpl-3-v", "AGPL v3"),
    ("agpl-3-vv", "AGPLv3"),
    ("later-2", "either version 2 of the License, or (at your option) any later version"),
    ("later-3", "either version 3 of the License, or (at your option) any later version"),
    ("later-2-1", "either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-name", "GNU Lesser General Public License"),
    ("lgpl-library", "GNU Library General Public License"),
    ("agpl-name", "GNU Affero General Public License"),
    ("mpl-2", "Mozilla Public License, version 2.0"),
    ("mpl-2-v", "Mozilla Public License, v. 2.0"),
    ("mpl-2-short", "Mozilla Public License 2.0"),
    ("mpl-1-1", "Mozilla Public License Version 1.1"),
    ("epl-1", "Eclipse Public License v1.0"),
    ("epl-1-words", "Eclipse Public License 1.0"),
    ("epl-2", "Eclipse Public License v2.0"),
    ("epl-2-v", "Eclipse Public License v. 2.0"),
    ("epl-2-words", "Eclipse Public License 2.0"),
    ("cddl-1", "Common Development and Distribution License"),
    ("eupl-1-2", "European Union Public Licence v. 1.2"),
    ("artistic-2", "Artistic License 2.0"),
    ("zlib-use", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("boost-1", "Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("wtfpl", "Do What The Fuck You Want To Public License"),
    ("ofl-1-1", "SIL Open Font License, Version 1.1"),
    ("psf-2", "Python Software Foundation License Version 2"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("upl-1", "Universal Permissive License v 1.0"),
    ("ncsa", "University of Illinois/NCSA Open Source License"),
    ("ms-pl", "Microsoft Public License"),
    ("cc0", "CC0"),
    ("cc0-1", "CC0 1.0"),
    ("cc0-name", "Creative Commons Zero"),
    ("cc-by-4", "CC BY 4.0"),
    ("cc-by-4-name", "Creative Commons Attribution 4.0"),
    ("cc-by-3", "CC BY 3.0"),
    ("cc-by-3-name", "Creative Commons Attribution 3.0"),
    ("cc-by-sa-4", "CC BY-SA 4.0"),
    ("cc-by-sa-4-name", "Attribution-ShareAlike 4.0"),
    ("cc-by-sa-3", "CC BY-SA 3.0"),
    ("cc-by-sa-3-name", "Attribution-ShareAlike 3.0"),
    ("cc-by-nc-4", "CC BY-NC 4.0"),
    ("cc-by-nc-4-name", "Attribution-NonCommercial 4.0"),
    ("cc-by-nd-4", "CC BY-ND 4.0"),
    ("cc-by-nd-4-name", "Attribution-NoDerivatives 4.0"),
    ("cc-by-nc-sa-4", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa-4-name", "Attribution-NonCommercial-ShareAlike 4.0"),
    ("cc-by-nc-nd-4", "CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd-4-name", "Attribution-NonCommercial-NoDerivatives 4.0"),
    ("public-domain", "is in the public domain"),
    ("into-public-domain", "released into the public domain"),
    ("placed-public-domain", "placed in the public domain"),
    ("to-public-domain", "dedicated to the public domain"),
    ("all-rights", "All rights reserved"),
    ("some-licence", "licensed under"),
    ("released-under", "released under"),
    ("distributed-under", "distributed under"),
)
# Ordered rules: a licence and identifiers, one after the other. An earlier rule takes its sentences from later ones.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice-short", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice-short")),
    ("MIT-0", ("mit-grant", "as-is")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-1-Clause", ("bsd-grant", "bsd-source")),
    ("ISC", ("isc-grant", "isc-notice", "isc-as-is")),
    ("ISC", ("isc-grant", "isc-notice")),
    ("0BSD", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-name",)),
    ("ISC", ("isc-name",)),
    ("Zlib", ("zlib-use", "zlib-origin")),
    ("GPL-2.0-or-later", ("gpl-name", "later-2")),
    ("GPL-3.0-or-later", ("gpl-name", "later-3")),
    ("LGPL-2.1-or-later", ("lgpl-name", "later-2-1")),
    ("LGPL-3.0-or-later", ("lgpl-name", "later-3")),
    ("LGPL-2.0-or-later", ("lgpl-library", "later-2")),
    ("AGPL-3.0-or-later", ("agpl-name", "later-3")),
    ("Apache-2.0", ("apache-2", "apache-comply", "apache-url", "apache-basis")),
    ("Apache-2.0", ("apache-2", "apache-comply", "apache-basis")),
    ("MIT", ("mit-name",)),
    *(("BSD-2-Clause", (x,)) for x in ("bsd-2-name", "bsd-2-simplified")),
    *(("BSD-3-Clause", (x,)) for x in ("bsd-3-name", "bsd-3-new", "bsd-3-new-or-revised", "bsd-3-revised")),
    *(("Apache-2.0", (x,)) for x in ("apache-2", "apache-2-short", "apache-2-bare", "apache-url")),
    *(("GPL-3.0", (x,)) for x in ("gpl-3", "gpl-3-v", "gpl-3-words", "gpl-3-name-v", "gpl-3-name-v0", "gpl-3-short-v", "gpl-3-of")),
    *(("GPL-2.0", (x,)) for x in ("gpl-2", "gpl-2-v", "gpl-2-words", "gpl-2-name-v", "gpl-2-name-v0", "gpl-2-short-v", "gpl-2-of")),
    *(("LGPL-2.1", (x,)) for x in ("lgpl-2-1-of", "lgpl-2-1-v", "lgpl-2-1-vv")),
    *(("LGPL-3.0", (x,)) for x in ("lgpl-3-of", "lgpl-3-v", "lgpl-3-vv")),
    *(("AGPL-3.0", (x,)) for x in ("agpl-3-of", "agpl-3-v", "agpl-3-vv")),
    ("GPL", ("gpl-name",)),
    ("LGPL", ("lgpl-name",)),
    ("LGPL", ("lgpl-library",)),
    ("AGPL-3.0", ("agpl-name",)),
    *(("MPL-2.0", (x,)) for x in ("mpl-2", "mpl-2-v", "mpl-2-short")),
    ("MPL-1.1", ("mpl-1-1",)),
    *(("EPL-1.0", (x,)) for x in ("epl-1", "epl-1-words")),
    *(("EPL-2.0", (x,)) for x in ("epl-2", "epl-2-v", "epl-2-words")),
    ("CDDL-1.0", ("cddl-1",)),
    ("EUPL-1.2", ("eupl-1-2",)),
    ("Artistic-2.0", ("artistic-2",)),
    ("BSL-1.0", ("boost-1",)),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    ("OFL-1.1", ("ofl-1-1",)),
    ("PSF-2.0", ("psf-2",)),
    ("PostgreSQL", ("postgresql",)),
    ("UPL-1.0", ("upl-1",)),
    ("NCSA", ("ncsa",)),
    ("MS-PL", ("ms-pl",)),
    *(("CC0-1.0", (x,)) for x in ("cc0-1", "cc0", "cc0-name")),
    *((f"CC-{x.upper()}.0", (f"cc-{x}{y}",)) for x in ("by-4", "by-3", "by-sa-4", "by-sa-3", "by-nc-4", "by-nd-4", "by-nc-sa-4", "by-nc-nd-4") for y in ("", "-name")),
    ("public-domain", ("public-domain",)),
    *(("public-domain", (x,)) for x in ("into-public-domain", "placed-public-domain", "to-public-domain")),
    ("proprietary", ("all-rights",)),
    *(("unknown", (x,)) for x in ("some-licence", "released-under", "distributed-under")),
)
#: Named only where no other licence is.
LAST = ("proprietary", "unknown")
#: Names of families, which say nothing more where a licence of the family is named.
BARE = {"GPL": "GPL-", "LGPL": "LGPL-", "AGPL-3.0": "AGPL-3.0-", "GPL-2.0": "GPL-2.0-", "GPL-3.0": "GPL-3.0-", "LGPL-2.1": "LGPL-2.1-", "LGPL-3.0": "LGPL-3.0-"}
_ONLY = tuple(f"{x}-{y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("only", "or-later"))
#: Tags: every licence of the rules has one, after either of two fields; those that end in only or or-later are known by themselves too.
_TAGGED = tuple(x for x in dict.fromkeys((*(n for n, _ in RULES), *_ONLY)) if x not in (*LAST, "public-domain", "GPL", "LGPL"))
#: Pairs that are offered for choice or together often.
_PAIRS = tuple(f"{a} {word} {b}" for x, y in (("MIT", "Apache-2.0"), ("GPL-2.0-only", "MIT"), ("GPL-2.0-or-later", "MIT"), ("BSD-3-Clause", "MIT"), ("BSD-3-Clause", "Apache-2.0"), ("GPL-2.0-only", "BSD-2-Clause")) for word in ("OR", "AND") for a, b in ((x, y), (y, x)))
_FIELDS = (("spdx", "SPDX-License-Identifier:"), ("field", "License:"))
TAGS = (*((f"{f}-{x.lower().replace(' ', '-')}", f"{field} {x}") for f, field in _FIELDS for x in (*_TAGGED, *_PAIRS)), *((f"id-{x.lower()}", x) for x in _ONLY))
ALL_SENTENCES = SENTENCES + TAGS
ALL_RULES = (*((x, (f"{f}-{x.lower().replace(' ', '-')}",)) for f, _ in _FIELDS for x in (*_TAGGED, *_PAIRS)), *((x, (f"id-{x.lower()}",)) for x in _ONLY), *RULES)
#: All but letters, digits and plus signs parts words: white space, line ends, comment marks, punctuation.
_BETWEEN = r"[^\p{L}\p{N}+]+"
_CHARS = 4_000_000


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-cased words with one space before, between and after them; licence and license are one word."""
    words = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), _BETWEEN, " ")
    words = pc.utf8_trim(pc.replace_substring(words, "licence", "license"), " ")
    space = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(space, words, space, pa.scalar("", pa.large_string()))


def _known() -> dict[str, str]:
    out = dict(zip(normalised(pa.array([s for _, s in ALL_SENTENCES])).to_pylist(), (i for i, _ in ALL_SENTENCES), strict=True))
    if len(out) < len(ALL_SENTENCES):
        raise ValueError("two sentences with the same words")
    return out


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, name in _known().items():
        a.add_word(phrase, (len(phrase), name))
    a.make_automaton()
    return a


def _pattern(ids: tuple[str, ...]) -> str:
    return "".join(f"|{i}|" for i in ids)


def identify(text: str) -> list[str]:
    """The identifiers of the known sentences in a normalised text, in order. One that lies within a longer one doesn't count."""
    found = sorted((end + 1 - n, -end, name) for end, (n, name) in _automaton().iter(text))
    out, far = [], -1
    for _, end, name in found:
        if -end > far:
            out.append(name)
            far = -end
    return out


def licences(ids: list[str]) -> list[str]:
    """The licences whose rules match, once each, in rule order; a family's name isn't among them beside one of its licences."""
    seq, hits = _pattern(tuple(ids)), []
    for name, own in ALL_RULES:
        p = _pattern(own)
        if p in seq:
            seq = seq.replace(p, "#")
            hits.append(name)
    named = [n for n in hits if n not in LAST] or hits
    return [n for n in dict.fromkeys(named) if not any(m.startswith(BARE.get(n, "\0")) for m in named)]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, sentences and licences (identifiers joined by commas), n_sentences.

    A sentence is known by its words, wherever they stand one after the other, whatever white space, line ends, comment marks or punctuation part
    them. All are found in one pass over a text of any length, in time that grows with its length. Of sentences with a common start the
    longest counts; equal ones count each time. A text without known sentences has empty strings. Null texts are empty, null ids stay, repeated
    rows each get a row, an empty table gives no rows, other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            total = pc.cumulative_sum(pc.utf8_length(texts).cast(pa.int64())).to_numpy() // _CHARS
            start = 0
            while start < len(texts):
                end = start + max(1, int((total[start:] == total[start]).sum()))
                ids = [identify(t) for t in normalised(texts.slice(start, end - start)).to_pylist()]
                names = [",".join(licences(i)) if i else "" for i in ids]
                columns = [batch.column(0).slice(start, end - start), pa.array([",".join(i) for i in ids], pa.string()), pa.array(names, pa.string()), pa.array([len(i) for i in ids], pa.int64())]
                yield pa.record_batch(columns, names=["doc_id", "sentences", "licences", "n_sentences"])
                start = end

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, sentences string, licences string, n_sentences long")


def _sql() -> str:
    """Every sentence is looked for by itself; between words there are two spaces, so that neighbours don't share one."""
    known = ", ".join(f"('{i}', ' {p.strip().replace(' ', '  ')} ')" for p, i in _known().items())
    steps = ["s0 AS (SELECT doc_id, seq, CAST([] AS VARCHAR[]) AS hits FROM e)"]
    for k, (name, ids) in enumerate(ALL_RULES):
        p = _pattern(ids)
        steps.append(f"s{k + 1} AS (SELECT doc_id, replace(seq, '{p}', '#') AS seq, CASE WHEN contains(seq, '{p}') AND NOT list_contains(hits, '{name}') THEN list_append(hits, '{name}') ELSE hits END AS hits FROM s{k})")
    last = ", ".join(f"'{x}'" for x in LAST)
    bare = " OR ".join(f"x = '{n}' AND len(list_filter(named, lambda y: starts_with(y, '{p}'))) > 0" for n, p in BARE.items())
    return rf"""
WITH n AS (SELECT doc_id, ' ' || replace(replace(trim(regexp_replace(lower(coalesce(text, '')), '{_BETWEEN}', ' ', 'g')), ' ', '  '), 'licence', 'license') || ' ' AS t FROM documents),
k(id, p) AS (VALUES {known}),
q AS (SELECT doc_id, id, p, string_split(t, p) AS q FROM n, k WHERE contains(t, p)),
o AS (SELECT doc_id, id, length(p) AS n, list_sum(list_transform(q[1:j], lambda x: length(x))) + (j - 1) * length(p) AS s FROM q, unnest(range(1, len(q))) AS r(j)),
w AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc_id = a.doc_id AND b.n > a.n AND b.s <= a.s AND b.s + b.n >= a.s + a.n)),
e AS (SELECT doc_id, string_agg(id, ',' ORDER BY s) AS ids, string_agg('|' || id || '|', '' ORDER BY s) AS seq, count(*) AS n FROM w GROUP BY doc_id),
{", ".join(steps)},
g AS (SELECT doc_id, CASE WHEN len(list_filter(hits, lambda x: x NOT IN ({last}))) > 0 THEN list_filter(hits, lambda x: x NOT IN ({last})) ELSE hits END AS named FROM s{len(ALL_RULES)}),
h AS (SELECT doc_id, list_filter(named, lambda x: NOT ({bare})) AS names FROM g)
SELECT n.doc_id, coalesce(e.ids, '') AS sentences, coalesce(array_to_string(h.names, ','), '') AS licences, CAST(coalesce(e.n, 0) AS BIGINT) AS n_sentences
FROM n LEFT JOIN e ON n.doc_id = e.doc_id LEFT JOIN h ON n.doc_id = h.doc_id
"""


SQL = _sql()
