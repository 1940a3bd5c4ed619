import random
import re
import unicodedata

import pytest

from tidemark.functions import quotes, sections
from tidemark.functions.text import fold
from tidemark.sources import files

LOG = "# Log\n\nintro\n## 2024-02-03 — First\ntext one\n```\n## 2024-09-09 in a fence\n```\n### sub\nmore\n## 2024-02-04\ntwo\n## 2024-02-04\nagain\n## Other\nthree\n# Later\ntail\n"


def short(text, most=8000):
    return [(s.anchor, s.date, s.evidence, s.kind, len(s.body)) for s in sections.sections(text, most)]


def test_dated_records_end_at_higher_headings():
    s = sections.sections(LOG)
    assert [(x.anchor, x.date, x.kind) for x in s] == [(None, None, "note"), ("2024-02-03-first", "2024-02-03", "episode"), ("2024-02-04", "2024-02-04", "episode"), ("2024-02-04-2", "2024-02-04", "episode"), ("after-2024-02-04", None, "note")]
    assert "".join(x.body for x in s) == LOG and "in a fence" in s[1].body and "three" in s[3].body


def test_decision_rows_take_the_lines_behind_them():
    t = "# Decisions\n\nD-001 | 2024-01-02 | accepted | **use** `x` | why\ncontinued\nD-0002 | 2024-13-02 | open | y\nD-001 | 2024-01-05 | open\n"
    assert [(x.anchor, x.lead, x.date, x.evidence) for x in sections.sections(t)][1:] == [("D-001", "D-001 · accepted: use x", "2024-01-02", "decision-row"), ("D-0002", "D-0002 · open: y", None, "decision-row"), ("D-001-2", "D-001 · open:", "2024-01-05", "decision-row")]
    assert short("D-001 | 2024-01-02 | one row only\n") == [(None, None, "none", "note", 34)]


def test_dates_of_whole_texts():
    assert short("---\ntitle: T\ndate: 2024-05-06\ntype: feedback\n---\nbody") == [(None, "2024-05-06", "front-matter", "feedback", 4)]
    assert short("# SESSION 2024-05-01 — x\n## part\ny\n")[0][:3] == (None, "2024-05-01", "dated-heading")
    assert short("# Prices as of 2024-05-01\nx\n")[0][:3] == (None, None, "none")
    assert short("") == [] and short("\n \n") == []


@pytest.mark.parametrize("most", [40, 60, 200])
def test_long_sections_lose_nothing_and_get_short(most):
    r = random.Random(most)
    for _ in range(40):
        t = "".join(r.choice(["# a\n", "## b b\n", "### c\n", "word " * r.randrange(1, 12) + "\n", "\n", "```\n", "x" * r.randrange(90) + "\n", "## 2024-01-0" + str(r.randrange(1, 9)) + " t\n"]) for _ in range(r.randrange(30)))
        s = sections.sections(t, most)
        assert all(len(x.body) <= most for x in s) and len({x.anchor for x in s}) == len(s)
        assert re.sub(r"\s", "", "".join(x.body for x in s)) == re.sub(r"\s", "", t)


def naive(quote, text):
    """All stretches whose normal form is the quote's, that begin and end with a character that counts."""
    norm = lambda t: re.sub(r"\s+", " ", "".join(fold(c) for c in t)).strip()
    want, out = norm(quote), []
    counts = lambda c: bool(fold(c)) and not c.isspace()
    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            if counts(text[a]) and counts(text[b - 1]) and norm(text[a:b]) == want:
                while b < len(text) and unicodedata.category(text[b]).startswith("M"):
                    b += 1
                out.append((a, b))
    return out


def test_quotes_are_found_where_they_stand():
    r = random.Random(5)
    pool = ["a", "A", "b", "é", "é", "E", "ß", "ss", " ", "  ", "\n", "İ", "i", "ı", "-"]
    some = 0
    for _ in range(300):
        text = "".join(r.choice(pool) for _ in range(r.randrange(18)))
        quote = "".join(r.choice(pool) for _ in range(r.randrange(1, 4)))
        if not quote.strip() or not fold(quote).strip():
            continue
        got = [(a, b) for a, b, _ in quotes.find_verbatim(quote, text)]
        assert got == naive(quote, text), (quote, text)
        some += bool(got)
    assert some > 60
    assert quotes.find_verbatim("The  CAFE", "In the café and the café") == [(3, 12, True), (17, 25, True)]
    assert quotes.find_verbatim("cat", "concatenate cat") == [(3, 6, False), (12, 15, True)] and quotes.find_verbatim(" ", "a b") == []


def test_splices_and_why_not(spark):
    from pyspark.sql import functions as F

    rows = [("one TWO three four", "two", "2"), ("one two three two", "two", "2"), ("onetwo three four", "two", "2"), ("two three", "two", "2"), ("one two three four", "two", "two"), ("one two three four", "two", "2" * 10), ("one", "two", "2"), (None, "two", "2"), ("ein Wört und mehr Text", "wort", "Satz")]
    d = spark.createDataFrame(rows, "text string, quote string, new string").withColumn("found", quotes.spans("quote", "text"))
    why = quotes.why_not(F.col("text"), F.col("found"), F.col("new"))
    x = F.get("found", 0)
    got = [tuple(r) for r in d.select(why, F.when(why.isNull(), quotes.splice(F.col("text"), x.start, x.end, F.col("new")))).collect()]
    assert got == [(None, "one 2 three four"), ("repeated", None), ("cuts-word", None), ("whole", None), ("same", None), ("too-long", None), ("absent", None), ("absent", None), (None, "ein Satz und mehr Text")]


def test_a_folder_as_sections(spark, tmp_path):
    texts = {"a.md": LOG, "sub/b.md": "---\ntitle: B\ndate: 2024-05-06\n---\nbody", "sub/copy.md": LOG, "stub.md": "@a.md\n@sub/b.md\n", "empty.md": " \n", "key.md": "AKIA" + "A" * 16}
    files.write_texts(spark.createDataFrame(list(texts.items()), "name string, text string"), str(tmp_path))
    got = files.corpus(spark, str(tmp_path), "md").collect()
    assert {x.path: x.reason for x in got if x.reason} == {"sub/copy.md": "copy-of:a.md", "stub.md": "stub", "empty.md": "empty", "key.md": "secret"}
    assert {x.source_key for x in got if not x.reason} == {"md:a.md", "md:a.md#2024-02-03-first", "md:a.md#2024-02-04", "md:a.md#2024-02-04-2", "md:a.md#after-2024-02-04", "md:sub/b.md"}
    b = next(x for x in got if x.path == "sub/b.md")
    assert (b.title, b.body, str(b.valid_from), b.evidence) == ("B", "body", "2024-05-06 00:00:00", "front-matter")
