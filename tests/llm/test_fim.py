"""Fill-in-middle against a plain regular expression over code points."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection, rows
from tidemark.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(text, name):
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{name}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    r = random.Random(3)
    pool = ["a", "bc", " ", "\n", "\t \r", "é", "日本", "🙂", " ", " ", "\x1c", "<", "<S", ">", "P>"]
    out = ["".join(r.choice(pool) for _ in range(r.randrange(0, 40))) for _ in range(300)]
    out += ["", " ", "x", " x", "x ", "<P>", "a <S> b", "<M", "a" * 3000, " " * 3000, "é" * 2000 + " x", ("wörter  und\n" * 400).strip()]
    return out + ["".join(r.choice(pool) for _ in range(60_000))]


@pytest.mark.parametrize("block", [1, 3, 64, 1024])
def test_blocks_of_any_size_cut_at_the_same_places(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    monkeypatch.setattr(fim, "STEP", block * 7)
    for i, t in enumerate(odd_texts()[:: 1 if block > 3 else 7]):
        n, form, p, m, out = fim.arrange(t.encode(), str(i))
        assert (n, form, p, m, out.decode()) == plain(t, i)
        tree, units = fim.BlockTree(t.encode()), UNIT.findall(t)
        for k in {0, 1, len(units) // 2, len(units)}:
            if k <= len(units):
                head = "".join(units[:k])
                assert tree.cut(k) == (len(head.encode()), len(head))


def test_rows_of_a_table(spark):
    texts = odd_texts()
    data = [(i, t, "clash", "x") for i, t in enumerate(texts)] + [(None, "one two three", None, None), (5, None, None, None), (7, texts[7], "x", "x"), (7, texts[7], "x", "x")]
    d = spark.createDataFrame(data, "doc_id long, text string, output string, `a.b` string")
    got = fim.transform(d).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(data) and {x.form for x in got} == {"plain", "psm", "spm"}
    want = sorted((repr(i), *plain(t or "", "null" if i is None else i), t or "") for i, t, *_ in data)
    assert [tuple(map(str, x)) for x in sorted((repr(x.doc_id), x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.back) for x in got)] == [tuple(map(str, x)) for x in want]
    assert fim.report(d.limit(0)).count() == 0


def test_same_rows_as_sql(spark, sf):
    got, want = queries.QUERIES["op12_fill_in_middle"](spark, sf).toPandas(), connection(sf).sql(fim.SQL).df()
    assert rows(got) == rows(want) and (got["output_sha256"] != got["restored_sha256"]).any()
