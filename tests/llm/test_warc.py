"""WARC archives: whole round trips, and what is salvaged after damage at known places."""

import base64
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection, rows
from tidemark.llm import queries, warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(data, least=0):
    out = []
    for i, body in data:
        raw = (body or "").encode()
        same = [j for j, b in data if (b or "").encode() == raw and j is not None]
        keeper = max(same, default=None) if len(raw) >= least else i
        out.append((i, len(raw), digest(raw), "response" if i == keeper else "revisit", None if i == keeper else keeper))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("compress", "kind"), [(True, "long"), (False, "long"), (True, "string")])
def test_round_trip(spark, tmp_path, compress, kind):
    r = random.Random(5)
    bodies = [None, "", "a", "é\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "HTTP/1.1 200 OK\r\n\r\n", "\x1f\x8b\x08"] + ["".join(r.choice("ab <>\n") for _ in range(r.randrange(60))) for _ in range(40)]
    data = [(i, r.choice(bodies)) for i in range(200)] + [(None, "a"), (None, "of a null id alone"), (3, "a"), (3, "a")]
    if kind == "string":
        data = [(None if i is None else f"p +/{i}%", b) for i, b in data]
    urls = ["http://a.example/ä b\r\nX: y", None, "https://b.example/?q=1#t"]
    d = spark.createDataFrame([(i, b, urls[k % 3], "x", 1) for k, (i, b) in enumerate(data)], f"page_id {kind}, html string, url string, archive string, `a.b` int")
    made = warc.write(d, str(tmp_path / "w"), compress=compress)
    assert made.agg(F.sum("records")).first()[0] == len(data)
    again = warc.archives(spark, str(tmp_path / "w"))
    assert again.count() == made.count()
    read = warc.read(again)
    assert sorted(repr(tuple(x)) for x in warc.pages_of(read, kind).collect()) == brute(data)
    got = read.where("record_type = 'response'").select("payload", "target_uri").collect()
    assert {bytes(x.payload) for x in got} == {(b or "").encode() for _, b in data}
    assert {x.target_uri for x in got} <= {"http://a.example/%C3%A4%20b%0D%0AX:%20y", None, urls[2]}
    assert read.where("kind = 'gap'").count() == 0


def test_payloads_below_the_least_size_are_all_responses(spark, tmp_path):
    data = [(1, "ab"), (2, "ab"), (3, "abc"), (4, "abc"), (5, None)]
    d = spark.createDataFrame([(i, b, None) for i, b in data], "page_id long, html string, url string")
    got = warc.pages_of(warc.read(warc.write(d, str(tmp_path), least=3)))
    assert sorted(repr(tuple(x)) for x in got.collect()) == brute(data, 3)
    assert warc.round_trip(d.limit(0)).count() == 0


def member(raw):
    c = zlib.compressobj(wbits=31)
    return c.compress(raw) + c.flush()


def parts(compress, n=40, seed=7):
    r = random.Random(seed)
    out = []
    for i in range(n):
        body = bytes(r.randrange(256) for _ in range(r.randrange(3000))) if i % 3 else b"text " * r.randrange(1, 900)
        raw = warc.made(str(i), "http://x.example/", body, len(body), digest(body), None, "1970-01-01T00:00:00Z")
        out.append(member(raw) if compress else raw)
    return out


def names(found):
    return [int(x["record_id"].removeprefix(warc.RECORD)) for _, _, _, records in found for x in records]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("chunk", [1 << 20, 100])
def test_damage_costs_the_damaged_records_only(monkeypatch, compress, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    whole = parts(compress)
    r = random.Random(11)
    for kind in ("flip", "cut", "junk", "head", "end", "all", "none"):
        got, at, bad = [], 0, []
        for i, p in enumerate(whole):
            hit = kind == "all" or kind != "none" and i in (0, 5, 6, 20)
            if kind == "end":
                hit = i == len(whole) - 1
            q = p
            if hit and kind in ("flip", "all"):
                k = r.randrange(len(p) // 3 if compress else len(p) - 20, len(p) - 12)  # a plain head has no digest, its block has
                q = p[:k] + bytes([p[k] ^ 0x55]) + p[k + 1 :]
            elif hit and kind in ("cut", "end"):
                q = p[: len(p) // 2]
            elif hit and kind == "junk":
                q = bytes(r.randrange(256) for _ in range(500)) + warc.MEMBER + b"\r\nWARC/1.1\r\nno record" + p
            elif hit and kind == "head":
                q = b"X" + p[1:]
            if hit:
                bad.append((i, at, at + len(q) - (len(p) if kind == "junk" else 0)))
            at += len(q)
            got.append(q)
        data = b"".join(got)
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        assert [x[0] for x in found] == [0, *(x[1] for x in found)][:-1] and found[-1][1] == len(data)  # no holes
        lost = set() if kind == "junk" else {i for i, _, _ in bad}
        assert names(found) == [i for i in range(len(whole)) if i not in lost]
        want = []
        for _, a, e in bad:
            if want and want[-1][1] == a:
                want[-1][1] = e
            else:
                want.append([a, e])
        assert [[a, e] for a, e, reason, _ in found if reason] == want


def test_each_check_has_its_reason():
    p = parts(False, 3)
    reason = lambda raw: next((x for _, _, x, _ in warc.salvage(io.BytesIO(raw), len(raw)) if x), None)
    assert reason(b"".join(p)) is None
    assert reason(p[1].replace(b"WARC/1.1", b"WARC/9.9")) == "version"
    assert reason(p[1].replace(b"WARC-Type: ", b"WARC-Kind: ")) == "head"
    assert reason(p[1].replace(b"Content-Length: ", b"Content-Length: 1")) == "length"
    assert reason(p[0].replace(b"text text", b"text best", 1)) == "block digest"
    odd = digest(b"other").encode()
    right = [x for x in p[0].split(b"\r\n") if x.startswith(b"WARC-Payload-Digest")][0].split(b":")[-1]
    assert reason(p[0].replace(b"WARC-Payload-Digest: sha1:" + right, b"WARC-Payload-Digest: sha1:" + odd)) == "payload digest"
    m = member(p[1])
    assert reason(m[:-9] + bytes([m[-9] ^ 1]) + m[-8:]) == "member"
    assert reason(member(p[1] + p[2])) is None and names(warc.salvage(io.BytesIO(x := member(p[1] + p[2])), len(x))) == [1, 2]


def test_damaged_files_read_by_spark(spark, tmp_path):
    for k in range(3):
        x = parts(True, 10, k)
        x[4] = x[4][:-3]
        (tmp_path / f"a{k}.warc.gz").write_bytes(b"".join(x))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read(warc.archives(spark, str(tmp_path)), payloads=False).groupBy("archive", "kind").agg(F.count("*").alias("n"), F.sum("length").alias("b")).collect()
    assert {(x.kind, x.n) for x in got} == {("record", 9), ("gap", 1)} and len(got) == 6


def test_same_rows_as_sql(spark, sf):
    assert rows(queries.QUERIES["op11_warc"](spark, sf).toPandas()) == rows(connection(sf).sql(warc.SQL).df())
