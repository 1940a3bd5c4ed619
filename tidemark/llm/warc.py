"""WARC archives: a record for each page, equal payloads stored once, and a reader that salvages what damage has left whole."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.idfile import _open as open_store
from tidemark.llm.small import sized
from tidemark.session import checkpoint_dir, cut

#: Bytes of an archive after which a task opens the next one.
ARCHIVE_BYTES = 128 << 20
#: Bytes read at once, most bytes of a record's head, and bytes of rows handed on at once.
CHUNK, MOST_HEAD, BATCH_BYTES = 1 << 20, 1 << 16, 8 << 20
#: Names of records: this and the page's id.
RECORD = "urn:x-page:"
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE, IN_NAMES = "!#$%&'()*+,/:;=?@[]~-._", "-._"
HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}

SCHEMA = "archive string, start long, length long, kind string, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


class Damage(Exception):
    """Why what stands at a place is no whole record."""


class Window:
    """Reads of a file at any place; some chunks are in memory, whatever the file's length."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, a: int, n: int) -> bytes:
        if a < self.at or a + n > self.at + len(self.data):
            self.file.seek(a)
            self.at, self.data = a, self.file.read(min(max(n, CHUNK), self.size - a)) if a < self.size else b""
        return self.data[a - self.at : a - self.at + n]

    def find(self, a: int) -> int:
        """The next place from ``a`` on where a member or a version line may begin, or the end."""
        lap = len(MEMBER) + len(VERSION)
        while a < self.size:
            part = self.read(a, CHUNK)
            hits = [i for i in (part.find(MEMBER), part.find(b"WARC/1.")) if i >= 0]
            if hits:
                return a + min(hits)
            if len(part) <= lap or a + len(part) >= self.size:
                return self.size
            a += len(part) - lap
        return self.size


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _holds(field: str | None, data: bytes) -> bool:
    """Whether ``data`` has the digest of a field ``algorithm:value`` in base 32 or hex; unknown algorithms aren't checked."""
    name, _, value = (field or "").partition(":")
    made = HASHES[name.lower()](data).digest() if name.lower() in HASHES else None
    return made is None or value.strip().rstrip("=").upper() == base32(made).rstrip("=") or value.strip().lower() == made.hex()


def _head(raw: bytes) -> dict[str, str]:
    """Fields by lower-case name of a head's lines; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Damage("head")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def record(read: Callable[[int, int], bytes], at: int) -> tuple[dict, int]:
    """The whole record at ``at`` and where it ends: version line, head, length, end mark and digests are checked."""
    if read(at, len(VERSION)) not in VERSIONS:
        raise Damage("version")
    raw = read(at, MOST_HEAD)
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Damage("head")
    head = _head(raw[len(VERSION) : end])
    length = head.get("content-length", "")
    if not length.isascii() or not length.isdigit() or "warc-type" not in head or "warc-record-id" not in head:
        raise Damage("head")
    body = at + end + 4
    n = int(length)
    block = read(body, n) if n < 1 << 62 else b""
    if len(block) < n or read(body + n, 4) != b"\r\n\r\n":
        raise Damage("length")
    if not _holds(head.get("warc-block-digest"), block):
        raise Damage("block digest")
    http, payload = {}, block
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        cut_at = block.find(b"\r\n\r\n")
        if cut_at < 0:
            raise Damage("head")
        lines = block[:cut_at].partition(b"\r\n")[2]
        http, payload = _head(lines) if lines else {}, block[cut_at + 4 :]
    kind = head["warc-type"]
    if kind == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        digest = head.get("warc-payload-digest", "").partition(":")[2] or None
        payload = None
    else:
        if not _holds(head.get("warc-payload-digest"), payload):
            raise Damage("payload digest")
        size, digest = len(payload), base32(hashlib.sha1(payload).digest())
    name = lambda x: x.strip("<>") if x else None
    return {"record_type": kind, "record_id": name(head["warc-record-id"]), "refers_to": name(head.get("warc-refers-to")), "target_uri": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "payload": payload}, body + n + 4


def _member(w: Window, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and where it ends; its own checksum and length are tested."""
    d, parts, pos = zlib.decompressobj(31), [], at
    while not d.eof:
        raw = w.read(pos, 1 << 16)
        if not raw:
            raise Damage("member")
        try:
            parts.append(d.decompress(raw))
        except zlib.error as e:
            raise Damage("member") from e
        pos += len(raw)
        if len(parts) == 1 and not parts[0].startswith(VERSION[:5]):
            raise Damage("version")
    return b"".join(parts), pos - len(d.unused_data)


def salvage(file, size: int) -> Iterator[tuple[int, int, str | None, list[dict]]]:
    """(start, end, reason, records) of all of a file, in order and without holes: whole records, or a quarantined gap with the reason and no records.

    A member of a compressed archive counts only if its checksum and all its records are right. Behind damage the reader tries each later place where a
    member or a version line begins, until one holds; what lies between is one gap. Bytes without any record are one gap to the end.
    """
    w = Window(file, size)
    at, bad, reason = 0, None, None
    while at < size:
        try:
            if w.read(at, 3) == MEMBER:
                data, end = _member(w, at)
                found, k = [], 0
                while k < len(data):
                    one, k = record(lambda a, n: data[a : a + n], k)
                    found.append(one)
                if not found:
                    raise Damage("member")
            else:
                one, end = record(w.read, at)
                found = [one]
        except Damage as e:
            if bad is None:
                bad, reason = at, str(e)
            at = w.find(at + 1)
            continue
        if bad is not None:
            yield bad, at, reason, []
            bad = None
        yield at, end, None, found
        at = end
    if bad is not None:
        yield bad, size, reason, []


def made(page: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with ``payload``, or with none a revisit of ``refers_to``, whose HTTP head keeps the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<{RECORD}{quote(page, IN_NAMES)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, PRINTABLE)))
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD}{quote(refers_to or '', IN_NAMES)}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def roles(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """(page, url, size, digest, refers_to, payload): of the pages with one payload of at least ``least`` bytes that with the largest id keeps it, others refer to it.

    Only digests and ids are grouped, summed up before they are dealt out; the pages themselves are shuffled only where the repeated digests are too
    many to broadcast, and then a hot digest is split by adaptive execution's skew join.
    """
    p = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{body}`"), F.lit("")).alias("payload"))
    p = p.withColumns({"digest": F.unhex(F.sha1(F.col("payload").cast("binary"))), "size": F.octet_length("payload").cast("long")})
    again = cut(p.where(F.col("size") >= least).groupBy("digest").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper"))
    p = p.join(sized(again, again.count(), 64), "digest", "left")
    other = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    return p.select(F.col("page").cast("string").alias("page"), "url", "size", "digest", F.when(other, F.col("keeper").cast("string")).alias("refers_to"), F.when(~other, F.col("payload").cast("binary")).alias("payload"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", body: str = "html", least: int = 0, compress: bool = True, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write archives below ``folder``, which all executors share: a row (archive, records, bytes) for each, in its final form when this returns.

    Each record is a gzip member of its own if ``compress``. A task writes its archives under passing names until they are whole, so lost tasks leave no
    half archive; read those listed here, as a repeated task may have left others. Payloads are UTF-8 (null: empty) and may be of any length; one at a
    time is in memory beside a batch. A page of null id is stored with the id ``null``; pages that repeat the largest id and its payload are responses
    too, as nothing tells them apart. Addresses (null: no field) are written with all but printable ASCII percent-encoded. An empty table makes no archive.
    """
    folder = folder.rstrip("/")
    store, local = open_store(folder)
    store.create_dir(local, recursive=True)
    suffix = "warc.gz" if compress else "warc"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        number, k, out, done = TaskContext.get().partitionId(), 0, None, []

        def close() -> None:
            nonlocal out
            out.close()
            name = f"{folder}/part-{number:06d}-{k:04d}.{suffix}"
            store.move(part, open_store(name)[1])
            done.append((name, n, size))
            out = None

        for b in batches:
            for page, address, total, digest, refers, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    n, size, k = 0, 0, k + 1
                    part = f"{open_store(folder)[1]}/{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(part)
                raw = made("null" if page is None else page, address, payload, total, base32(digest), refers, date)
                if compress:
                    c = zlib.compressobj(wbits=31)
                    raw = c.compress(raw) + c.flush()
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records", "bytes"])

    return cut(roles(pages, id_col, url, body, least).mapInArrow(put, "archive string, records long, bytes long"))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive): the archives below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{warc,warc.gz}").load(folder)
    return f.select(F.col("path").alias("archive"))


def read(found: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of SCHEMA for the archives of ``found`` (archive): records of kind ``record``, and quarantined byte gaps of kind ``gap`` with their reason.

    A record's start and length are those of its member in a compressed archive. An archive is read by one task in chunks: a record or member is in memory
    whole, an archive isn't. An empty file gives no rows. Of revisits the payload is null, and its bytes and digest are what their head says; without
    ``payloads`` no payload is handed on.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.binary() if x.endswith(" binary") else pa.string() for x in SCHEMA.split(", ")]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for name in b.column(0).to_pylist():
                store, path = open_store(name)
                with store.open_input_file(path) as f:
                    for a, e, reason, found in salvage(f, f.size()):
                        for x in found or [{}]:
                            payload = x.get("payload") if payloads else None
                            own = {"archive": name, "start": a, "length": e - a, "kind": "record" if found else "gap", "reason": reason} | x | {"payload": payload}
                            rows.append(tuple(own.get(c) for c in names))
                            held += len(payload or b"") + 200
                            if held >= BATCH_BYTES:
                                yield batch()
                                rows, held = [], 0
        if rows:
            yield batch()

    # a number of partitions of its own: adaptive execution would put all these small rows into one task
    return found.select("archive").repartition(max(1, found.count())).mapInArrow(get, SCHEMA)


def pages_of(records: DataFrame, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that ``write`` made; the id ``null`` is null again."""
    id_of = lambda c: F.when(F.startswith(c, F.lit(RECORD)) & (c != RECORD + "null"), F.substring(c, len(RECORD) + 1, 1 << 30))
    plain = lambda c: F.url_decode(c).cast(kind)
    r = records.where(F.col("kind") == "record").where(F.col("record_type").isin("response", "revisit"))
    return r.select(plain(id_of(F.col("record_id"))).alias("page_id"), "payload_bytes", "payload_digest", "record_type", plain(id_of(F.col("refers_to"))).alias("refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """What the archives of ``pages``, written to the shared checkpoint folder, hold when they are read back: a row for each page."""
    folder = f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[id_col].dataType.simpleString()
    return pages_of(read(write(pages, folder, id_col, url, body), payloads=False), kind)


#: The same by a window over payloads; base 32 from five hex digits at a time.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || h[i // 4 * 5 + 1:i // 4 * 5 + 5] AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM q
"""
