"""Files as sources and sinks: folders, Markdown, JSON lines, and an append-only event table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.sections import LONG, front_matter, sections
from tidemark.session import cut, stored

#: Larger files are not read.
MOST_BYTES = 2 << 20
#: Files and bytes that one task reads; Spark by itself gives 32 small files to a task, as it counts 4 MB for opening one.
TASK_FILES, TASK_BYTES = 1000, 64 << 20
#: Most tasks that list folders.
LISTS = 256


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, modificationTime, length, content) of files below ``root`` with one of the suffixes; hidden folders are left out. Unread columns cost nothing."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    return f.where(~F.col("path").rlike(r"/\.[^/]+/|/(node_modules|__pycache__)/"))


def _at(uri: str) -> tuple:
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") or "://" not in uri else fs.FileSystem.from_uri(uri)


def listed(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length) of the files that ``scan`` gives, listed in tasks, a folder in each, level by level: no list of files comes to the driver."""
    ends = tuple(f".{x}" for x in suffixes)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for folder in b.column(0).to_pylist():
                store, path = _at(folder)
                rows = []
                for x in store.get_file_info(fs.FileSelector(path)):
                    name, inner = x.base_name, x.type == fs.FileType.Directory
                    if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):
                        continue  # Spark's file sources leave these out
                    if name != "node_modules" if inner else name.endswith(ends):
                        rows.append((f"{folder.rstrip('/')}/{name}", inner, 0 if inner else x.size))
                for at in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000], strict=True), (pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["path", "inner", "length"])

    level, out = spark.createDataFrame([(root,)], "path string"), None
    while True:
        found = stored(level.mapInArrow(entries, "path string, inner boolean, length long"))
        own = found.where("NOT inner").select("path", "length")
        out = own if out is None else out.unionAll(own)
        level = found.where("inner").select("path")
        n = level.count()
        if not n:
            return out
        level = level.repartition(min(n, LISTS))


def contents(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length, content) of the files that ``scan`` gives, content null where it is over MOST_BYTES; listed and read in tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for path, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = None
                if length <= MOST_BYTES:
                    store, name = _at(path)
                    with store.open_input_stream(name) as f:
                        raw = f.read()
                rows.append((path, length, raw))
                size += len(raw or b"")
                if size > 4 * MOST_BYTES:
                    yield _contents(rows)
                    rows, size = [], 0
            if rows:
                yield _contents(rows)

    files = listed(spark, root, suffixes)
    n = tasks(files.select("path", F.least("length", F.lit(MOST_BYTES)).alias("bytes")))
    return files.repartition(n, "path").mapInArrow(read, "path string, length long, content binary")


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["path", "length", "content"])


def documents(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(path, text, reason): texts of files with a reason why one isn't taken (text null), with line ends as \\n and no byte order mark."""
    small = F.when(F.col("length") <= MOST_BYTES, F.col("content"))
    text = F.when(F.is_valid_utf8(small.cast("string")), small.cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "\r\n?", "\n")
    d = contents(spark, root, suffixes).select("path", "length", text.alias("text"))
    reason = F.when(F.col("length") > MOST_BYTES, "too-large").when(F.col("text").isNull(), "not-utf8").when(F.contains("text", F.lit("\0")), "binary").otherwise(admission(F.col("text")))
    return d.select("path", reason.alias("reason"), F.when(reason == "admitted", F.col("text")).alias("text"))


def admission(text: Column, most: int = MOST_BYTES) -> Column:
    """Why a text is not taken in, or 'admitted'."""
    secret = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
    return F.when(F.octet_length(text) > most, "too-large").when(F.trim(text, F.lit(" \t\n")) == "", "empty").when(text.rlike(secret), "secret").otherwise("admitted")


def structure(docs: DataFrame, id_col: str, md: str) -> DataFrame:
    """(id, headings, stubs, title, paths) of Markdown texts: a fence opens or closes at each line that starts with one."""
    l = docs.select(id_col, F.posexplode(F.split(md, "\n", -1)).alias("i", "line"))
    ticks = F.sum(F.when(F.startswith("line", F.lit("```")), 1).otherwise(0)).over(Window.partitionBy(id_col).orderBy("i"))
    l = l.withColumn("fenced", ticks % 2 == 1)
    heading, path = ~F.col("fenced") & F.col("line").rlike("^#{1,4} "), ~F.col("fenced") & F.col("line").rlike("^## .*[a-z]+/[a-z]+[.]md")
    mentioned = F.array_sort(F.collect_list(F.when(path, F.struct("i", F.regexp_extract("line", "([a-z]+/[a-z]+[.]md)", 1).alias("p")))))
    out = l.groupBy(id_col).agg(F.count_if(heading).alias("headings"), F.count_if(F.startswith("line", F.lit("@"))).alias("stubs"), F.max(F.when(F.col("i") == 1, F.regexp_extract("line", "^title: (.*)$", 1))).alias("title"), mentioned.alias("m"))
    return out.select(id_col, "headings", "stubs", "title", F.nullif(F.array_join("m.p", ","), F.lit("")).alias("paths"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON lines file or folder; lines that are no JSON are left out."""
    d = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return d.where("_corrupt is null").drop("_corrupt")


def append_events(batch: DataFrame, path: str, key: str, by: str = "event_type") -> None:
    """Append the events of ``batch`` whose key isn't in the table at ``path`` yet, one row a key; parts by ``by``. A batch may be sent again."""
    spark = batch.sparkSession
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        batch = batch.join(spark.read.parquet(path).select(key), key, "left_anti")
    batch.dropDuplicates([key]).write.mode("append").partitionBy(by).parquet(path)


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Write a file for each row of ``texts`` (name, text) below ``folder``, which all executors share: a row (name, bytes) for each when this returns.

    A name may hold slashes. A file gets its name only when it is whole, so that a task that is repeated leaves no half file.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                uri, raw = f"{folder.rstrip('/')}/{name}", (text or "").encode()
                store, path = _at(uri)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, path)
                sizes.append(len(raw))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return cut(texts.select("name", "text").mapInArrow(put, "name string, bytes long"))


def tasks(wrote: DataFrame) -> int:
    """Tasks in which the files of ``wrote`` (name, bytes) are read well: as many as their number and bytes ask for, and no fewer than twice the session's cores."""
    n, size = wrote.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return max(2 * wrote.sparkSession.sparkContext.defaultParallelism, n // TASK_FILES, size // TASK_BYTES)


def corpus(spark: SparkSession, root: str, system: str, most: int | None = LONG, size: Callable[[Column], Column] = F.length) -> DataFrame:
    """(source_key, path, anchor, title, kind, valid_from, evidence, body, digest) of the sections of all Markdown files below ``root``, and a row with ``reason`` for each file that isn't taken.

    A key is the system's name and the path below the root, with the anchor behind #. Files that hold nothing but @ lines are stubs; of equal texts the one with the shortest
    path, then the first, is taken and the others are copies of it; ``size`` of a path is what counts as its length. Sections longer than ``most`` are cut, if it is given.
    """
    d = documents(spark, root, ("md",))
    # the root as the files' paths spell it
    rel = F.regexp_extract("path", re.escape(root.removeprefix("file:").rstrip("/").lstrip("/")) + "/(.*)$", 1)
    stub = F.forall(F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+$", "")), "\n"), lambda x: F.trim(x) != ""), lambda x: x.rlike(r"^@\S+$"))
    d = d.select(rel.alias("path"), "text", F.when(F.col("reason") != "admitted", F.col("reason")).when(stub, "stub").alias("reason"))
    first = d.where("reason IS NULL").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min(F.struct(size(F.col("path")).alias("n"), F.col("path").alias("path"))).path.alias("keeper"))
    d = d.withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).join(first, "h", "left")
    d = d.withColumn("reason", F.coalesce("reason", F.when(F.col("keeper") != F.col("path"), F.concat(F.lit("copy-of:"), "keeper")))).drop("h", "keeper")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text, reason in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if reason:
                    rows.append((path, None, None, None, None, None, None, reason))
                    continue
                title = front_matter(text)[0].get("title") or path.rpartition("/")[2].removesuffix(".md")
                rows += [(path, s.anchor, s.lead or title, s.kind, s.date, s.evidence, s.body, None) for s in sections(text, most)]
            if rows:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    names = ["path", "anchor", "title", "kind", "day", "evidence", "body", "reason"]
    out = d.select("path", "text", "reason").mapInArrow(cut_up, ", ".join(f"{c} string" for c in names))
    key = F.concat(F.lit(f"{system}:"), "path", F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit("")))
    return out.select(key.alias("source_key"), "path", "anchor", "title", "kind", F.col("day").cast("date").cast("timestamp_ntz").alias("valid_from"), "evidence", "body", F.sha2(F.col("body").cast("binary"), 256).alias("digest"), "reason")
