"""Task packs as a data source: a folder of JSON-lines files, one pack a file, read by partitions, with the answers laid over the cases."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that one task reads.
SPLIT = 32 << 20


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Piece(InputPartition):
    """The lines of a pack's file that begin from ``start`` to before ``end``."""

    pack: str
    path: str
    start: int
    end: int


class Packs(DataSource):
    """Rows (pack, case_id, tier, body) of ``<folder>/<pack>.jsonl``; each line is an object with id, tier and any other fields, which are the body as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return "pack string, case_id string, tier string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackReader(self.options["path"])


class PackReader(DataSourceReader):
    """Equality on ``pack`` is pushed down: files of other packs are not opened."""

    def __init__(self, folder: str) -> None:
        self.folder, self.packs = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) and f.attribute == ("pack",) else set(f.value) if isinstance(f, In) and f.attribute == ("pack",) else None
            if names is None:
                yield f
            else:
                self.packs = names if self.packs is None else self.packs & names

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _open(self.folder)
        files = sorted((f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(".jsonl")), key=lambda f: f.path)
        named = [(f.base_name.removesuffix(".jsonl"), f) for f in files]
        # a file: path stays one, others keep their scheme by the folder's
        return [Piece(n, f"{self.folder.rstrip('/')}/{f.base_name}", a, min(f.size, a + SPLIT)) for n, f in named if self.packs is None or n in self.packs for a in range(0, f.size, SPLIT)]

    def read(self, partition: Piece) -> Iterator[tuple[Any, ...]]:
        store, path = _open(partition.path)
        with store.open_input_file(path) as f:
            at = partition.start
            if at:  # the line that reaches over the start belongs to the piece before
                f.seek(at - 1)
                at += len(self._line(f)) - 1
            while at < partition.end:
                f.seek(at)
                raw = self._line(f)
                at += len(raw)
                if raw.strip():
                    case = json.loads(raw)
                    name, tier = case.pop("id"), case.pop("tier", None)
                    yield partition.pack, str(name), tier, json.dumps(case, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    @staticmethod
    def _line(f: Any) -> bytes:
        """From where ``f`` stands to the end of the line."""
        parts = []
        while True:
            raw = f.read(1 << 16)
            end = raw.find(b"\n")
            parts.append(raw if end < 0 else raw[: end + 1])
            if end >= 0 or not raw:
                return b"".join(parts)


def packs(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of all packs of a folder; a filter on ``pack`` decides which files are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Packs)
    return spark.read.format("packs").load(folder)


def with_gold(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases with the answer of ``gold`` (pack, case_id, gold) in place of the one in their body, if there is one; cases without either have none."""
    own = F.get_json_object("body", "$.gold")
    return cases.join(gold, ["pack", "case_id"], "left").select("pack", "case_id", "tier", "body", F.coalesce("gold", own).alias("gold"), F.when(F.col("gold").isNotNull(), "overlay").when(own.isNotNull(), "case").otherwise("none").alias("gold_from"))


def vectors(cases: DataFrame, dims: int) -> DataFrame:
    """(pack, case_id, vector, reason): the vectors of cases with a field ``vector``, as floats; one of another length, with a null or a value that is not finite is null with the reason."""
    v = F.from_json(F.get_json_object("body", "$.vector"), "array<float>")
    bad = F.when(v.isNull(), "no-vector").when(F.size(v) != dims, "other-length").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not-finite")
    return cases.select("pack", "case_id", F.when(bad.isNull(), v).alias("vector"), bad.alias("reason"))
