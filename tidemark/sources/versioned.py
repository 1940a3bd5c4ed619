"""A table that takes upserts in numbered commits: plain Parquet folders and a log of which of them count."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "kind string, number long, path string"


class Versioned:
    """Rows by ``key``, of which the last one by ``order`` counts, below ``folder``.

    A commit writes its rows to a folder of its own and then appends one row to the log, which is what makes them count: a job that ends in between leaves a
    folder that nobody reads, and a commit whose number is in the log already is done. Readers merge the last base with the changes behind it; ``compact`` writes
    what they would read as the next base. One writer at a time. Rows with ``deleted`` true, if there is such a column, take their key away.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, key: list[str], order: str) -> None:
        self.spark, self.folder, self.schema, self.key, self.order = spark, folder.rstrip("/"), schema, key, order

    def _append(self, rows: list[tuple[str, int, str]]) -> None:
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def log(self) -> list[tuple[str, int, str]]:
        """(kind, number, path) of all commits, by number: a row each; none before the first."""
        try:
            return sorted((tuple(r) for r in self.spark.read.schema(LOG).parquet(f"{self.folder}/log").collect()), key=lambda r: r[1])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def last(self) -> int:
        """The number of the last commit, -1 before any."""
        return max((n for _, n, _ in self.log()), default=-1)

    def merge(self, rows: DataFrame, number: int, written: Callable[[], None] = lambda: None) -> bool:
        """Commit ``rows`` under ``number``, unless that has been done; ``written`` is called when the rows are there but don't count yet."""
        if any(n == number and kind == "change" for kind, n, _ in self.log()):
            return False
        path = f"{self.folder}/change-{number}-{uuid.uuid4().hex}"
        rows.select(*self._columns()).write.parquet(path)
        written()
        self._append([("change", number, path)])
        return True

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def read(self, upto: int | None = None, deleted: bool = False) -> DataFrame:
        """The rows as of commit ``upto``, or of the last one."""
        log = [r for r in self.log() if upto is None or r[1] <= upto]
        base = max((n for kind, n, _ in log if kind == "base"), default=-1)
        paths = [p for kind, n, p in log if (kind == "base" and n == base) or (kind == "change" and n > base)]
        parts = [self.spark.read.schema(self.schema).parquet(p) for p in paths] or [self.spark.createDataFrame([], self.schema)]
        rows = reduce(DataFrame.unionByName, parts)
        rest = [c for c in rows.columns if c not in self.key]
        now = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), self.order).alias("x")).select(*self.key, "x.*")
        return now.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in rest and not deleted else now

    def compact(self) -> None:
        """Write the rows as of the last commit as a base; earlier commits can still be read."""
        number = self.last()
        if number >= 0 and not any(kind == "base" and n == number for kind, n, _ in self.log()):
            path = f"{self.folder}/base-{number}-{uuid.uuid4().hex}"
            self.read().write.parquet(path)
            self._append([("base", number, path)])
