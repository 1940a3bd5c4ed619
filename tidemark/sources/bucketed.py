"""Tables kept in buckets of a key, so that joins, groups and windows on it don't shuffle them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.session import checkpoint_dir, prepare

#: Rows of a bucket, on average.
BUCKET_ROWS = 2_000_000


def bucketed(rows: DataFrame, key: str, order: list[str], folder: str | None = None, buckets: int | None = None) -> DataFrame:
    """``rows`` written once into buckets of ``key``, each sorted by key and ``order``, below ``folder`` (else the checkpoint folder), and read again as a table.

    The number of buckets follows the rows; it is the number of tasks of what is done by the key. A hot key fills one bucket: what is joined to it is not split, so
    tables with such keys are better left as they are.
    """
    spark = prepare(rows.sparkSession)
    name = f"bucketed_{uuid.uuid4().hex}"
    n = buckets or max(8, -(-rows.count() // BUCKET_ROWS))
    path = f"{folder or checkpoint_dir(spark)}/{name}"
    # one task a bucket writes it, so that each is one file
    rows.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key, *order).option("path", path).saveAsTable(name)
    return spark.table(name)
