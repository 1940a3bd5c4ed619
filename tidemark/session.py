"""Session settings shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; extra keyword settings use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return prepare(b.config(map=settings).getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and name a checkpoint folder where the cluster names none."""
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset: a temporary one if the master is local (tests), else an error."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        shared = sc.getCheckpointDir()
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
            shared = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def cut(df):
    """``df`` computed once and kept in the checkpoint folder, so that a lost executor costs no lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df):
    """``df`` as a Parquet table in the checkpoint folder: as ``cut``, but columnar and compressed, for wide or many rows."""
    spark = prepare(df.sparkSession)
    path = f"{checkpoint_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df, **what):
    """``df`` as ``stored`` gives it, and what the aggregates ``what`` come to over its rows, seen while they are written: no job of their own."""
    seen = Observation()
    out = stored(df.observe(seen, *(c.alias(k) for k, c in what.items())))
    return out, seen.get


_KEPT: dict[tuple[str, str, str], str] = {}


def state_of(source) -> str:
    """A digest of the paths, lengths and times of the files that a table is read from: another one when the table changes."""
    one = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    n, x = source.select(one.alias("h")).distinct().agg(F.count("*"), F.bit_xor("h")).first()
    return f"{n}-{x}"


def kept(spark: SparkSession, name: str, state: str, build):
    """What ``build()`` gives, stored once for each ``state`` of its sources in this session and read again after that; made anew if the folder is gone."""
    key = (prepare(spark).sparkContext.applicationId, name, state)
    if key in _KEPT:
        try:
            return spark.read.parquet(_KEPT[key])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    build().write.parquet(path)
    _KEPT[key] = path
    return spark.read.parquet(path)
