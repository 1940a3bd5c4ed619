"""Building blocks of writing and curating items: declarations, lessons, batches, reopening, relation rules, round trips, stages and set scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.functions import declared
from tidemark.session import checkpoint_dir, prepare

_REF = StructType([StructField(c, StringType()) for c in ("kind", "value")] + [StructField("section", BooleanType()), StructField("paths", ArrayType(StringType()))])
_FOUND = ArrayType(StructType([StructField("marker", StringType()), StructField("reverse", BooleanType()), StructField("subject", _REF), StructField("row", StringType()), StructField("itself", BooleanType()), StructField("targets", ArrayType(_REF)), StructField("clause", StringType())]))


@F.pandas_udf(_FOUND)
def _declared(bodies: pd.Series, paths: pd.Series) -> pd.Series:
    def one(body: str | None, path: str | None) -> list[dict]:
        ref = lambda k, v, section: {"kind": k, "value": v, "section": section, "paths": declared.candidates(v, path) if k == "path" else []}
        return [{"marker": d.marker, "reverse": d.reverse, "subject": ref(*d.subject, False) if d.subject else None, "row": d.row, "itself": d.itself, "targets": [ref(*t) for t in d.targets], "clause": d.clause} for d in declared.declarations(body or "")]

    return pd.Series([one(b, p) for b, p in zip(bodies, paths, strict=True)], dtype=object)


def declarations(items: DataFrame) -> DataFrame:
    """(key, n, k, marker, reverse, subject, row, itself, target): a row for each target of each declaration of items (key, path, body)."""
    d = items.select("key", F.posexplode(_declared("body", "path")).alias("n", "d")).select("key", "n", "d.*")
    return d.select("key", "n", "marker", "reverse", "subject", "row", "itself", F.posexplode("targets").alias("k", "target"))


def resolve(found: DataFrame, items: DataFrame) -> DataFrame:
    """(key, n, k, marker, newer, older, scope, outcome) for each row of ``declarations``: a link, or why there is none.

    items: (key, path, title, body). A reference is looked up by its path from the root, then from the folder of the item, then as a title, or as a decision row that
    a line of a body begins with; each step counts only if one item has it. A target is unknown if no step finds one, and ambiguous if the last that finds any finds more.
    Without an explicit subject a decision row declares for itself, and a text if nothing else is the subject; a text retires no single row of another. Links
    between parts of one item are none. The scope is part where a row or section is retired, or a row retires a text.
    """
    by = lambda d: d.groupBy("kind", "value").agg(F.count("*").alias("n_items"), F.min("item").alias("item"))
    rows = items.select("key", F.explode(F.split("body", "\n")).alias("line")).select(F.lit("row").alias("kind"), F.regexp_extract("line", r"^(D-\d{3,})[ \t]*\|", 1).alias("value"), F.col("key").alias("item")).where("value <> ''")
    names = by(items.select(F.lit("path").alias("kind"), F.col("path").alias("value"), F.col("key").alias("item")).unionByName(items.select(F.lit("title").alias("kind"), F.col("title").alias("value"), F.col("key").alias("item"))).unionByName(rows).where("value IS NOT NULL"))
    subject = found.where("subject IS NOT NULL").select("key", "n", F.lit(-1).alias("k"), F.col("subject").alias("ref"))
    refs = found.select("key", "n", "k", F.col("target").alias("ref")).unionByName(subject.distinct())
    steps = F.when(F.col("ref.kind") == "path", F.transform("ref.paths", lambda p: F.struct(F.lit("path").alias("kind"), p.alias("value")))).otherwise(F.array(F.struct(F.col("ref.kind").alias("kind"), F.col("ref.value").alias("value"))))
    tried = refs.select("key", "n", "k", F.posexplode(steps).alias("step", "s")).select("key", "n", "k", "step", "s.*").join(names, ["kind", "value"])
    hit = tried.groupBy("key", "n", "k").agg(F.min_by(F.when(F.col("n_items") == 1, F.col("item")), F.when(F.col("n_items") == 1, F.col("step"))).alias("item"), F.count("*").alias("any"))
    t = found.join(hit.select("key", "n", "k", F.col("item").alias("target_item"), "any"), ["key", "n", "k"], "left")
    t = t.join(hit.where("k = -1").select("key", "n", F.col("item").alias("subject_item")), ["key", "n"], "left")
    own = F.when(F.col("subject").isNotNull(), F.col("subject_item")).when(F.col("row").isNotNull() | F.col("itself"), F.col("key"))
    text_only = F.col("subject").isNull() & F.col("row").isNull()
    outcome = (
        F.when(F.col("target_item").isNull(), F.when(F.col("any").isNull(), "unknown-target").otherwise("ambiguous-target"))
        .when(own.isNull(), F.when(F.col("subject").isNull(), "no-subject").otherwise("unknown-subject"))
        .when(text_only & ~F.col("reverse") & (F.col("target.kind") == "row"), "row-by-text").when(own == F.col("target_item"), "self").otherwise("link")
    )
    t = t.withColumns({"outcome": outcome, "own": own})
    ok = F.col("outcome") == "link"
    new_is_row = (F.coalesce(F.col("subject.kind"), F.when(F.col("row").isNotNull(), "row")) == "row") & ~F.col("reverse")
    old_is_part = F.when(F.col("reverse"), F.coalesce(F.col("subject.kind") == "row", F.col("row").isNotNull())).otherwise((F.col("target.kind") == "row") | F.col("target.section"))
    side = lambda a, b: F.when(ok, F.when(F.col("reverse"), F.col(a)).otherwise(F.col(b)))
    scope = F.when(ok, F.when(F.coalesce(old_is_part, F.lit(False)) | F.coalesce(new_is_row, F.lit(False)), "part").otherwise("whole"))
    return t.select("key", "n", "k", "marker", side("target_item", "own").alias("newer"), side("own", "target_item").alias("older"), scope.alias("scope"), "outcome")


def lessons(items: DataFrame, key: str, body: str) -> DataFrame:
    """(key, rule, mistake, fix, context): a rule begins at each bullet labelled as a mistake and takes the fix and context up to the next; bullets before the first are rule 0. Other lines don't count."""
    roles = ("mistake", "fix", "context")
    lines = items.select(key, F.posexplode(F.split(body, "\n")).alias("i", "line")).where(F.startswith("line", F.lit("- ")) | F.startswith("line", F.lit("* ")))
    rest = F.substring("line", 3, 2**31 - 1)
    role = F.coalesce(*(F.when(F.startswith(F.lower(rest), F.lit(f"{r}: ")), r) for r in roles))
    text = F.trim(F.expr("substring(rest, length(role) + 3)"))
    b = lines.select(key, "i", rest.alias("rest"), role.alias("role")).where("role IS NOT NULL").withColumn("t", text)
    b = b.withColumn("rule", F.count_if(F.col("role") == "mistake").over(Window.partitionBy(key).orderBy("i")))
    return b.groupBy(key, "rule").agg(*(F.max(F.when(F.col("role") == r, F.col("t"))).alias(r) for r in roles))


def reopen(rows: DataFrame, asked: Column, at: Column) -> DataFrame:
    """The row set after supersessions of the closed rows in ``asked`` are taken back at ``at``: (version_id, logical_id, op, recorded_at, superseded_at).

    The row comes back as a copy ('restored') and the next of its line ends ('withdrawn'), unless that one was itself superseded ('refused').
    """
    line = Window.partitionBy("logical_id").orderBy("valid_from", "version_id")
    want = F.coalesce(F.col("superseded_at").isNotNull() & asked, F.lit(False))
    r = rows.withColumn("want", want)
    r = r.withColumn("undo", F.col("want") & F.lead("superseded_at").over(line).isNull())
    r = r.withColumn("gone", F.coalesce(F.lag("undo").over(line), F.lit(False)) & F.col("superseded_at").isNull())
    op = F.when(F.col("gone"), "withdrawn").when(F.col("want") & ~F.col("undo"), "refused").otherwise("kept")
    # each row gives itself, and a copy where it is restored, from one pass over the line
    own = F.struct(op.alias("op"), F.col("recorded_at").alias("recorded_at"), F.when(F.col("gone"), at).otherwise(F.col("superseded_at")).alias("superseded_at"))
    copy = F.when(F.col("undo"), F.struct(F.lit("restored").alias("op"), at.alias("recorded_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at")))
    return r.select("version_id", "logical_id", F.explode(F.array_compact(F.array(own, copy))).alias("x")).select("version_id", "logical_id", "x.*")


def actions(items: DataFrame, key: list[str], order: list[str], body: Column) -> DataFrame:
    """Items with ``action`` (insert, update, noop) against the last write of their key, and the ``version`` number that stands after it."""
    w = Window.partitionBy(*key).orderBy(*order)
    first, same = F.row_number().over(w) == 1, F.lag(body).over(w).eqNullSafe(body)
    a = items.withColumn("action", F.when(first, "insert").when(same, "noop").otherwise("update"))
    return a.withColumn("version", F.count_if(F.col("action") != "noop").over(w))


def relations(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key.., relation, tier) of text pairs (new, old). Numbers that both sides have alone drop the pair; equal texts act by themselves; more numbers over shared words refine, which asks."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    p = pairs.select(*key, "new", "old", words("new").alias("a"), words("old").alias("b"), numbers("new").alias("x"), numbers("old").alias("y"))
    p = p.select(*key, (F.col("new") == F.col("old")).alias("same"), F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("c"), F.size(F.array_except("x", "y")).alias("more"), F.size(F.array_except("y", "x")).alias("less"))
    c, nb, more = F.col("c"), F.col("nb"), F.col("more")
    clash, near, holds = (more > 0) & (F.col("less") > 0), 100 * c >= 90 * (F.col("na") + nb - c), 2 * c >= nb
    relation = F.when(clash, "dropped").when(F.col("same"), "duplicate").when(~near & holds & (more > 0), "refines").otherwise("relates")
    tier = F.when(clash, "none").when(F.col("same"), "auto").when(holds, "question").otherwise("ledger")
    return p.select(*key, relation.alias("relation"), tier.alias("tier"))


def round_trip(sent: DataFrame, there: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(batch, sent, equal, altered, missing, seal): texts by digest, in batches of ``size`` ids; a seal is the digest of a batch's digests by id. Null texts are empty. Only digests are shuffled."""
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    s, t = sent.select(key, digest.alias("a")), there.select(key, digest.alias("b"))
    n = lambda x: F.count_if(x)
    a, b = F.col("a"), F.col("b")
    g = s.join(t, key, "left").groupBy(F.floor(F.col(key) / size).alias("batch"))
    seal = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "a"))), lambda x: x["a"]), ""), 256)
    return g.agg(F.count("*").alias("sent"), n(a == b).alias("equal"), n(a != b).alias("altered"), n(b.isNull()).alias("missing"), seal.alias("seal"))


class Stages:
    """Named stages written below one shared folder; a run that is given the folder of an earlier one takes up the stages that are there."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = prepare(spark)
        self.folder = folder or f"{checkpoint_dir(spark)}/stages-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


def set_scores(answers: DataFrame, case: str) -> DataFrame:
    """(case, negative, f1, jaccard, correct) of rows (case, gold, said), one for each answer of a case. A case without gold is right if nothing was said."""
    n = answers.groupBy(case).agg(F.count_if(F.col("gold") & F.col("said")).alias("hit"), F.count_if("gold").alias("g"), F.count_if("said").alias("s"))
    hit, g, both = F.col("hit"), F.col("g"), F.col("g") + F.col("s")
    score = lambda x: F.when(both == 0, 1.0).otherwise(F.round(x, 6))
    return n.select(case, (g == 0).alias("negative"), score(2 * hit / both).alias("f1"), score(hit / (both - hit)).alias("jaccard"), F.when(g == 0, F.col("s") == 0).otherwise(hit > 0).alias("correct"))
