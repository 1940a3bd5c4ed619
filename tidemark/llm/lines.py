"""Line dedup: exact repeats by hash, near repeats by a join of deletion neighbourhoods; the earliest line stays.

A line is its lower-cased words. A line repeats an earlier one (smaller doc_id, or the same document and a smaller line number) if both have
the same words, or if both have NEAR_WORDS words or more and one edit of a word (put in, taken out, changed) makes them equal. Each line is
judged against all lines of the input, not against what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.small import sized
from tidemark.llm.text import words
from tidemark.session import cut, stored

NEAR_WORDS = 8
#: Stands for a null id, before all others.
NO_ID = -(2**63)
_PLACE = ("doc_id", "line_no")


def _split(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc_id"), F.posexplode(lines).alias("line_no", "line"))


def _hashed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each line with a word: its place, size, two hashes of its words, and up to three hashes of a first or last half.

    Of two lines one edit apart, the longer of c words, either the first c // 2 words agree or the last c - c // 2. A line takes part
    as one of c and as the shorter one of c + 1; the two cases share one half, so three keys do.
    """
    w = _split(docs, id_col, text).where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(*_PLACE, words(F.lower("line")).alias("w"))
    n = F.size("w")
    a, b = (n / 2).cast("int"), ((n + 1) / 2).cast("int")
    first = lambda k: F.xxhash64(F.lit(0), F.slice("w", F.lit(1), k))
    last = lambda k: F.xxhash64(F.lit(1), F.slice("w", n - k + 1, k))
    even = n % 2 == 0
    keys = F.when(n >= NEAR_WORDS, F.struct(first(a).alias("p"), F.when(even, last(a)).otherwise(first(b)).alias("q"), last(F.when(even, a + 1).otherwise(b)).alias("r")))
    return w.select(*_PLACE, n.alias("n"), F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(7), "w").alias("h2"), keys.alias("k")).select(*_PLACE, "n", "h1", "h2", "k.*")


def _later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose place is not the first of their key, with that first place as ``first``. Firsts are summed up map-side."""
    firsts = rows.groupBy(*keys).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return _after(rows, firsts, keys)


def _after(rows: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """A key has one row in ``firsts``, so what a hot key has in ``rows`` can be split over tasks: adaptive execution does so for skewed joins."""
    return rows.join(firsts, keys).where(F.struct(*_PLACE) > F.col("first"))


def one_edit(a: str, b: str) -> Column:
    """Whether at most one word differs between two word arrays, by substitution, insertion or deletion."""
    return F.expr(f"""
      CASE WHEN size({a}) = size({b}) THEN size(filter(zip_with({a}, {b}, (x, y) -> x <> y), t -> t)) <= 1
           WHEN size({a}) = size({b}) + 1 THEN exists(array(coalesce(nullif(array_position(zip_with(slice({a}, 1, size({b})), {b}, (x, y) -> x <> y), true), 0), size({b}) + 1)),
             p -> slice({a}, int(p) + 1, size({b})) = slice({b}, int(p), size({b})))
           WHEN size({b}) = size({a}) + 1 THEN exists(array(coalesce(nullif(array_position(zip_with(slice({b}, 1, size({a})), {a}, (x, y) -> x <> y), true), 0), size({a}) + 1)),
             p -> slice({b}, int(p) + 1, size({a})) = slice({a}, int(p), size({a})))
           ELSE false END""")


def _neighbourhoods(lines: DataFrame) -> DataFrame:
    """(key, place): for each line every way to take out one word, and itself with a gap at every place, as a hash of what is left and where.

    Hashes of what stands before and after a place are running exclusive ors of word hashes, so a line of n words costs n steps.
    Lines with an equal key are one edit apart at most.
    """
    rows = lines.select(*_PLACE, "n", "from_", "to_", F.posexplode("w").alias("j", "x"))
    rows = rows.select(*_PLACE, "n", "from_", "to_", "j", F.xxhash64("j", "x").alias("s"), F.xxhash64(F.col("j") - F.col("n"), "x").alias("e"))
    line = Window.partitionBy(*_PLACE)
    run = line.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    rows = rows.withColumns({"rs": F.bit_xor("s").over(run), "re": F.bit_xor("e").over(run), "te": F.bit_xor("e").over(line)})
    rows = rows.select(*_PLACE, "n", "j", "from_", "to_", "rs", xor("rs", "s").alias("before"), xor("te", "re").alias("after"), "e")
    rows = rows.where("j + 1 >= from_ and j <= to_")
    zero = F.lit(0).cast("long")
    key = lambda left, at, p, q: F.xxhash64(left, at, p, q)
    keys = F.array(
        key(F.col("n") - 1, F.col("j"), F.col("before"), F.col("after")),
        key(F.col("n"), F.col("j"), F.col("before"), xor("after", "e")),
        F.when(F.col("j") == F.col("n") - 1, key(F.col("n"), F.col("n"), F.col("rs"), zero)),
    )
    return rows.select(*_PLACE, F.explode(keys).alias("key")).where("key is not null")


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, near): the lines that repeat an earlier one; line_no counts from 0, doc_id NO_ID stands for null.

    Lines without a word never repeat. Rows that share an id count as one document: equal places don't repeat each other.
    """
    all_lines = stored(_hashed(docs, id_col, text))
    lowest = F.min(F.struct(*_PLACE, "n", "p", "q", "r")).alias("x")
    different = stored(all_lines.groupBy("h1", "h2").agg(lowest, F.count("*").alias("copies")).select("h1", "h2", "copies", "x.*"))
    again = different.where("copies > 1").select("h1", "h2", F.struct(*_PLACE).alias("first"))
    exact = _after(all_lines.select(*_PLACE, "h1", "h2"), again, ["h1", "h2"]).select(*_PLACE)
    # near repeats are sought among the first places of different lines, and among those only that share a half with another
    firsts = different.where(F.col("p").isNotNull())
    halves = firsts.select("h1", F.explode(F.array("p", "q", "r")).alias("half")).groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    even = F.col("n") % 2 == 0
    half = lambda c: F.col(f"{c}.half").isNotNull()
    f = firsts.select(*_PLACE, "n", F.posexplode(F.array("p", "q", "r")).alias("which", "half")).join(halves, "half")
    f = f.groupBy(*_PLACE, "n").agg(*(F.max(F.col("which") == i).alias(c) for i, c in enumerate("pqr")))
    small, big = (F.col("n") / 2).cast("int"), ((F.col("n") + 1) / 2).cast("int")
    # a shared first half of k words: the edit is at place k or after; a shared last half of k words: at n - k or before
    start = F.when(F.col("p"), small).when(F.col("q") & ~even, big).otherwise(F.col("n") + 1)
    end = F.when(F.col("q") & even, F.col("n") - small).when(F.col("r"), F.col("n") - F.when(even, small + 1).otherwise(big)).otherwise(-1)
    end = F.when(F.col("r"), F.greatest(end, F.col("n") - F.when(even, small + 1).otherwise(big))).otherwise(end)
    both = (F.col("p") | (F.col("q") & ~even)) & (F.col("r") | (F.col("q") & even))
    f = f.select(*_PLACE, F.when(both | (start <= F.col("n")), F.when(both, F.lit(0)).otherwise(start)).otherwise(0).alias("from_"), F.when(both | (start <= F.col("n")), F.col("n")).otherwise(end).alias("to_"))
    by_doc = cut(f.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "from_", "to_")).alias("picked")))
    n_picked = by_doc.agg(F.coalesce(F.sum(F.size("picked")), F.lit(0))).first()[0]
    t = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines"))
    t = t.join(sized(by_doc, n_picked, 24), "doc_id").select("doc_id", F.explode(F.expr("transform(picked, x -> struct(x.line_no, x.from_, x.to_, get(lines, x.line_no) AS line))")).alias("x"))
    t = t.select("doc_id", "x.*").where("line is not null")
    t = stored(t.select(*_PLACE, "from_", "to_", words(F.lower("line")).alias("w")).dropDuplicates(list(_PLACE)).withColumn("n", F.size("w")))
    pairs = _later(_neighbourhoods(t), ["key"]).select(*_PLACE, "first").distinct()
    one = t.where(F.col("n") >= NEAR_WORDS).select(*_PLACE, "w")
    other = one.select(F.struct(*_PLACE).alias("first"), F.col("w").alias("v"))
    near = pairs.join(one, list(_PLACE)).join(other, "first").where(one_edit("w", "v")).select(*_PLACE).distinct()
    return exact.distinct().withColumn("near", F.lit(False)).unionAll(near.withColumn("near", F.lit(True)))


def _left(lines: str, dropped: str) -> Column:
    return F.expr(f"array_join(transform(filter(transform({lines}, (x, i) -> struct(x, i)), y -> NOT array_contains({dropped}, y.i)), y -> y.x), '\\n')")


def _with_repeats(rows: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``rows`` (row, id, text) of ``docs``, whose columns may have any names, with exact and near: numbers of lines, or null where nothing repeats."""
    r = repeats(docs, id_col, text)
    # a line can repeat one only after edits if it is its words' first, so no line is in both lists
    r = r.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.when(~F.col("near"), F.col("line_no"))).alias("exact"), F.collect_list(F.when(F.col("near"), F.col("line_no"))).alias("near"))
    return rows.join(r, F.coalesce(rows["id"], F.lit(NO_ID)) == r["key"], "left")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_lines, n_exact, n_near (lines dropped) and kept_md5 of what is left. Null text: one empty line.

    Null ids count as one document before all others. A text of any length is cut into lines whole. An empty table gives no rows.
    """
    d = _with_repeats(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), docs, id_col, text)
    none = F.array().cast("array<int>")
    d = d.select(F.col("id").alias("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), F.coalesce("exact", none).alias("a"), F.coalesce("near", none).alias("b"))
    d = d.withColumn("c", F.concat("a", "b"))
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("a").cast("long").alias("n_exact"), F.size("b").cast("long").alias("n_near"), F.md5(_left("lines", "c").cast("binary")).alias("kept_md5"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text; rows that had words and have none left go, all other rows and columns stay. n_chars follows the text.

    Columns of ``docs`` may have any names; null texts stay; null ids and repeated ids are treated as in ``repeats``.
    """
    d = _with_repeats(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text")), docs, id_col, text)
    d = d.select("row", "text", F.split("text", "\n", -1).alias("lines"), F.concat("exact", "near").alias("gone"))
    d = d.select("row", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_left("lines", "gone")).alias("left"))
    d = d.where(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    new = {text: F.col("left")} | ({"n_chars": F.length("left").cast("long")} if "n_chars" in docs.columns else {})
    return d.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i)),
w AS (SELECT doc_id, line_no, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
r AS (SELECT *, array_to_string(w, ' ') AS s, min(struct_pack(d := doc_id, n := line_no)) OVER (PARTITION BY array_to_string(w, ' ')) AS fst FROM w WHERE len(w) > 0),
d AS (SELECT *, struct_pack(d := doc_id, n := line_no) AS pl FROM r),
f AS (SELECT * FROM d WHERE pl = fst AND len(w) >= 8),
k AS (SELECT pl, w, s, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v FROM f, unnest(range(1, len(w) + 1)) AS q(i)),
e AS (SELECT DISTINCT a.pl FROM k a JOIN k b ON a.v = b.v AND a.i = b.i AND len(a.w) = len(b.w) AND b.pl < a.pl
  UNION SELECT a.pl FROM k a JOIN f b ON a.v = b.s AND b.pl < a.pl UNION SELECT b.pl FROM k a JOIN f b ON a.v = b.s AND a.pl < b.pl),
g AS (SELECT pl.d AS doc_id, pl.n AS line_no, 1 AS near FROM e UNION ALL SELECT doc_id, line_no, 0 FROM d WHERE pl > fst)
SELECT l.doc_id, count(*) AS n_lines, CAST(count(*) FILTER (near = 0) AS BIGINT) AS n_exact, CAST(count(*) FILTER (near = 1) AS BIGINT) AS n_near,
  md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (near IS NULL), '')) AS kept_md5
FROM l LEFT JOIN g USING (doc_id, line_no) GROUP BY l.doc_id
"""
