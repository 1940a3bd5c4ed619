"""Quality rules: one projection of per-text figures and a threshold table compiled into its verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import let, named, windows, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this at from or an a have not "
    "der die das und in zu den von mit ist des im für auf nicht ein eine als auch dem "
    "le la les de des du et en un une que est pour dans pas sur par au qui "
    "el los las y del se que por con una para su al lo no como"
).split()


#: As they stand in texts: tested without folding each word's case.
STOP_FORMS = list(dict.fromkeys(f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())))


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose figure lies in [low, high]; an open end is None. Texts of fewer than from_words words pass."""

    figure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0

    def holds(self) -> Column:
        c = F.col(self.figure)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (c >= self.low)
        if self.high is not None:
            ok = ok & (c <= self.high)
        return F.coalesce(ok | (F.col("n_words") < self.from_words), F.lit(False))


#: The threshold table. Ratios are of words, of lines with a word, or of letters.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=1.5, high=25),
    Rule("symbol_ratio", high=0.25),
    Rule("stop_ratio", low=0.01, from_words=50),
    Rule("dup_line_ratio", high=0.5),
    Rule("shout_ratio", high=0.5),
)


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The figures the rules and the base test use, beside the column ``__row``, which callers fill with what they need back.

    Null and empty texts have zero words and zero of everything else; ratios of nothing are zero. Rows are independent,
    so repeated rows get equal figures.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select("__row", t.alias("t"), words(F.col(text)).alias("w"))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.filter("w", lambda x: x.isin(STOP_FORMS))
    b = a.select(
        "__row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.size(stop).cast("long").alias("n_stop"),
        windows(F.transform("w", lambda x: F.xxhash64(x)), WINDOW).alias("h"),
    )
    c = b.withColumns(
        {
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            # only texts in which some window recurs are sorted
            "p": F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
        }
    ).drop("lines", "h")
    near = lambda p, x, i, k: F.coalesce(F.get(p, i + k)["h"] == x["h"], F.lit(False))
    twice = let(F.col("p"), lambda p: F.transform(p, lambda x, i: F.when(near(p, x, i, -1) | near(p, x, i, 1), x["i"])))
    d = c.withColumn("s", F.array_sort(F.filter(twice, lambda x: x.isNotNull()))).drop("p")
    step = let(F.col("s"), lambda s: F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.select(
        "*",
        F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long")).alias("n_repeat_words"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_upper", "word_chars").alias("shout_ratio"),
    ).drop("s")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table compiled into one boolean: no base failure and every rule holds."""
    ok = ~base_failed()
    for r in rules:
        ok = ok & r.holds()
    return ok


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of ``docs``, in no order: the id, the base figures, base_failed and kept.

    Extra columns of ``docs`` are ignored whatever their names; null ids stay null; an empty table gives no rows.
    """
    f = figures(docs.select(F.struct(F.col(id_col).alias("id")).alias("__row"), F.col(text).alias("text")))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return f.select(F.col("__row.id").alias("doc_id"), *base, base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, of any name, and no shuffle. Null and empty texts don't pass; texts of any length are judged whole; repeated rows each are."""
    f = figures(docs.select(F.struct(*(named(c) for c in docs.columns)).alias("__row"), F.col(text).alias("text")))
    # a filter would be pushed below the projections and evaluate each figure again for every rule
    return f.select(F.explode(F.when(verdict(rules), F.array("__row"))).alias("__kept")).select("__kept.*")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS r(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
s AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS wc, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(regexp_extract_all(t, '\p{Lu}')) AS n_upper, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  len(list_filter(w, lambda x: list_contains([STOP], x))) AS n_stop, coalesce(s.n, 0) AS n_repeat_words FROM w LEFT JOIN s USING (doc_id)),
x AS (SELECT *, coalesce(wc, 0) AS word_chars, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.25 AND (n_words < 50 OR n_stop / n_words >= 0.01)
  AND n_dup_lines / len(l) <= 0.5 AND n_upper / word_chars <= 0.5 AS kept FROM x
""".replace("STOP", ", ".join(f"'{x}'" for x in STOP_FORMS))
