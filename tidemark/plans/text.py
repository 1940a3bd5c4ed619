"""Text, personal data, dates, JSON and import plans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.operators.sizes import sized
from tidemark.plans.registry import operator
from tidemark.sources.tables import table

_STATE = r"list_filter(list_transform(regexp_split_to_array({}, '\n|[.!?] '), lambda s: trim(regexp_replace(s, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+', ''))), lambda s: s <> '')"


@operator()
def normalize_fold(spark, sf):
    """H1.1, H1.2: folded texts, and whether folding again changes nothing."""
    d = table(spark, sf, "documents").select("doc_id", X.normalise(F.col("text")).alias("folded"))
    return d.select("doc_id", "folded", (X.normalise("folded") == F.col("folded")).alias("stable"))


@operator(r"""WITH w AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(url, '[\p{L}\p{N}_][\p{L}\p{N}_./-]*'), lambda x: regexp_replace(x, '[./-]+$', '')), lambda x: length(x) >= 2) AS w FROM pages),
d AS (SELECT page_id, x, min(i) AS i FROM w, unnest(w) WITH ORDINALITY AS u(x, i) GROUP BY ALL) SELECT page_id, string_agg(x, ' ' ORDER BY i) AS terms, CAST(count(*) FILTER (regexp_matches(x, '[_/.0-9]')) AS BIGINT) AS identifiers FROM d GROUP BY page_id""")
def identifier_terms(spark, sf):
    """H1.3, H1.4: terms of a URL and how many are identifiers."""
    t = table(spark, sf, "pages").select("page_id", X.terms(F.col("url")).alias("t"))
    return t.select("page_id", F.array_join("t", " ").alias("terms"), F.size(F.filter("t", X.is_identifier)).cast("long").alias("identifiers"))


@operator(r"SELECT item_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM benchmark")
def slugify(spark, sf):
    """H1.31: ASCII slugs."""
    return table(spark, sf, "benchmark").select("item_id", X.slug(F.col("text")).alias("slug"))


@operator(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s[1] AS head FROM (SELECT doc_id, {_STATE.format('text')} AS s FROM documents)")
def statements_split(spark, sf):
    """H1.17: statements of a text."""
    return table(spark, sf, "documents").select("doc_id", X.statements(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", 0).alias("head"))


_RULES = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in X.RULES)
_MASK = "text"
for _n, _p in X.RULES:
    _MASK = f"regexp_replace({_MASK}, '{_p}', '[{_n}]', 'g')"


@operator(f"SELECT doc_id, array_to_string(list_filter([{_RULES}], lambda x: x IS NOT NULL), ',') AS kinds, md5({_MASK}) AS masked FROM documents")
def pii_mask(spark, sf):
    """H2.1-H2.4: kinds of personal data and secrets, and the masked text's digest."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.findings(F.col("text")), ",").alias("kinds"), F.md5(X.mask(F.col("text")).cast("binary")).alias("masked"))


@operator(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (regexp_matches(line, '(?i)password|token|secret')) AS BIGINT) AS secret_lines, CAST(count(*) FILTER (regexp_matches(line, '[A-Za-z0-9+/]{40,}')) AS BIGINT) AS blobs FROM l GROUP BY doc_id""")
def scrub_lines(spark, sf):
    """H2.5: lines a scrubber would drop."""
    l = F.split("text", "\n", -1)
    n = lambda p: F.size(F.filter(l, lambda x: x.rlike(p))).cast("long")
    return table(spark, sf, "documents").select("doc_id", F.size(l).cast("long").alias("n"), n("(?i)password|token|secret").alias("secret_lines"), n("[A-Za-z0-9+/]{40,}").alias("blobs"))


@operator(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<a [^>]*href=')) AS BIGINT) AS links, CAST(length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS BIGINT) AS text_chars FROM pages")
def html_title(spark, sf):
    """A7, H3.18: title, links and visible text of a page."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_count("html", F.lit("(?i)<a [^>]*href=")).cast("long").alias("links"), F.length(plain).cast("long").alias("text_chars"))


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


@operator(rf"""WITH b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM b, unnest(range(1, len(w) - 6)) AS u(i)), t AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i))
SELECT item_id, round(avg(CASE WHEN t.g IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share, CAST(count(*) AS BIGINT) AS n FROM s LEFT JOIN t USING (g) GROUP BY item_id""")
def containment_share(spark, sf):
    """C23, H1.18: the share of eight-word runs that originals hold."""
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    s = table(spark, sf, "benchmark").select("item_id", w("text").alias("w")).select("item_id", F.explode(X.shingles(F.col("w"), 8)).alias("g"))
    t = table(spark, sf, "documents").select(w("text").alias("w")).select(F.explode(X.shingles(F.col("w"), 8)).alias("g"))
    t = t.join(sized(s.select("g").distinct(), 128), "g", "left_semi").distinct().withColumn("have", F.lit(1.0))  # only the items' runs are shuffled
    return s.join(t, "g", "left").groupBy("item_id").agg(F.round(F.avg(F.coalesce("have", F.lit(0.0))), 6).alias("share"), F.count("*").alias("n"))


_OLD = "o AS (SELECT source || ':' || doc_id AS key, md5(text) AS h FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT source || ':' || doc_id AS key, md5(CASE WHEN doc_id % 7 = 0 THEN text || '+' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)"


@operator(f"WITH {_OLD} SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'missing' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS action FROM o FULL JOIN n ON o.key = n.key")
def manifest_diff(spark, sf):
    """What an import would do, by key and hash."""
    d = table(spark, sf, "documents")
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("key")
    md5 = lambda c, n: F.md5(c.cast("binary")).alias(n)
    o = d.where("doc_id % 11 <> 0").select(key, md5(F.col("text"), "old"))
    n = d.where("doc_id % 13 <> 0").select(key, md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")), "new"))
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return o.join(n, "key", "full_outer").select("key", action.alias("action"))


@operator(rf"""WITH a AS (SELECT item_id AS old_id, {_WORDS.format('text')} AS w FROM benchmark), b AS (SELECT doc_id AS new_id, {_WORDS.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT old_id, array_to_string(w[i:i + 2], ' ') AS g FROM a, unnest(range(1, len(w) - 1)) AS u(i)), t AS (SELECT DISTINCT new_id, array_to_string(w[i:i + 2], ' ') AS g FROM b, unnest(range(1, len(w) - 1)) AS u(i)),
k AS (SELECT old_id, new_id, count(*) AS k FROM s JOIN t USING (g) GROUP BY ALL), ns AS (SELECT old_id, count(*) AS n FROM s GROUP BY old_id), c AS (SELECT old_id, new_id FROM k JOIN ns USING (old_id) WHERE k >= 0.6 * n)
SELECT old_id, new_id FROM (SELECT *, count(*) OVER (PARTITION BY old_id) AS x, count(*) OVER (PARTITION BY new_id) AS y FROM c) WHERE x = 1 AND y = 1""")
def remap_unique(spark, sf):
    """Old and new items whose three-word runs agree, where each has the other only."""
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    s = table(spark, sf, "benchmark").select(F.col("item_id").alias("old_id"), w("text").alias("w")).select("old_id", X.shingles(F.col("w"), 3).alias("g"))
    s = s.select("old_id", F.size("g").alias("n"), F.explode("g").alias("g"))
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("new_id"), w("text").alias("w")).select("new_id", F.explode(X.shingles(F.col("w"), 3)).alias("g"))
    c = s.join(t, "g").groupBy("old_id", "new_id", "n").agg(F.count("*").alias("k")).where("k >= 0.6 * n")
    one = lambda k: F.count("*").over(Window.partitionBy(k)) == 1
    return c.withColumns({"x": one("old_id"), "y": one("new_id")}).where("x AND y").select("old_id", "new_id")


@operator("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS canonical, date_trunc('hour', ts) AS hour, [1, 2, 4, 8, 16][least(CAST(event_id % 8 AS BIGINT) + 1, 5)] AS backoff, 'v' || user_id || '.' || (event_id % 3) AS clue, sha256(event_type || ':' || event_id) AS digest, CAST(CAST(round(value, 2) AS DECIMAL(14, 8)) AS VARCHAR) AS money FROM events")
def date_math_ids(spark, sf):
    """H3.1, H3.6, H3.8, H3.9, H3.13, H3.14: instants, windows, backoff, clues, digests, money."""
    e = table(spark, sf, "events")
    back = F.element_at(F.array(*(F.lit(x) for x in (1, 2, 4, 8, 16))), F.least(F.col("event_id") % 8 + 1, F.lit(5)).cast("int"))
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("canonical"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), back.alias("backoff"), F.concat(F.lit("v"), F.col("user_id").cast("string"), F.lit("."), (F.col("event_id") % 3).cast("string")).alias("clue"),
        F.sha2(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), 256).alias("digest"), F.round("value", 2).cast("decimal(14,8)").cast("string").alias("money"),
    )


@operator(r"SELECT conv_id, turn, length(regexp_replace(text, '<[^>]*>', '', 'g')) AS clean_chars, CAST(len(regexp_extract_all(lower(text), 'decid|agreed|must|never|always')) AS BIGINT) AS score, CASE WHEN length(text) > 200 THEN left(text, 120) || ' … ' || right(text, 60) ELSE text END AS clip FROM conversations")
def conversation_clean(spark, sf):
    """H1.38, B20: tags stripped, long turns clipped to head and tail, decision words counted."""
    clip = F.when(F.length("text") > 200, F.concat(F.left("text", F.lit(120)), F.lit(" … "), F.right("text", F.lit(60)))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.length(F.regexp_replace("text", "<[^>]*>", "")).cast("long").alias("clean_chars"), F.regexp_count(F.lower("text"), F.lit("decid|agreed|must|never|always")).cast("long").alias("score"), clip.alias("clip"))


#: Frequent short words of four languages that the others hardly have.
FUNCTION_WORDS = {
    "de": ("und", "der", "die", "das", "ist", "nicht", "ein", "mit", "auf", "von", "zu", "den"),
    "en": ("the", "and", "of", "to", "is", "that", "it", "was", "for", "with", "at", "his"),
    "es": ("el", "y", "los", "las", "por", "con", "para", "una", "su", "como", "lo", "más"),
    "fr": ("le", "et", "les", "des", "est", "dans", "une", "pour", "qui", "pas", "du", "il"),
}
_HITS = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in ws)}], x)))" for ws in FUNCTION_WORDS.values())


@operator(rf"""WITH h AS (SELECT doc_id, lang, [{_HITS}] AS h FROM (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents))
SELECT doc_id, CASE WHEN list_max(h) > 0 THEN [{", ".join(repr(x) for x in FUNCTION_WORDS)}][list_position(h, list_max(h))] END AS guess, list_max(h) > 0 AND [{", ".join(repr(x) for x in FUNCTION_WORDS)}][list_position(h, list_max(h))] = lang AS right_guess FROM h""")
def language_guess(spark, sf):
    """H1.39: the language whose short words a text has most of, and whether that is the one it is filed under."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    hits = lambda own: F.size(F.filter("w", lambda x: x.isin(*own)))
    d = table(spark, sf, "documents").select("doc_id", "lang", w.alias("w"))
    d = d.select("doc_id", "lang", F.array(*map(hits, FUNCTION_WORDS.values())).alias("h"))
    best = F.when(F.array_max("h") > 0, F.element_at(F.array(*map(F.lit, FUNCTION_WORDS)), F.array_position("h", F.array_max("h")).cast("int")))
    return d.select("doc_id", best.alias("guess"), F.coalesce(best == F.col("lang"), F.lit(False)).alias("right_guess"))
