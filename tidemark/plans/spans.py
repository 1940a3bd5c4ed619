"""Spans, quotes, previews, Markdown, sources and sinks, each beside its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import redact
from tidemark.functions import text as X
from tidemark.operators.sizes import sized
from tidemark.plans.registry import operator
from tidemark.plans.retrieval import query_terms
from tidemark.session import checkpoint_dir, cut, prepare
from tidemark.sources import files
from tidemark.sources.tables import table

_TOKEN = r"[\p{L}\p{N}_]+"


@operator(r"""WITH n AS (SELECT item_id, text, lower(substr(text, 1, 2)) AS needle, lower(text) AS hay FROM benchmark),
o AS (SELECT item_id, text, hay, needle, list_filter(range(1, length(hay)), lambda i: substr(hay, i, 2) = needle) AS places FROM n)
SELECT item_id, CAST(len(places) AS BIGINT) AS occurrences, len(places) = 1 AS once, NOT regexp_matches(substr(hay, 3, 1), '[\p{L}\p{N}_]') AS whole_word, '[cut]' || substr(text, 3) AS spliced FROM o""")
def span_occurrences(spark, sf):
    """H1.21, H1.22: overlapping occurrences of a span, whether it is unique and cuts no word, and the text with it replaced."""
    hay = F.lower("text")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(hay) - 1, F.lit(1))), lambda i: F.substring(hay, i, F.lit(2)) == F.substring(hay, 1, 2))
    b = table(spark, sf, "benchmark").select("item_id", "text", F.size(places).cast("long").alias("occurrences"))
    whole = ~F.substring(F.lower("text"), 3, 1).rlike(r"[\p{L}\p{N}_]")
    return b.select("item_id", "occurrences", (F.col("occurrences") == 1).alias("once"), whole.alias("whole_word"), F.overlay("text", F.lit("[cut]"), 1, 2).alias("spliced"))


@operator(r"""WITH c AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations),
q AS (SELECT *, array_to_string(w[2:4], ' ') || CASE WHEN turn % 2 = 1 THEN ' never' ELSE '' END AS quote FROM c)
SELECT conv_id, turn, quote, len(regexp_extract_all(quote, '[\p{L}\p{N}_]+')) >= 2 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || quote || ' ') AS verbatim FROM q""")
def quote_tests(spark, sf):
    """H1.20: whether a quote of two words or more stands in the text, apart from case and punctuation."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0))
    c = table(spark, sf, "conversations").select("conv_id", "turn", w.alias("w"))
    q = c.withColumn("quote", F.concat(F.array_join(F.slice("w", 2, 3), " "), F.when(F.col("turn") % 2 == 1, " never").otherwise("")))
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    two = F.regexp_count("quote", F.lit(_TOKEN)) >= 2
    return q.select("conv_id", "turn", "quote", (two & F.contains(pad(F.array_join("w", " ")), pad(F.col("quote")))).alias("verbatim"))


# turns of which every third names a number that the one before has too, and every third one that it hasn't
_NUMBERED = "CASE (conv_id + turn) % 3 WHEN 0 THEN text || ' 17' WHEN 1 THEN text || ' 17, 18.5' ELSE text || ' 17 18.5 19' END"
_NUMBERS = f"SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, {_NUMBERED} AS text FROM conversations)"
_TURNS = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations"


@operator(rf"""WITH t AS ({_NUMBERS}), s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS numbers, regexp_extract_all(coalesce(before, ''), '[0-9]+(?:[.,][0-9]+)*') AS have,
  list_filter(list_distinct(regexp_extract_all(lower(text), '{_TOKEN}')), lambda x: length(x) >= 9) AS refs, regexp_extract_all(lower(coalesce(before, '')), '{_TOKEN}') AS known FROM t)
SELECT conv_id, turn, len(list_filter(numbers, lambda x: NOT list_contains(have, x))) = 0 AS supported, CAST(len(list_filter(refs, lambda x: NOT list_contains(known, x))) AS BIGINT) AS ungrounded FROM s""")
def literal_support(spark, sf):
    """H1.24, H1.26: whether all numbers of a turn stand in the one before, and how many long words don't."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("text", F.expr(_NUMBERED)).select("conv_id", "turn", "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("before"))
    number = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), F.lit(0))
    refs = F.filter(F.array_distinct(words("text")), lambda x: F.length(x) >= 9)
    return t.select("conv_id", "turn", (F.size(F.array_except(number("text"), number("before"))) == 0).alias("supported"), F.size(F.array_except(refs, words("before"))).cast("long").alias("ungrounded"))


@operator(rf"""WITH t AS ({_TURNS}), s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '{_TOKEN}'), lambda x: length(x) >= 4)) AS new, list_distinct(list_filter(regexp_extract_all(lower(coalesce(before, '')), '{_TOKEN}'), lambda x: length(x) >= 4)) AS old FROM t)
SELECT conv_id, turn, len(list_intersect(new, old)) >= 0.6 * len(old) AND len(new) >= 1.3 * len(old) AS more_specific FROM s""")
def specificity(spark, sf):
    """H1.19: whether a text holds most content words of the one before and clearly more."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), F.lit(0)), lambda x: F.length(x) >= 4))
    t = table(spark, sf, "conversations").select("conv_id", "turn", words("text").alias("new"), words(F.coalesce(F.lag("text").over(w), F.lit(""))).alias("old"))
    most, more = F.size(F.array_intersect("new", "old")) >= 0.6 * F.size("old"), F.size("new") >= 1.3 * F.size("old")
    return t.select("conv_id", "turn", (most & more).alias("more_specific"))


#: Words of a preview, and how many of them stand before its first hit.
PREVIEW, LEAD = 16, 4
_Q20 = rf"q AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(text), '{_TOKEN}')) AS terms FROM benchmark WHERE item_id % 20 = 0)"


@operator(rf"""WITH {_Q20}, d AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS w FROM documents),
m AS (SELECT qid, terms, doc_id, w FROM (SELECT qid, terms, doc_id, w, row_number() OVER (PARTITION BY qid ORDER BY len(list_intersect(list_transform(w, lambda x: lower(x)), terms)) DESC, doc_id) AS r FROM q, d) WHERE r <= 5),
p AS (SELECT qid, doc_id, w, i, len(list_intersect(list_transform(w[i:i + {PREVIEW - 1}], lambda x: lower(x)), terms)) AS n, list_contains(terms, lower(w[i])) AS hit FROM m, unnest(range(1, len(w) + 1)) AS u(i)),
b AS (SELECT qid, doc_id, w, arg_max(i, [n, -i]) AS i, max(n) AS n FROM p WHERE hit GROUP BY qid, doc_id, w)
SELECT qid, doc_id, CAST(n AS BIGINT) AS n, CASE WHEN i > {LEAD + 1} THEN '… ' ELSE '' END || array_to_string(w[greatest(1, i - {LEAD}):greatest(1, i - {LEAD}) + {PREVIEW - 1}], ' ') AS preview FROM b""")
def query_preview(spark, sf):
    """H1.13, H1.14: for each query the five documents with most of its terms, and the window of each that holds most different ones, shown with a lead."""
    q = query_terms(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)).alias("w"))
    # documents meet a query over the terms they share
    found = d.select("doc_id", F.explode(F.array_distinct(F.transform("w", F.lower))).alias("tok")).join(q, "tok").groupBy("qid", "doc_id").agg(F.count("*").alias("k"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("k").desc(), "doc_id"))).where("r <= 5")
    best = cut(best.select("qid", "doc_id"))  # five rows a query
    m = d.join(sized(best, 32), "doc_id").join(q.groupBy("qid").agg(F.collect_list("tok").alias("terms")), "qid")
    m = cut(m.select("qid", "doc_id", "w", "terms", F.transform("w", F.lower).alias("low")))  # else made anew for each window below
    # windows begin at hits; the earliest of those with most terms
    starts = F.filter(F.transform("low", lambda x, i: F.when(F.array_contains("terms", x), i + 1)), lambda i: i.isNotNull())
    m = m.select("qid", "doc_id", "w", "terms", "low", starts.alias("starts"))
    scored = F.transform("starts", lambda i: F.struct(F.size(F.array_intersect(F.slice("low", i, F.lit(PREVIEW)), F.col("terms"))).alias("n"), (-i).alias("i")))
    m = m.select("qid", "doc_id", "w", F.array_max(scored).alias("x")).select("qid", "doc_id", "w", F.col("x.n").cast("long").alias("n"), (-F.col("x.i")).alias("i"))
    shown = F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("i") - LEAD), F.lit(PREVIEW)), " ")
    return m.select("qid", "doc_id", "n", F.concat(F.when(F.col("i") > LEAD + 1, "… ").otherwise(""), shown).alias("preview"))


@operator(rf"""WITH {_Q20}, p AS (SELECT DISTINCT qid, substr(t, 1, 5) AS pre FROM q, unnest(terms) AS u(t) WHERE length(t) >= 5), n AS (SELECT qid, count(*) AS n FROM p GROUP BY qid),
d AS (SELECT DISTINCT doc_id, substr(t, 1, 5) AS pre FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS t FROM documents) WHERE length(t) >= 5)
SELECT qid, doc_id, CAST(count(*) AS BIGINT) AS any_of, count(*) = n.n AS all_of FROM p JOIN d USING (pre) JOIN n USING (qid) GROUP BY qid, doc_id, n.n""")
def prefix_match(spark, sf):
    """H1.6: documents with words that begin like any of a query's terms, and whether all of its terms have one."""
    p = query_terms(spark, sf).where("length(tok) >= 5").select("qid", F.substring("tok", 1, 5).alias("pre")).distinct()
    p = p.withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    w = F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0))
    pre = F.array_distinct(F.transform(F.filter(w, lambda x: F.length(x) >= 5), lambda x: F.substring(x, 1, 5)))
    d = table(spark, sf, "documents").select("doc_id", F.explode(pre).alias("pre"))
    return d.join(p, "pre").groupBy("qid", "doc_id", "n").agg(F.count("*").alias("any_of")).select("qid", "doc_id", "any_of", (F.col("any_of") == F.col("n")).alias("all_of"))


@operator(r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, array_to_string(t[1:16], ' ') AS head FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS t FROM documents)""")
def token_meter(spark, sf):
    """H1.15: tokens of a text by a word-piece stand-in, and its first sixteen."""
    t = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("tokens"), F.array_join(F.slice("t", 1, 16), " ").alias("head"))


_MD = "'---' || chr(10) || 'title: ' || source || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || '# Body' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '## See docs/' || lang || '.md' || chr(10) || '@notes/' || doc_id || '.md'"


def _markdown(spark, sf):
    n = F.lit("\n")
    md = F.concat(F.lit("---\ntitle: "), "source", n, F.lit("lang: "), "lang", F.lit("\n---\n# Body\n"), F.coalesce("text", F.lit("")), F.lit("\n```\n# no heading\n```\n## See docs/"), "lang", F.lit(".md\n@notes/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf, "documents").select("doc_id", md.alias("md"))


@operator(rf"""WITH m AS (SELECT doc_id, {_MD} AS md FROM documents), l AS (SELECT doc_id, i, string_split(md, chr(10))[i] AS line FROM m, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS u(i)),
f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM l)
SELECT doc_id, CAST(count(*) FILTER (NOT fenced AND regexp_matches(line, '^#{{1,4}} ')) AS BIGINT) AS headings, CAST(count(*) FILTER (starts_with(line, '@')) AS BIGINT) AS stubs,
  max(regexp_extract(line, '^title: (.*)$', 1)) FILTER (i = 2) AS title, string_agg(regexp_extract(line, '([a-z]+/[a-z]+[.]md)', 1), ',') FILTER (NOT fenced AND regexp_matches(line, '^## .*[a-z]+/[a-z]+[.]md')) AS paths FROM f GROUP BY doc_id""")
def markdown_structure(spark, sf):
    """A7, H1.29, H1.32, H1.35, H1.36: frontmatter, headings outside fences, path mentions and stub lines of Markdown, by line."""
    return files.structure(_markdown(spark, sf), "doc_id", "md")


@operator(r"""SELECT doc_id, CASE WHEN octet_length(encode(text)) > 20000 THEN 'too-large' WHEN trim(text, ' ' || chr(9) || chr(10)) = '' THEN 'empty' WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b') THEN 'secret' ELSE 'admitted' END AS reason,
  regexp_matches(text, '[^.!?\s"'')\]]\s*$') OR (length(text) - length(replace(text, '```', ''))) // 3 % 2 = 1 AS cut_off FROM documents""")
def admission(spark, sf):
    """A6, H1.37: why a document is not taken in, and whether it looks cut off."""
    d = table(spark, sf, "documents")
    fences = (F.length("text") - F.length(F.replace("text", F.lit("```"), F.lit("")))) / 3
    return d.select("doc_id", files.admission(F.col("text"), 20_000).alias("reason"), (F.col("text").rlike(r"""[^.!?\s"')\]]\s*$""") | (F.floor(fences) % 2 == 1)).alias("cut_off"))


@operator()
def directory_scan(spark, sf):
    """A5: the files below a folder by suffix, without hidden ones: path, bytes and whether they may be read."""
    return files.scan(spark, sf, ("parquet",)).select("path", "length", (F.col("length") <= files.MOST_BYTES).alias("taken"))


def _folder(spark, name):
    return f"{checkpoint_dir(prepare(spark))}/{name}-{uuid.uuid4().hex}"


@operator("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT NULL, NULL, NULL, NULL WHERE false")
def jsonl_round_trip(spark, sf):
    """Turns written as JSON lines beside broken lines, and read again; broken lines are skipped."""
    c = table(spark, sf, "conversations")
    folder = _folder(spark, "jsonl")
    lines = c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    lines.unionAll(c.where("turn = 0").select(F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string")))).write.text(folder)
    return files.json_lines(spark, folder, "conv_id long, turn long, role string, text string")


@operator("SELECT event_id, event_type, user_id, value FROM events")
def event_sink(spark, sf):
    """Events appended in two batches, the second of which repeats rows of the first; an event stays once, as it came first."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    folder = _folder(spark, "events")
    files.append_events(e.where("value <= 60"), folder, "event_id")
    files.append_events(e.where("value > 40").withColumn("value", F.when(F.col("value") <= 60, -1.0).otherwise(F.col("value"))), folder, "event_id")
    return spark.read.parquet(folder).select("event_id", F.col("event_type").cast("string").alias("event_type"), "user_id", "value")


_RAW = r"""'{"k": ' || k || ', "mail" : "user' || user_id || '@example.org", "deep": [{"note": "said \"hi\" to a' || k || '@b.org", "a@key.org":"at 10.0.0.7, {\"x\": 1}"}, null, 1.50, "' || event_type || '"]}'"""


@operator(rf"""SELECT event_id, replace(replace(replace({_RAW}, 'user' || user_id || '@example.org', '[email]'), 'a' || k || '@b.org', '[email]'), '10.0.0.7', '[ipv4]') AS clean FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_redact(spark, sf):
    """H2.6: every string inside a JSON value masked, also behind blanks, escapes and in arrays; keys, numbers and shape stay."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", redact.masked_json(F.expr(_RAW.replace("\\", "\\\\"))).alias("clean"))


@operator()
def secret_redact(spark, sf):
    """H2.3, H2.4: secrets of the documents as placeholders of kind and digest; how many, and which."""
    t = redact.redacted(F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(t, F.lit("⟦[a-z_]+:[0-9a-f]{8}⟧"), F.lit(0)).alias("found"))
    return d.select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", " ").alias("placeholders"))
