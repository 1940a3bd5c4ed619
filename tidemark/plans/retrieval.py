"""Candidate lists, fusion, and the hybrid query."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import predicates as P
from tidemark.operators import lexicon as L
from tidemark.operators import retrieval as R
from tidemark.operators.sizes import held, sized
from tidemark.plans.aggregates import doc_terms
from tidemark.plans.registry import operator
from tidemark.session import cut, kept, state_of
from tidemark.sources.model import CHUNKS, VERSIONS, chunks, versions
from tidemark.sources.tables import table

# queries: all different words of the benchmark items whose id is divisible by 20, against all chunks
_Q = r"""qw AS (SELECT item_id AS qid, x AS tok, i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE item_id % 20 = 0), unnest(w) WITH ORDINALITY AS u(x, i)),
q AS (SELECT DISTINCT qid, tok FROM qw)"""
_IS_ID = "regexp_matches(term, '[_/.0-9]')"
#: Words of a title, words of a preview and how many stand before its first hit, and words that the hits of a query may show.
TITLE_WORDS, SHOWN, LEAD, BUDGET = 8, 16, 4, 200
#: What first place in one list gives, rounded up: evidence of no more is weak.
WEAK = 0.0164
#: The project, scopes and instants of hybrid_query.
PROJECT, SCOPES, V_AT, K_AT = 27, ["all", "class:work", "device:3"], "1996-06-01", "1996-06-05"


def _tokens(name: str, source: str) -> str:
    """(doc_id, chunk_id, tok, pos) of a relation with text."""
    return rf"{name} AS (SELECT doc_id, chunk_id, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT doc_id, chunk_id, regexp_extract_all(lower(text), '{L.TOKEN}') AS t FROM {source}))"


def _rare(name: str, terms: str, tk: str, source: str, fallback: int) -> str:
    """The terms of a relation (qid, term) that stand in at most a fifth of the texts, prefixes counted."""
    return f"""{name}_v AS (SELECT tok, count(*) AS df FROM (SELECT DISTINCT tok, doc_id, chunk_id FROM {tk}) GROUP BY tok), {name}_n AS (SELECT count(*) AS n FROM {source}),
{name}_d AS (SELECT term, least(sum(df), max(n)) AS df FROM (SELECT DISTINCT term FROM {terms}) JOIN {name}_v ON starts_with(tok, term), {name}_n GROUP BY term),
{name}_o AS (SELECT qid, term, coalesce(df, 0) AS df, n < 100 OR coalesce(df, 0) <= 0.2 * n OR {_IS_ID} AS ok FROM {terms} LEFT JOIN {name}_d USING (term), {name}_n),
{name} AS (SELECT qid, term FROM (SELECT *, bool_or(ok) OVER (PARTITION BY qid) AS any_ok, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS rn FROM {name}_o) WHERE ok OR NOT any_ok AND rn <= {fallback})"""


def _cover(name: str, groups: str, tk: str) -> str:
    """Cover density (qid, doc_id, chunk_id, score) of groups (qid, grp, m, term): for each end the latest start, for each start the first end."""
    return f"""{name}_x AS (SELECT DISTINCT qid, grp, m, term, tok FROM {groups} JOIN (SELECT DISTINCT tok FROM {tk}) ON starts_with(tok, term)),
{name}_h AS (SELECT DISTINCT qid, doc_id, chunk_id, grp, m, term, pos FROM {name}_x JOIN {tk} USING (tok)),
{name}_e AS (SELECT DISTINCT qid, doc_id, chunk_id, pos AS e FROM {name}_h),
{name}_l AS (SELECT qid, doc_id, chunk_id, e, grp, m, term, max(pos) AS p FROM {name}_e JOIN {name}_h USING (qid, doc_id, chunk_id) WHERE pos <= e GROUP BY ALL),
{name}_g AS (SELECT qid, doc_id, chunk_id, e, grp, min(p) AS p FROM {name}_l GROUP BY qid, doc_id, chunk_id, e, grp, m HAVING count(*) = m),
{name}_c AS (SELECT qid, doc_id, chunk_id, p, min(e) AS e FROM (SELECT qid, doc_id, chunk_id, e, max(p) AS p FROM {name}_g GROUP BY ALL) GROUP BY qid, doc_id, chunk_id, p),
{name}_r AS (SELECT c.qid, c.doc_id, c.chunk_id, c.p, c.e, 1 + (c.e - c.p) - (count(*) - 1) AS w FROM {name}_c c JOIN {name}_e x ON x.qid = c.qid AND x.doc_id = c.doc_id AND x.chunk_id = c.chunk_id AND x.e BETWEEN c.p AND c.e GROUP BY c.qid, c.doc_id, c.chunk_id, c.p, c.e),
{name} AS (SELECT qid, doc_id, chunk_id, round(r / (r + 1), 6) AS score FROM (SELECT qid, doc_id, chunk_id, sum(CAST(0.1 AS DOUBLE) / w) AS r FROM {name}_r GROUP BY ALL))"""


def _top(name: str, source: str, order: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k})"


_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_RUN = _GRAMS.removeprefix("list_distinct(").removesuffix(")")
_CT = f"{CHUNKS}, ct AS (SELECT doc_id, chunk_id, array_to_string(words, ' ') AS text FROM chunks), tt AS (SELECT doc_id, chunk_id, array_to_string(words[1:{TITLE_WORDS}], ' ') AS text FROM chunks WHERE ordinal = 0)"
_BASE = f"""{_CT}, {_tokens("tk", "ct")}, {_tokens("ttk", "tt")}, {_Q}, qt AS (SELECT qid, tok AS term FROM q), {_rare("lt", "qt", "tk", "ct", 2)}, {_rare("tq", "lt", "ttk", "tt", 0)},
qg AS (SELECT DISTINCT qid, grp, unnest(regexp_extract_all(grp, '{L.TOKEN}')) AS term FROM (SELECT item_id AS qid, unnest(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_./-]*'), lambda x: rtrim(x, './-'))) AS grp FROM benchmark WHERE item_id % 20 = 0)),
lg AS (SELECT qid, term AS grp, 1 AS m, term FROM lt), tg AS (SELECT qid, grp, count(*) OVER (PARTITION BY qid, grp) AS m, term FROM qg WHERE (qid, grp) IN (SELECT qid, grp FROM qg JOIN tq USING (qid, term)))"""


def _lists(seen: str) -> str:
    """The four lists over the documents of a relation (doc_id)."""
    own = lambda name, source: f"{name} AS (SELECT * FROM {source} WHERE doc_id IN (SELECT doc_id FROM {seen}))"
    return f"""{own("vk", "tk")}, {own("vtk", "ttk")}, {own("vct", "ct")}, {_cover("lc", "lg", "vk")}, {_cover("tc", "tg", "vtk")},
{_top("lex", "lc", "score DESC, chunk_id, doc_id", R.LEXICAL)}, {_top("tit", "tc", "score DESC, doc_id", R.TITLE)},
ti AS (SELECT qid, term, {_GRAMS.format("term")} AS own FROM lt WHERE length(term) >= {L.LONG} OR {_IS_ID}), cg AS (SELECT doc_id, chunk_id, {_RUN.format("text")} AS run FROM vct),
cx AS (SELECT doc_id, chunk_id, run, list_distinct(run) AS dr FROM cg),
sv AS (SELECT qid, term, own, doc_id, chunk_id, run FROM ti JOIN cx ON len(list_intersect(own, dr)) >= {L.SIMILAR} * len(own) - 1e-9),
mp AS (SELECT qid, term, own, doc_id, chunk_id, run, list_filter(range(1, len(run) + 1), lambda i: list_contains(own, run[i])) AS hits FROM sv),
ex AS (SELECT qid, own, doc_id, chunk_id, list_distinct(run[a:b]) AS part FROM (SELECT *, unnest(hits) AS a FROM mp), unnest(hits) AS u(b) WHERE b >= a AND b - a <= 4 * len(own)),
ts AS (SELECT qid, doc_id, chunk_id, round(max(len(list_intersect(part, own)) / (len(own) + len(part) - len(list_intersect(part, own)))), 6) AS score FROM ex GROUP BY ALL),
{_top("tri", "(SELECT * FROM ts WHERE score >= " + str(L.SIMILAR) + " - 1e-6)", "score DESC, chunk_id, doc_id", R.TRIGRAM)},
{_top("vec", "(SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT qid FROM q) AND b.vec_id IN (SELECT doc_id FROM " + seen + "))", "sim DESC, doc_id", R.VECTOR)},
cl AS (SELECT qid, doc_id, chunk_id, 'l' AS k, rank FROM lex UNION ALL SELECT qid, doc_id, chunk_id, 't', rank FROM tri UNION ALL SELECT qid, doc_id, doc_id * 1000, 'v', rank FROM vec),
cf AS (SELECT qid, doc_id, chunk_id, sum(1.0 / (60 + rank)) AS part, max(rank) FILTER (k = 'l') AS lexical_rank, max(rank) FILTER (k = 't') AS trigram_rank, max(rank) FILTER (k = 'v') AS vector_rank FROM cl GROUP BY ALL),
fused AS (SELECT qid, coalesce(chunk_id, doc_id * 1000) AS chunk_id, doc_id, round(coalesce(part, 0) + coalesce(1.0 / (60 + tit.rank), 0), 8) AS score,
  CAST((lexical_rank IS NOT NULL)::INT + (trigram_rank IS NOT NULL)::INT + (vector_rank IS NOT NULL)::INT + (tit.rank IS NOT NULL)::INT AS BIGINT) AS n_lists, lexical_rank, trigram_rank, vector_rank, tit.rank AS title_rank
  FROM cf FULL JOIN (SELECT qid, doc_id, rank FROM tit) tit USING (qid, doc_id))"""


_ALL = f"{_BASE}, every AS (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings), {_lists('every')}"
#: As _ALL, with all items of the benchmark as queries.
_WHOLE = _ALL.replace(" WHERE item_id % 20 = 0", "")
_LIVE = f"""{_BASE}, {VERSIONS}, lv AS (SELECT logical_id AS doc_id, version_id, device_scope FROM versions WHERE list_contains(project_ids, {PROJECT}) AND device_scope IN ({", ".join(f"'{s}'" for s in SCOPES)})
  AND valid_from <= TIMESTAMP '{V_AT}' AND (valid_to IS NULL OR TIMESTAMP '{V_AT}' < valid_to) AND recorded_at <= TIMESTAMP '{K_AT}' AND (superseded_at IS NULL OR TIMESTAMP '{K_AT}' < superseded_at)), {_lists('lv')}"""


def items(spark, sf, every=False):
    """The benchmark items that are queries: those whose id is divisible by 20, or ``every`` one."""
    b = table(spark, sf, "benchmark")
    return b if every else b.where("item_id % 20 = 0")


def query_terms(spark, sf, every=False):
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return items(spark, sf, every).select(F.col("item_id").alias("qid"), F.explode(w).alias("tok"))


class Lexicon:
    """Chunks, positional indexes of them and of the titles, vocabularies and sizes: made once for a state of the documents and kept for the session. ``every``: all items of the benchmark are queries."""

    def __init__(self, spark, sf, every=False):
        docs = table(spark, sf, "documents")
        state = state_of(docs)
        own = lambda name, build: kept(spark, name, state, build)
        self.spark, self.sf, self.every = spark, sf, every
        self.chunks = own("chunks", lambda: chunks(spark, sf))
        self.index = own("index", lambda: L.index(self.chunks))
        titles = self.chunks.where("ordinal = 0").select("doc_id", "chunk_id", F.slice("words", 1, TITLE_WORDS).alias("words"))
        self.titles = own("titles", lambda: L.index(titles))
        self.vocabulary = own("vocabulary", lambda: L.vocabulary(self.index))
        self.title_vocabulary = own("title vocabulary", lambda: L.vocabulary(self.titles))

    @cached_property
    def expanded(self):
        """(qid, term, tok, df): the tokens that begin with each of the queries' words."""
        return held(L.expand(self.vocabulary, held(query_terms(self.spark, self.sf, self.every).withColumnRenamed("tok", "term"))))

    @cached_property
    def terms(self):
        """(qid, term): the queries' words that, as prefixes, stand in at most a fifth of the chunks, or their two rarest."""
        terms = held(query_terms(self.spark, self.sf, self.every).withColumnRenamed("tok", "term"))
        return rare_prefixes(self.expanded, terms, self.chunks.agg(F.count("*").alias("n_docs")), 2)


def rare_prefixes(expanded, terms, n, fallback):
    """The terms (qid, term) that, as prefixes, stand in few enough of the texts; ``n`` has one row (n_docs)."""
    d = L.prefix_df(expanded).crossJoin(F.broadcast(n)).select(F.col("term").alias("tok"), F.least("df", "n_docs").alias("df"))
    return held(R.rare_terms(terms.withColumnRenamed("term", "tok"), d, n, fallback=fallback).select("qid", F.col("tok").alias("term")))


def query_groups(spark, sf, every=False):
    """(qid, grp, term): the tokens of each compound word of a query."""
    raw = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_./-]*"), F.lit(0)), lambda x: F.regexp_replace(x, r"[./-]+$", ""))
    g = items(spark, sf, every).select(F.col("item_id").alias("qid"), F.explode(raw).alias("grp"))
    return g.select("qid", "grp", F.explode(L.tokens(F.col("grp"))).alias("term")).distinct()


def lexical_list(lx, seen=None):
    """(qid, doc_id, chunk_id, score, rank): chunks by cover density of the OR of the terms as prefixes."""
    d = L.cover_density(_among(lx.index, seen), L.any_of(lx.expanded.join(lx.terms, ["qid", "term"], "left_semi")))
    return R.top_k(d, ["qid"], [F.col("score").desc(), F.col("chunk_id"), F.col("doc_id")], R.LEXICAL)


def title_list(lx, seen=None):
    """(qid, doc_id, score, rank): titles that hold all tokens of a compound word of the query, one of which is rare among titles too."""
    rare = rare_prefixes(L.expand(lx.title_vocabulary, lx.terms), lx.terms, lx.chunks.where("ordinal = 0").agg(F.count("*").alias("n_docs")), 0)
    groups = query_groups(lx.spark, lx.sf, lx.every)
    groups = groups.join(groups.join(rare, ["qid", "term"], "left_semi").select("qid", "grp").distinct(), ["qid", "grp"], "left_semi")
    groups = held(groups.withColumn("m", F.count("*").over(Window.partitionBy("qid", "grp")).cast("int")))
    d = L.cover_density(_among(lx.titles, seen), L.expand(lx.title_vocabulary, groups))
    return R.top_k(d, ["qid"], [F.col("score").desc(), F.col("doc_id")], R.TITLE)


def trigram_list(lx, seen=None):
    t = lx.terms.where(L.is_long_or_identifier(F.col("term")))
    d = L.trigram_similar(lx.chunks, _among(lx.index, seen), lx.vocabulary, t)
    return R.top_k(d, ["qid"], [F.col("score").desc(), F.col("chunk_id"), F.col("doc_id")], R.TRIGRAM)


def _among(rows, seen):
    """Rows of documents that may be seen: before anything is ranked or cut."""
    return rows if seen is None else rows.join(seen.select("doc_id"), "doc_id", "left_semi")


def fused(lx, seen=None):
    """(qid, chunk_id, doc_id, score, n_lists, ranks): four lists fused by reciprocal rank. A title credits every chunk of its document that is in another list, or the first one."""
    spark, sf = lx.spark, lx.sf
    named = lambda d, name: d.select("qid", "doc_id", "chunk_id", F.lit(name).alias("k"), "rank")
    e = table(spark, sf, "embeddings")
    asked = items(spark, sf, lx.every).select(F.col("item_id").alias("vec_id")).distinct()
    q = held(e.join(asked, "vec_id").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), 8192)
    others = e if seen is None else e.join(seen.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    vec = R.cosine_top(q, others, R.VECTOR).select(F.col("q").alias("qid"), F.col("v").alias("doc_id"), (F.col("v") * 1000).alias("chunk_id"), "rank")
    lists = named(lexical_list(lx, seen), "l").unionByName(named(trigram_list(lx, seen), "t")).unionByName(named(vec, "v"))
    rank = lambda k: F.max(F.when(F.col("k") == k, F.col("rank")))
    c = lists.groupBy("qid", "doc_id", "chunk_id").agg(F.sum(F.lit(1.0) / (R.K_RRF + F.col("rank"))).alias("part"), rank("l").alias("lexical_rank"), rank("t").alias("trigram_rank"), rank("v").alias("vector_rank"))
    t = title_list(lx, seen).select("qid", "doc_id", F.col("rank").alias("title_rank"))
    f = c.join(t, ["qid", "doc_id"], "full")
    ranks = ["lexical_rank", "trigram_rank", "vector_rank", "title_rank"]
    score = F.round(F.coalesce("part", F.lit(0.0)) + F.coalesce(F.lit(1.0) / (R.K_RRF + F.col("title_rank")), F.lit(0.0)), 8)
    n = sum(F.col(r).isNotNull().cast("long") for r in ranks)
    return cut(f.select("qid", F.coalesce("chunk_id", F.col("doc_id") * 1000).alias("chunk_id"), "doc_id", score.alias("score"), n.alias("n_lists"), *ranks))


@operator(f"WITH {_ALL} SELECT qid, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM lex")
def lexical_top(spark, sf):
    """H1.5-H1.7, F1: the hundred best chunks of each query by cover density of its rare words as prefixes."""
    return lexical_list(Lexicon(spark, sf)).select("qid", "chunk_id", "score", "rank")


_PAIRS = """pw AS (SELECT qid, i, term, lead(term) OVER (PARTITION BY qid ORDER BY i) AS nxt FROM (SELECT qid, i, tok AS term FROM qw WHERE (qid, tok) IN (SELECT qid, term FROM lt))),
pg AS (SELECT DISTINCT qid, grp, 2 AS m, term FROM (SELECT qid, term || ' ' || nxt AS grp, unnest([term, nxt]) AS term FROM pw WHERE nxt IS NOT NULL AND nxt <> term))"""


@operator(f"WITH {_BASE}, {_PAIRS}, {_cover('pc', 'pg', 'tk')} SELECT qid, doc_id, chunk_id, score FROM pc")
def cover_density_top(spark, sf):
    """H1.6, H1.7: chunks that hold two rare words which follow each other in the query, as prefixes, by the density of the shortest runs that hold both."""
    lx = Lexicon(spark, sf)
    w = F.regexp_extract_all(F.lower("text"), F.lit(L.TOKEN), F.lit(0))
    q = table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.posexplode(w).alias("i", "term")).join(lx.terms, ["qid", "term"], "left_semi")
    p = q.withColumn("nxt", F.lead("term").over(Window.partitionBy("qid").orderBy("i"))).where("nxt IS NOT NULL AND nxt <> term")
    groups = p.select("qid", F.concat_ws(" ", "term", "nxt").alias("grp"), F.lit(2).alias("m"), F.explode(F.array("term", "nxt")).alias("term")).distinct()
    return L.cover_density(lx.index, L.expand(lx.vocabulary, held(groups)))


@operator(f"WITH {_WHOLE} SELECT qid, doc_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM tri")
def trigram_top(spark, sf):
    """H1.8, C3, D1, F2: for each item of the benchmark the twenty chunks with the run of trigrams most like one of its long words or identifiers, at a similarity of .9 or more."""
    return trigram_list(Lexicon(spark, sf, every=True)).select("qid", "doc_id", "chunk_id", "score", "rank")


@operator(f"WITH {_ALL} SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM tit")
def title_top(spark, sf):
    """Titles by cover density."""
    return title_list(Lexicon(spark, sf)).select("qid", "doc_id", "rank")


@operator("SELECT q, v, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, v) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS v, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)) WHERE rank <= 20")
def cosine_topk(spark, sf):
    """H1.9, F2, L12: nearest vectors of a stated query set, exactly."""
    e = table(spark, sf, "embeddings")
    return R.cosine_top(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e, 20)


@operator("SELECT label, round(max(s), 4) AS best, round(avg(s), 4) AS mean, CAST(count(*) AS BIGINT) AS n FROM (SELECT b.label, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id = 0 AND b.vec_id <> 0) GROUP BY label")
def max_cos_per_label(spark, sf):
    """The best chunk of each version."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("qv"))
    s = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("label", R.dot("qv", "embedding").alias("s"))
    return s.groupBy("label").agg(F.round(F.max("s"), 4).alias("best"), F.round(F.avg("s"), 4).alias("mean"), F.count("*").alias("n"))


@operator("WITH m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY i) SELECT vec_id, round(sqrt(sum(x * x)), 4) AS norm, round(sum((x - m) * (x - m)), 4) AS spread FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) JOIN m USING (i) GROUP BY vec_id")
def vector_normalise(spark, sf):
    """H1.10: lengths, and distances from the corpus mean."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "x"))
    m = e.groupBy("i").agg(F.avg("x").alias("m"))
    j = e.join(F.broadcast(m), "i")  # a row for each dimension
    return j.groupBy("vec_id").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 4).alias("norm"), F.round(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))), 4).alias("spread"))


@operator(f"WITH {_WHOLE} SELECT qid, chunk_id, doc_id, score, n_lists FROM fused")
def rrf_fusion(spark, sf):
    """C18, C19, H1.11: for each item of the benchmark all hits of the lists, fused."""
    return fused(Lexicon(spark, sf, every=True)).select("qid", "chunk_id", "doc_id", "score", "n_lists")


@operator(f"""WITH {_LIVE}, b AS (SELECT f.*, version_id, device_scope, CASE split_part(device_scope, ':', 1) WHEN 'device' THEN 0 WHEN 'class' THEN 1 ELSE 2 END AS s FROM fused f JOIN lv USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, s, coalesce(lexical_rank, 1000), chunk_id) AS rn FROM b),
w AS (SELECT o.*, regexp_split_to_array(text, ' ') AS w, terms FROM o JOIN ct USING (doc_id, chunk_id) JOIN (SELECT qid, list(term) AS terms FROM lt GROUP BY qid) USING (qid) WHERE rn = 1),
p AS (SELECT *, list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(terms, lower(w[i]))), lambda i: [len(list_intersect(list_distinct(list_transform(w[greatest(1, least(i - {LEAD}, greatest(1, len(w) - {SHOWN - 1}))):greatest(1, least(i - {LEAD}, greatest(1, len(w) - {SHOWN - 1}))) + {SHOWN - 1}], lambda x: lower(x))), terms)), -greatest(1, least(i - {LEAD}, greatest(1, len(w) - {SHOWN - 1})))])) AS best FROM w),
v AS (SELECT *, coalesce(-best[2], 1) AS k FROM p),
u AS (SELECT *, sum(len(w[k:k + {SHOWN - 1}])) OVER (PARTITION BY qid ORDER BY score DESC, s, coalesce(lexical_rank, 1000), chunk_id, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM v)
SELECT qid, doc_id, version_id, chunk_id, score, n_lists, device_scope, CASE WHEN k > 1 THEN '… ' ELSE '' END || array_to_string(w[k:k + {SHOWN - 1}], ' ') AS preview, CAST(used AS BIGINT) AS used FROM u WHERE used <= {BUDGET}""")
def hybrid_query(spark, sf):
    """What a device may see of a project at an instant, ranked by four lists of frequency-filtered terms, the best chunk of each item, with previews packed under a word budget."""
    live = held(versions(spark, sf).where(P.authz(PROJECT, SCOPES) & P.temporal_live(V_AT, K_AT)).select(F.col("logical_id").alias("doc_id"), "version_id", "device_scope"))
    lx = Lexicon(spark, sf)
    f = fused(lx, live).join(live, "doc_id")
    scope = F.when(F.startswith("device_scope", F.lit("device")), 0).when(F.startswith("device_scope", F.lit("class")), 1).otherwise(2)
    order = [F.col("score").desc(), F.col("s"), F.coalesce("lexical_rank", F.lit(1000)), F.col("chunk_id")]
    best = R.top_k(f.withColumn("s", scope), ["qid", "doc_id"], order, 1).drop("rank")
    terms = lx.terms.groupBy("qid").agg(F.collect_list("term").alias("terms"))
    h = lx.chunks.select("doc_id", "chunk_id", "words").join(held(best, 128), ["doc_id", "chunk_id"]).join(terms, "qid")
    h = h.withColumn("preview", L.preview(F.col("words"), F.col("terms"), SHOWN, LEAD)).withColumn("n", F.least(F.size("words"), F.lit(SHOWN)))
    h = R.pack_prefix(h, ["qid"], [*order, F.col("doc_id")], "n", BUDGET)
    return h.select("qid", "doc_id", "version_id", "chunk_id", "score", "n_lists", "device_scope", "preview", "used")


@operator(f"""WITH {_ALL}, d AS (SELECT qid // 8 AS qid, doc_id, max(score) AS score FROM fused GROUP BY ALL), r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM d)
SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def multi_query(spark, sf):
    """Several queries of one question; a document counts by its best."""
    d = fused(Lexicon(spark, sf)).groupBy(F.floor(F.col("qid") / 8).alias("qid"), "doc_id").agg(F.max("score").alias("score"))
    return R.top_k(d, ["qid"], [F.col("score").desc(), F.col("doc_id")], 10)


@operator(f"""WITH {_ALL}, u AS (SELECT f.* FROM fused f JOIN labels l ON l.doc_id = f.doc_id AND quality = 1), r AS (SELECT qid, doc_id, max(score) AS score FROM u GROUP BY ALL)
SELECT qid, doc_id, score, score > {WEAK} AS warn FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM r) WHERE rk <= 10""")
def risk_check(spark, sf):
    """L5, L7, H1.12: fused hits inside a restricted universe, and whether they are strong enough."""
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    d = fused(Lexicon(spark, sf)).join(good, "doc_id").groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return R.top_k(d, ["qid"], [F.col("score").desc(), F.col("doc_id")], 10).select("qid", "doc_id", "score", (F.col("score") > WEAK).alias("warn"))


@operator(f"""WITH {_Q}, dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM documents), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT tok, count(*) AS df FROM dt GROUP BY tok),
t AS (SELECT qid, tok, coalesce(df, 0) AS df, coalesce(df, 0) <= 0.2 * n OR regexp_matches(tok, '[_/.0-9]') OR n < 100 AS ok FROM q LEFT JOIN df USING (tok), n),
x AS (SELECT *, bool_or(ok) OVER (PARTITION BY qid) AS any_ok, row_number() OVER (PARTITION BY qid ORDER BY df, tok) AS rn FROM t) SELECT qid, tok, CAST(df AS BIGINT) AS df FROM x WHERE ok OR NOT any_ok AND rn <= 2""")
def common_term_filter(spark, sf):
    """H1.5: terms that too many documents have are dropped; the two rarest stay if all are common."""
    df = doc_terms(spark, sf).groupBy("tok").agg(F.count("*").alias("df"))
    n = table(spark, sf, "documents").agg(F.count("*").alias("n_docs"))
    return R.rare_terms(query_terms(spark, sf), df, n)


@operator(f"WITH {CHUNKS} SELECT chunk_id, doc_id, ordinal, CAST(len(words) AS INTEGER) AS n, md5(array_to_string(words, ' ')) AS digest FROM chunks")
def chunk_windows(spark, sf):
    """H1.16: forty-word windows, four words shared."""
    return chunks(spark, sf).select("chunk_id", "doc_id", "ordinal", F.size("words").alias("n"), F.md5(F.array_join("words", " ").cast("binary")).alias("digest"))


@operator(f"WITH {CHUNKS}, p AS (SELECT doc_id, ordinal FROM chunks WHERE ordinal = 1) SELECT c.chunk_id, c.doc_id, p.ordinal AS around FROM chunks c JOIN p ON c.doc_id = p.doc_id AND c.ordinal BETWEEN p.ordinal - 1 AND p.ordinal + 1")
def drilldown_neighbours(spark, sf):
    """A chunk with its neighbours."""
    c = chunks(spark, sf)
    p = c.where("ordinal = 1").select("doc_id", F.explode(F.array(*(F.col("ordinal") + k for k in (-1, 0, 1)))).alias("ordinal"), F.col("ordinal").alias("around"))
    return c.join(p, ["doc_id", "ordinal"]).select("chunk_id", "doc_id", "around")


def trigrams(c):
    """Trigrams of a word with two blanks before and one after."""
    p = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


_TRI = "list_distinct(list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3)))"


@operator(rf"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS x FROM documents), v AS (SELECT DISTINCT x FROM w),
q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS x FROM benchmark), qq AS (SELECT x AS term FROM q),
a AS (SELECT x, unnest({_TRI}) AS g FROM v), b AS (SELECT term, unnest({_TRI.replace("x)", "term)").replace("|| x ||", "|| term ||").replace("length(x", "length(term")}) AS g FROM qq),
s AS (SELECT term, x, count(*) AS k FROM a JOIN b USING (g) GROUP BY ALL), na AS (SELECT x, count(*) AS n FROM a GROUP BY x), nb AS (SELECT term, count(*) AS m FROM b GROUP BY term)
SELECT term, x AS word, round(k / m, 4) AS sim FROM s JOIN na USING (x) JOIN nb USING (term) WHERE k / m >= 0.6""")
def word_similarity_match(spark, sf):
    """C3, D1, H1.8: all words of the benchmark against all words of the documents by the share of the term's trigrams, counted where the words lie."""
    tok = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    v = table(spark, sf, "documents").select(tok("text").alias("word")).distinct()
    q = table(spark, sf, "benchmark").select(tok("text").alias("term")).distinct()
    s = L.sharing(v.withColumn("t", trigrams(F.col("word"))), q.withColumn("t", trigrams(F.col("term"))), 0.6).where("k / m >= 0.6")
    return s.select("term", "word", F.round(F.col("k") / F.col("m"), 4).alias("sim"))
