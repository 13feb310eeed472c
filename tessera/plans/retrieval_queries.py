"""Queries of the memory plane: terms, vectors, BM25, fusion, recall, revisions, links, trees, forgetting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import memory as M
from tessera.functions import text as T
from tessera.operators import lexical_index, lineage, retrieval
from tessera.plans.registry import query
from tessera.sources import adapters as A
from tessera.sources.shared import checkpoint_dir
from tessera.sources.store import Store
from tessera.sources.tables import table
from tessera.streaming import reinforce, watch


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
CAMEL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
PARTS = "list_filter(string_split_regex(" + CAMEL + ", '[ _-]+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+'))"

SUMMARY = "substr(split_part(text, chr(10), 1), 1, 80)"
#: Index tokens of a text: its terms and their identifier words, each once within its term, cut as the index cuts them.
TERMS = "list_filter(string_split_regex({}, '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: w <> '')"
VARIANTS = "list_transform(" + TERMS + ", lambda w: list_distinct(list_prepend(lower(w), list_transform(" + PARTS.format("w").replace("lambda w:", "lambda v:").replace("(w, '[A-Za-z0-9]+')", "(v, '[A-Za-z0-9]+')") + ", lambda x: lower(x)))))"
TOKENS = "list_filter(string_split_regex(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

WORD_TABLES = f"""
doc_words AS (SELECT doc_id AS id, {WORDS.format(SUMMARY + " || chr(10) || text")} AS ws FROM documents),
query_all AS (SELECT item_id AS qid, {WORDS.format("text")} AS ws FROM benchmark),
doc_terms AS (SELECT doc_id AS id, list_concat({TOKENS.format(SUMMARY)}, {TOKENS.format("array_to_string(flatten(" + VARIANTS.format(SUMMARY + " || ' ' || text") + "), ' ')")}) AS ws FROM documents),
query_words AS (SELECT item_id AS qid, list_filter(list_distinct(flatten({VARIANTS.format("text")})), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)})) AS ws FROM benchmark)"""

BM25 = """
doc_tok AS (SELECT id, len(ws) AS len, unnest(ws) AS w FROM doc_terms),
totals AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM doc_terms),
asked AS (SELECT DISTINCT qid, strip_accents(w) AS w FROM (SELECT qid, unnest(ws) AS w FROM query_words)),
post AS (SELECT w, id, any_value(len) AS len, count(*) AS tf FROM doc_tok WHERE w IN (SELECT w FROM asked) GROUP BY w, id),
idf AS (SELECT w, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf
        FROM (SELECT w, count(*) AS df FROM post GROUP BY w), totals),
bm_scored AS (SELECT qid, id, sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score
              FROM post JOIN idf USING (w) JOIN asked USING (w), totals GROUP BY qid, id),
bm_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm_scored),
bm AS (SELECT qid, id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM bm_ranked WHERE rank <= 20)
       WHERE CASE WHEN best > 0 THEN round(score, 9) >= round(best * 0.3, 9) ELSE rank = 1 END)"""

VECTORS = """
doc_dim AS (SELECT id, CAST('0x' || substr(sha256(w), 1, 2) AS INTEGER) % 64 AS d, count(*) AS c
            FROM (SELECT id, unnest(ws) AS w FROM doc_words) GROUP BY 1, 2),
query_dim AS (SELECT qid, CAST('0x' || substr(sha256(w), 1, 2) AS INTEGER) % 64 AS d, count(*) AS c
              FROM (SELECT qid, unnest(ws) AS w FROM query_all) GROUP BY 1, 2),
doc_norm AS (SELECT id, sqrt(sum(c * c)) AS n FROM doc_dim GROUP BY id),
query_norm AS (SELECT qid, sqrt(sum(c * c)) AS n FROM query_dim GROUP BY qid),
vec_scored AS (SELECT qid, id, sum(q.c * d.c) / (any_value(qn.n) * any_value(dn.n)) AS score
               FROM query_dim q JOIN doc_dim d USING (d) JOIN query_norm qn USING (qid) JOIN doc_norm dn USING (id) GROUP BY qid, id),
vec_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM vec_scored),
vec AS (SELECT qid, id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM vec_ranked WHERE rank <= 20)
        WHERE CASE WHEN best > 0 THEN round(score, 9) >= round(best * 0.8, 9) ELSE rank = 1 END)"""

FUSED = """
fused AS (SELECT qid, id, 61 * sum(1.0 / (60 + rank)) AS relevance
          FROM (SELECT qid, id, rank FROM vec UNION ALL SELECT qid, id, rank FROM bm) GROUP BY qid, id)"""

TAILS = "tails AS (SELECT doc_id AS id, max(doc_id) OVER (PARTITION BY doc_id // 3) AS tail FROM documents)"

CANDIDATES = f"""
{TAILS},
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(relevance, 9) DESC, id) AS rn FROM fused) WHERE rn <= 3),
added AS (SELECT s.qid, t.tail AS id, max(relevance) * 0.5 AS relevance FROM seeds s JOIN tails t USING (id) WHERE t.tail <> s.id GROUP BY 1, 2),
cand AS (SELECT qid, id, relevance, true AS matched FROM fused UNION ALL
         SELECT qid, id, relevance, false FROM added a WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.qid = a.qid AND f.id = a.id)),
rows0 AS (SELECT c.*, t.tail, t.tail = c.id AS latest, exp(-(c.id % 90) / 7.0) AS retention, c.id % 90 AS age_days
          FROM cand c JOIN tails t USING (id)),
scored AS (SELECT *, relevance * (0.9 + 0.1 * retention) AS score FROM rows0)"""

FOLDED = """
folded AS (SELECT s.* FROM scored s WHERE s.latest OR NOT EXISTS (SELECT 1 FROM scored x WHERE x.qid = s.qid AND x.id = s.tail))"""

RECALL = f"""
{FOLDED},
direct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM folded) WHERE rank <= 3),
pairs AS (SELECT doc_id AS id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents),
both_ways AS (SELECT id, other FROM pairs WHERE other IS NOT NULL UNION SELECT other, id FROM pairs WHERE other IS NOT NULL),
reached AS (SELECT d.qid, t.tail AS id, d.id AS seed, d.score FROM direct d JOIN both_ways b USING (id) JOIN tails t ON t.id = b.other),
linked0 AS (SELECT qid, id, max(score) * 0.5 AS relevance, list_sort(list(DISTINCT seed)) AS linked_from FROM reached r
            WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.qid = r.qid AND d.id = r.id) GROUP BY qid, id),
linked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(relevance, 9) DESC, id) AS rank FROM linked0) WHERE rank <= 3),
recalled AS (
  SELECT qid, id, rank, score, relevance, retention, latest, age_days, 'direct' AS source, '' AS linked_from, matched FROM direct
  UNION ALL
  SELECT l.qid, l.id, l.rank, l.relevance, l.relevance, exp(-(l.id % 90) / 7.0), true, l.id % 90, 'link', array_to_string(linked_from, ','),
         EXISTS (SELECT 1 FROM fused f WHERE f.qid = l.qid AND f.id = l.id) FROM linked l)"""

ALL = f"WITH {WORD_TABLES}, {BM25}, {VECTORS}, {FUSED}, {CANDIDATES}, {RECALL}"


def _documents(spark: SparkSession, d: str, stems: bool = False) -> DataFrame:
    return A.memories(spark, d).select("id", T.lexical_row("summary", "body", stems).alias("words"))


def _questions(spark: SparkSession, d: str, stems: bool = False) -> DataFrame:
    from tessera.functions.stem import with_stems

    terms = T.query_terms("text")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.phrases(with_stems(terms) if stems else terms).alias("words"))


def bm25(spark: SparkSession, d: str) -> DataFrame:
    """From the stored index of records: summary, and terms of summary and body with identifier words."""
    return lexical_index.hits(A.stored_index(spark, d), _questions(spark, d))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = retrieval.hash_vectors(A.memories(spark, d).select("id", F.concat_ws("\n", "summary", "body").alias("text")), "id", "text")
    asked = retrieval.hash_vectors(table(spark, d, "benchmark"), "item_id", "text").withColumnRenamed("id", "qid")
    return retrieval.vector_hits(docs, asked)


def recalled(spark: SparkSession, d: str, **options) -> DataFrame:
    return retrieval.recall(A.memories(spark, d), A.links(spark, d), [vectors(spark, d), bm25(spark, d)], A.NOW, **options)


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, t[1] AS first_term FROM (SELECT doc_id, list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: w <> '') AS t FROM documents)")
def tok_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.split_terms("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first_term"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""
WITH t AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: w <> '')) AS w FROM benchmark),
x AS (SELECT item_id, lower(w) AS w FROM t UNION SELECT item_id, lower(unnest({PARTS.format("w")})) FROM t)
SELECT item_id, string_agg(w, ' ' ORDER BY w) AS terms FROM x WHERE w NOT IN ({_STOP}) GROUP BY item_id""")
def tok_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.query_terms("text")), " ").alias("terms"))


@query(f"SELECT p_partkey, array_to_string({PARTS.format('t')}, ' ') AS words FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '-' || replace(p_brand, '#', 'X') || p_size AS t FROM part)")
def ident_split(spark: SparkSession, d: str) -> DataFrame:
    term = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.replace("p_brand", F.lit("#"), F.lit("X")), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.identifier_words(term), " ").alias("words"))


@query(f"WITH {WORD_TABLES}, {VECTORS} SELECT qid, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM vec")
def hash_embed_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(vectors(spark, d))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s),
t AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM r WHERE rank <= 20)
SELECT qid, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM t WHERE CASE WHEN best > 0 THEN round(score, 9) >= round(best * 0.8, 9) ELSE rank = 1 END""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _ranked(retrieval.vector_hits(v, v.filter("id % 100 = 0").withColumnRenamed("id", "qid"), drop_self=True))


@query(f"WITH {WORD_TABLES}, {BM25} SELECT qid, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(bm25(spark, d))


_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' hotPassword ' || substr(text, 1, 40) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1"


@query(f"WITH changed AS ({_CHANGED}), {WORD_TABLES.replace('FROM documents', 'FROM changed')}, {BM25} SELECT qid, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM bm")
def bm25_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """The stored index after documents came, changed and went in three commits; SQL indexes what is left in one go."""
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/lexical-{uuid.uuid4().hex}")
    records, digit = A.memories(spark, d).select("id", "summary", "body"), F.pmod("id", F.lit(10))
    lexical_index.change(store, records.filter(digit != 3))
    lexical_index.change(store, records.filter(digit == 3), records.filter(digit == 1).select("id"))
    changed = records.filter(digit == 0).withColumn("body", F.concat("body", F.lit(" hotPassword "), F.substring("body", 1, 40)))
    for _ in range(2):  # tried again after a restart
        lexical_index.change(store, changed.withColumn("summary", F.substring(F.split_part("body", F.lit("\n"), F.lit(1)), 1, 80)), marks={"edits": 1})
    return _ranked(lexical_index.hits(store, _questions(spark, d)))


@query(f"WITH {WORD_TABLES}, {BM25}, {VECTORS}, {FUSED} SELECT qid, id, round(relevance, 6) AS relevance FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse([vectors(spark, d), bm25(spark, d)]).select("qid", "id", r6("relevance").alias("relevance"))


@query(f"""{ALL}
SELECT qid, id, CAST(rank AS BIGINT) AS rank, source, round(score, 6) AS score, round(relevance, 6) AS relevance, round(retention, 6) AS retention,
       latest, age_days > 30 AS stale, retention < 0.3 AS needs_update, CAST(age_days AS BIGINT) AS age_days, linked_from FROM recalled""")
def hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    r = recalled(spark, d)
    return r.select("qid", "id", F.col("rank").cast("long").alias("rank"), "source", r6("score").alias("score"), r6("relevance").alias("relevance"), r6("retention").alias("retention"), "latest", "stale", "needs_update", "age_days", F.array_join(F.transform("linked_from", lambda x: x.cast("string")), ",").alias("linked_from"))


@query(f"""{ALL}
SELECT qid, id, source, truncated AS body_truncated,
       CASE WHEN truncated THEN regexp_replace(substr(text, 1, 240), '\\s+$', '') || '…' ELSE text END AS body FROM (
  SELECT qid, id, source, text, NOT (nth = 1 OR (best > 0 AND round(relevance, 9) >= round(best * 0.99, 9)) OR length(text) <= 960) AS truncated FROM (
    SELECT r.*, d.text, row_number() OVER w AS nth, first_value(relevance) OVER w AS best FROM recalled r JOIN documents d ON d.doc_id = r.id
    WINDOW w AS (PARTITION BY qid ORDER BY r.source, rank)))""")
def hybrid_recall_snippets(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.with_texts(recalled(spark, d), A.memories(spark, d).select("id", "body"))
    return retrieval.snippets(r).select("qid", "id", "source", "body_truncated", "body")


@query(f"{ALL} SELECT id, 1706659200::BIGINT AS recalled_at, CAST(round(7.0 * 1.7, 6) AS DOUBLE) AS stability FROM recalled WHERE matched AND NOT retention < 0.3 GROUP BY id")
def recall_reinforcement(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.reinforcements(recalled(spark, d), A.memories(spark, d), A.NOW)
    return r.select("id", "recalled_at", r6("stability").alias("stability"))


@query("SELECT conv_id * 100 + turn AS id, conv_id * 100 + max(turn) OVER (PARTITION BY conv_id) AS tail FROM conversations")
def revision_tail(spark: SparkSession, d: str) -> DataFrame:
    return lineage.tails(A.turns(spark, d))


@query("SELECT conv_id * 100 + max(turn) AS id FROM conversations GROUP BY conv_id")
def latest_only(spark: SparkSession, d: str) -> DataFrame:
    t = A.turns(spark, d)
    return t.join(t.select(F.col("supersedes_id").alias("id")).filter("id is not null"), "id", "left_anti").select("id")


@query(f"WITH {WORD_TABLES}, {BM25}, {VECTORS}, {FUSED}, {CANDIDATES}, {FOLDED} SELECT qid, id, latest, matched, round(score, 6) AS score FROM folded")
def expand_fold(spark: SparkSession, d: str) -> DataFrame:
    records = A.memories(spark, d)
    tail_of = lineage.tails(records)
    fused = retrieval.fuse([vectors(spark, d), bm25(spark, d)])
    rows = retrieval.fold(retrieval.weighed(retrieval.expand_revisions(fused, tail_of, 3), records, tail_of, A.NOW))
    return rows.select("qid", "id", "latest", "matched", r6("score").alias("score"))


@query(f"""WITH {WORD_TABLES}, {BM25}, {VECTORS}, {FUSED}, {CANDIDATES}
SELECT qid, id, CAST(rank AS BIGINT) AS rank, latest, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 3""")
def history_mode(spark: SparkSession, d: str) -> DataFrame:
    r = recalled(spark, d, include_superseded=True).filter("source = 'direct'")
    return r.select("qid", "id", F.col("rank").cast("long").alias("rank"), "latest", r6("score").alias("score"))


_PAIRS = "p AS (SELECT doc_id AS id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents), n AS (SELECT id, other FROM p WHERE other IS NOT NULL UNION SELECT other, id FROM p WHERE other IS NOT NULL)"


@query(f"WITH {_PAIRS} SELECT id, other FROM n")
def links_onehop(spark: SparkSession, d: str) -> DataFrame:
    return lineage.neighbours(A.links(spark, d))


@query(f"{ALL} SELECT qid, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score, linked_from FROM recalled WHERE source = 'link'")
def link_supplement(spark: SparkSession, d: str) -> DataFrame:
    r = recalled(spark, d).filter("source = 'link'")
    return r.select("qid", "id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"), F.array_join(F.transform("linked_from", lambda x: x.cast("string")), ",").alias("linked_from"))


_TREE = """t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS label FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders),
crumbs AS (SELECT id, 0 AS depth, label AS path, label FROM t WHERE parent_id IS NULL
           UNION ALL SELECT t.id, depth + 1, path || ' / ' || t.label, t.label FROM t JOIN crumbs ON t.parent_id = crumbs.id)"""


@query(f"WITH RECURSIVE {_TREE} SELECT id, CAST(depth AS BIGINT) AS depth, path FROM crumbs")
def breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    return lineage.breadcrumbs(A.tree(spark, d)).select("id", F.col("depth").cast("long").alias("depth"), F.array_join("path", " / ").alias("path"))


@query(f"WITH RECURSIVE {_TREE} SELECT id, CAST(depth AS BIGINT) AS depth, repeat('  ', depth) || label AS line FROM crumbs")
def memory_tree(spark: SparkSession, d: str) -> DataFrame:
    return lineage.tree_lines(A.tree(spark, d)).select("id", F.col("depth").cast("long").alias("depth"), "line")


@query(f"""WITH RECURSIVE {_TREE}, up AS (SELECT id, parent_id AS above FROM t WHERE parent_id IS NOT NULL
UNION ALL SELECT up.id, t.parent_id FROM up JOIN t ON t.id = up.above WHERE t.parent_id IS NOT NULL)
SELECT t.id, CAST(count(up.id) AS BIGINT) AS below FROM t LEFT JOIN up ON up.above = t.id GROUP BY t.id""")
def subtree_counts(spark: SparkSession, d: str) -> DataFrame:
    return lineage.subtree_counts(A.tree(spark, d))


@query(f"""WITH {_PAIRS}, m AS (SELECT doc_id AS id, doc_id % 3 = 2 OR doc_id = (SELECT max(doc_id) FROM documents) AS latest, exp(-(doc_id % 90) / 7.0) AS r FROM documents)
SELECT m.id, latest, round(r, 6) AS retention, r < 0.3 AS needs_update, CAST(count(n.other) AS BIGINT) AS n_links FROM m LEFT JOIN n ON n.id = m.id GROUP BY m.id, latest, r""")
def memory_show(spark: SparkSession, d: str) -> DataFrame:
    s = lineage.shown(A.memories(spark, d), A.links(spark, d), A.NOW)
    return s.select("id", "latest", r6("retention").alias("retention"), "needs_update", F.size("links").cast("long").alias("n_links"))


_LOG = "e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tm FROM events WHERE event_type = 'purchase')"


@query(f"""WITH {_LOG} SELECT user_id, round(exp(-greatest((1706659200 - max(tm)) / 86400.0, 0.0) / 7.0), 6) AS retention,
exp(-greatest((1706659200 - max(tm)) / 86400.0, 0.0) / 7.0) < 0.3 AS needs_update FROM e GROUP BY user_id""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).groupBy("user_id").agg(F.min("at").alias("made"), F.max("at").alias("recalled"))
    kept = M.retention(F.lit(A.NOW), M.clock_origin(F.col("recalled"), F.col("made")), F.lit(7.0))
    return log.select("user_id", r6(kept).alias("retention"), M.needs_update(kept).alias("needs_update"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT doc_id AS id, doc_id % 90 > 30 AS stale, CAST(doc_id % 90 AS BIGINT) AS age_days FROM documents")
def stale_flags(spark: SparkSession, d: str) -> DataFrame:
    now, at = F.lit(A.NOW), F.col("updated_at")
    return A.memories(spark, d).select("id", M.stale(now, at).alias("stale"), M.age_days(now, at).alias("age_days"))


@query(f"""WITH RECURSIVE {_LOG}, o AS (SELECT user_id, tm, row_number() OVER (PARTITION BY user_id ORDER BY tm) AS i FROM e),
f AS (SELECT user_id, i, tm AS recalled_at, CAST(7.0 AS DOUBLE) AS stability, CAST(0 AS BIGINT) AS recalls FROM o WHERE i = 1
      UNION ALL SELECT o.user_id, o.i,
        CASE WHEN exp(-greatest((o.tm - f.recalled_at) / 86400.0, 0.0) / greatest(f.stability, 0.1)) >= 0.3 THEN o.tm ELSE f.recalled_at END,
        CASE WHEN exp(-greatest((o.tm - f.recalled_at) / 86400.0, 0.0) / greatest(f.stability, 0.1)) >= 0.3 THEN greatest(f.stability, 7.0) * 1.7 ELSE f.stability END,
        f.recalls + CASE WHEN exp(-greatest((o.tm - f.recalled_at) / 86400.0, 0.0) / greatest(f.stability, 0.1)) >= 0.3 THEN 1 ELSE 0 END
      FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, round(log10(stability), 6) AS log_stability, recalled_at, recalls FROM f QUALIFY i = max(i) OVER (PARTITION BY user_id)""")
def reinforce_fold(spark: SparkSession, d: str) -> DataFrame:
    r = reinforce.folded(_log(spark, d), "user_id", "at")
    return r.select("user_id", r6(F.log10("stability")).alias("log_stability"), "recalled_at", "recalls")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS begins, CAST(floor(epoch(max(ts))) AS BIGINT) AS ends, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, run""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    b = watch.bursts(table(spark, d, "events"), "user_id", "ts", 6 * 3600)
    return b.select("user_id", F.unix_timestamp(F.col("begins").cast("timestamp")).alias("begins"), F.unix_timestamp(F.col("ends").cast("timestamp")).alias("ends"), "n")


@query("""WITH q AS (SELECT item_id AS qid, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: length(w) > 2) AS ws FROM benchmark),
h AS (SELECT qid, doc_id AS id, CAST(len(list_filter(ws, lambda w: contains(lower(text), w))) AS BIGINT) AS hits FROM q, documents)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) AS rank FROM h WHERE hits > 0) WHERE rank <= 5""")
def grep_baseline(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.long_words("text").alias("words"))
    ranked = retrieval.word_overlap_rank(asked, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 5)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT count(*) AS memories, count(*) FILTER (WHERE doc_id % 3 = 2 OR doc_id = mx) AS latest, count(*) FILTER (WHERE doc_id % 90 > 30) AS stale,
count(*) FILTER (WHERE exp(-(doc_id % 90) / 7.0) < 0.3) AS needs_update FROM documents, (SELECT max(doc_id) AS mx FROM documents)""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    s = lineage.shown(A.memories(spark, d), A.links(spark, d), A.NOW)
    return s.agg(F.count("*").alias("memories"), F.count_if("latest").alias("latest"), F.count_if(M.stale(F.lit(A.NOW), F.col("updated_at"))).alias("stale"), F.count_if("needs_update").alias("needs_update"))


@query()
def stemmed_terms(spark: SparkSession, d: str) -> DataFrame:
    """Query terms with their English stems, which SQL here has no function for."""
    from tessera.functions.stem import with_stems

    return table(spark, d, "benchmark").select("item_id", F.array_join(with_stems(T.query_terms("text")), " ").alias("terms"))


@query()
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The lexical path with English stems in index and query, as recall has it; SQL has no function for stems."""
    return _ranked(retrieval.bm25_hits(_documents(spark, d, True), _questions(spark, d, True)))


@query(f"""{ALL}
SELECT qid, id, recalled.source, CAST(rank AS BIGINT) AS rank, substr(split_part(text, chr(10), 1), 1, 80) AS summary, round(score, 2) AS score, round(retention, 2) AS retention, latest,
CASE WHEN linked_from <> '' THEN linked_from END AS linked_from FROM recalled JOIN documents d ON d.doc_id = recalled.id""")
def recall_public(spark: SparkSession, d: str) -> DataFrame:
    """What a caller sees of recalled rows."""
    rows = retrieval.public_rows(retrieval.with_texts(recalled(spark, d), A.memories(spark, d).select("id", "summary", "body")))
    return rows.select("qid", "id", "source", F.col("rank").cast("long").alias("rank"), "summary", "score", "retention", "latest", F.array_join(F.transform("linked_from", lambda x: x.cast("string")), ",").alias("linked_from"))


@query("""SELECT conv_id * 100 + turn AS qid, CASE WHEN regexp_full_match(text, '\\s*') THEN 'blank' ELSE 'script' END AS error
FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' WHEN turn % 7 = 3 THEN 'при ' || text ELSE text END AS text FROM conversations)
WHERE regexp_full_match(text, '\\s*') OR regexp_matches(text, '[^\\p{Latin}\\p{Common}\\P{L}]')""")
def query_errors(spark: SparkSession, d: str) -> DataFrame:
    """Queries that recall refuses: turns, some made blank, some with letters of another script."""
    text = F.when(F.col("turn") % 5 == 4, " ").when(F.col("turn") % 7 == 3, F.concat(F.lit("при "), F.col("text"))).otherwise(F.col("text"))
    return retrieval.query_errors(table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), text.alias("text")))


@query("""WITH w AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM w)
SELECT id, CASE WHEN label % 2 = 0 THEN 'kept' ELSE 'hash' END AS embedding_model, CASE WHEN label % 2 = 0 THEN 'as it was' ELSE 'anew' END AS vector FROM n""")
def reembedded(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of another model are made anew from the text; those of the wanted one stay."""
    v = table(spark, d, "embeddings").withColumn("wanted", F.col("label") % 2 == 0)
    records = v.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.when(F.col("wanted"), "kept").otherwise("other").alias("embedding_model"), F.concat(F.lit("word"), F.col("vec_id").cast("string")).alias("body"))
    fresh = retrieval.reembedded(records, "kept", F.col("body")).withColumnRenamed("vector", "now").withColumnRenamed("embedding_model", "model")
    met = fresh.join(records.select("id", "vector"), "id")
    return met.select("id", F.when(F.col("now") == F.col("vector"), "kept").otherwise("hash").alias("embedding_model"), F.when(F.col("now") == F.col("vector"), "as it was").otherwise("anew").alias("vector"))
