"""Queries of the evaluation: ranking metrics, percentiles, scenario scores, fusion, banks, judges, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lineage, metrics, retrieval, scan
from tessera.plans import retrieval_queries as R
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import BM25, FUSED, VECTORS, WORD_TABLES, r6
from tessera.sources import adapters as A
from tessera.sources.tables import table

_GOLD = "gold AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_PER = f"""{_GOLD}, per AS (SELECT g.qid, count(*) AS n_gold, min(rank) AS first_rank, count(*) FILTER (WHERE rank <= 1) AS hits_1, count(*) FILTER (WHERE rank <= 5) AS hits_5, count(*) FILTER (WHERE rank <= 10) AS hits_10
FROM gold g LEFT JOIN bm USING (qid, id) GROUP BY g.qid)"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("needle"))
    return scan.containing(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), items)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_query(R.bm25(spark, d), gold(spark, d))


@query(f"""WITH {WORD_TABLES}, {BM25}, {_PER} SELECT qid, n_gold, CAST(first_rank AS BIGINT) AS first_rank, hits_1, hits_5, hits_10 FROM per""")
def recall_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("first_rank", F.col("first_rank").cast("long"))


@query(f"""WITH {WORD_TABLES}, {BM25}, {_PER} SELECT count(*) AS n, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr,
{", ".join(f"round(avg(hits_{c} / {c}.0), 6) AS precision_{c}, round(avg(hits_{c} / n_gold), 6) AS recall_{c}, round(avg(CAST(hits_{c} > 0 AS INTEGER)), 6) AS hit_{c}" for c in metrics.CUTOFFS)} FROM per""")
def mrr_hit_recall(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.summary(_scores(spark, d))
    return s.select("n", *[r6(c).alias(c) for c in s.columns if c != "n"])


@query(f"""WITH {WORD_TABLES}, {BM25}, {_PER}, typed AS (SELECT per.*, (SELECT min(lang) FROM gold g JOIN documents d ON d.doc_id = g.id WHERE g.qid = per.qid) AS type FROM per)
SELECT coalesce(type, '(all)') AS type, count(*) AS n, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, round(avg(hits_5 / n_gold), 6) AS recall_5, round(avg(CAST(hits_5 > 0 AS INTEGER)), 6) AS hit_5 FROM typed GROUP BY ROLLUP (type)""")
def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    langs = gold(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").groupBy("qid").agg(F.min("lang").alias("type"))
    s = metrics.summary(_scores(spark, d).join(langs, "qid"), "type")
    return s.select(F.coalesce("type", F.lit("(all)")).alias("type"), "n", r6("mrr").alias("mrr"), r6("recall_5").alias("recall_5"), r6("hit_5").alias("hit_5"))


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, round(v[least(n - 1, round_even(0.5 * (n - 1), 0)::INT) + 1], 6) AS p50, round(v[least(n - 1, round_even(0.95 * (n - 1), 0)::INT) + 1], 6) AS p95, round(v[n // 2 + 1], 6) AS upper_median,
round(list_median(v), 6) AS median,
round(v[greatest(1, least(n - 1, floor(0.9 * (n + 1))::INT))] + (0.9 * (n + 1) - greatest(1, least(n - 1, floor(0.9 * (n + 1))::INT))) * (v[greatest(1, least(n - 1, floor(0.9 * (n + 1))::INT)) + 1] - v[greatest(1, least(n - 1, floor(0.9 * (n + 1))::INT))]), 6) AS p90 FROM v""")
def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Latency-style summaries."""
    e = metrics.quantiles(table(spark, d, "events"), "event_type", "value")
    return e.select("event_type", *[r6(c).alias(c) for c in ("p50", "p95", "upper_median", "median", "p90")])


_CATEGORY = "CASE lang WHEN 'en' THEN 'Completion' WHEN 'fr' THEN 'BugFix' WHEN 'de' THEN 'Config' ELSE 'Unweighted' END"


@query(f"""WITH s AS (SELECT {_CATEGORY} AS category, CAST(quality AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
c AS (SELECT category, avg(score) AS mean, sum(score) AS total, count(*) AS n, CASE category WHEN 'Completion' THEN 0.28 WHEN 'BugFix' THEN 0.18 WHEN 'Config' THEN 0.04 ELSE 0 END AS w FROM s GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 6) AS raw, round(sum(mean * w) / sum(w), 6) AS weighted FROM c""")
def weighted_category(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("lang") == "en", "Completion").when(F.col("lang") == "fr", "BugFix").when(F.col("lang") == "de", "Config").otherwise("Unweighted")
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(category.alias("category"), F.col("quality").cast("double").alias("score"))
    w = metrics.weighted_accuracy(s)
    return w.select("n", r6("raw").alias("raw"), r6("weighted").alias("weighted"))


@query(f"""WITH {WORD_TABLES}, {BM25}, {_GOLD}, e AS (SELECT qid, list_sort(list(id)) AS expected FROM gold GROUP BY qid), r AS (SELECT qid, list(id ORDER BY rank) AS returned FROM bm GROUP BY qid),
j AS (SELECT qid, expected, coalesce(returned, []) AS returned, len(list_intersect(expected, coalesce(returned, []))) AS common FROM e LEFT JOIN r USING (qid))
SELECT qid, CAST(coalesce(returned[1] = expected[1], false) AS INTEGER)::DOUBLE AS exact_symbol, CAST(list_contains(returned[1:5], expected[1]) AS INTEGER)::DOUBLE AS in_top_k,
round(CASE WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (len(expected) + len(returned)) END, 6)::DOUBLE AS exact_set, round(common / len(expected), 6) AS contains FROM j""")
def exact_set_f1(spark: SparkSession, d: str) -> DataFrame:
    expected = gold(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("expected"))
    returned = R.bm25(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r")).select("qid", F.transform("r", lambda x: x["id"]).alias("returned"))
    j = expected.join(returned, "qid", "left").withColumn("returned", F.coalesce("returned", F.array().cast("array<bigint>")))
    kinds = ("exact_symbol", "in_top_k", "exact_set", "contains")
    return j.select("qid", *[r6(metrics.scenario_score(F.lit(k), F.col("expected"), F.col("returned"), F.lit(None).cast("int"))).alias(k) for k in kinds])


_GREP = "grep AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) AS rank FROM (SELECT item_id AS qid, doc_id AS id, len(list_filter(list_filter(string_split_regex(lower(b.text), '[^a-z0-9_]+'), lambda w: length(w) > 2), lambda w: contains(lower(d.text), w))) AS hits FROM benchmark b, documents d) WHERE hits > 0 QUALIFY rank <= 20)"


@query(f"""WITH {WORD_TABLES}, {BM25}, {VECTORS}, {_GREP}, {_GOLD}, hits AS (SELECT qid, id, rank, 1 AS bit FROM vec UNION ALL SELECT qid, id, rank, 2 FROM bm UNION ALL SELECT qid, id, rank, 4 FROM grep),
m AS (SELECT unnest(range(1, 8)) AS mask), f AS (SELECT mask, qid, id, sum(1.0 / (60 + rank)) AS score FROM m JOIN hits ON (mask & bit) > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY mask, qid ORDER BY round(score, 9) DESC, id) AS rank FROM f QUALIFY rank <= 20),
p AS (SELECT m.mask, g.qid, coalesce(1.0 / min(r.rank), 0) AS rr, count(r.rank) / count(*) AS recall FROM m CROSS JOIN gold g LEFT JOIN r ON r.mask = m.mask AND r.qid = g.qid AND r.id = g.id GROUP BY 1, 2)
SELECT array_to_string(list_filter([CASE WHEN mask & 1 > 0 THEN 'vector' END, CASE WHEN mask & 2 > 0 THEN 'bm25' END, CASE WHEN mask & 4 > 0 THEN 'grep' END], lambda x: x IS NOT NULL), '+') AS combination, round(avg(rr), 6) AS mrr, round(avg(recall), 6) AS recall FROM p GROUP BY mask""")
def rank_fusion_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    board = metrics.fusion_leaderboard({"vector": R.vectors(spark, d), "bm25": R.bm25(spark, d), "grep": _grep(spark, d)}, gold(spark, d))
    return board.select("combination", r6("mrr").alias("mrr"), r6("recall").alias("recall"))


def _grep(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.long_words("text").alias("words"))
    return retrieval.word_overlap_rank(asked, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 20)


@query(f"""WITH {WORD_TABLES}, {BM25}, {VECTORS}, {_GOLD}, f AS (SELECT qid, id, EXISTS (SELECT 1 FROM vec v WHERE v.qid = g.qid AND v.id = g.id) AS v, EXISTS (SELECT 1 FROM bm b WHERE b.qid = g.qid AND b.id = g.id) AS b FROM gold g)
SELECT CASE WHEN v AND b THEN 'vector & bm25' WHEN v THEN 'vector' WHEN b THEN 'bm25' ELSE '(none)' END AS found_by, count(*) AS n FROM f GROUP BY 1""")
def overlap_hist(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d)
    for name, hits in (("vector", R.vectors(spark, d)), ("bm25", R.bm25(spark, d))):
        g = g.join(hits.select("qid", "id", F.lit(True).alias(name)), ["qid", "id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return metrics.overlap_histogram(g, ["vector", "bm25"])


@query("""WITH r AS (SELECT doc_id, lang, CASE WHEN quality = 1 AND toxic = 1 THEN ['quality', 'toxic'] WHEN quality = 1 THEN ['quality'] WHEN toxic = 1 THEN ['toxic'] ELSE ['(none)'] END AS s, n_chars FROM labels JOIN documents USING (doc_id)),
e AS (SELECT unnest(s) AS slice, n_chars, lang FROM r) SELECT slice, count(*) AS n, round(avg(n_chars), 6) AS chars, round(avg(CAST(lang = 'en' AS INTEGER)), 6) AS english FROM e GROUP BY slice""")
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    rows = rows.withColumn("signals", F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))))
    s = metrics.slices(rows, "signals", {"chars": F.col("n_chars"), "english": (F.col("lang") == "en")})
    return s.select("slice", "n", r6("chars").alias("chars"), r6("english").alias("english"))


@query(f"""WITH {WORD_TABLES}, {BM25}, {_GOLD}, tails AS (SELECT doc_id AS id, max(doc_id) OVER (PARTITION BY doc_id // 3) AS tail FROM documents),
t AS (SELECT qid, id, rank, id % 2 = 0 AS latest FROM bm WHERE rank <= 5), w AS (SELECT qid, tail AS id FROM gold JOIN tails USING (id)),
n AS (SELECT w.qid, count(t.id) / count(*) AS newest_recall FROM w LEFT JOIN t USING (qid, id) GROUP BY w.qid),
s AS (SELECT qid, count(*) AS stale_latest FROM t WHERE latest AND id NOT IN (SELECT tail FROM tails) GROUP BY qid)
SELECT qid, round(newest_recall, 6) AS newest_recall, coalesce(stale_latest, 0) AS stale_latest FROM n LEFT JOIN s USING (qid)""")
def lineage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Even ids are claimed to be the latest revision, which is wrong for some."""
    tail_of = lineage.tails(A.memories(spark, d))
    ranked = R.bm25(spark, d).withColumn("latest", F.pmod("id", F.lit(2)) == 0)
    return metrics.lineage_scores(ranked, gold(spark, d), tail_of, 5).withColumn("newest_recall", r6("newest_recall"))


@query(f"""WITH {WORD_TABLES}, {BM25}, k AS (SELECT qid, source, min(rank) AS best FROM bm JOIN documents d ON d.doc_id = bm.id GROUP BY ALL)
SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY best) AS rank FROM k""")
def session_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Hits mapped to their source, each source at its first place."""
    hits = R.bm25(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return metrics.first_seen(hits, "source").withColumn("rank", F.col("rank").cast("long"))


_CONTENT = "list_filter(string_split_regex(lower({}), '[^a-z0-9'']+'), lambda w: length(w) > 2)"
_BANK = f"""p AS (SELECT item_id AS point, {_CONTENT.format("text")} AS ws, item_id % 4 = 3 AS noise FROM benchmark), m AS (SELECT doc_id AS id, {_CONTENT.format("text")} AS ws FROM documents),
c AS (SELECT point, noise, id, len(list_filter(p.ws, lambda w: list_contains(m.ws, w))) / len(p.ws) AS cov FROM p, m WHERE len(p.ws) > 0)"""


@query(f"WITH {_BANK} SELECT point, min_by(id, id) AS id, round(max(cov), 6) AS coverage FROM (SELECT *, max(cov) OVER (PARTITION BY point) AS best FROM c WHERE cov >= 0.55) WHERE cov = best GROUP BY point")
def best_memory(spark: SparkSession, d: str) -> DataFrame:
    points, memories = _bank(spark, d)
    return metrics.best_match(points, memories, 0.55).withColumn("coverage", r6("coverage"))


def _bank(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, d, "benchmark").select(F.col("item_id").alias("point"), T.content_words("text").alias("words"), (F.pmod("item_id", F.lit(4)) == 3).alias("interference"))
    memories = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), T.content_words("text").alias("words"))
    return points, memories


@query(f"""WITH {_BANK}, b AS (SELECT p.point, p.noise, bool_or(coalesce(cov >= 0.55, false)) AS found FROM p LEFT JOIN c USING (point) GROUP BY 1, 2),
x AS (SELECT count(*) FILTER (WHERE NOT noise) AS target_points, count(*) FILTER (WHERE NOT noise AND found) AS covered, count(*) FILTER (WHERE noise) AS noise, count(*) FILTER (WHERE noise AND NOT found) AS resisted FROM b),
y AS (SELECT count(DISTINCT id) AS precise FROM c WHERE NOT noise AND cov >= 0.55), z AS (SELECT count(*) AS memories FROM m)
SELECT target_points, covered, noise, resisted, precise, memories, round(covered / target_points, 6) AS recall, round(precise / memories, 6) AS precision,
round(CASE WHEN covered + precise = 0 THEN 0 ELSE 2 * (covered / target_points) * (precise / memories) / (covered / target_points + precise / memories) END, 6) AS f1, round(resisted / noise, 6) AS resistance FROM x, y, z""")
def bank_score(spark: SparkSession, d: str) -> DataFrame:
    b = metrics.bank_score(*_bank(spark, d))
    return b.select("target_points", "covered", "noise", "resisted", "precise", "memories", *[r6(c).alias(c) for c in ("recall", "precision", "f1", "resistance")])


_JUDGE = """j AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'integrity' WHEN 1 THEN 'accuracy' WHEN 2 THEN 'update' ELSE 'qa' END AS part, CASE WHEN doc_id % 9 <> 0 THEN quality + toxic END AS score,
CAST(1 + doc_id % 3 AS DOUBLE) AS importance, doc_id % 8 >= 4 AS flag, CASE doc_id % 5 WHEN 0 THEN 'Correct' WHEN 1 THEN 'Hallucination' WHEN 2 THEN 'Omission' WHEN 3 THEN 'Correct' END AS label FROM labels)"""


@query(f"""WITH {_JUDGE}, r AS (SELECT
count(*) FILTER (WHERE part = 'integrity' AND NOT flag AND score = 2) / count(*) FILTER (WHERE part = 'integrity' AND NOT flag) AS recall,
coalesce(sum(0.5 * score * importance) FILTER (WHERE part = 'integrity' AND NOT flag), 0) / sum(importance) FILTER (WHERE part = 'integrity' AND NOT flag) AS weighted_recall,
coalesce(sum(0.5 * score) FILTER (WHERE part = 'accuracy' AND flag), 0) / count(*) FILTER (WHERE part = 'accuracy' AND flag) AS target_accuracy,
count(*) FILTER (WHERE part = 'integrity' AND flag AND score = 0) / count(*) FILTER (WHERE part = 'integrity' AND flag) AS resistance,
{", ".join(f"count(*) FILTER (WHERE part = '{p}' AND label = '{lb}') / count(*) FILTER (WHERE part = '{p}') AS {p}_{lb.lower()}" for p in ("update", "qa") for lb in ("Correct", "Hallucination", "Omission"))} FROM j)
SELECT round(recall, 6) AS recall, round(weighted_recall, 6)::DOUBLE AS weighted_recall, round(target_accuracy, 6)::DOUBLE AS target_accuracy, round(resistance, 6) AS resistance,
{", ".join(f"round({p}_{lb}, 6) AS {p}_{lb}" for p in ("update", "qa") for lb in ("correct", "hallucination", "omission"))},
round(CASE WHEN recall + target_accuracy > 0 THEN 2 * recall * target_accuracy / (recall + target_accuracy) END, 6) AS f1 FROM r""")
def judge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    part = F.when(i % 4 == 0, "integrity").when(i % 4 == 1, "accuracy").when(i % 4 == 2, "update").otherwise("qa")
    label = F.when(i % 5 == 1, "Hallucination").when(i % 5 == 2, "Omission").when(i % 5 != 4, "Correct")
    rows = table(spark, d, "labels").select(part.alias("part"), F.when(i % 9 != 0, F.col("quality") + F.col("toxic")).alias("score"), (1 + i % 3).cast("double").alias("importance"), (i % 8 >= 4).alias("flag"), label.alias("label"))
    j = metrics.judged(rows)
    return j.select(*[r6(c).alias(c) for c in j.columns])


@query("""WITH m AS (SELECT lang AS case_id, doc_id AS id, lower(text) AS text FROM documents), f AS (SELECT DISTINCT lang AS case_id, unnest(['password', 'token', 'the', 'que']) AS fact FROM documents),
h AS (SELECT case_id, fact, id FROM f JOIN m USING (case_id) WHERE contains(text, fact)), a AS (SELECT case_id, fact, min(n) = 1 AS alone FROM (SELECT *, count(*) OVER (PARTITION BY case_id, id) AS n FROM h) GROUP BY 1, 2),
per AS (SELECT case_id, count(*) AS facts, count(alone) AS covered, count(*) FILTER (WHERE alone) AS exclusive FROM f LEFT JOIN a USING (case_id, fact) GROUP BY 1),
l AS (SELECT doc_id AS id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents),
ok AS (SELECT DISTINCT x.case_id FROM h x JOIN h y ON x.case_id = y.case_id AND x.fact = 'password' AND y.fact = 'token' WHERE x.id = y.id OR EXISTS (SELECT 1 FROM l WHERE l.id = x.id AND l.other = y.id))
SELECT per.*, CAST(CASE WHEN ok.case_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS link_hits, CAST(1 AS BIGINT) AS link_total, z.memories, z.mean_chars, z.max_chars
FROM per LEFT JOIN ok USING (case_id) JOIN (SELECT case_id, count(*) AS memories, CAST(round_even(avg(length(text)), 0) AS BIGINT) AS mean_chars, CAST(max(length(text)) AS BIGINT) AS max_chars FROM m GROUP BY 1) z USING (case_id)""")
def write_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    memories = docs.select(F.col("lang").alias("case_id"), F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    facts = docs.select(F.col("lang").alias("case_id")).distinct().withColumn("fact", F.explode(F.array(*[F.lit(x) for x in ("password", "token", "the", "que")]))).withColumn("must", F.array("fact"))
    stored = A.links(spark, d).select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    pairs = facts.filter("fact = 'password'").select("case_id", "fact", F.lit("token").alias("other"))
    return metrics.write_quality(memories, facts, stored, pairs)


@query(f"""WITH {WORD_TABLES}, {BM25}, t AS (SELECT qid, bm.id, rank, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens FROM bm JOIN documents d ON d.doc_id = bm.id)
SELECT qid, id, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM t) WHERE used <= 8000""")
def budgeted_context(spark: SparkSession, d: str) -> DataFrame:
    hits = R.bm25(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.token_estimate("text").alias("tokens")), "id")
    return metrics.budgeted(hits, 8000).select("qid", "id", "used")


@query("""WITH r AS (SELECT role AS arm, CAST((strlen(text) + 3) // 4 AS BIGINT) AS t FROM conversations), p AS (SELECT arm, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens FROM r GROUP BY arm)
SELECT arm, n, tokens, round(tokens / (SELECT tokens FROM p WHERE arm = 'user') - 1, 6) AS change FROM p""")
def payload_arms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("role").alias("arm"), "text")
    return metrics.payload_arms(rows, "user").withColumn("change", r6("change"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both_ok, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_base, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_this, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS neither FROM labels")
def paired_arms(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paired(table(spark, d, "labels").select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("base_ok"), (F.col("toxic") == 1).alias("this_ok")))


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS nth FROM conversations) WHERE role = 'system' OR nth <= 3""")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recent_turns(table(spark, d, "conversations"), 3).select("conv_id", "turn")


@query(f"""WITH {WORD_TABLES}, {BM25}, {VECTORS}, {FUSED}, {_GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(relevance, 9) DESC, id) AS rank FROM fused),
p AS (SELECT g.qid, min(rank) AS first_rank, count(*) AS n_gold, count(*) FILTER (WHERE rank <= 5) AS h FROM gold g LEFT JOIN r USING (qid, id) GROUP BY 1)
SELECT count(*) AS n, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, round(avg(h / n_gold), 6) AS recall_5 FROM p""")
def hybrid_quality(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.top(retrieval.fuse([R.vectors(spark, d), R.bm25(spark, d)]), 1 << 30, "relevance")
    s = metrics.summary(metrics.per_query(ranked, gold(spark, d)))
    return s.select("n", r6("mrr").alias("mrr"), r6("recall_5").alias("recall_5"))
