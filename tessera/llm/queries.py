"""The thin queries over the training-data operators: op1_ .. op10_ and pipeline. Each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import format_conversations

    return format_conversations(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.runtime import crc_mod
    from tessera.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) == 2)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_search import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.one_bit_search import approximate_top_k

    return approximate_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_model import deleted_interpolation
    from tessera.llm.runtime import crc_mod

    return deleted_interpolation(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_id import document_evidence, identify

    return identify(document_evidence(table(spark, sf_dir, "documents")), "doc_id")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 again, over pages, where all evidence occurs: markup, address suffix, domain and host."""
    from tessera.llm.language_id import identify, page_evidence

    return identify(page_evidence(table(spark, sf_dir, "pages")), "page_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.byte_bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.conversation_repair import damaged, repair

    given = table(spark, sf_dir, "conversations")
    ids, fixed = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), repair(damaged(given))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")]
    return ids.alias("i").join(fixed.alias("f"), F.expr("i.conv_id <=> f.conv_id"), "left").select("i.conv_id", *numbers, *texts)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_toxicity": op3_toxicity,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_mixing": op5_mixing,
        "op6_one_bit_search": op6_one_bit_search,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_language_id": op8_language_id,
        "pages_language_id": pages_language_id,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_token_alignment": op12_token_alignment,
        "op13_quality_rules": op13_quality_rules,
        "pipeline": pipeline,
    }


_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs)),
firsts AS (SELECT k, min(doc_id) AS origin FROM windows GROUP BY k),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (k) WHERE origin < doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""

EXACT_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}')")} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, c = m.n AND c = o.n AS same FROM common JOIN sizes m ON m.doc_id = a JOIN sizes o ON o.doc_id = b WHERE c >= 0.8 * (m.n + o.n - c)),
both_ways AS (SELECT a, b, same FROM links UNION ALL SELECT b, a, same FROM links),
reached(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reached r JOIN both_ways t ON r.b = t.a),
classes AS (SELECT a AS doc_id, min(b) AS least FROM reached GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE same) AS n_copies FROM both_ways GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(classes.least, doc_id)) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 0) AS BIGINT) AS n_copies
FROM docs LEFT JOIN classes USING (doc_id) LEFT JOIN counts USING (doc_id)"""


#: The grammar as a machine: 0 begin, 1 after the system turn, 2 after a user's, 3 after an assistant's.
CONVERSATION_REPAIR = """
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
faulty AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1)))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20 AS f FROM given),
rows AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM faulty),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
seen AS (SELECT *, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM placed),
flagged AS (SELECT *, final = '' AS blank, final <> '' AND again AS duplicate, final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS cut FROM seen),
inserts(st, mid, ins) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
moves(mid, initial, nxt, edit, price) AS (VALUES (0, NULL, 0, 'D', 4), (1, NULL, 1, 'D', 4), (2, NULL, 2, 'D', 4), (3, NULL, 3, 'D', 4), (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (3, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (0, NULL, 2, 'R', 3), (1, NULL, 2, 'R', 3), (3, NULL, 2, 'R', 3), (2, NULL, 3, 'R', 3)),
parse(conv_id, i, st, best) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': ''} FROM flagged
    UNION ALL
    SELECT p.conv_id, r.i, m.nxt, min({'cost': CAST(p.best.cost + 3 * length(n.ins) + m.price + CASE WHEN r.cut AND m.edit <> 'D' THEN 3 ELSE 0 END AS BIGINT), 'audit': p.best.audit || n.ins || m.edit})
    FROM parse p JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN inserts n ON n.st = p.st
    JOIN moves m ON m.mid = n.mid AND (m.edit = 'D' OR NOT r.blank AND NOT r.duplicate AND (m.edit = 'R' OR m.initial = r.initial)) GROUP BY ALL),
lengths AS (SELECT conv_id, max(i) AS n FROM flagged GROUP BY conv_id),
solved AS (SELECT p.conv_id, min({'cost': p.best.cost + 3 * length(e.ins), 'audit': p.best.audit || e.ins}) AS best FROM parse p JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.i
           JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) e(st, ins) ON e.st = p.st GROUP BY p.conv_id),
edits AS (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS j FROM solved),
numbered AS (SELECT conv_id, j, audit[j] AS edit, length(replace(audit[:j], 'I', '')) AS i, length(replace(audit[:j], 'D', '')) AS k, length(replace(audit, 'D', '')) % 2 AS odd FROM edits),
messages AS (SELECT n.conv_id, n.k, CASE WHEN edit = 'K' THEN role WHEN (k - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
             FROM numbered n LEFT JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.i AND n.edit <> 'I' WHERE edit <> 'D'),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM messages GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
           count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""


def _quality_sql() -> str:
    """Operator 13 with the module's own constants. Distances: half of the parts' sum, its root."""
    from tessera.llm import quality as q

    part = lambda p, r: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {r})) ELSE 0 END + CASE WHEN {r} > 0 THEN {r} * log2(2 * {r} / ({p} + {r})) ELSE 0 END"
    left = ["t"]
    for c in q.CLASSES:
        left.append(f"regexp_replace({left[-1]}, '{c.replace("'", "''")}', '', 'g')")
    counts = ", ".join([f"length({a}) - length({b}) AS c{i}" for i, (a, b) in enumerate(zip(left, left[1:], strict=False))] + [f"length({left[-1]}) AS c{len(q.CLASSES)}"])
    cs = [f"c{i}" for i in range(len(q.CLASSES) + 1)]
    n, limit = len(cs), lambda x: f"{x[0]} + {x[1]} / sqrt(n_words)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
chars AS (SELECT id, lang, {counts} FROM docs),
char_refs AS (SELECT lang, {", ".join(f"sum({c}) / ({' + '.join(f'sum({x})' for x in cs)}) AS q{i}" for i, c in enumerate(cs))} FROM (SELECT lang AS l, CASE WHEN u.a THEN NULL ELSE lang END AS lang, {", ".join(cs)}, u.a FROM chars, (VALUES (true), (false)) u(a)) WHERE a OR l IS NOT NULL GROUP BY lang),
words AS (SELECT id, lang, unnest(ws) AS w FROM docs),
tallies AS (SELECT CASE WHEN u.a THEN NULL ELSE lang END AS lang, w, sum(n) AS n FROM (SELECT lang, w, count(*) AS n FROM words GROUP BY ALL), (VALUES (true), (false)) u(a) WHERE u.a OR lang IS NOT NULL GROUP BY 1, 2),
word_refs AS (SELECT lang, w, n / total AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM tallies) WHERE n / total >= {q.COMMON} AND (lang IS NULL OR total >= {q.REFERENCE_WORDS})),
held AS (SELECT id, len(ws) AS n, CASE WHEN lang IN (SELECT lang FROM word_refs WHERE lang IS NOT NULL) THEN lang END AS ref FROM docs),
found AS (SELECT held.id, n, q, count(*) / n AS p FROM held JOIN words USING (id) JOIN word_refs r ON r.lang IS NOT DISTINCT FROM held.ref AND r.w = words.w GROUP BY held.id, n, r.w, q),
sums AS (SELECT id, sum({part("p", "q")}) AS twice, sum(p) AS ps, sum(q) AS qs FROM found GROUP BY id),
all_q AS (SELECT lang, sum(q) AS a FROM word_refs GROUP BY lang),
far AS (SELECT held.id, round(sqrt(greatest(0, (coalesce(twice, 0) + greatest(0, a - coalesce(qs, 0)) + {part("(1 - coalesce(ps, 0))", "greatest(0, 1 - a)")}) / 2)), 9) AS word_distance
        FROM held LEFT JOIN sums USING (id) JOIN all_q ON all_q.lang IS NOT DISTINCT FROM held.ref WHERE n > 0),
near AS (SELECT id, CASE WHEN s > 0 THEN round(sqrt(greatest(0, ({" + ".join(part(f"(c{i} / s)", f"q{i}") for i in range(n))}) / 2)), 9) END AS char_distance
         FROM (SELECT *, {" + ".join(cs)} AS s FROM chars) c JOIN held USING (id) JOIN char_refs r ON r.lang IS NOT DISTINCT FROM held.ref),
windows AS (SELECT id, i, array_to_string(ws[i:i + {q.WINDOW - 1}], ' ') AS k FROM (SELECT id, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM docs)),
repeated AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + {q.WINDOW})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY id, k) AS c FROM windows) WHERE c > 1) GROUP BY id),
measured AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{q.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
           CAST(coalesce(len(ls) - len(list_distinct(ls)), 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, char_distance, word_distance
    FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{q.SPACE}]')) AS ls FROM docs) LEFT JOIN near USING (id) LEFT JOIN far USING (id) LEFT JOIN repeated USING (id)),
failed AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {round(100 * q.MAX_REPEATED)} * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND NOT coalesce(n_words >= {q.JUDGED_WORDS} AND (char_distance > {limit(q.CHAR_LIMIT)} OR word_distance > {limit(q.WORD_LIMIT)}), false) AS kept FROM failed"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say: windows of words, integer inner products, shingle similarity with its components. The rest
    (random rounding, trained models, approximate search, byte pairs, pattern cuts) is tested against brute force."""
    sql = {"op1_substring_dedup": SUBSTRING_DEDUP, "op4_exact_top_k": EXACT_TOP_K, "op10_jaccard_join": JACCARD_JOIN, "op11_conversation_repair": CONVERSATION_REPAIR, "op13_quality_rules": _quality_sql()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
