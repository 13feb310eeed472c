"""Hybrid retrieval over many queries at once: vectors, BM25, gates, rank fusion, revisions, links, snippets.

Queries are the small side: their terms and vectors are broadcast behind a count (BROADCAST_QUERIES) and joined by
shuffle beyond it; documents stream past them, so only postings of query terms are ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import memory as M
from tessera.functions import text as T
from tessera.operators import lineage, scan
from tessera.sources.shared import cut, small_batches

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BROADCAST_QUERIES = 10_000
#: Query terms that a plan holds itself; with more, postings are joined with them.
TERMS_AT_HAND = 20_000


def small(queries: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """queries with a broadcast hint where they are few, as they are where not."""
    return F.broadcast(queries) if queries.count() <= most else queries


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query, with their rank: score descending (to nine decimals), then id."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def gate(ranked: DataFrame, ratio: float, score: str = "score") -> DataFrame:
    """Rows within `ratio` of their query's best; where the best is not positive, the first row alone."""
    best = F.max(score).over(Window.partitionBy("qid"))
    keep = F.when(best > 0, F.round(F.col(score), 9) >= F.round(best * ratio, 9)).otherwise(F.col("rank") == 1)
    return ranked.withColumn("keep", keep).filter("keep").drop("keep")


#: Words whose dimension a worker remembers before it starts anew.
REMEMBERED = 200_000


def hash_vectors(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, vector): counts of hashed words in 64 dimensions; a text without words has zeros.

    Words are cut by the engine and counted where they are read, a slice of texts at a time; nothing is shuffled.
    """
    id_type = rows.schema[id_col].dataType
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in scan.slices(batches, "words"):
            if len(known) > REMEMBERED:
                known.clear()
            words = batch.column("words")
            flat = words.flatten().dictionary_encode()
            names = flat.dictionary.to_pylist()
            for w in names:
                if w not in known:
                    known[w] = hashlib.sha256(w.encode()).digest()[0] % M.DIMENSIONS
            of = np.array([known[w] for w in names], np.int64)
            row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
            counts = np.bincount(row * M.DIMENSIONS + of[flat.indices.to_numpy()], minlength=len(batch) * M.DIMENSIONS).astype(np.float64)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * M.DIMENSIONS, pa.int32()), pa.array(counts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors], names=["id", "vector"])

    return rows.select(F.col(id_col).alias("id"), T.split_words(text_col).alias("words")).mapInArrow(run, f"id {id_type.simpleString()}, vector array<double>")


def vector_hits(memories: DataFrame, queries: DataFrame, pool: int = M.POOL, ratio: float = M.VECTOR_GATE, drop_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): cosine of each query with every vector. memories: id, vector; queries: qid, vector.

    A stated query set against all rows: the rows pass by the queries in batches, and each batch's best are ranked.
    """
    return gate(top(scan.nearest(memories, queries, pool, drop_self), pool), ratio)


def bm25_hits(memories: DataFrame, queries: DataFrame, pool: int = M.POOL, ratio: float = M.LEXICAL_GATE) -> DataFrame:
    """(qid, id, score, rank) by BM25. memories: id, words (tokens in order); queries: qid, words (distinct terms; one
    with blanks is a phrase, whose tokens must follow one another).

    The postings kept are those of query terms only; each document's length and terms are taken in one pass. A token
    COLUMN_END is the border of two columns: it has no length, and no phrase crosses it.
    """
    asked = queries.select("qid", F.explode("words").alias("w")).distinct()
    terms = cut(asked.select("w").distinct())
    several = terms.filter(F.contains("w", F.lit(" ")))
    with_phrases = not several.isEmpty()
    sized = memories.select("id", F.size(F.array_remove("words", T.COLUMN_END)).alias("len"), "words")
    if not with_phrases and terms.count() <= TERMS_AT_HAND:
        # Few terms: what is left of each document is small, so the texts are cut into words just once.
        wanted = [r["w"] for r in terms.collect()]
        sized = cut(sized.select("id", "len", F.filter("words", lambda w: w.isin(wanted)).alias("words")))
    totals = sized.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"))
    posted = sized.select("id", "len", F.explode("words").alias("w")).join(small(terms, 1_000_000), "w").groupBy("w", "id", "len").agg(F.count("*").alias("tf"))
    if with_phrases:
        posted = posted.union(phrase_postings(sized, several))
    totals = totals.first()
    return scored_hits(posted, asked, F.lit(totals["n"]), F.lit(totals["mean"]), pool, ratio)


def scored_hits(posted: DataFrame, asked: DataFrame, n: Column, mean: Column, pool: int, ratio: float) -> DataFrame:
    """BM25 of postings (w, id, len, tf) for the terms of each query (qid, w), of n records of a mean length.

    A record's postings are dealt to one place and meet all queries there; pairs of query and record are no rows before
    the best are taken.
    """
    per_term = posted.groupBy("w").agg(F.count("*").alias("df"))
    raw = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # A number stands for a term from here on.
    idf = cut(per_term.select("w", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"), F.monotonically_increasing_id().alias("term")))
    idf = small(idf, 1_000_000)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    weighed = posted.join(idf, "w").select("id", "term", part.alias("part"))
    questions = asked.join(idf.select("w", "term"), "w").groupBy("qid").agg(F.collect_list("term").alias("terms"))
    return gate(top(scan.summed(weighed, questions, pool), pool), ratio)


def phrase_postings(sized: DataFrame, phrases: DataFrame) -> DataFrame:
    """(w, id, len, tf): how often the tokens of each phrase follow one another. sized: id, len, words; phrases: w.

    A place counts where every token of the phrase stands at its distance from it.
    """
    parts = phrases.select("w", F.posexplode(F.split("w", " ")).alias("nth", "token")).withColumn("n", F.size(F.split("w", " ")))
    places = sized.select("id", "len", F.posexplode("words").alias("pos", "token")).join(small(parts, 1_000_000), "token")
    return whole_phrases(places)


def whole_phrases(places: DataFrame) -> DataFrame:
    """(w, id, len, tf) of the places (w, n, id, len, nth, pos) where all n tokens of a phrase stand."""
    whole = places.groupBy("w", "n", "id", "len", (F.col("pos") - F.col("nth")).alias("at")).agg(F.count("*").alias("found")).filter("found = n")
    return whole.groupBy("w", "id", "len").agg(F.count("*").alias("tf"))


def query_errors(queries: DataFrame) -> DataFrame:
    """(qid, error): queries that recall refuses: blank, or with letters of other scripts. queries: qid, text."""
    text = F.coalesce("text", F.lit(""))
    error = F.when(F.trim(F.regexp_replace(text, r"(?U)\s", " ")) == "", "blank").when(~T.only_latin(text), "script")
    return queries.select("qid", error.alias("error")).filter("error is not null")


def checked_queries(queries: DataFrame) -> DataFrame:
    """The queries that recall takes."""
    return queries.join(query_errors(queries).select("qid"), "qid", "left_anti")


def retokenized(records: DataFrame, version: int, stems: bool = False) -> DataFrame:
    """records with the index tokens of the wanted version: those of another, or none, are made anew.

    records: summary, body, index_words (array), index_version.
    """
    fits = F.coalesce(F.col("index_version") == version, F.lit(False))
    return records.withColumn("index_words", F.when(fits, F.col("index_words")).otherwise(T.lexical_row("summary", "body", stems))).withColumn("index_version", F.lit(version))


def fuse(lists: list[DataFrame], k: int = M.RRF_K) -> DataFrame:
    """(qid, id, relevance): reciprocal ranks summed, scaled so that one first rank is 1. lists: qid, id, rank."""
    rows = lists[0].select("qid", "id", "rank")
    for more in lists[1:]:
        rows = rows.union(more.select("qid", "id", "rank"))
    return rows.groupBy("qid", "id").agg(((k + 1) * F.sum(1.0 / (k + F.col("rank")))).alias("relevance"))


def expand_revisions(fused: DataFrame, tail_of: DataFrame, limit: int) -> DataFrame:
    """Adds, for the first `limit` rows of a query, the last revision of each at a decayed relevance, if not there."""
    seeds = top(fused, limit, "relevance").select("qid", "id", "relevance")
    moved = seeds.join(tail_of, "id").filter("tail <> id").groupBy("qid", F.col("tail").alias("id")).agg((F.max("relevance") * M.REVISION_DECAY).alias("relevance"))
    added = moved.join(fused.select("qid", "id"), ["qid", "id"], "left_anti")
    return fused.select("qid", "id", "relevance", F.lit(True).alias("matched")).union(added.select("qid", "id", "relevance", F.lit(False)))


def weighed(candidates: DataFrame, records: DataFrame, tail_of: DataFrame, now: int, stale_days: int = M.STALE_DAYS) -> DataFrame:
    """Candidates with their record's age, retention, score and whether they are the latest revision."""
    kept = M.retention(F.lit(now), M.clock_origin(F.col("recalled_at"), F.col("created_at")), F.col("stability"))
    out = candidates.join(records, "id").join(tail_of, "id")
    out = out.withColumn("retention", kept).withColumn("score", M.final_score(F.col("relevance"), F.col("retention"))).withColumn("latest", F.col("tail") == F.col("id"))
    return out.withColumn("needs_update", M.needs_update(F.col("retention"))).withColumn("stale", M.stale(F.lit(now), F.col("updated_at"), stale_days)).withColumn("age_days", M.age_days(F.lit(now), F.col("updated_at")))


def fold(rows: DataFrame) -> DataFrame:
    """Drops a superseded row whose last revision is a candidate of the same query; others stay."""
    there = rows.select("qid", F.col("id").alias("tail"), F.lit(True).alias("there"))
    return rows.join(there, ["qid", "tail"], "left").filter("latest or there is null").drop("there")


def recall(records: DataFrame, links: DataFrame, hits: list[DataFrame], now: int, limit: int = 3, expand: bool = True, include_superseded: bool = False, tail_of: DataFrame | None = None) -> DataFrame:
    """Direct rows, then linked ones, for every query. records: id, supersedes_id, created_at, updated_at, recalled_at,
    stability; links: source_id, target_id; hits: ranked lists (qid, id, rank).

    Returns qid, id, source (direct or link), rank, score, relevance, retention, latest, stale, needs_update, age_days,
    linked_from (ids), matched (the row was in a list itself).
    """
    limit = max(limit, 1)
    tail_of = lineage.tails(records) if tail_of is None else tail_of
    fused = cut(fuse(hits))  # at most the pool of each list for each query; read by four joins below
    candidates = expand_revisions(fused, tail_of, limit) if expand else fused.withColumn("matched", F.lit(True))
    rows = weighed(candidates, records, tail_of, now)
    rows = rows if include_superseded else fold(rows)
    columns = ["qid", "id", "rank", "score", "relevance", "retention", "latest", "stale", "needs_update", "age_days"]
    direct = top(rows, limit).select(*columns, "matched")
    seeds = direct.select("qid", F.col("id").alias("seed"), "score")
    reached = seeds.join(lineage.neighbours(links).withColumnRenamed("id", "seed"), "seed")
    if not include_superseded:
        reached = reached.join(tail_of.withColumnRenamed("id", "other"), "other").withColumn("other", F.col("tail"))
    reached = reached.select("qid", F.col("other").alias("id"), "seed", "score").join(direct.select("qid", "id"), ["qid", "id"], "left_anti")
    linked = reached.groupBy("qid", "id").agg((F.max("score") * M.LINK_DECAY).alias("relevance"), F.array_sort(F.collect_set("seed")).alias("linked_from"))
    linked = top(linked, limit, "relevance")
    linked = weighed(linked, records, tail_of, now).withColumn("score", F.col("relevance"))
    linked = linked if include_superseded else linked.filter("latest")
    was_matched = fused.select("qid", "id", F.lit(True).alias("m"))
    linked = linked.join(was_matched, ["qid", "id"], "left").withColumn("matched", F.coalesce("m", F.lit(False)))
    none = F.array().cast(linked.schema["linked_from"].dataType)
    a = direct.select(*columns, "matched", F.lit("direct").alias("source"), none.alias("linked_from"))
    return a.unionByName(linked.select(*columns, "matched", F.lit("link").alias("source"), "linked_from"))


def reinforcements(recalled: DataFrame, records: DataFrame, now: int) -> DataFrame:
    """(id, recalled_at, stability) to merge back: returned rows that matched themselves and are not needing an update."""
    due = recalled.filter("matched and not needs_update").select("id").distinct()
    return records.join(due, "id", "left_semi").select("id", F.lit(now).cast("long").alias("recalled_at"), M.strengthened(F.col("stability")).alias("stability"))


def with_texts(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows (such as from recall) with the texts of their records: few rows are sent to the texts, which stay where they
    are read. rows: id; records: id and the columns of text."""
    return small(cut(rows)).join(records, "id")


def snippets(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """Bodies of rows after a query's first: whole if short or nearly as relevant as the first, else clipped.

    rows: qid, source, rank, relevance, body; adds body_truncated.
    """
    w = Window.partitionBy("qid").orderBy(*([order] if order is not None else ["source", "rank"]))
    n, first = F.row_number().over(w), F.first("relevance").over(w)
    whole = (n == 1) | ((first > 0) & (F.round("relevance", 9) >= F.round(first * T.SNIPPET_RATIO, 9))) | (F.char_length("body") <= T.SNIPPET_FULL)
    out = rows.withColumn("whole", whole)
    return out.withColumn("body_truncated", ~F.col("whole")).withColumn("body", F.when(F.col("whole"), F.col("body")).otherwise(T.clip("body", T.SNIPPET_CLIP))).drop("whole")


def word_overlap_rank(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, id, hits, rank): how many of a query's words occur as part of a text. queries: qid, words; docs: id, text."""
    counted = scan.word_hits(docs.select("id", F.lower("text").alias("text")), queries, k)
    order = Window.partitionBy("qid").orderBy(F.desc("hits"), "id")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def embedded(rows: DataFrame, embedder: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(id, vector) of texts: unit vectors of the hash embedder, or of a given one (a batch of texts to lists of floats).

    rows: id, text.
    """
    if embedder is None:
        return hash_vectors(rows, "id", "text").select("id", M.unit(F.col("vector")).alias("vector"))
    return rows.select("id", F.pandas_udf(embedder, "array<double>")("text").alias("vector"))


def reembedded(records: DataFrame, model: str, text: Column, dimensions: int = M.DIMENSIONS, embedder: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """records with vectors of the wanted model: those that do not fit are computed anew, the rest stay as they are.

    A record without a vector stays without one.
    """
    fits = M.usable(F.col("vector"), F.col("embedding_model"), model, dimensions)
    stale = records.filter(F.col("vector").isNotNull() & ~fits).select("id", text.alias("text"))
    fresh = embedded(stale, embedder).withColumnRenamed("vector", "fresh")
    return records.join(fresh, "id", "left").withColumn("embedding_model", F.when(F.col("fresh").isNotNull(), F.lit(model)).otherwise(F.col("embedding_model"))).withColumn("vector", F.coalesce("fresh", "vector")).drop("fresh")


def public_rows(rows: DataFrame) -> DataFrame:
    """What a caller sees of recalled rows: score and retention to two decimals, no working columns, empty lists null.

    rows: as from recall, with summary and body.
    """
    links = F.when(F.size("linked_from") > 0, F.col("linked_from"))
    return rows.select("qid", "id", "source", "rank", "summary", "body", F.round("score", 2).alias("score"), F.round("retention", 2).alias("retention"), "latest", "stale", "needs_update", "age_days", links.alias("linked_from"))


def as_json(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, json): each key's rows as one JSON array, in order; null fields are left out."""
    fields = [c for c in rows.columns if c != key]
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*fields)).alias("j"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("r")).select(key, F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]")).alias("json"))
