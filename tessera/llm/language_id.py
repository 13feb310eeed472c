"""Operator 8, language identification by Bayesian evidence fusion.

Text gives each language a likelihood from smoothed character trigrams, learned from a bounded sample of rows by their
declared language. Likelihoods are tempered: trigrams overlap, so a text counts as at most EFFECTIVE independent ones.
The text's posterior under equal priors, summed by grouped aggregation, gives what the other evidence is worth: how
likely a declared markup language or an address suffix is in each language, and how the languages are spread on a
host, smoothed towards its domain and that towards all rows. All log terms add up to one posterior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import runtime
from tessera.llm.toxicity import blocks, grams

BITS, SHIFT = 15, 3
#: Bound of the rows the trigram model is fitted on (expected number), and of languages in it (the most frequent), each
#: with LEAST_ROWS rows at least. Rows that declare another language are taken at their word.
FIT_ROWS, LANGUAGES, LEAST_ROWS = 8_000, 200, 3
EFFECTIVE = 40
#: Pseudo-rows of the parent in each smoothed table.
KAPPA = 10.0
#: A text is no language's when its mean log-likelihood lies this many deviations under its language's mean; short texts
#: get sqrt(1 + SHORT / trigrams) times that room.
OUTLIER, SHORT = 10.0, 300.0
LEAST_POSTERIOR = 0.5
#: Evidence tables of up to this many values are broadcast; larger ones are joined by shuffle.
BROADCAST_VALUES = 20_000


def primary_tag(column: Column) -> Column:
    """en of en-GB, EN_us, ' en '; null for anything that is no two or three letters."""
    tag = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, domain, host) of raw web pages."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    named = F.when(host.rlike(r"^[^.]+(\.[^.]+)*\.[a-z][^.]*$"), host)
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        bare.alias("text"),
        primary_tag(declared).alias("declared"),
        F.element_at(F.split(named, r"\."), -1).alias("suffix"),
        F.substring_index(named, ".", -2).alias("domain"),
        F.when(host != "", host).alias("host"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """(doc_id, text, declared, suffix, domain, host) of documents: lang is the declared language, source the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", primary_tag(F.col("lang")).alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").cast("string").alias("host"))


def trigram_log_probabilities(rows: DataFrame, bound: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and per language the log-probability of every hashed trigram."""
    known = rows.filter("declared is not null and text is not null").select("declared", "text")
    per = known.groupBy("declared").count().orderBy(F.desc("count"), "declared").limit(LANGUAGES).collect()
    per = [r for r in per if r["count"] >= LEAST_ROWS] or per
    names = sorted(r["declared"] for r in per)
    if not names:
        return [], np.zeros((0, 1 << BITS))
    total = sum(r["count"] for r in per)
    # Of each language a like number of rows, by a hash of the text.
    each = max(1, bound // len(names))
    share = F.create_map(*[x for r in per for x in (F.lit(r["declared"]), F.lit(min(1.0, each / r["count"])))])
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    known = known.withColumn("y", number[F.col("declared")]).filter("y is not null")
    if total > bound:
        known = known.filter(F.pmod(F.xxhash64(F.lit("lid"), "text"), F.lit(1 << 30)) < share[F.col("declared")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), 1 << BITS), np.int64)
        for batch in batches:
            texts, y = [t or "" for t in batch.column("text").to_pylist()], batch.column("y").to_numpy(zero_copy_only=False)
            for i, j in blocks(texts):
                for doc, gram in grams(texts[i:j], (3,)):
                    np.add.at(sums, (y[i:j][doc], gram >> SHIFT), 1)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["y", "data"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("data").to_pylist())
        return pa.table({"y": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((len(names), 1 << BITS))
    for r in known.select("y", "text").mapInArrow(count, "y int, data binary").groupBy("y").applyInArrow(add, "y int, data binary").collect():
        counts[r["y"]] = np.frombuffer(r["data"], np.int64)
    smoothed = counts + 0.05
    return names, np.log(smoothed / smoothed.sum(1, keepdims=True))


def _text_evidence(rows: DataFrame, id_col: str, names: list[str], logs: np.ndarray) -> DataFrame:
    """(id, declared, suffix, domain, host, n_grams, ll: mean log-likelihood by language). One pass, no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    keep = [id_col, "declared", "suffix", "domain", "host"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in blocks(texts):
                n, sums = np.zeros(j - i, np.int64), np.zeros((len(names), j - i))
                for doc, gram in grams(texts[i:j], (3,)):
                    n = np.bincount(doc, minlength=j - i)
                    for k, table in enumerate(shared.value):
                        sums[k] = np.bincount(doc, table[gram >> SHIFT], minlength=j - i)
                mean = (sums / np.maximum(n, 1)).T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(names), pa.int32()), pa.array(mean.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in keep], pa.array(n, pa.int64()), lists], names=[*keep, "n_grams", "ll"])

    return rows.select(*keep, "text").mapInArrow(score, f"{id_col} long, declared string, suffix string, domain string, host string, n_grams long, ll array<double>")


def _softmax(column: str) -> str:
    return f"transform({column}, x -> exp(x - array_max({column})) / aggregate({column}, 0D, (s, y) -> s + exp(y - array_max({column}))))"


def _table(rows: DataFrame, key: str, n: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, *extra, c: mass of each language) by grouped aggregation."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key, *extra).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias("c"))


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    table = runtime.checkpoint(table)
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_VALUES else table, key, "left")


def identify(rows: DataFrame, id_col: str) -> DataFrame:
    """One row per input row: id, lang_id, posterior, text_posterior (of lang_id), n_grams, declared, accepted.

    rows: id_col, text, declared, suffix, domain, host, any of them null (then that evidence says nothing); domain may
    be null where host is not. accepted: a language is likelier than not, and the text is no outlier of it.

    A row that declares a language which the trigram model does not have (too few rows, or beyond the LANGUAGES most
    frequent) gets that language: posteriors are null, and it is accepted if it has trigrams at all. Such rows do not
    count in the evidence of the others.

    Null, empty and very short texts have no trigrams: lang_id comes from the other evidence, accepted is false. With
    no declared language anywhere nothing can be learned: lang_id is null and accepted false. Rows repeat as they are;
    an empty table gives an empty result.
    """
    runtime.small_batches(rows.sparkSession)
    names, logs = trigram_log_probabilities(rows)
    if not names:
        return rows.select(id_col, F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("double").alias("text_posterior"), F.lit(0).cast("long").alias("n_grams"), "declared", F.lit(False).alias("accepted"))
    n = len(names)
    seen = _text_evidence(rows, id_col, names, logs).withColumn("tempered", F.expr(f"transform(ll, x -> x * least(n_grams, {EFFECTIVE}))"))
    seen = runtime.checkpoint(seen.withColumn("post", F.expr(_softmax("tempered"))))
    unmodelled = F.coalesce(F.col("declared").isNotNull() & ~F.col("declared").isin(names), F.lit(False))
    spoke = seen.filter("n_grams > 0").filter(~unmodelled)
    sums = spoke.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    mass = np.array(list(sums), dtype=float)
    prior = (mass + 1) / (mass + 1).sum()
    everywhere = F.array(*[F.lit(float(x)) for x in prior])
    in_all = F.array(*[F.lit(float(x)) for x in mass])
    out = seen
    for key in ("declared", "suffix"):
        # P(value | language), smoothed towards the value's share of all rows
        of = _table(spoke, key, n).withColumn("share", F.expr(f"aggregate(c, 0D, (s, x) -> s + x) / {max(float(mass.sum()), 1.0)}D")).withColumn("all_mass", in_all)
        of = of.select(key, F.expr(f"zip_with(c, all_mass, (x, m) -> ln((x + {KAPPA} * greatest(share, 1e-9)) / (m + {KAPPA})))").alias(f"{key}_ln"))
        out = _joined(out, of, key)
    domains = _table(spoke, "domain", n).withColumn("parent", everywhere).select("domain", F.expr(f"zip_with(c, parent, (x, p) -> (x + {KAPPA} * p) / (aggregate(c, 0D, (s, y) -> s + y) + {KAPPA}))").alias("domain_p"))
    out = _joined(out, domains, "domain").withColumn("domain_p", F.coalesce("domain_p", everywhere))
    hosts = _table(spoke, "host", n).withColumnRenamed("c", "host_c")
    out = _joined(out, hosts, "host")
    host_p = f"coalesce(zip_with(host_c, domain_p, (x, p) -> (x + {KAPPA} * p) / (aggregate(host_c, 0D, (s, y) -> s + y) + {KAPPA})), domain_p)"
    nothing = F.array(*[F.lit(0.0)] * n)
    out = out.withColumn("host_p", F.expr(host_p)).withColumn("nothing", nothing)
    total = "zip_with(zip_with(tempered, transform(host_p, p -> ln(p)), (a, b) -> a + b), zip_with(coalesce(declared_ln, nothing), coalesce(suffix_ln, nothing), (a, b) -> a + b), (a, b) -> a + b)"
    out = out.withColumn("total", F.expr(total)).withColumn("p", F.expr(_softmax("total")))
    out = out.withColumn("best", F.expr("cast(array_position(p, array_max(p)) as int)"))
    usual = spoke.withColumn("i", F.expr("cast(array_position(ll, array_max(ll)) as int)")).groupBy("i").agg(F.avg(F.array_max("ll")).alias("mean"), F.coalesce(F.stddev_pop(F.array_max("ll")), F.lit(0.0)).alias("sd"))
    usual = {r["i"]: (r["mean"], max(r["sd"], 0.05)) for r in usual.collect()}
    mean, room = (F.array(*[F.lit(float(usual.get(i + 1, (-1e9, 1.0))[k])) for i in range(n)]) for k in (0, 1))
    floor = F.element_at(mean, F.col("best")) - OUTLIER * F.element_at(room, F.col("best")) * F.sqrt(1 + SHORT / F.greatest("n_grams", F.lit(1)))
    languages = F.array(*[F.lit(x) for x in names])
    at = F.col("best")
    accepted = (F.col("n_grams") > 0) & (F.element_at("p", at) >= LEAST_POSTERIOR) & (F.element_at("ll", at) >= floor)
    modelled = F.when(~unmodelled, F.struct(F.element_at(languages, at).alias("lang_id"), F.element_at("p", at).alias("posterior"), F.element_at("post", at).alias("text_posterior")))
    return out.withColumn("m", modelled).select(id_col, F.coalesce("m.lang_id", "declared").alias("lang_id"), "m.posterior", "m.text_posterior", "n_grams", "declared", F.when(unmodelled, F.col("n_grams") > 0).otherwise(accepted).alias("accepted"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs with a language; of rows that share an id all stay if one has. Rows of a null id stay."""
    found = identify(document_evidence(docs), "doc_id")
    per = found.groupBy("doc_id").agg(F.max("accepted").alias("ok")).filter("not ok and doc_id is not null").select("doc_id")
    return runtime.without_ids(docs, runtime.checkpoint(per))
