"""A stored inverted index of records, kept up as they come, change and go, and BM25 from it.

Postings lie in runs, whose files are sorted by term: the scan of a question reads the row groups that can hold its
terms. A run is added by each commit; FANOUT runs of a tier make one of the next, without the rows of records that have changed since.
What a record's newest commit is, says a table of owners; how many records there are and how long they are together, is
kept with the version. Tables and numbers change in one commit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import memory as M
from tessera.functions import text as T
from tessera.operators import retrieval, scan
from tessera.sources.shared import cut, small_batches
from tessera.sources.store import Lease, Store, Version

FANOUT = 4
#: Another number wherever tokens or tables change, so that no index of an earlier form is taken for a new one.
FORMAT = 1
#: Terms that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Bytes of text whose postings a task sorts.
PART_BYTES = 16 << 20

_CASES = [re.compile(p) for p in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])")]
_PLAIN = str.maketrans(T.MARKED, T.PLAIN)
_CUT = re.compile(r"[\W_]+")
_PARTS = re.compile("[ _-]+")
_BOUNDARY = re.compile(T.BOUNDARY)
_ASCII = re.compile("[A-Za-z0-9]+")


def plain_tokens(text: str) -> list[str]:
    """Runs of letters and digits, without case and accents."""
    return [w for w in _CUT.split(text.lower().translate(_PLAIN)) if w]


def term_tokens(term: str) -> list[str]:
    """The index tokens of one term: itself and its identifier words, each once (as functions.text.expand_term)."""
    if not _BOUNDARY.search(term):
        return plain_tokens(term)
    parts = term
    for case in _CASES:
        parts = case.sub(r"\1 \2", parts)
    words = dict.fromkeys([term.lower(), *[w.lower() for w in _PARTS.split(parts) if _ASCII.fullmatch(w)]])
    return [w for variant in words for w in plain_tokens(variant)]


def postings(records: DataFrame) -> DataFrame:
    """(term, id, tf, len, positions) of records (id, summary, body), the same as from functions.text.lexical_row.

    Terms are cut by the engine; the distinct ones of a slice are looked up once, and its postings are made where it is read.
    """
    id_type = records.schema["id"].dataType
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in scan.slices(batches, "terms"):
            if len(known) > REMEMBERED:
                known.clear()
            summaries = [plain_tokens(s or "") for s in batch.column("summary").to_pylist()]
            terms = batch.column("terms")
            coded = terms.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            for t in names:
                if t not in known:
                    known[t] = term_tokens(t)
            tokens = [known[t] for t in names]
            n_tokens = np.array([len(t) for t in tokens], np.int64)
            # Every place of a term stands for all of its tokens.
            code = coded.indices.to_numpy().astype(np.int64)
            n_terms = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
            row_of_term = np.repeat(np.arange(len(batch)), n_terms)
            first = np.r_[0, np.cumsum(n_tokens)][:-1]
            flat = pa.array([w for t in tokens for w in t] + [w for s in summaries for w in s], pa.string()).dictionary_encode()
            number, n_body = flat.indices.to_numpy().astype(np.int64), int(n_tokens.sum())
            reps = n_tokens[code]
            at = np.repeat(first[code] - np.r_[0, np.cumsum(reps)][:-1], reps) + np.arange(reps.sum())
            in_body, body_row = number[:n_body][at], np.repeat(row_of_term, reps)
            n_summary = np.array([len(s) for s in summaries], np.int64)
            summary_row = np.repeat(np.arange(len(batch)), n_summary)
            body_len = np.bincount(body_row, minlength=len(batch))
            start = np.r_[0, np.cumsum(body_len)][:-1]
            # The summary, a place for the border, then the terms.
            body_pos = np.arange(len(in_body)) - start[body_row] + n_summary[body_row] + 1
            summary_pos = np.arange(len(summary_row)) - (np.cumsum(n_summary) - n_summary)[summary_row]
            row, word, pos = np.r_[summary_row, body_row], np.r_[number[n_body:], in_body], np.r_[summary_pos, body_pos]
            order = np.lexsort((pos, word, row))
            row, word, pos = row[order], word[order], pos[order]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])]) if len(row) else np.zeros(0, np.int64)
            ends = np.r_[new, len(row)]
            yield pa.RecordBatch.from_arrays(
                [
                    flat.dictionary.take(pa.array(word[new])),
                    batch.column("id").take(pa.array(row[new])),
                    pa.array(np.diff(ends), pa.int32()),
                    pa.array((body_len + n_summary)[row[new]], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32())),
                ],
                names=["term", "id", "tf", "len", "positions"],
            )

    cut_terms = records.select("id", "summary", T.split_terms(F.concat_ws(" ", "summary", "body")).alias("terms"))
    return cut_terms.mapInArrow(run, f"term string, id {id_type.simpleString()}, tf int, len int, positions array<int>")


def dealt(records: DataFrame) -> DataFrame:
    """records in parts of about PART_BYTES of text where there are more than a part for each core: what a task sorts then
    does not follow from how the files are cut."""
    length = F.coalesce(F.octet_length("summary"), F.lit(0)) + F.coalesce(F.octet_length("body"), F.lit(0))
    size = records.agg(F.sum(length.cast("long"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    return records.repartition(parts, "id") if parts > records.sparkSession.sparkContext.defaultParallelism else records


def _owners(store: Store, version: Version) -> DataFrame:
    """(id, at, len) of every record's last commit; len is null where that removed it."""
    last = F.max_by(F.struct("at", "len"), F.col("at")).alias("o")
    return store.table("owners", version).groupBy("id").agg(last).select("id", "o.at", "o.len")


def live_postings(store: Store, version: Version, rows: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, len, positions, at), without those of records that have changed since."""
    rows = store.table("postings", version) if rows is None else rows
    if not version.facts["dead"]:
        return rows
    return rows.join(_owners(store, version).filter("len is not null").select("id", "at"), ["id", "at"], "left_semi").select(*rows.columns)


def change(store: Store, records: DataFrame, gone: DataFrame | None = None, marks: dict[str, int] | None = None, lease: Lease | None = None) -> Version:
    """Puts in new and changed records (id, summary, body) and takes out those of gone (id); ids occur once. Records that
    are not there can be gone without harm. With marks, a batch that was applied is not applied again."""
    base = store.latest()
    if marks and all(base.marks.get(source, -1) >= number for source, number in marks.items()):
        return base
    at = F.lit(base.number + 1).cast("long")
    # Sorted where they are made: a file's row groups then hold ranges of terms. Merged runs are dealt by ranges.
    run = store.put("postings", postings(dealt(records)).sortWithinPartitions("term", "id").withColumn("at", at), base)
    fresh = store.rows(run)
    lengths = records.select("id").join(fresh.groupBy("id").agg(F.first("len").alias("len")), "id", "left").select("id", at.alias("at"), F.coalesce("len", F.lit(0)).alias("len"))
    owners = lengths if gone is None else lengths.unionByName(gone.select("id", at.alias("at"), F.lit(None).cast("int").alias("len")))
    owners = cut(owners)
    known = _owners(store, base).filter("len is not null") if "owners" in base.tables else owners.limit(0)
    changed = owners.select("id", F.col("len").alias("new")).join(known, "id", "left")
    n = changed.agg(F.count("new").alias("come"), F.coalesce(F.sum("new"), F.lit(0)).alias("length"), F.count("len").alias("went"), F.coalesce(F.sum("len"), F.lit(0)).alias("less")).first()
    old = base.facts or {"n": 0, "length": 0, "dead": 0, "tiers": []}
    facts = {"n": old["n"] + n["come"] - n["went"], "length": old["length"] + n["length"] - n["less"], "dead": old["dead"] + n["went"], "tiers": [*old["tiers"], 0]}
    return _merged(store, store.commit(append={"postings": run, "owners": owners}, marks=marks, facts=facts, base=base, lease=lease), lease)


def _merged(store: Store, version: Version, lease: Lease | None) -> Version:
    """FANOUT runs of a tier as one of the next, as long as there are."""
    tiers = version.facts["tiers"]
    while len(tiers) >= FANOUT and len(set(tiers[-FANOUT:])) == 1:
        parts = store.parts("postings", version)
        runs = store.part("postings", parts[-FANOUT], version)
        for part in parts[1 - FANOUT :]:
            runs = runs.unionByName(store.part("postings", part, version))
        rows = live_postings(store, version, runs).repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        whole = len(tiers) == FANOUT
        facts = {"tiers": [*tiers[:-FANOUT], tiers[-1] + 1]} | ({"dead": 0} if whole else {})
        replace = {"owners": cut(_owners(store, version).filter("len is not null"))} if whole else {}
        version = store.commit(append={"postings": rows}, replace=replace, parts={"postings": parts[:-FANOUT]}, facts=facts, base=version, lease=lease)
        tiers = version.facts["tiers"]
    return version


def hits(store: Store, queries: DataFrame, pool: int = M.POOL, ratio: float = M.LEXICAL_GATE, version: Version | None = None) -> DataFrame:
    """(qid, id, score, rank) by BM25, as retrieval.bm25_hits over the records' words. queries: qid, words (terms; one
    with blanks is a phrase)."""
    version = version or store.latest()
    asked = cut(queries.select("qid", F.explode("words").alias("w")).distinct())
    terms = asked.select("w").distinct()
    tokens = terms.select(F.explode(F.split("w", " ")).alias("term")).distinct()
    rows = store.table("postings", version)
    few = [r["term"] for r in tokens.limit(retrieval.TERMS_AT_HAND + 1).collect()]
    rows = rows.filter(F.col("term").isin(few)) if len(few) <= retrieval.TERMS_AT_HAND else rows.join(retrieval.small(tokens, 1_000_000), "term", "left_semi")
    rows = live_postings(store, version, rows)
    posted = rows.select(F.col("term").alias("w"), "id", "len", "tf").join(retrieval.small(terms, 1_000_000), "w")
    several = terms.filter(F.contains("w", F.lit(" ")))
    if not several.isEmpty():
        parts = several.select("w", F.posexplode(F.split("w", " ")).alias("nth", "term")).withColumn("n", F.size(F.split("w", " ")))
        places = rows.join(retrieval.small(parts, 1_000_000), "term").select("w", "n", "id", "len", "nth", F.explode("positions").alias("pos"))
        posted = posted.unionByName(retrieval.whole_phrases(places))
    n = version.facts["n"]
    return retrieval.scored_hits(posted, asked, F.lit(n), F.lit(version.facts["length"] / max(n, 1)), pool, ratio)
