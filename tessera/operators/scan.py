"""A stated set of questions against all rows, in one pass over the rows for a bounded block of questions.

The questions of a block are gathered by the driver, within a fixed limit, and sent to the tasks; rows stream past them
in Arrow batches and only each batch's best leave. More questions than the limit make more blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources.shared import small_batches

#: Questions of a block.
VECTORS, WORD_LISTS, NEEDLES = 8192, 1024, 8192
#: Pairs scored at a time.
PAIRS = 1 << 21
#: Items of a list column that a task works on at a time.
ITEMS = 1 << 18


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = ITEMS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in parts of at most `most` items of a list column, or of one row: a task then
    holds no more for a batch of many or long lists."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def in_blocks(questions: DataFrame, most: int, one: Callable[[list], DataFrame]) -> DataFrame:
    """The results of `one` over each block of at most about `most` questions."""
    n = questions.count()
    if n <= most:
        return one(questions.collect())
    blocks = -(-n * 5 // (4 * most))
    at = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    return reduce(DataFrame.union, [one(questions.filter(at == i).collect()) for i in range(blocks)])


def _best(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of one question: score to nine decimals, then place."""
    rounded = np.round(score, 9)
    pick = np.arange(len(rounded))
    if len(rounded) > k:
        pick = np.flatnonzero(rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k])
    return pick[np.lexsort((place[pick], -rounded[pick]))][:k]


def _places(ids: pa.Array) -> np.ndarray:
    """The order of ids, as a number for each."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1))
    return np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)


def nearest(rows: DataFrame, questions: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """(qid, id, score): a superset of the k largest cosines of each question, k of each batch of rows at most.

    rows: id, vector; questions: qid, vector. A pair with an empty or zero vector or of unequal lengths scores 0.
    """
    id_type, qid_type = rows.schema["id"].dataType, questions.schema["qid"].dataType
    small_batches(rows.sparkSession)
    id_arrow, qid_arrow = to_arrow_type(id_type), to_arrow_type(qid_type)

    def one(asked: list) -> DataFrame:
        by_length: dict[int, list[int]] = {}
        for i, q in enumerate(asked):
            by_length.setdefault(len(q["vector"] or ()), []).append(i)
        tables = {n: (np.array(at), _unit(np.array([asked[i]["vector"] for i in at], np.float64).reshape(-1, n))) for n, at in by_length.items() if n}
        qids = pa.array([q["qid"] for q in asked], qid_arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, PAIRS // max(1, len(asked)))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    ids, column = part.column("id"), part.column("vector")
                    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
                    score = np.zeros((len(asked), len(part)))
                    for n, (which, table) in tables.items():
                        here = np.flatnonzero(length == n)
                        if len(here):
                            values = column.take(pa.array(here)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
                            score[np.ix_(which, here)] = table @ _unit(values).T
                    place = _places(ids)
                    if drop_self:
                        own = pc.index_in(qids.cast(id_arrow), ids).to_numpy(zero_copy_only=False)
                    picks, of = [], []
                    for q in range(len(asked)):
                        s = score[q]
                        if drop_self and own[q] == own[q]:
                            s = s.copy()
                            s[int(own[q])] = -np.inf
                        best = _best(s, place, k)
                        best = best[s[best] > -np.inf]
                        picks.append(best)
                        of.append(np.full(len(best), q))
                    if picks:
                        pick, q = np.concatenate(picks), np.concatenate(of)
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(pick)), pa.array(score[q, pick])], names=["qid", "id", "score"])

        return rows.select("id", "vector").mapInArrow(run, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, score double")

    return in_blocks(questions.select("qid", "vector"), VECTORS, one)


def _automaton(words: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        found.add_word(w, i)
    if words:
        found.make_automaton()
    return found


def word_hits(rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, hits): a superset of the k rows that have the most of each question's words inside their text.

    rows: id, text; questions: qid, words (a repeated word counts as often). Rows without a hit are left out.
    """
    id_type, qid_type = rows.schema["id"].dataType, questions.schema["qid"].dataType
    small_batches(rows.sparkSession)
    qid_arrow = to_arrow_type(qid_type)

    def one(asked: list) -> DataFrame:
        words = sorted({w for q in asked for w in q["words"] or () if w})
        number = {w: i for i, w in enumerate(words)}
        of = [(number[w], i) for i, q in enumerate(asked) for w in q["words"] or () if w]
        qids = pa.array([q["qid"] for q in asked], qid_arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(words)
            times = np.zeros((len(words), len(asked)), np.float32)
            np.add.at(times, tuple(np.array(of, np.int64).reshape(-1, 2).T), 1)
            for batch in batches if words else ():
                ids, texts = batch.column("id"), batch.column("text").to_pylist()
                place = _places(ids)
                hits = np.zeros((len(texts), len(asked)), np.float32)
                for i, t in enumerate(texts):
                    there = {v for _, v in found.iter(t)} if t else ()
                    if there:
                        hits[i] = times[np.fromiter(there, np.int64, len(there))].sum(0)
                picks = [b[hits[b, q] > 0] for q in range(len(asked)) for b in [_best(hits[:, q], place, k)]]
                pick, q = np.concatenate(picks), np.repeat(np.arange(len(asked)), [len(p) for p in picks])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(pick)), pa.array(hits[pick, q].astype(np.int64))], names=["qid", "id", "hits"])

        return rows.select("id", "text").mapInArrow(run, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, hits long")

    return in_blocks(questions.select("qid", "words"), WORD_LISTS, one)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, most: int = ITEMS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of batches that are sorted by a column, in parts of about `most` rows that each have all rows of a value,
    and where in a part its values begin."""

    def starts(part: pa.Table) -> np.ndarray:
        code = pc.fill_null(part.column(column).combine_chunks().dictionary_encode().indices, -1).to_numpy()
        return np.flatnonzero(np.r_[True, code[1:] != code[:-1]])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(map(len, kept)) >= most:
            part = pa.Table.from_batches(kept)
            at = starts(part)
            # The last value may go on in the next batch.
            if len(at) > 1:
                yield part.slice(0, at[-1]), at[:-1]
                kept = part.slice(at[-1]).combine_chunks().to_batches()
    part = pa.Table.from_batches(kept) if kept else None
    if part:
        yield part, starts(part)


def summed(rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): a superset of the k rows with the largest sums of their parts of each question's terms.

    rows: id, term, part (above 0); questions: qid, terms (each once). Ids without a term of the question are left out.
    The rows of an id are dealt to one task and met there by all questions of a block.
    """
    id_type, qid_type = rows.schema["id"].dataType, questions.schema["qid"].dataType
    qid_arrow = to_arrow_type(qid_type)
    small_batches(rows.sparkSession)
    dealt = rows.select("id", "term", "part").repartition("id").sortWithinPartitions("id")

    def one(asked: list) -> DataFrame:
        terms = sorted({t for q in asked for t in q["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        of = [(number[t], i) for i, q in enumerate(asked) for t in q["terms"]]
        qids = pa.array([q["qid"] for q in asked], qid_arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(terms, pa.int64())
            times = np.zeros((len(terms), len(asked)))
            times[tuple(np.array(of, np.int64).reshape(-1, 2).T)] = 1
            most, step = (max(1, PAIRS // max(1, n)) for n in (len(asked), len(terms)))
            for part, starts in whole_groups(batches, "id") if terms else ():
                ids = part.column("id").combine_chunks().take(pa.array(starts))
                term = pc.fill_null(pc.index_in(part.column("term").combine_chunks(), known), -1).to_numpy()
                weight = part.column("part").to_numpy()
                ends = np.r_[starts, len(part)]
                row = np.repeat(np.arange(len(starts)), np.diff(ends))
                for at in range(0, len(starts), most):
                    to = min(at + most, len(starts))
                    score = np.empty((to - at, len(asked)))
                    for first in range(at, to, step):
                        last = min(first + step, to)
                        here = np.arange(ends[first], ends[last])
                        here = here[term[here] >= 0]
                        cells = np.bincount((row[here] - first) * len(terms) + term[here], weight[here], (last - first) * len(terms))
                        score[first - at : last - at] = cells.reshape(last - first, len(terms)) @ times
                    place = _places(ids.slice(at, to - at))
                    picks = [b[score[b, q] > 0] for q in range(len(asked)) for b in [_best(score[:, q], place, k)]]
                    pick, q = np.concatenate(picks), np.repeat(np.arange(len(asked)), [len(p) for p in picks])
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(pick + at)), pa.array(score[pick, q])], names=["qid", "id", "score"])

        return dealt.mapInArrow(run, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, score double")

    return in_blocks(questions, WORD_LISTS, one)


def covering(rows: DataFrame, questions: DataFrame, share: float) -> DataFrame:
    """(qid, id, hits): the rows that have at least a share of a question's words among theirs, and how many.

    rows: id, words; questions: qid, words (a repeated word counts as often). A question without words is nowhere.
    """
    id_type, qid_type = rows.schema["id"].dataType, questions.schema["qid"].dataType
    small_batches(rows.sparkSession)
    qid_arrow = to_arrow_type(qid_type)

    def one(asked: list) -> DataFrame:
        asked = [q for q in asked if q["words"]]
        words = sorted({w for q in asked for w in q["words"]})
        number = {w: i for i, w in enumerate(words)}
        of = [(number[w], i) for i, q in enumerate(asked) for w in q["words"]]
        qids = pa.array([q["qid"] for q in asked], qid_arrow)
        size = np.array([len(q["words"]) for q in asked], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(words, pa.string())
            times = np.zeros((len(words), len(asked)), np.float32)
            np.add.at(times, tuple(np.array(of, np.int64).reshape(-1, 2).T), 1)
            step = max(1, PAIRS // max(1, len(words)))
            for batch in slices(batches, "words") if words else ():
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    lists = part.column("words")
                    word = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy()
                    row = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                    there = np.zeros((len(part), len(words)), np.float32)
                    there[row[word >= 0], word[word >= 0]] = 1
                    hits = (there @ times).astype(np.float64)
                    pick, q = np.nonzero(hits / size >= share)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), part.column("id").take(pa.array(pick)), pa.array(hits[pick, q].astype(np.int64))], names=["qid", "id", "hits"])

        return rows.select("id", "words").mapInArrow(run, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, hits long")

    return in_blocks(questions.select("qid", "words"), WORD_LISTS, one)


def containing(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id): the rows whose text has the question's needle inside. rows: id, text; questions: qid, needle.

    Null and empty needles are nowhere.
    """
    id_type, qid_type = rows.schema["id"].dataType, questions.schema["qid"].dataType
    small_batches(rows.sparkSession)
    qid_arrow = to_arrow_type(qid_type)

    def one(asked: list) -> DataFrame:
        by_needle: dict[str, list[int]] = {}
        for i, q in enumerate(asked):
            if q["needle"]:
                by_needle.setdefault(q["needle"], []).append(i)
        needles, owners = list(by_needle), list(by_needle.values())
        qids = pa.array([q["qid"] for q in asked], qid_arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(needles)
            for batch in batches if needles else ():
                at, q = [], []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    for v in {v for _, v in found.iter(t)} if t else ():
                        q += owners[v]
                        at += [i] * len(owners[v])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q, pa.int64())), batch.column("id").take(pa.array(at, pa.int64()))], names=["qid", "id"])

        return rows.select("id", "text").mapInArrow(run, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}")

    return in_blocks(questions.select("qid", "needle"), NEEDLES, one)
