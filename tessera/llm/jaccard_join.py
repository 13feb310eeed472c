"""Operator 10, n-gram Jaccard join by chosen paths.

Documents are sets of hashed five-word shingles; equal sets are one representative. A run hashes, level by level,
which tokens of a set are chosen (about CHOSEN of them at each level): a set goes to the bucket of every token that it
chooses, and the pairs of buckets of at most SMALL sets become candidates. Sets that share most tokens share a chosen
one with high probability; runs repeat until what they all miss is under 1 - RECALL. A set whose other buckets are
too few to promise that goes on in the larger ones, each of which splits by one of the choices kept for the next levels.
In a simulation of pairs at the threshold all of whose buckets are large, 4 of 300 000 did not meet after four levels
(with one choice a run and level: 221 of 150 000). Larger buckets whose members are mostly near a few probes hold near
copies and do not split, and others are left after the last level: their sets are dealt into blocks, and two blocks that
share such a bucket are compared all with all, exactly, by products of their tables of tokens. Candidates of small
buckets pass a size and a sketch test and are then verified exactly; classes are the connected components of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import runtime
from tessera.llm.wordhash import LOWER, U, Words, mix, utf8

SHINGLE, THRESHOLD = 5, 0.8
#: Tokens that a set chooses at each level of a run, in the mean.
CHOSEN = 2.0
RECALL = 0.99999
LEVELS, SMALL = 4, 32
#: Probes of a large bucket, bits in which a sketch may differ from a probe's, and share of members so near to one that
#: makes the bucket a group of near copies. This only chooses the way; either way finds all links.
PROBES, NEAR_BITS, NEAR_COPIES = 2, 64, 0.3
#: Tokens of a block of near copies (a set counts for EACH more), and the share of the pairs of two blocks from which on
#: a token in common is counted by a matrix product; a rarer one is counted pair by pair.
BLOCK_TOKENS, EACH, DENSE = 1 << 20, 256, 0.01
#: (tokens, bits): a pair of sets of at least so many tokens whose sketches differ in more bits is no candidate. Of
#: 200 000 simulated pairs at the threshold with 300, 200 and 100 tokens the farthest differed in 59, 63 and 84 bits, and
#: one bit more was a fourth to a third less likely each time: beyond these bounds it is under 1e-7 of such pairs.
SKETCHED = ((300, 68), (200, 76), (100, 96))
TEXT_BYTES = 2 << 20


def due(recall: float = RECALL) -> float:
    """Shared chosen tokens to expect, so that two sets have none with probability 1 - recall."""
    return -math.log(1 - recall)


def shared(threshold: float) -> float:
    """Least share of a set's tokens that a set of like size has at the threshold (of a larger one: more than this
    share of the smaller set's, which chooses its tokens at the higher rate)."""
    return 2 * threshold / (1 + threshold)


def runs_for(threshold: float, recall: float = RECALL, chosen: float = CHOSEN) -> int:
    """Runs that promise the recall to sets even where a quarter of their buckets are large."""
    return max(1, math.ceil(due(recall) / (chosen * (shared(threshold) - 0.25))))


def _sets(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts lo..hi, one text after another, and where each text's begin (n + 1)."""
    data, offsets = utf8(column.slice(lo, hi - lo))
    words = Words(LOWER[data], offsets)
    n = hi - lo
    h = words.hashes()
    at, grams = words.windows(SHINGLE, h)
    doc = words.doc[at]
    count = np.diff(words.first_of)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    extra = np.zeros(len(short), U)
    for i, d in enumerate(short.tolist()):
        for w in h[words.first_of[d] : words.first_of[d + 1]].tolist():
            extra[i : i + 1] = mix(extra[i : i + 1] * U(31) + U(w))
    doc, grams = np.r_[doc, short], np.r_[grams, extra]
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(n + 1))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")]
    at = total = 0
    for i, s in enumerate(sizes):
        total += s
        if total >= TEXT_BYTES:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _sketch(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256 one-bit sketches of the least token in each of 256 ranges; an empty range takes the next one's (n x 4 longs)."""
    n = len(at) - 1
    size = np.diff(at)
    place = np.repeat(np.arange(n), size) * 256 + (grams >> U(56)).astype(np.int64)
    least = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    known = np.full(n * 256, -1, np.int8)
    known[place[least]] = (mix(grams[least]) & U(1)).astype(np.int8)
    known = known.reshape(n, 256)
    where = np.where(known >= 0, np.arange(256), 1 << 20)
    nearest = np.minimum.accumulate(where[:, ::-1], axis=1)[:, ::-1]
    nearest = np.where(nearest == 1 << 20, nearest[:, :1], nearest)
    bits = np.take_along_axis(known, np.minimum(nearest, 255), axis=1)
    return np.packbits(bits > 0, axis=1).view(">i8").astype(np.int64)


def _signatures(n_runs: int, levels: int):
    names = ["doc_id", "hi", "lo", "size", "s0", "s1", "s2", "s3", "chosen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _blocks(batch):
                grams, at = _sets(batch.column("text"), i, j)
                n, size = j - i, np.diff(at)
                doc = np.repeat(np.arange(n), size)
                sums = [np.r_[U(0), np.cumsum(mix(grams ^ U(k)), dtype=U)] for k in (17, 99)]
                hi, lo = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                sketch = _sketch(grams, at)
                # Level by level and run by run, the tokens whose hash falls under the share that the set chooses.
                share = (np.minimum(1.0, CHOSEN / np.maximum(size, 1)) * 2.0**53).astype(np.int64)[doc]
                picks = []
                for k in range(n_runs * levels):
                    pick = np.flatnonzero((mix(grams + U((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U(11)).astype(np.int64) < share)
                    picks.append((doc[pick] * (n_runs * levels) + k, grams[pick]))
                slot = np.concatenate([p[0] for p in picks])
                token = np.concatenate([p[1] for p in picks])
                order = np.argsort(slot, kind="stable")
                inner = pa.ListArray.from_arrays(pa.array(np.searchsorted(slot[order], np.arange(n * n_runs * levels + 1)), pa.int32()), pa.array((token[order] >> U(32)).astype(np.uint32).view(np.int32), pa.int32()))
                chosen = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_runs * levels, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int32()), *[pa.array(sketch[:, k], pa.int64()) for k in range(4)], chosen], names=names)

    return run


SIGNATURES = "doc_id long, hi long, lo long, size int, s0 long, s1 long, s2 long, s3 long, chosen array<array<int>>"


def _sizes(threshold: float) -> str:
    return f"least(a.size, b.size) >= {threshold}D * greatest(a.size, b.size)"


DIFFERENT_BITS = " + ".join(f"bit_count(a.s{k} ^ b.s{k})" for k in range(4))


def _may_be_near() -> str:
    cases = " ".join(f"when least(a.size, b.size) >= {tokens} then {bits}" for tokens, bits in SKETCHED)
    return f"{DIFFERENT_BITS} <= case {cases} else 256 end"


def _paired(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.alias("a").join(rows.alias("b"), F.expr(f"a.path = b.path and a.rep < b.rep and {_sizes(threshold)} and {_may_be_near()}")).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


SKETCH = ("size", "s0", "s1", "s2", "s3")


def candidates(reps: DataFrame, n_runs: int, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """(a, b) with a < b, distinct: pairs of representatives to verify; and (path, rep, size) of the large buckets whose
    members are to be compared all with all (None: there are none). reps: rep, size, s0..s3, chosen."""
    sketches = reps.select("rep", *SKETCH)
    tokens = F.expr(f"flatten(transform(sequence(0, {n_runs - 1}), r -> transform(chosen[r * {levels}], t -> xxhash64(r, t))))")
    now = reps.select("rep", F.explode(tokens).alias("path"))
    pairs, groups, scratch, level = [], [], [], 1
    while True:
        # A set alone in its bucket is done there; the others carry their sketch and their bucket's size from here on.
        count = now.groupBy("path").count().filter("count > 1")
        met = runtime.written(now.join(count, "path").join(sketches, "rep"), f"paths-{level}", scratch)
        pairs.append(runtime.checkpoint(_paired(met.filter(F.col("count") <= small), threshold).distinct()))
        large = met.filter(F.col("count") > small).drop("count")
        if large.isEmpty():
            break
        group = _near_copies(large, threshold)
        groups.append(group)
        if level == 1:
            # Sets with enough chosen tokens in other buckets have met their likes there; so has whoever is like them.
            lost = large.groupBy("rep").agg(F.count("*").alias("lost"))
            mean = reps.select("rep", F.expr(f"aggregate(transform(sequence(0, {n_runs - 1}), r -> size(chosen[r * {levels}])), 0, (s, x) -> s + x)").alias("all"))
            weak = mean.join(lost, "rep").filter(shared(threshold) * F.col("all") - F.col("lost") < due(recall)).select("rep")
            large = large.join(runtime.checkpoint(weak), "rep", "left_semi")
        paths = runtime.broadcast_if_small(runtime.checkpoint(group.select("path").distinct()))
        large = runtime.written(large.join(paths, "path", "left_anti"), f"large-{level}", scratch)
        if level == levels:
            groups.append(runtime.checkpoint(large.select("path", "rep", "size")))
            break
        # Each bucket picks one of all the choices beyond the first level: buckets of one run must not fail together.
        split = large.select("rep", "path").join(reps.select("rep", "chosen"), "rep")
        pick = f"cast(pmod(path, {n_runs}) as int) * {levels} + 1 + cast(pmod(shiftright(path, 20), {levels - 1}) as int)"
        now = split.select("rep", "path", F.explode(F.expr(f"chosen[{pick}]")).alias("token")).withColumn("path", F.xxhash64("path", "token")).drop("token")
        level += 1
    found = runtime.checkpoint(reduce(DataFrame.union, pairs).distinct())
    runtime.drop(scratch)
    grouped = runtime.checkpoint(reduce(DataFrame.union, groups)) if groups else None
    return found, None if grouped is None or grouped.isEmpty() else grouped


def _least(members: DataFrame, n: int) -> DataFrame:
    """The member least by hash of each of n parts of a bucket (combined before it is shuffled)."""
    parts = members.withColumn("h", F.xxhash64("rep")).withColumn("part", F.pmod(F.col("h"), F.lit(n)))
    row = F.struct("h", "rep", *SKETCH)
    return parts.groupBy("path", "part").agg(F.min(row).alias("m")).select("path", "m.rep", *[f"m.{c}" for c in SKETCH])


def _near_copies(large: DataFrame, threshold: float) -> DataFrame:
    """(path, rep, size): the members of buckets many of whose members are near the bucket's probes."""
    probes = runtime.checkpoint(_least(large, PROBES))
    near = large.alias("a").join(probes.alias("b"), F.expr(f"a.path = b.path and a.rep <> b.rep and {_sizes(threshold)} and {DIFFERENT_BITS} <= {NEAR_BITS}")).select("a.path", "a.rep")
    there = near.union(probes.select("path", "rep")).distinct().groupBy("path").agg(F.count("*").alias("n"))
    alike = there.join(large.groupBy("path").count(), "path").filter(F.col("n") >= NEAR_COPIES * F.col("count")).select("path")
    # Few paths are broadcast, so that the members of a path that very many share stay where they are.
    return runtime.checkpoint(large.join(runtime.broadcast_if_small(runtime.checkpoint(alike)), "path", "left_semi").select("path", "rep", "size"))


def _dealt(grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, block), each rep once, and (x, y, second, rep) with x <= y: what each pair of blocks with a bucket in common
    compares, the sets of either one (second: those of y) that are in a bucket with a set of the other.

    Any two sets of a bucket are so compared in just one pair of blocks. Sets get the least label around them twice, and
    are dealt by the set that comes first in most of their buckets, so that a group, however many buckets it has, is in
    few blocks; nothing but the number of pairs depends on it. What has one label, or one set that comes first, goes to
    as many blocks as its tokens need, by hash.
    """
    labels = runtime.broadcast_if_small(runtime.checkpoint(grouped.groupBy("path").agg(F.min("rep").alias("label"))))
    met = grouped.join(labels, "path")
    own = met.groupBy("rep", "label").count().groupBy("rep").agg(F.max_by("label", F.struct("count", "label")).alias("own"))
    of_reps = met.groupBy("rep").agg(F.min("label").alias("label"))
    labels = runtime.broadcast_if_small(runtime.checkpoint(grouped.join(of_reps, "rep").groupBy("path").agg(F.min("label").alias("label"))))
    of_reps = grouped.join(labels, "path").groupBy("rep").agg(F.min("label").alias("label"), F.max("size").cast("long").alias("size")).join(own, "rep")
    of_reps = runtime.checkpoint(of_reps.select("rep", "label", "own", (F.col("size") + EACH).alias("weight")))

    def parts(*keys: str) -> DataFrame:
        return of_reps.groupBy(*keys).agg(F.ceil(F.sum("weight") / BLOCK_TOKENS).alias("parts"))

    of_label, of_own = parts("label").withColumnRenamed("parts", "of_label"), parts("label", "own").withColumnRenamed("parts", "of_own")
    dealt = of_reps.join(of_own, ["label", "own"]).join(of_label, "label")
    # A set that alone fills blocks has blocks of its own; the others of a label share them.
    own_part = F.when(F.col("of_own") > 1, F.xxhash64("own", F.pmod(F.xxhash64("rep"), F.col("of_own")))).otherwise(F.pmod(F.xxhash64("own"), F.col("of_label")))
    blocks = runtime.checkpoint(dealt.select("rep", F.xxhash64("label", own_part).alias("block")))
    own = grouped.join(blocks, "rep").select("path", "rep", "block")
    met = own.join(own.select("path", F.col("block").alias("other")).distinct(), "path")
    asked = met.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.expr("int(block > other)").alias("second"), "rep")
    return blocks, runtime.checkpoint(asked.distinct())


def _in_common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of xs has in common with each of ys."""
    n, m = len(xs), len(ys)
    _, code = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    cut = sum(map(len, xs))
    row, col = (np.repeat(np.arange(len(z)), [len(t) for t in z]) for z in (xs, ys))
    of_x, of_y = code[:cut], code[cut:]
    k = int(code.max()) + 1
    in_x, in_y = np.bincount(of_x, minlength=k), np.bincount(of_y, minlength=k)
    dense = in_x * in_y >= max(1.0, DENSE * n * m)
    number, n_dense = np.cumsum(dense) - 1, int(dense.sum())
    common = np.zeros((n, m), np.float32)
    step = max(1, (1 << 23) // (n + m))
    here_x, here_y = dense[of_x], dense[of_y]
    rows, at_x, cols, at_y = row[here_x], number[of_x[here_x]], col[here_y], number[of_y[here_y]]
    for lo in range(0, n_dense, step):
        a, b = (np.zeros((size, min(step, n_dense - lo)), np.float32) for size in (n, m))
        for table, which, at in ((a, rows, at_x), (b, cols, at_y)):
            part = (at >= lo) & (at < lo + step)
            table[which[part], at[part] - lo] = 1
        common += a @ b.T
    rare = np.flatnonzero(~here_x & (in_y[of_x] > 0))
    order = np.argsort(of_y, kind="stable")
    first = np.cumsum(in_y) - in_y
    total = np.cumsum(in_y[of_x[rare]])
    lo = 0
    while lo < len(rare):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 22), "right")))
        part = rare[lo:hi]
        many = in_y[of_x[part]]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        other = col[order[np.repeat(first[of_x[part]], many) + within]]
        np.add.at(common.reshape(-1), np.repeat(row[part], many) * m + other, np.float32(1))
        lo = hi
    return common


def _roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a table of links, a row that is connected with it; -1 where it has no link."""
    of_row, of_col = (np.full(k, -1) for k in linked.shape)
    for i in np.flatnonzero(linked.any(1)).tolist():
        rows = np.array([i]) if of_row[i] < 0 else np.zeros(0, int)
        of_row[rows] = i
        while len(rows):
            cols = np.flatnonzero(linked[rows].any(0) & (of_col < 0))
            of_col[cols] = i
            rows = np.flatnonzero(linked[:, cols].any(1) & (of_row < 0))
            of_row[rows] = i
    return of_row, of_col


COMPARED = "rep long, other long, linked long"


def _compare(threshold: float):
    """Of two blocks (x, y), or of one with itself: each set that has a link, a set that it is connected with, and how
    many rows it is linked to. One line a set, however many links there are."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # A row that repeats is one set; sets of one doc_id stand side by side.
        second = table.column("second").to_pylist()
        sides: list[dict] = [{}, {}]
        for s, rep, n, t in zip(second, table.column("rep").to_pylist(), table.column("n").to_pylist(), table.column("tokens").to_pylist(), strict=True):
            sides[s][rep, t] = n
        if key[0] == key[1]:
            sides[1] = sides[0]
        if not sides[0] or not sides[1]:
            return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "other", "linked")})
        ids, weights, sets, starts = [], [], [], []
        for side in sides:
            items = sorted(side.items(), key=lambda e: e[0][0])
            reps = np.array([e[0][0] for e in items], np.int64)
            start = np.flatnonzero(np.r_[True, reps[1:] != reps[:-1]])
            ids.append(reps[start])
            weights.append(np.array([e[1] for e in items], np.float64)[start])
            sets.append([np.frombuffer(e[0][1], U) for e in items])
            starts.append(start)
        common = _in_common(*sets)
        x, y = (np.array([len(t) for t in z], np.float64) for z in sets)
        similar = np.zeros(common.shape, bool)
        for i in range(0, len(x), 256):
            c = common[i : i + 256].astype(np.float64)
            similar[i : i + 256] = c >= threshold * (x[i : i + 256, None] + y - c)
        if len(starts[0]) < len(x) or len(starts[1]) < len(y):
            similar = np.logical_or.reduceat(np.logical_or.reduceat(similar, starts[0], axis=0), starts[1], axis=1)
        alone = key[0] == key[1]
        if alone:
            np.fill_diagonal(similar, False)
        linked = [np.zeros(len(i)) for i in ids]
        for i in range(0, len(ids[0]), 256):
            part = similar[i : i + 256].astype(np.float64)
            linked[0][i : i + 256] = part @ weights[1]
            if not alone:
                linked[1] += weights[0][i : i + 256] @ part
        roots = _roots(similar)
        has = [np.flatnonzero(r >= 0) for r in roots]
        out = (np.concatenate(z).astype(np.int64) for z in ([i[h] for i, h in zip(ids, has)], [ids[0][r[h]] for r, h in zip(roots, has)], [c[h] for c, h in zip(linked, has)]))
        return pa.table(dict(zip(("rep", "other", "linked"), map(pa.array, out))))

    return run


def _not_dealt(pairs: DataFrame, blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs that no pair of blocks compares, so that each link is counted once."""
    at = pairs.join(blocks.select(F.col("rep").alias("a"), F.col("block").alias("p")), "a").join(blocks.select(F.col("rep").alias("b"), F.col("block").alias("q")), "b")
    at = at.select("a", "b", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    asked = asked.select("x", "y", "rep")
    both = at.join(asked.withColumnRenamed("rep", "a"), ["x", "y", "a"], "left_semi").join(asked.withColumnRenamed("rep", "b"), ["x", "y", "b"], "left_semi")
    return pairs.join(both.select("a", "b"), ["a", "b"], "left_anti")


def _fetch_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in _blocks(batch):
            grams, at = _sets(batch.column("text"), i, j)
            blobs = [grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(blobs, pa.binary())], names=["rep", "tokens"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = common >= threshold * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(rep, class_id): the least node of each node's component. edges: (a, b).

    Every round a node takes the least label around it, then its label's label, so paths shorten by half or more.
    """
    both = edges.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(edges.select("b", "a"))
    labels = runtime.checkpoint(both.groupBy("rep").agg(F.least(F.min("other"), F.col("rep")).alias("class_id")))
    while True:
        around = both.join(labels.select(F.col("rep").alias("other"), "class_id"), "other").groupBy("rep").agg(F.min("class_id").alias("near"))
        stepped = labels.join(around, "rep").select("rep", F.least("class_id", "near").alias("class_id"), F.col("class_id").alias("was"))
        stepped = runtime.checkpoint(stepped)
        jump = stepped.select(F.col("rep").alias("class_id"), F.col("class_id").alias("further"))
        after = runtime.checkpoint(stepped.join(jump, "class_id", "left").select("rep", F.least(F.coalesce("further", "class_id"), "class_id").alias("class_id"), "was"))
        labels = after.select("rep", "class_id")
        if after.filter("class_id <> was").isEmpty():
            return labels


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id (least doc_id of its class), n_links, n_copies (other rows of its set).

    Texts whose sets of lower-cased five-word shingles have a Jaccard similarity of `threshold` or more are linked;
    a text of fewer words is one shingle. Classes are connected components. n_links counts the other rows linked to a
    row: its copies, and the rows of every representative that was found and verified as similar, each once.

    Null and empty texts and null ids take no part: class_id is the row's own doc_id, n_links 0. Rows that share a
    doc_id share a class. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runtime.small_batches(docs.sparkSession)
    n_runs = runs_for(threshold, recall)
    scratch: list[str] = []
    signed = docs.mapInArrow(_signatures(n_runs, LEVELS), SIGNATURES)
    known = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    wide = runtime.written(signed, "signatures", scratch)
    rest = [c for c in wide.columns if c not in ("doc_id", "hi", "lo")]
    every = runtime.checkpoint(wide.select("doc_id", "hi", "lo", "size"))
    first = runtime.checkpoint(every.filter(known).groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    reps = wide.filter(known).join(first.select(F.col("rep").alias("doc_id"), "hi", "lo"), ["doc_id", "hi", "lo"], "left_semi").dropDuplicates(["doc_id", "hi", "lo"]).select(F.col("doc_id").alias("rep"), *rest)
    kept: list[str] = []
    reps = runtime.written(reps, "representatives", kept)
    runtime.drop(scratch)
    pairs, grouped = candidates(reps, n_runs, threshold, recall)
    runtime.drop(kept)
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    if grouped is not None:
        blocks, met = _dealt(grouped)
        pairs = runtime.checkpoint(_not_dealt(pairs, blocks, met))
        needed = needed.union(blocks.select("rep"))
    needed = runtime.checkpoint(needed.distinct())
    asked = runtime.broadcast_if_small(needed)
    sets = runtime.written(docs.join(asked, "doc_id", "left_semi").mapInArrow(_fetch_sets, "rep long, tokens binary"), "sets", scratch)
    with_sets = pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b")
    links = runtime.written(with_sets.select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a long, b long"), "links", scratch).distinct()
    links = runtime.checkpoint(links)
    copies = first.select("rep", "n")
    edges = links
    degree = links.union(links.select("b", "a")).join(copies.select(F.col("rep").alias("b"), "n"), "b").select(F.col("a").alias("rep"), F.col("n").alias("linked"))
    if grouped is not None:
        members = met.join(copies.groupBy("rep").agg(F.sum("n").alias("n")), "rep").join(sets, "rep")
        compared = runtime.checkpoint(members.select("x", "y", "second", "rep", "n", "tokens").groupBy("x", "y").applyInArrow(_compare(threshold), COMPARED))
        edges = edges.union(compared.filter("rep <> other").select("rep", "other"))
        degree = degree.union(compared.select("rep", "linked"))
    runtime.drop(scratch)
    classes = components(edges)
    degree = degree.groupBy("rep").agg(F.sum("linked").alias("linked"))
    per_set = first.join(classes, "rep", "left").join(degree, "rep", "left").select("hi", "lo", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    rows = every.select("doc_id", F.when(known, F.col("hi")).alias("hi"), F.when(known, F.col("lo")).alias("lo"))
    out = rows.join(per_set, ["hi", "lo"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def first_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs whose doc_id is their class's least; of rows that share it, one. Rows without words all stay."""
    joined = jaccard_join(docs, threshold, recall)
    extra = runtime.checkpoint(joined.filter("doc_id <> class_id").select("doc_id").distinct())
    kept = runtime.without_ids(docs, extra)
    again = runtime.checkpoint(joined.filter("doc_id = class_id and n_copies > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    repeated = F.col("__again").isNotNull()
    marked = kept.join(again.withColumn("__again", F.lit(1)), "doc_id", "left").select(*[F.col(f"`{c}`") for c in kept.columns], "__again")
    return marked.filter(~repeated).drop("__again").union(marked.filter(repeated).drop("__again").dropDuplicates(["doc_id"]))
