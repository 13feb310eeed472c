"""Operator 5, mixing sources to target weights by pivotal dependent rounding. DataFrame and SQL functions only.

A document of a source with target t and size s is due t / s copies. Whole copies are certain; the fractions are
rounded in pairs: mass (words) moves at random from one to the other until one is a whole copy or none, in
expectation nothing changes, and the words taken in all stay the same. Bounded groups of documents do this by
themselves; what each leaves over (one fractional document at most) goes up a reduction tree to the next group, so a
source ends within one document of its target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import runtime

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Documents in a group of the tree (mean at the leaves, at most above them).
GROUP = 64
SEED = 11
#: Sources up to this many are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 20_000

#: Arrays of units sort by their first fields: long documents round first, so that what is left over is short.
_UNIT = "struct<o:bigint,k:bigint,doc_id:bigint,size:bigint,whole:int,m:double>"
_DONE = "struct<doc_id:bigint,size:bigint,copies:int>"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, n, source_size, target): shares of `share` times all sizes by weight, none above cap times its own size.

    A level L gives each source min(cap * size, L * weight); L is the one whose sum is the whole share. Sources are
    taken in the order in which a rising level fills them.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    cases = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    query = f"""
        with weighed as (
            select *, cast(case (row_number() over (order by source asc nulls last) - 1) % {len(weights)} {cases} end as double) w,
                   {float(cap)}D * source_size as most, {float(share)}D * sum(source_size) over () as all_share from {{per}}),
        filled as (
            select *, sum(w) over () - coalesce(sum(w) over before, 0D) as w_left, all_share - coalesce(sum(most) over before, 0D) as share_left
            from weighed window before as (order by most / w, source rows between unbounded preceding and 1 preceding)),
        levelled as (
            select *, min(if(most / w * w_left >= share_left, struct(most / w as r, source, share_left / w_left as l), null)) over () as at_level from filled)
        select source, n, source_size, least(most, coalesce(at_level.l, 0D) * w) as target from levelled"""
    return sized.sparkSession.sql(query, per=per)


def _fold(level: int) -> str:
    u = f"(pmod(xxhash64({SEED}, {level}, acc.p.k, x.k), 9007199254740992) / 9007199254740992D)"
    moved = "named_struct('i', acc.p, 'j', x, 'room_i', acc.p.size - acc.p.m, 'room_j', x.size - x.m, 'u', " + u + ")"
    up = "v.u * (least(v.room_i, v.j.m) + least(v.room_j, v.i.m)) < least(v.room_j, v.i.m)"

    def with_mass(unit: str, mass: str) -> str:
        return f"named_struct('o', {unit}.o, 'k', {unit}.k, 'doc_id', {unit}.doc_id, 'size', {unit}.size, 'whole', {unit}.whole, 'm', {mass})"

    def done(unit: str, when: str, on: int) -> str:
        return f"if({when}, array(named_struct('doc_id', {unit}.doc_id, 'size', {unit}.size, 'copies', {unit}.whole + {on})), cast(array() as array<{_DONE}>))"

    left = f"""case when w.up and v.room_i < v.j.m then {with_mass("v.j", "v.j.m - v.room_i")}
                    when w.up and v.j.m < v.room_i then {with_mass("v.i", "v.i.m + v.j.m")}
                    when not w.up and v.room_j < v.i.m then {with_mass("v.i", "v.i.m - v.room_j")}
                    when not w.up and v.i.m < v.room_j then {with_mass("v.j", "v.j.m + v.i.m")} end"""
    finished = ", ".join([done("v.i", "w.up and v.room_i <= v.j.m", 1), done("v.j", "w.up and v.j.m <= v.room_i", 0), done("v.j", "not w.up and v.room_j <= v.i.m", 1), done("v.i", "not w.up and v.i.m <= v.room_j", 0)])
    step = f"element_at(transform(array({moved}), v -> element_at(transform(array(named_struct('up', {up})), w -> named_struct('p', {left}, 'done', concat(acc.done, {finished}))), 1)), 1)"
    start = f"named_struct('p', cast(null as {_UNIT}), 'done', cast(array() as array<{_DONE}>))"
    return f"aggregate(array_sort(units), {start}, (acc, x) -> if(acc.p is null, named_struct('p', x, 'done', acc.done), {step}))"


def _rounded(units: DataFrame, most_per_source: int) -> list[DataFrame]:
    """(source, doc_id, size, copies) of all units, level by level of the tree."""
    out = []
    groups = max(1, -(-most_per_source // GROUP))
    now = units.withColumn("g", F.pmod(F.col("unit.k"), F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP))).cast("long")).select("source", "g", "unit")
    level = 0
    while True:
        folded = now.groupBy("source", "g").agg(F.collect_list("unit").alias("units")).select("source", "g", F.expr(_fold(level)).alias("f"))
        folded = runtime.checkpoint(folded)
        out.append(folded.select("source", F.explode("f.done").alias("unit")).select("source", "unit.doc_id", "unit.size", "unit.copies"))
        rest = folded.filter("f.p is not null")
        if groups <= 1:
            on = f"if(pmod(xxhash64({SEED}, 'last', f.p.k), 9007199254740992) / 9007199254740992D * f.p.size < f.p.m, 1, 0)"
            out.append(rest.select("source", F.col("f.p.doc_id").alias("doc_id"), F.col("f.p.size").alias("size"), (F.col("f.p.whole") + F.expr(on)).cast("int").alias("copies")))
            return out
        groups = -(-groups // GROUP)
        now = rest.select("source", F.floor(F.col("g") / GROUP).cast("long").alias("g"), F.col("f.p").alias("unit"))
        level += 1


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per input row: doc_id, source, size (words), source_size, target (its source's), copies, taken.

    Sources in code point order (null last) weigh `weights`, repeated, and share `share` times all words; none gets
    more than cap times its own, the excess goes to the others by weight. taken = copies * size; copies are whole and
    at most cap. Randomness comes from hashes of ids, so reruns agree.

    Null and empty texts have size 0 and take nothing (0 copies short of a whole one). Null ids and sources are values
    like others. Rows of one id, source and size are rounded together and share their copies as evenly as they go. An
    empty table gives an empty result. Extra columns are ignored.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = runtime.checkpoint(sized)
    sources = runtime.checkpoint(source_targets(sized, weights, share, cap))
    head = sources.agg(F.count("*").alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    side = F.broadcast(sources) if head["n"] <= BROADCAST_SOURCES else sources
    due = sized.alias("d").join(side.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.source", "d.doc_id", "d.size", "s.n", "s.source_size", "s.target")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    # Rows that are alike in id, source and size make one unit, however many they are.
    alike = due.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("n", "source_size", "target")])
    mass = (rate - F.floor(rate)) * F.col("size") * F.col("rows")
    more = F.when(F.col("size") > 0, F.floor(mass / F.col("size"))).otherwise(0)
    due = alike.withColumn("whole", (F.floor(rate) * F.col("rows") + more).cast("int")).withColumn("m", mass - more * F.col("size"))
    due = runtime.checkpoint(due)
    open_ = (F.col("m") > 0) & (F.col("m") < F.col("size"))
    units = due.filter(open_).select("source", "n", F.struct((-F.col("size")).alias("o"), F.xxhash64(F.lit(SEED), "doc_id", "size").alias("k"), "doc_id", "size", "whole", "m").alias("unit"))
    certain = due.filter(~open_).select("source", "doc_id", "size", F.col("whole").alias("copies"))
    rounded = reduce(DataFrame.union, _rounded(units, head["most"]), certain)
    several = due.filter("rows > 1").select("source", "doc_id", "size", "rows")
    one_each = rounded
    if not several.isEmpty():
        same = F.col("d.source").eqNullSafe(F.col("a.source")) & F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.size") == F.col("a.size"))
        shared = rounded.alias("d").join(several.alias("a"), same, "left").select("d.*", F.coalesce("a.rows", F.lit(1)).alias("rows"))
        shared = shared.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        copies = F.expr("cast(copies div rows as int)") + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("int")
        one_each = shared.select("source", "doc_id", "size", copies.alias("copies"))
    out = one_each.alias("d").join(side.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "d.copies", (F.col("d.copies") * F.col("d.size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0 to cap times). Rows that share id and source share their
    copies, the first by text the odd ones."""
    taken = {c.lower() for c in docs.columns}
    at, source, copies, n_rows, times, time = (next(f"{'_' * i}{c}" for i in range(1, len(taken) + 2) if f"{'_' * i}{c}" not in taken) for c in ("id", "source", "copies", "rows", "times", "time"))
    due = mix(docs, weights, share, cap).groupBy("doc_id", "source").agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(n_rows))
    due = runtime.checkpoint(due.select(F.col("doc_id").alias(at), F.col("source").alias(source), copies, n_rows))
    same = F.col("doc_id").eqNullSafe(F.col(at)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    rows = docs.join(due, same)
    alone = rows.filter(F.col(n_rows) == 1).withColumn(times, F.col(copies))
    nth = F.row_number().over(Window.partitionBy(at, source).orderBy("text"))
    shared = rows.filter(F.col(n_rows) > 1).withColumn(times, F.expr(f"cast({copies} div {n_rows} as int)") + (nth <= F.col(copies) % F.col(n_rows)).cast("int"))
    out = alone.unionByName(shared).filter(F.col(times) > 0)
    return out.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
