"""Ranking and evaluation metrics as grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import memory as M
from tessera.functions import text as T
from tessera.operators import retrieval, scan
from tessera.sources.shared import cut

# Weights of scenario categories.
CATEGORY_WEIGHTS = {
    "Completion": 0.28, "BugFix": 0.18, "Refactor": 0.10, "TestGen": 0.08, "FeatureAdd": 0.08, "ApiDiscovery": 0.15,
    "ControlFlow": 0.05, "Config": 0.04, "Safety-net": 0.04,
}
CUTOFFS = (1, 5, 10)


def ratio(part: Column, whole: Column, empty: Column | None = None) -> Column:
    """part / whole; `empty` (null by default) where whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(None).cast("double") if empty is None else empty)


#: Ranges in which a group's values are counted.
RANGES = 128


def order_statistics(rows: DataFrame, by: str, value: str, wanted: dict[str, Column]) -> DataFrame:
    """(by, name, value): the values at the wanted places (from 1; expressions over n, the group's count) in order.

    Equal values are counted where they are read; each group's values are counted by ranges that approximate quantiles
    set, and only the range that holds a place is ordered, so no group is gathered in one task or array.
    """
    values = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    per = cut(values.groupBy(by).agg(F.sum("c").alias("n"), F.percentile_approx("v", shares, F.lit(1000)).alias("borders")))
    values = values.join(per.select(by, "borders"), by).withColumn("range", F.size(F.filter("borders", lambda b: b < F.col("v")))).drop("borders")
    ranges = values.groupBy(by, "range").agg(F.sum("c").alias("in_range"))
    upto = F.sum("in_range").over(Window.partitionBy(by).orderBy("range"))
    ranges = ranges.select(by, "range", (upto - F.col("in_range")).alias("before"), upto.alias("upto"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in wanted.items()])
    asked = per.select(by, F.explode(places).alias("p")).select(by, "p.*").join(ranges, by).filter("at > before and at <= upto")
    asked = cut(asked.select(by, "range", "name", (F.col("at") - F.col("before")).alias("nth")))
    inside = F.sum("c").over(Window.partitionBy(by, "range").orderBy("v"))
    ordered = values.join(asked.select(by, "range").distinct(), [by, "range"], "left_semi").withColumn("last", inside)
    hit = ordered.join(asked, [by, "range"]).filter("nth <= last and nth > last - c")
    return hit.select(by, "name", F.col("v").alias("value"))


def quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p95, upper_median, median, p90): three definitions of quantiles that must not be mixed up.

    p50 and p95: the value at index round-half-even(p * (n - 1)); upper_median: at n // 2; median: the mean of the middle
    two; p90: the ninth decile by interpolation at 0.9 * (n + 1), null for a single value.
    """
    n = F.col("n")
    decile = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(0.9) * (n + 1))))

    def nearest(p: float) -> Column:
        return F.least(n - 1, F.bround(F.lit(p) * (n - 1), 0).cast("long")) + 1

    wanted = {"p50": nearest(0.5), "p95": nearest(0.95), "upper_median": F.floor(n / 2) + 1, "lower": F.floor((n + 1) / 2), "decile": decile, "after": decile + 1}
    found = order_statistics(rows, by, value, wanted).groupBy(by).agg(*[F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in wanted])
    counts = rows.groupBy(by).agg(F.count(value).alias("n"))
    out = counts.join(found, by, "left")
    p90 = F.when(n > 1, F.col("decile") + (F.lit(0.9) * (n + 1) - decile) * (F.col("after") - F.col("decile")))
    return out.select(by, "n", "p50", "p95", "upper_median", ((F.col("lower") + F.col("upper_median")) / 2).alias("median"), p90.alias("p90"))


def first_seen(ranked: DataFrame, key: str) -> DataFrame:
    """(qid, key, rank): hits mapped to keys, each key at its first place, ranked anew without gaps."""
    at = ranked.groupBy("qid", key).agg(F.min("rank").alias("at"))
    return at.select("qid", key, F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("rank"))


def per_query(ranked: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row per query with gold: n_gold, first_rank, and hits within each cutoff.

    ranked: qid, id, rank; gold: qid, id.
    """
    found = gold.distinct().join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
    hits = [F.count_if(F.col("rank") <= c).alias(f"hits_{c}") for c in cutoffs]
    return found.groupBy("qid").agg(F.count("*").alias("n_gold"), F.min("rank").alias("first_rank"), *hits)


def summary(scores: DataFrame, by: str | None = None, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """n, mrr, and mean precision, recall and hit rate at each cutoff; by a column and for all (by null) in one pass."""
    measures = [F.count("*").alias("n"), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr")]
    for c in cutoffs:
        measures += [
            F.avg(F.col(f"hits_{c}") / c).alias(f"precision_{c}"),
            F.avg(ratio(F.col(f"hits_{c}"), F.col("n_gold"), F.lit(0.0))).alias(f"recall_{c}"),
            F.avg((F.col(f"hits_{c}") > 0).cast("double")).alias(f"hit_{c}"),
        ]
    return scores.agg(*measures) if by is None else scores.rollup(by).agg(*measures)


def lineage_scores(ranked: DataFrame, gold: DataFrame, tail_of: DataFrame, k: int) -> DataFrame:
    """(qid, newest_recall, stale_latest). ranked: qid, id, rank, latest; gold: qid, id; tail_of: id, tail."""
    top = ranked.filter(F.col("rank") <= k)
    wanted = gold.join(tail_of, "id").select("qid", F.col("tail").alias("id"))
    newest = wanted.join(top.select("qid", "id", F.lit(1).alias("there")).distinct(), ["qid", "id"], "left").groupBy("qid").agg((F.count("there") / F.count("*")).alias("newest_recall"))
    ends = tail_of.select(F.col("tail").alias("id")).distinct()
    wrong = top.filter("latest").join(ends, "id", "left_anti").groupBy("qid").agg(F.count("*").alias("stale_latest"))
    return newest.join(wrong, "qid", "left").select("qid", "newest_recall", F.coalesce("stale_latest", F.lit(0)).alias("stale_latest"))


def scenario_score(kind: Column, expected: Column, returned: Column, k: Column) -> Column:
    """exact_symbol: first; in_top_k (k: 5 if null); exact_set: F1; contains: share of the expected. Arrays of ids."""
    one = F.try_element_at(expected, F.lit(1))
    common = F.size(F.array_intersect(expected, returned))
    n, m = F.size(F.array_distinct(expected)), F.size(F.array_distinct(returned))
    f1 = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2.0 * common / (n + m))
    held = F.size(F.filter(expected, lambda x: F.array_contains(returned, x)))
    cases = F.when(kind == "exact_symbol", F.coalesce((F.try_element_at(returned, F.lit(1)) == one).cast("double"), F.lit(0.0)))
    cases = cases.when(kind == "in_top_k", F.coalesce(F.array_contains(F.slice(returned, F.lit(1), F.coalesce(k, F.lit(5))), one).cast("double"), F.lit(0.0)))
    cases = cases.when(kind == "exact_set", f1).when(kind == "contains", F.when(F.size(expected) == 0, 1.0).otherwise(held / F.size(expected)))
    return cases.otherwise(0.0)


def weighted_accuracy(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(n, raw, weighted): mean score, and the mean of category means by weight over the categories there are."""
    table = F.create_map(*[F.lit(x) for kv in (weights or CATEGORY_WEIGHTS).items() for x in kv])
    per = scores.groupBy("category").agg(F.avg("score").alias("mean"), F.sum("score").alias("total"), F.count("*").alias("n"))
    per = per.withColumn("w", F.coalesce(F.try_element_at(table, F.col("category")), F.lit(0.0)))
    return per.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("raw"), F.coalesce(ratio(F.sum(F.col("mean") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("weighted"))


def slices(rows: DataFrame, keys: str, measures: dict[str, Column], none: str = "(none)") -> DataFrame:
    """Means by each value of an array column; a row without values counts under (none)."""
    exploded = rows.withColumn("slice", F.explode(F.when(F.size(keys) == 0, F.array(F.lit(none))).otherwise(F.col(keys))))
    return exploded.groupBy("slice").agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in measures.items()])


def overlap_histogram(found: DataFrame, rankers: list[str]) -> DataFrame:
    """(found_by, n): how many rows each set of rankers found. found: a boolean column per ranker."""
    names = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in rankers]))
    label = F.when(F.size(names) == 0, "(none)").otherwise(F.array_join(names, " & "))
    return found.groupBy(label.alias("found_by")).agg(F.count("*").alias("n"))


def fusion_leaderboard(lists: dict[str, DataFrame], gold: DataFrame, depth: int = 20, k: int = M.RRF_K) -> DataFrame:
    """(combination, mrr, recall): every ranker and every fusion of two or more, in one plan.

    Each ranker is a bit; a hit is dealt to all sets of rankers that hold its bit, and one grouped sum fuses them all.
    """
    names = list(lists)
    rows = [df.select("qid", "id", "rank", F.lit(1 << i).alias("bit")) for i, df in enumerate(lists.values())]
    hits = reduce(DataFrame.union, rows)
    sets = F.array(*[F.lit(m) for m in range(1, 1 << len(names))])
    dealt = hits.withColumn("mask", F.explode(F.filter(sets, lambda m: m.bitwiseAND(F.col("bit")) > 0)))
    fused = dealt.groupBy("mask", "qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    order = Window.partitionBy("mask", "qid").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    masks = gold.distinct().withColumn("mask", F.explode(sets))
    found = masks.join(ranked.select("mask", "qid", "id", "rank"), ["mask", "qid", "id"], "left")
    per = found.groupBy("mask", "qid").agg(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"), (F.count("rank") / F.count("*")).alias("recall"))
    label = F.array_join(F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(n)) for i, n in enumerate(names)])), "+")
    return per.groupBy(label.alias("combination")).agg(F.avg("rr").alias("mrr"), F.avg("recall").alias("recall"))


def matches(points: DataFrame, memories: DataFrame, threshold: float) -> DataFrame:
    """(point, id, coverage): the memories that cover at least `threshold` of a point's content words.

    points: point, words; memories: id, words. A block of points is held against all memories in one pass, and only
    matches leave it. With more points a memory that lacks a point's rarest words beyond what the threshold allows cannot
    match, so pairs start from those words alone; common words are only counted for the pairs found.
    """
    numbered = cut(points.select("point", "words").withColumn("qid", F.monotonically_increasing_id()))
    if numbered.count() <= scan.WORD_LISTS:
        found = scan.covering(memories, numbered, threshold)
        return found.join(F.broadcast(numbered), "qid").select("point", "id", (F.col("hits") / F.size("words")).alias("coverage"))
    asked = points.select("point", F.size("words").alias("n"), F.explode("words").alias("w")).groupBy("point", "n", "w").agg(F.count("*").alias("times"))
    asked = cut(asked)
    wanted = asked.select("w").distinct()
    held = memories.select("id", F.explode(F.array_distinct("words")).alias("w")).join(wanted, "w", "left_semi")
    held = cut(held)
    common = held.groupBy("w").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("point").orderBy("df", "w").rowsBetween(Window.unboundedPreceding, -1)
    ranked = asked.join(common, "w").withColumn("before", F.coalesce(F.sum("times").over(rarest), F.lit(0)))
    # What no memory has is missing everywhere.
    absent = asked.join(common, "w", "left_anti").groupBy("point").agg(F.sum("times").alias("absent"))
    ranked = ranked.join(absent, "point", "left").withColumn("spare", F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) - F.coalesce("absent", F.lit(0)))
    pairs = ranked.filter("before <= spare").select("point", "w").join(held, "w").select("point", "id").distinct()
    counted = pairs.join(asked, "point").join(held, ["id", "w"]).groupBy("point", "n", "id").agg(F.sum("times").alias("hit"))
    return counted.select("point", "id", (F.col("hit") / F.col("n")).alias("coverage")).filter(F.col("coverage") >= threshold)


def best_match(points: DataFrame, memories: DataFrame, threshold: float) -> DataFrame:
    """(point, id, coverage): the memory that covers most of a point's content words, the first of equals.

    points: point, words; memories: id, ordinal, words.
    """
    met = matches(points, memories, threshold).join(memories.select("id", "ordinal"), "id")
    best = met.groupBy("point").agg(F.max_by(F.struct("id", "coverage"), F.struct("coverage", -F.col("ordinal"))).alias("b"))
    return best.select("point", "b.id", "b.coverage")


def update_rate(points: DataFrame, originals: DataFrame, memories: DataFrame, threshold: float = 0.55) -> DataFrame:
    """One row: update_hits, update_total, update_rate (null without any).

    points: point, words, is_update; originals: point, words (one row per earlier memory of the point); memories: id,
    ordinal, words, supersedes_id. An update is a hit when its best memory supersedes the best memory of an original.
    """
    due = points.filter("is_update").join(originals.select("point").distinct(), "point", "left_semi")
    new = best_match(due, memories, threshold).join(memories.select("id", "supersedes_id"), "id").select("point", "supersedes_id")
    numbered = originals.select(F.struct("point", "words").alias("point"), "words").distinct()
    old = best_match(numbered, memories, threshold).select(F.col("point.point").alias("point"), F.col("id").alias("supersedes_id")).distinct()
    hits = new.join(old, ["point", "supersedes_id"], "left_semi").agg(F.count("*").alias("update_hits"))
    row = hits.crossJoin(due.agg(F.count("*").alias("update_total")))
    return row.withColumn("update_rate", ratio(F.col("update_hits"), F.col("update_total")))


def bank_score(points: DataFrame, memories: DataFrame, threshold: float = 0.55) -> DataFrame:
    """One row: covered targets, resisted interference, precision, recall and F1 of a memory bank.

    points: point, words, interference.
    """
    met = cut(matches(points, memories, threshold).select("point", "id"))
    per = points.join(met.select("point", F.lit(1).alias("found")).distinct(), "point", "left").agg(
        F.count_if(~F.col("interference")).alias("target_points"),
        F.count_if(~F.col("interference") & F.col("found").isNotNull()).alias("covered"),
        F.count_if(F.col("interference")).alias("noise"),
        F.count_if(F.col("interference") & F.col("found").isNull()).alias("resisted"),
    )
    precise = met.join(points.filter("not interference").select("point"), "point", "left_semi").agg(F.countDistinct("id").alias("precise"))
    row = per.crossJoin(precise).crossJoin(memories.agg(F.count("*").alias("memories")))
    recall, precision = ratio(F.col("covered"), F.col("target_points"), F.lit(0.0)), ratio(F.col("precise"), F.col("memories"), F.lit(0.0))
    row = row.withColumn("recall", recall).withColumn("precision", precision)
    f1 = F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision")))
    return row.withColumn("f1", f1).withColumn("resistance", ratio(F.col("resisted"), F.col("noise")))


def judged(records: DataFrame) -> DataFrame:
    """One row of judge ratios; unscored records stay in the denominators.

    records: part (integrity, accuracy, update, qa), score (null: unscored), importance, flag (interference of
    integrity, target of accuracy), label (of update and qa).
    """
    def n(cond: Column) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False)))

    def total(value: Column, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))

    whole = (F.col("part") == "integrity") & ~F.col("flag")
    noise = (F.col("part") == "integrity") & F.col("flag")
    target = (F.col("part") == "accuracy") & F.col("flag")
    measures = [
        ratio(n(whole & (F.col("score") == 2)), n(whole)).alias("recall"),
        ratio(total(0.5 * F.col("score") * F.col("importance"), whole), total(F.col("importance"), whole)).alias("weighted_recall"),
        ratio(total(0.5 * F.col("score"), target), n(target)).alias("target_accuracy"),
        ratio(n(noise & (F.col("score") == 0)), n(noise)).alias("resistance"),
    ]
    for part in ("update", "qa"):
        for label in ("Correct", "Hallucination", "Omission"):
            here = F.col("part") == part
            measures.append(ratio(n(here & (F.col("label") == label)), n(here)).alias(f"{part}_{label.lower()}"))
    out = records.agg(*measures)
    f1 = F.when(F.col("recall") + F.col("target_accuracy") > 0, 2 * F.col("recall") * F.col("target_accuracy") / (F.col("recall") + F.col("target_accuracy")))
    return out.withColumn("f1", f1)


def combined_judgements(*record_sets: DataFrame) -> DataFrame:
    """The judge's ratios over all record sets together, which is not the mean of their ratios."""
    return judged(reduce(lambda a, b: a.unionByName(b), record_sets))


def scenario_summary(rows: DataFrame, deferred: list[str]) -> DataFrame:
    """(level, key, n, avg): mean scores of all scenarios (raw), the weighted mean of categories, those that one hop
    can answer and the deferred, and of each category, op and sub-type.

    rows: category, op, sub_type, score; deferred: sub-types that count apart.
    """
    late = F.col("sub_type").isin(deferred) if deferred else F.lit(False)
    part = F.when(late, "deferred").otherwise("supported")
    keyed = rows.withColumn("keys", F.array(*[F.struct(F.lit(level).alias("level"), key.alias("key")) for level, key in (("raw", F.lit("all")), ("part", part), ("category", F.col("category")), ("op", F.col("op")), ("sub_type", F.col("sub_type")))]))
    per = keyed.select(F.explode("keys").alias("k"), "score").groupBy("k.level", "k.key").agg(F.count("*").alias("n"), F.avg("score").alias("avg"))
    weighted = weighted_accuracy(rows).select(F.lit("weighted").alias("level"), F.lit("all").alias("key"), "n", F.col("weighted").alias("avg"))
    return per.union(weighted)


def evidence_recall(ranked: DataFrame, evidence: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(category, n, mrr, recall_.., hit_..) of dialog turns found as evidence, by category and over all (null).

    ranked: qid, turn_id, rank (a turn may come back in several hits: its first place counts, ranked anew);
    evidence: qid, category, turn_id. Questions without evidence have no rows and do not count.
    """
    turns = first_seen(ranked.filter("turn_id is not null"), "turn_id").select("qid", F.col("turn_id").alias("id"), "rank")
    per = per_query(turns, evidence.select("qid", F.col("turn_id").alias("id")), cutoffs)
    named = per.join(evidence.select("qid", "category").distinct(), "qid")
    out = summary(named, "category", cutoffs)
    return out.select("category", "n", "mrr", *[f"{m}_{c}" for c in cutoffs for m in ("recall", "hit")])


def reach_shares(gold: DataFrame) -> DataFrame:
    """One row: how many gold files there are, and the shares that are indexed, within one and two hops, ranked, and
    within a hop but not ranked. gold: indexed, hop1, hop2 (booleans), rank (null: not ranked)."""
    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    return gold.agg(F.count("*").alias("gold_files"), share(F.col("indexed")).alias("indexed"), share(F.col("hop1")).alias("in_hop1"), share(F.col("hop2")).alias("in_hop2"), share(F.col("rank").isNotNull()).alias("ranked"), share(F.col("hop1") & F.col("rank").isNull()).alias("hop1_not_ranked"))


def missing(required: DataFrame, available: DataFrame) -> DataFrame:
    """What is required and not available, each once."""
    return required.distinct().exceptAll(available.distinct())


def write_quality(memories: DataFrame, facts: DataFrame, links: DataFrame, fact_links: DataFrame) -> DataFrame:
    """One row per case: covered and exclusive facts, satisfied and all linked pairs, number of memories and the mean
    and greatest length of their texts (0 without any).

    memories: case_id, id, text (folded); facts: case_id, fact, must (array); links: id, other (stored direction);
    fact_links: case_id, fact, other.
    """
    # Few facts go to the texts, which stay where they are read; what is left is read four times.
    hosted = cut(retrieval.small(facts).join(memories, "case_id").filter(F.forall("must", lambda p: F.contains(F.col("text"), F.lower(p)))).select("case_id", "fact", "id"))
    alone = hosted.withColumn("n", F.count("*").over(Window.partitionBy("case_id", "id"))).groupBy("case_id", "fact").agg((F.min("n") == 1).alias("alone"))
    per = facts.join(alone, ["case_id", "fact"], "left").groupBy("case_id").agg(F.count("*").alias("facts"), F.count("alone").alias("covered"), F.count_if("alone").alias("exclusive"))
    pairs = fact_links.join(facts.select("case_id", F.col("fact").alias("other")), ["case_id", "other"])
    pairs = pairs.withColumn("a", F.least("fact", "other")).withColumn("b", F.greatest("fact", "other")).dropDuplicates(["case_id", "a", "b"])
    left = retrieval.small(pairs).join(hosted.withColumnRenamed("id", "one"), ["case_id", "fact"]).select("case_id", "a", "b", "other", "one")
    right = hosted.select("case_id", F.col("fact").alias("other"), F.col("id").alias("two"))
    # The other fact's memory is the same one or at the end of a link: all of one fact with all of the other never meet.
    linked = left.join(links.select(F.col("id").alias("one"), F.col("other").alias("two")), "one").select("case_id", "a", "b", "other", "two")
    ends = left.select("case_id", "a", "b", "other", F.col("one").alias("two")).union(linked)
    ok = ends.join(right, ["case_id", "other", "two"], "left_semi").select("case_id", "a", "b").distinct().groupBy("case_id").agg(F.count("*").alias("link_hits"))
    total = pairs.groupBy("case_id").agg(F.count("*").alias("link_total"))
    lengths = memories.groupBy("case_id").agg(F.count("*").alias("memories"), F.bround(F.avg(F.char_length("text")), 0).cast("long").alias("mean_chars"), F.max(F.char_length("text")).cast("long").alias("max_chars"))
    out = per.join(ok, "case_id", "left").join(total, "case_id", "left").join(lengths, "case_id", "left")
    return out.select("case_id", "facts", "covered", "exclusive", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("link_hits", "link_total", "memories", "mean_chars", "max_chars")])


def budgeted(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows of each query, in rank order, while their tokens add up to the budget or less. ranked: qid, rank, tokens."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("used", F.sum("tokens").over(w)).filter(F.col("used") <= budget)


def payload_arms(rows: DataFrame, baseline: str) -> DataFrame:
    """(arm, n, tokens, change): totals by arm, and their relative change from the baseline. rows: arm, text."""
    per = rows.groupBy("arm").agg(F.count("*").alias("n"), F.sum(T.token_estimate("text")).alias("tokens"))
    base = per.filter(F.col("arm") == baseline).select(F.col("tokens").alias("base"))
    return per.join(F.broadcast(base)).select("arm", "n", "tokens", (F.col("tokens") / F.col("base") - 1).alias("change"))


def paired(rows: DataFrame) -> DataFrame:
    """One row: questions right in both arms, in one alone, in none. rows: qid, base_ok, this_ok."""
    b, t = F.col("base_ok"), F.col("this_ok")
    return rows.agg(F.count_if(b & t).alias("both_ok"), F.count_if(b & ~t).alias("only_base"), F.count_if(~b & t).alias("only_this"), F.count_if(~b & ~t).alias("neither"))


def recent_turns(messages: DataFrame, keep: int = 12) -> DataFrame:
    """System messages and the last `keep` others of each conversation. messages: conv_id, turn, role."""
    nth = F.row_number().over(Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.desc("turn")))
    return messages.withColumn("nth", nth).filter((F.col("role") == "system") | (F.col("nth") <= keep)).drop("nth")
