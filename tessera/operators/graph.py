"""Code graph: one-hop references, node sets, name search, ambiguity, reference resolution, edges, reach.

nodes: id, kind, name, file_path, start_line, end_line; edges: source, target, kind, line. All operators take many
questions at once and join on node ids or names.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import scan, topk
from tessera.sources.shared import cut, shuffled, tasks

REFERENCE_EDGES = ("calls", "references", "implements")
# How candidates of a reference are scored, and how many ties are kept.
SAME_FILE, SAME_DIRECTORY, SAME_TOP, PREFERRED, QUALIFIED, NAMED_FILE, TEST_PENALTY, EXAMPLE_PENALTY = 100, 50, 20, 15, 40, 25, 40, 20
TIES_IN_FILE, TIES = 8, 4
# Scores of hinted candidates, and how many are listed.
BASE, FILE_HINT, KIND_HINT, SCOPE_HINT, CANDIDATES = 0.5, 0.4, 0.2, 0.1, 20


def references(edges: DataFrame, nodes: DataFrame, asked: DataFrame, incoming: bool, kinds: tuple[str, ...] = REFERENCE_EDGES) -> DataFrame:
    """(asked, id, kind, line): one row per edge into (or out of) each asked node. asked: asked."""
    here, there = ("target", "source") if incoming else ("source", "target")
    found = edges.filter(F.col("kind").isin(*kinds)).join(asked, F.col(here) == F.col("asked"))
    return found.join(nodes.select("id"), F.col(there) == F.col("id")).select("asked", "id", "kind", "line")


def neighbours(edges: DataFrame, nodes: DataFrame, asked: DataFrame, incoming: bool, kinds: tuple[str, ...] = ("calls", "references")) -> DataFrame:
    """Distinct nodes on the other end of edges of a whole set of nodes."""
    here, there = ("target", "source") if incoming else ("source", "target")
    ids = edges.filter(F.col("kind").isin(*kinds)).join(asked, F.col(here) == F.col("asked"), "left_semi").select(F.col(there).alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = tuple(P.CALL_KINDS)) -> DataFrame:
    """Nodes of the kinds that nothing calls."""
    called = edges.filter("kind = 'calls'").select(F.col("target").alias("id"))
    return nodes.filter(F.col("kind").isin(*kinds)).join(called, "id", "left_anti")


#: Symbols, and askers, of a file in one list (the pairs of two lists are in memory at once); lists that are cut from what is
#: gathered by a hash; places for each task where the lists of a file meet.
MET, ASKERS, GATHERED, PLACES = 256, 16, 16, 4


def members(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id): contained symbols; for a node that contains none, the other symbols of its file.

    The second kind grows with the square of a file's symbols; what is shuffled for it does not. Askers go in lists of
    ASKERS, symbols in lists of MET. Those of a file are cut into groups, of which a side has no more than the root of all
    places, and every pair of groups meets in a place of its own: a list is copied as often as there are groups on the other
    side, however many rows there are. Rows leave a place by pairs of lists, so the same MET ids come again and again, which
    column formats write in little room (bits of numbers repeat as bytes, since MET is a multiple of eight).
    """
    symbols = nodes.filter("kind <> 'file'").select("id", F.col("file_path").alias("path"))
    inside = cut(edges.filter("kind = 'contains'").join(asked, F.col("source") == F.col("asked")).join(symbols.select("id"), F.col("target") == F.col("id")).select("asked", "id").distinct())
    alone = _few(asked.join(inside, "asked", "left_anti"))
    empty = cut(alone.join(nodes.select(F.col("id").alias("asked"), F.col("file_path").alias("path")), "asked"))
    symbols = cut(symbols.join(_few(empty.select("path").distinct()), "path", "left_semi"))

    def lists(rows: DataFrame, length: int, name: str) -> DataFrame:
        return rows.groupBy("path").agg(F.ceil(F.count("*") / length).alias(name))

    sizes = _few(lists(empty, ASKERS, "across").join(lists(symbols, MET, "down"), "path"))
    n = tasks(nodes.sparkSession)
    most = F.lit(math.ceil(math.sqrt(PLACES * n))).cast("long")

    def dealt(rows: DataFrame, length: int, column: str, own: str, other: str) -> DataFrame:
        met = rows.join(sizes, "path").withColumn("part", F.pmod(F.xxhash64(column), F.ceil(F.col(own) / GATHERED)))
        met = met.groupBy("path", "across", "down", "part").agg(F.collect_list(column).alias("all"))
        cut_up = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(length)), lambda i: F.slice("all", i, F.lit(length)))
        met = met.select("path", "across", "down", "part", F.posexplode(cut_up).alias("nth", f"{column}s"))
        group, others = F.pmod(F.col("part") * GATHERED + F.col("nth"), F.least(own, most)), F.sequence(F.lit(0).cast("long"), F.least(other, most) - 1)
        return met.select("path", f"{column}s", group.alias(f"{own}_at"), F.explode(others).alias(f"{other}_at"))

    keys = ["path", "across_at", "down_at"]
    left, right = (rows.repartition(n, *keys) for rows in (dealt(empty, ASKERS, "asked", "across", "down"), dealt(symbols, MET, "id", "down", "across")))
    pairs = left.hint("merge").join(right, keys).select(F.explode("askeds").alias("asked"), "ids")
    return inside.union(pairs.select("asked", F.explode("ids").alias("id")))


def implementors(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    return neighbours(edges, nodes, asked, True, ("implements",))


HINTS = ("file", "kind_hint", "scope")


def find(nodes: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, id, tier, rank, total_matches): names that contain the query, caseless, best first.

    Tiers: 0 exact, 1 equal but for case, 2 begins with it, 3 has it inside. queries: qid, query, and any of file,
    kind_hint and scope, all of which must fit where they are not null.
    """
    name, q = F.lower("name"), F.lower("query")
    kept = nodes.filter("kind <> 'file'")
    pairs = scan.containing(kept.select("id", name.alias("text")), queries.select("qid", F.lower(F.trim("query")).alias("needle")))
    found = pairs.join(kept, "id").join(queries.withColumn("query", F.trim("query")), "qid")
    given = [F.col(h) if h in queries.columns else F.lit(None).cast("string") for h in HINTS]
    if any(h in queries.columns for h in HINTS):
        found = hinted(found, *given).filter("matched")
    tier = F.when(F.col("name") == F.col("query"), 0).when(name == q, 1).when(F.startswith(name, q), 2).otherwise(3)
    out = found.select("qid", "id", "name", tier.alias("tier"), P.kind_score(F.col("kind")).alias("priority"), F.octet_length("name").alias("bytes"), "file_path", "start_line")
    order = [("tier", "ascending"), ("priority", "descending"), *[(c, "ascending") for c in ("bytes", "file_path", "start_line", "id")]]
    return topk.first_k(out, ["qid"], order, limit, "total_matches").select("qid", "id", "name", "tier", "rank", "total_matches")


def hinted(nodes: DataFrame, file: Column, kind: Column, scope: Column) -> DataFrame:
    """Adds score (0 to 1) and matched (all given hints fit). A null hint is not given."""
    score = F.lit(BASE)
    score = score + F.when(file.isNotNull() & P.hinted(F.col("file_path"), file), FILE_HINT).otherwise(0.0)
    kind_fits = F.lower("kind") == F.lower(F.trim(kind))
    score = score + F.when(kind.isNull(), P.kind_score(F.col("kind"))).when(kind_fits, KIND_HINT).otherwise(0.0)
    scope_fits = P.in_scope(F.col("file_path"), P.normalized(scope))
    score = score + F.when(scope.isNotNull() & scope_fits, SCOPE_HINT).otherwise(0.0)
    fits = F.coalesce(P.hinted(F.col("file_path"), file), F.lit(True)) & F.coalesce(kind_fits, F.lit(True)) & F.coalesce(scope_fits, F.lit(True))
    return nodes.withColumn("score", F.least(F.lit(1.0), score)).withColumn("matched", fits)


def pick(nodes: DataFrame, asked: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(qid, id, status, score, rank, total): the node that a name and its hints mean, or the candidates.

    asked: qid, name, file, kind_hint, scope (hints may be null). One node of the name, or one that fits all hints, is
    `ok`; else `ambiguous`: those that fit if any do, else all of the name.
    """
    return _picked(nodes.filter("kind <> 'file'").join(asked, "name"), limit)


def _picked(rows: DataFrame, limit: int) -> DataFrame:
    rows = hinted(rows, F.col("file"), F.col("kind_hint"), F.col("scope"))
    w = Window.partitionBy("qid")
    # Whether those that fit are all that counts, is known when all have been counted: the first of both are kept.
    fits = F.coalesce(F.col("file"), F.col("kind_hint"), F.col("scope")).isNotNull() & F.col("matched")
    rows = rows.select("qid", "id", "score", fits.alias("fits"), F.round("score", 9).alias("s"), F.octet_length("file_path").alias("bytes"))
    order = [("s", "descending"), ("bytes", "ascending"), ("id", "ascending")]
    rows = topk.partial_firsts(rows, ["qid", "fits"], order, limit)
    rows = rows.withColumn("all", F.sum("n").over(w)).withColumn("n_fit", F.sum(F.when(F.col("fits"), F.col("n")).otherwise(0)).over(w))
    rows = rows.filter((F.col("all") == 1) | (F.col("n_fit") == 0) | F.col("fits"))
    status = F.when((F.col("all") == 1) | (F.col("n_fit") == 1), "ok").otherwise("ambiguous")
    total = F.when((F.col("all") == 1) | (F.col("n_fit") == 0), F.col("all")).otherwise(F.col("n_fit"))
    out = rows.withColumn("status", status).withColumn("rank", F.row_number().over(w.orderBy(F.desc("s"), "bytes", "id"))).withColumn("total", total)
    return out.filter(F.col("rank") <= limit).select("qid", "id", "status", "score", "rank", "total")


#: What a candidate's score depends on besides its place, and the places a question looks at, the nearest first.
FEATURES = ("kind", "named_file", "is_test", "example")
NEAR = (SAME_FILE, SAME_DIRECTORY, SAME_TOP, 0)


def _placed(candidates: DataFrame) -> DataFrame:
    """A row for each candidate and level: at is its file, its directory, its top directory, and the same for all."""
    path = F.col("file_path")
    c = candidates.select("id", "name", "kind", "file_path", (F.lower(P.stem(path)) == F.lower("name")).alias("named_file"), P.is_test(path).alias("is_test"), F.contains(path, F.lit("examples/")).alias("example"), F.xxhash64(P.top_segment(path)).alias("top"))
    return c.select("*", F.posexplode(F.array(path, P.directory(path), P.top_segment(path), F.lit(""))).alias("level", "at"))


def _classes(placed: DataFrame, *more: str) -> DataFrame:
    """Candidates of a name at a place that are alike in all features, as one row with their number: a few for a place."""
    return placed.groupBy(*more, "name", "level", "at", *FEATURES).agg(F.count("*").alias("n"), F.min("top").alias("low"), F.max("top").alias("high"))


def _score() -> Column:
    """Of a class of candidates for a question, as far as its level tells.

    A candidate counts at its own level and, with a lower score, at the levels further out. So the best score is right,
    and whoever has it has it once: what is nearer or of the qualifying type would have a better one.
    """
    near = F.element_at(F.array(*[F.lit(n) for n in NEAR]), F.col("level") + 1)
    score = near + F.when(F.col("preferred"), PREFERRED).otherwise(0) + F.when(F.col("of_type"), QUALIFIED).otherwise(0)
    score = score + F.when(F.col("types_wanted") & F.col("named_file"), NAMED_FILE).otherwise(0)
    score = score - F.when(F.col("is_test") & (F.col("level") > 0), TEST_PENALTY).otherwise(0)
    return score - F.when(F.col("example") & ~F.col("own_example"), EXAMPLE_PENALTY).otherwise(0)


ASKED = ("name", "file_path", "prefer", "q")
#: Classes of candidates up to this many are broadcast to the questions.
BROADCAST_CANDIDATES = 200_000


def resolve(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ref_id, id, score): definitions that references mean.

    refs: ref_id, name, file_path, prefer (array of kinds), qualifier (null: none); candidates: id, name, kind,
    file_path. Candidates of a name are scored by nearness and kind; a single one always counts, a best score below 0
    none. Of several best: in the caller's own file the first few by id; else one of a preferred kind; else the
    preferred ones, or all, if two, or if a few of one top directory.

    References that differ in neither name, file, kinds nor qualifier mean the same: each such question is scored once,
    against classes of candidates at its file, its directory, its top directory and everywhere, of which a place has a
    few; candidates themselves are met only where the rules let them count. No pairs of all with all are formed.
    """
    refs = refs.select("ref_id", "name", "file_path", "prefer", F.coalesce("qualifier", F.lit("")).alias("q"))
    questions = refs.select(*ASKED).distinct().repartition(refs.sparkSession.sparkContext.defaultParallelism, *ASKED)
    asked = cut(questions.withColumn("question", F.monotonically_increasing_id()))
    placed = cut(_placed(candidates))
    classes = _numbered(_classes(placed))
    here = F.col("file_path")
    types_wanted = F.arrays_overlap("prefer", F.array(*[F.lit(k) for k in P.TYPE_KINDS]))
    sides = asked.select("question", "name", "q", "prefer", types_wanted.alias("types_wanted"), F.contains(here, F.lit("examples/")).alias("own_example"), F.posexplode(F.array(here, P.directory(here), P.top_segment(here), F.lit(""))).alias("level", "at"))
    found = sides.join(classes, ["name", "level", "at"]).withColumn("of_type", F.lit(False))
    # A qualifier favours the definitions in files that define a type of its name.
    pairs = asked.filter("q <> ''").select("q", "name").distinct()
    types = placed.filter((F.col("level") == 0) & F.col("kind").isin(P.TYPE_KINDS)).select(F.col("name").alias("q"), "file_path").distinct()
    of_type = cut(placed.join(shuffled(types), "file_path").join(_few(pairs), ["q", "name"]).select("q", *placed.columns))
    types_classes = _numbered(_classes(of_type, "q"))
    qualified = sides.filter("q <> ''").join(types_classes, ["q", "name", "level", "at"]).withColumn("of_type", F.lit(True))
    scored = found.unionByName(qualified, allowMissingColumns=True).withColumn("preferred", F.array_contains("prefer", F.col("kind")))
    # Numbers alone are shuffled, once: what follows is grouped by the question, too.
    everywhere = F.when((F.col("level") == 3) & ~F.col("of_type"), F.col("n")).otherwise(0)
    scored = scored.select("question", _score().alias("score"), "n", everywhere.alias("all"), "low", "high", "preferred", (F.col("level") == 0).alias("here"), "class", "of_type").repartition("question")
    only = lambda c: F.when(F.col("preferred"), F.col(c))
    sums = scored.groupBy("question", "score").agg(F.sum("n").alias("n"), F.sum("all").alias("all"), F.min("here").alias("here"), F.coalesce(F.sum(only("n")), F.lit(0)).alias("n_preferred"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(only("low")).alias("low_preferred"), F.max(only("high")).alias("high_preferred"), F.collect_list(F.struct("class", "of_type", "preferred")).alias("classes"))
    best = sums.groupBy("question").agg(F.sum("all").alias("all"), F.max_by(F.struct(*[c for c in sums.columns if c not in ("question", "all")]), F.col("score")).alias("b")).select("question", "all", "b.*")
    some = F.col("n_preferred") > 0
    pool = F.when(some, F.col("n_preferred")).otherwise(F.col("n"))
    one_top = F.when(some, F.col("low_preferred") == F.col("high_preferred")).otherwise(F.col("low") == F.col("high"))
    rule = F.when((F.col("all") == 1) | ((F.col("n") == 1) & (F.col("score") >= 0)), "all").when(F.col("score") < 0, None)
    rule = rule.when(F.col("here"), "here").when((F.col("n_preferred") == 1) | (pool == 2) | ((pool <= TIES) & one_top), F.when(some, "preferred").otherwise("all"))
    best = best.select("question", "score", rule.alias("rule"), "classes").filter("rule is not null")
    # The few that count are looked up by their class.
    wanted = _few(best.select("question", "score", "rule", F.explode("classes").alias("c")).select("question", "score", "rule", "c.*").filter("rule <> 'preferred' or preferred"))
    keys = ["name", "level", "at", *FEATURES]
    met = wanted.filter("not of_type").join(placed.join(classes, keys).select("class", "id"), "class").select("question", "id", "score", "rule")
    met = met.unionByName(wanted.filter("of_type").join(of_type.join(types_classes, ["q", *keys]).select("class", "id"), "class").select("question", "id", "score", "rule"))
    in_file = Window.partitionBy("question").orderBy("id")
    kept = met.withColumn("nth", F.row_number().over(in_file)).filter((F.col("rule") != "here") | (F.col("nth") <= TIES_IN_FILE))
    return refs.join(shuffled(asked), [*ASKED]).join(shuffled(kept.select("question", "id", "score")), "question").select("ref_id", "id", "score")


def _numbered(classes: DataFrame) -> DataFrame:
    """Classes with a number each, so that questions carry that and not their names and paths."""
    return _few(classes.withColumn("class", F.monotonically_increasing_id()))


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast where a count shows that they are few, else shuffled."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_CANDIDATES else shuffled(rows)


def innermost(points: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """Each point with the smallest span of its file that holds it; of equals the one that starts later, then by id.

    points: point_id, file_path, line; spans: id, file_path, start_line, end_line. The file is the join key, so the
    range is only tested within it.
    """
    s = spans.select(F.col("id").alias("span_id"), F.col("file_path").alias("span_file"), "start_line", "end_line")
    inside = (F.col("file_path") == F.col("span_file")) & (F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line"))
    rows = points.join(s, inside, how)
    order = Window.partitionBy("point_id").orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line"), "span_id")
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth", "span_file", "start_line", "end_line")


def unique_edges(edges: DataFrame) -> DataFrame:
    """Each edge once; of several files that make it, once for each where edges carry their file.

    Edges are dealt out first: few repeat where they are read, and a task would hold all that it reads.
    """
    keys = ["source", "target", "kind", "at", *(["file_path"] if "file_path" in edges.columns else [])]
    return edges.withColumn("at", F.coalesce("line", F.lit(-1))).repartition(tasks(edges.sparkSession), *keys).dropDuplicates(keys).drop("at")


def built_edges(nodes: DataFrame, resolved: DataFrame, impls: DataFrame) -> DataFrame:
    """All edges: file contains symbol; resolved references (source, target, kind, line); implementations.

    impls: type_id, trait_id (null: none), method_id (null: the block itself), line, method_line. A block makes
    type implements trait; a method makes type contains method, method references type and trait. No edge to itself.
    Where resolved and impls have a file_path, edges carry it.
    """
    own = ["file_path"] if "file_path" in resolved.columns else []
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("source"), "file_path")
    contains = nodes.filter("kind <> 'file'").join(_few(files), "file_path").select("source", F.col("id").alias("target"), F.lit("contains").alias("kind"), F.col("start_line").cast("int").alias("line"), *own)
    block = impls.filter("method_id is null and trait_id is not null")
    method = impls.filter("method_id is not null")

    def made(rows: DataFrame, source: str, target: str, kind: str, line: str) -> DataFrame:
        return rows.select(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"), F.col(line).alias("line"), *own)

    parts = [
        resolved.select("source", "target", "kind", "line", *own),
        made(block, "type_id", "trait_id", "implements", "line"),
        made(method, "type_id", "method_id", "contains", "method_line"),
        made(method, "method_id", "type_id", "references", "method_line"),
        made(method.filter("trait_id is not null"), "method_id", "trait_id", "references", "method_line"),
    ]
    out = contains
    for part in parts:
        out = out.union(part)
    return unique_edges(out.filter("source <> target and target is not null"))


def affected_files(changed: DataFrame, names: DataFrame, refs: DataFrame, impls: DataFrame) -> DataFrame:
    """Distinct files to resolve again: the changed, and those whose references or implementations use a changed name.

    changed: file_path; names: name (old and new ones of changed files); refs: file_path, target_name, qualifier;
    impls: file_path, type_name, trait_name.
    """
    wanted = _few(names.select("name").distinct())
    out = changed.select("file_path")
    for rows, column in ((refs, "target_name"), (refs, "qualifier"), (impls, "type_name"), (impls, "trait_name")):
        out = out.union(rows.join(wanted, F.col(column) == F.col("name"), "left_semi").select("file_path"))
    return out.distinct()


def neighbour_files(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, limit: int = 20, kinds: tuple[str, ...] = REFERENCE_EDGES) -> DataFrame:
    """(anchor, file_path, score, rank): files one edge away from an anchor file's symbols, either way.

    anchors: anchor (a file), changed (array of names that its change mentions; see changed_names); an edge counts 2 from
    a mentioned symbol and 1 from others. The either-way condition is two equi-joins; an edge within the file counts for neither.
    """
    own = nodes.filter("kind <> 'file'").join(anchors, F.col("file_path") == F.col("anchor")).select(F.col("id").alias("own"), "anchor", F.when(F.array_contains("changed", F.col("name")), 2.0).otherwise(1.0).alias("weight"))
    kept = edges.filter(F.col("kind").isin(*kinds))
    out = kept.join(own, F.col("source") == F.col("own")).select("anchor", "weight", F.col("target").alias("id"))
    back = kept.join(own, F.col("target") == F.col("own")).select("anchor", "weight", F.col("source").alias("id"))
    files = out.union(back).join(nodes.select("id", "file_path"), "id").filter("file_path <> anchor").groupBy("anchor", "file_path").agg(F.sum("weight").alias("score"))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "file_path")
    return files.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def changed_names(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(anchor, changed): the names of a file's symbols that its change has as whole words. changes: anchor, diff."""
    from tessera.functions import text as T

    named = nodes.filter("kind <> 'file'").select(F.col("file_path").alias("anchor"), "name").distinct()
    met = changes.join(named, "anchor", "left")
    return met.groupBy("anchor").agg(F.collect_set(F.when(T.names_word("diff", "name"), F.col("name"))).alias("changed"))


#: Files with more neighbours than this are hubs: what lies beyond them is a bitmap.
HUB = 64


def reach(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("calls", "references")) -> DataFrame:
    """(file_path, hop1, hop2): numbers of other files within one and two edges of each file.

    Two steps through a file of few neighbours are pairs, at most HUB for each edge. The neighbours of a hub are bitmaps
    of file numbers by bucket, met once for each of its edges and joined by OR, so a hub of n neighbours costs n bitmaps
    and not n * n pairs.
    """
    of = nodes.select("id", "file_path")
    files = cut(nodes.select("file_path").distinct().withColumn("at", F.monotonically_increasing_id() + 1))
    place = of.join(files, "file_path").select("id", "at")
    pairs = edges.filter(F.col("kind").isin(*kinds)).join(place.select(F.col("id").alias("source"), F.col("at").alias("a")), "source").join(place.select(F.col("id").alias("target"), F.col("at").alias("b")), "target").select("a", "b")
    hop1 = cut(pairs.union(pairs.select("b", "a")).filter("a <> b").distinct())
    one = cut(hop1.groupBy("a").agg(F.count("*").alias("hop1")))
    hubs = one.filter(F.col("hop1") > HUB).select(F.col("a").alias("b"))
    light, heavy = hop1.join(hubs, "b", "left_anti"), hop1.join(hubs, "b", "left_semi")
    near_hub = heavy.select("a").distinct()
    further = hop1.select(F.col("a").alias("b"), F.col("b").alias("c"))
    met = light.join(further, "b").select("a", F.col("c").alias("b")).union(hop1).filter("a <> b")
    plain = met.join(near_hub, "a", "left_anti").distinct().groupBy("a").agg(F.count("*").alias("hop2"))

    def bits(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys, F.bitmap_bucket_number("c").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))

    beyond = heavy.join(bits(further.join(hubs, "b", "left_semi"), "b"), "b").select("a", "bucket", "bits")
    own = bits(met.join(near_hub, "a", "left_semi").select("a", F.col("b").alias("c")), "a")
    merged = beyond.union(own).groupBy("a", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    # A file lies among its hub's neighbours itself.
    around = merged.groupBy("a").agg((F.sum(F.bitmap_count("bits")) - 1).alias("hop2"))
    out = files.select(F.col("at").alias("a"), "file_path").join(one, "a", "left").join(plain.union(around), "a", "left")
    return out.select("file_path", F.coalesce("hop1", F.lit(0)).alias("hop1"), F.coalesce("hop2", F.lit(0)).alias("hop2"))


def file_symbols(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, id): the symbols of a file; of a path that no file has, those of files that end with it. asked: qid, path."""
    symbols = nodes.filter("kind <> 'file'").select("id", "file_path")
    exact = asked.join(symbols, F.col("path") == F.col("file_path")).select("qid", "id")
    rest = asked.join(exact.select("qid").distinct(), "qid", "left_anti").filter("path <> ''")
    # The file name of both is equal, so the suffix is tested within it.
    ends = rest.withColumn("base", P.file_name(F.col("path"))).join(symbols.withColumn("base", P.file_name(F.col("file_path"))), "base")
    return exact.union(ends.filter(F.endswith("file_path", F.concat(F.lit("/"), "path"))).select("qid", "id"))


def symbol_candidates(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, id): the nodes that a symbol may mean: the node of that id; else the symbols of that name in that file
    (file/symbol, the file with a dot); else all of that name. asked: qid, symbol."""
    symbols = nodes.filter("kind <> 'file'").select("id", "name", "file_path")
    by_id = asked.filter(F.contains("symbol", F.lit(":"))).join(symbols, F.col("symbol") == F.col("id")).select("qid", "id")
    rest = asked.join(by_id.select("qid"), "qid", "left_anti")
    file, symbol = P.file_and_symbol(P.normalized(F.col("symbol")))
    split = rest.select("qid", file.alias("file_path"), symbol.alias("name")).filter(F.contains("file_path", F.lit(".")) & F.col("name").isNotNull())
    in_file = split.join(symbols, ["file_path", "name"]).select("qid", "id")
    rest = rest.join(in_file.select("qid").distinct(), "qid", "left_anti")
    by_name = rest.join(symbols, F.col("symbol") == F.col("name")).select("qid", "id")
    return by_id.union(in_file).union(by_name)


def picked(nodes: DataFrame, asked: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """pick() for symbols in any of their three forms, and a row `not_found` for those that mean nothing.

    asked: qid, symbol, file, kind_hint, scope. Returns qid, id, status, score, rank, total. Questions that differ in
    nothing but qid mean the same, and are answered once: many that ask for a common name make no pairs of all with all.
    """
    columns = ("symbol", *HINTS)
    questions = cut(asked.select(*columns).distinct().withColumn("qid", F.monotonically_increasing_id()))
    found = cut(symbol_candidates(nodes, questions))
    meant = found.join(nodes.select("id", "kind", "name", "file_path"), "id").join(questions.select("qid", *HINTS), "qid")
    none = questions.join(found.select("qid").distinct(), "qid", "left_anti")
    out = _picked(meant, limit).union(none.select("qid", F.lit(None).cast("string"), F.lit("not_found"), F.lit(None).cast("double"), F.lit(1), F.lit(0).cast("long")))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in columns])
    numbered = asked.select("qid", *columns).join(questions.select(F.col("qid").alias("question"), *[F.col(c).alias(f"q_{c}") for c in columns]), same)
    return numbered.select("qid", "question").join(out.withColumnRenamed("qid", "question"), "question").select("qid", "id", "status", "score", "rank", "total")


def ref(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, status, symbol_id, id, kind, line): one-hop references of what a symbol and its hints mean.

    asked: qid, symbol, incoming (boolean), file, kind_hint, scope. status ok: a row per edge whose other end lies in the
    scope (id null where there is none); ambiguous: a row per candidate (symbol_id); not_found: one row.
    """
    out = picked(nodes, asked)
    rest = out.filter("status <> 'ok'").select("qid", "status", F.col("id").alias("symbol_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("kind", "string"), ("line", "int"))])
    ok = out.filter("status = 'ok'").select("qid", F.col("id").alias("symbol_id")).join(asked.select("qid", "incoming", "scope"), "qid")
    kept = edges.filter(F.col("kind").isin(*REFERENCE_EDGES))
    into = ok.filter("incoming").join(kept, F.col("target") == F.col("symbol_id")).select("qid", "scope", F.col("source").alias("id"), "kind", "line")
    out_of = ok.filter("not incoming").join(kept, F.col("source") == F.col("symbol_id")).select("qid", "scope", F.col("target").alias("id"), "kind", "line")
    ends = into.union(out_of).join(nodes.select("id", "file_path"), "id")
    ends = ends.filter(F.coalesce(P.in_scope(F.col("file_path"), P.normalized(F.col("scope"))), F.lit(True)))
    return rest.union(ok.join(ends.drop("scope", "file_path"), "qid", "left").select("qid", F.lit("ok"), "symbol_id", "id", "kind", F.col("line").cast("int")))


def state(nodes: DataFrame, sources: DataFrame) -> str:
    """What a question to the graph meets: ok; not_indexed where there are sources but no nodes; else empty."""
    if not nodes.isEmpty():
        return "ok"
    return "empty" if sources.isEmpty() else "not_indexed"
