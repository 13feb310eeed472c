"""Operator 2, chat formatting by quotation linking. DataFrame and SQL functions only.

Messages of a conversation are numbered by turn. Lines give their quote level by the marks before them; runs of lines of
one level are passages. Passages, and their lines, are hashed after normalising case and white space and joined to the
latest earlier message of the conversation that has them among its own words. A message answers the message that its
outermost linked passage quotes, else the one before it; its text is what it says itself. The answers make a tree, and
the conversation is ordered by it: every message is followed by its answers, with theirs.

The tree is walked by runs: messages that each answer the one before them. A run's first answer is its next message, so
a run stands together, then come the runs that branch off, from its last message to its first; sums over them come from
pointer doubling. What is ordered within a conversation, "the latest earlier one" included, works on stretches of
TURNS numbers with one carried row a stretch, so a conversation that holds a third of all messages spreads over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import runtime

#: Numbers in a stretch, as bits.
STRETCH_BITS = 8
#: Messages of a part of an assembled conversation.
PART = 256
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: A line that introduces a quotation (fixed pattern).
INTRODUCES = r"(?i)^\s*(on|le|el|am)\b.*\b(wrote|écrit|escribió|schrieb)\b.*:\s*$"


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _stretch(at: str) -> Column:
    return F.shiftright(at, STRETCH_BITS)


def _sum_before(rows: DataFrame, keys: list[str], at: str, weight: str, name: str) -> DataFrame:
    """rows with the sum of weight over rows of their keys with a smaller `at` (a long that differs within keys)."""
    rows = rows.withColumn("stretch", _stretch(at))
    inside = Window.partitionBy(*keys, "stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "stretch").agg(F.sum(weight).alias("of_stretch"))
    sums = sums.select(*keys, "stretch", F.coalesce(F.sum("of_stretch").over(earlier), F.lit(0)).alias("carried"))
    out = rows.withColumn("inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(sums, [*keys, "stretch"])
    return out.withColumn(name, F.col("inside") + F.col("carried")).drop("stretch", "inside", "carried")


def _latest_before(events: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """events with the last value (not null) of their keys up to them; of one `at`, a row without value comes first."""
    events = events.withColumn("stretch", _stretch(at))
    inside = Window.partitionBy(*keys, "stretch").orderBy(at, F.col(value).isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = events.groupBy(*keys, "stretch").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(at, value))).alias("end"))
    ends = ends.select(*keys, "stretch", F.max("end").over(earlier)[value].alias("carried"))
    out = events.withColumn("near", F.last(value, ignorenulls=True).over(inside)).join(ends, [*keys, "stretch"])
    return out.withColumn(name, F.coalesce("near", "carried")).drop("stretch", "near", "carried")


def numbered(messages: DataFrame) -> DataFrame:
    """(conv, n, conv_id, turn, role, text): distinct messages, numbered from 0 in their conversation by turn.

    Messages of one turn stand by a hash of role and text; a turn that very many share is dealt by that hash.
    """
    rows = messages.select("conv_id", "turn", "role", "text").distinct()
    conv, at = F.coalesce(F.col("conv_id").cast("long"), F.lit(LOWEST)), F.coalesce(F.col("turn").cast("long"), F.lit(HIGHEST))
    rows = rows.select(conv.alias("conv"), at.alias("at"), "conv_id", "turn", "role", "text")
    turns = rows.groupBy("conv", "at").agg(F.count("*").alias("in_turn"))
    rows = rows.join(_sum_before(turns, ["conv"], "at", "in_turn", "first"), ["conv", "at"])
    one, several = rows.filter("in_turn = 1"), rows.filter("in_turn > 1").withColumn("tie", F.xxhash64("role", "text")).withColumn("part", F.shiftright("tie", 56))
    parts = several.groupBy("conv", "at", "part").agg(F.count("*").alias("in_part"))
    earlier = Window.partitionBy("conv", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "at", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("conv", "at", "part").orderBy("tie", "role", "text")) - 1
    several = several.withColumn("nth", nth).join(parts, ["conv", "at", "part"]).withColumn("first", F.col("first") + F.col("earlier") + F.col("nth"))
    columns = ["conv", F.col("first").alias("n"), "conv_id", "turn", "role", "text"]
    return one.select(*columns).union(several.select(*columns))


def parsed(rows: DataFrame) -> DataFrame:
    """rows with lines: array of (pos, level, body)."""
    level = "length(regexp_replace(regexp_extract(l, '^((?:[ \\\\t]*>)+)', 1), '[^>]', ''))"
    line = f"named_struct('pos', i, 'level', {level}, 'body', if({level} > 0, regexp_replace(l, '^(?:[ \\\\t]*>)+[ \\\\t]?', ''), l))"
    return rows.withColumn("lines", F.expr(f"transform(split(coalesce(text, ''), '\\\\r\\\\n|\\\\n|\\\\r'), (l, i) -> {line})"))


def own_text(lines: str = "lines") -> Column:
    """A message's own lines: none that quote, none that introduce a quotation."""
    own = f"filter({lines}, (p, i) -> p.level = 0 and not (p.body rlike '{INTRODUCES.replace(chr(92), chr(92) * 2)}' and coalesce(get({lines}, i + 1).level, 0) > 0))"
    return F.trim(F.regexp_replace(F.expr(f"array_join(transform({own}, p -> p.body), '\n')"), r"\A\s+|\s+\z", ""))


def passages(rows: DataFrame) -> DataFrame:
    """(conv, n, passage, level, keys: hash of the passage first, then of its lines) of quoting messages."""
    quoting = rows.filter("exists(lines, p -> p.level > 0)")
    line = quoting.select("conv", "n", F.explode("lines").alias("p")).select("conv", "n", "p.*").filter("level > 0")
    order = Window.partitionBy("conv", "n").orderBy("pos")
    begins = (F.lag("pos").over(order) + 1 != F.col("pos")) | (F.lag("level").over(order) != F.col("level"))
    line = line.withColumn("begins", F.coalesce(begins, F.lit(True)).cast("int")).withColumn("passage", F.sum("begins").over(order)).withColumn("body", _normal(F.col("body"))).filter("body <> ''")
    per = line.groupBy("conv", "n", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("ls"))
    whole = F.expr("xxhash64(array_join(transform(ls, x -> x.body), ' '))")
    return per.select("conv", "n", "passage", "level", F.size("ls").alias("n_lines"), F.concat(F.array(whole), F.expr("transform(ls, x -> xxhash64(x.body))")).alias("keys"))


def quote_links(rows: DataFrame) -> DataFrame:
    """(conv, n, passage, level, original): the number of the message that a passage quotes.

    A whole passage counts before lines; of lines, the original that most of them name, the latest of equals.
    """
    asked = passages(rows).select("conv", "n", "passage", "level", F.posexplode("keys").alias("k", "h"))
    own = rows.select("conv", "n", own_text().alias("own"))
    units = F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", r"\n"))
    own = own.select("conv", "n", F.explode(F.array_distinct(F.transform(units, lambda x: F.xxhash64(_normal(x))))).alias("h"))
    own = own.join(asked.select("conv", "h").distinct(), ["conv", "h"], "left_semi").distinct()
    none = F.lit(None).cast("long")
    columns = ["conv", "h", "n", "passage", "level", "k", "source"]
    events = asked.select("conv", "h", "n", F.col("passage").cast("long").alias("passage"), F.col("level").cast("long").alias("level"), F.col("k").cast("long").alias("k"), none.alias("source"))
    events = events.union(own.select("conv", "h", "n", none.alias("passage"), none.alias("level"), none.alias("k"), F.col("n").alias("source")).select(*columns))
    found = _latest_before(events, ["conv", "h"], "n", "source", "original").filter("k is not null and original is not null")
    votes = found.groupBy("conv", "n", "passage", "level", "original").agg(F.max((F.col("k") == 0).cast("int")).alias("whole"), F.count("*").alias("votes"))
    return votes.groupBy("conv", "n", "passage", "level").agg(F.max(F.struct("whole", "votes", "original")).alias("best")).select("conv", "n", "passage", "level", F.col("best.original").alias("original"))


def _summed_below(runs: DataFrame) -> DataFrame:
    """(conv, start, total): messages of a run and of all runs that branch off it. runs: conv, start, up, size."""
    state = runs.select("conv", "start", F.col("up").alias("above"), F.col("size").alias("total"))
    while not state.filter("above is not null").isEmpty():
        more = state.filter("above is not null").groupBy("conv", F.col("above").alias("start")).agg(F.sum("total").alias("more"))
        jump = state.select("conv", F.col("start").alias("above"), F.col("above").alias("further"))
        state = state.join(jump, ["conv", "above"], "left").join(more, ["conv", "start"], "left")
        state = runtime.checkpoint(state.select("conv", "start", F.col("further").alias("above"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
    return state.select("conv", "start", "total")


def _placed(runs: DataFrame) -> DataFrame:
    """(conv, start, place, deep): position and depth of each run's first message. runs: conv, start, up, place, deep
    (both relative to the run it branches off)."""
    state = runs.select("conv", "start", F.col("up").alias("above"), "place", "deep")
    while not state.filter("above is not null").isEmpty():
        jump = state.select("conv", F.col("start").alias("above"), F.col("above").alias("further"), F.col("place").alias("p"), F.col("deep").alias("d"))
        state = state.join(jump, ["conv", "above"], "left")
        state = runtime.checkpoint(state.select("conv", "start", F.col("further").alias("above"), (F.col("place") + F.coalesce("p", F.lit(0))).alias("place"), (F.col("deep") + F.coalesce("d", F.lit(0))).alias("deep")))
    return state.select("conv", "start", "place", "deep")


def reply_order(answers: DataFrame) -> DataFrame:
    """(conv, n, position, depth) of messages that answer smaller numbers. answers: conv, n, parent (null: n = 0).

    position counts from 0 in the order in which every message is followed by its answers, in the order of their
    numbers, each with theirs.
    """
    begins = F.col("parent").isNull() | (F.col("parent") != F.col("n") - 1)
    rows = runtime.checkpoint(_latest_before(answers.withColumn("begin", F.when(begins, F.col("n"))), ["conv"], "n", "begin", "start"))
    sizes = rows.groupBy("conv", "start").agg(F.count("*").alias("size"))
    runs = rows.filter("begin is not null").select("conv", "start", F.col("parent").alias("attach")).join(sizes, ["conv", "start"])
    above = rows.select("conv", F.col("n").alias("attach"), F.col("start").alias("up"))
    runs = runtime.checkpoint(runs.join(above, ["conv", "attach"], "left").select("conv", "start", "attach", "up", "size"))
    runs = runtime.checkpoint(runs.join(_summed_below(runs), ["conv", "start"]))
    branches = runs.filter("up is not null")
    # What branches off later messages of the run comes first; of one message, the earlier answer.
    per = branches.groupBy("conv", "up", "attach").agg(F.sum("total").alias("of_message")).withColumn("from_end", -F.col("attach"))
    per = _sum_before(per, ["conv", "up"], "from_end", "of_message", "later").select("conv", "up", "attach", "later")
    branches = _sum_before(branches, ["conv", "up", "attach"], "start", "total", "before").join(per, ["conv", "up", "attach"])
    of_up = runs.select("conv", F.col("start").alias("up"), F.col("size").alias("up_size"))
    branches = branches.join(of_up, ["conv", "up"]).select("conv", "start", "up", (F.col("up_size") + F.col("later") + F.col("before")).alias("place"), (F.col("attach") - F.col("up") + 1).alias("deep"))
    first = runs.filter("up is null").select("conv", "start", "up", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("deep"))
    placed = _placed(runtime.checkpoint(first.union(branches)))
    within = F.col("n") - F.col("start")
    return rows.join(placed, ["conv", "start"]).select("conv", "n", (F.col("place") + within).alias("position"), (F.col("deep") + within).alias("depth"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per distinct message: conv_id, turn, role, message (its number in the conversation, from 0, by turn),
    reply_to (the number of the message that it answers; null for the first), depth (answers down from the first),
    position (from 0, in reply order), linked (by a quotation), n_quoted (lines that quote), text (its own).

    A null conv_id is a conversation of its own; null turns come last. Null and empty texts quote nothing and say
    nothing. A passage that no earlier message of the conversation has links nothing and is dropped from the text all
    the same. Messages of one turn stand by a hash of role and text. Identical rows are one message. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = parsed(runtime.written(numbered(messages), "messages"))
    links = quote_links(rows)
    quoted = links.groupBy("conv", "n").agg(F.min(F.struct("level", "passage", "original")).alias("a")).select("conv", "n", F.col("a.original").alias("quoted"))
    answers = rows.select("conv", "n").join(runtime.checkpoint(quoted), ["conv", "n"], "left")
    answers = runtime.checkpoint(answers.select("conv", "n", F.coalesce("quoted", F.when(F.col("n") > 0, F.col("n") - 1)).alias("parent"), F.col("quoted").isNotNull().alias("linked")))
    ordered = reply_order(answers.select("conv", "n", "parent"))
    said = rows.select("conv", "n", "conv_id", "turn", "role", own_text().alias("text"), F.expr("cast(size(filter(lines, p -> p.level > 0)) as long)").alias("n_quoted"))
    out = said.join(answers.join(ordered, ["conv", "n"]), ["conv", "n"])
    return out.select("conv_id", "turn", "role", F.col("n").alias("message"), F.col("parent").alias("reply_to"), "depth", "position", "linked", "n_quoted", "text")


def assembled(formatted: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, messages): conversations in reply order, `part` messages a row (array of message, reply_to, depth,
    role, text); a longer conversation goes on in its next part."""
    row = F.struct("position", "message", "reply_to", "depth", "role", "text")
    parts = formatted.groupBy("conv_id", F.floor(F.col("position") / part).alias("part")).agg(F.array_sort(F.collect_list(row)).alias("m"))
    return parts.select("conv_id", "part", F.transform("m", lambda x: x.dropFields("position")).alias("messages"))
