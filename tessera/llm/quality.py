"""Operator 13, quality rules: how far a document's histograms diverge from its language's. DataFrame functions only.

Each language has two references, counted over all its documents: a histogram of character classes, and the shares of
its common words (those that make up COMMON of its words or more, so at most 1 / COMMON of them). A document's own
histograms are compared with them by Jensen-Shannon distance. Small samples diverge by chance, about as one over the
square root of their size: the limits leave that room, and texts under a minimal length aren't judged at all. Plain
rules on counts (words, repeated windows) come first.

No text is shuffled: a document's words, windows and histograms are arrays in its own row. Values that are used
again inside a lambda are bound by let(), or they would be computed for each element anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import runtime

SPACE = "\\x20\\x09-\\x0D"
#: Characters of a class are taken out before the next class is counted; what is left over is the last class.
CLASSES = ("[aeiou]+", "[a-z]+", f"[{SPACE}]+", "[A-Z]+", "[.,;:!?'\"()-]+", "[^\\x00-\\x7F]+", "[0-9]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 0.3
#: A word is common that makes up this share of a language's words.
COMMON = 0.002
#: A language with fewer words has no reference of its own; its documents are held against that of all languages.
REFERENCE_WORDS = 10_000
#: Texts of fewer words aren't judged by their histograms.
JUDGED_WORDS = 50
#: Limits of the distances: constant + room / sqrt(words).
CHAR_LIMIT, WORD_LIMIT = (0.15, 1.5), (0.28, 2.0)
BROADCAST_LANGUAGES = 5_000
#: Low bits of hashes by which common words are found.
SLOTS = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def class_counts(text: Column) -> Column:
    """n: characters of each class, and those of none (array of long); rest: the characters of none."""

    def cut(left: Column, classes: tuple[str, ...], counts: tuple[Column, ...]) -> Column:
        if not classes:
            return F.struct(F.array(*counts, F.char_length(left).cast("long")).alias("n"), left.alias("rest"))
        rest = F.regexp_replace(left, classes[0], "")
        return let(rest, lambda r: cut(r, classes[1:], (*counts, (F.char_length(left) - F.char_length(r)).cast("long"))))

    return cut(text, CLASSES, ())


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("lang").cast("string").alias("lang"), runtime.text_of().alias("text"))


def language_references(docs: DataFrame, common: float = COMMON, least_words: int = REFERENCE_WORDS) -> DataFrame:
    """(lang, chars, words, shares, slots): per language the shares of character classes, the hashes of its common words in
    order of their numbers, their shares, and by the low bits of a hash the one word's number that has them (0: none, -1:
    several); a row with lang null for all languages together.

    Rows with lang null count for all languages only. An empty table gives no row.
    """
    counted = _texts(docs).select("lang", F.col("text"), class_counts(F.col("text"))["n"].alias("n"))
    words = word_references(docs, common, least_words)
    return words.alias("w").join(char_references(counted).alias("k"), F.expr("k.lang <=> w.lang")).select("w.lang", "k.chars", "w.words", "w.shares", "w.slots")


def char_references(counted: DataFrame) -> DataFrame:
    """(lang, chars) of documents' counts by class (lang, n), and of all together with lang null."""
    sums = [f"c{i}" for i in range(len(CLASSES) + 1)]
    per = runtime.checkpoint(counted.groupBy("lang").agg(*[F.sum(F.get("n", F.lit(i))).alias(c) for i, c in enumerate(sums)]))
    every = per.groupBy().agg(*[F.sum(c).alias(c) for c in sums]).select(F.lit(None).cast("string").alias("lang"), *sums)
    total = sum([F.col(c) for c in sums[1:]], F.col(sums[0]))
    return per.filter("lang is not null").unionByName(every).select("lang", F.array(*[F.when(total > 0, F.col(c) / total).otherwise(0.0) for c in sums]).alias("chars"))


def word_references(docs: DataFrame, common: float = COMMON, least_words: int = REFERENCE_WORDS) -> DataFrame:
    """(lang, words, shares, slots), as language_references."""
    counts = _texts(docs).select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = runtime.written(counts, "word-counts")
    together = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "word", "n")
    words = None
    for some in (counts.filter("lang is not null"), together):
        total = some.groupBy("lang").agg(F.sum("n").alias("total")).alias("t")
        shares = some.alias("s").join(total, F.col("s.lang").eqNullSafe(F.col("t.lang"))).select("s.lang", "s.word", (F.col("n") / F.col("total")).alias("share"), "total")
        shares = shares.filter(F.col("share") >= common)
        words = shares if words is None else words.unionByName(shares)
    entries = F.sort_array(F.collect_list(F.struct(F.xxhash64("word").alias("h"), F.col("share"))))
    words = words.groupBy("lang").agg(F.first("total").alias("total"), entries.alias("e")).filter(F.col("lang").isNull() | (F.col("total") >= least_words))
    return runtime.checkpoint(words.select("lang", F.col("e.h").alias("words"), F.col("e.share").alias("shares")).withColumn("slots", _slots(F.col("words"))))


def _slots(words: Column) -> Column:
    def of(b: Column) -> Column:
        fits = F.filter(F.transform(words, lambda w, i: F.when(w.bitwiseAND(F.lit(SLOTS - 1)) == b, i + 1)), lambda i: i.isNotNull())
        return let(fits, lambda f: F.when(F.size(f) == 0, 0).when(F.size(f) == 1, F.get(f, F.lit(0))).otherwise(-1))

    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), of)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def _part(p: Column, q: Column) -> Column:
    """What one outcome adds to twice the divergence (bits)."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)


def _distance(twice: Column) -> Column:
    return F.round(F.sqrt(F.greatest(F.lit(0.0), twice / 2)), 9)


def char_distance(counts: Column, reference: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(total, lambda n: F.when(n > 0, _distance(_sum(F.zip_with(counts, reference, lambda c, q: _part(c / n, q))))))


def word_distance(hashes: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of the common words among `hashes` (all others are one outcome) from a reference."""
    words, shares = reference["words"], reference["shares"]

    def number_of(h: Column) -> Column:
        slot = F.get(reference["slots"], h.bitwiseAND(F.lit(SLOTS - 1)).cast("int"))
        one = F.when(F.get(words, slot - 1) == h, slot).otherwise(0)
        return F.when(slot == 0, 0).when(slot > 0, one).otherwise(F.array_position(words, h).cast("int"))

    number = F.sort_array(F.filter(F.transform(hashes, number_of), lambda k: k > 0))

    def over_runs(s: Column, n: Column) -> Column:
        """s: numbers of the common words that occur, in order."""
        ends = F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1))))
        share = lambda at: F.get(shares, (at - 1).cast("int"))

        def summed(e: Column) -> Column:
            runs = F.transform(e, lambda i, nth: F.struct(share(F.get(s, i)).alias("q"), ((i - F.coalesce(F.get(e, nth - 1), F.lit(-1))) / n).alias("p")))
            present = lambda r: (_sum(F.transform(r, lambda x: _part(x["p"], x["q"]))), _sum(F.transform(r, lambda x: x["q"])))
            rest = lambda all_q, q: F.greatest(F.lit(0.0), all_q - q)
            return let(runs, lambda r: let(_sum(shares), lambda all_q: _distance(present(r)[0] + rest(all_q, present(r)[1]) + _part(1 - F.size(s) / n, F.greatest(F.lit(0.0), 1 - all_q)))))

        return let(ends, summed)

    return F.when(F.size(hashes) > 0, let(number, lambda s: over_runs(s, F.size(hashes))))


def repeated_words(hashes: Column, words: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of `width` words (a power of two) that occur more than once (all occurrences).

    Windows are told apart by hashes. Only where two are alike, the windows are sorted as words.
    """

    def doubled(windows: Column, at: int) -> Column:
        """Hashes of windows of 2 * at words from those of at words: each with the one that begins behind it."""
        n = F.size(windows) - at
        wider = F.zip_with(F.slice(windows, F.lit(1), n), F.slice(windows, F.lit(at + 1), n), lambda a, b: F.xxhash64(a, b))
        return wider if 2 * at == width else let(wider, lambda w: doubled(w, 2 * at))

    alike = doubled(hashes, 1)

    def covered(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["w"] == F.get(s, b)["w"], F.lit(False))
        at = F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
        return let(F.sort_array(F.filter(at, lambda i: i.isNotNull())), lambda p: F.aggregate(F.transform(p, lambda i, nth: F.least(F.lit(width), F.coalesce(F.get(p, nth + 1) - i, F.lit(width)))), F.lit(0), lambda a, x: a + x))

    def sought(w: Column) -> Column:
        """w: a hash for each window. Windows whose hash occurs once are no repeats."""
        by_hash = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])), x["i"])), lambda i: i.isNotNull())
        return let(by_hash, lambda s: let(F.sort_array(F.transform(twice(s), lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("w"), i.alias("i")))), covered))

    some = let(alike, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), sought(w)).otherwise(0))
    return F.when(F.size(hashes) > width, some).otherwise(0).cast("long")


def _measured(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """The counts of each document, its word distance, its counts by class, and which reference it has."""
    side = F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs
    texts = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    own = side.filter("lang is not null").alias("o")
    every = F.broadcast(refs.filter("lang is null").select(F.lit(True).alias("has"), F.struct("lang", "words", "shares", "slots").alias("e"))).alias("a")
    # The reference of all languages is one row.
    found = texts.alias("d").join(own, F.col("d.lang") == F.col("o.lang"), "left").select("d.*", F.when(F.col("o.lang").isNotNull(), F.struct("o.lang", "o.words", "o.shares", "o.slots")).alias("ref"))
    found = found.withColumn("has", F.lit(True)).alias("f").join(every, F.col("f.has") == F.col("a.has"), "left").select("f.doc_id", "f.lang", "f.text", F.coalesce("f.ref", "a.e").alias("ref"))
    text, ref = F.col("text"), F.col("ref")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")

    def of_words(w: Column, h: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(h, w).alias("n_repeat_words"), word_distance(h, ref).alias("word_distance"))

    def of_characters(c: Column) -> Column:
        total = F.aggregate(c["n"], F.lit(0).cast("long"), lambda a, x: a + x)
        symbols = F.char_length(c["rest"]) - F.char_length(F.translate(c["rest"], SYMBOLS, ""))  # of no class
        return F.struct(c["n"].alias("n"), (total - F.get(c["n"], F.lit(CLASSES.index(f"[{SPACE}]+")))).alias("word_chars"), symbols.cast("long").alias("n_symbols"))

    out = found.select(
        "doc_id",
        "lang",
        ref["lang"].alias("reference"),
        ref.isNotNull().alias("has_reference"),
        let(words_of(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: of_words(w, h))).alias("m"),
        let(class_counts(text), of_characters).alias("c"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return out.select("doc_id", "lang", "reference", "has_reference", "n_dup_lines", "m.*", "c.*")


def judge(docs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEATED of them in repeated windows. kept: not that, and
    both distances within their limits, where the text has JUDGED_WORDS words. Documents of a language without a
    reference (null, or of too few words) are held against all languages together.

    Null and empty texts have no words: counts 0, distances null, base_failed. Rows repeat as they are; null ids stay.
    With no words in the whole table, distances are null and nothing is judged by them. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    refs = word_references(docs) if references is None else references
    # One pass over the texts; what is left of each is a row of numbers, from which the rest follows.
    rows = runtime.written(_measured(docs, refs.select("lang", "words", "shares", "slots")), "measures")
    chars = char_references(rows) if references is None else references.select("lang", "chars")
    chars = F.broadcast(chars) if refs.count() <= BROADCAST_LANGUAGES else chars
    out = rows.alias("r").join(chars.alias("k"), F.expr("r.has_reference and r.reference <=> k.lang"), "left").select("r.*", "k.chars").withColumn("char_distance", char_distance(F.col("n"), F.col("chars")))
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * round(100 * MAX_REPEATED))
    limit = lambda x: x[0] + x[1] / F.sqrt(n)
    far = (n >= JUDGED_WORDS) & ((F.col("char_distance") > limit(CHAR_LIMIT)) | (F.col("word_distance") > limit(WORD_LIMIT)))
    out = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
