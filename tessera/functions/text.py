"""Text functions as Column expressions: term splitting, identifiers, clipping, excerpts, patterns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query does without.
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "do", "does", "did", "of", "to",
    "in", "on", "for", "by", "with", "or", "and", "it", "this", "that", "how", "what", "why",
    "which", "where", "when", "who", "whether",
]

# Names that are no references.
BUILTIN_NAMES = [
    "Self", "self", "super", "crate", "i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16",
    "u32", "u64", "u128", "usize", "f32", "f64", "bool", "str", "char", "never", "void", "int",
    "long", "short", "float", "double", "unsigned", "signed", "const", "auto", "size_t", "boolean",
    "byte", "var", "dynamic", "object", "string", "nullptr", "NULL", "this", "base",
]

# Limits of returned text.
SNIPPET_FULL, SNIPPET_CLIP, SNIPPET_RATIO = 960, 240, 0.99
EXCERPT, EXCERPT_KEPT = 300, 297


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def split_terms(text: Column | str) -> Column:
    """Runs of letters, digits, _ and -, case kept."""
    return F.filter(F.split(_c(text), r"[^\p{L}\p{N}_-]+"), lambda w: w != "")


def identifier_words(term: Column | str) -> Column:
    """Parts of an identifier at _, -, case changes and letter-digit borders; a part with other characters is left out."""
    s = F.regexp_replace(_c(term), "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z])([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Za-z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, "([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(s, "[ _-]+"), lambda w: w.rlike("^[A-Za-z0-9]+$"))


#: Where an identifier has parts.
BOUNDARY = "[_-]|[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without them."""
    pairs = []
    for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0].isascii() and chr(c).islower() and all(unicodedata.combining(x) for x in parts[1:]):
            pairs.append((chr(c), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _accents()


def folded(text: Column | str) -> Column:
    """Lower case without accents on Latin letters."""
    return F.translate(F.lower(_c(text)), MARKED, PLAIN)


def expand_term(term: Column) -> Column:
    """A term and its identifier words, lower-cased, each once."""
    return F.array_distinct(F.transform(F.concat(F.array(term), identifier_words(term)), F.lower))


def term_variants(text: Column | str) -> Column:
    """For each term of a text itself and its identifier words (array of arrays)."""
    plain = F.transform(split_terms(text), lambda w: F.array(F.lower(w)))
    return F.when(_c(text).rlike(BOUNDARY), F.transform(split_terms(text), lambda w: F.when(w.rlike(BOUNDARY), expand_term(w)).otherwise(F.array(F.lower(w))))).otherwise(plain)


def document_terms(text: Column | str) -> Column:
    """Index terms in order; repeats count, but not within one term."""
    return F.flatten(term_variants(text))


def index_tokens(terms: Column) -> Column:
    """Tokens of index terms: cut at everything but letters and digits, without case and accents."""
    t = folded(F.array_join(terms, " "))
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Between the columns of an index row, so that no phrase crosses them.
COLUMN_END = ""


def lexical_row(summary: Column | str, body: Column | str, stems: bool = False) -> Column:
    """Tokens of a record's two index columns, COLUMN_END between them: the summary as it is, and the terms of summary
    and body with their identifier words (and English stems)."""
    text = F.concat_ws(" ", _c(summary), _c(body))
    if stems:
        from tessera.functions.stem import variants_with_stems

        tokens = index_tokens(variants_with_stems(term_variants(text)))
    else:  # where no term has parts, the terms are the words
        words = F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        tokens = F.when(text.rlike(BOUNDARY), index_tokens(document_terms(text))).otherwise(words)
    plain = F.filter(F.split(folded(F.coalesce(_c(summary), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.concat(plain, F.array(F.lit(COLUMN_END)), tokens)


def phrases(terms: Column) -> Column:
    """Query terms as the index sees them: the tokens of each, joined by blanks; those without any go."""
    return F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(F.regexp_replace(folded(t), r"[^\p{L}\p{N}]+", " "))), lambda t: t != ""))


def query_terms(text: Column | str) -> Column:
    """A query's terms: no stop words, each once, in order of first occurrence."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(document_terms(text), lambda w: ~F.array_contains(stop, w)))


def match_expression(terms: Column) -> Column:
    """Quoted terms joined by OR, stripped to letters, digits, _ and -."""
    clean = F.filter(F.transform(terms, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_-]", "")), lambda t: t != "")
    return F.array_join(F.transform(clean, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def long_words(text: Column | str, pattern: str = "[^a-z0-9_]+") -> Column:
    """Lower-cased words of over two characters, cut at the pattern; repeats stay."""
    return F.filter(F.split(F.lower(_c(text)), pattern), lambda w: F.length(w) > 2)


def content_words(text: Column | str) -> Column:
    return long_words(text, "[^a-z0-9']+")


def coverage(needle: Column, hay: Column) -> Column:
    """Share of the needle's content words (repeats count) that the other words have; 0 without any."""
    return F.when(F.size(needle) > 0, F.size(F.filter(needle, lambda w: F.array_contains(hay, w))) / F.size(needle)).otherwise(0.0)


def clip(text: Column | str, most: int) -> Column:
    """Whole if short; else its first characters, white space cut from the end, and an ellipsis."""
    t = _c(text)
    return F.when(F.char_length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most), r"(?U)\s+$", ""), F.lit("…"))).otherwise(t)


def excerpt(line: Column | str) -> Column:
    t = _c(line)
    return F.when(F.char_length(t) > EXCERPT, F.concat(F.substring(t, 1, EXCERPT_KEPT), F.lit("…"))).otherwise(t)


def lines_of(text: Column | str) -> Column:
    """Lines without their ends; a last line end begins no line."""
    parts = F.split(_c(text), "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def slice_lines(text: Column | str, first: Column, last: Column) -> Column:
    """Lines first..last (from 1, last may lie beyond the end) joined again."""
    return F.array_join(F.slice(lines_of(text), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def only_latin(text: Column | str) -> Column:
    """False when a letter belongs to a script other than Latin, Common and Inherited."""
    return ~_c(text).rlike(r"(?!\p{IsLatin}|\p{IsCommon}|\p{IsInherited})\p{IsAlphabetic}")


def without_other_scripts(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?!\p{IsLatin})[\p{L}\p{M}]", " ")


def reference_name(name: Column | str) -> Column:
    """True for names that can be references: over one byte and not built in."""
    return (F.octet_length(_c(name)) > 1) & ~_c(name).isin(BUILTIN_NAMES)


def type_name(name: Column | str) -> Column:
    return _c(name).rlike(r"^\p{Lu}")


def token_estimate(text: Column | str) -> Column:
    return F.floor((F.octet_length(_c(text)) + 3) / 4).cast("long")


def line_value(text: Column | str, label: str) -> Column:
    """What follows a label at the start of a line; null where no line has it."""
    found = F.regexp_extract(_c(text), f"(?m)^{label}: (.*)$", 1)
    return F.when(found != "", found)


def session_of(summary: Column | str, body: Column | str) -> Column:
    """First sess-number in the summary, else in the body, else empty."""
    a, b = F.regexp_extract(_c(summary), r"sess-\d+", 0), F.regexp_extract(_c(body), r"sess-\d+", 0)
    return F.when(a != "", a).otherwise(b)


def batch_index(reference: Column | str) -> Column:
    """The number of a #N reference to the same batch; null for an id."""
    r = F.trim(_c(reference))
    return F.when(r.rlike("^#[0-9]+$"), F.substring(r, 2, 20).cast("long"))


def identifiers(text: Column | str, most: int = 8, stop: list[str] | None = None) -> Column:
    """First distinct identifiers of a question that are no stop words."""
    without = F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)]).cast("array<string>")
    found = F.regexp_extract_all(_c(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), 1)
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~F.array_contains(without, F.lower(w)))), 1, most)


def names_word(text: Column | str, name: Column | str) -> Column:
    """True where the text has the name as a whole word."""
    return F.regexp_like(_c(text), F.concat(F.lit(r"(?U)\b\Q"), F.replace(_c(name), F.lit(r"\E"), F.lit("")), F.lit(r"\E\b")))
