"""Virtual paths, languages and symbol kinds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "cpp", "hh": "cpp", "hpp": "cpp",
    "hxx": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "cs": "csharp",
}
# Directories that hold no sources of a project.
SKIPPED_DIRECTORIES = ["target", "node_modules", ".git", "vendor", "dist"]

# Kinds of symbols, and what they add to a candidate's score.
TYPE_KINDS = ["struct", "class", "trait", "enum", "type_alias"]
CALL_KINDS = ["function", "method"]
KIND_SCORES = {"function": 0.06, "method": 0.04}
TYPE_SCORE, OTHER_SCORE = 0.10, 0.02


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def top_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_test(path: Column) -> Column:
    return path.startswith("tests/") | path.contains("/tests/") | path.contains("/test/")


def normalized(path: Column) -> Column:
    """Without surrounding blanks and slashes and leading ./ (repeated)."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), "^(\\./)+", ""), "^/+|/+$", "")


def in_scope(path: Column, scope: Column) -> Column:
    """Equal or below; an empty scope has everything."""
    return (scope == "") | (path == scope) | path.startswith(F.concat(scope, F.lit("/")))


def hinted(path: Column, hint: Column) -> Column:
    """ASCII-caseless part of the path; an empty hint never matches."""
    needle = F.lower(F.regexp_replace(hint, "^/+|/+$", ""))
    return (needle != "") & F.contains(F.lower(path), needle)


def kind_score(kind: Column) -> Column:
    c = F.when(kind.isin(TYPE_KINDS), TYPE_SCORE)
    for k, v in KIND_SCORES.items():
        c = c.when(kind == k, v)
    return c.otherwise(OTHER_SCORE)


def file_and_symbol(path: Column) -> tuple[Column, Column]:
    """(file, symbol): a known source file by itself, or followed by / and a symbol; else both null (a directory)."""
    whole = language(path).isNotNull()
    head = directory(path)
    with_symbol = ~whole & language(head).isNotNull()
    return F.when(whole, path).when(with_symbol, head), F.when(with_symbol, file_name(path))


def prefixed(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat_ws("/", prefix, name))


def safe_relative(path: Column) -> Column:
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)|:|\\") & (path != "")


def unprefixed(prefix: Column, name: Column) -> Column:
    """A shown path or id without its project's prefix; null where it lies outside the project."""
    inside = F.startswith(name, F.concat(prefix, F.lit("/")))
    return F.when(prefix == "", name).when(inside, F.substring(name, F.length(prefix) + 2, F.length(name)))


def trailing_name(symbol: Column) -> Column:
    """The last identifier of a stable symbol id, whose closing marks are left out; '' where there is none."""
    return F.regexp_extract(F.regexp_replace(symbol, r"[().#:/;\[\]`]+$", ""), r"(?U)(\w*)$", 1)


def path_hint(symbol: Column) -> Column:
    """The part of a stable symbol id that tells the module's path; all of a file: id."""
    rest = F.element_at(F.split(F.trim(symbol), r"\s+"), -1)
    rest = F.split_part(F.split_part(rest, F.lit("#"), F.lit(1)), F.lit("."), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(rest, "/impl$", ""), "`", "")
    return F.when(F.startswith(symbol, F.lit("file:")), F.substring(symbol, F.lit(6), F.length(symbol))).otherwise(F.regexp_replace(rest, "^/+|/+$", ""))


def path_fits(path: Column, hint: Column) -> Column:
    """True where a file's path and a path hint mean the same module: one is part of the other, or the hint's module, or
    the file name's stem, is in the path."""
    p = F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"^[./]+", "")
    h = F.lower(F.regexp_replace(hint, "^/+|/+$", ""))
    parts = F.filter(F.split(h, "/"), lambda x: (x != "") & (x != "crate"))
    n = F.size(parts)
    last = F.try_element_at(parts, n)
    module = F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), "/")).otherwise("")
    stem_part = F.when(n > 1, F.try_element_at(parts, F.greatest(n - 1, F.lit(1)))).otherwise(last)
    by_stem = F.contains(F.concat(F.lit("/"), p), F.concat(F.lit("/"), stem_part, F.lit("."))) | F.endswith(p, F.concat(F.lit("/"), stem_part, F.lit(".rs"))) | F.endswith(p, F.concat(F.lit("/"), stem_part, F.lit(".py")))
    fits = F.when(F.endswith(last, F.lit(".rs")) | F.endswith(last, F.lit(".py")), F.contains(p, last)).otherwise(((module != "") & F.contains(p, module)) | by_stem)
    return F.when((p == "") | (h == ""), False).when(F.contains(p, h) | F.contains(h, p), True).when(n == 0, False).otherwise(fits)
