"""Unit vectors of the scalar functions."""

import math

from pyspark.sql import functions as F

from tessera.functions import memory as M
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.functions.stem import stem, with_stems


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_query_terms_with_stems(spark):
    row = one(spark, with_stems(T.query_terms(F.lit("How are stored memories recalled?"))))
    assert row[0] == ["stored", "store", "memories", "memori", "recalled", "recal"]


def test_stem():
    words = {"running": "run", "generalization": "general", "happily": "happili", "sky": "sky", "cries": "cri", "ties": "tie", "agreed": "agre", "national": "nation", "hopping": "hop"}
    assert {w: stem(w) for w in words} == words


def test_identifier_words(spark):
    row = one(spark, T.identifier_words(F.lit("parseHTTPResponse2_fast-path")))
    assert row[0] == ["parse", "HTTP", "Response", "2", "fast", "path"]


def test_match_expression(spark):
    assert one(spark, T.match_expression(F.array(F.lit("a\"b"), F.lit("x-y"), F.lit("?"))))[0] == '"ab" OR "x-y"'


def test_clip_excerpt_lines(spark):
    row = one(spark, T.clip(F.lit("abc   def"), 5), T.clip(F.lit("abc"), 5), T.excerpt(F.lit("x" * 301)), T.lines_of(F.lit("a\r\nb\n")), T.slice_lines(F.lit("a\nb\nc"), F.lit(2), F.lit(9)))
    assert list(row) == ["abc…", "abc", "x" * 297 + "…", ["a", "b"], "b\nc"]


def test_scripts(spark):
    row = one(spark, T.only_latin(F.lit("naïve µ 5")), T.only_latin(F.lit("при")), T.without_other_scripts(F.lit("aпb")))
    assert list(row) == [True, False, "a b"]


def test_small_text_functions(spark):
    row = one(spark, T.reference_name(F.lit("self")), T.reference_name(F.lit("run")), T.type_name(F.lit("Éa")), T.token_estimate(F.lit("abcde")), T.line_value(F.lit("x\nDIA_ID: D1:2\n"), "DIA_ID"), T.session_of(F.lit("a"), F.lit("b sess-12")), T.batch_index(F.lit("#3")), T.batch_index(F.lit("x#3")))
    assert list(row) == [False, True, True, 2, "D1:2", "sess-12", 3, None]


def test_coverage(spark):
    row = one(spark, T.coverage(T.content_words(F.lit("red red car")), F.array(F.lit("red"))), T.coverage(T.content_words(F.lit("a b")), F.array(F.lit("a"))))
    assert row[0] == 2 / 3 and row[1] == 0.0


def test_forgetting(spark):
    day = M.DAY
    row = one(spark, M.retention(F.lit(7 * day), F.lit(0), F.lit(7.0)), M.needs_update(M.retention(F.lit(60 * day), F.lit(0), F.lit(7.0))), M.strengthened(F.lit(7.0)), M.age_days(F.lit(day * 2 + 5), F.lit(0)), M.stale(F.lit(30 * day), F.lit(0)))
    assert math.isclose(row[0], math.exp(-1)) and row[1] and math.isclose(row[2], 11.9) and row[3] == 2 and not row[4]


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = one(spark, M.cosine(a, a), M.cosine(a, z), M.cosine(a, F.array(F.lit(1.0))), M.unit(a), M.unit(z))
    assert list(row) == [1.0, 0.0, 0.0, [0.6, 0.8], [0.0, 0.0]]


def test_usable(spark):
    v = F.array_repeat(F.lit(1.0), 64)
    row = one(spark, M.usable(v, F.lit("hash"), "hash"), M.usable(v, F.lit(None).cast("string"), "hash"), M.usable(v, F.lit(" "), "other"), M.usable(F.lit(None).cast("array<double>"), F.lit("hash"), "hash"))
    assert list(row) == [True, True, False, False]


def test_paths(spark):
    f, s = P.file_and_symbol(F.lit("src/a.rs/run"))
    row = one(spark, P.language(F.lit("a/B.HPP")), P.language(F.lit("x.txt")), P.directory(F.lit("a/b/c.rs")), P.stem(F.lit("a/parser.rs")), P.normalized(F.lit(" ././a/b/ ")), P.in_scope(F.lit("a/b"), F.lit("")), P.hinted(F.lit("a/b"), F.lit("/")), P.is_test(F.lit("a/tests/b.rs")), f, s, P.safe_relative(F.lit("a/../b")))
    assert list(row) == ["cpp", None, "a/b", "parser", "a/b", True, False, True, "src/a.rs", "run", False]


def test_identifiers_and_whole_words(spark):
    row = one(spark, T.identifiers(F.lit("What does parseTree do with the tree_node and parseTree?")), T.names_word(F.lit("call run_all()"), F.lit("run")), T.names_word(F.lit("call run()"), F.lit("run")), T.folded(F.lit("ÀÉîß Ñ")))
    assert list(row) == [["parseTree", "tree_node"], False, True, "aeiß n"]


def test_stems_of_many_rows(spark):
    """Rows are taken in parts; nulls and empty ones keep their place."""
    from tessera.functions.stem import ROWS, variants_with_stems

    rows = [(i, None if i % 7 == 0 else [] if i % 7 == 1 else [["running", "run"], ["été"], [f"tests{i}", "tests"]]) for i in range(3 * ROWS + 5)]
    got = spark.createDataFrame(rows, "i int, v array<array<string>>").repartition(1).select("i", variants_with_stems("v").alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: ["running", "run", "été", f"tests{i}", "tests", "test"] if v else [] for i, v in rows}
