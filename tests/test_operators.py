"""Operators on small inputs with known results."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, ids, index, lineage, metrics, parsers, retrieval, scan, snapshot, vfs, write_path
from tessera.sources import tables
from tessera.sources.store import Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fusion_values(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, id int, rank int")
    got = {r.id: r.relevance for r in retrieval.fuse([a, a]).collect()}
    assert math.isclose(got[10], 2.0) and math.isclose(got[11], 2 * 61 / 62)


def test_gate(spark):
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.7), (1, 3, 0.5), (2, 1, -1.0), (2, 2, -2.0)], "qid int, id int, score double")
    got = retrieval.gate(retrieval.top(s, 20), 0.3).select("qid", "id")
    assert rows(got) == [(1, 1), (1, 2), (2, 1)]


def test_tails_and_fold(spark):
    r = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(40)], "id int, supersedes_id int")
    assert all(t == i // 10 * 10 + 9 for i, t in rows(lineage.tails(r)))


def test_breadcrumbs_drop_dangling(spark):
    n = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "gone", "X")], "id string, parent_id string, label string")
    assert rows(lineage.breadcrumbs(n)) == [("a", 0, ["A"]), ("b", 1, ["A", "B"]), ("c", 2, ["A", "B", "C"])]
    assert rows(lineage.subtree_counts(n)) == [("a", 2), ("b", 1), ("c", 0), ("x", 0)]


def test_snippets(spark):
    r = spark.createDataFrame([(1, "direct", 1, 1.0, "x" * 2000), (1, "direct", 2, 0.5, "y" * 2000), (1, "direct", 3, 0.995, "z" * 2000), (1, "link", 1, 0.1, "s")], "qid int, source string, rank int, relevance double, body string")
    got = {(x.source, x.rank): (x.body_truncated, len(x.body)) for x in retrieval.snippets(r).collect()}
    assert got == {("direct", 1): (False, 2000), ("direct", 2): (True, 241), ("direct", 3): (False, 2000), ("link", 1): (False, 1)}


def test_find_order(spark):
    names = ["Parser", "parse", "parse_ref", "parsexref", "reparse", "parser", "parse_ref"]
    n = spark.createDataFrame([(str(i), "struct" if x == "Parser" else "function", x, "a.rs", i, i) for i, x in enumerate(names)], "id string, kind string, name string, file_path string, start_line int, end_line int")
    q = spark.createDataFrame([("q", "PARSE"), ("u", "_")], "qid string, query string")
    got = graph.find(n, q)
    order = [r.name for r in got.filter("qid = 'q'").orderBy("rank").collect()]
    assert len(order) == 7 and order[:2] == ["parse", "Parser"] and order[-1] == "reparse"
    assert got.filter("qid = 'u'").count() == 2


@pytest.mark.parametrize(
    "cands, want",
    [
        ([("a", "function", "x/a.rs"), ("b", "function", "y/b.rs")], ["a"]),
        ([("a", "function", "y/b.rs"), ("b", "function", "z/c.rs")], ["a", "b"]),
        ([("a", "struct", "y/b.rs"), ("b", "function", "z/c.rs"), ("c", "function", "z/d.rs"), ("d", "function", "z/e.rs")], ["b", "c", "d"]),
        ([("a", "function", "y/tests/b.rs"), ("b", "struct", "y/tests/c.rs")], []),
        ([("a", "function", "y/tests/b.rs")], ["a"]),
    ],
)
def test_resolution(spark, cands, want):
    refs = spark.createDataFrame([("r", "run", "x/m.rs", ["function", "method"], None)], "ref_id string, name string, file_path string, prefer array<string>, qualifier string")
    c = spark.createDataFrame([(i, "run", k, p) for i, k, p in cands], "id string, name string, kind string, file_path string")
    assert sorted(r.id for r in graph.resolve(refs, c).collect()) == want


def test_pick(spark):
    n = spark.createDataFrame([("1", "class", "P", "app/gen.py", 1, 2), ("2", "function", "P", "mirror/gen.py", 1, 2), ("3", "class", "Q", "x.py", 1, 2)], "id string, kind string, name string, file_path string, start_line int, end_line int")
    asked = spark.createDataFrame([("none", "P", None, None, None), ("file", "P", "app", None, None), ("wrong", "P", "zzz", None, None), ("one", "Q", "zzz", None, None)], "qid string, name string, file string, kind_hint string, scope string")
    got = graph.pick(n, asked).select("qid", "id", "status", "total")
    assert rows(got) == [("file", "1", "ok", 1), ("none", "1", "ambiguous", 2), ("none", "2", "ambiguous", 2), ("one", "3", "ok", 1), ("wrong", "1", "ambiguous", 2), ("wrong", "2", "ambiguous", 2)]


def test_grep_symbols(spark):
    files = spark.createDataFrame([("a.rs", "// needle\nfn f() {\n  needle\n}\n")], "file_path string, text string")
    q = spark.createDataFrame([("n", "needle")], "qid string, query string")
    spans = spark.createDataFrame([("f", "a.rs", 2, 4)], "id string, file_path string, start_line int, end_line int")
    assert rows(vfs.grep_symbols(files, q, spans).select("line", "symbol", "total")) == [(1, None, 2), (3, "f", 2)]


def test_diff_and_incremental(spark):
    old = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "h"), ("c", 1, 1, "h"), ("d", 1, 1, "h")], "path string, size int, mtime int, hash string")
    new = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 2, "h"), ("c", 2, 2, "i"), ("e", 1, 1, "h"), ("f", 1, 1, None)], "path string, size int, mtime int, hash string")
    status = snapshot.diff(old, new)
    assert rows(status) == [("a", "unchanged"), ("b", "touched"), ("c", "modified"), ("d", "removed"), ("e", "added"), ("f", "skipped")]
    assert tuple(snapshot.report(status).first()) == (5, 1, 1, 1, 1, 2, 1)
    forced = snapshot.diff(old, new, F.lit(True))
    assert {s for _, s in rows(forced)} == {"modified", "removed", "added", "skipped"}
    fresh = new.filter("path in ('c', 'e')")
    assert [r[0] for r in rows(snapshot.replaced(old, fresh, status.filter("status = 'removed'").select("path"), "path"))] == ["a", "b", "c", "e"]


def test_quantiles_differ(spark):
    rnd = random.Random(1)
    groups = {"ten": [float(x) for x in range(1, 11)], "one": [3.0], "ties": [2.0] * 500 + [1.0], "many": [float(rnd.randrange(3000)) for _ in range(5001)], "none": [None]}
    d = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r for r in metrics.quantiles(d, "k", "v").collect()}
    assert tuple(got["ten"])[1:] == (10, 5.0, 10.0, 6.0, 5.5, pytest.approx(9.9))
    assert tuple(got["none"])[1:] == (0, None, None, None, None, None)
    for k in ("one", "ties", "many"):
        v = sorted(groups[k])
        n, r = len(v), got[k]
        assert (r.p50, r.p95, r.upper_median, r.median) == (v[round(0.5 * (n - 1))], v[round(0.95 * (n - 1))], v[n // 2], statistics.median(v))
        assert r.p90 is None if n == 1 else r.p90 == pytest.approx(statistics.quantiles(v, n=10)[-1])


def test_scenarios(spark):
    def score(kind, expected, returned, k=None):
        a = [F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (expected, returned)]
        return spark.range(1).select(metrics.scenario_score(F.lit(kind), *a, F.lit(k).cast("int"))).first()[0]

    assert score("exact_symbol", ["a"], ["a", "b"]) == 1.0
    assert score("exact_symbol", ["b"], ["a", "b"]) == 0.0
    assert score("in_top_k", ["c"], ["a", "b", "c"], 2) == 0.0
    assert score("exact_set", [], []) == 1.0
    assert score("exact_set", ["a", "b"], ["a"]) == pytest.approx(2 / 3)
    assert score("contains", ["a", "b"], ["b", "z"]) == 0.5


def test_write_rules(spark):
    d = spark.createDataFrame(
        [
            ("ok", 0, "n0", "topic", "b", None, None, []),
            ("ok", 1, "n1", "shell", "b", "#0", "old", ["#0", "#0", "old"]),
            ("bad", 0, "m0", "при", " ", None, "#1", []),
            ("bad", 1, "m1", "s", "b", "#9", "#0", ["gone", "m1"]),
        ],
        "batch string, i int, id string, summary string, body string, parent string, supersedes string, links array<string>",
    )
    stored = spark.createDataFrame([("old", None, "root"), ("root", None, None)], "id string, supersedes_id string, parent_id string")
    found = write_path.errors(d, stored.select("id", "supersedes_id"))
    assert rows(found.filter("batch = 'ok'")) == []
    assert {(r.i, r.field, r.error) for r in found.collect()} == {(0, "summary", "script"), (0, "body", "empty"), (1, "parent", "range"), (1, "links", "missing"), (1, "links", "self"), (0, "supersedes", "circle"), (1, "supersedes", "circle")}
    assert [r.id for r in write_path.accepted(d, found).orderBy("i").collect()] == ["n0", "n1"]
    assert rows(write_path.distinct_links(d.filter("batch = 'ok'"))) == [("ok", 1, ["n0", "old"])]
    assert {(r.batch, r.i): r.parent_id for r in write_path.inherited_parents(d.filter("batch = 'ok'"), stored.select("id", "parent_id")).collect()} == {("ok", 0): None, ("ok", 1): "n0"}


def test_parsers(spark):
    files = spark.createDataFrame([("a.py", "python", "class A(Base):\n    def run(self):\n        helper(1)\n\ndef helper(x):\n    return x\n"), ("b.rs", "rust", "struct S;\nimpl T for S {\n    fn go(&self) {\n        work();\n    }\n}\n"), ("c.py", "python", "def (")], "file_path string, language string, text string")
    got = {(r.file_path, r.what, r.kind, r.name, r.within) for r in parsers.parsed(files).collect()}
    assert {("a.py", "def", "class", "A", None), ("a.py", "def", "method", "run", "A"), ("a.py", "impl", "implements", "Base", "A"), ("a.py", "ref", "calls", "helper", "run"), ("b.rs", "def", "struct", "S", None), ("b.rs", "impl", "implements", "T", "S"), ("b.rs", "ref", "calls", "work", "go"), ("c.py", "skipped", "", "", None)} <= got


def test_source_tree(spark, tmp_path):
    root = tmp_path / "it's here"
    files = {
        "a.rs": "fn x() {}", "target/b.rs": "", "sub/.git/HEAD": "", "sub/c.rs": "", "keep/d.py": "x", "skipme/e.py": "", "n.txt": "", ".hidden.py": "h", ".github/f.py": "g", "_x/g.go": "",
        ".gitignore": "# c\nskipme/\n*.log.py\n/top.py\nout/**/z.py\n!kept.log.py\n", "in/.gitignore": "!*.log.py\nlocal.py\n", "a.log.py": "", "kept.log.py": "", "in/b.log.py": "", "in/local.py": "", "local.py": "",
        "top.py": "", "in/top.py": "", "out/1/2/z.py": "", "out/z.py": "", "skipme/kept.log.py": "",
    }
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    got = tables.source_tree(spark, str(root))
    assert [r.path for r in got.orderBy("path").collect()] == sorted(["a.rs", "keep/d.py", ".hidden.py", ".github/f.py", "_x/g.go", "kept.log.py", "in/b.log.py", "local.py", "in/top.py"])
    assert {r.path: (r.text, r.size) for r in got.collect()}[".hidden.py"] == ("h", 1)
    rules = tables.ignore_rules(spark.createDataFrame([("# c",), ("skipme/",), ("*.py",)], "line string"))
    assert rows(tables.source_tree(spark, str(root), rules).select("path", "language")) == [("_x/g.go", "go"), ("a.rs", "rust")]
    assert rows(tables.nested_projects(spark, str(root))) == [("sub",)]


def test_datasets_results_codec(spark, tmp_path, monkeypatch):
    from tessera.functions import codec

    (tmp_path / "d.toml").write_text('[datasets]\none = "../x/one"\n')
    assert tables.dataset(str(tmp_path / "d.toml"), "one") == str(tmp_path.parent / "x/one")
    monkeypatch.setenv("DATASET_ONE", "/elsewhere")
    assert tables.dataset(str(tmp_path / "d.toml"), "one") == "/elsewhere"
    with pytest.raises(KeyError):
        tables.dataset(str(tmp_path / "d.toml"), "two")
    tables.write_results(spark.range(1), spark.range(3), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/rows")).count() == 3
    v = spark.createDataFrame([([1.0, -2.5],), (None,), ([],)], "v array<double>").select(codec.unpacked_vector(codec.packed_vector("v")).alias("v"))
    assert [r.v for r in v.collect()] == [[1.0, -2.5], None, []]
    j = spark.createDataFrame([('{"k": 1, "z": 2}',), ("no",), ('{"k": "x"}',)], "j string").select(tables.lenient_json(F.col("j"), "k int").alias("j"))
    assert [r.j and r.j.k for r in j.collect()] == [1, None, None] and tables.as_text({"a": ["é"]}) == '{"a":["é"]}'


def test_id_catalog(spark):
    known = spark.createDataFrame([("ra x m/run#go().", None, 1), ("file:src/a.py", "a", 2), ("local 3", "go", 3), ("ra x other/b#go().", None, 4)], "id string, asked string, ordinal int")
    c = ids.catalog(known)
    assert [r.id for r in c.filter("name = 'go'").orderBy("place").collect()] == ["ra x m/run#go().", "ra x other/b#go().", "local 3"]
    assert rows(c.filter("name = 'a.py'").select("id")) == [("file:src/a.py",)]
    found = spark.createDataFrame([("q", 1, "go", "src/other/b.rs"), ("q", 2, "go", "zzz.rs")], "qid string, rank int, name string, file_path string")
    assert [r.id for r in ids.mapped(found, c).orderBy("rank").collect()] == ["ra x other/b#go().", "ra x m/run#go().", "local 3"]


def test_sample_and_append(spark, tmp_path):
    d = spark.range(100).toDF("id")
    a = tables.seeded_sample(d, F.col("id"), 10, 42)
    assert rows(a) == rows(tables.seeded_sample(d.repartition(3), F.col("id"), 10, 42)) and a.count() == 10
    path = str(tmp_path / "t")
    tables.append(d, path)
    assert spark.read.parquet(path).count() == 100


def test_tails_of_a_long_chain(spark):
    n = 10_000
    r = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("supersedes_id"))
    assert lineage.tails(r).filter(F.col("tail") != n - 1).isEmpty()


def test_inherited_parents_of_a_long_chain(spark):
    n = 40
    d = spark.createDataFrame([("b", i, f"n{i}", "s", "b", None, f"#{i - 1}" if i else "old", []) for i in range(n)], "batch string, i int, id string, summary string, body string, parent string, supersedes string, links array<string>")
    stored = spark.createDataFrame([("old", "root")], "id string, parent_id string")
    assert {r.parent_id for r in write_path.inherited_parents(d, stored).collect()} == {"root"}


def test_subtree_counts_of_a_long_chain(spark):
    n = 200
    d = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert {r.id: r.below for r in lineage.subtree_counts(d).collect()} == {i: n - 1 - i for i in range(n)}


def test_tree_order_and_links_in_order(spark):
    n = spark.createDataFrame([("a", None, "A", 5), ("b", "a", "B", 9), ("c", "a", "C", 3), ("d", "b", "D", 1)], "id string, parent_id string, label string, created_at long")
    assert [(r.id, r.line) for r in lineage.tree_order(n).orderBy("sort_key").collect()] == [("a", "A"), ("c", "  C"), ("b", "  B"), ("d", "    D")]
    links = spark.createDataFrame([("x", "z", 1), ("y", "x", 2), ("x", "a", 3), ("z", "x", 4), ("x", "x", 5)], "source_id string, target_id string, ordinal int")
    assert {r.id: r.links for r in lineage.ordered_neighbours(links).collect()}["x"] == ["z", "a", "y"]


@pytest.mark.parametrize("most", [1000, 2])
def test_scans(spark, monkeypatch, most):
    for name in ("VECTORS", "WORD_LISTS", "NEEDLES"):
        monkeypatch.setattr(scan, name, most)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(6, None), (7, [1.0]), (8, [0.0, 0.0])], "id long, vector array<double>")
    q = v.filter("id < 5").withColumnRenamed("id", "qid")
    got = {(r.qid, r.id): r.score for r in scan.nearest(v, q, 20, drop_self=True).collect()}
    assert set(got) == {(a, b) for a in range(5) for b in range(9) if a != b}
    assert got[1, 2] == pytest.approx(3 / math.sqrt(10)) and got[1, 6] == got[1, 7] == got[1, 8] == 0
    assert scan.nearest(v.limit(0), q, 20).count() == 0 == scan.nearest(v, q.limit(0), 20).count()
    texts = spark.createDataFrame([(1, "the cat sat"), (2, "concatenate"), (3, None), (4, ""), (5, "dog")], "id long, text string")
    words = spark.createDataFrame([("a", ["cat", "cat", "sat"]), ("b", ["dog"]), ("c", []), ("d", ["zebra"])], "qid string, words array<string>")
    assert rows(scan.word_hits(texts, words, 5)) == [("a", 1, 3), ("a", 2, 2), ("b", 5, 1)]
    needles = spark.createDataFrame([("a", "cat"), ("b", "cat s"), ("c", ""), ("d", None), ("e", "dog")], "qid string, needle string")
    assert rows(scan.containing(texts, needles)) == [("a", 1), ("a", 2), ("b", 1), ("e", 5)]


def lexical(spark, records, queries, stems=False):
    r = spark.createDataFrame(records, "id string, summary string, body string")
    q = spark.createDataFrame(queries, "qid string, text string")
    from tessera.functions.stem import with_stems

    terms = T.query_terms("text")
    return retrieval.bm25_hits(r.select("id", T.lexical_row("summary", "body", stems).alias("words")), q.select("qid", T.phrases(with_stems(terms) if stems else terms).alias("words")))


def test_lexical_index(spark):
    row = spark.range(1).select(T.lexical_row(F.lit("Café notes"), F.lit("parseHTTP multi-arch"))).first()[0]
    assert row == ["cafe", "notes", T.COLUMN_END, "cafe", "notes", "parsehttp", "parse", "http", "multi", "arch", "multi", "arch"]
    stemmed = spark.range(1).select(T.lexical_row(F.lit("stored"), F.lit("stored"), True)).first()[0]
    assert stemmed == ["stored", T.COLUMN_END, "stored", "store", "stored", "store"]
    records = [("a", "multi build", "arch and multi-arch images"), ("b", "x", "arch then multi"), ("c", "build", "nothing"), ("d", "other", "words"), ("e", "more", "words here")]
    got = {(r.qid, r.id): r.score for r in lexical(spark, records, [("p", "multi-arch")]).collect()}
    n, df = 5, {"multi arch": 1, "multi": 2, "arch": 2}
    length = {i: len([w for w in T_words(spark, s, b) if w]) for i, s, b in records}
    mean = sum(length.values()) / n
    counts = {"a": {"multi arch": 2, "multi": 4, "arch": 3}, "b": {"multi arch": 0, "multi": 1, "arch": 1}}

    def bm25(i):
        out = 0.0
        for t, f in counts[i].items():
            idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
            out += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[i] / mean))
        return out

    assert got[("p", "a")] == pytest.approx(bm25("a")) and got.get(("p", "b"), bm25("b")) == pytest.approx(bm25("b"))


def T_words(spark, summary, body):
    return spark.range(1).select(T.lexical_row(F.lit(summary), F.lit(body))).first()[0]


def test_a_shared_short_token_is_no_lexical_match(spark):
    records = [("exact", "bundledToolSchemas holds the five vfs tool schemas", "bundledToolSchemas.ts is kept in sync with toolMetadata.ts"), ("hot", "vfs_replace zeroes m_Script", "status missing maps to fileID 0 in yamlCompactInvert.ts")]
    records += [(t, t, f"{t} notes for the daemon") for t in ("serve lock", "ndjson line limit", "query worker", "index build")]
    got = [r.id for r in lexical(spark, records, [("q", "Is bundledToolSchemas.ts generated or updated by a script?")], stems=True).orderBy("rank").collect()]
    assert got == ["exact"]


def test_index_upkeep(spark):
    old = spark.createDataFrame([("s", "b", ["mine"], 2), ("s", "b", ["old"], 1), ("s", "b", None, None)], "summary string, body string, index_words array<string>, index_version int")
    assert sorted(r.index_words for r in retrieval.retokenized(old, 2).collect()) == [["mine"], ["s", "", "s", "b"], ["s", "", "s", "b"]]


def test_given_embedder(spark):
    r = spark.createDataFrame([(1, "ab", [1.0], "old"), (2, "abc", None, None)], "id long, body string, vector array<double>, embedding_model string")
    got = retrieval.reembedded(r, "lengths", F.col("body"), 2, lambda texts: texts.map(lambda t: [float(len(t)), 0.0])).orderBy("id").collect()
    assert [(x.vector, x.embedding_model) for x in got] == [([2.0, 0.0], "lengths"), (None, None)]


def test_public_json(spark):
    r = spark.createDataFrame([(1, 7, 0.555001, None), (1, 8, 0.2, [3])], "qid int, id int, score double, linked_from array<int>")
    got = retrieval.as_json(r, "qid", ["id"]).first().json
    assert json.loads(got) == [{"id": 7, "score": 0.555001}, {"id": 8, "score": 0.2, "linked_from": [3]}]


def test_shapes_and_batches(spark, tmp_path):
    documents = spark.createDataFrame(
        [
            ("ok", json.dumps([{"summary": " a ", "body": "x", "parent": " "}, {"summary": "b", "body": "y", "supersedes": "#0", "links": ["#0", " ", "old"]}])),
            ("shape", json.dumps([3, {"summary": "s", "body": "b", "extra": 1}, {"summary": " ", "body": "b"}, {"summary": "s", "body": 5}, {"summary": "s", "body": "b", "parent": 5}, {"summary": "s", "body": "b", "links": [1]}])),
            ("none", "{}"),
            ("empty", "[]"),
            ("text", "no json"),
        ],
        "batch string, json string",
    )
    assert rows(write_path.shape_errors(documents)) == [("empty", None, "empty"), ("none", None, "not an array"), ("shape", 0, "not an object"), ("shape", 1, "unknown field"), ("shape", 2, "summary"), ("shape", 3, "body"), ("shape", 4, "parent"), ("shape", 5, "links"), ("text", None, "no JSON")]
    drafts = write_path.parsed_drafts(documents.filter("batch = 'ok'")).withColumn("id", F.concat(F.lit("n"), F.col("i").cast("string")))
    assert [(r.summary, r.parent, r.supersedes, r.links) for r in drafts.orderBy("i").collect()] == [("a", None, None, []), ("b", None, "#0", ["#0", "old"])]
    store = Store(spark, str(tmp_path))
    store.commit(append={"records": spark.createDataFrame([("old", None, None, "o", "o")], "id string, parent_id string, supersedes_id string, summary string, body string")})
    bad = drafts.withColumn("batch", F.lit("bad")).withColumn("id", F.concat(F.lit("m"), "id")).withColumn("body", F.lit(" "))
    found = write_path.write_batches(drafts.unionByName(bad), store, 9)
    assert {(r.batch, r.field, r.error) for r in found.collect()} == {("bad", "body", "empty")}
    stored = {r.id: r for r in store.table("records").collect()}
    assert set(stored) == {"old", "n0", "n1"} and stored["n1"].supersedes_id == "n0" and stored["n1"].created_at == 9
    assert rows(store.table("links")) == [("n1", "n0"), ("n1", "old")]


def test_symbols_refs_and_reading(spark):
    n = spark.createDataFrame(
        [("a.rs:function:run:1", "function", "run", "a.rs", 1, 2), ("a.rs:function:new:4", "function", "new", "a.rs", 4, 4), ("a.rs:function:new:6", "function", "new", "a.rs", 6, 6), ("b/c.rs:function:run:1", "function", "run", "b/c.rs", 1, 1), ("file:a.rs", "file", "a.rs", "a.rs", 1, None)],
        "id string, kind string, name string, file_path string, start_line int, end_line int",
    )
    asked = spark.createDataFrame([("id", "b/c.rs:function:run:1"), ("path", "./a.rs/run"), ("name", "run"), ("gone", "zzz"), ("two", "a.rs/new")], "qid string, symbol string")
    got = {q: sorted(r.id for r in graph.symbol_candidates(n, asked).filter(F.col("qid") == q).collect()) for q in ("id", "path", "name", "gone", "two")}
    assert got == {"id": ["b/c.rs:function:run:1"], "path": ["a.rs:function:run:1"], "name": ["a.rs:function:run:1", "b/c.rs:function:run:1"], "gone": [], "two": ["a.rs:function:new:4", "a.rs:function:new:6"]}
    e = spark.createDataFrame([("a.rs:function:new:4", "a.rs:function:run:1", "calls", 4), ("b/c.rs:function:run:1", "a.rs:function:run:1", "calls", 1), ("file:a.rs", "a.rs:function:run:1", "contains", 1)], "source string, target string, kind string, line int")
    rows_of = [("in", "a.rs/run", True, None, None, None), ("scoped", "run", True, "a.rs", None, "b"), ("many", "run", True, None, None, None), ("out", "b/c.rs:function:run:1", False, None, None, None), ("none", "zzz", True, None, None, None)]
    refs = graph.ref(n, e, spark.createDataFrame(rows_of, "qid string, symbol string, incoming boolean, file string, kind_hint string, scope string"))
    found = {}
    for r in refs.collect():
        found.setdefault(r.qid, (r.status, set()))[1].add(r.id if r.status == "ok" else r.symbol_id)
    assert found == {"in": ("ok", {"a.rs:function:new:4", "b/c.rs:function:run:1"}), "scoped": ("ambiguous", {"a.rs:function:run:1", "b/c.rs:function:run:1"}), "many": ("ambiguous", {"a.rs:function:run:1", "b/c.rs:function:run:1"}), "out": ("ok", {"a.rs:function:run:1"}), "none": ("not_found", {None})}
    files = spark.createDataFrame([("a.rs", "fn run() {\n}\n\nnew\n\nnew\n"), ("b/c.rs", "x")], "file_path string, text string")
    paths = spark.createDataFrame([("i", "a.rs:function:run:1", False), ("s", "a.rs/run", False), ("w", "b/c.rs", True), ("o", "a.rs", False), ("m", "a.rs/new", False), ("g", "a.rs/zzz", False), ("d", "b", False)], "qid string, path string, full boolean")
    read = {}
    for r in vfs.read(files, n, paths).collect():
        read.setdefault(r.qid, []).append((r.status, r.kind, r.path, r.text))
    assert read["i"] == read["s"] == [("ok", "function", "a.rs/run", "fn run() {\n}")] and read["w"] == [("ok", "file", "b/c.rs", "x")]
    assert read["o"][0][3].startswith("a.rs\n  run  function  1-2") and [x[0] for x in read["m"]] == ["ambiguous"] * 2 and read["g"][0][0] == "not_found" and read["d"][0][0] == "no_file"
    files_asked = spark.createDataFrame([("exact", "a.rs"), ("suffix", "c.rs"), ("none", "z.rs")], "qid string, path string")
    assert sorted({(r.qid, r.id.split(":")[0]) for r in graph.file_symbols(n, files_asked).collect()}) == [("exact", "a.rs"), ("suffix", "b/c.rs")]
    assert (graph.state(n, files), graph.state(n.limit(0), files), graph.state(n.limit(0), files.limit(0))) == ("ok", "not_indexed", "empty")


def test_graph_from_source(spark):
    def files(texts):
        return spark.createDataFrame([(p, len(t), 0, t, "rust" if p.endswith("rs") else "python", t) for p, t in texts.items()], "path string, size long, mtime long, hash string, language string, text string")

    texts = {
        "a.rs": "pub trait Show {\n}\npub struct Box1 {\n}\nimpl Show for Box1 {\n    fn show(&self) {\n        helper(1);\n    }\n}\nfn helper(x: i32) {\n}\n",
        "b.rs": "fn run() {\n    helper(2);\n    Box1::show();\n}\nhelper(3);\n",
        "c.py": "class Base:\n    def go(self):\n        return run(self)\n\nclass Kid(Base):\n    def go2(self):\n        return 1\n",
    }
    g = index.full(files(texts))
    edges = {(r.source, r.target, r.kind) for r in g.edges.collect()}
    show, box, trait, helper, run = "a.rs:method:show:6", "a.rs:struct:Box1:3", "a.rs:trait:Show:1", "a.rs:function:helper:10", "b.rs:function:run:1"
    assert {(box, trait, "implements"), (box, show, "contains"), (show, box, "references"), (show, trait, "references"), (show, helper, "calls"), (run, helper, "calls"), (run, show, "calls"), ("file:a.rs", show, "contains"), ("c.py:class:Kid:5", "c.py:class:Base:1", "implements"), ("c.py:method:go:2", run, "calls")} <= edges
    assert not [r for r in g.refs.collect() if r.line == 5 and r.file_path == "b.rs"]  # outside every definition
    for change in ({"b.rs": "fn run() {\n}\nfn helper(y: i32) {\n}\n"}, {"a.rs": None, "d.rs": "struct Base {\n}\n", "c.py": "\n" + texts["c.py"]}):
        after = {p: t for p, t in (texts | change).items() if t is not None}
        phases = []
        kept, report = index.synced(g, files(after), phases.append)
        assert phases == ["scanning", "parsing", "storing", "resolving"]
        want = index.full(files(after))
        for got, full in ((kept.edges, want.edges), (kept.nodes, want.nodes), (kept.refs, want.refs), (kept.impls, want.impls)):
            assert rows(got.select(*full.columns)) == rows(full)
        assert report.first().parsed == sum(t is not None for t in change.values())


def test_path_hints_and_evaluation(spark):
    from tessera.functions import paths as P

    ids = ["rust-analyzer cargo clap 4 builder/command/Command#new().", "file:src/a.py", "x y `mod`/impl#run()."]
    got = spark.createDataFrame([(i,) for i in ids], "s string").select(P.trailing_name(F.col("s")), P.path_hint(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("new", "builder/command/Command"), ("py", "src/a.py"), ("run", "mod")]
    fits = [("clap_builder/src/builder/command.rs", "builder/command/Command", True), ("src/x.rs", "builder/command/Command", False), ("./src/a.py", "src/a.py", True), ("a.rs", "", False), ("src/lib.rs", "crate/lib/Thing", True)]
    d = spark.createDataFrame(fits, "p string, h string, want boolean")
    assert d.filter(P.path_fits(F.col("p"), F.col("h")) != F.col("want")).isEmpty()
    assert spark.range(1).select(P.unprefixed(F.lit("sub/x"), F.lit("sub/x/a.rs")), P.unprefixed(F.lit("sub"), F.lit("a.rs")), P.unprefixed(F.lit(""), F.lit("a"))).first()[:] == ("a.rs", None, "a")
    s = spark.createDataFrame([("Completion", "callers", "x", 1.0), ("Completion", "callees", "late", 0.0), ("Config", "callers", "x", 0.5)], "category string, op string, sub_type string, score double")
    got = {(r.level, r.key): (r.n, r.avg) for r in metrics.scenario_summary(s, ["late"]).collect()}
    assert got["raw", "all"] == (3, 0.5) and got["part", "deferred"] == (1, 0.0) and got["part", "supported"] == (2, 0.75) and got["op", "callers"] == (2, 0.75)
    assert got["weighted", "all"][1] == pytest.approx((0.5 * 0.28 + 0.5 * 0.04) / 0.32)
    ranked = spark.createDataFrame([(1, "D1", 1), (1, "D1", 2), (1, "D2", 3), (1, None, 4), (2, "D9", 1)], "qid int, turn_id string, rank int")
    evidence = spark.createDataFrame([(1, "multi", "D2"), (1, "multi", "D3"), (2, "open", "D1")], "qid int, category string, turn_id string")
    got = {r.category: (r.n, r.mrr, r.recall_5, r.hit_5) for r in metrics.evidence_recall(ranked, evidence).collect()}
    assert got == {"multi": (1, 0.5, 0.5, 1.0), "open": (1, 0.0, 0.0, 0.0), None: (2, 0.25, 0.25, 0.5)}
    gold = spark.createDataFrame([(True, True, True, 1), (True, True, True, None), (False, False, False, None), (True, False, True, None)], "indexed boolean, hop1 boolean, hop2 boolean, rank int")
    assert tuple(metrics.reach_shares(gold).first()) == (4, 0.75, 0.5, 0.75, 0.25, 0.25)
    assert rows(metrics.missing(spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(1,)], "x int"))) == [(2,)]
    words = lambda t: t.split()
    points = spark.createDataFrame([("p", words("cat sat mat"), True), ("q", words("dog ran"), True), ("r", words("cat sat"), False)], "point string, words array<string>, is_update boolean")
    originals = spark.createDataFrame([("p", words("cat lay mat")), ("q", words("dog sat")), ("r", words("cat"))], "point string, words array<string>")
    memories = spark.createDataFrame([(1, 1, words("cat lay mat"), None), (2, 2, words("cat sat mat"), 1), (3, 3, words("dog ran"), None)], "id int, ordinal int, words array<string>, supersedes_id int")
    assert tuple(metrics.update_rate(points, originals, memories).first()) == (1, 2, 0.5)
    judged = spark.createDataFrame([("qa", None, 1.0, False, "Correct"), ("qa", None, 1.0, False, "Omission")], "part string, score int, importance double, flag boolean, label string")
    assert metrics.combined_judgements(judged, judged.filter("label = 'Correct'")).first().qa_correct == pytest.approx(2 / 3)


def test_best_match_by_rare_words(spark):
    rnd = random.Random(2)
    pool = ["the"] * 30 + [f"w{i}" for i in range(40)]
    points = [(i, [rnd.choice(pool) for _ in range(rnd.randrange(1, 9))]) for i in range(30)]
    memories = [(i, i, [rnd.choice(pool) for _ in range(rnd.randrange(0, 25))]) for i in range(40)]
    p, m = spark.createDataFrame(points, "point int, words array<string>"), spark.createDataFrame(memories, "id int, ordinal int, words array<string>")
    want = sorted((q, i) for q, ws in points for i, _, has in memories if sum(w in has for w in ws) / len(ws) >= 0.55)
    assert sorted((r.point, r.id) for r in metrics.matches(p, m, 0.55).collect()) == want


def test_json_sources_manifest_and_chunks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 3}\n')
    assert rows(tables.json_records(spark, str(tmp_path / "a.json"))) == [(1,), (2,)] and rows(tables.json_records(spark, str(tmp_path / "b.jsonl"), True)) == [(1,), (3,)]
    m = spark.createDataFrame([("ok", "r", "c", "old", 1), ("ok", "r", "c", "new", 2), ("failed", "r", "d", "x", 3)], "status string, repo string, base_commit string, chunks_path string, ordinal int")
    assert rows(tables.manifest(m)) == [("r", "c", "new")]
    c = spark.createDataFrame([("file", "a", "1", 1), ("file", "a", "2", 2), ("symbol", "b", "3", 3)], "kind string, path string, text string, ordinal int")
    assert rows(tables.file_texts(c)) == [("a", "2")]


def test_nested_listing_touch_and_delete(spark):
    entries = spark.createDataFrame([("src", "dir"), ("sub", "dir")], "name string, kind string")
    assert rows(vfs.with_nested(entries, spark.createDataFrame([("sub",), ("other",)], "name string"))) == [("other", "project"), ("src", "dir"), ("sub", "project")]
    old = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "h")], "path string, size int, mtime int, hash string")
    new = spark.createDataFrame([("a", 1, 5, "h"), ("b", 1, 1, "h")], "path string, size int, mtime int, hash string")
    assert rows(snapshot.touched(old, new, snapshot.diff(old, new)).select("path", "mtime")) == [("a", 5), ("b", 1)]
    edges = spark.createDataFrame([("x", "y", "calls"), ("x", "gone", "calls"), ("gone", "y", "calls")], "source string, target string, kind string")
    assert rows(snapshot.without_edges_of(edges, spark.createDataFrame([("x",), ("y",)], "id string"))) == [("x", "y", "calls")]
    spans = spark.createDataFrame([("s", "a.rs", 2, 9)], "id string, file_path string, start_line int, end_line int")
    assert rows(vfs.read_spans(spark.createDataFrame([("a.rs", "1\n2\n3\n")], "file_path string, text string"), spans)) == [("s", "2\n3")]


def test_equal_symbol_questions_are_answered_once(spark, monkeypatch):
    """60 questions for a name that 80 nodes have: 80 rows are scored, not 4,800."""
    nodes = spark.createDataFrame([(f"n{i:02d}", "function", "common", f"d{i % 3}/f.rs", 1) for i in range(80)], "id string, kind string, name string, file_path string, start_line int")
    asked = spark.createDataFrame([(f"q{i}", "common" if i else None, None, None, None) for i in range(61)], "qid string, symbol string, file string, kind_hint string, scope string")
    seen, one = [], graph._picked
    monkeypatch.setattr(graph, "_picked", lambda found, limit: seen.append(found.count()) or one(found, limit))
    got = graph.picked(nodes, asked).collect()
    assert seen == [80]
    assert {r.qid for r in got if r.status == "not_found"} == {"q0"}
    assert sorted((r.qid, r.id, r["rank"], r.total) for r in got if r.id) == sorted((f"q{i}", f"n{k:02d}", k + 1, 80) for i in range(1, 61) for k in range(20))


def test_linked_facts_do_not_meet_all_with_all(spark):
    """Two facts in 400 memories each, linked by one link alone: the plan has no join of all hosts of both."""
    memories = spark.createDataFrame([("c", i, "alpha" if i % 2 else "beta") for i in range(800)] + [("e", 900, "alpha"), ("e", 901, "beta")], "case_id string, id long, text string")
    facts = spark.createDataFrame([(c, f, [f]) for c in "ce" for f in ("alpha", "beta")], "case_id string, fact string, must array<string>")
    links = spark.createDataFrame([(1, 2)], "id long, other long")
    q = metrics.write_quality(memories, facts, links, spark.createDataFrame([(c, "alpha", "beta") for c in "ce"], "case_id string, fact string, other string"))
    assert {r.case_id: (r.facts, r.covered, r.exclusive, r.link_hits, r.link_total, r.memories) for r in q.collect()} == {"c": (2, 2, 2, 1, 1, 800), "e": (2, 2, 2, 0, 1, 2)}
    assert "LeftSemi" in q._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_dealt_out_before_parsing(spark, monkeypatch):
    """Sources of one task are parsed by several."""
    files = spark.range(8, numPartitions=1).select(F.concat(F.lit("p"), "id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.lit("def f():\n    pass\n").alias("text"))
    seen, one = [], parsers.parsed
    monkeypatch.setattr(parsers, "parsed", lambda rows: seen.append(rows.rdd.getNumPartitions()) or one(rows))
    assert index.extracted(files)[0].count() == 16
    assert seen == [4]


def test_what_cuts_hide_is_not_broadcast_by_a_guess(spark, monkeypatch):
    """Rows that were parsed and exploded look small; only those that were counted are sent to all tasks. Names are resolved in one go."""
    text = F.concat(F.lit("class C"), "id", F.lit("(C1):\n    def go(self):\n        return make(C2.size)\n\ndef make(x):\n    return x\n"))
    files = spark.range(6).select(F.concat(F.lit("p"), "id", F.lit(".py")).alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit("h").alias("hash"), F.lit("python").alias("language"), text.alias("text"))
    want = rows(index.full(files).edges)
    seen, real = [], graph.cut
    for module in (graph, index):
        monkeypatch.setattr(module, "cut", lambda df: seen.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df))
    monkeypatch.setattr(graph, "BROADCAST_CANDIDATES", -1)
    assert rows(index.full(files).edges) == want and want
    assert sum("SortMergeJoin" in p for p in seen) > 5 and not any("BroadcastHashJoin" in p for p in seen)
    assert sum("posexplode(array(file_path" in p for p in seen) == 2  # candidates, and questions


def test_few_points_are_matched_in_one_pass(spark, monkeypatch):
    """A block of points makes no pairs of words; more points go by their rarest words, with the same matches."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    points = [(i, [rnd.choice(words[:12]) for _ in range(rnd.randrange(0, 8))]) for i in range(20)] + [(90, None), (91, ["nowhere", "w1"])]
    memories = [(i, [rnd.choice(words) for _ in range(rnd.randrange(0, 40))]) for i in range(100)] + [(500, None), (501, ["w1"])]
    p, m = spark.createDataFrame(points, "point long, words array<string>"), spark.createDataFrame(memories, "id long, words array<string>")
    want = sorted((a, i, h / len(w)) for a, w in points if w for i, v in memories for h in [sum(x in set(v or ()) for x in w)] if h / len(w) >= 0.5)
    rows = lambda: metrics.matches(p, m, 0.5)
    assert sorted(map(tuple, rows().collect())) == want and want
    plan = rows()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    monkeypatch.setattr(metrics.scan, "WORD_LISTS", 5)
    assert sorted(map(tuple, rows().collect())) == want


def test_questions_shuffle_numbers_alone(spark):
    """Names and paths of references stay where their classes are met; all that is grouped by a question is shuffled once."""
    refs = spark.createDataFrame([(f"r{i}", f"n{i % 7}", f"a/b{i % 5}/f{i % 11}.rs", ["function"], f"n{i % 7}" if i % 3 else None) for i in range(200)], "ref_id string, name string, file_path string, prefer array<string>, qualifier string")
    nodes = spark.createDataFrame([(f"d{i}", f"n{i % 7}", ["function", "struct"][i % 2], f"a/b{i % 5}/f{i % 13}.rs") for i in range(150)], "id string, name string, kind string, file_path string")
    seen = []
    real = graph.cut
    try:
        graph.cut = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df)
        got = graph.resolve(refs, nodes).count()
    finally:
        graph.cut = real
    wanted = [p for p in seen if "collect_list" in p]
    assert got and len(wanted) == 1 and "RepartitionByExpression [question" in wanted[0] and "Aggregate [question#" in wanted[0]
    assert not any("name#" in line for line in wanted[0].splitlines() if "Aggregate [question#" in line)


def test_texts_of_few_rows_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # texts and rows of no known size
    try:
        texts = spark.range(1000).select("id", F.concat(F.lit("text "), "id").alias("body"))
        asked = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 5000)], "qid int, id long")
        rows = retrieval.with_texts(asked, texts)
        assert sorted(map(tuple, rows.select("qid", "id", "body").collect())) == [(1, 7, "text 7"), (1, 8, "text 8"), (2, 7, "text 7")]
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
