"""The stored index against BM25 over the texts, after inserts, changes and deletes."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lexical_index, retrieval, scan
from tessera.sources.store import Store

POOL = ["run", "runTests", "HTTPServer2", "snake_case_name", "Été", "naïve", "the", "x1", "a-b", "日本", "l'eau", "deja", "déjà", "foo.bar", "", "###", "9lives"]


def record(rnd, i):
    words = [rnd.choice(POOL) for _ in range(rnd.randrange(0, 30))]
    return i, rnd.choice([None, "", "run the naïve HTTPServer2", "Été"]), rnd.choice([" ".join(words), "\n".join(words), None])


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, summary string, body string")


def queries(spark):
    texts = [(1, "runTests naïve"), (2, "snake_case_name"), (3, "a-b the"), (4, "zzz"), (5, "HTTPServer2 日本 l'eau"), (6, "deja vu")]
    return spark.createDataFrame(texts, "qid int, text string").select("qid", T.phrases(T.query_terms("text")).alias("words"))


def found(df):
    return sorted((r.qid, r.id, r["rank"], round(r.score, 9)) for r in df.collect())


def from_texts(spark, rows):
    return found(retrieval.bm25_hits(frame(spark, rows).select("id", T.lexical_row("summary", "body").alias("words")), queries(spark)))


def test_postings_are_those_of_the_texts(spark):
    rnd = random.Random(1)
    rows = frame(spark, [record(rnd, i) for i in range(200)])
    got = {(r.term, r.id): (r.tf, r.len, r.positions) for r in lexical_index.postings(rows).collect()}
    want = {}
    for r in rows.select("id", T.lexical_row("summary", "body").alias("w")).collect():
        for pos, w in enumerate(r.w):
            if w != T.COLUMN_END:
                want.setdefault((w, r.id), []).append(pos)
    lengths = {r.id: r.n for r in rows.select("id", F.size(F.array_remove(T.lexical_row("summary", "body"), T.COLUMN_END)).alias("n")).collect()}
    assert got == {k: (len(p), lengths[k[1]], p) for k, p in want.items()}


def test_the_index_is_kept_up(spark, tmp_path):
    rnd, store = random.Random(2), Store(spark, str(tmp_path))
    now = {i: record(rnd, i) for i in range(60)}
    lexical_index.change(store, frame(spark, list(now.values())))
    assert found(lexical_index.hits(store, queries(spark))) == from_texts(spark, list(now.values()))
    for step in range(1, 5):
        come = {i: record(rnd, i) for i in [rnd.randrange(60) for _ in range(5)] + [100 * step, 100 * step + 1]}
        gone = [i for i in (step, 30 + step, 999) if i not in come]
        now = {i: r for i, r in (now | come).items() if i not in gone}
        for _ in range(2):  # the second time changes nothing
            lexical_index.change(store, frame(spark, list(come.values())), spark.createDataFrame([(i,) for i in gone], "id long"), {"batch": step})
        facts = store.latest().facts
        assert facts["n"] == len(now)
        if step in (1, 4):
            assert found(lexical_index.hits(store, queries(spark))) == from_texts(spark, list(now.values()))
    assert facts["tiers"] == [1, 0] and facts["dead"] == store.latest().facts["dead"]
    assert store.table("postings").count() > lexical_index.live_postings(store, store.latest()).count() or not facts["dead"]


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    rows = [(1, "run", "the naïve x1"), (2, None, "runTests a-b"), (3, "a b", "b a")]
    lexical_index.change(store, frame(spark, rows))
    want = from_texts(spark, rows)
    monkeypatch.setattr(retrieval, "TERMS_AT_HAND", 1)
    assert found(lexical_index.hits(store, queries(spark))) == want


def test_an_empty_index(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    lexical_index.change(store, frame(spark, []))
    assert found(lexical_index.hits(store, queries(spark))) == [] and store.latest().facts["n"] == 0
    with pytest.raises(KeyError):
        store.table("nothing")


def test_slices_bound_what_a_task_holds():
    """A batch of long lists is worked on in parts; a row that is longer by itself is one."""
    rnd = random.Random(5)
    lists = [rnd.choice([None, [], ["w"] * rnd.randrange(9), ["w"] * 25]) for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, j)), pa.array(lists[i:j], pa.list_(pa.string()))], names=["id", "words"]) for i, j in ((0, 170), (170, 170), (170, 300))]
    parts = list(scan.slices(iter(batches), "words", 20))
    assert [x for p in parts for x in p.column("id").to_pylist()] == list(range(300))
    assert all(len(p) == 1 or sum(len(x or ()) for x in p.column("words").to_pylist()) <= 20 for p in parts) and len(parts) > 30


def test_batches_of_texts_are_bounded_in_bytes(spark):
    """Rows of long texts come to a task in batches of a few MB; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    texts = spark.range(400, numPartitions=1).select("id", F.lit("").alias("summary"), F.expr("repeat('word and ', 5000)").alias("body"))
    bytes_of = lambda df: [r.n for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()]
    assert max(bytes_of(texts)) > 16 << 20
    for use in (lambda: lexical_index.postings(texts), lambda: retrieval.hash_vectors(texts, "id", "body"), lambda: scan.containing(texts.select("id", F.col("body").alias("text")), texts.limit(1).select(F.col("id").alias("qid"), F.lit("word").alias("needle")))):
        spark.conf.unset(name)
        use()
        assert max(bytes_of(texts)) < 5 << 20
    spark.conf.set(name, "1m")
    lexical_index.postings(texts)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_a_run_is_written_once(spark, tmp_path, monkeypatch):
    """Postings go to the store's folder and are read from there; no copy of them is made before."""
    store, copies = Store(spark, str(tmp_path)), []
    monkeypatch.setattr(lexical_index, "cut", lambda df, cut=lexical_index.cut: copies.append(df.columns) or cut(df))
    lexical_index.change(store, frame(spark, [(1, "run", "the naïve x1"), (2, None, "runTests a-b")]))
    assert copies and not any("positions" in c for c in copies)
    run = store.put("postings", store.table("postings"), store.latest())
    assert store.rows(run).count() == store.table("postings").count() > 0 and run.folder not in store.parts("postings")
    store.vacuum()
    assert not (tmp_path / "data" / run.folder).exists() and store.table("postings").count() > 0


def test_sums_of_terms_meet_all_questions_in_one_place(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, t, 1 + rnd.random()) for i in range(300) for t in rnd.sample(range(40), rnd.randrange(0, 12))]
    asked = [(q, rnd.sample(range(50), rnd.randrange(1, 9))) for q in range(30)]
    want = {}
    for q, terms in asked:
        sums = {}
        for i, t, part in rows:
            if t in terms:
                sums[i] = sums.get(i, 0) + part
        want |= {(q, i): round(s, 9) for i, s in sorted(sums.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]}
    monkeypatch.setattr(scan, "WORD_LISTS", 7)  # several blocks
    got = scan.summed(spark.createDataFrame(rows, "id long, term long, part double"), spark.createDataFrame(asked, "qid long, terms array<long>"), 5).collect()
    got = sorted(got, key=lambda r: (r.qid, -round(r.score, 9), r.id))
    best = {q: [r for r in got if r.qid == q][:5] for q, _ in asked}
    assert {(q, r.id): round(r.score, 9) for q, found in best.items() for r in found} == want
    # No more rows than the best of each question from a task, whatever the pairs of question and row.
    assert len(got) <= 5 * len(asked) * 4 < 0.9 * sum(1 for q, terms in asked for i in range(300) if any(r[0] == i and r[1] in terms for r in rows))


def test_parts_of_sorted_batches_have_whole_groups():
    ids = [i for i in range(40) for _ in range(i % 7 + 1)]
    batches = [pa.RecordBatch.from_pydict({"id": ids[at : at + 5]}) for at in range(0, len(ids), 5)]
    parts = list(scan.whole_groups(iter(batches), "id", 12))
    assert len(parts) > 5 and [i for part, _ in parts for i in part.column("id").to_pylist()] == ids
    assert [i for part, starts in parts for i in part.column("id").take(pa.array(starts)).to_pylist()] == list(range(40))
    assert list(scan.whole_groups(iter([]), "id")) == []


def test_a_run_is_made_in_parts_of_bounded_text(spark, tmp_path, monkeypatch):
    """Records of one large file, a single task where they are read, are dealt out before their postings are sorted."""
    rnd = random.Random(7)
    rows = [record(rnd, i) for i in range(300)]
    one = frame(spark, rows).coalesce(1)
    assert lexical_index.dealt(one).rdd.getNumPartitions() == 1  # small: left as it is
    monkeypatch.setattr(lexical_index, "PART_BYTES", 1 << 10)
    store = Store(spark, str(tmp_path))
    lexical_index.change(store, one)
    per_task = [r["count"] for r in store.table("postings").groupBy(F.input_file_name().alias("f")).count().collect()]
    assert len(per_task) > 8 and max(per_task) < 0.3 * sum(per_task)
    assert found(lexical_index.hits(store, queries(spark))) == from_texts(spark, rows)
    assert lexical_index.dealt(frame(spark, [])).count() == 0
