"""A stored graph kept up by syncs and streams: always what indexing the final tree as a whole gives."""

import pytest

from tessera.operators import index, stored_graph
from tessera.sources.store import Store
from tessera.streaming import watch

SCHEMA = "path string, size long, mtime long, hash string, language string, text string"


def files(spark, texts, mtime=0):
    return spark.createDataFrame([(p, len(t), mtime, t, "python", t) for p, t in texts.items()], SCHEMA)


def content(g):
    return [sorted(map(tuple, t.select(*sorted(t.columns)).collect()), key=repr) for t in g]


BEFORE = {
    "a.py": "class Base:\n    def go(self):\n        return run(self)\n",
    "b.py": "class Kid(Base):\n    def hop(self):\n        return run(self)\n",
    "c.py": "def run(x):\n    return x\n",
    "d.py": "def other(x):\n    return x\n",
}
AFTER = {"a.py": "\n\n" + BEFORE["a.py"], "b.py": BEFORE["b.py"], "d.py": BEFORE["d.py"], "e.py": "def run(x):\n    return other(x)\n"}


def test_a_sync_appends_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    phases = []
    assert stored_graph.sync(store, files(spark, BEFORE), tell=phases.append).first().added == 4
    assert phases == ["parsing", "storing", "resolving"]
    assert content(stored_graph.read(store)) == content(index.full(files(spark, BEFORE)))
    report = stored_graph.sync(store, files(spark, AFTER), marks={"x": 1}, tell=phases.append).first()
    assert (report.added, report.modified, report.removed, report.parsed) == (1, 1, 1, 2) and phases[3:] == ["scanning", "parsing", "storing", "resolving"]
    assert content(stored_graph.read(store)) == content(index.full(files(spark, AFTER)))
    assert stored_graph.sync(store, files(spark, BEFORE), marks={"x": 1}) is None
    rows = store.part("nodes", store.parts("nodes")[-1])
    assert {r.file_path for r in rows.collect()} == {"a.py", "e.py"}
    stored_graph.sync(store, files(spark, AFTER, mtime=5))  # touched: other times, the same rows
    assert content(stored_graph.read(store)) == content(index.full(files(spark, AFTER, mtime=5)))
    stored_graph.compact(store)
    assert content(stored_graph.read(store)) == content(index.full(files(spark, AFTER, mtime=5))) and len(store.parts("edges")) == 1
    assert content(index.refreshed(None, files(spark, BEFORE))) == content(index.refreshed(index.full(files(spark, AFTER)), files(spark, BEFORE)))


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_stream_that_is_killed_and_restarted_ends_at_the_final_tree(spark, tmp_path, monkeypatch, when):
    store = Store(spark, str(tmp_path / "store"))
    stored_graph.sync(store, files(spark, BEFORE))
    tree = {}

    def files_now(paths):
        return files(spark, tree).join(paths, "path", "left_semi")

    def run():
        events = spark.readStream.schema("kind string, path string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        watch.keep_graph(events, store, files_now, str(tmp_path / "cp")).awaitTermination(120)

    def tell(name, *rows):
        spark.createDataFrame(rows, "kind string, path string").coalesce(1).write.json(str(tmp_path / f"in-{name}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in-{name}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{name}.json")

    tree = {p: AFTER[p] for p in ("a.py", "b.py", "d.py")} | {"c.py": BEFORE["c.py"]}
    tell("1", ("modify_data", "a.py"), ("access", "b.py"))
    run()
    tree = AFTER
    tell("2", ("remove", "c.py"), ("create", "e.py"), ("modify_data", "d.py"))
    real = Store.commit

    def dying(self, *a, **b):
        if when == "after":
            real(self, *a, **b)
        raise Killed

    monkeypatch.setattr(Store, "commit", dying)
    with pytest.raises(Exception, match="Killed"):
        run()
    monkeypatch.undo()
    number = store.latest().number
    run()  # the same batch again
    assert store.latest().number == number + (when == "before")
    assert content(stored_graph.read(store)) == content(index.full(files(spark, AFTER)))
    assert store.latest().marks == {"watch": 1}
