import os

from corvid.engine import Engine
from corvid.streaming import changes

FILES = {
    ".gitignore": "*.skip.py\n",
    "src/__init__.py": "from . import a\n",
    "src/a.py": "def helper(x):\n    return x + 1\n\n\ndef main():\n    return helper(2)\n",
    "src/b.py": "from a import helper\n\n\nclass B:\n    def run(self):\n        helper(3)\n",
    "src/c.skip.py": "x = 1\n",
    "node_modules/q.js": "y()\n",
    "README.md": "# Notes\nThe helper adds one.\n",
}


def write(root, files):
    for name, body in files.items():
        p = root / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(body)


def test_index_query_update(spark, tmp_path):
    repo = tmp_path / "repo"
    write(repo, FILES)
    e = Engine(spark, str(tmp_path / "store"))
    assert e.index(str(repo)) == 1
    assert [r.path.rsplit("/", 1)[-1] for r in e.files().collect()] == ["README.md", "__init__.py", "a.py", "b.py"]
    found = e.query("the helper adds one", 5).orderBy("pos").collect()
    assert found[0].file.endswith("README.md") and len(found) == 4
    assert [r.file.rsplit("/", 1)[-1] for r in e.query("helper scope:docs").collect()] == ["README.md"]
    assert [r.line_start for r in e.file_query(f"{repo}/src/a.py", "main").collect()] == [1]
    assert e.update(str(repo)) is None
    write(repo, {"src/b.py": "def helper(y):\n    return y\n\n\nclass B:\n    def run(self):\n        helper(33)\n"})
    os.remove(repo / "README.md")
    assert e.update(str(repo)) == 2
    fresh = Engine(spark, str(tmp_path / "fresh"))
    fresh.index(str(repo))
    for t in ("calls", "symbol", "raw_edge"):
        assert sorted(map(str, e.store.read(t).collect())) == sorted(map(str, fresh.store.read(t).select(*e.store.read(t).columns).collect())), t
    nodes, edges = e.graph()
    assert nodes.count() == 4 and edges.count() == 2
    assert e.stats().first().asDict() == {"files": 3, "chunks": 3, "symbols": 5, "dimensions": 64}
    assert [r.line_no for r in e.grep(str(repo), "return helper", literal=True).collect()] == [6]
    assert [r.text for r in e.read(str(repo), f"{repo}/src/a.py", 5, 6).collect()] == ["def main():", "    return helper(2)"]
    assert e.store.sweep(1) == [1] and e.store.current() == 2


def test_change_stream_is_coalesced(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    (src / "1.json").write_text('{"path":"a","event":"create","seq":1}\n{"path":"a","event":"remove","seq":3}\n{"path":"b","event":"rename_to","seq":2}\n{"path":"c","event":"chmod","seq":4}\n')
    stream = spark.readStream.schema("path string, event string, seq long").json(str(src))
    seen = []
    q = changes.maintain(changes.as_changes(stream), lambda df, n: seen.extend((r.path, r.change) for r in df.collect()), str(tmp_path / "ckpt"), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == [("a", "deleted"), ("b", "added")]


def test_a_small_update_writes_few_buckets(spark, tmp_path):
    repo = tmp_path / "repo"
    write(repo, {f"m{k}.py": f"def f{k}():\n    f{(k + 1) % 40}()\n" for k in range(40)})
    e = Engine(spark, str(tmp_path / "store"))
    e.index(str(repo))
    write(repo, {"m7.py": "def f7():\n    f8()\n    f9()\n\n\ndef more():\n    f7()\n"})
    assert e.update(str(repo)) == 2
    for t in ("symbol", "chunk", "raw_edge", "file_meta"):
        assert len(list((tmp_path / "store" / "gen=2" / t).glob("bucket=*"))) == 1, t
    fresh = Engine(spark, str(tmp_path / "fresh"))
    fresh.index(str(repo))
    for t in ("calls", "symbol", "raw_edge"):
        assert sorted(map(str, e.store.read(t).collect())) == sorted(map(str, fresh.store.read(t).select(*e.store.read(t).columns).collect())), t
    assert e.store.meta()["stamp"] == fresh.store.meta()["stamp"] and e.stats().first() == fresh.stats().first()
    assert e.store.sweep(1) == [] and e.store.read("chunk").count() == 40  # the first generation is still read from
    assert e.heal(str(repo)) == 3 and not (tmp_path / "store" / "gen=3" / "symbol").exists()
    os.remove(repo / "m7.py")
    assert e.update(str(repo)) == 4
    assert e.store.read("symbol").count() == 39 and e.store.read("symbol", 2).count() == 41
