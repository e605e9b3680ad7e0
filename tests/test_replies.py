"""Rerankers' replies, hints, cases, ids and the engine's stored answers."""

import os

import pytest

from corvid.functions import paths
from corvid.operators import incremental, ranking
from corvid.plans import replies
from corvid.sources import cases, files
from corvid.streaming.changes import Debounced

BLOCKS = [(1, 40), (10, 20), (100, 160)]


@pytest.mark.parametrize(
    ("reply", "structured", "order", "ranges", "skipped"),
    [
        ("so <ranked_indices> [2, 0] </ranked_indices> done", False, [2, 0], [None, None], None),
        ("```json\n[1]\n```", False, [1], [None], None),
        (" [0] ", False, [0], [None], None),
        ('{"ranked_indices": [{"chunk_index": 2, "lines": [[110, 112], [114, 115], [159, 400]]}]}', True, [2], [[(108, 117), (157, 160)]], None),
        ('[{"i": 1, "lines": [[12, 13]]}]', False, [1], [None], None),  # short blocks stay whole
        ('[{"chunk_index": 0, "keep": "full"}, {"chunk_index": 0, "lines": []}]', False, [0, 0], [None, None], None),
        ('[7, -1, true, 1.5, "x", {"lines": [[1, 2]]}, {"chunk_index": 0, "lines": [[5, 2], [1], "x", [200, 300], [3, 4]]}]', False, [0], [[(1, 6)]], None),
        ("[]", False, [], [], None),
        ("no idea", False, [0, 1, 2], [None] * 3, "failed to parse LLM response"),
        ("{}", False, [0, 1, 2], [None] * 3, "failed to parse LLM response"),
        ("[1]", True, [0, 1, 2], [None] * 3, "failed to parse structured response"),
        ('{"x": 1}', True, [0, 1, 2], [None] * 3, "structured response missing ranked_indices"),
    ],
)
def test_replies(reply, structured, order, ranges, skipped):
    assert replies.read(reply, BLOCKS, structured=structured) == (order, ranges, skipped)


def test_probabilities_order_and_narrow():
    assert replies.spans_to_ask((1, 10), [(2, 3)]) == [] and replies.spans_to_ask((1, 17), [(2, 3)]) == [(2, 3)]
    got = replies.by_probability([0.2, 0.9, 0.2], [[(1, 4), (4, 9), (20, 21)], [(5, 6)], []], [[0.5, 0.7, 0.1], [None], []])
    assert got == ([1, 0, 2], [None, [(1, 9)], None], None)
    assert replies.flattened([7, 8]) and not replies.flattened([[7, 8]]) and not replies.flattened([])


def test_a_reply_is_applied_to_rows(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, file string")
    out = ranking.applied(df, replies.read('[2, {"chunk_index": 0, "lines": [[5, 6]]}]', BLOCKS))
    assert [(r.pos, r.file, r.ranges and [tuple(x) for x in r.ranges]) for r in out.orderBy("pos").collect()] == [(0, "c", None), (1, "a", [(3, 8)])]


def test_hints():
    assert replies.grep_hint([(["run", "Engine", "operator=="], ["a b", "helper", "Engine", "walk_all", "fifth", "sixth"]), (["merge"], [])]) == "Engine|merge|helper|walk_all"
    assert replies.grep_hint([(["x"], [])]) is None
    assert replies.grep_hint([([c * 40 for c in "abc"], ["short"])]) == "a" * 40 + "|" + "b" * 40 + "|short"


SOURCE = """# Far above.

# Reads the whole listing once and hands
# every path to the callers in sorted order.
def walk(a):
    b = 1
    c = 2
    d = 3
    e = 4
    return a

# This one says what short_name means, which gives it away at once.
def short_name(a):
    b = 1
    c = 2
    d = 3
    e = 4
    return a

# Too short.
def other(a):
    b = 1
    c = 2
    d = 3
    e = 4
    return a
"""


def test_cases_come_from_comments(spark):
    df = spark.createDataFrame([("a.py", SOURCE.encode()), ("b.py", b"\xff"), ("c.py", None)], "path string, content binary")
    want = ("Reads the whole listing once and hands every path to the callers in sorted order.", "a.py", "walk", 5, 10)
    assert [tuple(r) for r in cases.derived(df).collect()] == [want]
    assert cases.comment_above(["/// says", "#[inline]", "", "fn f() {"], 4) == "says" and cases.comment_above(["x", "def f():"], 2) is None


def test_ids_and_globs():
    assert paths.repo_of(paths.repo_id("/a/b c/é")) == "/a/b c/é" and paths.repo_of(paths.repo_id("C:\\x\\")) == "C:/x"
    for bad in ("%%%", "_w"):
        with pytest.raises(ValueError):
            paths.repo_of(bad)
    assert [paths.glob_prefix(g) for g in ("src/foo/**/*.rs", "*.rs", "a/b.py", "a/[xy]/c")] == ["src/foo", None, "a/b.py", "a"]


def test_paths_stay_in_the_root(tmp_path):
    root = tmp_path / "r"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.py").write_text("x")
    (tmp_path / "out.py").write_text("y")
    os.symlink(tmp_path / "out.py", root / "link.py")
    assert files.within(str(root), "a/../a/x.py") == "a/x.py"
    for bad in ("", "/etc/passwd", "../out.py", "link.py", "none.py", "C:x"):
        with pytest.raises(ValueError):
            files.within(str(root), bad)


def test_linked_folders_know_their_main_one(tmp_path):
    main, linked = tmp_path / "main", tmp_path / "linked"
    (main / ".git" / "worktrees" / "w").mkdir(parents=True)
    linked.mkdir()
    (linked / ".git").write_text("gitdir: ../main/.git/worktrees/w\n")
    assert files.main_root(str(linked)) == str(main) and files.main_root(str(main)) is None and files.main_root(str(tmp_path)) is None


def test_only_indexed_files_change_but_any_may_go(spark):
    changes = spark.createDataFrame([("a", "modified"), ("b", "added"), ("c", "deleted")], "path string, change string")
    assert sorted(map(tuple, incremental.allowed(changes, spark.createDataFrame([("a",)], "path string")).collect())) == [("a", "modified"), ("c", "deleted")]


def test_bursts_run_once():
    import threading

    ran, done = [], threading.Event()
    run = Debounced(lambda: (ran.append(1), done.set()), 0.2)
    for _ in range(5):
        run()
    assert done.wait(5) and ran == [1]


def test_answers_are_stored_and_files_can_be_left_out(spark, tmp_path):
    from corvid.engine import Engine

    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "a.py").write_text("def f():\n    g()\n")
    (repo / "b.py").write_text("def g():\n    pass\n")
    steps = []
    e = Engine(spark, str(tmp_path / "store"), progress=steps.append)
    e.index(str(repo))
    assert steps == ["list", "parse", "embed", "resolve", "write"]
    again = Engine(spark, str(tmp_path / "store"))
    assert [tuple(r) for r in again.graph()[1].collect()] == [(f"{repo}/a.py::f", f"{repo}/b.py::g")]
    assert again.stats().first().files == 2
    for f in (tmp_path / "store" / "gen=1" / "_answer_stats").glob("part-*"):
        f.unlink()  # what can't be read is made again
    (tmp_path / "store" / "gen=1" / "_answer_stats" / "part-0.parquet").write_bytes(b"junk")
    assert Engine(spark, str(tmp_path / "store")).stats().first().files == 2
    assert e.heal(str(repo)) == 2 and e.store.read("calls").count() == 1
    assert e.ignore("B.PY") == 3 and e.ignore("none") is None
    assert [r.path for r in e.files().collect()] == [f"{repo}/a.py"] and e.store.read("calls").count() == 0
    assert e.update(str(repo)) is None
    assert e.unignore("b.py") == 1 and e.update(str(repo)) == 5
    assert e.stats().first().files == 2 and e.store.read("calls").count() == 1
