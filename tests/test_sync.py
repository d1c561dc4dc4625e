"""Syncs as a whole: a partial sync ends where a full one would."""

import pytest
from pyspark.sql import functions as F

from quern.operators import sync as Y

NOTES = "hash_id string, component_type string, component_name string, file string, language string, content string, tags array<string>, links array<string>"
TREE = {
    "a/main.rs": "use b::helper;\nfn main() {\n    helper();\n    local();\n}\nfn local() {}\n",
    "a/b.rs": "fn helper() {}\nfn unused() {}\n",
    "c/d.py": "def lonely():\n    pass\n",
    "c/e.py": "def other():\n    return 1\n",
    "c/notes.txt": "lonely",
    "skip/x.rs": "fn skipped() {}\n",
}
LANG = {"rs": "rust", "py": "python"}


def tree(spark, files):
    rows = [(p, LANG.get(p.rsplit(".", 1)[-1]), c) for p, c in files.items()]
    return spark.createDataFrame(rows, "path string, language string, content string")


def shown(index):
    name = {r["id"]: f"{r['file']}:{r['name']}" for r in index.components.collect()}
    return {
        "files": sorted(tuple(r) for r in index.files.select("path", "language", "file_hash").collect()),
        "components": sorted(name.values()),
        "edges": sorted((name[r["src"]], name[r["target"]], r["kind"]) for r in index.edges.collect()),
        "live": sorted((name[r["id"]], r["death_status"], tuple(r["reasons"])) for r in index.liveness.collect()),
    }


@pytest.fixture(scope="module")
def start(spark):
    notes = spark.createDataFrame([], NOTES)
    return Y.full_sync(tree(spark, TREE), notes, ["skip/"]), notes


def test_full_sync(start):
    got = shown(start[0])
    assert [f[0] for f in got["files"]] == ["a/b.rs", "a/main.rs", "c/d.py", "c/e.py"]
    assert ("a/main.rs:main", "a/b.rs:helper", "import_resolved") in got["edges"] and ("a/main.rs:main", "a/main.rs:local", "same_file") in got["edges"]
    live = {n: s for n, s, _ in got["live"]}
    assert live["a/main.rs:main"] == live["a/b.rs:helper"] == "alive" and live["c/d.py:lonely"] == "definitely_dead"


def test_partial_sync_ends_like_a_full_one(spark, start):
    index, notes = start
    after = {**TREE, "a/b.rs": "fn helper() {}\nfn fresh() {}\n", "c/f.py": "def new():\n    pass\n"}
    del after["c/d.py"]
    asked = ["a/b.rs", "c/f.py", "c/d.py", "c/e.py", "gone.rs", "skip/x.rs", "c/notes.txt"]
    got, status = Y.partial_sync(index, spark.createDataFrame([(a,) for a in asked], "path string"), tree(spark, after), notes, ["skip/"])
    assert {(r["path"], r["status"], r["reason"]) for r in status.collect()} == {
        ("a/b.rs", "indexed", None), ("c/f.py", "indexed", None), ("c/d.py", "removed", None), ("c/e.py", "skipped", "file hash unchanged"),
        ("gone.rs", "skipped", "path does not exist"), ("skip/x.rs", "skipped", "ignored"), ("c/notes.txt", "skipped", "unsupported file extension"),
    }
    assert shown(got) == shown(Y.full_sync(tree(spark, after), notes, ["skip/"]))


def test_what_is_not_requested_stays_drifted(spark, start):
    index, notes = start
    after = {**TREE, "a/b.rs": "fn changed() {}\n", "c/e.py": "def renamed():\n    return 1\n"}
    got, _ = Y.partial_sync(index, spark.createDataFrame([("a/b.rs",)], "path string"), tree(spark, after), notes, ["skip/"])
    assert "c/e.py:other" in shown(got)["components"] and "a/b.rs:changed" in shown(got)["components"]
    now = Y._hashed(tree(spark, after)).select("path", "file_hash")
    assert {tuple(r) for r in Y.drift(got.files, now).collect()} == {("c/e.py", "changed")}


def test_add_remove_refresh(spark, start):
    index, notes = start
    after = {**TREE, "n.py": "def n():\n    pass\n"}
    present = tree(spark, after)
    added = Y.add_file(index, "./n.py", present, notes, ["skip/"])
    assert "n.py:n" in shown(added)["components"]
    assert shown(Y.add_file(added, "n.py", present, notes, ["skip/"])) == shown(added)  # unchanged is no error
    for path, reason in (("none.py", "path does not exist"), ("skip/x.rs", "ignored"), ("c/notes.txt", "unsupported file extension")):
        with pytest.raises(ValueError, match=reason):
            Y.add_file(index, path, present, notes, ["skip/"])
    removed, held = Y.remove_file(added, "n.py", present, notes)
    assert held and shown(removed) == shown(index)
    assert Y.remove_file(index, "none.py", present, notes) == (index, False)
    fewer = {p: c for p, c in TREE.items() if p != "a/b.rs"}
    got = shown(Y.refresh(index, tree(spark, fewer), notes))
    assert got == shown(Y.full_sync(tree(spark, fewer), notes, ["skip/"]))
    empty = Y.full_sync(tree(spark, TREE).where(F.lit(False)), notes, [])
    assert shown(empty) == {"files": [], "components": [], "edges": [], "live": []}
