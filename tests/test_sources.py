import pytest
from pyspark.sql import functions as F

from quern.sources import stores
from quern.sources.files import scan_tree
from quern.streaming import increment


def test_scan_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.rs").write_bytes(b"fn a() {}\xff")
    (tmp_path / "src/B.PY").write_text("def b(): pass")
    (tmp_path / "node_modules/c.js").write_text("x")
    (tmp_path / "d.txt").write_text("x")
    rows = {r["path"]: r for r in scan_tree(spark, str(tmp_path), ["*.go"]).collect()}
    assert {p: r["language"] for p, r in rows.items()} == {"src/a.rs": "rust", "src/B.PY": "python"}
    assert rows["src/a.rs"]["content"].endswith("�") and len(rows["src/a.rs"]["file_hash"]) == 64


def test_settings(tmp_path):
    own, template = str(tmp_path / "own.json"), str(tmp_path / "all.json")
    assert stores.load_settings(own, template) == stores.Settings()
    stores.save_settings(stores.Settings(index_storage="x", ignore_patterns=("a/",), default_dependency_depth=4), template)
    got = stores.load_settings(own, template)
    assert got.index_storage == "index" and got.default_dependency_depth == 4 and got.ignore_patterns[0] == "a/" and "node_modules/" in got.ignore_patterns
    assert stores.Settings().with_ignores(add=("b",), remove=("target/",)).ignore_patterns == ("node_modules/", ".git/", "b")


def test_registry(tmp_path, spark):
    path = str(tmp_path / "r.json")
    registry = stores.Registry.load(path)
    registry.add("a", "/x")
    registry.add("a", "/x")
    with pytest.raises(ValueError):
        registry.add("a", "/y")
    registry.save(path)
    assert stores.Registry.load(path).root("a") == "/x" and registry.table(spark).count() == 1
    assert registry.remove("a") and not registry.remove("a")


def test_stores(spark, tmp_path):
    links = spark.createDataFrame([("c", "b", 1), ("c", "a", 0), ("d", "x", 0)], "component_id string, path string, pos int")
    stores.link_lines(links, "2025").write.text(str(tmp_path / "lines"))
    expected = {("c", "a", 0), ("c", "b", 1), ("d", "x", 0)}
    assert {tuple(r) for r in stores.read_link_lines(spark, str(tmp_path / "lines")).collect()} == expected
    (tmp_path / "links.json").write_text('{"version": 1, "memberships": {"c": ["a", "b"], "d": ["x"]}}')
    assert {tuple(r) for r in stores.read_link_store(spark, str(tmp_path / "links.json")).collect()} == expected
    assert stores.read_link_store(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "cat.json").write_text('{"version": 1, "paths": {"a": {"title": "A", "sort_key": "1"}}}')
    assert stores.read_catalog(spark, str(tmp_path / "cat.json")).first()["sort_key"] == "1"
    stores.save_postings(spark.createDataFrame([("t", "c", "name")], "token string, component_id string, origin string"), str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    (tmp_path / "n.md").write_text("---\na = 1\n---\n")
    assert [r["text"] for r in stores.read_notes(spark, str(tmp_path)).collect()] == ["---\na = 1\n---\n"]
    assert stores.git_head("true\nabc\n") == (True, "abc") and stores.git_head("false") == (False, None)


def test_stream_keeps_the_index(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(p, "rust", c, h, None) for p, c, h in r], increment.FILE)
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    rows(("a.rs", "fn a() {}", "1"), ("b.rs", "fn b() {}", "1")).coalesce(1).write.parquet(source)
    for step, expected in enumerate([{"a", "b"}, {"c", "b"}]):
        if step:
            rows(("a.rs", "fn c() {}", "2")).coalesce(1).write.mode("append").parquet(source)
        increment.maintain(increment.read_files(spark, source), index, str(tmp_path / "cp")).awaitTermination()
        assert {r["name"] for r in increment.read_index(spark, index).collect()} == expected


def test_stream_goes_on_from_an_index(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(p, "rust", c, h, None) for p, c, h in r], increment.FILE)
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    assert increment.read_index(spark, index).count() == 0
    increment.start_index(increment.components_of(rows(*((f"{i}.rs", f"fn f{i}() {{}}", "1") for i in range(40)))), index)
    rows(("3.rs", "fn g() {}", "2"), ("4.rs", "", "2"), (None, "fn x() {}", "1")).coalesce(1).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        increment.maintain(increment.read_files(spark, source), index, str(tmp_path / "cp")).awaitTermination()
        names = [r["name"] for r in increment.read_index(spark, index).collect()]
        assert sorted(names) == sorted([f"f{i}" for i in range(40) if i not in (3, 4)] + ["g"])
    # Parts without a file of the batch stay where they were.
    assert {f.split("/")[1] for f in increment._manifest(spark, index)[1].values()} == {"generation=-1", "generation=0"}


def test_tables_and_documents(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    for load in (stores.load_index, stores.load_postings, stores.load_diagnostics):
        assert load(spark, at("none")).count() == 0
    components = spark.createDataFrame([(f"fn-{i}", "rust" if i % 3 else "go", "fn", f"f{i}", f"{i}.x", 1, 2, "") for i in range(30)], stores.COMPONENT)
    stores.save_index(components, at("index"))
    assert sorted(map(str, stores.load_index(spark, at("index")).select(components.columns).collect())) == sorted(map(str, components.collect()))
    assert {n for n in stores.names_in(spark, at("index")) if "=" in n} == {"language=rust", "language=go"}
    found = spark.createDataFrame([("a", 1, "error", "", "m"), ("a", 1, "error", "", "m")], stores.DIAGNOSTIC)
    for _ in range(2):
        stores.save_diagnostics(found, at("diagnostics"))
    assert stores.load_diagnostics(spark, at("diagnostics")).count() == 2
    links = spark.createDataFrame([("c", "b", 1), ("c", "a", 0), ("d", "ü", 0)], "component_id string, path string, pos int")
    stores.write_text(spark, at("links.json"), stores.link_document(links, "2025"))
    assert sorted(map(tuple, stores.read_link_store(spark, at("links.json")).collect())) == sorted(map(tuple, links.collect()))
    catalog = spark.createDataFrame([("a", "A", None, None, "1"), ("b", None, "d", "a", None)], stores.CATALOG)
    stores.write_text(spark, at("catalog.json"), stores.catalog_document(catalog, "2025"))
    stores.catalog_lines(catalog, "2025").write.text(at("catalog"))
    for back in (stores.read_catalog(spark, at("catalog.json")), stores.read_catalog_lines(spark, at("catalog"))):
        assert sorted(map(str, back.collect())) == sorted(map(str, catalog.collect()))
    assert stores.load_settings(at("own.json"), write=True) == stores.load_settings(at("own.json")) and stores.exists(spark, at("own.json"))


def test_search_in_a_stored_index(spark, tmp_path):
    from quern.operators import search as S

    names = ["parseBuffer", "buffers", "parser", "bufer_size", "writeFile", "searchable", "death", "größe", "日本語", "x"]
    components = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(names)], "id string, name string")
    notes = spark.createDataFrame([("c4", "the parser and its buffer", ["Hot"])], "component_id string, content string, tags array<string>")
    links = spark.createDataFrame([("c5", "@a/parsing/things")], "component_id string, path string")
    postings = S.build_postings(components, notes, links)
    stores.save_search_index(S.search_index(postings), str(tmp_path / "i"))
    index = stores.load_search_index(spark, str(tmp_path / "i"))
    rows = lambda df: sorted((r["component_id"], round(r["score"], 6), r["match_type"]) for r in df.collect())
    for query in ("parse_buffer", "bufer", "write", "searching", "hot", "größe", "qqq", "x", ""):
        assert rows(S.fuzzy_search(index, query)) == rows(S.fuzzy_search(postings, query)), query
    assert rows(S.fuzzy_search(stores.load_search_index(spark, str(tmp_path / "none")), "parse")) == []
    plan = S.fuzzy_search(index, "parse")
    assert {r["component_id"] for r in plan.collect()} >= {"c0", "c2"}


def test_scan_of_odd_roots(spark, tmp_path):
    root = tmp_path / "a+(b).c"
    root.mkdir()
    (root / "x.Rs").write_text("fn a() {}")
    assert [r["path"] for r in scan_tree(spark, str(root)).collect()] == ["x.Rs"]


def test_no_local_checkpoints_on_a_cluster():
    from types import SimpleNamespace as N

    from quern.session import ensure_checkpoint_dir

    used = []
    context = lambda master: N(master=master, getCheckpointDir=lambda: None, setCheckpointDir=used.append)
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(N(sparkContext=context(master), conf=N(get=lambda *_: None)))
        ensure_checkpoint_dir(N(sparkContext=context(master), conf=N(get=lambda *_: "s3a://b/c")))
    assert used == ["s3a://b/c"] * 3


def test_stream_activity(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a.rs", "rust", "", "1")] * 2, "path string, language string, content string, file_hash string").withColumn(
        "indexed_at", F.lit("2025-01-01 10:00:00").cast("timestamp_ntz")
    ).coalesce(1).write.parquet(source)
    query = increment.activity(increment.read_files(spark, source)).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["language"], r["files"]) for r in spark.table("activity").collect()] == [("rust", 2)]
