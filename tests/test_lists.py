import pytest

from quern.operators import lists

ROWS = [
    ("a", "rust", "fn", "f", "x.rs", 1, 2, "alive", 0, 0, 0),
    ("b", "rust", "struct", "S", "x.rs", 4, 5, "maybe_dead", 0, 0, 0),
    ("c", "rust", "fn", "g", "a.rs", 1, 1, "alive", 0, 1, 0),
    ("d", "go", "func", "h", "b.go", 1, 1, "alive", 0, 0, 0),
]
SCHEMA = "id string, language string, type string, name string, file string, start_line int, end_line int, death_status string, errors int, warnings int, notes int"


def test_modes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    ids = lambda **k: (lambda r: (r[0], [x["id"] for x in r[1].collect()]))(lists.listing(df, **k))
    mode, rows = lists.listing(df)
    assert mode == "languages" and [r[0] for r in rows.collect()] == ["go", "rust"]
    mode, rows = lists.listing(df, "rs")
    assert mode == "language_summary" and {tuple(r) for r in rows.collect()} == {("fn", 2), ("struct", 1)}
    assert ids(language="rs", everything=True) == ("language_all", ["c", "a", "b"])
    assert ids(language="rs", kind="FN") == ("language_and_type", ["c", "a"])
    assert ids(language="rs", dead=True) == ("language_all", ["b"])
    assert ids(language="rs", dead=True, fault=True) == ("language_all", ["c", "b"])
    for bad in ({"language": "rs", "kind": "fn", "everything": True}, {"kind": "fn"}, {"language": "cobol"}, {"dead": True}):
        with pytest.raises(ValueError):
            lists.listing(df, **bad)


def test_show(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    files = spark.createDataFrame([("x.rs", "one\r\ntwo\nthree\n"), ("empty.rs", "")], "path string, content string")
    said = spark.createDataFrame([("x.rs", 2, "note", "n"), ("x.rs", 2, "error", "e"), ("x.rs", 3, "note", "n")], "file string, line int, severity string, message string")
    got = [(r["line"], r["code"], [d["severity"] for d in r["diagnostics"]]) for r in lists.shown(lists.component(df, "a"), files, said).orderBy("line").collect()]
    assert got == [(1, "one", []), (2, "two", ["error", "note"])]
    with pytest.raises(KeyError):
        lists.component(df, "zzz")
    lists.guard("show", True)
    with pytest.raises(PermissionError):
        lists.guard("sync", True)
