"""Operators of the code index on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import tokens as K
from quern.operators import annotations as A
from quern.operators import diagnostics as D
from quern.operators import edges as E
from quern.operators import extraction as X
from quern.operators import graph as G
from quern.operators import links as L
from quern.operators import liveness as V
from quern.operators import search as S
from quern.operators import sync as Y
from quern.plans import index_queries as Q
from quern.sources.ignore import ignored


def one(spark, expression, *values):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'string' if not isinstance(v, (int, float)) else 'double' if isinstance(v, float) else 'long'}" for n, v in zip(names, values, strict=True)))
    return df.select(expression(*map(F.col, names)).alias("x")).first()["x"]


def pairs(language, content):
    return [(k, n) for k, n, *_ in X.extract(language, content)]


@pytest.mark.parametrize(
    "language,content,expected",
    [
        ("rust", "pub struct Config {}\nenum Kind {}\npub(crate) fn run() {}\npub async fn get() {}\ntrait T {}\nimpl T for Config {}\nmod m;\nuse a::b;\n",
         [("struct", "Config"), ("enum", "Kind"), ("fn", "run"), ("fn", "get"), ("trait", "T"), ("impl", "T for Config"), ("mod", "m"), ("use", "a::b")]),
        ("javascript", "export class E {}\nexport default async function h() {}\nconst A = 1;\nlet b = 2;\nvar c = 3;\nexport { A, b as d };\n",
         [("class", "E"), ("function", "h"), ("const", "A"), ("let", "b"), ("var", "c"), ("export", "A"), ("export", "b")]),
        ("typescript", "export interface U {}\ntype Id = string;\nclass A {}\n", [("interface", "U"), ("type", "Id"), ("class", "A")]),
        ("python", "import os  # x\nfrom a.b import c, d\nclass S:\n    async def f(self):\n        pass\n    def g(self):\n        pass\n",
         [("import", "os"), ("from", "a.b -> c, d"), ("class", "S"), ("async def", "f"), ("def", "g")]),
        ("go", "type S struct {}\ntype H interface {}\nfunc main() {}\nfunc (s *S) Start() {}\nconst M = 1\nvar D = 2\ntype Du int\n",
         [("struct", "S"), ("interface", "H"), ("func", "main"), ("func", "Start"), ("const", "M"), ("var", "D"), ("type", "Du")]),
        ("swift", "import XCTest\npublic actor Counter {}\nextension Array {}\nfunc == (a: A, b: A) {}\ninit(a: Int) {}\ndeinit {}\nsubscript(i: Int) -> Int {}\ntypealias X = Y\n",
         [("import", "XCTest"), ("actor", "Counter"), ("extension", "Array"), ("func", "=="), ("init", "init"), ("deinit", "deinit"), ("subscript", "subscript"), ("typealias", "X")]),
        ("zig", 'const std = @import("std");\npub fn init() void {}\nconst P = packed struct {};\nconst m: u8 = 3;\nvar c: i32 = 0;\ntest "a b" {}\n',
         [("import", "std"), ("fn", "init"), ("struct", "P"), ("const", "m"), ("var", "c"), ("test", "a b")]),
        ("c", "#include <a.h>\n#define M 1\nstruct P { int x; };\nenum E { A };\ntypedef unsigned long ul;\nint main(void) {\n}\n",
         [("include", "<a.h>"), ("define", "M"), ("struct", "P"), ("enum", "E"), ("typedef", "ul"), ("fn", "main")]),
        ("cpp", "namespace my::lib {}\nclass W {};\ntemplate <typename T>\nT mx(T a) { return a; }\nusing V = int;\n", [("namespace", "my::lib"), ("class", "W"), ("fn", "mx"), ("fn", "mx"), ("using", "V")]),
        ("cobol", "x", []),
        ("rust", "", []),
    ],
)
def test_declarations(language, content, expected):
    assert pairs(language, content) == expected


@pytest.mark.parametrize(
    "language,content,expected",
    [
        ("rust", "pub mod utils;\nmod internal;\n\nuse std::a::{\n    b,\n    c,\n};\nimpl<T> Drawable for W<T> {\n    fn draw(&self) {}\n}\npub(crate) struct Hidden;\nimplement this\nimpl {\n",
         [("mod", "utils"), ("mod", "internal"), ("use", "std::a::{\n    b,\n    c,\n}"), ("impl", "Drawable for W<T>"), ("fn", "draw")]),
        ("javascript", "export default class A extends B {}\nconst f = () => 1;\nlet g;\nfunction* gen() {}\nconst $x = 2;\nexport {\n  f as default,\n  $x\n}\n",
         [("class", "A"), ("const", "f"), ("const", "$x"), ("export", "f"), ("export", "$x")]),
        ("typescript", "export type Id = string;\ntype Cb = (e: Error) => void;\nconst typed: number = 3;\nabstract class Q {}\n", [("type", "Id"), ("type", "Cb")]),
        ("python", "import os, sys\nfrom . import x\nfrom typing import (\n    List,\n)\nclass A(B): pass\nclassy = 1\ndef na\u00efve(): pass\nasync  def g(): pass\nimport   # nothing\n",
         [("import", "os, sys"), ("from", ". -> x"), ("from", "typing -> ("), ("class", "A"), ("async def", "g")]),
        ("go", "type S struct {\n}\n\ntype H interface {\n}\nfunc (s *S) Start() error {\nfunc Map[T any](x T) {}\ntype C func(error)\nconst (\n\tA = 1\n)\nfuncs()\n",
         [("struct", "S"), ("interface", "H"), ("type", "H"), ("func", "Start"), ("type", "C")]),
        ("swift", "@testable import XCTest\n@_exported import struct Foundation.URL\nindirect enum E {}\n@objc extension NSObject {\n    subscript(key: String) -> Any? { nil }\n}\nstruct P {\n    static func == (l: P, r: P) -> Bool { true }\n    static func += (l: inout P, r: P) {}\n    static func ..< (l: P, r: P) -> Bool { true }\n    func + (o: P) -> P { self }\n    class func make() {}\n    required init(a: Int) {}\n    deinit {}\n}\n@available(iOS 13, *)\nfinal public class K {}\n",
         [("import", "XCTest"), ("import", "Foundation.URL"), ("enum", "E"), ("extension", "NSObject"), ("subscript", "subscript"), ("struct", "P"), ("func", "=="), ("func", "+="), ("func", "..<"),
          ("func", "+"), ("func", "make"), ("init", "init"), ("deinit", "deinit"), ("class", "K")]),
        ("zig", "pub const Color = enum {\n};\nconst Payload = extern union {\n};\nexport fn entry() void {\n}\nvar counter: u32 = 0;\nconst Color = 3;\n",
         [("enum", "Color"), ("union", "Payload"), ("fn", "entry"), ("var", "counter")]),
        ("c", "#include \"my.h\"\n#  define MIN(a, b) 1\ntypedef struct Node {\n  int x;\n} Node;\ntypedef struct Other Alias;\nstatic unsigned long *find(int a,\n    int b)\n{\n}\nint proto(int);\n  int indented(void) {\n",
         [("include", '"my.h"'), ("define", "MIN"), ("struct", "Node"), ("struct", "Other"), ("typedef", "Alias"), ("fn", "find")]),
        ("cpp", "template <class T>\nclass Box {};\ntemplate<typename T> static T first(T a);\nusing namespace std;\nusing V = std::vector<int>;\nstruct S { };\n",
         [("class", "Box"), ("fn", "first"), ("using", "V"), ("struct", "S")]),
    ],
)
def test_declarations_in_full(language, content, expected):
    assert pairs(language, content) == expected


@pytest.mark.parametrize("language", ["python", "c", "cpp", "javascript", "rust", "swift", "go", "zig", "typescript"])
def test_extraction_is_linear(language):
    import time

    texts = [
        "".join(f"def f{i}(a):\n    return a\n\n" for i in range(80_000))[:2_000_000],
        "words of prose without any punctuation at all\n" * 43_000,
        "const a=1;function f(){return 1};" * 61_000,
        "public\n@a\npub\nexport\ntemplate<>\ntypedef\nuse x\nexport {\nfunc (\n#include <\n" * 30_000,
        "\n" * 2_000_000,
    ]
    for text in texts:
        began = time.process_time()
        X.extract(language, text)
        assert time.process_time() - began < 5


def test_spans_against_brute_force():
    import random

    def brute(text, start):
        depth, quote, at = 0, "", start
        while at < len(text):
            c = text[at]
            if quote:
                at += c == "\\"
                quote = "" if c == quote else quote
            elif text[at : at + 2] == "//":
                at = text.find("\n", at) if "\n" in text[at:] else len(text)
            elif text[at : at + 2] == "/*":
                at = text.find("*/", at + 2) + 1 if "*/" in text[at + 2 :] else len(text)
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    return text.count("\n", 0, at) + 1
            elif c == ";" and not depth:
                return text.count("\n", 0, at) + 1
            at += 1
        return None

    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["fn a() ", "struct B ", "{", "}", ";", "\n", "\n", '"', "'", "// x", "/* y", "*/", "\\", " z "]) for _ in range(r.randint(1, 60)))
        rows = X.extract("rust", text)
        offsets = sorted({(o, k, n) for o, k, n in X.declared("rust", text)})
        for i, (offset, kind, name) in enumerate(offsets):
            first = text.count("\n", 0, offset) + 1
            bound = text.count("\n", 0, offsets[i + 1][0]) if i + 1 < len(offsets) else text.count("\n") + 1
            end = brute(text, offset)
            assert (kind, name, first, max(first, min(bound if end is None else end, bound))) in {(k, n, a, b) for k, n, _, a, b, *_ in rows}


def test_spans_and_nesting():
    text = "fn outer() {\n    let s = \"}\"; // }\n    fn inner() {}\n}\nfn last() {\n"
    rows = [(n, a, b, p) for _, n, _, a, b, _, p in X.extract("rust", text)]
    assert rows == [("outer", 1, 2, ""), ("inner", 3, 3, "outer::inner"), ("last", 5, 6, "")]
    # Blank lines before a declaration belong to its match.
    assert [(n, a) for _, n, _, a, *_ in X.extract("rust", "use a;\n\n\nfn f() {}\n")] == [("a", 1), ("f", 2)]
    assert X.extract("python", "class Foo:\n    def bar(self):\n        pass\n")[1][6] == "Foo.bar"


def test_ids_outlast_line_shifts(spark):
    files = [("a.rs", "rust", "fn f() {}\nfn f() {}\nfn g() {}\n"), ("b.rs", "rust", None), ("c.txt", None, "fn f() {}")]
    moved = [("a.rs", "rust", "// one more\nfn f() {}\nfn f() {}\nfn g() {}\n")]
    ids = lambda rows: {r["id"] for r in X.with_ids(X.raw_components(spark.createDataFrame(rows, "path string, language string, content string"))).collect()}
    assert len(ids(files)) == 3 and ids(files) == ids(moved)
    assert all(i.startswith("fn-") and len(i) == 19 for i in ids(files))


@pytest.mark.parametrize(
    "name,tokens",
    [("parseComponents", ["parse", "components", "parsecomponents"]), ("file_hash", ["file", "hash", "file_hash"]), ("IndexData", ["index", "data", "indexdata"]),
     ("blake3Hash", ["blake", "3", "hash", "blake3hash"]), ("run", ["run"]), ("HTTPServer", ["http", "server", "httpserver"]), ("  ", []), ("x", ["x"])],
)
def test_name_tokens(spark, name, tokens):
    assert one(spark, K.name_tokens, name) == tokens


def test_content_tokens(spark):
    got = set(one(spark, K.content_tokens, "The **quick** brown fox on the IndexData, a lazy x"))
    assert {"quick", "brown", "fox", "lazy", "index", "data"} <= got and not got & {"the", "on", "a", "x"}


def test_trigrams_and_stems(spark):
    assert one(spark, K.trigrams, "parse") == ["ars", "par", "rse"] and one(spark, K.trigrams, "ab") == []
    stem = lambda w: one(spark, K.stem, w)
    assert (stem("death"), stem("growth"), stem("health"), stem("searchable")) == ("dea", "grow", "heal", "search")
    for a, b in (("dependencies", "dependency"), ("parsing", "parse"), ("parsers", "parser"), ("components", "component"), ("running", "run"), ("abilities", "ability"), ("performances", "performance")):
        assert stem(a) == stem(b)


def test_ranked_search(spark):
    names = [("fn-run", "run"), ("fn-auth", "authenticateUser"), ("fn-component", "componentRegistry"), ("fn-notes", "notes"), ("fn-dead", "death_handler")]
    components = spark.createDataFrame(names, "id string, name string")
    notes = spark.createDataFrame([("fn-notes", "The OAuth flow", [])], "component_id string, content string, tags array<string>")
    links = spark.createDataFrame([], "component_id string, path string")
    index = S.build_postings(components, notes, links).cache()

    def first(query):
        r = S.fuzzy_search(index, query).orderBy(F.desc("score"), "component_id").first()
        return r["component_id"], r["match_type"], round(r["score"], 6)

    assert first("run") == ("fn-run", "exact", 1.0)
    assert first("auth") == ("fn-auth", "prefix", 0.7)
    assert first("onent") == ("fn-component", "substring", 0.4)
    assert first("oauth") == ("fn-notes", "annotation", 0.3)
    assert first("dead")[0] == "fn-dead"
    assert first("un") == ("fn-run", "substring", 0.4)  # two letters: every token is looked at
    assert S.fuzzy_search(index, "  ").count() == 0


def test_postings_hold_tags_and_links(spark):
    components = spark.createDataFrame([("fn-a", "run")], "id string, name string")
    notes = spark.createDataFrame([("fn-a", "Fast path", ["Needs-Review", "the"]), ("fn-a", None, ["hot"])], "component_id string, content string, tags array<string>")
    links = spark.createDataFrame([("fn-a", "@Core/io/x")], "component_id string, path string")
    got = {(r["token"], r["origin"]) for r in S.build_postings(components, notes, links).collect()}
    noted = {"fast", "path", "needs-review", "the", "hot", "@core/io/x", "core", "io"}
    assert got == {("run", "name"), *((t, "annotation") for t in noted)}


def test_whole_token_index_by_component(spark, tmp_path):
    tables = {
        "components": ([("fn-a", "rust", "fn", "run", "src/a.rs", 1, 2, None, None, None, None, None), ("fn-b", "rust", "fn", "stop", "src/a.rs", 3, 4, None, None, None, None, None)],
            "id string, language string, type string, name string, file string, start_line int, end_line int, death_status string, display_path string, removed_at timestamp, faults struct<errors:int,warnings:int,notes:int>, first_seen_at timestamp"),
        "annotations": ([("fn-old", "fn", "run", "src/a.rs", None, "quick", ["Keep"], ["net/http", "bad//link"], None, None), ("fn-gone", "fn", "none", "x", None, "lost", ["lost"], ["lost"], None, None)],
            "hash_id string, component_type string, component_name string, file string, language string, content string, tags array<string>, links array<string>, created_at timestamp, updated_at timestamp"),
        "link_membership": ([("fn-b", "Disk/io", 0), ("fn-gone", "lost", 0)], "component_id string, path string, pos int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["token"]: r["first_id"] for r in Q.whole_token_index(spark, str(tmp_path)).collect()}
    a, b = ("run", "quick", "keep", "net/http", "net", "http", "bad//link", "bad", "link"), ("stop", "disk/io", "disk", "io")
    assert got == dict.fromkeys(a, "fn-a") | dict.fromkeys(b, "fn-b")


def test_searches_see_tokens_outside_ascii(spark, tmp_path):
    words = ["büfer", "parsé", "größen", "parse_büffer"]
    spark.createDataFrame([(t, f"fn-{i}", "name") for i, t in enumerate(words)], "token string, component_id string, origin string").write.parquet(f"{tmp_path}/postings.parquet")
    comps = [(f"fn-{i}", "python", "fn", t, "src/a.py", 1, 2, None, None, None, None, None) for i, t in enumerate(words)]
    schema = "id string, language string, type string, name string, file string, start_line int, end_line int, death_status string, display_path string, removed_at timestamp, faults struct<errors:int,warnings:int,notes:int>, first_seen_at timestamp"
    spark.createDataFrame(comps, schema).write.parquet(f"{tmp_path}/components.parquet")
    folder = str(tmp_path)
    assert [(r["token"], r["distance"]) for r in Q.edit_distance_hits(spark, folder).collect()] == [("büfer", 1)]
    assert {(r["token"], r["kind"], r["score"]) for r in Q.name_match_scores(spark, folder).collect()} == {("parsé", "fuzzy", 0.16), ("parse_büffer", "prefix", 0.7)}
    assert {r["token"] for r in Q.stem_tokens(spark, folder).collect()} == set(words)
    assert {(r["token"]) for r in Q.stem_siblings(spark, folder).collect()} == set()  # no ASCII word shares a stem with them
    hits = {r["component_id"]: r["match_type"] for r in Q.fuzzy_search(spark, folder).collect()}
    # parse and buffer each count; parse_buffer is a letter off.
    assert hits["fn-3"] == "prefix" and hits["fn-1"] == "fuzzy"
    assert {r["id"] for r in Q.merged_search(spark, folder).collect()} == set(hits)


def test_search_terms():
    assert S.parse_terms(["run"]) == (None, None, "run")
    assert S.parse_terms(["rs", "main"]) == ("rust", None, "main")
    assert S.parse_terms(["rs", "FN", "a", "b"]) == ("rust", "fn", "a b")
    assert S.parse_terms(["py", "other", "b"]) == ("python", None, "other b")
    for bad in ([], ["cobol", "x"], ["rs", "fn", " "]):
        with pytest.raises(ValueError):
            S.parse_terms(bad)


@pytest.mark.parametrize(
    "path,valid",
    [("auth/login", "auth/login"), (" a ", "a"), ("auth//x", None), ("@", None), ("@only", None), ("@a/", None), ("/a", None), ("a/", None), ("", None), ("a/ /b", None), ("@p/t/u", "@p/t/u"), ("x" * 257, None), ("é" * 129, None)],
)
def test_link_paths(spark, path, valid):
    assert one(spark, L.valid_path, path) == valid


def test_paths_below(spark):
    under = lambda p, q: one(spark, L.under, p, q)
    assert under("auth/login", "AUTH") and under("auth", "auth") and not under("oauth", "auth")
    assert under("@tokio/auth/login", "@tokio/auth") and not under("auth/login", "@tokio/auth")


def test_merged_links(spark):
    store = spark.createDataFrame([("c", "B", 0), ("c", "a//b", 1), ("c", "a", 2), ("d", "x", 0)], "component_id string, path string, pos int")
    noted = spark.createDataFrame([("c", "b", 0), ("c", "z", 1), (None, "z", 0)], "component_id string, path string, pos int")
    assert [tuple(r) for r in L.merge(store, noted).orderBy("component_id", "pos").collect()] == [("c", "B", 0), ("c", "a", 1), ("c", "z", 2), ("d", "x", 0)]
    assert L.merge(store, noted, most=2).where("component_id = 'c'").count() == 2
    known = spark.createDataFrame([("p",)], "project_id string")
    new = spark.createDataFrame([("d", "@p/t"), ("d", "@q/t"), ("d", "X")], "component_id string, path string")
    assert {r["path"] for r in L.added(store, new, known).where("component_id = 'd'").collect()} == {"x", "@p/t"}
    assert L.removed(store, spark.createDataFrame([("c", "b")], "component_id string, path string")).where("path = 'B'").count() == 0
    with pytest.raises(ValueError):
        L.peer_matches(store, store, "@p")


COMP = "id string, language string, type string, name string, file string, start_line int, end_line int"
NOTE = "hash_id string, component_type string, component_name string, file string, language string, content string, tags array<string>, links array<string>, created_at string, updated_at string"


def notes(spark, rows):
    return spark.createDataFrame([(h, t, n, f, lang, c, tags, [], "2025", "2025") for h, t, n, f, lang, c, tags in rows], NOTE)


def test_resolve(spark):
    components = spark.createDataFrame(
        [("fn-1", "rust", "fn", "a", "x.rs", 1, 2), ("fn-2", "rust", "fn", "b", "x.rs", 3, 4), ("fn-3", "rust", "fn", "b", "x.rs", 5, 6), ("fn-4", "rust", "fn", "c", "y.rs", 1, 2)], COMP
    )
    rows = [
        ("fn-1", "fn", "zzz", None, None, "", []),  # by id
        ("old1", "fn", "a", "x.rs", "rust", "", []),  # alone in its file
        ("old2", "fn", "b", "x.rs", None, "", []),  # two in its file: no fall through
        ("old3", "fn", "c", None, None, "", []),  # no file: alone by name
        ("old4", "fn", "c", "wrong.rs", None, "", []),  # a wrong file: no fall through
        ("old5", "fn", "a", "x.rs", "go", "", []),  # another language
        ("old6", None, None, None, None, None, None),
    ]
    got = {r["hash_id"]: r["component_id"] for r in A.resolve(notes(spark, rows), components).collect()}
    assert got == {"fn-1": "fn-1", "old1": "fn-1", "old2": None, "old3": "fn-4", "old4": None, "old5": None, "old6": None}
    new = {r["old_id"]: (r["hash_id"], r["file"]) for r in A.reconciled(A.resolve(notes(spark, rows), components), components).collect()}
    assert new["old1"] == ("fn-1", "x.rs") and new["old3"] == ("fn-4", "y.rs") and new["old2"] == ("old2", "x.rs")


def test_notes_as_text(spark):
    rows = [("h", "fn", 'na"me\\', None, "rust", "body\n---\nmore\n\n", ["a", 'b"']), ("i", "fn", "é\n", "f", None, None, [])]
    back = {r["hash_id"]: r for r in A.parsed(A.rendered(notes(spark, rows))).collect()}
    assert back["h"]["component_name"] == 'na"me\\' and back["h"]["tags"] == ["a", 'b"'] and back["h"]["content"] == "body\n---\nmore" and back["h"]["file"] is None
    assert back["i"]["component_name"] == "é\n" and back["i"]["content"] == ""
    for bad in ("", "no head", "---\na = 1\n"):
        with pytest.raises(ValueError):
            A.parse_note(bad)


def test_diagnostics(spark):
    lines = ["a.rs:3:1: warning: w", "a.rs:15:2: ERROR[E1]: e: more", "b\\c.rs:5: note: n", "a.rs:x:1: error: e", "a.rs:1: short", "", "b/c.rs:2:9: odd: o"]
    found = D.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    got = {(r["file"], r["line"], r["severity"], r["message"]) for r in found.collect()}
    assert got == {("a.rs", 3, "warning", "w"), ("a.rs", 15, "error", "e: more"), ("b/c.rs", 5, "note", "n"), ("b/c.rs", 2, "warning", "o")}
    spans = spark.createDataFrame([("fn-a", "a.rs", 1, 10), ("fn-b", "a.rs", 11, 20), ("fn-c", "b/c.rs", 1, 3)], "id string, file string, start_line int, end_line int")
    faults = {r["id"]: tuple(r)[1:] for r in D.faults(D.located(found, spans)).collect()}
    assert faults == {"fn-a": (0, 1, 0), "fn-b": (1, 0, 0), "fn-c": (0, 1, 0)}


def test_sync(spark):
    raw = [" M src/a.rs", "?? b.txt", "R  old.rs -> new.rs", "", "xx", "?? "]
    assert {r["path"] for r in Y.status_paths(spark.createDataFrame([(x,) for x in raw], "raw string")).collect()} == {"src/a.rs", "b.txt", "old.rs", "new.rs"}
    paths = lambda *p: spark.createDataFrame([(x, h) for x, h in p], "path string, file_hash string")
    indexed, current = paths(("a.rs", "1"), ("gone.rs", "2"), ("n.rs", None)), paths(("a.rs", "1"), ("new.rs", "3"), ("t.txt", "4"), ("target/x.rs", "5"), ("n.rs", None))
    asked = spark.createDataFrame([(p,) for p in ("a.rs", "gone.rs", "new.rs", "t.txt", "target/x.rs", "never", "n.rs")], "path string")
    got = {r["path"]: (r["status"], r["reason"]) for r in Y.partial_status(asked, indexed, current, ["target/"]).collect()}
    assert got == {
        "a.rs": ("skipped", "file hash unchanged"), "gone.rs": ("removed", None), "new.rs": ("indexed", None), "t.txt": ("skipped", "unsupported file extension"),
        "target/x.rs": ("skipped", "ignored"), "never": ("skipped", "path does not exist"), "n.rs": ("skipped", "file hash unchanged"),
    }
    assert {tuple(r) for r in Y.drift(indexed, current).collect()} == {("gone.rs", "missing")}
    assert {r["path"] for r in Y.dirty_to_sync(asked, indexed, current, ["target/"]).collect()} == {"a.rs", "gone.rs", "new.rs", "n.rs"}
    assert Y.sync_mode([], True, False, True, True, 3) == ("full", "empty_index") and Y.sync_mode([], True, False, False, True, 0)[0] == "noop"
    assert Y.sync_mode(["a"], None, True, False, True, 1)[0] == "partial" and Y.sync_mode([], None, False, False, True, 1)[0] == "full"


@pytest.mark.parametrize(
    "path,expected",
    [("a/node_modules/x.js", True), ("node_modules.js", False), ("x/a.min.js", True), ("third_party/a.c", True), ("third_party/adapters/a.c", False), ("tmp/a", True), ("x/tmp/a", False), ("x/build/out/a", False), ("build/out/a", True), ("a/b.bak", True), ("vendor/a/b", True), ("vendor", False), ("s p/a", True)],
)
def test_ignore(spark, path, expected):
    patterns = ["# c", "", "node_modules/", "*.min.js", "third_party/", "!third_party/adapters/", "/tmp/", "build/out/", "**/*.bak", "vendor/**", "s\\ p/"]
    assert one(spark, lambda p: ignored(p, patterns), path) is expected


def test_edges(spark):
    rows = [("a", "b", "qualified"), ("a", "b", "same_file"), ("b", "c", "import_disambiguated"), ("c", "a", "qualified"), ("a", "a", "same_file"), ("a", None, "x"), ("d", "lost", "qualified")]
    edges = spark.createDataFrame(rows, "src string, target string, kind string")
    assert {tuple(r) for r in E.merged_edges(edges).collect()} >= {("a", "b", "same_file"), ("b", "c", "import_disambiguated")}
    roots = spark.createDataFrame([("a",)], "root string")
    got = {(r["direction"], r["id"], r["depth"]) for r in E.neighbourhood(edges, roots, 2).collect()}
    assert got == {("before", "b", 1), ("before", "c", 2), ("after", "c", 1), ("after", "b", 2)}
    assert E.neighbourhood(edges, roots, 0).count() == 0


def test_inferred_edges(spark):
    files = spark.createDataFrame(
        [("p/m.rs", "rust", "use q::helper;\nfn main() {\n    helper(); local(); q::far(); // note other\n}\nfn local() {}\n"), ("p/h.rs", "rust", "fn helper() {}\nfn other() {}\n"), ("z/h.rs", "rust", "fn helper() {}\n"), ("z/f.rs", "rust", "fn far() {}\n")],
        "path string, language string, content string",
    )
    components = X.with_ids(X.raw_components(files)).cache()
    name = {r["id"]: f"{r['file']}:{r['name']}" for r in components.collect()}
    got = {(name[r["src"]], name[r["target"]], r["kind"]) for r in E.inferred_edges(components, files).collect()}
    assert got == {("p/m.rs:main", "p/m.rs:local", "same_file"), ("p/m.rs:main", "p/h.rs:helper", "import_disambiguated"), ("p/m.rs:main", "z/f.rs:far", "qualified")}


def test_islands(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        nodes = [f"n{i:03d}" for i in range(60)]
        links = [(r.choice(nodes), r.choice(nodes)) for _ in range(45)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(20)]
        label = {n: n for n in nodes}

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            label[b] = a
        got = {x["id"]: x["island"] for x in G.islands(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(links, "a string, b string")).collect()}
        assert got == {n: find(n) for n in nodes}


LIVE = [
    ("fn-a", "rust", "fn", "main", "src/m.rs", 1, 3), ("fn-b", "rust", "fn", "bb", "src/m.rs", 4, 5), ("fn-c", "rust", "fn", "cc", "src/m.rs", 6, 7),
    ("fn-d", "rust", "fn", "dd", "src/d.rs", 1, 2), ("fn-e", "rust", "fn", "ee", "src/e.rs", 1, 2), ("fn-f", "rust", "fn", "ff", "src/f.rs", 1, 2),
]


def live(spark, m="", f="", keep=(), name_f="ff", seeds=True):
    comps = [(*r[:3], name_f if r[0] == "fn-f" else r[3] if seeds or r[3] != "main" else "mm", *r[4:]) for r in LIVE]
    files = [("src/m.rs", "fn main() {\n bb(); cc();\n}\n\n\n\n\n" + m), ("src/d.rs", "fn dd() {\n x::y();\n}"), ("src/e.rs", "fn ee() {\n}\n"), ("src/f.rs", "fn ff() {\n}\n" + f)]
    edges = spark.createDataFrame([("fn-a", "fn-b"), ("fn-b", "fn-c"), ("fn-d", "fn-e"), ("fn-d", "nowhere")], "src string, target string")
    rows = V.liveness(spark.createDataFrame(comps, COMP), edges, spark.createDataFrame(files, "path string, content string"), notes(spark, [(i, "fn", "x", None, None, "", ["keep"]) for i in keep] or [("none", "fn", "x", None, None, "", [])]))
    return {r["id"]: (r["death_status"], r["reasons"]) for r in rows.collect()}


def test_liveness(spark):
    base = live(spark)
    assert all(base[i] == ("alive", []) for i in ("fn-a", "fn-b", "fn-c"))
    assert base["fn-d"] == ("definitely_dead", ["not_reachable_from_seeds", "no_local_scope_references"])
    assert base["fn-e"] == ("definitely_dead", ["not_reachable_from_seeds", "all_parents_dead_candidates", "no_local_scope_references"])
    assert base["fn-f"][0] == "definitely_dead" and "no_dependency_edges" in base["fn-f"][1]
    assert live(spark, m="// see ff here\n")["fn-f"] == ("alive", [])
    assert live(spark, f="// ff again\n")["fn-f"] == ("alive", [])
    assert live(spark, keep=["fn-f"])["fn-f"] == ("alive", ["annotated_keep"])
    assert live(spark, f="x" * 512_001)["fn-f"][0] == "maybe_dead"
    assert live(spark, name_f="")["fn-f"][0] == "probably_dead"
    assert live(spark, seeds=False)["fn-b"][0] == "alive"  # no seed: the largest island


def test_liveness_of_names_without_words(spark):
    for name, use, other in (("==", "if a==b", "a === b"), ("$", "$(x)", "$$ x"), ("数据", "x.数据()", "数据库")):
        assert live(spark, name_f=name, m=f"{use}\n")["fn-f"] == ("alive", [])
        assert live(spark, name_f=name, m=f"{other}\n")["fn-f"][0] == "definitely_dead"
    assert live(spark, name_f="==", f="a == b\n")["fn-f"] == ("alive", [])


@pytest.mark.parametrize("seconds,text", [(1.5, "1.50s"), (59.99, "59.99s"), (60.0, "1m 0.00s"), (123.25, "2m 3.25s")])
def test_duration(spark, seconds, text):
    assert one(spark, T.duration, seconds) == text


def test_texts(spark):
    assert one(spark, T.type_prefix, "async def") == "async_def" and one(spark, T.type_prefix, "++") == "component"
    assert one(spark, T.indent_width, " \t x") == 6 and one(spark, T.id_prefix, "fn-1") == "fn" and one(spark, T.id_prefix, "-1") == "component"
    assert one(spark, T.lines, "a\r\nb\n") == ["a", "b"] and one(spark, T.lines, "") == [] and one(spark, T.lines, "\n") == [""]
    assert one(spark, T.ascii_lower, "ÉA") == "Éa"
    assert one(spark, lambda c: T.preview(c, 8), "  abcdefghij\nx") == "abcde..."
    assert one(spark, lambda c: T.staleness_reason(F.lit(True), c), 1) == "HEAD changed since the last save; 1 indexed file changed on disk"
    assert one(spark, lambda c: T.decoded(F.unhex(c)), "61ff62") == "a\ufffdb"
