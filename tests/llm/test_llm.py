"""Operators for text collections: cases, brute force, exact round trips, held-out accuracy."""

import collections
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))

from compare import check  # noqa: E402

from quern.llm import handwritten, mixing, packing, pii, queries, terms, tokens  # noqa: E402
from quern.llm.pii_training import GIVEN, compose  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, data, name):
    check(spark, data, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


# --- 1: files nobody wrote by hand -----------------------------------------------------

HAND = "def parse_{0}(alpha_{0}):\n    # what {0} needs\n    return other_{0}(alpha_{0})\n\n"
OWN = "".join(HAND.format(w) for w in ("tree", "leaf", "stem", "root", "bark", "twig"))


def reasons(spark, rows, patterns=("vendor/",), own=("acme",)):
    df = spark.createDataFrame([(p, c, 1) for p, c in rows], "path string, content string, score int")
    return {r["path"]: r["reason"] for r in handwritten.not_handwritten(df, list(patterns), own).collect()}


def test_generated_files(spark):
    ladder = "".join(f"func step{i:03d}(n int) int {{\n\treturn n\n}}\n" for i in range(8))
    grid = "".join(f"function {v}Gate(x) {{\n return x * {i};\n}}\n" for i, v in enumerate(("hot", "cold", "warm", "wet", "dry", "raw")))
    rows = [
        ("p/a.go", "// Code generated by foo from a.proto. DO NOT EDIT.\n" + OWN),
        ("p/b.py", "#!/usr/bin/env python\n# AUTOGENERATED FILE -- run `make b` to refresh\n" + OWN),
        ("p/c.rs", "// Diese Datei wurde automatisch aus x erzeugt. Nicht von Hand ändern.\n" + OWN),
        ("p/d.ts", "/* This file was created automatically; changes will be lost. */\n" + OWN),
        ("p/e.ts", "// Output of foogen at 2025; edit a.tmpl instead\n" + OWN),
        ("p/ladder.go", ladder),
        ("p/grid.js", grid),
        ("p/end.go", ladder + "// Fichier produit par foo, ne pas modifier.\n"),
    ]
    assert reasons(spark, rows) == {p: "generated" for p, _ in rows}


def test_handwritten_files(spark):
    rows = [
        ("p/generated/a.go", OWN),
        ("vendor/x.go", OWN),
        ("p/a.min.js", OWN),
        ("p/gen.py", '# The emitted header must read "Code generated by x. DO NOT EDIT."; see below.\n' + OWN),
        ("p/m.py", "# @generated markers are stripped by the caller.\n" + OWN),
        ("p/w.py", "# This used to be generated. It is maintained by hand since.\n" + OWN),
        ("p/l.py", "# Copyright (c) 2025 the acme team. All rights reserved.\n" + OWN),
        ("p/self.py", "# Copyright (c) 2025 the thing team. Part of thing itself.\n" + OWN),
        ("p/s.py", OWN + "TABLE = [\n" + "    1, 2, 3,\n" * 4 + "]\n"),
        ("p/long.py", "# sample kept on one line: " + "a=b;if(a){c=d[0]};" * 60 + "\n" + OWN),
        ("p/print.py", 'def f(out):\n    out("// Code generated by x. DO NOT EDIT.")\n' + OWN),
        ("p/empty.py", ""),
        ("p/null.py", None),
        (None, OWN),
    ]
    assert reasons(spark, rows) == {}
    assert reasons(spark, []) == {}


def test_minified_data_and_third_party(spark):
    minified = '"use strict";' + "".join(f"var a{i}=b.c,d{i}={i};function e{i}(f,g){{return h.i?{i}:j(k)}}" for i in range(60))
    data = "TABLE = [\n" + "".join(f'    ["w{i}", {i * 77}, {i}],\n' for i in range(60)) + "]\n"
    blob = "DATA = [\n" + '    "' + "hxOnMm0zWkUpZMjiQE17cvOoK6cu" * 2 + '",\n' + ('    "' + "aB3/" * 18 + '",\n') * 30 + "]\n"
    library = "".join(f"func zorbie{w}(n int) int {{\n\treturn n + {i}\n}}\n" for i, w in enumerate(("Parse", "Emit", "Close", "Open")))
    banner = "// zorbie 1.2.3\n// Copyright (c) 2019 the zorbie contributors. Permission is granted to use this file.\n\n"
    other = "func zorbieRest(n int) int {\n\treturn 7\n}\nfunc zorbieMore(k int) int {\n\treturn 9\n}\n"
    copied = library.replace("zorbie", "quuxly")
    shared = OWN.replace("other_", "some_")
    rows = [
        ("p/x.js", minified), ("p/y.py", data), ("p/z.py", blob), ("p/lib.go", banner + library), ("q/renamed.go", library), ("q/other.go", other),
        ("p/copy.go", copied), ("q/copy.go", copied), ("q/mine.py", OWN), ("p/shared.py", shared), ("q/shared.py", shared),
    ]
    got = reasons(spark, rows * 2)
    assert got == {
        "p/x.js": "minified", "p/y.py": "data", "p/z.py": "data", "p/lib.go": "third_party", "q/renamed.go": "third_party", "q/other.go": "third_party",
        "p/copy.go": "third_party", "q/copy.go": "third_party",
    }


def test_notices_in_strings_are_none(spark):
    head = "// Code generated by foo. DO NOT EDIT.\n# Code generated by foo. DO NOT EDIT.\n"
    rows = [
        ("p/a.py", f'HEAD = """\n{head}"""\n\n' + OWN),
        ("p/b.py", f"HEAD = '''\n{head}'''\n\n" + OWN),
        ("p/c.go", f"package p\n\nconst head = `\n{head}`\n"),
        ("p/d.ts", f"export const head = `\n{head}`;\n"),
        ("p/e.rs", f'const HEAD: &str = r#"\n{head}"#;\nfn f<\'a>(x: &\'a str) {{}}\n'),
        ("p/f.rs", f'const HEAD: &str = "\n{head}";\n'),
        ("p/g.cpp", f'const char *head = R"x(\n{head})x";\n'),
        ("p/h.swift", f'let head = """\n{head}"""\n'),
    ]
    assert reasons(spark, rows) == {}
    # The same lines outside of strings, and in comments of several lines, are notices.
    rows = [
        ("p/a.py", 'X = """\nsome text\n"""\n# Code generated by foo. DO NOT EDIT.\n' + OWN),
        ("p/b.js", "/*\n  This file was generated by foo.\n  Do not edit.\n*/\nfunction a() {}\n"),
        ("p/c.rs", "fn f<'a>(x: &'a str) { \"it's\" }\n// Code generated by foo. DO NOT EDIT.\n"),
    ]
    assert reasons(spark, rows) == {p: "generated" for p, _ in rows}


def test_data_counts_by_its_size(spark):
    numbers = ", ".join(map(str, range(9000)))
    rows = [
        ("p/one.py", f"TABLE = [{numbers}]\n"),
        ("p/eleven.py", "TABLE = [\n" + f"    {numbers},\n" * 11 + "]\n"),
        ("p/two.js", f"const A = [{numbers}];\nconst B = [{numbers}];\n"),
    ]
    assert reasons(spark, rows) == {p: "data" for p, _ in rows}
    assert reasons(spark, [("p/few.py", "A = [1, 2, 3]\nB = [4, 5]\n")]) == {}


def test_own_banners_are_told_by_the_tables(spark):
    def own(i):
        return f"// Copyright (c) 2024 the plumfield team. All rights reserved.\nfn plum_read_{i}(a: u8) -> u8 {{\n    a + {i}\n}}\nfn plum_write_{i}_back(b: u8) -> u8 {{\n    b * {i}\n}}\n"

    library = "// Copyright (c) 2019 the zorbie contributors. All rights reserved.\nfn zorbie_a(n: u8) -> u8 {\n    n + 1\n}\nfn zorbie_b(n: u8) -> u8 {\n    n + 2\n}\n"
    rows = [(f"t{i}/own{i}.rs", own(i)) for i in range(6)] + [(f"t{i}/lib.rs", library) for i in range(5)]
    assert reasons(spark, rows, own=()) == {f"t{i}/lib.rs": "third_party" for i in range(5)}
    # A single folder shows nothing: its banners count as they stand.
    assert set(reasons(spark, [("t/own.rs", own(1)), ("t/lib.rs", library)], own=())) == {"t/own.rs", "t/lib.rs"}


# --- 2 and 3: terms -------------------------------------------------------------------

POST = "token string, component_id string, origin string, extra int"


def postings(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], POST)


def test_term_counts_against_brute_force(spark):
    r = random.Random(4)
    words = [f" W{i}\t" if i % 3 else f"w{i}" for i in range(40)]
    rows = [(r.choice(words) if r.random() < 0.6 else "HOT", f"c{r.randrange(30)}", r.choice(["name", "annotation", None])) for _ in range(800)]
    rows += [("  ", "c1", "name"), (None, "c1", "name"), ("w1", None, "name")]
    want = {}
    for scope in ("all", "name"):
        seen = collections.defaultdict(list)
        kept = [(t.strip().lower(), c) for t, c, o in rows if t and t.strip() and c and (scope == "all" or o == "name")]
        for t, c in kept:
            seen[t].append(c)
        total = len({c for _, c in kept})
        want |= {(scope, t): (len(cs), len(set(cs)), total) for t, cs in seen.items()}
    for heavy in (1, 5, 60, 200):
        got = {(x["token_scope"], x["token"]): (x["n_rows"], x["n_components"], x["n_all"]) for x in terms.term_counts(postings(spark, rows), heavy).collect()}
        assert got == want
    limits = spark.createDataFrame([("all", 12, 0.5), ("name", None, None)], "token_scope string, min_components int, max_share double")
    marks = {(x["token_scope"], x["token"]): x["mark"] for x in terms.mark_terms(terms.term_counts(postings(spark, rows)), limits).collect()}
    for (scope, t), (_, n, total) in want.items():
        assert marks[scope, t] == ((None if scope == "name" else "rare" if n < 12 else "common" if n / total > 0.5 else None))


def test_terms_of_nothing(spark):
    assert terms.term_counts(postings(spark, [])).count() == 0
    assert terms.distinctive_terms(postings(spark, [])).count() == 0


def test_distinctive_terms_against_brute_force(spark):
    r = random.Random(5)
    rows = [(f"t{min(r.randrange(30), r.randrange(30))}", f"c{r.randrange(12)}", r.choice(["name", "annotation"])) for _ in range(300)]
    held = collections.defaultdict(set)
    for t, c, o in rows:
        held[c, t].add(o)
    tf = {k: len(v) for k, v in held.items()}
    cf = collections.Counter()
    for (_, t), n in tf.items():
        cf[t] += n
    mass = sum(tf.values())
    got = {(x["component_id"], x["token"]): (x["tf"], x["df"], x["cf"], x["score"]) for x in terms.distinctive_terms(postings(spark, rows + rows[:50])).collect()}
    for c in {c for c, _ in tf}:
        own = {t: n for (d, t), n in tf.items() if d == c}
        p = {t: n / sum(own.values()) for t, n in own.items()}
        for _ in range(20_000):
            e = {t: n * 0.3 * p[t] / (0.7 * cf[t] / mass + 0.3 * p[t]) for t, n in own.items()}
            new = {t: v / sum(e.values()) for t, v in e.items()}
            done = max(abs(new[t] - p[t]) for t in p) <= 1e-13
            p = p if done else new
            if done:
                break
        for t, n in own.items():
            assert got[c, t][:3] == (n, sum(1 for d, u in tf if u == t), cf[t])
            assert math.isclose(got[c, t][3], p[t], abs_tol=1e-6)
        assert math.isclose(sum(got[c, t][3] for t in own), 1.0, abs_tol=1e-9)


def test_rare_pairs(spark):
    rows = [("a", c, "name") for c in ("x", "y", "z")] + [("b", c, "annotation") for c in ("x", "y", "y")] + [("c", c, "name") for c in "xyzw"] + [("d", "x", "name")]
    pairs = terms.rare_pairs(terms.distinctive_terms(postings(spark, rows)))
    assert [(p["component_a"], p["component_b"], p["shared"]) for p in pairs.collect()] == [("x", "y", 2)]


def test_rare_pairs_of_a_component_with_a_third_of_the_postings(spark):
    rows = [(f"own{i}", "big", "name") for i in range(998)] + [(f"common{i}", f"c{j}", "name") for i in range(40) for j in range(50)]
    rows += [(t, c, "name") for t in ("s1", "s2") for c in ("big", "x", "y")]
    scores = terms.distinctive_terms(postings(spark, rows)).cache()
    assert {x["score"] for x in scores.where("component_id = 'big' AND token IN ('s1', 's2')").collect()} == {0.0}
    got = {(p["component_a"], p["component_b"], p["shared"]) for p in terms.rare_pairs(scores).collect()}
    assert got == {("big", "x", 2), ("big", "y", 2), ("x", "y", 2)}


def test_rare_pairs_without_scores(spark):
    r = random.Random(8)
    # Some rare tokens fill many rows and are spread, the others are shuffled by token.
    rows = [(f"hot{i}", f"c{(i + k) % 9}", "name") for i in range(6) for k in (0, 4) for _ in range(50)]
    rows += [(f"t{r.randrange(300)}", f"c{r.randrange(9)}", r.choice(["name", "annotation"])) for _ in range(700)]
    rows += [(" T7 ", "c1", "name"), (" ", "c1", "name"), (None, "c1", "name"), (" ", "c2", "name"), ("t7", None, "name")]
    held = collections.defaultdict(set)
    for t, c, _ in rows:
        if t and t.strip() and c:
            held[t.strip().lower()].add(c)
    shared = collections.Counter((a, b) for group in held.values() if len(group) <= 3 for a in group for b in group if a < b)
    want = {(*pair, n) for pair, n in shared.items() if n >= 2}
    assert want
    pairs = terms.rare_pairs(terms.token_frequencies(postings(spark, rows)))
    assert pairs.columns == ["component_a", "component_b", "shared"]
    assert {tuple(p) for p in pairs.collect()} == want
    scored = terms.rare_pairs(terms.distinctive_terms(postings(spark, rows)))
    assert {tuple(p)[:3] for p in scored.collect()} == want
    assert terms.rare_pairs(terms.token_frequencies(postings(spark, []))).count() == 0


@pytest.mark.parametrize("name, scored", [("p3_found", False), ("p3_pairs", True), ("p3_scores", True)])
def test_scores_only_where_they_come_out(spark, data, name, scored):
    # The model runs in Python; the cases don't depend on it.
    assert ("ArrowEvalPython" in queries.QUERIES[name](spark, data)._jdf.queryExecution().toString()) == scored


def test_scores_of_pairs(spark, data):
    held = collections.defaultdict(dict)
    for x in queries.p3_scores(spark, data).where("df BETWEEN 2 AND 3").collect():
        held[x["token"]][x["component_id"]] = x["score"]
    want = collections.defaultdict(list)
    for group in held.values():
        for a in group:
            for b in group:
                if a < b:
                    want[a, b].append(math.sqrt(group[a] * group[b]))
    got = {(p["component_a"], p["component_b"]): (p["shared"], p["score"]) for p in queries.p3_pairs(spark, data).collect()}
    assert got.keys() == {tuple(p) for p in queries.p3_found(spark, data).collect()} == {p for p, x in want.items() if len(x) >= 2}
    for pair, (n, score) in got.items():
        assert n == len(want[pair]) and math.isclose(score, sum(want[pair]), abs_tol=1e-6)


# --- 1: files nobody wrote ---------------------------------------------------------------


def shape(content):
    lines = content.split("\n")
    return handwritten._shape(lines, [None] * len(lines))[1]


def test_long_rows_of_data():
    row = ", ".join(str(i * 37 % 10007) for i in range(2000))
    assert shape("\n".join([row + ","] * 10)) == 1.0
    for head in ("const X = [", "static const int X[2000] = {", "let x: Vec<i32> = vec![", "X = np.array(["):
        assert shape(f"{head}{row}" + {"{": "};", "(": "])"}.get(head[-1], "])" if "(" in head else "];")) == 1.0
    assert shape("\n".join(f"const LIMIT_{i} = {i};" for i in range(40))) == 0.0
    assert shape('MESSAGE = ("' + "a long sentence, and on " * 20 + '")') == 0.0


def test_repetition_with_long_parameters():
    parameters = ", ".join(f"parameter_{i}: i64" for i in range(40))
    assert len(parameters) > 400
    assert handwritten.repetition("\n".join(f"fn call_{i}({parameters}) {{\n    run({i});\n}}" for i in range(1, 9))) == 1.0
    assert handwritten.repetition("fn a(" * 40_000) == handwritten.repetition("fn a(" * 40_000 + ")") == 0.0


# --- 7: containers ----------------------------------------------------------------------


def packed(spark, sizes, containers):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    return packing.pack(df, containers).collect()


@pytest.mark.parametrize("capacity", [16, 100, 512])
def test_packing_is_valid_and_tight(spark, capacity):
    r = random.Random(capacity)
    sizes = [min(int(r.lognormvariate(3.5, 1)), 3000) for _ in range(600)] + [0, None, capacity, 2 * capacity, 2 * capacity + 1]
    rows = packed(spark, sizes, [("k", capacity)])
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x)
        if x["container_id"] is not None:
            by_bin[x["container_id"]].append(x)
    assert set(by_doc) == set(range(len(sizes)))
    for d, n in enumerate(sizes):
        pieces = sorted(by_doc[d], key=lambda x: x["doc_start"])
        assert sum(x["n_tokens"] for x in pieces) == (n or 0)
        assert [x["doc_start"] for x in pieces] == list(np.cumsum([0] + [x["n_tokens"] for x in pieces])[:-1])
        assert len(pieces) == 1 or n > capacity  # only too large a text is cut
        assert len(pieces) == max(1, -(-(n or 0) // capacity))
    for xs in by_bin.values():
        xs.sort(key=lambda x: x["position"])
        assert [x["position"] for x in xs] == list(range(len(xs)))
        assert [x["container_start"] for x in xs] == list(np.cumsum([0] + [x["n_tokens"] for x in xs])[:-1])
        assert sum(x["n_tokens"] for x in xs) <= capacity
    assert sorted(by_bin) == list(range(len(by_bin)))
    least = -(-sum(n or 0 for n in sizes) // capacity)
    assert len(by_bin) <= 1.06 * least + 2


def test_packing_edges(spark):
    assert packed(spark, [], [("k", 8)]) == [] and packed(spark, [1], []) == []
    assert len({x["container_id"] for x in packed(spark, [5] * 40, [("k", 8)])}) == 40  # no two fit
    assert packed(spark, [1], [("k", None), (None, 8)]) == []
    with pytest.raises(ValueError):
        packed(spark, [1], [("k", 0)])
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (None, 3, "y"), (2, None, None)], "doc_id long, n_tokens long, container_id string")
    rows = packing.pack(df, [("k", 8)]).collect()
    assert sorted(str(x["doc_id"]) for x in rows) == ["1", "1", "2", "None"] and len({x["container_id"] for x in rows if x["container_id"] is not None}) == 2


def test_knapsack_against_brute_force():
    r = random.Random(1)
    for _ in range(30):
        n, capacity = r.randint(1, 4), r.randint(1, 20)
        lengths, limits = np.array([r.randint(1, 9) for _ in range(n)]), np.array([r.randint(0, 3) for _ in range(n)])
        values = np.array([r.random() for _ in range(n)])
        best = 0.0
        for uses in np.ndindex(*(limits + 1)):
            if np.dot(uses, lengths) <= capacity:
                best = max(best, float(np.dot(uses, values)))
        uses = packing.best_configuration(values, lengths, limits, capacity)
        assert (uses <= limits).all() and np.dot(uses, lengths) <= capacity and math.isclose(np.dot(uses, values), best)


def test_plan_reaches_a_known_optimum():
    # 60 + 40, 50 + 50 and 34 + 33 + 33 fill 100 exactly.
    plan = packing.plan_containers({60: 30, 40: 30, 50: 20, 34: 10, 33: 20}, 100)
    assert plan.bins == 50


@pytest.mark.parametrize(
    "name,histogram,capacity,gap",
    [
        ("uneven", {1000: 10**8, 30: 10**3, 700: 10**4}, 2048, 1.01),
        ("even", {i: 10**5 for i in range(1, 2048)}, 2048, 1.03),
        ("skewed", {i: 10**6 // i for i in range(1, 512)}, 512, 1.02),
        ("tiny", {1: 10**9, 2: 10**3, 500: 5}, 512, 1.01),
        ("one", {7: 3}, 512, 3.0),
    ],
)
def test_plan_closes_the_gap_whatever_the_counts(monkeypatch, name, histogram, capacity, gap):
    import time

    handed = []
    best_fit = packing._best_fit
    monkeypatch.setattr(packing, "_best_fit", lambda rest, lengths, c: handed.append(int((rest * lengths).sum())) or best_fit(rest, lengths, c))
    for factor in (1, 1000):
        began = time.process_time()
        plan = packing.plan_containers({k: n * factor for k, n in histogram.items()}, capacity)
        assert time.process_time() - began < 20
        placed = sum((uses * k for uses, k in plan.configurations), np.zeros(len(plan.ends), dtype=np.int64))
        assert placed.sum() == factor * sum(histogram.values())
        assert all((uses * plan.ends).sum() <= capacity for uses, _ in plan.configurations)
        assert plan.bins <= gap * max(plan.bound, 1) + 8
        # Best fit gets less than eight containers' worth, and places it class by class.
        assert all(size < 8 * capacity for size in handed)


def test_best_fit_works_by_class():
    rest, lengths = np.array([10**9, 10**8, 3]), np.array([3, 50, 90])
    plan = packing._best_fit(rest.copy(), lengths, 100)
    assert (sum(uses * k for uses, k in plan) == rest).all() and all((uses * lengths).sum() <= 100 for uses, _ in plan)
    assert sum(k for _, k in plan) <= 1.03 * (rest * lengths).sum() / 100 + 3


def test_token_counts(spark):
    texts = [("a", "Hello world"), ("b", ""), ("c", None), ("d", "<|endoftext|> é\n" * 3), ("e", "x" * 200_000)]
    got = {r["id"]: r["n_tokens"] for r in tokens.with_token_counts(spark.createDataFrame(texts, "id string, text string")).collect()}
    clash = spark.createDataFrame([("a", "Hello", "no")], "n_tokens string, text string, k string")
    assert tokens.with_token_counts(clash).first().asDict() == {"k": "no", "n_tokens": 1}
    encode = tokens.encoder().encode_ordinary
    assert got == {k: len(encode(t or "")) for k, t in texts}
    for _, t in texts:
        assert tokens.encoder().decode(encode(t or "")) == (t or "")


# --- 8: mixtures -------------------------------------------------------------------------


def test_poisson_inversion():
    cdf = mixing.thresholds(1.3, 4)
    p = [math.exp(-1.3) * 1.3**k / math.factorial(k) for k in range(4)]
    assert np.allclose(cdf, np.cumsum(p)) and list(mixing.thresholds(math.inf, 2)) == [0, 0] and mixing.thresholds(0.0, 2)[0] == 1
    even = np.ones(mixing.DRAW_BINS)
    for rate, most in ((0.4, 1), (1.7, 3), (3, 3), (0, 2)):
        mean = mixing.calibrated_mean(even, rate, most)
        limit = mixing.thresholds(mean, most)
        assert abs(sum(1 - x for x in limit) - rate) < 1e-3


def test_mixture(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["Big", "big ", "small-one", "small one"]) if i % 10 else None, r.randint(20, 60)) for i in range(4000)]
    docs = [(i, s if s is None or "small" not in s or i % 7 == 0 else "big", n) for i, s, n in docs] + [(9001, "other", 50), (9002, "big", 0), (9003, "big", None)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small_one", 0.3, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    out = mixing.repeats(sized, targets)
    rows = {x["doc_id"]: (x["source"], x["repeats"]) for x in out.collect()}
    assert len(rows) == len(docs) and rows[9001][1] == 0 and rows[9002][1] == 0 and rows[0][1] == 0
    assert max(n for s, n in rows.values() if s == "big") == 1 and max(n for s, n in rows.values() if s == "small_one") <= 3
    share = {x["source"]: x["reached_share"] for x in mixing.shares(out, targets).collect()}
    assert abs(share["big"] - 0.6 / 0.9) < 0.01 and abs(share["small_one"] - 0.3 / 0.9) < 0.01 and share["absent"] == 0
    again = {x["doc_id"]: x["repeats"] for x in mixing.repeats(sized.repartition(7, "n_tokens"), targets).collect()}
    assert again == {k: n for k, (_, n) in rows.items()}
    used = mixing.replicated(out).collect()
    assert collections.Counter(x["doc_id"] for x in used) == collections.Counter({k: n for k, (_, n) in rows.items() if n})
    assert [x["place"] for x in used] == sorted(x["place"] for x in used)
    # A source too small for a given total is used as often as allowed.
    capped = {x["source"]: x["repeats"] for x in mixing.repeats(sized, targets, total=10**7).where("n_tokens > 0").select("source", "repeats").distinct().collect() if x["source"] in ("big", "small_one")}
    assert capped == {"big": 1, "small_one": 3}
    odd = spark.createDataFrame([(None, "big", 5, 9), (1, None, None, 9), (1, None, None, 9)], "doc_id long, source string, n_tokens long, repeats int")
    loose = spark.createDataFrame([("big", 0.5, 1), ("big", 0.1, 2), (None, 0.2, 1), ("x", None, None)], "source string, target_share double, max_repeats int")
    assert mixing.repeats(odd, loose).count() == 3
    empty = mixing.repeats(sized.where("false"), targets)
    assert empty.count() == 0 and mixing.shares(empty, targets).where("reached_share IS NULL").count() == 3


# --- 9: personal information ---------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    given = frozenset(pii.fold(n) for n in GIVEN)
    return pii.trained(given), given


def test_held_out_accuracy(model):
    weights, given = model
    right = found = true = 0
    for text, labels in compose(600, 4242, sorted(given)):
        got = {(s.start, s.end, s.kind) for s in pii.find_spans(text, weights, given)}
        right, found, true = right + len(got & set(labels)), found + len(got), true + len(labels)
    assert right / found > 0.98 and right / true > 0.98


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Ask Petra Lindqvist before you touch it.", [("name", "Petra Lindqvist")]),
        ("Write to p.lindqvist@mail.acme.example if it comes back.", [("email", "p.lindqvist@mail.acme.example")]),
        ("mailto:petra_lindqvist at mail dot acme dot example", [("email", "petra_lindqvist at mail dot acme dot example")]),
        ("The pager forwards to +44 (0)7700 900 593 at night.", [("phone", "+44 (0)7700 900 593")]),
        ("The form was sent with SSN 666-79-8914 filled in.", [("id_number", "666-79-8914")]),
        ("Return the board to Flat 4, 9 Birchgate Close,\nAshcombe. It is late.", [("address", "Flat 4, 9 Birchgate Close,\nAshcombe")]),
        ("Sent by noreply@mail.acme.example on push.", []),
        ("Clone it from git@code.acme.example:core/x.git first.", []),
        ("The Victor scheduler and the Clara cache share one window.", []),
        ("Module Rose Street Parser renamed to x.", []),
        ("Trace id 20977-7790-0038 belongs to run 317.", []),
        ("", []),
        ("\n \t", []),
    ],
)
def test_single_sentences(model, text, expected):
    weights, given = model
    assert [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text, weights, given)] == expected


@pytest.mark.parametrize(
    "text", ["Tel.: 030 1234567 2024-05-01", "2024-05-01 030 1234567", "Tel.: 2024-05-01 030 1234567", "2024-05-01 2024-05-02 2024-05-03 030 1234567"]
)
def test_phone_beside_dates(model, text):
    weights, given = model
    assert "030 1234567" in {text[s.start : s.end] for s in pii.candidates(text, given) if s.kind == "phone"}
    assert [text[s.start : s.end] for s in pii.find_spans(text, weights, given)] == ["030 1234567"]


def test_short_lower_case_names(model):
    weights, given = model
    for name in ("anna beck", "clara ruiz", "li, anna"):
        text = f"ask {name} about it"
        assert name in {text[s.start : s.end] for s in pii.candidates(text, given)}
    assert [(s.kind, s.start, s.end) for s in pii.find_spans("ask anna beck about it", weights, given)] == [("name", 4, 13)]
    for text in ("anna has no time", "clara may run"):
        assert pii.find_spans(text, weights, given) == []


def test_marginals_against_brute_force(model):
    weights, given = model
    text = "cc Anna Lindqvist-Berg, Tom. Call 07700 900385 or 030/23125-591"
    spans = pii.candidates(text, given)[:12]
    scores = np.array([sum(weights.get(f, 0) for f in s.features) for s in spans]) / 4
    total, mass = 0.0, np.zeros(len(spans))
    best, best_set = 0.0, []
    for bits in range(2 ** len(spans)):
        chosen = [i for i in range(len(spans)) if bits >> i & 1]
        ordered = sorted(chosen, key=lambda i: spans[i].start)
        if any(spans[a].end > spans[b].start for a, b in zip(ordered, ordered[1:], strict=False)):
            continue
        score = float(scores[chosen].sum()) if chosen else 0.0
        total += math.exp(score)
        mass[chosen] += math.exp(score)
        if score > best + 1e-12:
            best, best_set = score, chosen
    assert np.allclose(pii._marginals(spans, scores), mass / total)
    got = pii.decode(spans, {f: w / 4 for f, w in weights.items()})
    assert {(s.start, s.end, s.kind) for s in got} == {(spans[i].start, spans[i].end, spans[i].kind) for i in best_set}


def test_find_and_redact(spark):
    text = "cc Petra Lindqvist\nTel.: 030/23125-591"
    long = ("word " * 30_000) + "Ask Petra Lindqvist before you touch it. " + "x" * 100_000 + " " + "9" * 5000 + "@" * 2000
    docs = spark.createDataFrame([(1, text, "k"), (2, None, None), (3, "", "k"), (4, long, "k"), (1, text, "k")], "doc_id long, text string, pii_kind string")
    given = spark.createDataFrame([("Petra",), (None,), ("Petra",)], "name string")
    found = pii.find(docs, given).collect()
    assert collections.Counter((r["doc_id"], r["pii_kind"], r["pii_text"]) for r in found) == {
        (1, "name", "Petra Lindqvist"): 2, (1, "phone", "030/23125-591"): 2, (4, "name", "Petra Lindqvist"): 1,
    }
    rows = {r["doc_id"]: r["text"] for r in pii.redact(docs, given).collect()}
    assert rows[1] == "cc [NAME]\nTel.: [PHONE]" and rows[2] is None and rows[3] == ""
    assert rows[4] == long.replace("Petra Lindqvist", "[NAME]")
    assert pii.find(docs.where(F.lit(False)), given).count() == 0


@pytest.mark.parametrize(
    "text",
    ["// a" + " " * 200_000 + "b", "1" * 200_000 + "x", '"' * 200_000, "fn a(" * 40_000, "/*" * 100_000, "A-" * 100_000, "12 Main " * 30_000, "anna.berg@mail.acme.example, Anna Berg; " * 3000, "a." * 100_000],
    ids=["blanks", "digits", "quotes", "brackets", "comments", "capitals", "streets", "mailboxes", "dots"],
)
def test_very_long_texts_take_linear_time(model, text):
    import time

    began = time.time()
    handwritten.file_features("p/a.py", text, handwritten._automaton(), frozenset())
    pii.find_spans(text, *model)
    assert time.time() - began < 10
