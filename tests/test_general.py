"""The general data problems on small tables, cases and brute force."""

import random
from datetime import UTC, datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import hierarchy as H
from quern.operators import references as R
from quern.operators import snapshots as S
from quern.operators.skew import global_index, heavy_keys, skew_join

D = datetime
SNAP = "root string, generated_at string, path string, language string, file_hash string, received_at timestamp_ntz, extra int"


def snap(spark, rows):
    return spark.createDataFrame([(r, g, p, "x", h, t, 1) for r, g, p, h, t in rows], SNAP)


def changes(spark, rows):
    return {tuple(r)[:4] for r in S.snapshot_changes(snap(spark, rows)).collect()}


def test_changes_between_snapshots(spark):
    t = D(2025, 1, 1)
    rows = [
        ("r", "2025-01-01T00:00:00Z", "a", "1", t),
        ("r", "2025-01-01T01:00:00+01:00", "./b", "2", t),
        ("r", "2025-01-01T00:00:00.000Z", "c", None, t),
        ("r", "2025-01-01T00:00:00Z", "d", "4", t),
        ("r", "2025-03-01T00:00:00Z", "a", "ONE", D(2025, 1, 2)),  # replaced by the next
        ("r", "2025-03-01T00:00:00Z", "a", "1", D(2025, 1, 3)),
        ("r", "2025-03-01T00:00:00Z", "B", "2", t),
        ("r", "2025-03-01T00:00:00Z", "c", None, t),
        ("r", "2025-03-01T00:00:00Z", "d", None, t),
        ("r", "2025-03-01T00:00:00Z", "x\\y", "7", t),
        ("r", "2025-03-01T00:00:00Z", "x\\y", "7", t),
        ("only", "2025-03-01T00:00:00Z", "q", "7", t),
        (None, "2025-03-01T00:00:00Z", "q", "7", t),
        ("r", "no time", "q", "7", t),
        ("r", None, "q", "7", t),
        ("r", "2025-03-01T00:00:00Z", None, "7", t),
    ]
    at = "2025-03-01T00:00:00Z"
    assert changes(spark, rows) == {("r", at, "b", "removed"), ("r", at, "B", "added"), ("r", at, "d", "changed"), ("r", at, "x/y", "added")}


def test_except_all_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "w")], "k int, v string")
    over_a, over_b = S.except_all_both_ways(a, b)
    assert sorted(map(tuple, over_a.collect())) == sorted(map(tuple, a.exceptAll(b).collect())) == [(1, "x"), (3, "z")]
    assert sorted(map(str, over_b.collect())) == sorted(map(str, b.exceptAll(a).collect()))


def test_changes_of_nothing(spark):
    assert changes(spark, []) == set()


def test_changes_do_not_depend_on_the_session_zone(spark):
    t = D(2025, 1, 1)
    rows = [("r", "2025-01-01T00:00:00Z", "a", "1", t), ("r", "2025-02-01T00:00:00+02:00", "a", "2", t)]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert changes(spark, rows) == {("r", "2025-01-31T22:00:00Z", "a", "changed")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_orphans(spark):
    day = lambda n: D(2025, 1, n)
    parents = spark.createDataFrame(
        [("a", day(2), day(5)), ("a", day(2), day(5)), ("A ", day(8), None), ("b", day(1), day(3)), ("b", day(2), day(6)), ("z", None, None), (None, day(1), None)],
        "id string, first_seen_at timestamp_ntz, removed_at timestamp_ntz",
    )
    alive = R.lifetimes(parents, "id", "first_seen_at", "removed_at")
    assert alive.where("id = 'a'").count() == 2
    rows = [(" A\t", 1), ("a", 2), ("a", 5), ("a", 9), ("b", 5), ("b", 6), ("z", 3), ("", 3), (None, 3), ("gone", 3), ("gone", 3), ("a", None)]
    refs = spark.createDataFrame([(i, day(n) if n else None) for i, n in rows], "i string, t timestamp_ntz")
    found = R.orphans(R.references(refs, "t", F.col("i"), R.micros_of("t")), alive)
    assert {(r["id"], R_day(r["at"]), r["refs"]) for r in found.collect()} == {("a", 1, 1), ("a", 5, 1), ("b", 6, 1), ("z", 3, 1), ("gone", 3, 2)}


def R_day(micros):
    return datetime.fromtimestamp(micros / 1e6, UTC).day


def test_orphans_of_a_hot_key(spark):
    refs = spark.range(3000).select(F.lit("t").alias("ref_table"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("at"), F.lit(1).alias("refs"))
    alive = spark.createDataFrame([("hot", 0, 1500)], "id string, start long, end long")
    assert R.orphans(refs, alive).where("id = 'hot'").count() == 500
    assert R.orphans(refs, alive.where("false")).count() == 3000
    assert R.orphans(refs.where("false"), alive).count() == 0


# --- hierarchies ------------------------------------------------------------------------


def brute(parent):
    """Status, chain of parents and subtree of each node."""
    out = {}
    for node in parent:
        chain, at, seen = [], parent[node], {node}
        while at is not None and at not in seen:
            chain.append(at)
            seen.add(at)
            at = parent[at]
        if at is None:
            out[node] = ("tree", chain[::-1])
        else:
            out[node] = ("cycle" if at == node else "leads_to_cycle", None)
    return out


def hierarchy_of(spark, parent, links=None):
    nodes = spark.createDataFrame([(n, p, True) for n, p in parent.items()], "path string, parent string, is_entry boolean")
    counts = spark.createDataFrame(list((links or {"?": (1, 1)}).items()), "path string, c struct<a:long,b:long>").select("path", F.col("c.a").alias("links"), F.col("c.b").alias("members"))
    return {r["path"]: r for r in H.hierarchy(nodes, counts).collect()}


def check_hierarchy(spark, parent):
    links = {n: (i + 1, i % 3) for i, n in enumerate(sorted(parent))}
    got, want = hierarchy_of(spark, parent, links), brute(parent)
    rings = H.cycle_nodes(spark.createDataFrame(list(parent.items()), "path string, parent string"))
    assert sorted(r["path"] for r in rings.collect()) == sorted(p for p, r in got.items() if r["status"] == "cycle")
    assert set(got) == set(parent)
    tree = [n for n in parent if want[n][0] == "tree"]
    for n in parent:
        assert got[n]["status"] == want[n][0]
        if n not in tree:
            assert got[n]["depth"] is None
            continue
        below = [m for m in tree if n in want[m][1]]
        row = got[n]
        assert row["parents"] == want[n][1] and row["depth"] == len(want[n][1])
        assert row["root"] == (want[n][1] + [n])[0]
        assert row["n_below"] == len(below)
        assert row["n_links"] == sum(links[m][0] for m in [n, *below])
        assert {m for m in tree if row["pre"] < got[m]["pre"] <= row["post"]} == set(below)
    assert sorted(got[n]["pre"] for n in tree) == list(range(len(tree)))


def test_hierarchy_cases(spark):
    check_hierarchy(spark, {"a": None, "b": "a", "c": "a", "d": "b", "e": "d", "f": None, "s": "s", "x": "y", "y": "x", "z": "x", "zz": "z"})


def test_hierarchy_deep_and_wide(spark):
    parent = {"n000": None} | {f"n{i:03d}": f"n{i - 1:03d}" for i in range(1, 70)} | {f"w{i:03d}": "n000" for i in range(60)}
    check_hierarchy(spark, parent)


def test_hierarchy_random(spark):
    for seed in range(3):
        r = random.Random(seed)
        names = [f"k{i:02d}" for i in range(40)]
        check_hierarchy(spark, {n: (r.choice(names) if r.random() < 0.85 else None) for n in names})


def test_hierarchy_of_nothing(spark):
    nodes = spark.createDataFrame([], "path string, parent string, is_entry boolean")
    counts = spark.createDataFrame([], "path string, links long, members long")
    assert H.hierarchy(nodes, counts).count() == 0 and H.cycle_nodes(nodes).count() == 0


def test_catalog_nodes(spark):
    rows = [("/A/b/", " a "), ("a/B", None), ("a/b", "A/"), ("", "x"), (None, "x"), ("c", "  "), ("c", None), ("d", "missing")]
    catalog = spark.createDataFrame([(p, q, 1) for p, q in rows], "path string, parent_path string, pos int")
    got = {(r["path"], r["parent"], r["is_entry"]) for r in H.catalog_nodes(catalog).collect()}
    assert got == {("a/b", "a", True), ("a", None, False), ("c", None, True), ("d", "missing", True), ("missing", None, False)}


# --- helpers ----------------------------------------------------------------------------


def test_skew_join_is_a_join(spark):
    left = spark.range(500).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 90).alias("k"), "id")
    right = spark.range(60).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, skew_join(left, right, "k", how, most=3).select("k", "id", "v").collect())) == want
    assert heavy_keys(left, "k", 1).collect()[0]["k"] == 7


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=40))
def test_global_index(spark, rows):
    df = spark.createDataFrame([(a, i, v) for i, (a, v) in enumerate(rows)], "a int, i int, v int")
    got = {r["i"]: r["_index"] for r in global_index(df, ["a", "i"], F.col("v")).collect()}
    total = 0
    for a, i, v in sorted((a, i, v) for i, (a, v) in enumerate(rows)):
        assert got[i] == total
        total += v
