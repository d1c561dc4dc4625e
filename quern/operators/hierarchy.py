"""Parent links to full hierarchies by heavy-path decomposition.

Stages, none of which needs more than a logarithmic number of rounds:

1. Pointer doubling finds depth and root of every node and, in the same
   rounds, the sums over its subtree. Nodes whose pointers never run out are
   set apart: those that pointers of ever larger reach still hit lie on a
   cycle, the others only lead to one.
2. Every node's largest child continues its chain; the others head chains of
   their own. At most log2(nodes) chains lie between a node and its root.
3. Chains take their position in one preorder numbering and the path of their
   parents from the chain they hang on, level by level; a node adds its own
   segment. A subtree is the interval [pre, post].
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.cleaning import lower_trimmed, topic_path
from quern.operators.skew import BROADCAST_ROWS, global_index, lookup_join, skew_join
from quern.session import cut

SCHEMA = (
    "path string, parent string, is_entry boolean, status string, depth long, root string, "
    "parents array<string>, pre long, post long, n_below long, n_links long, n_members long"
)


def catalog_entries(catalog: DataFrame) -> DataFrame:
    """(path, parent) of a link catalog: one row per path.

    Paths and parents are cleaned; rows without a path are no entries. Of
    several parents given for one path the least holds.
    """
    rows = catalog.select(topic_path("path").alias("path"), topic_path("parent_path").alias("parent"))
    return rows.where("path IS NOT NULL").groupBy("path").agg(F.min("parent").alias("parent"))


def catalog_nodes(catalog: DataFrame) -> DataFrame:
    """(path, parent, is_entry) of a link catalog: one row per path.

    A parent without an entry becomes a node with is_entry false, the root of
    what names it.
    """
    entries = catalog_entries(catalog)
    named = entries.select(F.col("parent").alias("path")).where("path IS NOT NULL").distinct()
    missing = named.join(entries, "path", "left_anti")
    return entries.withColumn("is_entry", F.lit(True)).unionByName(
        missing.select("path", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("is_entry"))
    )


def membership_counts(membership: DataFrame) -> DataFrame:
    """(path, links, members): rows and distinct components filed under each path itself."""
    rows = membership.select(topic_path("path").alias("path"), lower_trimmed("component_id").alias("component"))
    pairs = rows.where("path IS NOT NULL").groupBy("path", "component").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("path").agg(F.sum("n").alias("links"), F.count("component").alias("members"))


def _double(state: DataFrame, n: int) -> DataFrame:
    """One round over n nodes: pointers reach twice as far, sums take in the depth they now cover."""
    reach = state.select(
        F.col("path").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("top").alias("top2")
    )
    sums = state.where("up IS NOT NULL").groupBy(F.col("up").alias("path"))
    sums = sums.agg(*(F.sum(c).alias(f"_{c}") for c in ("size", "links", "members")))
    jumped = lookup_join(state, reach, "up", "left", n).select(
        "path",
        F.col("up2").alias("up"),
        (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
        F.coalesce("top2", "top").alias("top"),
        "size",
        "links",
        "members",
    )
    added = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("size", "links", "members")]
    return lookup_join(jumped, sums, "path", "left", n).select("path", "up", "dist", "top", *added)


def separate(nodes: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest (path, depth, root, size, links, members) and the rest (path, status).

    status is cycle for a node that is among its own ancestors and
    leads_to_cycle for one whose parents end in such a node.
    """
    state = nodes.join(counts, "path", "left").select(
        "path",
        F.col("parent").alias("up"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.coalesce("parent", "path").alias("top"),
        F.lit(1).cast("long").alias("size"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("members", F.lit(0)).alias("members"),
    )
    state = cut(state)
    n, still_open = state.agg(F.count(F.lit(1)), F.count("up")).first()
    open_before = -1
    # No node has a depth between two reaches: then none is deeper, and what is open never ends.
    while still_open and still_open != open_before:
        state = cut(_double(state, n))
        open_before, still_open = still_open, state.where("up IS NOT NULL").count()
    forest = state.where("up IS NULL").select("path", F.col("dist").alias("depth"), F.col("top").alias("root"), "size", "links", "members")
    endless = state.where("up IS NOT NULL").select("path", "up")
    if not still_open:
        return forest, endless.select("path", F.lit("cycle").alias("status"))
    endless = cut(endless)
    ring = _rings(endless, still_open).withColumn("ring", F.lit(True))
    status = F.when(F.col("ring"), "cycle").otherwise("leads_to_cycle").alias("status")
    return forest, endless.select("path").join(ring, "path", "left").select("path", status)


def _further(pointers: DataFrame, n: int) -> DataFrame:
    """Of n pointers (path, up) those that reach twice as far; those that would leave the table are gone."""
    reach = pointers.select(F.col("path").alias("up"), F.col("up").alias("up2"))
    return lookup_join(pointers, reach, "up", "inner", n).select("path", F.col("up2").alias("up"))


def _rings(endless: DataFrame, n: int) -> DataFrame:
    """(path) of the nodes on cycles, from n pointers none of which ever ends.

    What pointers hit shrinks as they reach further, until only the cycles are
    left: where it stays the same they map it onto itself.
    """
    hit_before, hit = -1, endless.select("up").distinct().count()
    while hit and hit != hit_before:
        endless = cut(_further(endless, n))
        hit_before, hit = hit, endless.select("up").distinct().count()
    return endless.select(F.col("up").alias("path")).distinct()


def cycle_nodes(nodes: DataFrame) -> DataFrame:
    """(path) of the nodes that are among their own ancestors: the cycle separation of `hierarchy` by itself.

    nodes: (path, parent), one row per path; a parent need not be among the
    paths. Only pointers that are still open are carried on, so a forest
    without cycles shrinks to nothing. Empty input gives no rows.
    """
    pointers = cut(nodes.where("parent IS NOT NULL").select("path", F.col("parent").alias("up")))
    open_before, still_open = -1, pointers.count()
    # Where no pointer ended, none has a depth between two reaches, and so none a greater one.
    while still_open and still_open != open_before:
        pointers = cut(_further(pointers, still_open))
        open_before, still_open = still_open, pointers.count()
    return _rings(pointers, still_open)


def _chains(tree: DataFrame, heavy: DataFrame, n: int) -> DataFrame:
    """(path, head, pos): the chain each of n nodes lies on and its place there."""
    state = lookup_join(tree, heavy.select(F.col("heavy").alias("path"), F.lit(True).alias("inner")), "path", "left", n).select(
        "path",
        F.when(F.col("inner"), F.col("parent")).alias("up"),
        F.when(F.col("inner"), F.col("parent")).otherwise(F.col("path")).alias("head"),
        F.when(F.col("inner"), 1).otherwise(0).cast("long").alias("pos"),
    )
    state = cut(state)
    while state.where("up IS NOT NULL").limit(1).count():
        # Every chain pointer leads to another node, so this join has no hot key.
        reach = state.select(F.col("path").alias("up"), F.col("up").alias("up2"), F.col("head").alias("head2"), F.col("pos").alias("pos2"))
        state = cut(
            (state.join(F.broadcast(reach), "up", "left") if n <= BROADCAST_ROWS else state.join(reach, "up", "left")).select(
                "path",
                F.col("up2").alias("up"),
                F.coalesce("head2", "head").alias("head"),
                (F.col("pos") + F.coalesce("pos2", F.lit(0))).alias("pos"),
            )
        )
    return state.select("path", "head", "pos")


def hierarchy(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Chain of parents, depth, root and subtree of every node; columns as in SCHEMA.

    nodes: (path, parent, is_entry), one row per path, every non-null parent
    among the paths (catalog_nodes makes them). counts: (path, links,
    members), those of unknown paths count nowhere. parents runs from the
    root to the direct parent. [pre, post] numbers the nodes in preorder over
    the whole forest: the nodes below v are those with v.pre < pre <= v.post.
    n_below counts them, n_links and n_members sum counts over v and all below.
    Nodes whose chain never ends have status cycle or leads_to_cycle and
    nulls; the others have status tree. Empty input gives no rows.

    The result holds one array element per node and ancestor, which is what a
    full chain is; everything before it is linear in the nodes.
    """
    nodes = cut(nodes.select("path", "parent", "is_entry"))
    forest, endless = separate(nodes, counts)
    tree = cut(forest.join(nodes, "path"))
    n = tree.count()  # bounds what is looked up below

    children = tree.where("parent IS NOT NULL")
    best = children.groupBy("parent").agg(F.max(F.struct("size", "path")).alias("best"))
    heavy = cut(best.select("parent", F.col("best.path").alias("heavy"), F.col("best.size").alias("heavy_size")))
    placed = cut(lookup_join(_chains(tree, heavy, n), tree, "path", "inner", n))

    # Order among the chains that hang on one node: a running sum over all of
    # them, less the sum at the first of that node, so that a node with very
    # many children is never one task's work.
    heads = placed.where("pos = 0").select("path", "parent", "size")
    summed = cut(global_index(heads, ["parent", "path"], F.col("size"), "before"))
    first = summed.where("parent IS NOT NULL").groupBy("parent").agg(F.min("before").alias("first"))
    at_parent = first.join(heavy, "parent", "left").select("parent", "first", "heavy_size")
    offset = (
        F.when(F.col("parent").isNull(), F.col("before"))
        .otherwise(F.col("before") - F.col("first") + F.coalesce("heavy_size", F.lit(0)) + 1)
        .alias("offset")
    )
    offsets = lookup_join(summed, at_parent, "parent", "left", n).select(F.col("path").alias("head"), "parent", offset)

    members = placed.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("nodes"))
    hooks = placed.select(F.col("path").alias("parent"), F.col("head").alias("on_head"), F.col("pos").alias("on_pos"))
    chains = lookup_join(offsets, hooks, "parent", "left", n).join(members, "head")
    chains = cut(chains.select("head", "on_head", "on_pos", "offset", F.col("nodes.path").alias("nodes")))

    # Roots come first among all heads (null parents sort first), so their
    # running sums are the places of the trees.
    done = level = cut(
        chains.where("on_head IS NULL").select("head", "nodes", F.col("offset").alias("base"), F.array().cast("array<string>").alias("prefix"))
    )
    waiting = chains.where("on_head IS NOT NULL")
    while True:
        hung = level.select(
            F.col("head").alias("on_head"), F.col("nodes").alias("on_nodes"), F.col("base").alias("on_base"), F.col("prefix").alias("on_prefix")
        )
        level = cut(
            # These rows carry whole chains: they are never broadcast.
            skew_join(waiting, hung, "on_head", "inner").select(
                "head",
                "nodes",
                (F.col("on_base") + F.col("on_pos") + F.col("offset")).alias("base"),
                F.concat("on_prefix", F.slice("on_nodes", F.lit(1), (F.col("on_pos") + 1).cast("int"))).alias("prefix"),
            )
        )
        if not level.limit(1).count():
            break
        done = done.unionByName(level)

    pre = (F.col("base") + F.col("pos")).alias("pre")
    full = skew_join(placed, done, "head", "inner").select(
        "path",
        "parent",
        "is_entry",
        F.lit("tree").alias("status"),
        "depth",
        "root",
        F.concat("prefix", F.slice("nodes", F.lit(1), F.col("pos").cast("int"))).alias("parents"),
        pre,
        (F.col("base") + F.col("pos") + F.col("size") - 1).alias("post"),
        (F.col("size") - 1).alias("n_below"),
        F.col("links").alias("n_links"),
        F.col("members").alias("n_members"),
    )
    rest = endless.join(nodes, "path").select(
        "path",
        "parent",
        "is_entry",
        "status",
        *(
            F.lit(None).cast(t).alias(c)
            for c, t in (
                ("depth", "long"), ("root", "string"), ("parents", "array<string>"), ("pre", "long"),
                ("post", "long"), ("n_below", "long"), ("n_links", "long"), ("n_members", "long"),
            )
        ),
    )
    return full.unionByName(rest)


def below(tree: DataFrame) -> DataFrame:
    """(path, below): every node with each node under it, from the chains of parents."""
    return tree.where("status = 'tree'").select(F.explode("parents").alias("path"), F.col("path").alias("below"))
