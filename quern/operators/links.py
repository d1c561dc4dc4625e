"""Hierarchical topic links of components: validation, merging, lookup, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.cleaning import as_col
from quern.functions.text import ascii_lower

#: Longest path in bytes, and most paths of one component (fixed values).
MAX_PATH_BYTES = 256
MAX_PATHS = 128


def valid_path(c: Column | str) -> Column:
    """A link path trimmed, or null if it isn't one.

    Parts are separated by single slashes, none at the ends, and none is
    blank. @project/topic needs both halves. At most MAX_PATH_BYTES bytes.
    """
    path = F.trim(as_col(c))
    parts = F.split(path, "/", -1)
    fine = F.forall(parts, lambda s: F.trim(s) != "") & (F.octet_length(path) <= MAX_PATH_BYTES)
    scoped = ~F.startswith(path, F.lit("@")) | ((F.size(parts) >= 2) & (F.trim(F.substring(parts[0], 2, MAX_PATH_BYTES)) != ""))
    return F.when(fine & scoped, path)


def scope(c: Column | str) -> Column:
    """Project id of a scoped path, null of a local one."""
    return F.when(F.startswith(as_col(c), F.lit("@")), F.regexp_extract(as_col(c), "^@([^/]+)/", 1))


def topic(c: Column | str) -> Column:
    """A path without its scope."""
    return F.regexp_replace(as_col(c), "^@[^/]+/", "")


def path_depth(c: Column | str) -> Column:
    """Slashes in a path."""
    return F.size(F.split(as_col(c), "/", -1)) - 1


def under(path: Column | str, query: Column | str) -> Column:
    """Whether a path is the query or lies below it, ASCII case aside."""
    p, q = ascii_lower(F.trim(as_col(path))), ascii_lower(F.trim(as_col(query)))
    return (p == q) | F.startswith(p, F.concat(q, F.lit("/")))


def merge(store: DataFrame, noted: DataFrame, most: int = MAX_PATHS) -> DataFrame:
    """(component_id, path, pos): stored paths, then those of notes, each once per component.

    store, noted: (component_id, path, pos). Invalid paths are dropped; of
    paths equal but for ASCII case the first spelling stays; a component keeps
    its first `most`, a limit of the data model. pos counts from 0. Repeats
    are dropped before the window, which then sees the distinct paths of one
    component.
    """
    both = store.select("component_id", valid_path("path").alias("path"), F.lit(0).alias("rank"), "pos").unionByName(
        noted.select("component_id", valid_path("path").alias("path"), F.lit(1).alias("rank"), "pos")
    )
    both = both.where("path IS NOT NULL AND component_id IS NOT NULL")
    first = both.groupBy("component_id", ascii_lower("path").alias("key")).agg(F.min(F.struct("rank", "pos", "path")).alias("f"))
    place = F.row_number().over(Window.partitionBy("component_id").orderBy("f")) - 1
    kept = first.withColumn("place", place).where(F.col("place") < most)
    return kept.select("component_id", F.col("f.path").alias("path"), F.col("place").alias("pos"))


def distinct_paths(*sources: DataFrame, prefix: str | None = None) -> DataFrame:
    """(path): every valid path of the sources once, spelt as the least, optionally those under a prefix."""
    rows = None
    for source in sources:
        part = source.select(valid_path("path").alias("path")).where("path IS NOT NULL")
        rows = part if rows is None else rows.unionByName(part)
    if prefix is not None:
        rows = rows.where(under("path", F.lit(prefix)))
    return rows.groupBy(ascii_lower("path").alias("key")).agg(F.min("path").alias("path")).select("path")


def top_paths(merged: DataFrame, n: int = 32) -> DataFrame:
    """(path, components) of the n paths most used, in lower case; n is kept within 1..256."""
    counts = merged.groupBy(ascii_lower("path").alias("path")).agg(F.countDistinct("component_id").alias("components"))
    return counts.orderBy(F.desc("components"), "path").limit(max(1, min(n, 256)))


def ordered_paths(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, sort_key, depth) for output: by the catalog's sort key, then path; catalog: (path, sort_key)."""
    keys = catalog.groupBy(ascii_lower("path").alias("key")).agg(F.min("sort_key").alias("sort_key"))
    rows = paths.withColumn("key", ascii_lower("path")).join(keys, "key", "left")
    return rows.select("path", F.coalesce("sort_key", F.lit("")).alias("sort_key"), path_depth("path").alias("depth"))


def show(merged: DataFrame, components: DataFrame, query: str) -> DataFrame:
    """Components filed under a path or below it, with the paths that match; orphans are left out."""
    hits = merged.where(under("path", F.lit(query))).groupBy(F.col("component_id").alias("id"))
    hits = hits.agg(F.array_sort(F.collect_set("path")).alias("paths"))  # at most MAX_PATHS each
    return components.join(hits, "id")


def peer_matches(scoped: DataFrame, peer: DataFrame, query: str) -> DataFrame:
    """(component_id, path, match_source) for @peer/topic: scoped paths here, and local paths of the peer.

    The query must name both a project and a topic.
    """
    project, _, tail = query.strip().removeprefix("@").partition("/")
    if not query.strip().startswith("@") or not project or not tail:
        raise ValueError("a peer lookup needs @project/topic")
    here = scoped.where(under("path", F.lit(query))).select("component_id", "path", F.lit("scoped").alias("match_source"))
    local = peer.where(~F.startswith(F.trim("path"), F.lit("@")) & under("path", F.lit(tail)))
    return here.unionByName(local.select("component_id", "path", F.lit("peer_local").alias("match_source")))


def orphan_memberships(store: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of the store whose component is not in the index."""
    return store.join(components.select(F.col("id").alias("component_id")), "component_id", "left_anti")


def compact(noted: DataFrame, store: DataFrame) -> DataFrame:
    """Links of notes less those the store has for the same component, ASCII case aside."""
    keyed = noted.withColumn("_key", ascii_lower(F.trim("path")))
    stored = store.select("component_id", ascii_lower(F.trim("path")).alias("_key")).distinct()
    return keyed.join(stored, ["component_id", "_key"], "left_anti").drop("_key")


def added(store: DataFrame, new: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """The store with new (component_id, path) rows after the old ones, merged as ever.

    With registered: (project_id), scoped paths of unknown projects are refused.
    """
    if registered is not None:
        known = new.withColumn("_p", scope("path")).join(
            registered.select(F.col("project_id").alias("_p"), F.lit(True).alias("_ok")).distinct(), "_p", "left"
        )
        new = known.where(F.col("_p").isNull() | F.col("_ok")).select("component_id", "path")
    place = F.row_number().over(Window.partitionBy("component_id").orderBy("path"))
    return merge(store, new.select("component_id", "path").distinct().withColumn("pos", place))


def removed(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without the given (component_id, path) rows, ASCII case aside."""
    return compact(store, gone)
