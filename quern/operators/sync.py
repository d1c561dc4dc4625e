"""Keeping an index up to date: status lines, drift, deltas, partial syncs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.cleaning import file_path
from quern.functions.text import content_hash, detected_language
from quern.operators.edges import inferred_edges
from quern.operators.extraction import raw_components, with_ids
from quern.operators.liveness import liveness
from quern.session import cut
from quern.sources.ignore import ignored


def status_paths(lines: DataFrame, column: str = "raw") -> DataFrame:
    """(path): distinct paths of porcelain status lines; a rename gives both of its paths."""
    rest = F.trim(F.substring(F.rtrim(F.col(column)), 4, 10**6))
    paths = lines.where((F.length(F.rtrim(F.col(column))) >= 4) & (rest != "")).select(F.explode(F.split(rest, " -> ", 2)).alias("path"))
    return paths.select(file_path(F.trim("path")).alias("path")).where("path <> ''").distinct()


def dirty_to_sync(dirty: DataFrame, indexed: DataFrame, present: DataFrame, patterns: list[str]) -> DataFrame:
    """Dirty paths a sync must look at: present source files not ignored, and indexed files that are gone."""
    rows = (
        dirty.select("path").distinct()
        .join(indexed.select("path", F.lit(True).alias("_indexed")).distinct(), "path", "left")
        .join(present.select("path", F.lit(True).alias("_present")).distinct(), "path", "left")
    )
    usable = detected_language("path").isNotNull() & ~ignored(F.col("path"), patterns)
    keep = (F.coalesce("_present", F.lit(False)) & usable) | (F.coalesce("_indexed", F.lit(False)) & F.col("_present").isNull())
    return rows.where(keep).select("path")


def drift(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, drift): indexed files whose content is another or missing now; both sides (path, file_hash)."""
    now = current.select("path", F.col("file_hash").alias("_now"), F.lit(True).alias("_here"))
    rows = indexed.select("path", "file_hash").join(now, "path", "left")
    kind = F.when(F.col("_here").isNull(), "missing").when(~F.col("file_hash").eqNullSafe(F.col("_now")), "changed")
    return rows.select("path", kind.alias("drift")).where("drift IS NOT NULL")


def delta(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): keys added and removed between two tables."""
    plus = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    minus = before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return plus.unionByName(minus)


def partial_status(requested: DataFrame, indexed: DataFrame, current: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, status, reason): what a partial sync does with each requested path.

    indexed, current: (path, file_hash). removed: indexed, no longer there;
    indexed: read again; skipped with the reason: path does not exist,
    ignored, unsupported file extension, file hash unchanged.
    """
    was = indexed.select("path", F.col("file_hash").alias("_was"), F.lit(True).alias("_indexed"))
    now = current.select("path", F.col("file_hash").alias("_now"), F.lit(True).alias("_here"))
    rows = requested.select("path").distinct().join(was, "path", "left").join(now, "path", "left")
    here, known = F.col("_here").isNotNull(), F.col("_indexed").isNotNull()
    reason = (
        F.when(~here & ~known, "path does not exist")
        .when(here & ignored(F.col("path"), patterns), "ignored")
        .when(here & detected_language("path").isNull(), "unsupported file extension")
        .when(here & known & F.col("_was").eqNullSafe(F.col("_now")), "file hash unchanged")
    )
    status = F.when(reason.isNotNull(), "skipped").when(~here, "removed").otherwise("indexed")
    return rows.select("path", status.alias("status"), reason.alias("reason"))


def replaced(old: DataFrame, new: DataFrame, paths: DataFrame, column: str = "file") -> DataFrame:
    """Rows after a partial sync: those of the synced paths exchanged for the new ones."""
    gone = paths.select(F.col("path").alias(column)).distinct()
    return old.join(gone, column, "left_anti").select(old.columns).unionByName(new.select(old.columns))


#: What extraction gives for a component of the index.
_COMPONENT = ("id", "language", "type", "name", "file", "start_line", "end_line", "display_path")


@dataclass(frozen=True)
class Index:
    """An index's tables: files (path, language, file_hash), components, edges (src, target, kind), liveness (id, death_status, reasons)."""

    files: DataFrame
    components: DataFrame
    edges: DataFrame
    liveness: DataFrame


def _hashed(present: DataFrame) -> DataFrame:
    return present.select("path", "language", "content", content_hash("content").alias("file_hash"))


def _rebuilt(files: DataFrame, components: DataFrame, present: DataFrame, annotations: DataFrame, seeds: dict) -> Index:
    """The index of these components: edges and liveness are those of all files, whatever changed."""
    # Both read the components several times.
    components = cut(components)
    content = present.join(files.select("path"), "path", "left_semi").select("path", "language", "content")
    edges = cut(inferred_edges(components, content))
    return Index(files, components, edges, liveness(components, edges, content, annotations, **seeds))


def _components_of(files: DataFrame) -> DataFrame:
    return with_ids(raw_components(files)).select(*_COMPONENT)


def full_sync(present: DataFrame, annotations: DataFrame, patterns: list[str], **seeds) -> Index:
    """The index of a tree built anew. present: (path, language, content), one row per path; seeds as in liveness."""
    usable = _hashed(present).where(F.col("language").isNotNull() & ~ignored(F.col("path"), patterns))
    return _rebuilt(usable.select("path", "language", "file_hash"), _components_of(usable), present, annotations, seeds)


def partial_sync(
    index: Index, requested: DataFrame, present: DataFrame, annotations: DataFrame, patterns: list[str], **seeds
) -> tuple[Index, DataFrame]:
    """The index after a sync of the requested paths, and (path, status, reason) of each.

    Rows of indexed and removed paths are exchanged, and so are those of
    present files whose extension is no longer known; all else keeps its
    components. An indexed file that is gone is dropped even if nobody asked
    for it. Then edges and liveness are computed for the whole index. A file
    that changed but wasn't requested keeps its components and its old hash,
    so it still shows as drifted.
    """
    now = cut(_hashed(present))
    status = cut(partial_status(requested, index.files, now, patterns))
    read = status.where("status = 'indexed'").select("path")
    gone = status.where("status = 'removed' OR reason = 'unsupported file extension'").select("path")
    missing = index.files.select("path").join(now.select("path"), "path", "left_anti")
    paths = read.unionByName(gone).unionByName(missing).distinct()
    fresh = now.join(read, "path", "left_semi")
    files = replaced(index.files.select("path", "language", "file_hash"), fresh.select("path", "language", "file_hash"), paths, "path")
    components = replaced(index.components.select(*_COMPONENT), _components_of(fresh), paths)
    return _rebuilt(cut(files), components, present, annotations, seeds), status


def add_file(index: Index, path: str, present: DataFrame, annotations: DataFrame, patterns: list[str], **seeds) -> Index:
    """A partial sync of one file; ValueError with the reason if it wasn't indexed, unless it was unchanged."""
    asked = present.sparkSession.createDataFrame([(path,)], "path string").select(file_path("path").alias("path"))
    after, status = partial_sync(index, asked, present, annotations, patterns, **seeds)
    row = status.first()
    if row["status"] != "indexed" and row["reason"] != "file hash unchanged":
        raise ValueError(f"{path}: {row['reason'] or row['status']}")
    return after


def remove_file(index: Index, path: str, present: DataFrame, annotations: DataFrame, **seeds) -> tuple[Index, bool]:
    """The index without a file, and whether it held anything of it; untouched if it didn't."""
    asked = present.sparkSession.createDataFrame([(path,)], "path string").select(file_path("path").alias("path"))
    known = index.files.select("path").unionByName(index.components.select(F.col("file").alias("path")))
    if known.join(asked, "path", "left_semi").isEmpty():
        return index, False
    files = index.files.join(asked, "path", "left_anti")
    components = index.components.select(*_COMPONENT).join(asked.withColumnRenamed("path", "file"), "file", "left_anti").select(*_COMPONENT)
    return _rebuilt(cut(files), components, present, annotations, seeds), True


def refresh(index: Index, present: DataFrame, annotations: DataFrame, **seeds) -> Index:
    """Edges and liveness computed anew; files that are gone are dropped, all others keep components and hash."""
    here = present.select("path").distinct()
    files = index.files.join(here, "path", "left_semi")
    components = index.components.select(*_COMPONENT).join(here.withColumnRenamed("path", "file"), "file", "left_semi").select(*_COMPONENT)
    return _rebuilt(cut(files), components, present, annotations, seeds)


def sync_mode(files: list[str], git: bool | None, prefers_git: bool, index_empty: bool, is_repo: bool, dirty: int) -> tuple[str, str]:
    """(mode, reason) of a sync: partial for named files; git_partial or noop where git is asked for and can tell; else full."""
    if files:
        return "partial", "explicit_paths"
    wants = prefers_git if git is None else git
    if not wants:
        return "full", "requested"
    if index_empty:
        return "full", "empty_index"
    if not is_repo:
        return "full", "not_a_repository"
    return ("git_partial", "dirty_paths") if dirty else ("noop", "no_dirty_paths")
