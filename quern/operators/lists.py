"""Listing and showing components, and what may be done to another project's index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import content_hash, lines, normal_language
from quern.operators.diagnostics import severity_rank
from quern.operators.search import narrowed
from quern.operators.skew import global_index

#: The order of components in an index, in a full list, among hits, and among links.
INDEX_ORDER = ("language", "file", "start_line", "type", "name")
LIST_ORDER = ("file", "start_line", "type", "name", "id")
HIT_ORDER = (*INDEX_ORDER, "id")
LINK_ORDER = ("file", "start_line", "name", "id")
NOTE_ORDER = ("component_type", "component_name", "hash_id")
#: Hits of a merged search: exact ones, then by score, falling.
MERGED_ORDER = ("match_rank", "-score", *HIT_ORDER)


def positions(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """rows with position, from 0, in an order; a column with a minus sorts falling, nulls come first.

    Rows are ranged, not gathered: only a count per partition reaches the driver.
    """
    falling = {c: f"_{c[1:]}" for c in order if c[0] == "-"}
    keyed = rows.withColumns({new: -F.col(c[1:]) for c, new in falling.items()})
    return global_index(keyed, [falling.get(c, c) for c in order], None, "position").drop(*falling.values())


def is_dead() -> Column:
    return F.col("death_status") != "alive"


def is_faulty() -> Column:
    return F.col("errors") + F.col("warnings") + F.col("notes") > 0


def listing(
    components: DataFrame, language: str | None = None, kind: str | None = None, everything: bool = False, dead: bool = False, fault: bool = False
) -> tuple[str, DataFrame]:
    """(mode, rows) of a list.

    No language: the languages. A language: its kinds with their counts. With
    everything, dead or fault: its components, the latter two those that are
    either. A kind: its components in index order; a kind and everything
    together are an error, as is a kind without a language.
    """
    if kind and everything:
        raise ValueError("a type and everything can't be listed together")
    if not language:
        if kind or everything or dead or fault:
            raise ValueError("a list of components needs a language")
        return "languages", components.select("language").distinct().orderBy("language")
    pool = narrowed(components, normal_language(language), kind)
    if dead or fault:
        either = (is_dead() if dead else F.lit(False)) | (is_faulty() if fault else F.lit(False))
        pool = pool.where(either)
    if kind:
        return "language_and_type", pool.orderBy(*INDEX_ORDER)
    if everything or dead or fault:
        return "language_all", pool.orderBy(*LIST_ORDER)
    return "language_summary", pool.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type")


def component(components: DataFrame, component_id: str) -> DataFrame:
    """The component with an id; KeyError where there is none."""
    found = components.where(F.col("id") == component_id)
    if found.isEmpty():
        raise KeyError(f"component {component_id!r} not found")
    return found


def shown(components: DataFrame, files: DataFrame, diagnostics: DataFrame, indexed: DataFrame | None = None, reported: Column | None = None) -> DataFrame:
    """(id, line, code, diagnostics, file_changed) of components' source, each line with its messages.

    files: (path, content); diagnostics: (file, line, severity, message), whose
    file is the path or what `reported` makes of it. file_changed: the file's
    content has another hash than the indexed one, (path, file_hash); null
    without indexed files.
    """
    spans = components.select("id", F.col("file").alias("path"), "start_line", "end_line")
    numbered = files.select("path", F.posexplode(lines("content")).alias("at", "code")).withColumn("line", F.col("at") + 1)
    inside = (numbered["path"] == spans["path"]) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    rows = numbered.join(spans, inside).select("id", numbered["path"], "line", "code")
    rows = rows.withColumn("_file", F.col("path") if reported is None else reported)
    item = F.struct(severity_rank("severity").alias("rank"), "severity", "message")
    said = diagnostics.groupBy(F.col("file").alias("_file"), "line").agg(F.array_sort(F.collect_list(item)).alias("diagnostics"))
    empty = F.array().cast("array<struct<rank:int,severity:string,message:string>>")
    rows = rows.join(said, ["_file", "line"], "left").withColumn("diagnostics", F.coalesce("diagnostics", empty))
    if indexed is None:
        return rows.select("id", "line", "code", "diagnostics", F.lit(None).cast("boolean").alias("file_changed"))
    now = files.select("path", content_hash("content").alias("_now")).join(indexed.select("path", "file_hash"), "path", "left")
    now = now.select("path", (~F.col("_now").eqNullSafe(F.col("file_hash"))).alias("file_changed"))
    return rows.join(now, "path").select("id", "line", "code", "diagnostics", "file_changed")


#: What is refused when another project is the target (fixed values).
LOCAL_ONLY = ("sync", "add", "remove", "config", "registry", "annotate remove")


def guard(action: str, external: bool) -> None:
    """PermissionError for an action that never reaches into another project."""
    if external and action in LOCAL_ONLY:
        raise PermissionError(f"{action} works on the own project only")
