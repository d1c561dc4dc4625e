"""Stored tables: settings, registry, link store and catalog as JSON, the index as parquet."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.search import SearchIndex
from quern.sources.ignore import DEFAULT_PATTERNS

COMPONENT = "id string, language string, type string, name string, file string, start_line int, end_line int, display_path string"
POSTING = "token string, component_id string, origin string"
DIAGNOSTIC = "file string, line int, severity string, code string, message string"
CATALOG = "path string, title string, description string, parent_path string, sort_key string"


@dataclass(frozen=True)
class Settings:
    """A project's settings; unknown keys of a stored file are ignored."""

    default_dependency_depth: int = 2
    ignore_patterns: tuple[str, ...] = DEFAULT_PATTERNS
    index_storage: str = "index"
    index_pretty: bool = True
    diagnostics_enabled: bool = False
    diagnostics_timeout_secs: int = 120
    seed_files: tuple[str, ...] = ()
    seed_names: tuple[str, ...] = ()
    seed_types: tuple[str, ...] = ()
    empty_sync_uses_git: bool = False

    def changed(self, **values) -> Settings:
        return replace(self, **values)

    def with_ignores(self, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> Settings:
        kept = [p for p in self.ignore_patterns if p not in remove]
        return replace(self, ignore_patterns=tuple(dict.fromkeys([*kept, *add])))


def load_settings(path: str, template: str | None = None, write: bool = False) -> Settings:
    """Settings of a project; of the template where it has none (its storage place apart), else defaults.

    The default ignore patterns always apply. write: settings that came from
    elsewhere are stored as the project's own, as on its first use.
    """
    settings = _load_settings(path, template)
    if write and not os.path.exists(path):
        save_settings(settings, path)
    return settings


def _load_settings(path: str, template: str | None) -> Settings:
    known = Settings.__dataclass_fields__
    source = path if os.path.exists(path) else template if template and os.path.exists(template) else None
    if source is None:
        return Settings()
    with open(source) as file:
        stored = {k: tuple(v) if isinstance(v, list) else v for k, v in json.load(file).items() if k in known}
    if source != path:
        stored.pop("index_storage", None)
    settings = Settings(**stored)
    return settings.with_ignores(add=DEFAULT_PATTERNS)


def save_settings(settings: Settings, path: str) -> None:
    with open(path, "w") as file:
        json.dump(asdict(settings), file, indent=2)
        file.write("\n")


@dataclass
class Registry:
    """Projects by id and their roots."""

    projects: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Registry:
        if not os.path.exists(path):
            return cls()
        with open(path) as file:
            return cls({k: v["root"] for k, v in json.load(file).get("projects", {}).items()})

    def add(self, project_id: str, root: str) -> None:
        """ValueError if the id stands for another root."""
        if self.projects.get(project_id, root) != root:
            raise ValueError(f"project {project_id!r} has another root")
        self.projects[project_id] = root

    def remove(self, project_id: str) -> bool:
        return self.projects.pop(project_id, None) is not None

    def root(self, project_id: str) -> str:
        """KeyError for an unknown project."""
        return self.projects[project_id]

    def save(self, path: str) -> None:
        with open(path, "w") as file:
            json.dump({"version": 1, "projects": {k: {"root": v} for k, v in sorted(self.projects.items())}}, file, indent=2)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.projects.items()), "project_id string, root string")


# --- files wherever they lie ------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them, whatever the path's scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, on any file system Spark reads."""
    system, where = _file_system(spark, path)
    return system.exists(where)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    system, where = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, read on the driver."""
    system, where = _file_system(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file: written beside its place and then renamed, so that no reader sees half of it."""
    system, where = _file_system(spark, path)
    _, beside = _file_system(spark, path + ".tmp")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if system.exists(where):
        system.delete(where, False)
    if not system.rename(beside, where):
        raise OSError(f"could not write {path}")


# --- links and catalog -----------------------------------------------------------------


def read_link_store(spark: SparkSession, path: str) -> DataFrame:
    """(component_id, path, pos) of a link store {version, memberships: {id: [path]}}; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "component_id string, path string, pos int")
    raw = spark.read.schema("version int, memberships map<string,array<string>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("memberships").alias("component_id", "paths"))
    return rows.select("component_id", F.posexplode("paths").alias("pos", "path")).select("component_id", "path", "pos")


def link_lines(store: DataFrame, updated_at: str) -> DataFrame:
    """(value): the store as one JSON object per component, whose paths the data model bounds."""
    paths = store.groupBy("component_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("p"))
    return paths.select(F.to_json(F.struct("component_id", F.col("p.path").alias("paths"), F.lit(updated_at).alias("updated_at"))).alias("value"))


def read_link_lines(spark: SparkSession, path: str) -> DataFrame:
    """(component_id, path, pos) of a folder or file of link_lines."""
    raw = spark.read.schema("component_id string, paths array<string>").json(path)
    return raw.select("component_id", F.posexplode("paths").alias("pos", "path")).select("component_id", "path", "pos")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """CATALOG of a file {version, paths: {path: {...}}}; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], CATALOG)
    entry = "struct<title:string,description:string,parent_path:string,sort_key:string>"
    raw = spark.read.schema(f"version int, paths map<string,{entry}>").option("multiLine", True).json(path)
    return raw.select(F.explode("paths").alias("path", "e")).select("path", "e.*")


def catalog_lines(catalog: DataFrame, updated_at: str) -> DataFrame:
    """(value): the catalog as one JSON object per entry."""
    names = [f.split()[0] for f in CATALOG.split(", ")]
    return catalog.select(F.to_json(F.struct(*names, F.lit(updated_at).alias("updated_at"))).alias("value"))


def read_catalog_lines(spark: SparkSession, path: str) -> DataFrame:
    """CATALOG of a folder or file of catalog_lines."""
    return spark.read.schema(CATALOG).json(path)


def link_document(store: DataFrame, updated_at: str) -> str:
    """The one JSON text read_link_store reads, for stores that fit a driver: {version, updated_at, memberships}."""
    rows = store.groupBy("component_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("p")).orderBy("component_id")
    members = {r["component_id"]: [x["path"] for x in r["p"]] for r in rows.toLocalIterator()}
    return json.dumps({"version": 1, "updated_at": updated_at, "memberships": members}, indent=2, ensure_ascii=False) + "\n"


def catalog_document(catalog: DataFrame, updated_at: str) -> str:
    """The one JSON text read_catalog reads, for catalogs that fit a driver: {version, updated_at, paths}."""
    entries = {r["path"]: {k: v for k, v in r.asDict().items() if k != "path" and v is not None} for r in catalog.orderBy("path").toLocalIterator()}
    return json.dumps({"version": 1, "updated_at": updated_at, "paths": entries}, indent=2, ensure_ascii=False) + "\n"


# --- tables ----------------------------------------------------------------------------


def read_table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored parquet table, or an empty one of that schema where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """COMPONENT rows of an index that save_index wrote; none where there is no index."""
    return read_table_or_empty(spark, path, COMPONENT)


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    """POSTING rows that save_postings wrote; none where there is no token index."""
    return read_table_or_empty(spark, path, POSTING)


def load_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """DIAGNOSTIC rows that save_diagnostics wrote; none where no analyzer has run."""
    return read_table_or_empty(spark, path, DIAGNOSTIC)


def save_index(components: DataFrame, path: str) -> None:
    """Components by language: a listing of one language reads that part only.

    Ranged by language and file: a language with many files is written by many
    tasks, one with few shares a task.
    """
    ranged = components.repartitionByRange("language", "file").sortWithinPartitions("language", "file")
    ranged.write.mode("overwrite").partitionBy("language").parquet(path)


def save_postings(postings: DataFrame, path: str, files: int | None = None) -> None:
    """Postings ranged and sorted by token, so that a search skips row groups by their token range.

    files: how many to write; by default as many as shuffle partitions.
    """
    order = ("token", "component_id")
    ranged = postings.repartitionByRange(files, *order) if files else postings.repartitionByRange(*order)
    ranged.sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def save_search_index(index: SearchIndex, path: str) -> None:
    """An index's three tables, each ranged by what a search looks for in it."""
    save_postings(index.postings, f"{path}/postings")
    index.tokens.repartitionByRange("stem", "token").sortWithinPartitions("stem").write.mode("overwrite").parquet(f"{path}/tokens")
    index.grams.repartitionByRange("trigram", "token").sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{path}/grams")


def load_search_index(spark: SparkSession, path: str) -> SearchIndex:
    """An index that save_search_index wrote; an empty one where there is none."""
    tokens = read_table_or_empty(spark, f"{path}/tokens", "token string, stem string")
    grams = read_table_or_empty(spark, f"{path}/grams", "trigram string, token string")
    return SearchIndex(load_postings(spark, f"{path}/postings"), tokens, grams)


def save_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """The last analyzer run's messages, ranged by file; they replace those of the run before."""
    diagnostics.select(*(f.split()[0] for f in DIAGNOSTIC.split(", "))).repartitionByRange("file", "line").write.mode("overwrite").parquet(path)


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(text) of every .md file below a folder."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return raw.withColumnRenamed("value", "text")


def as_json(df: DataFrame) -> DataFrame:
    """(value): every row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def git_head(output: str) -> tuple[bool, str | None]:
    """(inside a work tree, head) of rev-parse's two lines."""
    rows = output.split("\n")
    inside = bool(rows) and rows[0].strip() == "true"
    return inside, (rows[1].strip() or None) if inside and len(rows) > 1 else None
