"""Notes on components: finding their component, upkeep, text form."""

from __future__ import annotations

import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ascii_lower, preview

#: Tags that keep a component from being called dead (fixed values).
KEEP_TAGS = ("keep", "public_api", "entrypoint")


def keeps(tags: Column | str) -> Column:
    """Whether one of the tags keeps its component; case counts."""
    return F.coalesce(F.arrays_overlap(F.col(tags) if isinstance(tags, str) else tags, F.array(*(F.lit(t) for t in KEEP_TAGS))), F.lit(False))


def _single(components: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Components that are alone with their key values, as (keys, name)."""
    return components.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias(name)).where("_n = 1").drop("_n")


def resolve(annotations: DataFrame, components: DataFrame) -> DataFrame:
    """annotations with component_id: the component each is about, null if none can be told.

    In turn: the component with the annotation's id; the only one of its file,
    name and type (and language, where the annotation has one); where the
    annotation has no file, the only one of its name and type. A file that
    doesn't lead to exactly one component ends the search. Keys that aren't
    alone are dropped before the joins, so no join multiplies rows.
    """
    keyed = annotations.withColumnsRenamed({"component_name": "_name", "component_type": "_type", "file": "_file", "language": "_lang"})
    by_id = components.select(F.col("id").alias("hash_id"), F.col("id").alias("_by_id")).distinct()
    rename = {"name": "_name", "type": "_type", "file": "_file", "language": "_lang"}
    bare = components.select("id", *(F.col(c).alias(x) for c, x in rename.items()))
    with_language = _single(bare, ["_file", "_name", "_type", "_lang"], "_in_file_lang")
    in_file = _single(bare, ["_file", "_name", "_type"], "_in_file")
    anywhere = _single(bare, ["_name", "_type"], "_anywhere")
    rows = (
        keyed.join(by_id, "hash_id", "left")
        .join(with_language, ["_file", "_name", "_type", "_lang"], "left")
        .join(in_file, ["_file", "_name", "_type"], "left")
        .join(anywhere, ["_name", "_type"], "left")
    )
    second = F.when(F.col("_lang").isNotNull(), F.col("_in_file_lang")).otherwise(F.col("_in_file"))
    tail = F.when(F.col("_file").isNotNull(), second).otherwise(F.col("_anywhere"))
    rows = rows.withColumn("component_id", F.coalesce("_by_id", tail)).drop("_by_id", "_in_file_lang", "_in_file", "_anywhere")
    back = {"_name": "component_name", "_type": "component_type", "_file": "file", "_lang": "language"}
    return rows.withColumnsRenamed(back).select(*annotations.columns, "component_id")


def applies(components: DataFrame, annotations: DataFrame) -> DataFrame:
    """Components an annotation fits: by id, or by file, name, type and language where it has one.

    Unlike resolve it asks for no uniqueness. Two semi joins on equal keys
    take the place of one with an OR.
    """
    by_id = components.join(annotations.select(F.col("hash_id").alias("id")), "id", "left_semi")
    a = annotations.where("file IS NOT NULL").select(
        F.col("file").alias("_f"), F.col("component_name").alias("_n"), F.col("component_type").alias("_t"), F.col("language").alias("_l")
    )
    same = (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")) & (F.col("type") == F.col("_t"))
    by_place = components.join(a, same & (F.col("_l").isNull() | (F.col("language") == F.col("_l"))), "left_semi")
    return by_id.unionByName(by_place.join(by_id.select("id"), "id", "left_anti"))


def with_notes(components: DataFrame, resolved: DataFrame, most: int = 80) -> DataFrame:
    """components with annotation_preview and annotation_tags; of several notes the last by (type, name, id)."""
    last = F.struct("component_type", "component_name", "hash_id")
    notes = resolved.where("component_id IS NOT NULL").groupBy(F.col("component_id").alias("id"))
    notes = notes.agg(F.max_by(F.struct("content", "tags"), last).alias("n"))
    return components.join(notes, "id", "left").withColumns(
        {"annotation_preview": preview("n.content", most), "annotation_tags": F.col("n.tags")}
    ).drop("n")


def orphans(resolved: DataFrame) -> DataFrame:
    """Annotations whose component can't be told."""
    return resolved.where("component_id IS NULL")


def reconciled(resolved: DataFrame, components: DataFrame) -> DataFrame:
    """Annotations brought in line with the component they are about: its id, file and language.

    old_id is the id before; rows whose component can't be told stay.
    """
    now = components.select(F.col("id").alias("component_id"), F.col("file").alias("_f"), F.col("language").alias("_l"))
    rows = resolved.join(now, "component_id", "left")
    return rows.select(
        F.coalesce("component_id", "hash_id").alias("hash_id"),
        F.col("hash_id").alias("old_id"),
        F.coalesce("_f", "file").alias("file"),
        F.coalesce("_l", "language").alias("language"),
        *(c for c in resolved.columns if c not in ("hash_id", "file", "language", "component_id")),
    )


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations after writing new ones by hash_id.

    An annotation that exists keeps its created_at, and its tags, links and
    content where the new ones are empty or blank.
    """
    was = old.select("hash_id", F.struct("content", "tags", "links", "created_at").alias("was"))
    rows = new.join(was, "hash_id", "left")
    kept = lambda c, empty: F.when(empty & F.col("was").isNotNull(), F.col(f"was.{c}")).otherwise(F.col(c)).alias(c)
    empty_list = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    changed = rows.select(
        *(c for c in old.columns if c not in ("content", "tags", "links", "created_at")),
        kept("content", F.trim(F.coalesce("content", F.lit(""))) == ""),
        kept("tags", empty_list("tags")),
        kept("links", empty_list("links")),
        F.coalesce("was.created_at", "created_at").alias("created_at"),
    )
    return old.join(new.select("hash_id"), "hash_id", "left_anti").unionByName(changed.select(old.columns))


def removed(old: DataFrame, ids: DataFrame) -> DataFrame:
    """Annotations without those of the given hash_ids."""
    return old.join(ids.select("hash_id").distinct(), "hash_id", "left_anti")


def of_type(annotations: DataFrame, kind: str) -> DataFrame:
    return annotations.where(ascii_lower("component_type") == kind)


# --- text form ------------------------------------------------------------------

NOTE = (
    "hash_id string, component_type string, component_name string, file string, language string, tags array<string>, "
    "links array<string>, created_at string, updated_at string, content string"
)


def rendered(annotations: DataFrame) -> DataFrame:
    """(hash_id, text): each annotation as text with a head of TOML between lines of three hyphens."""
    head = ("hash_id", "component_type", "component_name", "file", "language", "created_at", "updated_at")
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    value = lambda c: F.regexp_extract(quoted(c), r'(?s)^\{"v":(.*)\}$', 1)
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} = "), value(F.col(c)))) for c in head]
    lists = [F.concat(F.lit(f"{c} = "), value(F.coalesce(F.col(c), F.array().cast("array<string>")))) for c in ("tags", "links")]
    body = F.regexp_replace(F.coalesce("content", F.lit("")), r"\n+\z", "")
    return annotations.select("hash_id", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines, *lists), F.lit("\n---\n"), body, F.lit("\n")).alias("text"))


def parse_note(text: str) -> dict:
    """The annotation written in a text; ValueError if the head is missing or not closed."""
    rows = text.replace("\r\n", "\n").split("\n")
    if not rows or rows[0].strip() != "---":
        raise ValueError("no head: the first line must be ---")
    end = next((i for i, row in enumerate(rows[1:], 1) if row.strip() == "---"), None)
    if end is None:
        raise ValueError("the head is not closed by ---")
    head = tomllib.loads("\n".join(rows[1:end]))
    return {**head, "content": "\n".join(rows[end + 1 :]).rstrip("\n")}


def parsed(texts: DataFrame) -> DataFrame:
    """Annotations of texts: (text) in, NOTE out. One text that can't be read fails the scan, as a bad file should."""
    fields = [f.split(" ", 1) for f in NOTE.split(", ")]
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches):
        for batch in batches:
            notes = [parse_note(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pylist([{n: note.get(n) for n, _ in fields} for note in notes], schema)

    return texts.select("text").mapInArrow(run, NOTE)
