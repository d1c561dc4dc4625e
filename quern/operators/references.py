"""References to records that do not exist at the time they are made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.cleaning import instant, lower_trimmed, micros_of, utc_month
from quern.operators.skew import heavy_keys


def references(df: DataFrame, ref_table: str, key: Column, at: Column) -> DataFrame:
    """(ref_table, id, at, refs): how often a table refers to an id at an instant.

    key is a string column and at microseconds since the epoch. Blank and null
    keys refer to nothing; rows without a time can't be judged; both are left
    out. Counting here, before any shuffle, makes the keys distinct.
    """
    rows = df.select(lower_trimmed(key).alias("id"), at.alias("at")).where("id IS NOT NULL AND at IS NOT NULL")
    counts = rows.groupBy("id", "at").agg(F.count(F.lit(1)).alias("refs"))
    return counts.select(F.lit(ref_table).alias("ref_table"), "id", "at", "refs")


def lifetimes(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(id, start, end): when each key exists, repeated spells dropped.

    Null start: the spell is unknown and left out. Null end: it lasts. A spell
    that ends before it starts is empty. Spells may overlap.
    """
    forever = F.lit(2**63 - 1)
    spells = parents.select(
        lower_trimmed(key).alias("id"),
        micros_of(start).alias("start"),
        F.coalesce(micros_of(end), forever).alias("end"),
    ).where("id IS NOT NULL AND start IS NOT NULL AND end > start")
    return spells.groupBy("id", "start").agg(F.max("end").alias("end"))


def orphans(refs: DataFrame, alive: DataFrame, salts: int = 16) -> DataFrame:
    """Rows of refs (ref_table, id, at, refs) whose id does not exist at that time.

    Left anti-join of the distinct keys against the parents. The rows of ids
    that hold a large share of the references are salted by their time, and
    only the few spells of those ids (as many as shuffle partitions) are repeated
    once per salt, so no task gets a whole hot id.
    """
    heavy = F.broadcast(heavy_keys(refs, "id").withColumn("_heavy", F.lit(True)))
    slot = F.pmod(F.xxhash64("at", "ref_table"), F.lit(salts)).cast("int")
    left = refs.join(heavy, "id", "left").withColumn("_salt", F.when(F.col("_heavy"), slot).otherwise(0)).drop("_heavy")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = alive.join(heavy, "id", "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    match = (
        (left["id"] == right["id"])
        & (left["_salt"] == right["_salt"])
        & (right["start"] <= left["at"])
        & (left["at"] < right["end"])
    )
    return left.join(right, match, "left_anti").drop("_salt")


def orphan_report(refs: DataFrame, dangling: DataFrame) -> DataFrame:
    """(ref_table, ref_month, refs, orphan_refs, orphan_ids) per table and month."""
    month = utc_month(F.col("at")).alias("ref_month")
    totals = refs.groupBy("ref_table", month).agg(F.sum("refs").alias("refs"))
    per_id = dangling.groupBy("ref_table", month, "id").agg(F.sum("refs").alias("refs"))
    lost = per_id.groupBy("ref_table", "ref_month").agg(
        F.sum("refs").alias("orphan_refs"), F.count(F.lit(1)).alias("orphan_ids")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return totals.join(lost, ["ref_table", "ref_month"], "left").select(
        "ref_table", "ref_month", "refs", zero("orphan_refs"), zero("orphan_ids")
    )


def component_references(
    membership: DataFrame, annotations: DataFrame, edges: DataFrame, files: DataFrame
) -> DataFrame:
    """All references to components in the four referring tables of the index."""
    exploded = files.select(F.explode("component_ids").alias("component_id"), "indexed_at")
    parts = [
        references(membership, "link_membership", F.col("component_id"), micros_of("updated_at")),
        references(annotations, "annotations", F.col("hash_id"), instant("created_at")),
        references(edges, "dep_edges", F.col("target"), micros_of("generated_at")),
        references(exploded, "source_files", F.col("component_id"), micros_of("indexed_at")),
    ]
    return reduce(DataFrame.unionByName, parts)
