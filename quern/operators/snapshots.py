"""What changed between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.cleaning import file_path, instant, micros_of, utc_text
from quern.operators.skew import broadcast_if_small


def latest_rows(snapshots: DataFrame) -> DataFrame:
    """(root, at, path, hash), one row per root, instant and path.

    Input columns: root, generated_at (RFC-3339 text), path, file_hash,
    received_at; others are ignored. Of several rows for one path in a
    snapshot the one received last holds; of those received at one time the
    greatest hash. Rows without root, path or readable instant are no part of
    any snapshot and are left out. A null hash stays null, a value of its own.

    Rows are shuffled once, by root and path: that also serves everything that
    compares the snapshots of a root later, and spreads even a root that holds
    most of the rows.
    """
    cleaned = snapshots.select(
        F.col("root"),
        instant("generated_at").alias("at"),
        file_path("path").alias("path"),
        F.lower("file_hash").alias("hash"),
        micros_of("received_at").alias("got"),
    ).where("root IS NOT NULL AND at IS NOT NULL AND path IS NOT NULL")
    keyed = cleaned.repartition("root", "path")
    best = keyed.groupBy("root", "path", "at").agg(F.max(F.struct("got", "hash")).alias("best"))
    return best.select("root", "at", "path", F.col("best.hash").alias("hash"))


def residues(signed: DataFrame, columns: list[str]) -> DataFrame:
    """columns and _n of what two tables don't share, from their rows with _n 1 and -1: EXCEPT ALL both ways at once.

    EXCEPT ALL counts each distinct row up in one table and down in the other;
    what is over is the residue of the one (_n > 0) or the other (_n < 0).
    Nulls equal nulls.
    """
    return signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")


def except_all_both_ways(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a EXCEPT ALL b, b EXCEPT ALL a) for tables of the same columns, in one aggregation."""
    columns = a.columns
    rest = residues(a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))), columns)
    copies = lambda sign: F.explode(F.sequence(F.lit(1), sign * F.col("_n")))
    over = lambda sign: rest.where(sign * F.col("_n") > 0).withColumn("_k", copies(sign)).select(columns)
    return over(1), over(-1)


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(root, generated_at, path, change_kind, old_hash, new_hash) between consecutive snapshots.

    Each snapshot is compared with the one of the same root before it. EXCEPT
    ALL in both directions drops the rows that stayed the same; what is left
    is full-joined by key: only in the later snapshot is added, only in the
    earlier removed, in both changed. A root's first snapshot gives nothing.
    An empty table gives an empty result.

    A row stands for itself in its own snapshot and against itself in the
    next one, so both tables of the EXCEPT ALL come from one row by exploding,
    in the partition where it lies. There a key has at most one residue on
    either side, and the full join is a grouping: files are shuffled once,
    as long as there are no more snapshots than may be broadcast.
    """
    rows = latest_rows(snapshots)
    # One row per root and snapshot: the window never holds files.
    order = Window.partitionBy("root").orderBy("at")
    instants = snapshots.select("root", instant("generated_at").alias("at")).where("root IS NOT NULL AND at IS NOT NULL AND path IS NOT NULL")
    index = instants.distinct().select("root", "at", F.lag("at").over(order).isNotNull().alias("has_earlier"), F.lead("at").over(order).alias("next_at"))

    side = lambda at, n: F.struct(at.alias("at"), F.lit(n).alias("_n"))
    sides = F.array(F.when(F.col("has_earlier"), side(F.col("at"), 1)), F.when(F.col("next_at").isNotNull(), side(F.col("next_at"), -1)))
    signed = rows.join(broadcast_if_small(index), ["root", "at"]).select("root", "path", "hash", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x"))
    signed = signed.select("root", "path", "hash", "x.at", "x._n")
    over = lambda sign: F.max(F.when(sign * F.col("_n") > 0, F.struct("hash")))
    changes = residues(signed, ["root", "path", "at", "hash"]).groupBy("root", "path", "at").agg(over(1).alias("new"), over(-1).alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return changes.select(
        "root",
        utc_text(F.col("at")).alias("generated_at"),
        "path",
        kind.alias("change_kind"),
        F.col("old.hash").alias("old_hash"),
        F.col("new.hash").alias("new_hash"),
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """(root, generated_at, change_kind, files): how many files each delivery changed."""
    return changes.groupBy("root", "generated_at", "change_kind").agg(F.count(F.lit(1)).alias("files"))
