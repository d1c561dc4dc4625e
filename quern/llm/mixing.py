"""Mixing sources to target shares by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.cleaning import as_col, lower_trimmed


def clean_source(c: Column | str) -> Column:
    """A source's name: trimmed, lower case, blanks and hyphens as one underscore; null where blank."""
    return F.regexp_replace(lower_trimmed(as_col(c)), r"[\s\-]+", "_")


#: The draws are summed up in so many bins per source to set the Poisson means.
DRAW_BINS = 4096


def thresholds(mean: float, most: int) -> np.ndarray:
    """Values of the Poisson distribution function at 0..most-1.

    A draw u in [0, 1) gives as many repeats as the thresholds it reaches: the
    inverse of the distribution, cut off at `most`.
    """
    if mean == math.inf:
        return np.zeros(most)
    terms = np.exp(-mean + np.arange(most) * math.log(mean) - [math.lgamma(k + 1) for k in range(most)]) if mean else np.eye(1, most)[0]
    return np.minimum(np.cumsum(terms), 1.0)


def calibrated_mean(tokens: np.ndarray, rate: float, most: int) -> float:
    """The Poisson mean at which the texts, with their draws, come to `rate` times their size.

    tokens: size of the texts by draw, in equal bins over [0, 1). With many
    texts this is the mean of a cut-off Poisson number with expectation
    `rate`; with few it also makes up for the chance in their draws.
    """
    goal = rate * tokens.sum()
    if rate >= most:
        return math.inf
    if goal <= 0:
        return 0.0
    middle = (np.arange(len(tokens)) + 0.5) / len(tokens)
    used = lambda mean: float((tokens * np.searchsorted(thresholds(mean, most), middle, side="right")).sum())
    low, high = 0.0, 1.0
    while used(high) < goal and high < 600:
        high *= 2
    for _ in range(60):
        mean = (low + high) / 2
        low, high = (mean, high) if used(mean) < goal else (low, mean)
    return low if abs(used(low) - goal) < abs(used(high) - goal) else high


def rates(sizes: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict[str, float], float]:
    """Mean repeats of each source, and the total size they are meant for.

    sizes: tokens per source; targets: (share, most repeats) per source. Without
    a total the mix is as large as it can be with every source that has text
    at its share. A source too small for its share of a given total is used as
    often as allowed and stays below.
    """
    live = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    if total is None:
        total = min((most * sizes[s] / share for s, (share, most) in live.items()), default=0.0)
    return {s: min(float(most), share * total / sizes[s]) for s, (share, most) in live.items()}, total


def repeats(sized: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): how often each text is used in the mix.

    sized: (doc_id, source, n_tokens). targets: (source, target_share,
    max_repeats), one row per source and as few as there are sources; they and
    the tokens per source and draw, DRAW_BINS numbers each, go to the driver. A source's texts each get a
    Poisson number with the source's mean rate, by inverting the distribution
    at a hash of (seed, doc_id), never more than max_repeats; the mean is set
    so that the cut-off numbers come to the wanted size. Same seed, same result,
    whatever the partitions.

    Texts with a null or unlisted source, and those without tokens, get 0.
    Repeated targets for one source add up. Empty inputs give no repeats.
    """
    rows = sized.select("doc_id", clean_source("source").alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(clean_source("source").alias("s"), "target_share", "max_repeats").collect():
        share, most = wanted.get(r["s"], (0.0, 0))
        wanted[r["s"]] = (share + (r["target_share"] or 0.0), max(most, r["max_repeats"] or 0))
    wanted.pop(None, None)
    # 52 bits of a 64-bit hash: a number in [0, 1).
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 12) / F.lit(float(2**52))
    listed = rows.where(F.col("source").isin(list(wanted)))
    bins = listed.groupBy("source", F.floor(draw * DRAW_BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n"))
    drawn = {s: np.zeros(DRAW_BINS) for s in wanted}
    for r in bins.collect():  # at most DRAW_BINS rows per listed source
        drawn[r["source"]][r["bin"]] = r["n"]
    rate, _ = rates({s: float(d.sum()) for s, d in drawn.items()}, wanted, total)

    count = F.lit(0)
    for source, r in sorted(rate.items()):
        most = wanted[source][1]
        steps = [F.when(draw >= F.lit(float(t)), 1).otherwise(0) for t in thresholds(calibrated_mean(drawn[source], r, most), most)]
        count = F.when((F.col("source") == source) & (F.col("n_tokens") > 0), sum(steps[1:], steps[0])).otherwise(count)
    return rows.withColumn("repeats", count.cast("int"))


def replicated(repeated: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, copy, source, n_tokens, place): every use of every text, in a global random order.

    place is a 64-bit hash of (seed, doc_id, copy): the order of the mix. Rows
    are range-partitioned and sorted by it, so a written mix is shuffled
    through and its files are alike. No source is gathered anywhere.
    """
    used = repeated.where("repeats > 0").select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"), "source", "n_tokens"
    )
    used = used.withColumn("place", F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "copy"))
    return used.repartitionByRange("place").sortWithinPartitions("place", "doc_id", "copy")


def shares(repeated: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_texts, n_tokens, used_tokens, reached_share) per listed source.

    A source without texts reaches 0; an empty mix has null shares.
    """
    sums = repeated.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"),
    )
    all_used = sums.agg(F.sum("used_tokens")).first()[0]
    wanted = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return wanted.join(sums, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        zero("n_texts").alias("n_texts"),
        zero("n_tokens").alias("n_tokens"),
        zero("used_tokens").alias("used_tokens"),
        (zero("used_tokens") / F.lit(all_used or None).cast("double")).alias("reached_share"),
    )
