"""Filling containers of fixed capacity with texts, by a configuration linear program."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.skew import global_index
from quern.session import cut


def size_classes(capacity: int, precision: float) -> np.ndarray:
    """Upper ends of the length classes 1..capacity, each at most `precision` wide.

    Short lengths are classes of their own; their number grows with
    log(capacity) / precision, not with the data.
    """
    ends, at = [], 0
    while at < capacity:
        at = min(capacity, max(at + 1, math.floor((at + 1) * (1 + precision))))
        ends.append(at)
    return np.array(ends)


def best_configuration(values: np.ndarray, lengths: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length is used in the most valuable filling of one container.

    Bounded knapsack by dynamic programming over the capacity. A kind that may
    be used m times becomes bundles of 1, 2, 4, ... of it, each used once.
    """
    best = np.zeros(capacity + 1, dtype=np.float32)
    offers = np.empty_like(best)
    values = (values / values.max()).astype(np.float32) if len(values) and values.max() > 0 else values
    bundles = []
    for kind in np.argsort(-values / lengths, kind="stable"):
        most = int(min(limits[kind], capacity // lengths[kind]))
        size = 1
        while most > 0 and values[kind] > 0:
            size = min(size, most)
            weight = int(lengths[kind]) * size
            offer = np.add(best[: capacity + 1 - weight], values[kind] * size, out=offers[: capacity + 1 - weight])
            bundles.append((kind, size, weight, offer > best[weight:]))
            np.maximum(best[weight:], offer, out=best[weight:])
            most -= size
            size *= 2
    used = np.zeros(len(lengths), dtype=np.int64)
    at = int(np.argmax(best))
    for kind, size, weight, better in reversed(bundles):
        if at >= weight and better[at - weight]:
            used[kind] += size
            at -= weight
    return used


@dataclass
class Plan:
    """Configurations of one container kind; bins of one configuration are consecutive.

    bound: no packing of the lengths as classed needs fewer containers; it is
    the best value of a dual solution met while pricing.
    """

    capacity: int
    ends: np.ndarray
    bound: float = 0.0
    configurations: list[tuple[np.ndarray, int]] = field(default_factory=list)  # (uses per class, bins)

    @property
    def bins(self) -> int:
        return sum(k for _, k in self.configurations)


def _fractional(
    counts: np.ndarray, lengths: np.ndarray, capacity: int, rate: float, slack: float, sharpness: float = 4
) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Multiplicative weights for: cover every class's count with as few containers as possible.

    A length's price starts at its size, which gives the total size as the
    first dual bound, and falls exponentially with the share of its class that
    is covered, to 0 once all of it is. A configuration is used until one
    class that still lacked cover has gained the share `rate`: each round
    takes a class that far, so the rounds are at most classes / rate whatever
    the counts. One found before serves again while it is worth, of all that
    is left, 1 - slack of what the best one was worth when last priced; else
    the knapsack prices a new one.

    Returns the configurations with their amounts and the dual bound.
    """
    share = np.zeros(len(counts))
    prices = lengths.astype(float)
    columns: list[np.ndarray] = []
    amounts: list[float] = []
    pool = np.zeros((len(counts), 64), order="C")  # a row per class: a change of its price touches one row
    values = np.zeros(64)
    efficiency, bound = 0.0, 0.0
    worth = float(prices @ counts)
    while worth > 0:
        at = int(np.argmax(values[: len(columns)])) if columns else -1
        if at < 0 or values[at] < (1 - slack) * efficiency * worth:
            uses = best_configuration(prices, lengths, counts, capacity)
            best = float(uses @ prices)
            efficiency, bound = best / worth, max(bound, worth / best)
            if at < 0 or best > values[at] * (1 + 1e-9):
                at = len(columns)
                if at == len(values):
                    pool, values = np.hstack([pool, np.zeros_like(pool)]), np.concatenate([values, np.zeros_like(values)])
                pool[:, at] = uses
                values[at] = best
                columns.append(uses)
                amounts.append(0.0)
        used = np.flatnonzero(columns[at])
        gaining = used[prices[used] > 0]
        step = float((np.minimum(rate, 1 - share[gaining]) * counts[gaining] / columns[at][gaining]).min())
        amounts[at] += step
        share[used] += step * columns[at][used] / counts[used]
        new = np.where(share[gaining] < 1 - 1e-9, lengths[gaining] * np.exp(-sharpness * share[gaining]), 0.0)
        change = new - prices[gaining]
        prices[gaining] = new
        values += change @ pool[gaining]
        worth = float(prices @ counts)
    return [(c, x) for c, x in zip(columns, amounts, strict=True)], bound


def _rounded(
    solution: list[tuple[np.ndarray, float]], rest: np.ndarray, lengths: np.ndarray, share: float
) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of containers, fullest configurations first, never more than there are items.

    Configurations filled less than `share` of the solution's average wait for
    the next solution over what is left.
    """
    filled = [int((uses * lengths).sum()) for uses, _ in solution]
    average = sum(f * x for f, (_, x) in zip(filled, solution, strict=True)) / sum(x for _, x in solution)
    placed = []
    for f, (uses, amount) in sorted(zip(filled, solution, strict=True), key=lambda x: (-x[0], -x[1][1], x[1][0].tobytes())):
        left = math.ceil(amount - 1e-9)
        # Where a class runs out, the rest of the containers go without it.
        while left > 0 and f >= share * average and uses.any():
            k = min(left, int((rest[uses > 0] // uses[uses > 0]).min()))
            if k > 0:
                rest -= k * uses
                placed.append((uses, k))
                left -= k
            uses = np.where(rest >= uses, uses, 0)
            f = int((uses * lengths).sum())
    return placed


def _best_fit(rest: np.ndarray, lengths: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """What rounding leaves over: longest first into the fullest containers that have room.

    Equal containers are one entry with their number, and a class goes in with
    as many of its items as fit: the work depends on the classes, not on the
    items.
    """
    groups: list[list] = []  # [free space, uses, how many containers]
    for kind in range(len(lengths) - 1, -1, -1):
        left, length = int(rest[kind]), int(lengths[kind])
        for group in sorted((g for g in groups if g[0] >= length), key=lambda g: (g[0], g[1].tobytes())):
            if not left:
                break
            each = min(group[0] // length, left)
            many = min(group[2], left // each)
            if many < group[2]:
                groups.append([group[0], group[1].copy(), group[2] - many])
            group[0], group[2] = group[0] - each * length, many
            group[1][kind] += each
            left -= each * many
        each = capacity // length
        for size, many in ((each, left // each), (left % each, 1)):
            if size and many:
                uses = np.zeros(len(lengths), dtype=np.int64)
                uses[kind] = size
                groups.append([capacity - size * length, uses, many])
    same = Counter()
    for _, uses, many in groups:
        same[uses.tobytes()] += many
    return [(np.frombuffer(u, dtype=np.int64), k) for u, k in sorted(same.items())]


def plan_containers(
    histogram: dict[int, int], capacity: int, precision: float = 0.01, rate: float = 0.03, slack: float = 0.01
) -> Plan:
    """Configurations and how many containers of each, for counts by length (1..capacity).

    Lengths are classed; a class counts as its longest length that occurs. The
    linear program is solved by multiplicative weights and rounded; its
    remainder is solved and rounded again, first by the fuller configurations
    alone, then by all, while that places at least a tenth of it. Rounding
    leaves less than one container per configuration, which best fit places
    class by class. Deterministic. The work depends on the classes and the
    capacity, and on the number of items by its logarithm at most.
    """
    grid = size_classes(capacity, precision)
    longest: dict[int, int] = {}
    for length in histogram:
        kind = int(np.searchsorted(grid, length))
        longest[kind] = max(longest.get(kind, 0), length)
    ends = np.array([longest[k] for k in sorted(longest)], dtype=np.int64)
    counts = np.zeros(len(ends), dtype=np.int64)
    for length, n in histogram.items():
        counts[int(np.searchsorted(ends, length))] += n
    plan = Plan(capacity, ends)
    rest = counts.copy()
    share = 0.99
    while rest.sum():
        live = np.flatnonzero(rest)
        before = int((rest * ends).sum())
        if before < 8 * capacity:
            plan.configurations += _best_fit(rest, ends, capacity)
            break
        sub = rest[live].copy()
        solution, bound = _fractional(sub, ends[live], capacity, rate, slack)
        plan.bound = plan.bound or bound
        for level in (share, 0.0):
            for uses, k in _rounded(solution, sub, ends[live], level):
                full = np.zeros(len(ends), dtype=np.int64)
                full[live] = uses
                plan.configurations.append((full, k))
            if int((sub * ends[live]).sum()) <= 0.9 * before:
                break
        rest[live] = sub
        if int((rest * ends).sum()) > 0.9 * before:
            plan.configurations += _best_fit(rest, ends, capacity)
            break
    return plan


def _places(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: where the ranges of its ranks start, and the first bin, bins and first slot of each."""
    rows: dict[int, list] = {}
    reached, base = Counter(), 0
    for uses, k in plan.configurations:
        slot = 0
        for kind in np.flatnonzero(uses)[::-1]:
            rows.setdefault(int(kind), []).append((reached[kind], base, k, slot))
            reached[kind] += int(uses[kind]) * k
            slot += int(uses[kind])
        base += k
    return {kind: tuple(np.array(c) for c in zip(*r, strict=True)) for kind, r in rows.items()}


def _plans(items: DataFrame, capacities: list[int], precision: float) -> dict[int, dict]:
    """The plan of each place in capacities for items (place, n_tokens), found by one task per capacity.

    A task gets a histogram, at most one number per length up to its capacity,
    and gives back where the ranks of each class go: a number per class and
    configuration.
    """

    def run(batches):
        for batch in batches:
            for place, lengths in zip(batch.column("place").to_pylist(), batch.column("lengths").to_pylist(), strict=True):
                plan = plan_containers({x["n_tokens"]: x["n"] for x in lengths}, capacities[place], precision)
                counts = np.zeros(len(plan.ends), dtype=np.int64)
                for x in lengths:
                    counts[int(np.searchsorted(plan.ends, x["n_tokens"]))] += x["n"]
                out = {"ends": plan.ends, "counts": counts, "bins": plan.bins, "bound": plan.bound, "places": _places(plan)}
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([pickle.dumps(out)], pa.binary())], ["place", "plan"])

    histogram = items.groupBy("place", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    gathered = histogram.groupBy("place").agg(F.collect_list(F.struct("n_tokens", "n")).alias("lengths"))
    rows = gathered.repartition(len(capacities), "place").mapInArrow(run, "place int, plan binary").collect()
    empty = {"ends": np.array([], dtype=np.int64), "counts": [], "bins": 0, "bound": 0.0, "places": {}}
    return {p: empty for p in range(len(capacities))} | {r["place"]: pickle.loads(bytes(r["plan"])) for r in rows}


def pack(
    sizes: DataFrame, containers: list[tuple[str, int]], precision: float = 0.01
) -> DataFrame:
    """Container and position of every text, for each kind of container.

    sizes: (doc_id, n_tokens), doc_id unique. containers: (kind, capacity in
    tokens), a few. Result: container_kind, container_id, position (from 0
    within the container), doc_id, piece, doc_start (the piece's first token
    within its text), n_tokens, container_start (its first token within the
    container).

    Only a text larger than the capacity is cut: into full pieces, each a
    container of its own, and a remainder packed like a text. The lengths'
    histogram, at most one number per length up to the capacity, goes to the
    driver, where the configurations are found; texts then take places by
    their rank among those of their class, which a range-partitioned running
    count gives without gathering a class anywhere. A text without tokens
    needs no space: its container, position and start are null. Empty input
    gives no rows; no container kinds neither; a kind without name or capacity
    is none. Repeated rows are items of their own.
    """
    containers = [(kind, capacity) for kind, capacity in containers if kind is not None and capacity is not None]
    if not containers:
        return sizes.sparkSession.createDataFrame([], RESULT)
    if any(c <= 0 for _, c in containers):
        raise ValueError("capacities must be positive")
    sizes = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")))
    kinds = sorted(containers)
    remainders = [
        sizes.select(
            F.lit(place).alias("place"),
            "doc_id",
            F.expr(f"CAST(n_tokens DIV {capacity} AS INT)").alias("piece"),
            (F.col("n_tokens") % capacity).alias("n_tokens"),
        ).where("n_tokens > 0")
        for place, (_, capacity) in enumerate(kinds)
    ]
    every = reduce(DataFrame.unionByName, remainders)
    plans = _plans(every, [c for _, c in kinds], precision)
    starts, first = {}, 0
    for place in range(len(kinds)):
        for k, n in enumerate(plans[place]["counts"]):
            starts[place, k] = first
            first += int(n)
    # Classes are ranges of lengths: sorted by length, their ranks follow each other.
    items = global_index(every, ["place", "n_tokens", "doc_id"], None, "index")
    places = {p: plan["places"] for p, plan in plans.items()}
    ends = {p: plan["ends"] for p, plan in plans.items()}

    def assign(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            length, index = batch.column("n_tokens").to_numpy(), batch.column("index").to_numpy()
            kind = np.zeros(len(place), np.int64)
            for p in set(place.tolist()):
                kind[place == p] = np.searchsorted(ends[p], length[place == p])
            bins, slots = np.zeros(len(place), np.int64), np.zeros(len(place), np.int32)
            for p, k in set(zip(place.tolist(), kind.tolist(), strict=True)):
                own = np.flatnonzero((place == p) & (kind == k))
                from_rank, base, many, slot = places[p][k]
                rank = index[own] - starts[p, k]
                at = np.searchsorted(from_rank, rank, side="right") - 1
                offset = rank - from_rank[at]
                bins[own] = base[at] + offset % many[at]
                slots[own] = slot[at] + offset // many[at]
            columns = [batch.column(c) for c in ("place", "doc_id", "piece", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bins), pa.array(slots)], ["place", "doc_id", "piece", "n_tokens", "container_id", "slot"]
            )

    doc_type = sizes.schema["doc_id"].dataType.simpleString()
    placed = items.mapInArrow(assign, f"place int, doc_id {doc_type}, piece int, n_tokens long, container_id long, slot int")
    # A container holds at most its capacity in tokens, so these windows are bounded.
    inside = Window.partitionBy("place", "container_id").orderBy("slot")
    placed = placed.select(
        "place",
        "container_id",
        (F.row_number().over(inside) - 1).alias("position"),
        "doc_id",
        "piece",
        "n_tokens",
        (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("container_start"),
    )
    parts = []
    for place, (kind, capacity) in enumerate(kinds):
        own = placed.where(F.col("place") == place).withColumn("doc_start", F.col("piece").cast("long") * capacity)
        large = global_index(sizes.where(F.col("n_tokens") >= capacity), ["doc_id"], F.expr(f"n_tokens DIV {capacity}"), "before")
        large = large.select(
            "doc_id", "before", F.explode(F.expr(f"sequence(0, CAST(n_tokens DIV {capacity} AS INT) - 1)")).alias("piece")
        ).select(
            (F.lit(plans[place]["bins"]) + F.col("before") + F.col("piece")).alias("container_id"),
            F.lit(0).alias("position"),
            "doc_id",
            "piece",
            F.lit(capacity).cast("long").alias("n_tokens"),
            F.lit(0).cast("long").alias("container_start"),
            (F.col("piece").cast("long") * capacity).alias("doc_start"),
        )
        none = sizes.where("n_tokens = 0").select(
            F.lit(None).cast("long").alias("container_id"),
            F.lit(None).cast("int").alias("position"),
            "doc_id",
            F.lit(0).alias("piece"),
            F.lit(0).cast("long").alias("n_tokens"),
            F.lit(None).cast("long").alias("container_start"),
            F.lit(0).cast("long").alias("doc_start"),
        )
        parts.append(own.drop("place").unionByName(large).unionByName(none).withColumn("container_kind", F.lit(kind)))
    columns = ["container_kind", "container_id", "position", "doc_id", "piece", "doc_start", "n_tokens", "container_start"]
    return reduce(DataFrame.unionByName, parts).select(columns)


RESULT = (
    "container_kind string, container_id long, position int, doc_id long, piece int, doc_start long, "
    "n_tokens long, container_start long"
)


def usage(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, n_containers, n_tokens, least_containers, unused_share) of a packing.

    least_containers is the total size over the capacity, which no packing can
    go below.
    """
    sums = packed.where("container_id IS NOT NULL").groupBy("container_kind").agg(
        F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    )
    capacity = F.broadcast(containers.select("container_kind", "capacity_tokens"))  # a few kinds
    return sums.join(capacity, "container_kind").select(
        "container_kind",
        "n_containers",
        "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"),
    )
