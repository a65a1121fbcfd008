"""Documents packed into containers of several fixed capacities, with little room left.

Variable-capacity best-fit, largest first: an item goes into the open container with the least room
that holds it; where none does, a new one is opened at the capacity that costs least for each token it
will hold.  The group is also packed with each capacity preferred throughout, and the cheapest result is
kept.  At the end every container is
downsized to the smallest capacity that holds its contents.  The cost of a container is its capacity
plus ``open_cost``.

Items are spread over groups of about ``GROUP`` items by a hash, so groups are alike and bounded and
each is packed by one task; at most a few containers of a group are not full.  Only items longer than
the largest capacity are cut, into full containers and a rest.

Defined results: documents without tokens are in no container (null); without any capacity there is
nothing to pack into and all containers are null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 20_000
PACKED = "doc_id long, piece int, n_tokens long, container_id string, capacity_tokens int, position int"


def least_cost(size: int, rest: int, capacities: Sequence[int], open_cost: float) -> int:
    """The capacity that costs least for each token it will hold, if what is left of the items fills it."""
    return min((c for c in capacities if c >= size), key=lambda c: ((c + open_cost) / min(c, size + rest), c))


def best_fit(sizes: Sequence[int], capacities: Sequence[int], rule: int | None, open_cost: float = 1.0) -> tuple[list[int], list[int]]:
    """(container of each item, contents of each container) of items in decreasing order.  Without a rule, each
    container is opened at the least-cost capacity; rule k opens the k-th smallest capacity that holds the
    item, or the largest."""
    rest = sum(sizes)
    room_of: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: there is a container with r tokens of room
    where, used = [], []
    cap_of: list[int] = []
    for s in sizes:
        rest -= s
        fit = open_rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            k = room_of[room].pop()
            if not room_of[room]:
                open_rooms &= ~(1 << room)
        else:
            holds = [c for c in capacities if c >= s]
            room = least_cost(s, rest, capacities, open_cost) if rule is None else holds[min(rule, len(holds) - 1)]
            k = len(used)
            used.append(0)
            cap_of.append(room)
        used[k] += s
        left = room - s
        if left:
            room_of.setdefault(left, []).append(k)
            open_rooms |= 1 << left
        where.append(k)
    return where, used


def pack_group(items: pd.DataFrame, capacities: Sequence[int], open_cost: float) -> pd.DataFrame:
    items = items.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
    best = None
    for rule in (None, *range(len(capacities))):
        where, used = best_fit(items["n_tokens"].tolist(), capacities, rule, open_cost)
        final = [min(c for c in capacities if c >= u) for u in used]
        cost = sum(final) + open_cost * len(final)
        if best is None or cost < best[0]:
            best = (cost, where, final)
    _, where, final = best
    group = int(items["group"].iloc[0])
    out = items[["doc_id", "piece", "n_tokens"]].copy()
    out["container_id"] = [f"{group:06d}-{k:06d}" for k in where]
    out["capacity_tokens"] = [final[k] for k in where]
    out["position"] = out.groupby("container_id", sort=False).cumcount()
    return out


def pack(counted: DataFrame, capacities: Sequence[int], group: int = GROUP, open_cost: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens) -> (doc_id, piece, n_tokens, container_id, capacity_tokens, position); pieces
    count from 0.  ``counted`` is read twice: pass a written table."""
    capacities = sorted({int(c) for c in capacities if c and c > 0})
    if not capacities:
        return counted.select("doc_id", F.lit(0).alias("piece"), "n_tokens", F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("int").alias("capacity_tokens"), F.lit(None).cast("int").alias("position"))
    most = capacities[-1]
    pieces = counted.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / most).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most).alias("n_tokens"))
    n_groups = max(1, math.ceil(pieces.count() / group))
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_groups)))
    packed = grouped.groupBy("group").applyInPandas(lambda g: pack_group(g, capacities, open_cost), PACKED)
    rest = counted.where("n_tokens <= 0").selectExpr("doc_id", "0 as piece", "n_tokens", "cast(null as string) as container_id", "cast(null as int) as capacity_tokens", "cast(null as int) as position")
    return packed.unionByName(rest)


def fill(packed: DataFrame) -> DataFrame:
    """(capacity_tokens, n_containers, n_pieces, n_tokens, room_left, fill) per capacity."""
    boxes = packed.where("container_id is not null").groupBy("container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    return boxes.groupBy("capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("pieces").alias("n_pieces"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.col("capacity_tokens") - F.col("n")).alias("room_left"),
        F.round(F.sum("n") / F.sum("capacity_tokens"), 6).alias("fill"),
    )
