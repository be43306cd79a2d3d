"""Filling fixed-capacity containers with items, mixture-controlled.

Items are spread by hash over packing partitions of bounded size.  In each one
a deficit round-robin over the source queues fills every window of containers
to the target token proportions; what a source got too little of is carried
into the next window and, through prefix sums of the partitions' token totals,
into the next partition.  Inside a window items go, largest first, into the
open container that they fill best; open containers stay open for later windows.

An item larger than the capacity is cut into full containers and a remainder;
no other item is ever split.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.session import cut

#: items in one packing partition, on average
PARTITION_ITEMS = 20_000
#: containers that one window of the round-robin fills
WINDOW_CONTAINERS = 64

PACKED = "capacity_id int, container_id string, item_id long, piece int, start_token long, tokens long, source string, window_id string"


def _fill(sizes: list[int], capacity: int, open_bins: list[tuple[int, int]], n_bins: int) -> tuple[list[int], int]:
    """Best fit for items in descending order; open_bins is sorted (space, bin). Returns each item's bin and the number of bins."""
    where = []
    for s in sizes:
        i = bisect_left(open_bins, (s, -1))
        if i < len(open_bins):
            space, b = open_bins.pop(i)
        else:
            space, b = capacity, n_bins
            n_bins += 1
        where.append(b)
        if space > s:
            insort(open_bins, (space - s, b))
    return where, n_bins


def pack_queues(queues: dict[str, list[tuple[int, int]]], shares: dict[str, float], deficits: dict[str, float], capacity: int, window: int) -> Iterator[tuple[int, str, int, int]]:
    """Deficit round-robin over queues of (item index, size); yields (container, source, item index, window).

    Every queue is drained.  A window takes from each source what its share of
    the window and its deficit allow; a source that has run dry passes its part
    on to the others in proportion.
    """
    at = dict.fromkeys(queues, 0)
    owed = {s: deficits.get(s, 0.0) for s in queues}
    open_bins: list[tuple[int, int]] = []
    n_bins = turn = 0
    while live := [s for s in queues if at[s] < len(queues[s])]:
        weight = sum(shares.get(s, 0.0) for s in live)
        taken: list[tuple[int, str, int]] = []
        for s in live:
            part = shares.get(s, 0.0) / weight if weight > 0 else 1 / len(live)
            owed[s] += part * capacity * window
            q, i = queues[s], at[s]
            while i < len(q) and q[i][1] <= owed[s] + q[i][1] / 2:  # to the nearer side of the target
                owed[s] -= q[i][1]
                taken.append((q[i][1], s, q[i][0]))
                i += 1
            at[s] = i
        if not taken:  # all deficits are negative after a carried surplus: raise them together
            continue
        taken.sort(key=lambda t: (-t[0], t[1], t[2]))
        where, n_bins = _fill([t[0] for t in taken], capacity, open_bins, n_bins)
        for b, (_, s, i) in zip(where, taken, strict=True):
            yield b, s, i, turn
        turn += 1


def pack(sizes: DataFrame, capacities: DataFrame, shares: DataFrame | None = None, partition_items: int = PARTITION_ITEMS, window: int = WINDOW_CONTAINERS) -> DataFrame:
    """Every item in containers of every capacity.

    sizes: ``doc_id``, ``source``, ``tokens``.  capacities: ``capacity_id``,
    ``capacity_tokens`` (a handful of rows; those without a positive capacity
    are skipped).  shares: ``source``, ``share``; by default the sources' own
    shares of all tokens, with which all queues run dry together.
    Items without tokens (null or empty texts) need no container and are left
    out; a null source is a source of its own; repeated rows are packed as
    often as they occur; an empty table gives no container.
    """
    base = cut(sizes.filter("tokens > 0").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "tokens").withColumn("_row", F.monotonically_increasing_id()), "sizes").df  # written, so that row numbers stay
    if shares is None:
        own = base.groupBy("source").agg(F.sum("tokens").alias("_t"))
        shares = own.crossJoin(own.agg(F.sum("_t").alias("_all"))).select("source", (F.col("_t") / F.col("_all")).alias("share"))
    n_parts = max(1, -(-base.count() // partition_items))

    caps = capacities.filter("capacity_tokens > 0").select("capacity_id", F.col("capacity_tokens").cast("long").alias("cap"))
    each = F.array(*(F.struct(F.lit(int(r["capacity_id"])).alias("capacity_id"), F.lit(int(r["cap"])).cast("long").alias("cap")) for r in caps.collect())) if not caps.isEmpty() else None
    if each is None:
        return base.sparkSession.createDataFrame([], PACKED)
    items = base.withColumn("_c", F.explode(each)).select("doc_id", "source", "tokens", "_row", F.col("_c.capacity_id").alias("capacity_id"), F.col("_c.cap").alias("cap"))
    over = F.col("tokens") > F.col("cap")
    full = F.when(over, F.floor(F.col("tokens") / F.col("cap"))).otherwise(F.lit(0)).cast("int")
    items = items.withColumn("full", full).withColumn("rest", F.col("tokens") - F.col("full") * F.col("cap"))

    whole = items.filter("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    whole = whole.select(
        "capacity_id",
        F.concat(F.lit("f"), F.col("_row").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container_id"),
        F.col("doc_id").cast("long").alias("item_id"), "piece", (F.col("piece") * F.col("cap")).cast("long").alias("start_token"), F.col("cap").alias("tokens"), "source", F.lit("").alias("window_id"),
    )

    part = F.pmod(F.xxhash64("doc_id", "_row"), F.lit(n_parts)).cast("int")
    rest = items.filter("rest > 0").select("capacity_id", "cap", part.alias("part"), "source", F.col("doc_id").cast("long").alias("doc_id"), "full", "rest")
    # one row for each capacity, partition and source: what each source is owed when a partition begins
    totals = rest.groupBy("capacity_id", "part", "source").agg(F.sum("rest").alias("t"))
    grid = totals.select("capacity_id", "part").distinct().join(rest.select("capacity_id", "source").distinct(), "capacity_id")
    totals = grid.join(totals, ["capacity_id", "part", "source"], "left").join(shares, "source", "left").fillna(0, ["t", "share"])
    before = Window.partitionBy("capacity_id", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_own", F.coalesce(F.sum("t").over(before), F.lit(0)))
    totals = totals.withColumn("_all", F.sum("_own").over(Window.partitionBy("capacity_id", "part")))
    owed = totals.select("capacity_id", "part", "source", "share", (F.col("share") * F.col("_all") - F.col("_own")).alias("deficit"))
    rest = rest.join(owed, ["capacity_id", "part", "source"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cap_id, p = key
        pdf = pdf.sort_values(["source", "doc_id", "rest"], kind="stable").sample(frac=1, random_state=int(p) + 1).reset_index(drop=True)
        cap = int(pdf["cap"].iloc[0])
        size = pdf["rest"].tolist()
        queues: dict[str, list[tuple[int, int]]] = {}
        for i, s in enumerate(pdf["source"].tolist()):
            queues.setdefault(s, []).append((i, size[i]))
        first = pdf.drop_duplicates("source").set_index("source")
        bins, order, turns = [], [], []
        for b, _, i, t in pack_queues(dict(sorted(queues.items())), first["share"].to_dict(), first["deficit"].to_dict(), cap, window):
            bins.append(f"{p}-{b}")
            order.append(i)
            turns.append(f"{p}-{t}")
        d = pdf.iloc[order]
        return pd.DataFrame({
            "capacity_id": cap_id, "container_id": bins, "item_id": d["doc_id"].astype("Int64").values, "piece": d["full"].values, "start_token": (d["full"] * cap).values, "tokens": d["rest"].values,
            "source": d["source"].values, "window_id": turns,
        })

    return whole.unionByName(rest.groupBy("capacity_id", "part").applyInPandas(run, PACKED))


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens and the share of unused space for each capacity."""
    per = packed.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    d = per.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("n").alias("pieces"))
    d = d.join(capacities.select("capacity_id", "capacity_tokens"), "capacity_id")
    return d.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def window_shares(packed: DataFrame, capacities: DataFrame, shares: DataFrame | None = None, window: int = WINDOW_CONTAINERS) -> DataFrame:
    """How far windows keep to the target proportions: for each capacity and source its target share, its share of all windows' tokens, and mean and greatest distance of a window's share.

    Windows filled to less than nine tenths are counted in ``windows`` but not in
    the distances.  The greatest distances come from the last windows of a
    partition, where a source has run out and the others take its part.
    """
    d = packed.filter("window_id <> ''").groupBy("capacity_id", "window_id", "source").agg(F.sum("tokens").alias("t"))
    if shares is None:
        own = packed.groupBy("capacity_id", "source").agg(F.sum(F.when(F.col("window_id") != "", F.col("tokens")).otherwise(0)).alias("_t"))
        shares = own.join(own.groupBy("capacity_id").agg(F.sum("_t").alias("_a")), "capacity_id").select("capacity_id", "source", (F.col("_t") / F.col("_a")).alias("share"))
    per = d.groupBy("capacity_id", "window_id").agg(F.sum("t").alias("all")).join(capacities.select("capacity_id", "capacity_tokens"), "capacity_id")
    full = per.withColumn("full", F.col("all") >= F.lit(0.9 * window) * F.col("capacity_tokens"))
    grid = full.join(shares, "capacity_id").join(d, ["capacity_id", "window_id", "source"], "left")
    off = F.when(F.col("full"), F.abs(F.coalesce("t", F.lit(0)) / F.col("all") - F.col("share")))
    return grid.groupBy("capacity_id", "source").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.max("share"), 6).alias("target_share"), F.round(F.sum(F.coalesce("t", F.lit(0))) / F.sum("all"), 6).alias("share"),
        F.round(F.avg(off), 6).alias("mean_distance"), F.round(F.max(off), 6).alias("greatest_distance"),
    )
