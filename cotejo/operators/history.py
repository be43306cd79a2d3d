"""Change history of entity attributes (slowly changing versions).

Captures of one entity are put in order, packed into short sorted struct arrays
and folded by a higher-order function that appends a version only when the
state differs from the last one.  No array or window ever holds a whole entity:

* a range exchange on (entity, time) spreads a hot entity over many tasks;
* positions inside that order give chunks (the folded arrays) and segments
  (the windows), both of a fixed number of captures;
* versions that continue across a segment border are joined through a summary
  that has one row for each entity and segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.session import Cut, cut

#: captures in one folded array, and chunks in one window, as powers of two
CHUNK_BITS = 8
SEGMENT_BITS = 11


def positioned(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition and sort ``df`` by keys and order and add ``_pos``, which rises along that order."""
    by = [*keys, *order]
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id())


def standing(df: DataFrame, keys: Sequence[str], time: str, ident: str, values: Sequence[str]) -> DataFrame:
    """Of several rows with the same keys and time keep the one with the highest ``ident``.

    Rows with a null key, time or ident can't be placed and are left out.  The
    result is range-partitioned by (keys, time): the aggregation needs no
    exchange of its own, and positioned() can follow without another one.
    """
    by = [*keys, time]
    ok = df.select(*by, ident, *values)
    for c in (*by, ident):
        ok = ok.filter(F.col(c).isNotNull())
    return (
        ok.repartitionByRange(*by)
        .groupBy(*by)
        .agg(F.max(F.struct(ident, *values)).alias("_s"))
        .select(*by, *(F.col("_s")[c].alias(c) for c in (ident, *values)))
    )


def chunked(df: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str], chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Sorted struct arrays of at most ``2**chunk_bits`` rows: keys, ``_chunk``, ``_rows``.

    ``df`` must be range-partitioned by (keys, time), as standing() leaves it.
    ``_chunk`` rises with time inside an entity.
    """
    pos = df.sortWithinPartitions(*keys, time).withColumn("_pos", F.monotonically_increasing_id())
    return (
        pos.withColumn("_chunk", F.shiftright("_pos", chunk_bits))
        .groupBy(*keys, "_chunk")
        .agg(F.array_sort(F.collect_list(F.struct(time, *fields))).alias("_rows"))
    )


def fold_changes(rows, state: Sequence[str], dtype: str):
    """Fold a sorted struct array into the array of its changes of ``state``."""

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        same = F.lit(True)
        for s in state:
            same = same & last[s].eqNullSafe(x[s])
        return F.when((F.size(acc) > 0) & same, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(rows, F.array().cast(dtype), step)


def change_history(
    captures: DataFrame,
    keys: Sequence[str],
    time: str,
    ident: str,
    state: Sequence[str],
    chunk_bits: int = CHUNK_BITS,
    segment_bits: int = SEGMENT_BITS,
) -> DataFrame:
    """All versions of every entity.

    captures: rows with ``keys``, ``time``, ``ident`` and the ``state`` columns;
    further columns are ignored.  Result: keys, ``valid_from``, ``valid_to``
    (null: still valid), ``first_id``, ``next_id`` (null: none) and the state.

    Nulls: a null state value is a value like any other; rows with a null key,
    time or ident are left out.  Repeated rows and ties on time leave the row
    with the highest ident.  An empty table gives an empty history.
    """
    rows = standing(captures, keys, time, ident, state)
    packed = chunked(rows, keys, time, [ident, *state], chunk_bits)
    dtype = packed.schema["_rows"].dataType.simpleString()
    # Written: the range exchange samples its input, so positions must not be computed twice.
    folded: Cut = cut(
        packed.select(*keys, "_chunk", F.shiftright("_chunk", segment_bits).alias("_seg"), fold_changes(F.col("_rows"), state, dtype).alias("_v")),
        "versions",
    )

    state_of = lambda x: F.struct(*(x[s].alias(s) for s in state))
    in_seg = Window.partitionBy(*keys, "_seg")
    d = folded.df.withColumn("_prev", F.lag(state_of(F.get("_v", F.size("_v") - 1))).over(in_seg.orderBy("_chunk")))
    d = d.select(*keys, "_seg", "_prev", F.posexplode("_v").alias("_i", "_x")).filter(
        (F.col("_i") > 0) | F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(state_of(F.col("_x")))
    )
    start = F.struct(F.col("_x")[time].alias("t"), F.col("_x")[ident].alias("id"))
    d = d.select(*keys, "_seg", start.alias("_start"), state_of(F.col("_x")).alias("_state"))
    d = d.withColumn("_next", F.lead("_start").over(in_seg.orderBy("_start")))

    # One row for each entity and segment; only entities with several segments go on.
    per = Window.partitionBy(*keys)
    ends = d.groupBy(*keys, "_seg").agg(
        F.min(F.struct("_start", "_state", "_next")).alias("_f"), F.max(F.struct("_start", "_state")).alias("_l")
    )
    ends = ends.withColumn("_n", F.count(F.lit(1)).over(per)).filter("_n > 1")
    order = per.orderBy("_seg")
    ends = ends.withColumn("_before", F.lag("_l._state").over(order))
    ends = ends.withColumn("_joins", F.col("_before").isNotNull() & F.col("_before").eqNullSafe(F.col("_f._state")))
    ends = ends.withColumn("_own", F.when(F.col("_joins"), F.col("_f._next")).otherwise(F.col("_f._start")))
    ends = ends.withColumn("_later", F.first("_own", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    ends = ends.select(*keys, "_seg", "_joins", "_later", F.col("_f._start").alias("_seg_start"))

    v = d.join(ends, [*keys, "_seg"], "left")
    v = v.filter(~(F.coalesce("_joins", F.lit(False)) & (F.col("_start") == F.col("_seg_start"))))
    end = F.coalesce("_next", "_later")
    return v.select(
        *keys,
        F.col("_start.t").alias("valid_from"),
        end["t"].alias("valid_to"),
        F.col("_start.id").alias("first_id"),
        end["id"].alias("next_id"),
        *(F.col("_state")[s].alias(s) for s in state),
    )
