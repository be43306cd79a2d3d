"""Attributes as known at event time.

Each attribute has its own change history in one long table (attribute, entity,
time, value).  Every event is matched separately with the last value known of
each attribute; the matches are pivoted back into one row for each event.
Attributes may change at different times without widening any version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.operators.history import CHUNK_BITS, chunked, fold_changes, positioned
from cotejo.session import cut

SEGMENT_ROWS_BITS = 19


def value_type(rows: DataFrame, attributes: Sequence[str]) -> str:
    """Type of ``_value``: that of the attributes if they share one, else text."""
    kinds = {rows.schema[a].dataType.simpleString() for a in attributes}
    return kinds.pop() if len(kinds) == 1 else "string"


def attribute_histories(rows: DataFrame, keys: Sequence[str], time: str, attributes: Sequence[str], ident: str | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Long change histories: keys, ``_attr``, ``_t``, ``_value`` (see value_type).

    ``rows`` comes from standing().  Each attribute is folded on its own inside
    short sorted arrays; a chunk restates its first value, which changes no
    last-known match.  A null value is kept: from then on the value is null.
    ``ident`` differs in every row, so its history is the rows as they are; where
    it is the only attribute, rows needn't be standing ones.
    """
    kind = value_type(rows, attributes)
    folded = [a for a in attributes if a != ident]
    out = None
    if ident in attributes:
        out = rows.select(*keys, F.lit(list(attributes).index(ident)).alias("_attr"), F.col(time).alias("_t"), F.col(ident).cast(kind).alias("_value"))
        if not folded:
            return out
    packed = chunked(rows, keys, time, folded, chunk_bits)

    def one(k: int, a: str):
        slim = F.transform("_rows", lambda x: F.struct(x[time].alias("t"), x[a].cast(kind).alias("v")))
        t = packed.schema["_rows"].dataType.elementType[time].dataType.simpleString()
        return F.transform(fold_changes(slim, ["v"], f"array<struct<t:{t},v:{kind}>>"), lambda x: F.struct(F.lit(k).alias("k"), x["t"].alias("t"), x["v"].alias("v")))

    changes = F.concat(*(one(k, a) for k, a in enumerate(attributes) if a != ident))
    long = packed.select(*keys, F.explode(changes).alias("_c")).select(*keys, F.col("_c.k").alias("_attr"), F.col("_c.t").alias("_t"), F.col("_c.v").alias("_value"))
    return long if out is None else long.unionByName(out)


def last_known(
    histories: DataFrame, events: DataFrame, keys: Sequence[str], event_id: str, event_time: str, n_attributes: int, segment_bits: int = SEGMENT_ROWS_BITS
) -> DataFrame:
    """For each event and attribute the last value with ``_t`` not after the event.

    A range exchange on (attribute, entity, time) and windows over segments of
    a fixed number of rows keep a hot entity out of any single task; what was
    known at the end of earlier segments comes from a summary.
    Result: event_id, ``_attr``, ``_value``; events without any earlier value
    of an attribute have no row for it.
    """
    ev = events.select(*keys, F.col(event_time).alias("_t"), F.col(event_id).alias("_event")).filter(
        F.col("_t").isNotNull() & F.col("_event").isNotNull()
    )
    ev = ev.withColumn("_attr", F.explode(F.array(*(F.lit(k) for k in range(n_attributes)))))
    both = histories.select(*keys, "_attr", "_t", F.lit(0).alias("_side"), "_value", F.lit(None).cast(ev.schema["_event"].dataType).alias("_event")).unionByName(
        ev.select(*keys, "_attr", "_t", F.lit(1).alias("_side"), F.lit(None).cast(histories.schema["_value"].dataType).alias("_value"), "_event")
    )
    by = ["_attr", *keys]
    placed = cut(positioned(both, by, ["_t", "_side", "_value"]).withColumn("_seg", F.shiftright("_pos", segment_bits)).drop("_pos"), "asof")

    known = F.when(F.col("_side") == 0, F.struct("_t", "_value"))
    in_seg = Window.partitionBy(*by, "_seg").orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    d = placed.df.withColumn("_known", F.last(known, ignorenulls=True).over(in_seg))

    per = Window.partitionBy(*by)
    tails = placed.df.groupBy(*by, "_seg").agg(F.max(known).alias("_tail"))
    tails = tails.withColumn("_n", F.count(F.lit(1)).over(per)).filter("_n > 1")
    before = per.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*by, "_seg", F.last("_tail", ignorenulls=True).over(before).alias("_carried"))

    hits = d.filter("_side = 1").join(tails, [*by, "_seg"], "left")
    hits = hits.withColumn("_k", F.coalesce("_known", "_carried")).filter(F.col("_k").isNotNull())
    return hits.select(F.col("_event").alias(event_id), "_attr", F.col("_k._value").alias("_value"))


def attributes_at(
    rows: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    attributes: Sequence[str],
    event_id: str,
    event_time: str,
    ident: str | None = None,
    chunk_bits: int = CHUNK_BITS,
    segment_bits: int = SEGMENT_ROWS_BITS,
) -> DataFrame:
    """One row for each event with any attribute known at its time.

    rows: standing captures (see history.standing) with the ``attributes``; if
    only ``ident`` is asked for, any captures: the highest ident of a time counts.
    events: ``keys``, ``event_id`` (unique) and ``event_time``; events with a
    null id, key or time match nothing.  Result: event_id and each attribute in
    its own type.  Columns other than those named are
    ignored, so clashing names don't matter.
    """
    types = {a: rows.schema[a].dataType for a in attributes}
    usable = rows.dropna(subset=[*keys, time, *([ident] if ident else [])])
    long = attribute_histories(usable if list(attributes) == [ident] else rows, keys, time, attributes, ident, chunk_bits)
    hits = last_known(long, events, keys, event_id, event_time, len(attributes), segment_bits)
    cols = []
    for k, a in enumerate(attributes):
        cols.append(F.max(F.when(F.col("_attr") == k, F.col("_value"))).cast(types[a]).alias(a))
    return hits.groupBy(event_id).agg(*cols)
