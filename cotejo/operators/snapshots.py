"""What changed between consecutive full snapshots.

Keys are hashed into ranges, and each range into leaves of one or two rows: the
lower levels of a digest tree.  Row digests are computed and written once.  Two
consecutive snapshots are compared from the root down: nodes above the ranges
level by level, then the leaves of differing ranges, and only the rows of
differing leaves are compared with each other.  One exchange by range brings all
snapshots of a range together; leaves and rows are compared where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.session import cut

#: children of a tree node, as a power of two
FAN_BITS = 4
#: rows that a leaf and a range hold at most on average in the largest snapshot
LEAF_ROWS, RANGE_ROWS = 2, 512


def canonical_product_url(url: Column) -> Column:
    """Scheme and host in lower case; query, fragment and trailing slashes gone."""
    bare = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))), r"/+$", "")


def _digest(cols: Sequence[str], seed: int) -> Column:
    # null is a value of its own: the null flags are hashed too
    return F.xxhash64(F.lit(seed), *(x for c in cols for x in (F.col(c).isNull(), F.col(c))))


def _bits(rows: int, per: int) -> int:
    """Bits of a hash that give nodes of at most ``per`` of ``rows`` rows on average."""
    return min(48, max(0, (max(rows, 1) - 1) // max(per, 1)).bit_length())


def _open_ranges(ranges: DataFrame, pairs: DataFrame, range_bits: int, fan_bits: int) -> DataFrame:
    """``_g``, ``_p``, ``_open`` (array of snapshot numbers): ranges that differ from the snapshot before, found from the root down.

    ranges: ``_g``, ``_i`` (number of the snapshot), ``_p`` and digest ``_d``.
    """
    tree, bits = [ranges], range_bits
    while bits > 0:
        step = min(fan_bits, bits)
        up = tree[0].groupBy("_g", "_i", F.shiftright("_p", step).alias("_p"))
        tree.insert(0, up.agg(F.sum(F.xxhash64("_p", "_d").cast("decimal(20,0)")).alias("_t")).select("_g", "_i", "_p", F.xxhash64("_t").alias("_d")))
        bits -= step
    steps = [0, *((range_bits - 1) % fan_bits + 1 if k == 0 else fan_bits for k in range(len(tree) - 1))]
    look = pairs.select("_g", "_i", F.lit(0).cast("long").alias("_up"))
    for nodes, step in zip(tree, steps, strict=True):
        # a node is the new side of its own snapshot's comparison and the old side of the next one's
        sides = F.array(F.struct(F.col("_i").alias("i"), F.col("_d").alias("n"), F.lit(None).cast("long").alias("o")), F.struct((F.col("_i") + 1).alias("i"), F.lit(None).cast("long").alias("n"), F.col("_d").alias("o")))
        d = nodes.withColumn("_x", F.explode(sides)).select("_g", "_p", F.col("_x.i").alias("_i"), "_x.n", "_x.o", F.shiftright("_p", step).alias("_up") if step else F.lit(0).cast("long").alias("_up"))
        met = d.groupBy("_g", "_i", "_up", "_p").agg(F.max("n").alias("n"), F.max("o").alias("o")).filter(~F.col("n").eqNullSafe(F.col("o")))
        look = met.join(look, ["_g", "_i", "_up"], "left_semi").select("_g", "_i", F.col("_p").alias("_up"))
    return look.groupBy("_g", F.col("_up").alias("_p")).agg(F.collect_set("_i").alias("_open"))


def _compared(rows: DataFrame, group: str, snapshot: str, key: str, compared: Sequence[str], leaf_rows: int, range_rows: int, fan_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows of differing leaves, snapshots): the former with ``_g``, ``_i``, ``_k``, ``_new`` (whether of the later snapshot) and ``_h``; the latter ``_g``, ``_i``, ``_s``, ``_rows``."""
    base = rows.filter(F.col(group).isNotNull() & F.col(snapshot).isNotNull() & F.col(key).isNotNull())
    sizes = cut(base.groupBy(F.col(group).alias("_g"), F.col(snapshot).alias("_s")).agg(F.count(F.lit(1)).alias("_rows")), "sizes").df
    largest = int(sizes.agg(F.max("_rows")).first()[0] or 0)
    leaf_bits = _bits(largest, leaf_rows)
    range_bits = min(leaf_bits, _bits(largest, range_rows))
    # one row for each snapshot of a group
    numbered = sizes.withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy("_s")))
    hashed = F.xxhash64(F.lit(7), key)
    at = lambda bits: F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("long")
    slim = base.select(
        F.col(group).alias("_g"), F.col(snapshot).alias("_s"), at(range_bits).alias("_p"), at(leaf_bits).alias("_b"), F.col(key).alias("_k"), F.struct(_digest(compared, 1).alias("a"), _digest(compared, 2).alias("b")).alias("_h")
    )
    digests = cut(slim.join(numbered.select("_g", "_s", "_i"), ["_g", "_s"]).drop("_s"), "digests").df
    placed = digests.repartition("_g", "_p")

    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    one, two = F.xxhash64("_k", "_h"), F.xxhash64(F.lit(3), "_k", "_h")
    ranges = cut(digests.groupBy("_g", "_p", "_i").agg(F.xxhash64(F.count(F.lit(1)), wide(one), wide(two)).alias("_d")), "ranges").df
    open_ = _open_ranges(ranges, numbered.filter("_i > 1"), range_bits, fan_bits)

    roles = F.filter(F.array(F.struct(F.col("_i").alias("i"), F.lit(True).alias("new")), F.struct((F.col("_i") + 1).alias("i"), F.lit(False).alias("new"))), lambda x: F.array_contains("_open", x["i"]))
    d = placed.join(open_, ["_g", "_p"]).withColumn("_r", F.explode(roles)).select("_g", "_p", "_b", F.col("_r.i").alias("_i"), F.col("_r.new").alias("_new"), "_k", "_h")
    leaf = Window.partitionBy("_g", "_p", "_b", "_i")
    side = lambda new: F.struct(*(F.sum(F.when(F.col("_new") == new, x)).over(leaf).alias(n) for n, x in (("n", F.lit(1).cast("decimal(20,0)")), ("a", one.cast("decimal(20,0)")), ("b", two.cast("decimal(20,0)")))))
    return d.withColumn("_dn", side(True)).withColumn("_do", side(False)).filter(~F.col("_dn").eqNullSafe(F.col("_do"))).drop("_dn", "_do"), numbered


def snapshot_changes(
    rows: DataFrame, group: str, snapshot: str, key: str, compared: Sequence[str], leaf_rows: int = LEAF_ROWS, range_rows: int = RANGE_ROWS, fan_bits: int = FAN_BITS
) -> DataFrame:
    """Result: group, key, snapshot, ``change`` ('added', 'removed' or 'changed').

    Each snapshot of a group is compared with that group's snapshot before it;
    the first one yields nothing.  Rows with a null group, snapshot or key are
    left out.  Exact copies inside a snapshot count once; several different
    rows with one key count as a set.  Columns not named in ``compared`` never
    matter, whatever they are called.
    """
    d, numbered = _compared(rows, group, snapshot, key, compared, leaf_rows, range_rows, fan_bits)
    sets = [F.array_sort(F.collect_set(F.when(F.col("_new") == new, F.col("_h")))).alias(name) for new, name in ((True, "n"), (False, "o"))]
    met = d.groupBy("_g", "_p", "_b", "_i", "_k").agg(*sets)
    change = F.when(F.size("o") == 0, "added").when(F.size("n") == 0, "removed").when(F.col("o") != F.col("n"), "changed")
    met = met.select("_g", "_i", "_k", change.alias("change")).filter(F.col("change").isNotNull()).join(numbered, ["_g", "_i"])
    return met.select(F.col("_g").alias(group), F.col("_k").alias(key), F.col("_s").alias(snapshot), "change")


def pruning_report(
    rows: DataFrame, group: str, snapshot: str, key: str, compared: Sequence[str], leaf_rows: int = LEAF_ROWS, range_rows: int = RANGE_ROWS, fan_bits: int = FAN_BITS
) -> DataFrame:
    """How much the tree spares: group, snapshot, ``rows`` (of it and the one before) and ``compared_rows`` (of differing leaves)."""
    d, numbered = _compared(rows, group, snapshot, key, compared, leaf_rows, range_rows, fan_bits)
    seen = d.groupBy("_g", "_i").agg(F.count(F.lit(1)).alias("compared_rows"))
    before = numbered.select("_g", (F.col("_i") + 1).alias("_i"), F.col("_rows").alias("_old"))
    out = numbered.join(before, ["_g", "_i"]).join(seen, ["_g", "_i"], "left")
    return out.select(F.col("_g").alias(group), F.col("_s").alias(snapshot), (F.col("_rows") + F.col("_old")).alias("rows"), F.coalesce("compared_rows", F.lit(0)).alias("compared_rows"))
