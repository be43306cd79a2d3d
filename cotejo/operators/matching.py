"""Entity resolution across stores: candidates, scores, tiers, components, golden records.

Rows have ``id``, ``store``, ``name`` (normalised), ``brand``, ``unit``,
``specs`` (map), ``flags`` (array) and ``price``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cotejo.functions.catalog import NO_BRAND, lookup_url, name_tokens
from cotejo.session import Cut, cut

# fixed values: what each quality flag costs, and when two prices are too far apart
PENALTIES = {"missing_brand": 5, "missing_sku": 3, "missing_effective_price": 2, "unknown_unit": 2, "empty_name_normalized": 10}
OUTLIER_RATIO, OUTLIER_PENALTY = 3.0, 15
CONFIDENT, REVIEW = 90, 78
SIGNALS = ("name_score", "brand_score", "numeric_score", "unit_score", "penalty", "score", "conflicts")
#: row ids in one cell where pairs of classes become pairs of rows, and pairs of rows that one task unfolds
CHUNK, TASK_PAIRS = 500, 2_000_000
#: row ids in one cell of a kind
CELL = 2000


class Classes(NamedTuple):
    """Rows that pairing and scoring can't tell apart, as written tables.

    ``groups``: ``cls``, ``kind``, ``n`` rows and the columns asked for; ``kinds``:
    ``kind``, ``name``, ``brand``, ``unit``; ``nodes``: ``node``, ``cls``, ``store``
    and ``n`` of a class's rows in one store; ``members``: ``cls``, ``store`` and
    ``ids``, structs of about CHUNK ids in a cell.
    """

    groups: DataFrame
    kinds: DataFrame
    nodes: DataFrame
    members: DataFrame


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def classes(rows: DataFrame, *more: str) -> Classes:
    """Classes of rows with equal ``name``, ``brand``, ``unit`` and ``more``; rows without a store pair with none."""
    kind, key = ["name", "brand", "unit"], ["name", "brand", "unit", *more]
    base = cut(rows.filter(F.col("store").isNotNull()).select("id", "store", *key), "rows").df
    groups = cut(base.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("cls", F.monotonically_increasing_id()), "classes").df
    kinds = cut(groups.select(*kind).distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds").df
    of = base.join(groups, _same(base, groups, key)).select("id", "store", "cls", "n")
    part = F.pmod(F.xxhash64("id"), 1 + F.floor(F.col("n") / CHUNK))
    members = cut(of.groupBy("cls", "store", part.alias("_part")).agg(F.collect_list(F.struct("id")).alias("ids")).drop("_part"), "members").df
    nodes = cut(members.groupBy("cls", "store").agg(F.sum(F.size("ids")).alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes").df
    return Classes(groups.join(kinds, _same(groups, kinds, kind)).select("cls", "kind", "n", *(groups[c] for c in more)), kinds, nodes, members)


def kind_pairs(kinds: DataFrame) -> DataFrame:
    """``lk``, ``rk`` of kinds that share a token and whose brands and units don't conflict, in both orders; each kind with itself.

    The blocking key is (token, brand): a kind with a brand meets kinds of its
    brand; one without meets all.  Of several shared tokens only the smallest
    yields the pair, so no distinct over pairs is needed.
    """
    base = kinds.select("kind", "brand", "unit", F.array_sort(name_tokens(F.col("name"))).alias("toks")).filter(F.size("toks") > 0)
    e = base.withColumn("tok", F.explode("toks"))
    l, r = e.alias("l"), e.alias("r")
    c = F.col
    ok = c("l.unit").isNull() | c("r.unit").isNull() | (c("l.unit") == c("r.unit"))
    ok = ok & (c("l.tok") == c("r.tok")) & (c("l.tok") == F.array_min(F.array_intersect("l.toks", "r.toks")))
    blank = lambda x: c(x) == NO_BRAND
    same = l.join(r, ok & (c("l.brand") == c("r.brand")) & (c("l.kind") <= c("r.kind")))
    mixed = l.filter(blank("l.brand")).join(r.filter(~blank("r.brand")), ok)
    pick = [c("l.kind").alias("a"), c("r.kind").alias("b")]
    met = same.select(*pick).unionByName(mixed.select(*pick))
    one, other = F.struct(c("a").alias("lk"), c("b").alias("rk")), F.struct(c("b").alias("lk"), c("a").alias("rk"))
    return met.select(F.inline(F.when(c("a") == c("b"), F.array(one)).otherwise(F.array(one, other))))


def class_pairs(c: Classes) -> DataFrame:
    """``lc``, ``rc`` with their row counts ``ln``, ``rn``: classes whose rows of different stores are candidates."""
    g = c.groups
    d = kind_pairs(c.kinds).join(g.select(F.col("kind").alias("lk"), F.col("cls").alias("lc"), F.col("n").alias("ln")), "lk")
    return d.join(g.select(F.col("kind").alias("rk"), F.col("cls").alias("rc"), F.col("n").alias("rn")), "rk").select("lc", "rc", "ln", "rn")


def row_pairs(pairs: DataFrame, c: Classes) -> DataFrame:
    """The pairs of rows (``left_id``, ``right_id``, ``left_store``, ``right_store``) that pairs of classes stand for, with the other columns of ``pairs``.

    Cells of ids meet and are unfolded at the very end; the number of tasks
    follows the number of pairs, not the bytes before they are unfolded.
    """
    p = cut(pairs, "class-pairs").df
    total = p.agg(F.sum(F.col("ln") * F.col("rn").cast("double"))).first()[0] or 0.0
    side = lambda k, x: c.members.select(F.col("cls").alias(k), F.col("store").alias(f"{x}_store"), F.col("ids").alias(f"_{x}"))
    d = p.drop("ln", "rn").join(side("lc", "left"), "lc").join(side("rc", "right"), "rc").filter("left_store < right_store").drop("lc", "rc")
    if total > TASK_PAIRS:
        d = d.repartition(int(min(10_000, total // TASK_PAIRS + 1)))
    d = d.withColumn("_left", F.explode("_left")).withColumn("_right", F.explode("_right"))
    return d.select(F.col("_left.id").alias("left_id"), F.col("_right.id").alias("right_id"), *(x for x in d.columns if x not in ("_left", "_right")))


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Ids of rows of different stores that share a token and whose brands and units don't conflict; each pair once.

    Equal rows are paired as one.
    """
    c = classes(rows)
    return row_pairs(class_pairs(c), c).select("left_id", "right_id")


def blocking_counts(rows: DataFrame) -> DataFrame:
    """``rule``, ``pairs``: pairs of rows of different stores that share a token, by the first rule that stops them (brand_mismatch, unit_mismatch) or passed.

    Rows of one store with equal tokens, brand and unit are one class with a
    count, so pairs are counted and not formed.
    """
    toks = F.array_sort(name_tokens(F.col("name")))
    c = rows.select("store", "brand", "unit", toks.alias("toks")).filter(F.size("toks") > 0).groupBy("store", "brand", "unit", "toks").agg(F.count(F.lit(1)).alias("n"))
    # token sets meet once, however many classes have them
    sets = cut(c.select("toks").distinct(), "token-sets").df
    e = sets.withColumn("tok", F.explode("toks"))
    met = e.alias("l").join(e.alias("r"), (F.col("l.tok") == F.col("r.tok")) & (F.col("l.tok") == F.array_min(F.array_intersect("l.toks", "r.toks")))).select(F.col("l.toks").alias("lt"), F.col("r.toks").alias("rt"))
    d = met.join(c.alias("l"), F.col("lt") == F.col("l.toks")).join(c.alias("r"), (F.col("rt") == F.col("r.toks")) & (F.col("l.store") < F.col("r.store")))
    brand = (F.col("l.brand") != NO_BRAND) & (F.col("r.brand") != NO_BRAND) & (F.col("l.brand") != F.col("r.brand"))
    rule = F.when(brand, "brand_mismatch").when(F.col("l.unit") != F.col("r.unit"), "unit_mismatch").otherwise("passed")
    return d.groupBy(rule.alias("rule")).agg(F.sum(F.col("l.n") * F.col("r.n")).alias("pairs"))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 characters and more at a time as bits of one integer."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_ratio(left: str | None, right: str | None) -> int:
    """0..100: similarity of two token sets; 100 if one contains the other; blanks give 0."""
    a, b = set((left or "").split()), set((right or "").split())
    if not a or not b:
        return 0
    common = a & b
    if common and (a <= b or b <= a):
        return 100
    ra, rb = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    s, g = len(" ".join(sorted(common))), 1 if common else 0
    la, lb = len(ra), len(rb)
    total = 2 * (s + g) + la + lb
    best = 1 - (la + lb - 2 * _lcs(ra, rb)) / total
    if common:
        best = max(best, 1 - (g + la) / (2 * s + g + la), 1 - (g + lb) / (2 * s + g + lb))
    return round(100 * best)


@F.pandas_udf(IntegerType())
def token_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(left, right, strict=True)], dtype="int32")


def name_scores(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Name score of each distinct pair of names: the Python part sees every pair of texts once, however many rows share it."""
    d = pairs.select(left, right).distinct().withColumn("ts", token_similarity(F.col(left), F.col(right)))
    d = d.withColumn("lev", F.levenshtein(left, right))
    penalty = F.when(F.col("ts") >= 50, F.greatest((F.col("lev") - 14) * 2, F.lit(0))).otherwise(0)
    return d.select(left, right, "ts", "lev", F.greatest(F.col("ts") - penalty, F.lit(0)).alias("name_score"))


def spec_number(v: Column) -> Column:
    """Number at the start of a measure: fraction or decimal; null if there is none."""
    top, below = F.regexp_extract(v, r"^(\d+(?:\.\d+)?)", 1), F.regexp_extract(v, r"^\d+(?:\.\d+)?/(\d+)", 1)
    return F.when(below != "", F.try_divide(top.try_cast("double"), below.try_cast("double"))).otherwise(top.try_cast("double"))


def read_specs(m: Column) -> Column:
    """Map of measures with each measure's text, number and unit."""

    def read(_: Column, v: Column) -> Column:
        text = F.lower(F.trim(v))
        return F.struct(text.alias("text"), spec_number(text).alias("number"), F.regexp_extract(text, r"([a-z]+)$", 1).alias("unit"))

    return F.transform_values(m, read)


def spec_conflicts(a: Column, b: Column) -> tuple[Column, Column]:
    """(array of conflicting keys, number of shared equal measures) of two maps that read_specs() made."""
    keys = F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))

    def clash(k: Column) -> Column:
        x, y = F.element_at(a, k), F.element_at(b, k)
        nx, ny = x["number"], y["number"]
        near = F.try_divide(F.abs(nx - ny), F.greatest(nx, ny)) <= 0.10
        comparable = nx.isNotNull() & ny.isNotNull() & (x["unit"] == y["unit"]) & (x["unit"] != "")
        return (x["text"] != y["text"]) & ~(comparable & F.coalesce(near, F.lit(True)))

    return F.filter(keys, clash), F.size(F.filter(keys, lambda k: F.element_at(a, k)["text"] == F.element_at(b, k)["text"]))


def measure_signals(a: Column, b: Column) -> dict[str, Column]:
    """``conflicts``, ``_clash`` and ``numeric_score`` of two maps that read_specs() made."""
    conflicts, shared = spec_conflicts(a, b)
    numeric = F.when(shared > 0, 100).when((F.size(a) > 0) | (F.size(b) > 0), 55).otherwise(70)
    return {"conflicts": F.array_join(conflicts, ";"), "_clash": F.size(conflicts) > 0, "numeric_score": numeric}


def named_pairs(c: Classes) -> DataFrame:
    """Pairs of kinds with their names, brands, units and name scores."""
    side = lambda k, x: c.kinds.select(F.col("kind").alias(k), *(F.col(v).alias(f"{x}_{v}") for v in ("name", "brand", "unit")))
    d = cut(kind_pairs(c.kinds), "kind-pairs").df.join(side("lk", "left"), "lk").join(side("rk", "right"), "rk")
    return d.join(name_scores(d, "left_name", "right_name"), ["left_name", "right_name"])


def scorable(rows: DataFrame) -> Classes:
    """Classes of rows that score alike.

    Prices are told apart only where two of them may be outliers to each other.
    """
    low, high = rows.filter("price > 0").agg(F.min("price"), F.max("price")).first()
    price = F.lit(None).cast("double") if low is None or high / low <= OUTLIER_RATIO else F.col("price")
    penalties = F.create_map(*(F.lit(x) for kv in PENALTIES.items() for x in kv))
    cost = F.aggregate("flags", F.lit(0), lambda acc, f: acc + F.coalesce(F.element_at(penalties, f), F.lit(0)))
    d = rows.withColumns({"measures": F.array_sort(F.map_entries("specs")), "cost": cost, "price": price})
    return classes(d, "measures", "cost", "price")


def _total(numeric: Column) -> Column:
    return F.rint((F.col("name_score") * 65 + F.col("brand_score") * 20 + numeric * 10 + F.col("unit_score") * 5) / 100.0).cast("int")


def kind_scores(c: Classes) -> DataFrame:
    """``lk``, ``rk`` with the scores that a kind's rows share."""
    lb, rb, lu, ru = (F.col(x) for x in ("left_brand", "right_brand", "left_unit", "right_unit"))
    none = (lb == NO_BRAND).cast("int") + (rb == NO_BRAND).cast("int")
    brand = F.when(none == 2, 40).when(none == 1, 25).when(lb == rb, 100).otherwise(0)
    unit = F.when(lu == ru, 100).when(lu.isNotNull() | ru.isNotNull(), 60).otherwise(70)
    return named_pairs(c).select("lk", "rk", "name_score", brand.alias("brand_score"), unit.alias("unit_score"))


def final_scores(total: Column, confident: int, review: int) -> list[Column]:
    """``penalty``, ``score`` and ``tier`` of classes with ``lcost``, ``rcost``, ``lprice``, ``rprice`` and their signals."""
    lp, rp = F.col("lprice"), F.col("rprice")
    outlier = F.coalesce((lp > 0) & (rp > 0) & (F.greatest(lp, rp) / F.least(lp, rp) > OUTLIER_RATIO), F.lit(False))
    penalty = F.col("lcost") + F.col("rcost")
    score = F.greatest(total - penalty - F.when(outlier, OUTLIER_PENALTY).otherwise(0), F.lit(0))
    sure = (score >= confident) & (F.col("name_score") >= 90) & (F.col("brand_score") == 100)
    tier = F.when(F.col("_clash"), "rejected").when(sure, "confident").when(score >= review, "review").otherwise("rejected")
    return [penalty.alias("penalty"), score.alias("score"), tier.alias("tier")]


def class_scores(c: Classes, lowest: int = 0, confident: int = CONFIDENT, review: int = REVIEW) -> DataFrame:
    """Signals, final score and tier of pairs of classes, with their row counts ``ln``, ``rn`` and their rows by store ``ls``, ``rs``.

    Pairs that can't reach ``lowest`` whatever their measures are left out.  Names
    are compared once for each pair of names, measures once for each pair of
    sets of measures.
    """
    kinds = cut(kind_scores(c).filter(_total(F.lit(100)) >= lowest), "kind-scores").df
    sets = cut(c.groups.select("measures").distinct().withColumn("set", F.monotonically_increasing_id()), "measures").df
    by_store = c.nodes.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("store", "n"))).alias("stores"))
    g = c.groups.join(sets, _same(c.groups, sets, ["measures"])).select("cls", "kind", "n", "set", "cost", "price")
    g = cut(g.join(by_store, "cls"), "scorable").df
    own = g.select("kind", "set").distinct()
    met = kinds.select("lk", "rk").join(own.select(F.col("kind").alias("lk"), F.col("set").alias("lm")), "lk").join(own.select(F.col("kind").alias("rk"), F.col("set").alias("rm")), "rk").select("lm", "rm").distinct()
    side = lambda k, x: sets.select(F.col("set").alias(k), read_specs(F.map_from_entries("measures")).alias(x))
    met = met.join(side("lm", "_a"), "lm").join(side("rm", "_b"), "rm")
    met = cut(met.select("lm", "rm", *(v.alias(k) for k, v in measure_signals(F.col("_a"), F.col("_b")).items())), "measure-pairs").df
    names = {"cls": "c", "kind": "k", "n": "n", "set": "m", "cost": "cost", "price": "price", "stores": "s"}
    part = lambda x: g.select(*(F.col(v).alias(f"{x}{w}") for v, w in names.items()))
    d = kinds.join(part("l"), "lk").join(part("r"), "rk").join(met, ["lm", "rm"])
    d = d.select("*", *final_scores(_total(F.col("numeric_score")), confident, review))
    return d.select("lc", "rc", "ln", "rn", "ls", "rs", *SIGNALS, "tier")


def kind_cells(c: Classes) -> DataFrame:
    """``kind``, ``sets``: about CELL rows of one kind in a cell, by their measures, then by cost, price and store."""
    n = c.groups.groupBy("kind").agg(F.sum("n").alias("_n"))
    d = c.members.join(c.groups.drop("n"), "cls").join(n, "kind")
    part = F.pmod(F.xxhash64("cls", "store", F.element_at("ids", 1)), 1 + F.floor(F.col("_n") / CELL))
    d = d.groupBy("kind", part.alias("_part"), "measures").agg(F.sort_array(F.collect_list(F.struct("store", "cost", "price", F.sort_array("ids").alias("ids")))).alias("rows"))
    d = d.groupBy("kind", "_part").agg(F.sort_array(F.collect_list(F.struct("measures", "rows"))).alias("sets"))
    return d.select("kind", F.transform("sets", lambda s: F.struct(read_specs(F.map_from_entries(s["measures"])).alias("specs"), s["rows"].alias("rows"))).alias("sets"))


def scored_pairs(rows: DataFrame) -> DataFrame:
    """Signals, final score and tier of every candidate pair.

    Only pairs of cells of whole kinds are moved; measures are compared and rows
    scored where a pair of cells is unfolded: first by sets of measures, then by
    cost, price and store, at the very end by rows.
    """
    c = scorable(rows)
    kinds = cut(kind_scores(c), "kind-scores").df
    cells = cut(kind_cells(c), "cells").df
    n = c.groups.groupBy("kind").agg(F.sum("n").cast("double").alias("n"))
    side = lambda k, v, x: F.col(v).alias(f"{x}{k}")
    total = kinds.join(n.select(side("k", "kind", "l"), side("n", "n", "l")), "lk").join(n.select(side("k", "kind", "r"), side("n", "n", "r")), "rk").agg(F.sum(F.col("ln") * F.col("rn"))).first()[0] or 0.0
    d = kinds.join(cells.select(side("k", "kind", "l"), side("sets", "sets", "l")), "lk").join(cells.select(side("k", "kind", "r"), side("sets", "sets", "r")), "rk").drop("lk", "rk")
    if total > TASK_PAIRS:
        d = d.repartition(int(min(10_000, max(total // TASK_PAIRS + 1, rows.sparkSession.sparkContext.defaultParallelism))))
    # a left row meets all sets of the right cell in turn: runs and repetitions that the result's files keep short
    d = d.withColumn("l", F.explode("lsets"))
    met = lambda r: F.struct(*(v.alias(k) for k, v in measure_signals(F.col("l.specs"), r["specs"]).items()), r["rows"].alias("rows"))
    d = d.select("name_score", "brand_score", "unit_score", F.col("l.rows").alias("lrows"), F.transform("rsets", met).alias("rsets"))
    d = d.withColumn("_l", F.explode("lrows")).withColumn("_left", F.explode("_l.ids")).withColumn("r", F.explode("rsets"))
    d = d.withColumn("_r", F.explode("r.rows")).filter("_l.store < _r.store")
    own = lambda v, x: F.col(f"_{x}.{v}").alias(f"{x}{v}")
    d = d.select("*", "r.numeric_score", "r.conflicts", "r._clash", *(own(v, x) for x in "lr" for v in ("cost", "price")), F.col("_l.store").alias("left_store"), F.col("_r.store").alias("right_store"))
    d = d.withColumn("_total", _total(F.col("numeric_score")))
    d = d.select("_left", "_r", "left_store", "right_store", "name_score", "brand_score", "numeric_score", "unit_score", "conflicts", *final_scores(F.col("_total"), CONFIDENT, REVIEW))
    d = d.withColumn("_right", F.explode("_r.ids"))
    return d.select(F.col("_left.id").alias("left_id"), F.col("_right.id").alias("right_id"), "left_store", "right_store", *SIGNALS, "tier")


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``id``, ``component`` (smallest member): min-label propagation with pointer jumping, each round written."""
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null and a <> b")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges").df
    now: Cut = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    for _ in range(max_rounds):
        near = both.join(now.df.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("n"))
        step = now.df.join(near, "a", "left").select("a", F.least("c", F.coalesce("n", "c")).alias("c"), F.col("c").alias("old"))
        jump = step.alias("s").join(step.select(F.col("a").alias("k"), F.col("c").alias("j")).alias("t"), F.col("s.c") == F.col("t.k"), "left")
        nxt = cut(jump.select("s.a", F.least(F.col("s.c"), F.coalesce(F.col("t.j"), F.col("s.c"))).alias("c"), "s.old"), "labels")
        moved = nxt.df.filter("c <> old").isEmpty()
        now.drop()
        now = nxt
        if moved:
            break
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return now.df.select(F.col("a").alias("id"), F.col("c").alias("component"))


def resolve_row_ids(sides: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``resolved`` to ``rid``, ``store``, ``sku``, ``url``: the listing that each side of a decision means, null if none.

    rows: ``silver_row_id``, ``store``, ``sku_store``, ``product_url``, one for
    each listing.  In turn: the id itself, store and SKU with the same URL, store
    and SKU if they are unique, store and URL.  Rows have no order, so the
    smallest id stands for the first match and the largest for the last.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    key = lambda store, sku, url: [F.lower(text(F.col(store))).alias("_store"), text(F.col(sku)).alias("_sku"), lookup_url(F.col(url)).alias("_url")]
    r = rows.filter("silver_row_id <> ''").select("silver_row_id", *key("store", "sku_store", "product_url")).filter("_store <> ''")
    both = r.filter("_sku <> '' and _url <> ''").groupBy("_store", "_sku", "_url").agg(F.min("silver_row_id").alias("_both"))
    only = r.filter("_sku <> ''").groupBy("_store", "_sku").agg(F.min("silver_row_id").alias("_only"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    by_url = r.filter("_url <> ''").groupBy("_store", "_url").agg(F.max("silver_row_id").alias("_last"))
    ids = rows.filter("silver_row_id <> ''").select(F.col("silver_row_id").alias("rid"), F.col("silver_row_id").alias("_hit")).distinct()
    d = sides.distinct().select("rid", "store", "sku", "url", *key("store", "sku", "url")).join(ids, "rid", "left")
    d = d.join(both, ["_store", "_sku", "_url"], "left").join(only, ["_store", "_sku"], "left").join(by_url, ["_store", "_url"], "left")
    return d.select("rid", "store", "sku", "url", F.coalesce("_hit", "_both", "_only", "_last").alias("resolved"))


def short_hash(ids: Column) -> Column:
    """16 hex digits of the SHA-1 of an array of ids, sorted and joined by '|'."""
    return F.substring(F.sha1(F.array_join(F.array_sort(ids), "|")), 1, 16)


def are_similar(left: Column, right: Column, threshold: int = 90) -> Column:
    """Whether the token-set ratio of two names reaches the threshold."""
    return token_similarity(left, right) >= threshold


def merged_components(entities: DataFrame, entity: str, member: str, accepted: DataFrame, left: str, right: str) -> DataFrame:
    """Entities after accepted pairs were integrated: ``id``, ``component`` over entity members and accepted links together.

    The final state doesn't depend on the order of the decisions.
    """
    own = entities.select(F.col(entity).alias("e"), F.col(member).alias("b")).filter("e is not null and b is not null")
    edges = own.join(own.groupBy("e").agg(F.min("b").alias("a")), "e").select("a", "b")
    return components(edges.unionByName(accepted.select(F.col(left).alias("a"), F.col(right).alias("b"))), "a", "b")


def store_counts(rows: DataFrame) -> DataFrame:
    """``left_store``, ``right_store``, ``pairs``: candidate pairs by stores, counted and not formed."""
    c = classes(rows)
    side = lambda k, x: c.nodes.select(F.col("cls").alias(k), F.col("store").alias(f"{x}_store"), F.col("n").alias(f"_{x}"))
    d = class_pairs(c).join(side("lc", "left"), "lc").join(side("rc", "right"), "rc").filter("left_store < right_store")
    return d.groupBy("left_store", "right_store").agg(F.sum(F.col("_left") * F.col("_right")).alias("pairs"))


def tier_counts(rows: DataFrame) -> DataFrame:
    """``tier``, ``numeric_conflict``, ``pairs``, ``low`` and ``high`` score of all candidate pairs, counted by classes and not formed."""
    d = class_scores(scorable(rows))
    before = lambda y: F.aggregate("ls", F.lit(0).cast("long"), lambda a, x: a + F.when(x["store"] < y["store"], x["n"]).otherwise(0))
    n = F.aggregate("rs", F.lit(0).cast("long"), lambda a, y: a + y["n"] * before(y))
    d = d.withColumn("_n", n).filter("_n > 0")
    return d.groupBy("tier", (F.col("conflicts") != "").alias("numeric_conflict")).agg(F.sum("_n").alias("pairs"), F.min("score").alias("low"), F.max("score").alias("high"))


def best_pairs(pairs: DataFrame, c: Classes, most: int) -> DataFrame:
    """Of the row pairs that pairs of classes stand for the ``most`` best: highest score, then smallest ids.

    Every left row of a pair of classes has a partner in it, so the best pairs
    have left rows among the ``most`` best by score and id; only those are paired.
    """
    p = cut(pairs, "ranked").df
    last = c.nodes.groupBy(F.col("cls").alias("rc")).agg(F.max("store").alias("_last"))
    side = lambda k, x: c.members.select(F.col("cls").alias(k), F.col("store").alias(f"{x}_store"), F.explode("ids.id").alias(f"{x}_id"))
    left = p.join(last, "rc").groupBy("lc", "score").agg(F.max("_last").alias("_last")).join(side("lc", "left"), "lc").filter("left_store < _last").drop("_last")
    left = cut(left.orderBy(F.desc("score"), "left_id").limit(most), "best-left").df
    d = left.join(p, ["lc", "score"]).join(side("rc", "right"), "rc").filter("left_store < right_store")
    return d.orderBy(F.desc("score"), "left_id", "right_id").limit(most).drop("lc", "rc")


def review_pairs(rows: DataFrame, most: int) -> DataFrame:
    """The best pairs for review."""
    c = scorable(rows)
    d = best_pairs(class_scores(c, REVIEW).filter("tier = 'review'").drop("ln", "rn", "ls", "rs"), c, most)
    return d.select("left_id", "right_id", "left_store", "right_store", *SIGNALS, "tier")


def golden_records(rows: DataFrame) -> DataFrame:
    """One record for each component of confident pairs with rows of two stores: base row, price reference, scores and an id made of the members.

    Rows of one class and store have the same partners, so they are one vertex.
    The id needs all member ids of a component in one cell, as its definition has it.
    """
    c = scorable(rows)
    sure = class_scores(c, CONFIDENT).filter("tier = 'confident'").select("lc", "rc", "score", F.col("ls.store").alias("_l"), F.col("rs.store").alias("_r"))
    side = lambda k, x: c.nodes.select(F.col("cls").alias(k), F.col("store").alias(f"{x}_store"), F.col("node").alias(x), F.col("n").alias(f"_{x}"))
    d = sure.filter(F.array_min("_l") < F.array_max("_r")).drop("_l", "_r").join(side("lc", "left"), "lc").join(side("rc", "right"), "rc").filter("left_store < right_store")
    edges = cut(d.select("left", "right", "score", (F.col("_left") * F.col("_right")).alias("n")), "confident").df
    comp = cut(components(edges, "left", "right").select(F.col("id").alias("node"), F.col("component").alias("_comp")), "components").df
    ids = c.members.join(c.nodes.select("cls", "store", "node"), ["cls", "store"]).join(comp, "node").select("_comp", F.explode("ids.id").alias("id"))
    m = ids.join(rows, "id")
    best = F.struct(F.size("flags").alias("a"), (-F.length("name")).alias("b"), F.col("id").alias("c"))
    per = m.groupBy("_comp").agg(
        F.min("id").alias("component"),
        F.countDistinct("store").alias("stores"), F.count(F.lit(1)).alias("members"), F.min_by("name", best).alias("name"), F.min_by("brand", best).alias("brand"),
        F.min(F.when(F.col("price") > 0, F.col("price"))).alias("price_reference"), short_hash(F.collect_set(F.col("id").cast("string"))).alias("gold_id"),
    ).filter("stores >= 2")
    s = edges.join(comp.withColumnRenamed("node", "left"), "left").groupBy("_comp").agg(
        F.sum("n").alias("pairs"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.bround(F.sum(F.col("score") * F.col("n")).cast("double") / F.sum("n"), 2).alias("avg_score")
    )
    return per.join(s, "_comp").drop("_comp")


def class_previews(c: Classes, threshold: int = 60, gate: int = 25, lowest: int | None = None) -> DataFrame:
    """Composite preview score of pairs of classes that pass the name gate and reach the threshold (or ``lowest``, where a fallback needs those below)."""
    d = named_pairs(c).filter(F.col("ts") >= max(45, threshold - gate))
    none = (F.col("left_brand") == NO_BRAND) | (F.col("right_brand") == NO_BRAND)
    brand = F.when((F.col("left_brand") == F.col("right_brand")) & ~none, 100).when(none, 50).otherwise(20)
    score = F.rint((F.col("ts") * 75 + brand * 15 + F.greatest(100 - F.col("lev") * 3, F.lit(0)) * 10) / 100.0).cast("int")
    d = d.select("lk", "rk", F.col("ts").alias("token_score"), F.col("lev").alias("distance"), score.alias("score")).filter(F.col("score") >= (threshold if lowest is None else lowest))
    side = lambda k, x: c.groups.select(F.col("kind").alias(k), F.col("cls").alias(f"{x}c"), F.col("n").alias(f"{x}n"))
    return d.join(side("lk", "l"), "lk").join(side("rk", "r"), "rk").drop("lk", "rk")


def best_previews(rows: DataFrame, threshold: int, lowest: int, most: int) -> DataFrame:
    """``left_id``, ``right_id``, ``score`` of the best candidate pairs down to ``lowest``."""
    c = classes(rows)
    p = class_previews(c, threshold, lowest=lowest)
    return best_pairs(p.select("lc", "rc", "score"), c, most).select("left_id", "right_id", "score")


def preview_pairs(rows: DataFrame, threshold: int = 60, gate: int = 25) -> DataFrame:
    """Preview score of every candidate pair that passes the name gate and reaches the threshold."""
    c = classes(rows)
    return row_pairs(class_previews(c, threshold, gate), c).select("left_id", "right_id", "token_score", "distance", "score")
