"""Golden entities: variants, canonical product, rationale, refresh and integration of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.catalog import NO_BRAND
from cotejo.operators.matching import components, short_hash
from cotejo.session import cut

#: pairs whose reasons make the rationale, and reasons kept
RATIONALE_PAIRS, RATIONALE_REASONS = 5, 12
VARIANT = (
    "store", "silver_row_id", "name_original", "name_normalized", "brand_original", "brand_normalized", "sku_store", "product_url", "effective_price", "unidad_medida", "image_url", "quality_flags", "category_normalized",
)


def _canonical(v: str) -> dict[str, Column]:
    """Canonical values of an array of variants sorted by id: of the row with fewest flags, then the longest name, then the smallest id."""
    rank = lambda x: F.struct(F.size(F.coalesce(x["quality_flags"], F.array().cast("array<string>"))).alias("a"), (-F.length(F.coalesce(x["name_normalized"], F.lit("")))).alias("b"), x["silver_row_id"].alias("c"), x.alias("x"))
    base = F.array_min(F.transform(F.col(v), lambda x: rank(x)))["x"]
    prices = F.filter(F.transform(F.col(v), lambda x: x["effective_price"]), lambda p: p > 0)
    return {
        "base_row_id": base["silver_row_id"],
        "name_canonical": F.coalesce(F.nullif(base["name_normalized"], F.lit("")), base["name_original"]),
        "brand_canonical": base["brand_normalized"],
        "unidad_medida": base["unidad_medida"],
        "category_normalized": base["category_normalized"],
        "image_url": F.get(F.filter(F.transform(F.col(v), lambda x: F.nullif(x["image_url"], F.lit(""))), lambda i: i.isNotNull()), F.lit(0)),
        "price_reference": F.array_min(prices),
    }


def golden_entities(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One entity for each component of accepted pairs with rows of two stores, surest first.

    rows: the VARIANT columns, one row for each silver_row_id.  pairs: left_id,
    right_id, score, reason.  An entity holds its variants (sorted by id) in one
    array, as the data model has it.  The rationale is the distinct reasons of its
    first pairs by (left_id, right_id).  Pairs with ids that no row has still link.
    """
    p = cut(pairs.filter("left_id is not null and right_id is not null and left_id <> right_id").select("left_id", "right_id", "score", "reason"), "accepted").df
    comp = cut(components(p, "left_id", "right_id"), "entities").df
    members = comp.join(rows.withColumnRenamed("silver_row_id", "id"), "id").withColumn("silver_row_id", F.col("id"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("id").alias("i"), F.struct(*VARIANT).alias("v"))))
    e = members.groupBy("component").agg(F.transform(ordered, lambda x: x["v"]).alias("store_variants"), F.countDistinct("store").alias("stores")).filter("stores >= 2")
    ids = comp.groupBy("component").agg(short_hash(F.collect_set("id")).alias("gold_product_id"))
    named = p.join(comp.select(F.col("id").alias("left_id"), "component"), "left_id")
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("component").orderBy("left_id", "right_id", "score", "reason"))).filter(F.col("_r") <= RATIONALE_PAIRS)
    why = first.groupBy("component").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_r", "reason"))), lambda x: x["reason"])), 1, RATIONALE_REASONS).alias("matching_rationale"))
    score = named.groupBy("component").agg(F.count(F.lit(1)).alias("component_pair_count"), F.min("score").alias("min_pair_score"), F.max("score").alias("max_pair_score"), F.bround(F.avg("score"), 2).alias("avg_pair_score"))
    d = e.join(ids, "component").join(score, "component").join(why, "component").withColumns(_canonical("store_variants"))
    return d.withColumn("confidence_score", F.col("min_pair_score")).orderBy(F.desc("confidence_score"), "gold_product_id")


def refreshed_entities(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities with repeated variants removed (the last one of an id stays), canonical values, id and confidence renewed.

    entities: gold_product_id, confidence_score, store_variants.  incoming:
    gold_product_id, score of decisions about them; the confidence becomes the
    smallest, where one of 0 or less counts as unset and is replaced.  An entity
    without any variant keeps its id and gets the name '' and no brand.
    """
    item = F.transform("store_variants", lambda v, i: F.struct(v["silver_row_id"].alias("k"), i.alias("i"), v.alias("v")))
    filled = F.filter(item, lambda x: F.coalesce(x["k"], F.lit("")) != "")
    # the last occurrence of each id: no later item has the same one
    d = entities.withColumn("_x", filled).withColumn("_last", F.map_from_entries(F.transform(F.array_distinct(F.transform("_x", lambda x: x["k"])), lambda k: F.struct(k, F.array_max(F.transform(F.filter("_x", lambda x: x["k"] == k), lambda x: x["i"]))))))
    kept = F.filter("_x", lambda x: F.element_at(F.col("_last"), x["k"]) == x["i"])
    placed = F.array_sort(F.transform(kept, lambda x: F.struct(F.coalesce(x["v"]["store"], F.lit("")).alias("s"), x["k"].alias("k"), x["i"].alias("i"))))
    d = d.withColumn("store_variants", F.transform(placed, lambda x: F.get("store_variants", x["i"])))
    ids = F.transform("store_variants", lambda v: v["silver_row_id"])
    base = F.array_min(F.transform("store_variants", lambda v: F.struct(F.size(F.coalesce(v["quality_flags"], F.array().cast("array<string>"))).alias("a"), (-F.length(F.coalesce(v["name_normalized"], F.lit("")))).alias("b"), v["silver_row_id"].alias("c"), v["name_normalized"].alias("n"), v["name_original"].alias("o"), v["brand_normalized"].alias("m"))))
    low = incoming.groupBy("gold_product_id").agg(F.min("score").alias("_in"))
    d = d.join(low, "gold_product_id", "left").withColumn("_b", base)
    own = F.when(F.col("confidence_score") > 0, F.col("confidence_score"))
    return d.select(
        F.col("gold_product_id").alias("old_id"), F.when(F.size(ids) > 0, short_hash(ids)).otherwise(F.col("gold_product_id")).alias("gold_product_id"),
        F.coalesce(F.least(own, F.col("_in")), F.lit(0)).alias("confidence_score"), F.coalesce(F.nullif("_b.n", F.lit("")), "_b.o", F.lit("")).alias("name_canonical"), F.coalesce("_b.m", F.lit(NO_BRAND)).alias("brand_canonical"),
        F.array_min(F.filter(F.transform("store_variants", lambda v: v["effective_price"]), lambda p: p > 0)).alias("price_reference"), "store_variants",
    )


def remaining_reviews(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """Items of the queue that nobody decided or whose last decision is to escalate.

    queue: review_item_id.  decided: review_item_id, seq, action.
    """
    last = decided.groupBy("review_item_id").agg(F.max(F.struct("seq", "action"))["action"].alias("_a"), F.lit(True).alias("_seen"))
    return queue.join(last, "review_item_id", "left").filter(F.col("_seen").isNull() | (F.col("_a") == "escalate")).drop("_a", "_seen")


def preview_topk(previews: DataFrame, threshold: int = 60, most: int = 400, fallback: int = 50) -> DataFrame:
    """The best pairs; only if none reaches the threshold, the best of those up to 30 below it, tagged.

    previews: left_id, right_id, score of all pairs down to ``max(25, threshold - 30)``.
    """
    any_ = previews.filter(F.col("score") >= threshold).limit(1).select(F.lit(True).alias("_any"))
    d = previews.join(any_, how="left")  # at most one row: no growth
    wanted = F.when(F.col("_any"), F.col("score") >= threshold).otherwise(F.col("score") >= max(25, threshold - 30))
    rank = d.filter(wanted).orderBy(F.desc("score"), "left_id", "right_id").limit(most)
    rank = rank.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), "left_id", "right_id")))  # over the few rows kept
    return rank.filter(F.col("_any") | (F.col("_r") <= min(most, fallback))).withColumn("fallback", F.col("_any").isNull()).drop("_any", "_r")


def integration_counters(entities: DataFrame, accepted: DataFrame) -> DataFrame:
    """How accepted pairs changed the entities, counted from the state before and after, whatever their order.

    entities: entity, member.  accepted: left_id, right_id.  ``created``: groups
    without an entity before; ``expanded``: entities that got new members;
    ``merged``: entities that went into another one; ``already_connected``: pairs
    of one entity; ``skipped``: pairs without an id, or of a record with itself.
    """
    own = cut(entities.filter("entity is not null and member is not null").distinct(), "members").df
    pairs = cut(accepted.select("left_id", "right_id"), "pairs").df
    ok = pairs.filter("left_id is not null and right_id is not null and left_id <> right_id").distinct()
    hub = own.groupBy("entity").agg(F.min("member").alias("a"))
    edges = own.join(hub, "entity").select("a", F.col("member").alias("b")).unionByName(ok.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    loose = hub.join(own.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter("n = 1"), "entity").select(F.col("a").alias("id"), F.col("a").alias("component"))
    after = components(edges, "a", "b")
    after = cut(after.unionByName(loose.join(after.select("id"), "id", "left_anti")), "after").df
    touched = ok.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().join(after, "id").select("component").distinct()
    of = own.join(after, own["member"] == after["id"])
    before = of.groupBy("component").agg(F.countDistinct("entity").alias("olds"))
    fresh = after.join(own.select(F.col("member").alias("id")).distinct(), "id", "left_anti").groupBy("component").agg(F.count(F.lit(1)).alias("new"))
    c = touched.join(before, "component", "left").join(fresh, "component", "left").fillna(0, ["olds", "new"]).agg(
        F.count_if(F.col("olds") == 0).alias("created"), F.count_if((F.col("olds") > 0) & (F.col("new") > 0)).alias("expanded"), F.coalesce(F.sum(F.greatest(F.col("olds") - 1, F.lit(0))), F.lit(0)).alias("merged")
    )
    l, r = own.select(F.col("member").alias("left_id"), "entity"), own.select(F.col("member").alias("right_id"), "entity")
    same = ok.join(l, "left_id").join(r, ["right_id", "entity"]).select("left_id", "right_id").distinct().agg(F.count(F.lit(1)).alias("already_connected"))
    bad = pairs.agg(F.count_if(F.col("left_id").isNull() | F.col("right_id").isNull() | (F.col("left_id") == F.col("right_id"))).alias("skipped"))
    return c.crossJoin(same).crossJoin(bad)  # one row each
