"""Queries of the silver and gold stages over whole domain tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import catalog as fn
from cotejo.operators import entities as gold
from cotejo.operators import matching, silver
from cotejo.plans.reference import _BRAND_SQL, _EFF_SQL, _NAME_SQL, _SPEC_SQL, _UNIT_SQL, _bronze, _BRONZE, _part_rows, _PLAIN_SQL
from cotejo.plans.scores_sql import _PAIRS, _TS
from cotejo.session import cut
from cotejo.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GENERATED = "2026-07-01T00:00:00+00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _hints(spark):
    return spark.createDataFrame([], "store string, product_url string, category_url string")


def _silver(spark, sf):
    return silver.silver_rows(_bronze(spark, sf), _hints(spark), GENERATED)


_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_URL = "regexp_replace(regexp_replace(trim(coalesce(product_url, '')), '[?#].*$', ''), '(/p)(/p)+$', '/p')"
_OWN_CAT = "CASE WHEN p LIKE '%/articulo/%' THEN '' ELSE coalesce(replace(nullif(sg[1], 'p'), '-', ' '), '') END"
_SILVER = f"""(SELECT substr(sha1(store || '|' || sku || '|' || url), 1, 16) AS silver_row_id, store, name_original, name_normalized, brand_original, brand_normalized, sku AS sku_store, url AS product_url,
  precio_normal, precio_internet, precio_oferta, precio_tarjeta, precio_unitario, un AS unidad_medida, precio_unitario_fuente, image_url, e AS effective_price, {_OWN_CAT} AS category_normalized,
  CASE WHEN {_OWN_CAT} <> '' THEN 'product_url' ELSE 'empty' END AS category_source, specs AS numeric_specs, store AS raw_source_store, store || '_products.json' AS raw_source_file, '{GENERATED}' AS generated_at_utc,
  array_to_string(list_filter([CASE WHEN brand_normalized = 'SIN MARCA' THEN 'missing_brand' END, CASE WHEN sku = '' THEN 'missing_sku' END, CASE WHEN e IS NULL THEN 'missing_effective_price' END,
    CASE WHEN un IS NULL AND precio_unitario IS NOT NULL THEN 'unknown_unit' END, CASE WHEN name_normalized = '' THEN 'empty_name_normalized' END], lambda x: x IS NOT NULL), ',') AS quality_flags, old_id
FROM (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS sg, {_UNIT_SQL} AS un FROM (
  SELECT *, silver_row_id AS old_id, {_CLEAN.format('name')} AS name_original, {_CLEAN.format('brand')} AS brand_original, {_CLEAN.format('sku_store')} AS sku, {_URL} AS url, regexp_extract({_URL}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1) AS p,
    array_to_string({_NAME_SQL}, ' ') AS name_normalized, {_BRAND_SQL} AS brand_normalized, {_EFF_SQL} AS e, regexp_replace(translate(lower(unidad_medida), '²³', '23'), '[^a-z0-9]', '', 'g') AS u,
    (SELECT {_SPEC_SQL} FROM (SELECT {_PLAIN_SQL.format('name')} AS t)) AS specs FROM {_BRONZE})))"""


@query(f"SELECT * EXCLUDE (old_id) FROM {_SILVER}")
def silver_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All 24 columns; measures and flags as text."""
    return _silver(spark, sf).withColumn("numeric_specs", fn.spec_text(F.col("numeric_specs"))).withColumn("quality_flags", F.array_join("quality_flags", ","))


@query(f"SELECT store, count(*) AS total_rows, count(effective_price) AS with_effective_price, count(*) FILTER (brand_normalized <> 'SIN MARCA') AS with_brand_normalized, count(*) FILTER (numeric_specs <> '') AS with_numeric_specs, count(precio_unitario) AS with_unit_price FROM {_SILVER} GROUP BY 1")
def silver_quality(spark: SparkSession, sf: str) -> DataFrame:
    return silver.silver_metrics(_silver(spark, sf))


@query("""SELECT store, array_to_string(list_filter([CASE WHEN trim(coalesce(name, '')) = '' THEN 'name' END, CASE WHEN trim(coalesce(brand, '')) = '' THEN 'brand' END, CASE WHEN trim(regexp_replace(coalesce(sku_store, ''), '\\s+', ' ', 'g')) = '' THEN 'sku_store' END], lambda x: x IS NOT NULL), ',') AS faltan, count(*) AS filas
FROM bronze_product GROUP BY 1, 2""")
def missing_field_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields listings leave blank, by the check that normalised rows must pass."""
    d = table(spark, sf, "bronze_product").withColumn("faltan", F.array_join(silver.missing_fields(("name", "brand", "sku_store")), ","))
    return d.groupBy("store", "faltan").agg(F.count(F.lit(1)).alias("filas"))


@query(f"SELECT silver_row_id, store, name_normalized FROM {_SILVER}")
def silver_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised rows through the fail-fast check, by id."""
    return silver.checked_silver(_silver(spark, sf)).select("silver_row_id", "store", "name_normalized")


@query(f"SELECT silver_row_id, min(old_id) AS primero, count(*) AS veces FROM {_SILVER} GROUP BY 1")
def silver_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Keep-first by row id, in the order of the listings' own ids."""
    b = _bronze(spark, sf)
    d = b.select("store", fn.short_id(F.col("store"), F.coalesce(fn.clean_text("sku_store"), F.lit("")), fn.canonical_url(F.col("product_url"))).alias("silver_row_id"), F.col("silver_row_id").alias("primero"))
    n = d.groupBy("silver_row_id").agg(F.count(F.lit(1)).alias("veces"))
    return silver.first_of_each_id(d, "silver_row_id", ["primero"]).select("silver_row_id", "primero").join(n, "silver_row_id")


def _accepted(spark, sf):
    d = table(spark, sf, "gold_review_llm_decisions").filter("auto_action = 'accept'")
    return d.select(F.col("left_product.silver_row_id").alias("left_id"), F.col("right_product.silver_row_id").alias("right_id"), F.col("gold_confidence_score").alias("score"), F.col("llm_reason").alias("reason")).distinct()


_ACC = """a AS (SELECT DISTINCT left_product.silver_row_id AS l, right_product.silver_row_id AS r, gold_confidence_score AS score, llm_reason AS reason FROM gold_review_llm_decisions
  WHERE auto_action = 'accept' AND left_product.silver_row_id IS NOT NULL AND right_product.silver_row_id IS NOT NULL AND left_product.silver_row_id <> right_product.silver_row_id),
ed AS (SELECT l AS x, r AS y FROM a UNION SELECT r, l FROM a), rc AS (SELECT DISTINCT x AS v, x AS u FROM ed UNION SELECT rc.v, ed.y FROM rc JOIN ed ON rc.u = ed.x),
comp AS (SELECT v AS id, min(u) AS component FROM rc GROUP BY v)"""


@query(f"""WITH RECURSIVE {_ACC}, s AS (SELECT * EXCLUDE (silver_row_id), old_id AS id FROM {_SILVER}), m AS (SELECT * FROM comp JOIN s USING (id)),
f AS (SELECT *, CASE WHEN quality_flags = '' THEN 0 ELSE len(string_split(quality_flags, ',')) END AS nf FROM m),
e AS (SELECT component, string_agg(store || ':' || id, ' ' ORDER BY id) AS variantes, count(DISTINCT store) AS stores, arg_min(id, {{'a': nf, 'b': -len(name_normalized), 'c': id}}) AS base_row_id,
  arg_min(name_normalized, {{'a': nf, 'b': -len(name_normalized), 'c': id}}) AS nombre, arg_min(brand_normalized, {{'a': nf, 'b': -len(name_normalized), 'c': id}}) AS marca, arg_min(image_url, id) FILTER (coalesce(image_url, '') <> '') AS imagen,
  min(effective_price) FILTER (effective_price > 0) AS precio FROM f GROUP BY 1),
g AS (SELECT component, substr(sha1(string_agg(id, '|' ORDER BY id)), 1, 16) AS gold_product_id FROM comp GROUP BY 1),
n AS (SELECT a.*, component, row_number() OVER (PARTITION BY component ORDER BY l, r, score, reason) AS k FROM a JOIN comp ON comp.id = a.l),
w AS (SELECT component, string_agg(reason, '|' ORDER BY k) AS motivos FROM (SELECT component, reason, min(k) AS k FROM n WHERE k <= 5 GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT component, count(*) AS pares, min(score) AS peor, max(score) AS mejor, round_even(avg(score), 2) AS media FROM n GROUP BY 1)
SELECT gold_product_id, peor AS confianza, base_row_id, nombre, marca, imagen, precio, variantes, motivos, pares, mejor, media FROM e JOIN g USING (component) JOIN w USING (component) JOIN q USING (component) WHERE stores >= 2""")
def gold_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Complete golden entities of the accepted decisions, surest first."""
    rows = _bronze(spark, sf).withColumnRenamed("silver_row_id", "old_id")
    s = _silver_of(spark, rows)
    e = gold.golden_entities(s, _accepted(spark, sf))
    return e.select(
        "gold_product_id", F.col("confidence_score").alias("confianza"), "base_row_id", F.col("name_canonical").alias("nombre"), F.col("brand_canonical").alias("marca"), F.col("image_url").alias("imagen"), F.col("price_reference").alias("precio"),
        F.array_join(F.transform("store_variants", lambda v: F.concat(v["store"], F.lit(":"), v["silver_row_id"])), " ").alias("variantes"), F.array_join("matching_rationale", "|").alias("motivos"), F.col("component_pair_count").alias("pares"),
        F.col("max_pair_score").alias("mejor"), F.col("avg_pair_score").alias("media"),
    )


def _silver_of(spark, rows):
    """Normalised columns of listings that keep the id they came with (``old_id``)."""
    text = lambda c: fn.clean_text(F.coalesce(F.col(c), F.lit("")))
    d = rows.select(
        F.col("old_id").alias("silver_row_id"), "store", text("name").alias("name_original"), fn.normalize_name(F.col("name")).alias("name_normalized"), text("brand").alias("brand_original"), fn.normalize_brand(F.col("brand")).alias("brand_normalized"),
        text("sku_store").alias("sku_store"), "product_url", fn.effective_price(*(F.col(p) for p in silver.PRICES)).alias("effective_price"), fn.normalize_unit(F.col("unidad_medida")).alias("unidad_medida"), "precio_unitario", "image_url",
        fn.category_from_url(F.col("product_url")).alias("category_normalized"),
    )
    return d.withColumn("quality_flags", fn.quality_flags(*(F.col(c) for c in ("brand_normalized", "sku_store", "effective_price", "unidad_medida", "precio_unitario", "name_normalized"))))


_REFRESH = """v AS (SELECT gold_product_id AS g, confidence_score AS c, unnest(store_variants) AS v, generate_subscripts(store_variants, 1) AS i FROM gold_products),
k AS (SELECT * FROM v WHERE coalesce(v.silver_row_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY g, v.silver_row_id ORDER BY i DESC) = 1)"""


@query(f"""WITH {_REFRESH}, r AS (SELECT g, min(c) AS c, substr(sha1(string_agg(v.silver_row_id, '|' ORDER BY v.silver_row_id)), 1, 16) AS id, count(*) AS n, min(v.effective_price) FILTER (v.effective_price > 0) AS p,
  arg_min({{'n': v.name_normalized, 'o': v.name_original, 'm': v.brand_normalized}}, {{'a': coalesce(len(v.quality_flags), 0), 'b': -len(coalesce(v.name_normalized, '')), 'c': v.silver_row_id}}) AS b FROM k GROUP BY 1)
SELECT gold_product_id AS old_id, coalesce(r.id, gold_product_id) AS gold_product_id, CASE WHEN confidence_score > 0 THEN least(confidence_score, 88) ELSE 88 END AS confianza, coalesce(nullif(b.n, ''), b.o, '') AS nombre, coalesce(b.m, 'SIN MARCA') AS marca, p AS precio, coalesce(n, 0) AS variantes
FROM gold_products LEFT JOIN r ON r.g = gold_product_id""")
def entity_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Every entity renewed as if a decision of score 88 had come in for it."""
    g = table(spark, sf, "gold_products")
    d = gold.refreshed_entities(g.select("gold_product_id", "confidence_score", "store_variants"), g.select("gold_product_id", F.lit(88).alias("score")))
    return d.select("old_id", "gold_product_id", F.col("confidence_score").alias("confianza"), F.col("name_canonical").alias("nombre"), F.col("brand_canonical").alias("marca"), F.col("price_reference").alias("precio"), F.size("store_variants").cast("bigint").alias("variantes"))


@query("""WITH RECURSIVE own AS (SELECT DISTINCT gold_product_id AS e, unnest(store_variants).silver_row_id AS m FROM gold_products), ok0 AS (SELECT left_product.silver_row_id AS l, right_product.silver_row_id AS r FROM gold_review_llm_decisions WHERE auto_action = 'accept'),
ok AS (SELECT DISTINCT * FROM ok0 WHERE l IS NOT NULL AND r IS NOT NULL AND l <> r), hub AS (SELECT e, min(m) AS a FROM own WHERE m IS NOT NULL GROUP BY 1),
ed0 AS (SELECT a AS x, m AS y FROM own JOIN hub USING (e) WHERE m IS NOT NULL UNION SELECT l, r FROM ok), ed AS (SELECT x, y FROM ed0 UNION SELECT y, x FROM ed0),
rc AS (SELECT DISTINCT x AS v, x AS u FROM ed UNION SELECT rc.v, ed.y FROM rc JOIN ed ON rc.u = ed.x), comp AS (SELECT v AS id, min(u) AS c FROM rc GROUP BY v),
t AS (SELECT DISTINCT c FROM comp JOIN ok ON comp.id = ok.l), b AS (SELECT c, count(DISTINCT e) AS olds FROM own JOIN comp ON comp.id = own.m GROUP BY 1), f AS (SELECT c, count(*) AS fresh FROM comp WHERE id NOT IN (SELECT m FROM own WHERE m IS NOT NULL) GROUP BY 1)
SELECT (SELECT count(*) FROM t LEFT JOIN b USING (c) WHERE b.c IS NULL) AS created, (SELECT count(*) FROM t JOIN b USING (c) JOIN f USING (c)) AS expanded, (SELECT coalesce(sum(olds - 1), 0)::BIGINT FROM t JOIN b USING (c)) AS merged,
(SELECT count(*) FROM (SELECT DISTINCT l, r FROM ok JOIN own x ON x.m = ok.l JOIN own y ON y.m = ok.r AND y.e = x.e)) AS already_connected, (SELECT count(*) FROM ok0 WHERE l IS NULL OR r IS NULL OR l = r) AS skipped""")
def integration_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "gold_products").select(F.col("gold_product_id").alias("entity"), F.explode("store_variants.silver_row_id").alias("member"))
    d = table(spark, sf, "gold_review_llm_decisions").filter("auto_action = 'accept'")
    return gold.integration_counters(own, d.select(F.col("left_product.silver_row_id").alias("left_id"), F.col("right_product.silver_row_id").alias("right_id")))


@query("""WITH d AS (SELECT review_item_id, arg_max(coalesce(auto_action, ''), {'s': llm_confidence, 'a': coalesce(auto_action, '')}) AS a FROM gold_review_llm_decisions WHERE auto_action IS NOT NULL OR error IS NULL GROUP BY 1)
SELECT DISTINCT q.review_item_id FROM gold_review_llm_decisions q LEFT JOIN d USING (review_item_id) WHERE d.review_item_id IS NULL OR d.a = 'escalate'""")
def remaining_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Review items left over: undecided (no action and an error) or escalated."""
    d = table(spark, sf, "gold_review_llm_decisions")
    done = d.filter("auto_action is not null or error is null").select("review_item_id", F.col("llm_confidence").alias("seq"), F.coalesce("auto_action", F.lit("")).alias("action"))
    return gold.remaining_reviews(d.select("review_item_id").distinct(), done)


@query("SELECT DISTINCT review_item_id, left_product.silver_row_id AS izquierda, right_product.silver_row_id AS derecha FROM gold_review_llm_decisions WHERE auto_action = 'accept' ORDER BY 1")
def accepted_by_id(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "gold_review_llm_decisions").filter("auto_action = 'accept'")
    return d.select("review_item_id", F.col("left_product.silver_row_id").alias("izquierda"), F.col("right_product.silver_row_id").alias("derecha")).distinct().orderBy("review_item_id")


@query(f"""WITH RECURSIVE {_PAIRS}, {_TS}, s AS (SELECT left_id, right_id, round_even((ts * 75 + 100 * 15 + greatest(100 - lev * 3, 0) * 10) / 100.0::DOUBLE, 0)::INT AS score FROM c JOIN t USING (nl, nr) WHERE ts >= 45)
SELECT left_id, right_id, score, NOT EXISTS (SELECT 1 FROM s WHERE score >= 60) AS fallback FROM s WHERE score >= CASE WHEN EXISTS (SELECT 1 FROM s WHERE score >= 60) THEN 60 ELSE 30 END ORDER BY score DESC, left_id, right_id LIMIT 400""")
def preview_best(spark: SparkSession, sf: str) -> DataFrame:
    """The 400 best previews: the limit is the feature."""
    return gold.preview_topk(cut(matching.best_previews(_part_rows(spark, sf), 60, 30, 400), "previews").df)


@query("""WITH t AS (SELECT p_type AS s, upper(p_brand) AS b, lower(p_name) AS n, count(*) AS k FROM part GROUP BY ALL)
SELECT CASE WHEN l.b <> r.b THEN 'brand_mismatch' ELSE 'passed' END AS regla, sum(l.k * r.k)::BIGINT AS pares FROM t l JOIN t r ON l.s < r.s AND list_has_any(string_split(l.n, ' '), string_split(r.n, ' ')) GROUP BY 1""")
def blocking_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that share a word, by the first rule that stops them; equal rows are counted, not paired."""
    return matching.blocking_counts(_part_rows(spark, sf)).select(F.col("rule").alias("regla"), F.col("pairs").alias("pares"))
