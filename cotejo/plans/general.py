"""Queries of the general data-pipeline problems (2, 3, 6 and 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import units as u
from cotejo.operators.asof import attributes_at
from cotejo.operators.history import change_history, standing
from cotejo.operators.snapshots import canonical_product_url, pruning_report, snapshot_changes
from cotejo.operators.units import harmonise
from cotejo.sources.tables import table

PAIR = ["id_producto_maestro", "id_retailer"]
COMPARED = (
    "name", "brand", "sku_store", "precio_normal", "precio_internet", "precio_oferta", "precio_tarjeta", "precio_unitario", "unidad_medida", "image_url", "disponibilidad",
)


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "precio_retailer").filter("precio_clp > 0")
    return p.select(
        *PAIR, "fecha_captura", "id_precio", F.round("precio_clp", 0).cast("bigint").alias("precio"), F.coalesce("disponibilidad", F.lit(True)).alias("disponible"), "precio_clp"
    )


def p2_history(spark: SparkSession, sf: str) -> DataFrame:
    """Every version of price and availability of each product at each retailer."""
    v = _versions(spark, sf)
    return v.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return change_history(_captures(spark, sf), PAIR, "fecha_captura", "id_precio", ["precio", "disponible"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    v = _versions(spark, sf)
    return v.select(*PAIR, F.col("first_id").alias("id_precio_desde"), F.coalesce("next_id", F.lit(0)).alias("id_precio_hasta"))


def _known(spark: SparkSession, sf: str, attributes: list[str]) -> DataFrame:
    quotes = table(spark, sf, "cotizacion").filter("fecha_creacion is not null").select("id_cotizacion", "fecha_creacion")
    lines = table(spark, sf, "detalle_cotizacion").select("id_detalle", "id_cotizacion", *PAIR).join(quotes, "id_cotizacion")
    rows = _captures(spark, sf)
    if attributes != ["id_precio"]:
        rows = standing(rows, PAIR, "fecha_captura", "id_precio", ["precio_clp", "disponible"])
    return attributes_at(rows, lines, PAIR, "fecha_captura", attributes, "id_detalle", "fecha_creacion", "id_precio")


def p3_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Each quote line with capture, price and availability as known when the quote was made."""
    return _known(spark, sf, ["id_precio", "precio_clp", "disponible"]).withColumn("precio_clp", F.col("precio_clp").cast("double"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf, ["id_precio"]).select("id_detalle", "id_precio")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    same = table(spark, sf, "gold_products").select(F.col("gold_product_id").alias("entity"), F.explode("store_variants.silver_row_id").alias("silver_row_id"))
    b, m = harmonise(table(spark, sf, "bronze_product"), table(spark, sf, "producto_maestro"), table(spark, sf, "unit_target"), same)
    b = b.select(F.lit("bronze_product").alias("tabla"), F.col("silver_row_id").alias("clave"), "unidad_comun", "valor")
    m = m.select(F.lit("producto_maestro").alias("tabla"), F.col("id_producto").cast("string").alias("clave"), "unidad_comun", "valor")
    return b.unionByName(m).dropDuplicates()


def _deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bronze_snapshot").withColumn("_url", canonical_product_url(F.col("product_url")))


def p7_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of both deliveries, and those that reach the row comparison."""
    return pruning_report(_deliveries(spark, sf), "store", "snapshot_date", "_url", COMPARED)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(_deliveries(spark, sf), "store", "snapshot_date", "_url", COMPARED).select("store", F.col("_url").alias("product_url"), "snapshot_date", F.col("change").alias("cambio"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_history": p2_history,
    "p3_found": p3_found,
    "p3_attributes": p3_attributes,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_pruning": p7_pruning,
}

_STANDING = """
c AS (
  SELECT id_producto_maestro, id_retailer, fecha_captura, id_precio, precio_clp, round(precio_clp, 0)::BIGINT AS precio, coalesce(disponibilidad, true) AS disponible
  FROM precio_retailer WHERE precio_clp > 0
  QUALIFY row_number() OVER (PARTITION BY id_producto_maestro, id_retailer, fecha_captura ORDER BY id_precio DESC) = 1)"""
_VERSIONS = f"""WITH {_STANDING},
l AS (
  SELECT *, lag(precio) OVER w AS p0, lag(disponible) OVER w AS d0, row_number() OVER w AS n
  FROM c WINDOW w AS (PARTITION BY id_producto_maestro, id_retailer ORDER BY fecha_captura)),
v AS (SELECT * FROM l WHERE n = 1 OR p0 <> precio OR d0 <> disponible)"""

SQL: dict[str, str] = {
    "p2_found": f"""{_VERSIONS}
SELECT id_producto_maestro, id_retailer, id_precio AS id_precio_desde,
  coalesce(lead(id_precio) OVER (PARTITION BY id_producto_maestro, id_retailer ORDER BY fecha_captura), 0) AS id_precio_hasta FROM v""",
    "p2_history": f"""{_VERSIONS}
SELECT id_producto_maestro, id_retailer, fecha_captura AT TIME ZONE 'UTC' AS valid_from, lead(fecha_captura AT TIME ZONE 'UTC') OVER w AS valid_to, id_precio AS first_id, lead(id_precio) OVER w AS next_id, precio, disponible
FROM v WINDOW w AS (PARTITION BY id_producto_maestro, id_retailer ORDER BY fecha_captura)""",
    "p3_found": f"""WITH {_STANDING}
SELECT d.id_detalle, c.id_precio
FROM detalle_cotizacion d JOIN cotizacion q ON q.id_cotizacion = d.id_cotizacion AND q.fecha_creacion IS NOT NULL
ASOF JOIN c ON c.id_producto_maestro = d.id_producto_maestro AND c.id_retailer = d.id_retailer AND q.fecha_creacion >= c.fecha_captura""",
    "p3_attributes": f"""WITH {_STANDING}
SELECT d.id_detalle, c.id_precio, c.precio_clp::DOUBLE AS precio_clp, c.disponible
FROM detalle_cotizacion d JOIN cotizacion q ON q.id_cotizacion = d.id_cotizacion AND q.fecha_creacion IS NOT NULL
ASOF JOIN c ON c.id_producto_maestro = d.id_producto_maestro AND c.id_retailer = d.id_retailer AND q.fecha_creacion >= c.fecha_captura""",
    "p7_found": """WITH r AS (
  SELECT DISTINCT store, snapshot_date,
    regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1), '/+$', '') AS k,
    hash(name, brand, sku_store, precio_normal, precio_internet, precio_oferta, precio_tarjeta, precio_unitario, unidad_medida, image_url, disponibilidad) AS h
  FROM (SELECT *, regexp_replace(trim(product_url), '[?#].*$', '') AS u FROM bronze_snapshot)),
s AS (SELECT store, snapshot_date, lag(snapshot_date) OVER (PARTITION BY store ORDER BY snapshot_date) AS p FROM (SELECT DISTINCT store, snapshot_date FROM r)),
x AS (
  SELECT coalesce(a.store, b.store) AS store, coalesce(a.k, b.k) AS product_url, coalesce(a.snapshot_date, b.snapshot_date) AS snapshot_date,
    CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' END AS cambio
  FROM (SELECT r.* FROM r JOIN s USING (store, snapshot_date) WHERE p IS NOT NULL) a
  FULL JOIN (SELECT r.store, s.snapshot_date, r.k, r.h FROM r JOIN s ON s.store = r.store AND s.p = r.snapshot_date) b
  ON a.store = b.store AND a.snapshot_date = b.snapshot_date AND a.k = b.k)
SELECT * FROM x WHERE cambio IS NOT NULL""",
}

_FOLD = "trim(regexp_replace(translate(strip_accents(lower(regexp_replace(replace(replace({0}, '&quot;', '\"'), '&amp;', '&'), '&([a-zA-Z])(acute|tilde);', '\\1', 'g'))), '²³', '23'), '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_MAP = ", ".join(f"('{name}', '{common}', {factor:f})" for name, (common, factor) in u.NAMES.items())
_SMALL = ", ".join(f"'{x}'" for x in u.SMALL)


def _number_sql(text: str, stem: str) -> str:
    top = f"regexp_extract({text}, '^([\\d.,]+)', 1)"
    below = f"regexp_extract({text}, '/\\s*(\\d+)\\s*$', 1)"
    plain = f"CASE WHEN {stem} IN ({_SMALL}) AND regexp_full_match({top}, '[1-9]\\d{{0,2}}(?:\\.\\d{{3}})+') THEN replace({top}, '.', '') ELSE replace({top}, ',', '.') END"
    return f"TRY_CAST({plain} AS DOUBLE) / CASE WHEN {below} = '' THEN 1 ELSE nullif(TRY_CAST({below} AS DOUBLE), 0) END"


def _stated_sql(common: str) -> tuple[str, str]:
    rx = f"(?:^|[^\\d.,/a-z])({u.NUMBER})\\s*({u._GROUPS[common]})(?:[^a-z0-9]|$)"
    return f"regexp_extract(n, '{rx}', 1)", f"regexp_extract(n, '{rx}', 2)"


_KG, _LT = _stated_sql("kg"), _stated_sql("lt")
SQL["p6_found"] = f"""WITH f(stem, comun, factor) AS (VALUES {_MAP}),
b AS (SELECT silver_row_id, precio_unitario AS p, CASE WHEN unidad_medida IS NULL THEN regexp_extract({_FOLD.format('name')}, '{u.PRICE_PER}', 1) ELSE {_FOLD.format('unidad_medida')} END AS t FROM bronze_product WHERE precio_unitario > 0),
r AS (SELECT *, regexp_extract(t, '{u.PHRASE}', 1) AS pk, regexp_extract(t, '{u.PHRASE}', 2) AS num, regexp_extract(t, '{u.PHRASE}', 3) AS st, regexp_extract(t, '^({u.STEM})\\s*\\.?$', 1) AS whole FROM b),
g AS (SELECT silver_row_id, p, CASE WHEN whole IN (SELECT stem FROM f) THEN whole WHEN pk = '' OR num <> '' THEN st END AS stem,
  CASE WHEN whole IN (SELECT stem FROM f) OR num = '' THEN 1 ELSE {_number_sql('num', 'st')} END AS q FROM r),
d AS (SELECT silver_row_id, comun, p, round(q * factor * 1000000000000)::HUGEINT AS d FROM g JOIN f USING (stem)),
m AS (SELECT id_producto, valor_medida, nombre_unidad, {_FOLD.format('nombre_producto')} AS n FROM producto_maestro LEFT JOIN unit_target USING (id_unidad)),
k AS (SELECT id_producto, valor_medida, uf.comun AS uc, uf.factor AS ufac, kf.comun AS kc, {_number_sql(_KG[0], _KG[1])} * kf.factor AS kv, lf.comun AS lc, {_number_sql(_LT[0], _LT[1])} * lf.factor AS lv
  FROM m LEFT JOIN f uf ON uf.stem = lower(strip_accents(nombre_unidad)) LEFT JOIN f kf ON kf.stem = {_KG[1]} LEFT JOIN f lf ON lf.stem = {_LT[1]})
SELECT DISTINCT 'bronze_product' AS tabla, silver_row_id AS clave, comun AS unidad_comun, ((2 * p::HUGEINT * 1000000000000 + d) // (2 * d))::BIGINT AS valor FROM d WHERE d > 0
UNION ALL SELECT 'producto_maestro', id_producto::VARCHAR, CASE WHEN valor_medida IS NOT NULL AND uc IS NOT NULL THEN uc ELSE coalesce(kc, lc) END,
  floor(round(CASE WHEN valor_medida IS NOT NULL AND uc IS NOT NULL THEN valor_medida * ufac ELSE coalesce(kv, lv) END::DOUBLE * 1000000, 4) + 0.5)::BIGINT FROM k WHERE (valor_medida IS NOT NULL AND uc IS NOT NULL) OR kv IS NOT NULL OR lv IS NOT NULL"""
