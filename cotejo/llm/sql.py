"""SQL equivalents of the llm queries, where SQL can say the same on whole tables."""

SQL: dict[str, str] = {
    "p4_found": """WITH RECURSIVE e0 AS (
  SELECT lower(trim(left_product.silver_row_id)) AS a, lower(trim(right_product.silver_row_id)) AS b FROM gold_review_llm_decisions WHERE auto_action = 'accept'
  UNION ALL
  SELECT lower(trim(m)), lower(trim(h)) FROM (SELECT unnest(store_variants).silver_row_id AS m, store_variants[1].silver_row_id AS h FROM gold_products)),
e AS (
  SELECT a, b FROM e0 WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM e0 WHERE a <> '' AND b <> '' AND a <> b),
r AS (SELECT DISTINCT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT v AS silver_row_id, min(u) AS group_row_id FROM r GROUP BY v""",
    "p5_found": """WITH b AS (
  SELECT * FROM bronze_product QUALIFY row_number() OVER (PARTITION BY silver_row_id ORDER BY fecha_ultima_revision DESC NULLS LAST) = 1),
c AS (
  SELECT DISTINCT g.gold_product_id, b.silver_row_id, b.fecha_ultima_revision AS f, s.trust_rank AS t,
    coalesce(regexp_replace(strip_accents(lower(b.brand)), '[^a-z0-9]', '', 'g') NOT IN ('', 'sinmarca', 'sm', 'na', 'noinforma', 'generico'), false) AS br,
    coalesce(regexp_matches(b.image_url, '^https?://[^/?#]+/[^?#]*\\.(jpg|jpeg|png|webp|gif|svg)$') AND NOT regexp_matches(b.image_url, 'placeholder|no-image|sin-foto'), false) AS im,
    coalesce(trim(b.unidad_medida) <> '', false)::INT + coalesce(regexp_replace(b.sku_store, '\\s', '', 'g') <> '', false)::INT
      + (greatest(coalesce(precio_normal, 0), coalesce(precio_internet, 0), coalesce(precio_oferta, 0), coalesce(precio_tarjeta, 0)) > 0)::INT AS n
  FROM (SELECT gold_product_id, unnest(store_variants).silver_row_id AS id FROM gold_products) g
  JOIN b ON b.silver_row_id = g.id LEFT JOIN store_rank s ON s.store = b.store),
o AS (
  SELECT *, row_number() OVER (PARTITION BY gold_product_id ORDER BY f DESC NULLS LAST, t NULLS LAST, silver_row_id) AS p FROM c)
SELECT gold_product_id, arg_min(silver_row_id, -1000000 * (n + br::INT + im::INT) + p) AS base_row_id,
  coalesce(arg_min(silver_row_id, p) FILTER (br), '') AS brand_row_id, coalesce(arg_min(silver_row_id, p) FILTER (im), '') AS image_row_id
FROM o GROUP BY gold_product_id""",
}
