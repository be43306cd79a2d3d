"""SQL of the similarity queries: token-set ratio with a longest common subsequence computed row by row of its table."""

from __future__ import annotations

from cotejo.functions.catalog import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: rows of entity resolution as the queries read them, and their candidate pairs
_PAIRS = f"""p AS (SELECT p_partkey AS id, p_type AS store, upper(p_brand) AS brand, p_size AS size, p_retailprice AS price,
  array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: len(w) >= 3 AND w NOT IN ({_STOP})), ' ') AS name FROM part),
c AS (SELECT l.id AS left_id, r.id AS right_id, l.store AS left_store, r.store AS right_store, l.name AS nl, r.name AS nr, l.size AS sl, r.size AS sr, l.price AS pl, r.price AS pr
  FROM p l JOIN p r ON l.brand = r.brand AND l.store < r.store AND list_has_any(string_split(l.name, ' '), string_split(r.name, ' ')))"""


def token_set_sql(names: str) -> str:
    """CTEs up to ``t(nl, nr, ts, lev)`` for the distinct pairs of names that ``names`` selects."""
    rest = lambda a, b: f"array_to_string(list_sort(list_filter(list_distinct(string_split({a}, ' ')), lambda w: NOT list_contains(string_split({b}, ' '), w))), ' ')"
    return f"""n AS ({names}),
d AS (SELECT *, {rest('nl', 'nr')} AS ra, {rest('nr', 'nl')} AS rb,
  len(array_to_string(list_sort(list_filter(list_distinct(string_split(nl, ' ')), lambda w: list_contains(string_split(nr, ' '), w))), ' ')) AS s FROM n),
lc AS (SELECT ra, rb, 0 AS i, list_transform(range(0, len(rb) + 1), lambda x: 0::BIGINT) AS row FROM (SELECT DISTINCT ra, rb FROM d)
  UNION ALL SELECT ra, rb, i + 1, list_transform(range(0, len(rb) + 1), lambda j: greatest(row[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: rb[k] = ra[i + 1]), lambda k: row[k] + 1)), 0)))
  FROM lc WHERE i < len(ra)),
q AS (SELECT d.*, len(d.ra) AS la, len(d.rb) AS lb, CASE WHEN s > 0 THEN 1 ELSE 0 END AS g, lc.row[len(lc.rb) + 1] AS k FROM d JOIN lc ON lc.ra = d.ra AND lc.rb = d.rb AND lc.i = len(lc.ra)),
t AS (SELECT nl, nr, levenshtein(nl, nr) AS lev, CASE WHEN nl = '' OR nr = '' THEN 0 WHEN s > 0 AND (la = 0 OR lb = 0) THEN 100 ELSE round_even(100 * greatest(1 - (la + lb - 2 * k)::DOUBLE / (2 * (s + g) + la + lb),
  CASE WHEN s > 0 THEN greatest(1 - (g + la)::DOUBLE / (2 * s + g + la), 1 - (g + lb)::DOUBLE / (2 * s + g + lb)) ELSE 0 END), 0)::INT END AS ts FROM q)"""


_TS = token_set_sql("SELECT DISTINCT nl, nr FROM c")
SCORED = f"""WITH RECURSIVE {_PAIRS}, {_TS},
e AS (SELECT c.*, greatest(ts - CASE WHEN ts >= 50 THEN greatest((lev - 14) * 2, 0) ELSE 0 END, 0) AS name_score, CASE WHEN sl = sr THEN 100 ELSE 55 END AS numeric_score,
  sl <> sr AND abs(sl - sr)::DOUBLE / greatest(sl, sr) > 0.1 AS clash FROM c JOIN t USING (nl, nr)),
f AS (SELECT *, greatest(round_even((name_score * 65 + 100 * 20 + numeric_score * 10 + 70 * 5) / 100.0::DOUBLE, 0)::INT - CASE WHEN pl > 0 AND pr > 0 AND greatest(pl, pr) / least(pl, pr) > 3 THEN 15 ELSE 0 END, 0) AS score FROM e),
scored AS (SELECT left_id, right_id, left_store, right_store, name_score, 100 AS brand_score, numeric_score, 70 AS unit_score, 0 AS penalty, score, CASE WHEN clash THEN 'diametro' ELSE '' END AS conflicts,
  CASE WHEN clash THEN 'rejected' WHEN score >= 90 AND name_score >= 90 THEN 'confident' WHEN score >= 78 THEN 'review' ELSE 'rejected' END AS tier FROM f)"""

SQL: dict[str, str] = {
    "pair_scores": f"{SCORED} SELECT * FROM scored",
    "tier_counts": f"{SCORED} SELECT tier, conflicts <> '' AS numeric_conflict, count(*) AS pares, min(score) AS peor, max(score) AS mejor FROM scored GROUP BY 1, 2",
    "review_topk": f"{SCORED} SELECT * FROM scored WHERE tier = 'review' ORDER BY score DESC, left_id, right_id LIMIT 500",
    "preview_pairs": f"""WITH RECURSIVE {_PAIRS}, {_TS}
SELECT left_id, right_id, ts AS token_score, lev AS distance, round_even((ts * 75 + 100 * 15 + greatest(100 - lev * 3, 0) * 10) / 100.0::DOUBLE, 0)::INT AS score FROM c JOIN t USING (nl, nr)
WHERE ts >= 45 AND round_even((ts * 75 + 100 * 15 + greatest(100 - lev * 3, 0) * 10) / 100.0::DOUBLE, 0) >= 60""",
    "golden_records": f"""{SCORED},
sure AS (SELECT * FROM scored WHERE tier = 'confident'),
ed AS (SELECT left_id AS a, right_id AS b FROM sure UNION SELECT right_id, left_id FROM sure),
rc AS (SELECT DISTINCT a AS v, a AS u FROM ed UNION SELECT rc.v, ed.b FROM rc JOIN ed ON rc.u = ed.a),
comp AS (SELECT v AS id, min(u) AS component FROM rc GROUP BY v),
per AS (SELECT component, count(DISTINCT store) AS stores, count(*) AS members, arg_min(name, {{'b': -len(name), 'c': id}}) AS name, arg_min(brand, {{'b': -len(name), 'c': id}}) AS brand, min(price) FILTER (price > 0) AS price_reference,
  substr(sha1(string_agg(id::VARCHAR, '|' ORDER BY id::VARCHAR)), 1, 16) AS gold_id FROM comp JOIN p USING (id) GROUP BY 1),
s AS (SELECT component, count(*) AS pairs, min(score) AS min_score, max(score) AS max_score, round_even(avg(score), 2) AS avg_score FROM sure JOIN comp ON comp.id = sure.left_id GROUP BY 1)
SELECT * FROM per JOIN s USING (component) WHERE stores >= 2""",
    "similar_names": f"""WITH RECURSIVE w AS (SELECT DISTINCT lower(p_name) AS x FROM part), {token_set_sql("SELECT a.x AS nl, b.x AS nr FROM w a JOIN w b ON a.x < b.x AND list_has_any(string_split(a.x, ' '), string_split(b.x, ' '))")}
SELECT nl AS izquierda, nr AS derecha, ts AS puntaje, ts >= 60 AS similar FROM t""",
}
