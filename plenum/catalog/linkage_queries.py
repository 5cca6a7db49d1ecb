"""Queries on record linkage: parts against the same parts with mistakes in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import views as v
from plenum.operators import linkage as lk
from plenum.operators.matching import select_candidate

FIELDS = [lk.Field("name", "l_name", "r_name", close=0.75, counted=True), lk.Field("brand", "l_brand", "r_brand", close=0.85), lk.Field("price", "l_price", "r_price")]
# shares of the levels 0, 1 and 2 among matches and others, as a fit gives them
GIVEN = {"name": ((0.02, 0.38, 0.6), (0.85, 0.1, 0.05)), "brand": ((0.03, 0.07, 0.9), (0.6, 0.36, 0.04)), "price": ((0.2, 0.1, 0.7), (0.98, 0.01, 0.01))}
PRIOR = 0.05
WEIGHTS = lk.Weights({n: dict(enumerate(m)) for n, (m, _) in GIVEN.items()}, {n: dict(enumerate(u)) for n, (_, u) in GIVEN.items()}, PRIOR)


def pairs(spark, d, shared=False):
    """Parts of one type and size, the left ones with a letter dropped, a brand missing or a price off.

    ``shared`` adds the share of the left name among all parts.
    """
    p = v.table(spark, d, "part")
    key = F.col("p_partkey")
    price = F.round("p_retailprice", 1)
    block = [F.col("p_type").alias("type"), F.col("p_size").alias("size")]
    left = p.select(*block, key.alias("l_key"), F.when(key % 3 == 0, F.concat(F.substring("p_name", 1, 2), F.expr("substr(p_name, 4)"))).otherwise(F.col("p_name")).alias("l_name"),
                    F.when(key % 11 != 0, F.col("p_brand")).alias("l_brand"), F.when(key % 4 == 0, price + 1).otherwise(price).cast("decimal(12,1)").cast("string").alias("l_price"))
    right = p.select(*block, key.alias("r_key"), F.col("p_name").alias("r_name"), F.col("p_brand").alias("r_brand"), price.cast("decimal(12,1)").cast("string").alias("r_price"))
    if shared:
        left = lk.with_share(left, "l_name", lk.value_shares(p, "p_name"), "name_share")
    return lk.block_pairs(lk.cleaned(left, FIELDS, "left"), lk.cleaned(right, FIELDS, "right"), ["type", "size"], "l_key", carry=["l_key", "r_key"])


PAIRS = """p AS (SELECT p_partkey AS k, p_type AS type, p_size AS size, p_name, p_brand, round(p_retailprice, 1) AS price FROM part),
  l AS (SELECT type, size, k AS l_key, lower(CASE WHEN k % 3 = 0 THEN substr(p_name, 1, 2) || substr(p_name, 4) ELSE p_name END) AS a_name, CASE WHEN k % 11 <> 0 THEN lower(p_brand) END AS a_brand,
    (CASE WHEN k % 4 = 0 THEN price + 1 ELSE price END)::DECIMAL(12,1)::VARCHAR AS a_price FROM p),
  r AS (SELECT type, size, k AS r_key, lower(p_name) AS b_name, lower(p_brand) AS b_brand, price::DECIMAL(12,1)::VARCHAR AS b_price FROM p),
  levels AS (SELECT *, CASE WHEN a_name = b_name THEN 2 WHEN 1 - levenshtein(a_name, b_name)::DOUBLE / greatest(length(a_name), length(b_name)) >= 0.75 THEN 1 ELSE 0 END AS level_name,
    CASE WHEN a_brand IS NULL THEN -1 WHEN a_brand = b_brand THEN 2 WHEN 1 - levenshtein(a_brand, b_brand)::DOUBLE / greatest(length(a_brand), length(b_brand)) >= 0.85 THEN 1 ELSE 0 END AS level_brand,
    CASE WHEN a_price = b_price THEN 2 ELSE 0 END AS level_price FROM l JOIN r USING (type, size))"""


def _levels(spark, d, shared=False):
    return lk.with_levels(pairs(spark, d, shared), FIELDS)


def _scores(spark, d):
    return lk.score(_levels(spark, d, shared=True), FIELDS, WEIGHTS, {"name": "name_share"}, digits=6)


def _case(name: str) -> str:
    return f"CASE level_{name} " + " ".join(f"WHEN {x} THEN {WEIGHTS.weight(name, x)!r}::DOUBLE" for x in lk.LEVELS) + " ELSE 0 END"


SCORES = f"""WITH {PAIRS}, shares AS (SELECT lower(p_name) AS value, count(*) / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1),
  weighed AS (SELECT l_key, r_key, CASE WHEN level_name = 2 THEN greatest({WEIGHTS.weight('name', 2)!r}::DOUBLE, log2({WEIGHTS.matches['name'][2]!r}::DOUBLE / share)) ELSE {_case('name')} END + {_case('brand')} + {_case('price')} AS w
    FROM levels LEFT JOIN shares ON value = a_name)
  SELECT l_key, r_key, round(w, 6) AS match_weight, round(1 / (1 + pow(2, -(w + log2({PRIOR}::DOUBLE / (1 - {PRIOR}::DOUBLE))))), 6) AS match_probability FROM weighed"""


def _selected(spark, d):
    """Weights fitted on the pairs; the best record of each, and how many are right."""
    levels = _levels(spark, d, shared=True)
    # the best record and three others are selected, so four are enough of each tile
    scored = lk.score(levels, FIELDS, lk.fit(levels, FIELDS), {"name": "name_share"}, best=4, order="r_key")
    chosen = select_candidate(scored.withColumn("rank", F.col("r_key")), F.col("match_weight"), ["l_key"], ["r_key"])
    return chosen.agg(F.count("*").alias("records"), (F.avg((F.col("l_key") == F.col("r_key")).cast("int")) >= 0.8).alias("mostly_right"))


QUERIES = {
    "linkage_patterns": (lambda s, d: lk.pattern_counts(_levels(s, d), FIELDS), f"WITH {PAIRS} SELECT level_name, level_brand, level_price, count(*) AS pairs FROM levels GROUP BY ALL"),
    "linkage_scores": (_scores, SCORES),
    "linkage_selection": (_selected, "SELECT count(*) AS records, TRUE AS mostly_right FROM part"),
}
