"""The taxonomy's checks over all parts, read as items with parents, formulas and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint as op
from ..sources import roles
from .base import query

CATEGORIES = ["ECONOMY", "SMALL", "STANDARD", "LARGE"]
ITEMS = """raw AS (SELECT CASE WHEN p_partkey % 89 = 5 THEN 'c' || (p_partkey - 1) ELSE 'c' || p_partkey END AS canonical_name, p_type AS category, CASE WHEN p_partkey % 31 <> 0 THEN p_name END AS display_name, [p_name || ' ' || p_partkey % 300] AS aliases, CASE WHEN p_partkey % 47 <> 0 THEN p_brand END AS definition, 'positive' AS typical_sign,
 CASE WHEN p_partkey = 1 THEN 'c2' WHEN p_partkey = 2 THEN 'c1' WHEN p_partkey % 4 = 0 THEN NULL ELSE 'c' || (p_partkey * 5 + 1) % 2100 END AS parent_canonical, CASE WHEN p_partkey % 20 = 7 THEN 'revenue - abs(other_cost)' END AS derivation, CASE WHEN p_partkey % 25 = 0 THEN [upper(p_name), 'x'] END AS ocr_variants FROM part)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, s = F.col("p_partkey"), F.col("p_name"), lambda c: c.cast("string")
    c = lambda x: F.concat(F.lit("c"), s(x))
    return roles.table(spark, sf_dir, "part").select(
        F.when(k % 89 == 5, c(k - 1)).otherwise(c(k)).alias("canonical_name"), F.col("p_type").alias("category"), F.when(k % 31 != 0, name).alias("display_name"), F.array(F.concat(name, F.lit(" "), s(k % 300))).alias("aliases"), F.when(k % 47 != 0, F.col("p_brand")).alias("definition"),
        F.lit("positive").alias("typical_sign"), F.when(k == 1, "c2").when(k == 2, "c1").when(k % 4 != 0, c((k * 5 + 1) % 2100)).alias("parent_canonical"), F.when(k % 20 == 7, "revenue - abs(other_cost)").alias("derivation"), F.when(k % 25 == 0, F.array(F.upper(name), F.lit("x"))).alias("ocr_variants"),
    )


#: Of names that are there twice the least row counts, with null before all values.
ONE = "one AS (SELECT * FROM raw QUALIFY ROW_NUMBER() OVER (PARTITION BY canonical_name ORDER BY category NULLS FIRST, display_name NULLS FIRST, aliases NULLS FIRST, parent_canonical NULLS FIRST) = 1)"


@query("WITH RECURSIVE " + ITEMS + f""", {ONE}, up AS (SELECT canonical_name, parent_canonical AS above, 0 AS level FROM one UNION SELECT u.canonical_name, o.parent_canonical, u.level + 1 FROM up u JOIN one o ON o.canonical_name = u.above WHERE u.level < 300),
top AS (SELECT canonical_name, MIN(level) AS level FROM up WHERE above IS NULL OR above NOT IN (SELECT canonical_name FROM one) GROUP BY 1)
SELECT 'missing_field' AS check, 'error' AS severity, canonical_name, f AS detail FROM raw, (SELECT unnest(['display_name', 'definition']) AS f) WHERE CASE f WHEN 'display_name' THEN display_name ELSE definition END IS NULL
UNION ALL SELECT 'duplicate_name', 'error', canonical_name, CAST(COUNT(*) AS VARCHAR) FROM raw GROUP BY 3 HAVING COUNT(*) > 1
UNION ALL SELECT 'invalid_category', 'error', canonical_name, category FROM one WHERE category NOT IN ('ECONOMY', 'SMALL', 'STANDARD', 'LARGE')
UNION ALL SELECT 'orphaned_parent', 'error', canonical_name, parent_canonical FROM one WHERE parent_canonical NOT IN (SELECT canonical_name FROM one)
UNION ALL SELECT 'cross_category_parent', 'warning', a.canonical_name, a.parent_canonical FROM one a JOIN one b ON b.canonical_name = a.parent_canonical WHERE a.category <> b.category
UNION ALL SELECT 'circular_reference', 'error', canonical_name, NULL FROM one WHERE canonical_name NOT IN (SELECT canonical_name FROM top)
UNION ALL SELECT 'hierarchy_depth', 'warning', canonical_name, CAST(level AS VARCHAR) FROM top WHERE level > 4
UNION ALL SELECT 'duplicate_alias', 'warning', MIN(canonical_name), a FROM (SELECT canonical_name, lower(unnest(aliases)) AS a FROM one) GROUP BY a HAVING COUNT(*) > 1
UNION ALL SELECT 'derivation_reference', 'warning', canonical_name, unnest(['revenue', 'other_cost']) FROM one WHERE derivation IS NOT NULL
UNION ALL SELECT 'ocr_variant', 'warning', canonical_name, v FROM (SELECT canonical_name, display_name, unnest(ocr_variants) AS v FROM one) WHERE lower(v) = lower(display_name)
UNION ALL SELECT 'identity_item', 'warning', unnest({op.IDENTITIES!r}), NULL""")
def taxonomy_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P"""
    return op.findings(_items(spark, sf_dir), CATEGORIES)


@query("WITH " + ITEMS + " SELECT category, COUNT(*) AS items, COUNT(parent_canonical) AS with_parent, COUNT(ocr_variants) AS with_variants, CAST(SUM(COALESCE(len(ocr_variants), 0)) AS BIGINT) AS variants FROM raw GROUP BY 1")
def taxonomy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.distribution(_items(spark, sf_dir))
