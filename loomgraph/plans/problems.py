"""The queries of the general problems over the given tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import decoded
from ..functions.typed import FALSE, MONTHS, PLACEHOLDERS, TRUE
from ..operators import heavy_keys, hierarchy, wide
from ..session import cut, spread, table


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(hierarchy.links(spread(table(spark, d, "triples").select("subject", "predicate", "object")), table(spark, d, "hierarchy_props")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("hierarchy", "node", "state", "root_node", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each node's path from its root, with the number of its descendants."""
    nodes = cut(_resolved(spark, d))
    paths = hierarchy.paths(nodes).select("hierarchy", "node", F.array_join("path", " > ").alias("path"))
    return nodes.select("hierarchy", "node", "n_descendants").join(paths, ["hierarchy", "node"])


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a node and a node below it."""
    pairs = hierarchy.nested_pairs(cut(_resolved(spark, d)))
    return pairs.select("hierarchy", "ancestor", "descendant", (F.col("depth") - F.col("ancestor_depth")).alias("links"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.cells(spread(table(spark, d, "triples").select("subject", "predicate", "object")), table(spark, d, "attribute_catalog"))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.typed_wide(spread(table(spark, d, "triples").select("subject", "predicate", "object")), table(spark, d, "attribute_catalog"))


def _keyed(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    t, v = table(spark, d, "triples"), table(spark, d, "vertices")
    return [
        ("triples.object", t.select(decoded(F.col("object")).alias("k"), "loaded_at", decoded(F.col("subject")).alias("v"))),
        ("vertices.name", v.select(decoded(F.col("name")).alias("k"), "loaded_at", F.col("chunk_no").cast("string").alias("v"))),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    (a, t), (b, v) = _keyed(spark, d)
    rows = heavy_keys.heavy(t, "k").withColumn("field", F.lit(a)).unionByName(heavy_keys.heavy(v, "k").withColumn("field", F.lit(b)))
    return rows.select("field", "key_value")


def p5_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct subjects (objects) or chunks (vertices), first and last load of every key."""
    (a, t), (b, v) = _keyed(spark, d)
    rows = heavy_keys.per_key(t, "k", "loaded_at", "v").withColumn("field", F.lit(a))
    rows = rows.unionByName(heavy_keys.per_key(v, "k", "loaded_at", "v").withColumn("field", F.lit(b)))
    return rows.select("field", "key_value", "n_rows", "n_distinct", "first_at", "last_at")


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p3_found, p3_wide, p5_found, p5_per_key)}


def _sql_term(x: str) -> str:
    quoted = "'(?s)^\"(.*)\"(?:@[A-Za-z0-9-]+|\\^\\^<[^>]*>)?$'"
    return f"CASE WHEN {x} LIKE '<%>' THEN {x}[2:-2] WHEN regexp_matches({x}, {quoted}) THEN regexp_extract({x}, {quoted}, 1) ELSE {x} END"


_LINKS = f"""
WITH RECURSIVE terms AS (
  SELECT {_sql_term("subject")} AS s, {_sql_term("object")} AS o, lower(regexp_extract({_sql_term("predicate")}, '([^/#]*)$', 1)) AS p FROM triples),
links AS (
  SELECT hierarchy, CASE WHEN child_end = 'subject' THEN s ELSE o END AS child, min(CASE WHEN child_end = 'subject' THEN o ELSE s END) AS parent
  FROM terms JOIN hierarchy_props ON p = lower(predicate_local)
  WHERE s <> '' AND o <> '' AND s NOT LIKE '\\_:%' ESCAPE '\\' AND o NOT LIKE '\\_:%' ESCAPE '\\' GROUP BY ALL),
nodes AS (SELECT hierarchy, child AS node FROM links UNION SELECT hierarchy, parent FROM links),
walk AS (
  SELECT hierarchy, node, node AS cur, [node] AS seen, false AS back FROM nodes
  UNION ALL
  SELECT w.hierarchy, w.node, l.parent, list_append(w.seen, l.parent), list_contains(w.seen, l.parent)
  FROM walk w JOIN links l ON l.hierarchy = w.hierarchy AND l.child = w.cur WHERE NOT w.back),
ends AS (SELECT hierarchy, node, seen, back, cur FROM walk w WHERE back OR NOT EXISTS (SELECT 1 FROM links l WHERE l.hierarchy = w.hierarchy AND l.child = w.cur)),
found AS (
  SELECT hierarchy, node, back, cur, CASE WHEN back THEN list_position(seen, cur) - 1 ELSE len(seen) - 1 END AS depth,
         CASE WHEN back THEN list_aggregate(seen[list_position(seen, cur):], 'min') ELSE cur END AS root_node,
         CASE WHEN back THEN seen[:list_position(seen, cur)] ELSE seen END AS up FROM ends)
"""
_KEYS = f"""
WITH k AS (
  SELECT 'triples.object' AS field, {_sql_term("object")} AS key_value, {_sql_term("subject")} AS v, loaded_at FROM triples
  UNION ALL SELECT 'vertices.name', {_sql_term("name")}, CAST(chunk_no AS VARCHAR), loaded_at FROM vertices)
"""
_MONTHS = "MAP {" + ", ".join(f"'{form}': '{n:02d}'" for n, forms in enumerate(MONTHS, 1) for form in forms) + "}"
_NUMBER, _YEAR = "'^\\d{1,2}$'", "'^\\d{4}$'"
_MONTH = f"coalesce({_MONTHS}[p[2]], CASE WHEN regexp_matches(p[2], {_NUMBER}) THEN lpad(p[2], 2, '0') END)"
_AMOUNT = "'^(?:[A-Za-z]{3}|[€$£])?\\s*([+-]?)(\\d(?:[\\d.,''’\\s]*\\d)?)[.,](\\d\\d)\\s*(?:[A-Za-z]{3}|[€$£])?$'"


def _sql_measure(units: str, factor: str) -> str:
    form = f"'(?i)^\\+?(\\d+(?:[.,]\\d+)?)\\s*({units})?$'"
    unit = f"coalesce(nullif(lower(regexp_extract(t, {form}, 2)), ''), bare_unit)"
    number = f"TRY_CAST(replace(regexp_extract(t, {form}, 1), ',', '.') AS DECIMAL(28, 9))"
    return f"CASE WHEN regexp_matches(t, {form}) THEN CAST(CAST(round({number} * (CASE {unit} {factor} END), 0) AS BIGINT) AS VARCHAR) END"


_CELLS = f"""
WITH d AS (SELECT {_sql_term("subject")} AS subject, lower(regexp_extract({_sql_term("predicate")}, '([^/#]*)$', 1)) AS k, {_sql_term("object")} AS o FROM triples),
r AS (SELECT subject, attr, col_type, bare_unit, regexp_replace(o, '^\\s+|\\s+$', '', 'g') AS t FROM d JOIN attribute_catalog ON lower(attr) = k
  WHERE subject <> '' AND subject NOT LIKE '\\_:%' ESCAPE '\\' AND o IS NOT NULL AND o NOT LIKE '\\_:%' ESCAPE '\\'),
x AS (SELECT *, string_split_regex(regexp_replace(lower(t), '[t ]\\d{{1,2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?(z|[+-]\\d{{2}}:?\\d{{2}})?$', ''), '[-/]|[., ]+') AS p FROM r),
y AS (SELECT *, CASE WHEN len(p) <> 3 THEN NULL
  WHEN regexp_matches(p[1], {_YEAR}) AND regexp_matches(p[3], {_NUMBER}) THEN p[1] || '-' || {_MONTH} || '-' || lpad(p[3], 2, '0')
  WHEN regexp_matches(p[3], {_YEAR}) AND regexp_matches(p[1], {_NUMBER}) THEN p[3] || '-' || {_MONTH} || '-' || lpad(p[1], 2, '0')
  WHEN regexp_matches(p[3], {_YEAR}) AND regexp_matches(p[2], {_NUMBER}) THEN p[3] || '-' || {_MONTHS}[p[1]] || '-' || lpad(p[2], 2, '0') END AS iso FROM x),
z AS (SELECT subject, attr, CASE col_type
  WHEN 'text' THEN CASE WHEN lower(t) NOT IN ({", ".join(f"'{x}'" for x in PLACEHOLDERS)}) THEN t END
  WHEN 'int' THEN CASE WHEN regexp_matches(t, '^[+-]?0*\\d+([.,]0+)?$') THEN CAST(CAST(regexp_extract(t, '^([+-]?\\d+)', 1) AS BIGINT) AS VARCHAR) END
  WHEN 'int_mm' THEN {_sql_measure("mm|cm|dm|m", "WHEN 'mm' THEN 1 WHEN 'cm' THEN 10 WHEN 'dm' THEN 100 WHEN 'm' THEN 1000")}
  WHEN 'int_g' THEN {_sql_measure("kg|g", "WHEN 'g' THEN 1 WHEN 'kg' THEN 1000")}
  WHEN 'decimal2' THEN CASE WHEN regexp_matches(t, {_AMOUNT}) THEN replace(regexp_extract(t, {_AMOUNT}, 1), '+', '') || regexp_replace(regexp_extract(t, {_AMOUNT}, 2), '\\D', '', 'g') || '.' || regexp_extract(t, {_AMOUNT}, 3) END
  WHEN 'date' THEN CASE WHEN TRY_CAST(iso AS DATE) IS NOT NULL THEN iso END
  WHEN 'bool' THEN CASE WHEN lower(t) IN ({", ".join(f"'{x}'" for x in TRUE)}) THEN 'true' WHEN lower(t) IN ({", ".join(f"'{x}'" for x in FALSE)}) THEN 'false' END END AS val FROM y),
n AS (SELECT subject, attr, val, count(*) AS n FROM z WHERE val IS NOT NULL GROUP BY ALL),
c AS (SELECT subject, attr, val FROM n QUALIFY attr = 'technique' OR row_number() OVER (PARTITION BY subject, attr ORDER BY n DESC, val) = 1)
"""
# The columns of the wide table and their types.
_WIDE = {
    "inventory_no": "VARCHAR", "title": "VARCHAR", "height": "INTEGER", "width": "INTEGER", "weight": "INTEGER", "page_count": "INTEGER", "acquired_on": "DATE", "last_seen_on": "DATE", "on_display": "BOOLEAN",
    "insured_value": "DECIMAL(20, 2)", "P82a_begin_of_the_begin": "DATE", "P82b_end_of_the_end": "DATE", "birth_year": "INTEGER", "founded_year": "INTEGER",
}
ORACLES = {
    "p3_wide": _CELLS
    + "SELECT subject, list_sort(list(val) FILTER (attr = 'technique')) AS technique, "
    + ", ".join(f"CAST(max(CASE WHEN attr = '{a}' THEN val END) AS {t}) AS {a}" for a, t in _WIDE.items())
    + " FROM c GROUP BY subject",
    "p3_found": _CELLS + "SELECT subject, attr, val FROM c",
    "p1_found": _LINKS + "SELECT hierarchy, node, CASE WHEN NOT back THEN 'tree' WHEN depth = 0 THEN 'cycle' ELSE 'below_cycle' END AS state, root_node, CAST(depth AS INTEGER) AS depth FROM found",
    "p1_paths": _LINKS + ", above AS (SELECT hierarchy, unnest(up[2:]) AS node FROM found), n AS (SELECT hierarchy, node, count(*) AS n FROM above GROUP BY ALL) "
    "SELECT f.hierarchy, f.node, coalesce(n.n, 0) AS n_descendants, array_to_string(list_reverse(up), ' > ') AS path FROM found f LEFT JOIN n USING (hierarchy, node)",
    "p1_descendants": _LINKS + "SELECT hierarchy, up[i + 1] AS ancestor, node AS descendant, CAST(i AS INTEGER) AS links FROM (SELECT hierarchy, node, up, unnest(range(1, len(up))) AS i FROM found)",
    "p5_found": _KEYS + "SELECT field, key_value FROM (SELECT field, key_value, count(*) AS n FROM k GROUP BY ALL) JOIN (SELECT field, count(*) AS total FROM k GROUP BY ALL) USING (field) WHERE key_value IS NOT NULL AND n * 100 >= total",
    "p5_per_key": _KEYS + "SELECT field, key_value, count(*) AS n_rows, count(DISTINCT v) AS n_distinct, min(loaded_at) AS first_at, max(loaded_at) AS last_at FROM k WHERE key_value IS NOT NULL GROUP BY ALL",
}
