"""Queries on exports of the graph, the facts of documents, and the cache of vectors, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.terms import local_name
from ..operators import exports, graph
from ..session import table
from .graph import _FR, _GRAPH, _PR
from .problems import _sql_term
from .store import store

#: most edges of a JSON export of these tables
MOST_EDGES = 20_000


def graphml_lines(spark, d):
    """Elements of the whole graph."""
    return exports.graphml(store(spark, d).vertices, store(spark, d).all_edges)


def graphml_shortcuts(spark, d):
    """Elements of the graph of shortcuts alone."""
    return exports.graphml(store(spark, d).vertices, store(spark, d).all_edges, True)


def json_nodes(spark, d):
    return exports.json_nodes(store(spark, d).vertices, store(spark, d).pagerank)


def json_edges(spark, d):
    return exports.json_edges(store(spark, d).all_edges, MOST_EDGES)


def export_facts(spark, d):
    return exports.export_facts(store(spark, d).vertices, store(spark, d).all_edges, MOST_EDGES)


def drawn_nodes(spark, d):
    """Nodes of a drawing, sized by their degree."""
    return exports.drawn_nodes(store(spark, d).vertices, graph.degrees(store(spark, d).edges))


def shared_neighbours(spark, d):
    """The five places where most agents live."""
    v = store(spark, d).vertices.where("uri LIKE '%/agent/%'").select("uri")
    return exports.shared_neighbours(store(spark, d).edges.where("p_key = 'p74_has_current_or_former_residence'"), v)


def document_facts(spark, d):
    """Types, Wikidata ids and images of every document."""
    f = graph.document_facts(table(spark, d, "graph_documents"))
    return f.select("uri", F.array_join("types", " ").alias("types"), "wikidata", F.array_join("images", " ").alias("images"))


def documents_by_category(spark, d):
    """The type index: documents of each category by any of their types."""
    known = table(spark, d, "fc_classes").select(F.lower("class_local").alias("k"), "fc").distinct()
    t = graph.document_facts(table(spark, d, "graph_documents")).select("uri", F.explode("types").alias("t"))
    return t.select("uri", F.lower(local_name(F.col("t"))).alias("k")).join(known, "k").select("fc", "uri").distinct()


def category_names(spark, d):
    """What a category's classes are called: local names and labels."""
    c = table(spark, d, "fc_classes")
    label = F.regexp_replace(F.regexp_replace("class_local", r"^[A-Z]+\d+[a-z]?_", ""), "_", " ")
    return c.select("fc", F.explode(F.array("class_local", label)).alias("name")).distinct()


def _cache(spark, d, source: str):
    g = table(spark, d, "graph_documents").where("id IS NOT NULL AND embedding IS NOT NULL")
    g = g.select(F.col("id").alias("doc_id"), F.lit("table").alias("model"), F.md5("id").alias("text_hash"), F.col("embedding").alias("vec"), "doc_type")
    return g.where(F.col("doc_type") == source).drop("doc_type")


def cache_facts(spark, d):
    """A cache of the vectors of objects after those of productions were put in: how many, how long, how large."""
    start = spark.createDataFrame([], "doc_id string, model string, text_hash string, vec array<float>")
    whole = exports.upserted(exports.upserted(start, _cache(spark, d, "E22_Human-Made_Object")), _cache(spark, d, "E12_Production"))
    return exports.cache_facts(whole)


QUERIES = {
    f.__name__: f
    for f in (graphml_lines, graphml_shortcuts, json_nodes, json_edges, export_facts, drawn_nodes, shared_neighbours, document_facts, documents_by_category, category_names, cache_facts)
}


def _xml(c: str) -> str:
    for plain, sign in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, '{plain}', '{sign}')"
    return c


def _data(key: str) -> str:
    return f"'<data key=\"{key}\">' || {_xml(f'coalesce({key}::VARCHAR, {chr(39) * 2})')} || '</data>'"


_NODE = f"'<node id=\"' || {_xml('uri')} || '\">' || " + " || ".join(map(_data, ("label", "fc", "is_doc", "doc_type"))) + " || '</node>'"
_EDGE = f"'<edge source=\"' || {_xml('src')} || '\" target=\"' || {_xml('dst')} || '\">' || " + " || ".join(map(_data, ("p_key", "predicate_label", "weight", "edge_type"))) + " || '</edge>'"
_FACTS = f"""WITH gd AS (SELECT {_sql_term("id")} AS uri, coalesce(all_types, []) AS all_types, wikidata_id, coalesce(images, []) AS images FROM graph_documents WHERE id IS NOT NULL),
f AS (SELECT uri, list_sort(list_distinct(flatten(list(all_types)))) AS types, min(wikidata_id) AS wikidata, list_sort(list_distinct(flatten(list(images)))) AS images FROM gd WHERE uri <> '' AND uri NOT LIKE '\\_:%' ESCAPE '\\' GROUP BY ALL)
"""
ORACLES = {
    "graphml_lines": _FR + f"SELECT 1 AS place, {_NODE} AS line FROM v UNION ALL SELECT 2, {_EDGE} FROM ae",
    "graphml_shortcuts": _FR + f"SELECT 1 AS place, {_NODE} AS line FROM v WHERE uri IN (SELECT src FROM fr UNION SELECT dst FROM fr) UNION ALL SELECT 2, {_EDGE} FROM ae WHERE edge_type = 'fr'",
    "json_nodes": _PR + " SELECT uri, to_json({'id': uri, 'label': label, 'fc': fc, 'pagerank': printf('%.9f', coalesce(rank, 0.0)), 'is_doc': is_doc, 'doc_type': doc_type})::VARCHAR AS node FROM v LEFT JOIN pr USING (uri)",
    "json_edges": _FR + f"SELECT to_json({{'source': src, 'target': dst, 'predicate_label': predicate_label, 'weight': weight, 'edge_type': edge_type}})::VARCHAR AS edge FROM (SELECT * FROM ae ORDER BY edge_type, src, dst, p_key LIMIT {MOST_EDGES})",
    "export_facts": _FR + f"SELECT (SELECT count(*) FROM v) AS node_count, (SELECT count(*) FROM ae) AS edge_count, (SELECT count(*) FROM ae) > {MOST_EDGES} AS truncated, (SELECT string_agg(fc || '=' || n, ' ' ORDER BY fc) FROM (SELECT fc, count(*) AS n FROM v WHERE fc <> '' GROUP BY ALL)) AS fc_counts",
    "drawn_nodes": _GRAPH + "SELECT uri, label, CASE WHEN fc = '' THEN 'Unknown' ELSE fc END AS fc, 3 + least(30.0::DOUBLE, 0.5::DOUBLE * coalesce(n, 0)) AS size FROM v LEFT JOIN (SELECT uri, count(*) AS n FROM (SELECT src AS uri FROM e UNION ALL SELECT dst FROM e) GROUP BY ALL) USING (uri)",
    "shared_neighbours": _GRAPH + """, sh AS (SELECT uri FROM v WHERE uri LIKE '%/agent/%'), k AS (SELECT src, dst FROM e WHERE p_key = 'p74_has_current_or_former_residence'),
bo AS (SELECT src AS uri, dst AS other FROM k WHERE src IN (SELECT uri FROM sh) UNION SELECT dst, src FROM k WHERE dst IN (SELECT uri FROM sh))
SELECT other, count(*) AS sources FROM bo WHERE other NOT IN (SELECT uri FROM sh) AND (SELECT count(*) FROM k WHERE src IN (SELECT uri FROM sh) AND dst IN (SELECT uri FROM sh)) < 3 GROUP BY ALL HAVING count(*) >= 2 ORDER BY sources DESC, other LIMIT 5""",
    "document_facts": _FACTS + "SELECT uri, array_to_string(types, ' ') AS types, wikidata, array_to_string(images, ' ') AS images FROM f",
    "documents_by_category": _FACTS + "SELECT DISTINCT c.fc, uri FROM (SELECT uri, unnest(types) AS t FROM f) JOIN fc_classes c ON lower(class_local) = lower(regexp_extract(t, '([^/#]*)$', 1))",
    "category_names": "SELECT DISTINCT fc, unnest([class_local, replace(regexp_replace(class_local, '^[A-Z]+\\d+[a-z]?_', ''), '_', ' ')]) AS name FROM fc_classes",
    "cache_facts": "SELECT 'table' AS model, count(*) AS vectors, max(n)::INTEGER AS dims, sum(4 * n)::BIGINT AS bytes FROM (SELECT id, arg_min(len(embedding), CASE WHEN doc_type = 'E12_Production' THEN 0 ELSE 1 END) AS n FROM (SELECT id, doc_type, min(embedding) AS embedding FROM graph_documents WHERE id IS NOT NULL AND embedding IS NOT NULL AND doc_type IN ('E12_Production', 'E22_Human-Made_Object') GROUP BY ALL) GROUP BY ALL)",
}
