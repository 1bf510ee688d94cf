"""Exports of the graph for other programs, and a cache of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import local_name
from ..session import Cut


def _xml(c: Column) -> Column:
    for plain, sign in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(sign))
    return c


def _data(key: str, c: Column) -> Column:
    return F.concat(F.lit(f'<data key="{key}">'), _xml(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</data>"))


def graphml(vertices: DataFrame, edges: DataFrame, shortcuts_only: bool = False) -> DataFrame:
    """(place, line): a node or edge element of GraphML per row, nodes first; with `shortcuts_only` edges of type `fr` and the vertices they have.

    vertices: uri, label, fc, is_doc, doc_type; edges: src, dst, p_key, predicate_label, weight, edge_type.
    """
    if shortcuts_only:
        edges = edges.where("edge_type = 'fr'")
        vertices = vertices.join(edges.select(F.explode(F.array("src", "dst")).alias("uri")).distinct(), "uri", "left_semi")
    node = F.concat(F.lit('<node id="'), _xml(F.col("uri")), F.lit('">'), *(_data(c, F.col(c)) for c in ("label", "fc", "is_doc", "doc_type")), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), *(_data(c, F.col(c)) for c in ("p_key", "predicate_label", "weight", "edge_type")), F.lit("</edge>"))
    return vertices.select(F.lit(1).alias("place"), node.alias("line")).unionByName(edges.select(F.lit(2).alias("place"), edge.alias("line")))


# What precedes and follows the elements of a GraphML file.
GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'
GRAPHML_TAIL = "</graph></graphml>"


def write_graphml(lines: DataFrame, folder: str) -> None:
    """Text files of a folder that make one GraphML document when joined in the order of their names."""
    spark = lines.sparkSession
    ends = spark.createDataFrame([(0, GRAPHML_HEAD), (3, GRAPHML_TAIL)], "place int, line string")
    lines.unionByName(ends).repartitionByRange("place", F.xxhash64("line")).sortWithinPartitions("place").select(F.col("line").alias("value")).write.text(folder)


def json_nodes(vertices: DataFrame, ranks: DataFrame) -> DataFrame:
    """(uri, node): one JSON object per vertex, with its rank (uri, rank) as text with nine decimals, 0 without one."""
    v = vertices.join(ranks, "uri", "left")
    node = F.to_json(F.struct(F.col("uri").alias("id"), "label", "fc", F.format_string("%.9f", F.coalesce("rank", F.lit(0.0))).alias("pagerank"), "is_doc", "doc_type"))
    return v.select("uri", node.alias("node"))


def json_edges(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """(edge): one JSON object per edge, of at most `most` edges, those that come first by type, ends and property."""
    few = edges.orderBy("edge_type", "src", "dst", "p_key").limit(most)
    return few.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "predicate_label", "weight", "edge_type")).alias("edge"))


def export_facts(vertices: DataFrame, edges: DataFrame, most: int = 500_000) -> DataFrame:
    """(node_count, edge_count, truncated, fc_counts): one row; fc_counts is `category=n` of all categories in their order, joined by blanks."""
    fcs = vertices.where("fc <> ''").groupBy("fc").agg(F.count("*").alias("n"))
    listed = fcs.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fc", "n"))), lambda x: F.concat(x["fc"], F.lit("="), x["n"])), " ").alias("fc_counts"))
    n, m = vertices.agg(F.count("*").alias("node_count")), edges.agg(F.count("*").alias("edge_count"))
    # three tables of one row each
    return n.crossJoin(m).crossJoin(listed).select("node_count", "edge_count", (F.col("edge_count") > most).alias("truncated"), "fc_counts")


def drawn_nodes(vertices: DataFrame, degrees: DataFrame) -> DataFrame:
    """(uri, label, fc, size): size 3 and half the degree (uri, degree), 30 of it at most."""
    d = vertices.join(degrees, "uri", "left")
    return d.select("uri", "label", F.when(F.col("fc") == "", "Unknown").otherwise(F.col("fc")).alias("fc"), (3 + F.least(F.lit(30.0), 0.5 * F.coalesce("degree", F.lit(0)))).alias("size"))


def drawn_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", local_name(F.col("p_key")).alias("short"))


def shared_neighbours(edges: DataFrame, shown: DataFrame, few: int = 3, most: int = 5) -> DataFrame:
    """(other, sources): neighbours that are not shown (uri) themselves but that two or more of the shown share, the `most` with most of them; none if the shown have `few` links or more."""
    a, b = shown.select(F.col("uri").alias("src")), shown.select(F.col("uri").alias("dst"))
    if edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").limit(few).count() >= few:
        return edges.select(F.col("dst").alias("other"), F.lit(0).cast("bigint").alias("sources")).where("false")
    out = edges.join(a, "src", "left_semi").select(F.col("src").alias("uri"), F.col("dst").alias("other"))
    into = edges.join(b, "dst", "left_semi").select(F.col("dst").alias("uri"), F.col("src").alias("other"))
    both = out.unionByName(into).distinct().join(shown.select(F.col("uri").alias("other")), "other", "left_anti")
    return both.groupBy("other").agg(F.count("*").alias("sources")).where("sources >= 2").orderBy(F.desc("sources"), "other").limit(most)


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The rows (doc_id, model, text_hash, vec) of `cache` that `new` doesn't replace, and those of `new`; of several new rows of a key the one of the smallest hash counts."""
    one = new.groupBy("doc_id", "model").agg(F.min(F.struct("text_hash", "vec")).alias("x")).select("doc_id", "model", "x.*")
    return cache.join(one, ["doc_id", "model"], "left_anti").select("doc_id", "model", "text_hash", "vec").unionByName(one)


def missing(cache: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """The documents (doc_id, text) without a vector of the model for their present text."""
    have = cache.where(F.col("model") == model).select("doc_id", "text_hash")
    return documents.withColumn("text_hash", F.md5(F.concat_ws("|", F.lit(model), "text"))).join(have, ["doc_id", "text_hash"], "left_anti")


def cache_facts(cache: DataFrame) -> DataFrame:
    """(model, vectors, dims, bytes)."""
    return cache.groupBy("model").agg(F.count("*").alias("vectors"), F.max(F.size("vec")).alias("dims"), F.sum(4 * F.size("vec")).alias("bytes"))


def written(frame: DataFrame) -> DataFrame:
    """A copy in the shared folder, such as a cache that a later step replaces."""
    return Cut(frame).df
