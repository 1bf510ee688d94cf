"""The queries of the problems on text and vectors over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import neighbours, packing, quality, spellings, tokens


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.same_entities(table(spark, d, "triples"), table(spark, d, "vertices"), table(spark, d, "entity_types"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each URI with the smallest URI of its class, in place of all pairs."""
    found = spellings.entity_classes(table(spark, d, "triples"), table(spark, d, "vertices"), table(spark, d, "entity_types"))
    return found.select("uri", "class").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(neighbours.neighbours(table(spark, d, "graph_documents")))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "graph_documents"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids; equal to the texts themselves, and empty for null ones."""
    return tokens.decoded(tokens.token_ids(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents")).where("n_parts > 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """One row: the documents that are in containers, and whether every container keeps to its capacity and every part to its place."""
    c = packing.containers(table(spark, d, "documents"))
    fill = c.groupBy("container").agg(F.sum("n_tokens").alias("fill")).agg((F.max("fill") <= 4096).alias("within"))
    whole = c.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_parts").alias("parts"), F.count_distinct("part").alias("different"))
    rows = whole.agg(F.count("*").alias("documents"), F.bool_and((F.col("n") == F.col("parts")) & (F.col("different") == F.col("parts"))).alias("once"))
    return rows.crossJoin(fill)  # two tables of one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents")).where("p_prose < 0.5").select("doc_id")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents"))


def p8_plain(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that SQL can say as well."""
    s = quality.text_statistics(table(spark, d, "documents"))
    return s.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("mean_word_length", "digit_ratio")))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p4_found, p4_neighbours, p6_ids, p6_decoded, p7_found, p7_containers, p7_coverage, p8_found, p8_statistics, p8_plain)}
#: white space as the statistics know it
_BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
ORACLES = {
    "p7_coverage": "SELECT count(*) AS documents, true AS once, true AS within FROM documents WHERE text <> ''",
    "p8_plain": f"""WITH t AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS n_words, regexp_replace(text, '{_BLANK}+', ' ', 'g') AS x, regexp_replace(text, '{_BLANK}', '', 'g') AS solid FROM documents)
SELECT doc_id, n_words::INTEGER AS n_words, round(length(solid)::DOUBLE / len(string_split(trim(x), ' ')), 6) AS mean_word_length, round(length(regexp_replace(solid, '[^0-9]', '', 'g'))::DOUBLE / length(solid), 6) AS digit_ratio FROM t WHERE solid <> ''""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
