"""Queries of ranked retrieval over documents and embeddings, and SQL that gives the same rows.

The queries asked are all rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import LANGUAGES, language
from ..operators import retrieval
from ..session import table


def _asked(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def _near(spark: SparkSession, d: str, k: int, metric: str, where: str = "true") -> DataFrame:
    v = _vectors(spark, d)
    q = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    return retrieval.nearest(v.where(where), q, k, metric)


def _scored(found: DataFrame) -> DataFrame:
    return found.select("query_id", "doc_id", (1 / (1 + F.col("distance"))).alias("score"), "rank")


def _out(ranked: DataFrame, value: str = "score", places: int = 6) -> DataFrame:
    return ranked.select("query_id", "doc_id", F.round(value, places).alias(value), F.col("rank").cast("int").alias("rank"))


def bm25_statistics(spark, d):
    """Length in words and number of different words of every document that has any."""
    return retrieval.postings(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("tf").alias("length"), F.count("*").alias("terms"))


def bm25_top(spark, d):
    docs = table(spark, d, "documents")
    return _out(retrieval.bm25(docs, _asked(docs), 10))


def bm25_typed(spark, d):
    """English documents among the best 50 of all, which is the reference's rule."""
    docs = table(spark, d, "documents")
    return _out(retrieval.bm25(docs, _asked(docs), 10, docs.where(language(F.col("lang")) == "en"), over_fetch=5))


def bm25_typed_whole(spark, d):
    """Among all English documents."""
    docs = table(spark, d, "documents")
    return _out(retrieval.bm25(docs, _asked(docs), 10, docs.where(language(F.col("lang")) == "en")))


def knn_l2(spark, d):
    return _out(_near(spark, d, 10, "l2"), "distance")


def knn_cosine(spark, d):
    return _out(_near(spark, d, 10, "cosine"), "distance")


def knn_typed(spark, d):
    """Among the vectors with label 0 only."""
    return _out(_near(spark, d, 10, "l2", "label = 0"), "distance")


def rrf_three(spark, d):
    """Fusion of the nearest by distance, by cosine and by distance among label 0."""
    return _out(retrieval.fused([_near(spark, d, 20, "l2"), _near(spark, d, 20, "cosine"), _near(spark, d, 20, "l2", "label = 0")], 20), "score", 9)


def slot_merge(spark, d):
    return _out(retrieval.merged_slots(_scored(_near(spark, d, 20, "l2")), _scored(_near(spark, d, 20, "l2", "label = 0")), 20))


def ratio_cap(spark, d):
    """At most a quarter of the results with an even label."""
    flagged = _scored(_near(spark, d, 20, "l2")).join(_vectors(spark, d).select("doc_id", (F.col("label") % 2 == 0).alias("even")), "doc_id")
    return _out(retrieval.capped(flagged, "even"))


def normalised_scores(spark, d):
    return _out(retrieval.normalised(_scored(_near(spark, d, 20, "l2"))), "norm")


QUERIES = {f.__name__: f for f in (bm25_statistics, bm25_top, bm25_typed, bm25_typed_whole, knn_l2, knn_cosine, knn_typed, rrf_three, slot_merge, ratio_cap, normalised_scores)}

_BM25 = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT q.doc_id AS query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf / (p.tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))) AS score
  FROM p q JOIN f USING (term) JOIN p USING (term) JOIN l ON l.doc_id = p.doc_id, n WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0)
"""
_KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings),
a AS MATERIALIZED (SELECT query_id, doc_id, label, pow(list_distance(qv, v), 2) AS l2, 1 - list_cosine_similarity(qv, v) AS cs FROM q, x),
l AS (SELECT query_id, doc_id, l2 AS distance, 1 / (1 + l2) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(l2, 9), doc_id) AS rank FROM a),
c AS (SELECT query_id, doc_id, cs AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(cs, 9), doc_id) AS rank FROM a),
t AS (SELECT query_id, doc_id, l2 AS distance, 1 / (1 + l2) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(l2, 9), doc_id) AS rank FROM a WHERE label = 0)
"""
_ENGLISH = "lower(regexp_extract(trim(lang), '^([A-Za-z]*)', 1)) IN ('en', " + ", ".join(f"'{k}'" for k, v in LANGUAGES.items() if v == "en") + ")"
_TOP = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank"
ORACLES = {
    "bm25_statistics": _BM25 + "SELECT doc_id, CAST(sum(tf) AS BIGINT) AS length, count(*) AS terms FROM p GROUP BY ALL",
    "bm25_top": _BM25 + "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10",
    "bm25_typed": _BM25 + f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT query_id, r.doc_id, score, {_TOP.replace('doc_id)', 'r.doc_id)')} FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 50 AND {_ENGLISH}) WHERE rank <= 10",
    "bm25_typed_whole": _BM25 + f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT query_id, r.doc_id, score, {_TOP.replace('doc_id)', 'r.doc_id)')} FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE {_ENGLISH}) WHERE rank <= 10",
    "knn_l2": _KNN + "SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM l WHERE rank <= 10",
    "knn_cosine": _KNN + "SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 10",
    "knn_typed": _KNN + "SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10",
    "rrf_three": _KNN + f", u AS (SELECT query_id, doc_id, rank FROM l UNION ALL SELECT query_id, doc_id, rank FROM c UNION ALL SELECT query_id, doc_id, rank FROM t), z AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u WHERE rank <= 20 GROUP BY ALL) "
    f"SELECT query_id, doc_id, round(score, 9) AS score, rank FROM (SELECT *, {_TOP} FROM z) WHERE rank <= 20",
    "slot_merge": _KNN + f", m AS (SELECT query_id, doc_id, score FROM l WHERE rank <= 10), y AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM t WHERE rank <= 20 AND NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = t.query_id AND m.doc_id = t.doc_id)) "
    f"SELECT query_id, doc_id, round(score, 6) AS score, {_TOP} FROM (SELECT * FROM m UNION ALL SELECT query_id, doc_id, score FROM y WHERE r <= 10)",
    "ratio_cap": _KNN + ", y AS (SELECT l.*, x.label % 2 = 0 AS even, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, x.label % 2 = 0 ORDER BY rank) AS k FROM l JOIN x USING (doc_id) WHERE rank <= 20) "
    "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM y WHERE NOT even OR k <= greatest(1, floor(0.25 * n))",
    "normalised_scores": _KNN + ", y AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM l WHERE rank <= 20) "
    "SELECT query_id, doc_id, round(CASE WHEN hi - lo < 1e-10 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS norm, CAST(rank AS INTEGER) AS rank FROM y",
}
