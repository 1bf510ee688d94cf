"""Retrieval end to end: documents of entities found by words, by vectors and along the graph, fused, typed, filtered and selected; and the text written from what was found.

The questions asked are all documents whose id is divisible by 100 and whose entity has a vector: their texts and the vectors of their entities. A question's category is that of its
entity; the category of its context is Actor, which has too few documents here and is searched as Thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.terms import decoded, named
from ..operators import enrich, graph, labels, ranks, relations, retrieval
from ..session import Cut, table
from .exports import documents_by_category
from .graph import _FR, _SPANS, _pagerank_sql
from .problems import _sql_term
from .store import store

POOL, SEEDS, DIMS = 60, 5, 128
ROUNDS, LEAST = 4, 1e-3
# Fixed value: what looks like a name in a text.
_NAMED = r"[A-Z][a-zà-ÿ]+(?:\s+[A-Z][a-zà-ÿ]+)*"


def _corpus(spark, d) -> DataFrame:
    """(uri, label, doc_type, all_types, vec): one row per document with a usable vector, the smallest of its rows."""

    def make():
        g = table(spark, d, "graph_documents").select(decoded(F.col("id")).alias("uri"), F.col("embedding").alias("vec"), F.coalesce("label", F.lit("")).alias("label"), "doc_type", "all_types")
        g = g.where(named(F.col("uri")) & (F.size("vec") == DIMS) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)) & F.exists("vec", lambda x: x != 0))
        return g.groupBy("uri").agg(F.min(F.struct("vec", "label", "doc_type", "all_types")).alias("x")).select("uri", "x.*")

    # written in the type it is given in, which is half as long
    return store(spark, d).kept("corpus", make).withColumn("vec", F.col("vec").cast("array<double>"))


def _asked(spark, d) -> DataFrame:
    """(query_id, uri, text, vec)."""

    def make():
        q = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), decoded(F.col("entity_uri")).alias("uri"), "text")
        return q.join(_corpus(spark, d).select("uri", "vec"), "uri").select("query_id", "uri", "text", "vec")

    return store(spark, d).kept("asked", make)


def _categories(spark, d) -> DataFrame:
    """(fc, doc_id): documents of each category by any of their types, of those with a vector."""
    return documents_by_category(spark, d).join(_corpus(spark, d).select("uri"), "uri", "left_semi").select("fc", F.col("uri").alias("doc_id"))


def _question_fc(spark, d) -> DataFrame:
    return _asked(spark, d).join(store(spark, d).vertices.select("uri", "fc"), "uri").select("query_id", "fc")


def _dense(spark, d) -> DataFrame:
    make = lambda: retrieval.nearest(_corpus(spark, d).select(F.col("uri").alias("doc_id"), "vec"), _asked(spark, d).select("query_id", "vec"), POOL)
    return store(spark, d).kept("dense", make)


def _by_entity(found: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """Ranks of documents (query_id, doc_id, rank) as ranks of their entities (doc_id, uri), each by its best."""
    best = found.join(entities, "doc_id").groupBy("query_id", F.col("uri").alias("doc_id")).agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("rank") <= k)


def _texts(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text", decoded(F.col("entity_uri")).alias("uri"))
    return t.join(_corpus(spark, d).select("uri"), "uri", "left_semi")


def _words(spark, d) -> DataFrame:
    """The best 5 POOL documents by words, which the typed lists are filtered from."""
    make = lambda: retrieval.bm25(_texts(spark, d).select("doc_id", "text"), _asked(spark, d).select("query_id", "text"), 5 * POOL).select("query_id", "doc_id", "rank")
    return store(spark, d).kept("words", make)


def _sparse(spark, d) -> DataFrame:
    return _by_entity(_words(spark, d).where(F.col("rank") <= POOL), _texts(spark, d).select("doc_id", "uri"), POOL)


def _seeds(spark, d) -> DataFrame:
    """(query_id, uri, rank): entities named in the text first, then the nearest documents of the context's category, SEEDS in all, without hubs."""
    s = store(spark, d)
    sizes = {r["fc"]: r["n"] for r in _categories(spark, d).groupBy("fc").agg(F.count("*").alias("n")).collect()}  # bounded by the categories
    fc = "Actor" if sizes.get("Actor", 0) >= retrieval.SPARSE else "Thing"
    docs = _corpus(spark, d).join(_categories(spark, d).where(F.col("fc") == fc).select(F.col("doc_id").alias("uri")), "uri", "left_semi")
    near = retrieval.nearest(docs.select(F.col("uri").alias("doc_id"), "vec"), _asked(spark, d).select("query_id", "vec"), SEEDS)
    terms = _asked(spark, d).select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_NAMED), F.lit(0)))).alias("label"))
    found = labels.find(s.vertices, terms.select("label").distinct(), 1).withColumnRenamed("wanted", "label")
    given = terms.join(found, "label").join(_corpus(spark, d).select("uri"), "uri", "left_semi").select("query_id", F.col("uri").alias("doc_id"), F.lit(0).alias("rank"))
    both = given.unionByName(near.select("query_id", "doc_id", "rank")).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    few = graph.first_few(both, ["query_id"], ["rank", "doc_id"], SEEDS, "doc_id").select("query_id", F.col("doc_id").alias("uri"), F.col("r").alias("rank"))
    return retrieval.seeds_without_hubs(few, graph.degrees(s.all_edges))


def _along(spark, d) -> DataFrame:
    """Documents by personalised PageRank from the seeds, seeds left out."""

    def make():
        seeds = Cut(_seeds(spark, d)).df
        pushed = ranks.pushed(store(spark, d).links, seeds, ROUNDS, least=LEAST, among=_corpus(spark, d).select("uri"), k=POOL)
        return retrieval.top(pushed.select("query_id", F.col("uri").alias("doc_id"), F.col("rank").alias("score")), POOL, 12)

    return store(spark, d).kept("along", make)


def _fused(spark, d) -> DataFrame:
    """Fusion of the three lists; a question's own entity is left out of the lists by words and vectors, as an answer given before would be."""

    def make():
        own = _asked(spark, d).select("query_id", F.col("uri").alias("doc_id"))
        return retrieval.fused([retrieval.excluded(_dense(spark, d), own), retrieval.excluded(_sparse(spark, d), own), _along(spark, d)], POOL)

    return store(spark, d).kept("fused", make)


def _typed(spark, d, central: bool) -> DataFrame:
    """Documents of the question's category by vectors and words, fused; `central` also with the documents of highest rank of the category."""
    fc = _question_fc(spark, d)
    docs = _corpus(spark, d).select(F.col("uri").alias("doc_id"), "vec").join(_categories(spark, d), "doc_id")
    near = retrieval.nearest(docs, _asked(spark, d).select("query_id", "vec").join(fc, "query_id"), POOL, within="fc")
    words = retrieval.of_category(_words(spark, d).join(_texts(spark, d).select("doc_id", "uri"), "doc_id"), fc, _categories(spark, d).withColumnRenamed("doc_id", "uri"))
    words = words.groupBy("query_id", F.col("uri").alias("doc_id")).agg(F.min("rank").alias("rank"))
    words = graph.first_few(words, ["query_id"], ["rank", "doc_id"], POOL, "doc_id").select("query_id", "doc_id", F.col("r").alias("rank"))
    both = retrieval.fused([near, words], POOL)
    if not central:
        return both
    docs = _corpus(spark, d).select("uri").join(store(spark, d).vertices.select("uri", "fc"), "uri")
    best = ranks.ranked_documents(store(spark, d).pagerank, docs, 10 * POOL, POOL)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("fc").orderBy(F.round("rank", 12).desc(), "uri"))).select("fc", F.col("uri").alias("doc_id"), "rank")
    return retrieval.fused([both, fc.join(best, "fc").select("query_id", "doc_id", "rank")], POOL)


def _pool(spark, d) -> DataFrame:
    """The pool of a specific question: typed slots, at most a quarter of types that say little, scores from 0 to 1."""

    def make():
        merged = retrieval.merged_slots(_fused(spark, d), _typed(spark, d, False), POOL, 0.3)
        c = merged.join(_corpus(spark, d).withColumnRenamed("uri", "doc_id"), "doc_id").withColumn("dull", retrieval.non_informative(F.col("doc_type"), F.col("all_types")))
        return retrieval.normalised(retrieval.capped(c, "dull"))

    return store(spark, d).kept("pool", make)


def _features(spark, d) -> DataFrame:
    """The pool with all that the selection weighs: connection to the five best, type modifier, nearness to the question's entity, degree."""

    def make():
        s, pool = store(spark, d), _pool(spark, d)
        best = pool.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("r") <= SEEDS).select("query_id", F.col("doc_id").alias("uri"))
        way = ranks.pushed(s.links, best, ROUNDS, least=LEAST, wanted=pool.select("query_id", F.col("doc_id").alias("uri"))).withColumnRenamed("uri", "doc_id").withColumnRenamed("rank", "mass")
        linked = pool.join(best.select("query_id", F.col("uri").alias("doc_id"), F.lit(1.0).alias("seed")), ["query_id", "doc_id"], "left").join(way, ["query_id", "doc_id"], "left")
        # seeds count as fully connected
        linked = linked.withColumn("score", F.coalesce("seed", "mass", F.lit(0.0))).withColumnRenamed("norm", "relevance")
        linked = retrieval.normalised(linked).withColumnRenamed("norm", "link").withColumnRenamed("relevance", "norm")
        pairs = linked.select("query_id", F.col("doc_id").alias("b")).join(_asked(spark, d).select("query_id", F.col("uri").alias("a")), "query_id")
        bonus = pairs.join(retrieval.focus_bonus(ranks.pair_distances(s.links, pairs)), ["a", "b"]).select("query_id", F.col("b").alias("doc_id"), "bonus")
        degree = graph.degrees(s.all_edges).withColumnRenamed("uri", "doc_id")
        out = linked.join(bonus, ["query_id", "doc_id"], "left").join(degree, "doc_id", "left")
        return out.select("query_id", "doc_id", "rank", "norm", "link", "label", "doc_type", retrieval.type_modifier(F.col("doc_type"), F.col("all_types")).alias("modifier"), F.coalesce("bonus", F.lit(0.0)).alias("bonus"), F.coalesce("degree", F.lit(0)).alias("degree"), "vec")

    return store(spark, d).kept("features", make)


def _chosen(spark, d) -> DataFrame:
    return store(spark, d).kept("chosen", lambda: retrieval.selected(_features(spark, d), 10))


def hybrid_dense(spark, d):
    return _dense(spark, d).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


def hybrid_sparse(spark, d):
    return _sparse(spark, d).select("query_id", "doc_id", "rank")


def hybrid_seeds(spark, d):
    return _seeds(spark, d).select("query_id", "uri")


def hybrid_along(spark, d):
    return _along(spark, d).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def hybrid_fused(spark, d):
    return _fused(spark, d).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def typed_channel(spark, d):
    """Vectors and words among documents of the question's category."""
    return _typed(spark, d, False).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def typed_channel_central(spark, d):
    """The same with the most central documents of the category, as for questions that list or count."""
    return _typed(spark, d, True).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def candidate_features(spark, d):
    f = _features(spark, d)
    return f.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in ("norm", "link", "modifier", "bonus")), "degree")


def coherent_selection(spark, d):
    """Ten of the pool by relevance, connection and diversity."""
    return _chosen(spark, d)


def dual_merge(spark, d):
    """The lists by words and by vectors taken in turn, ten in all."""
    return retrieval.interleaved(_sparse(spark, d), _dense(spark, d), 10)


def triples_enrichment(spark, d):
    """What the graph tells of the documents chosen for each question, within its budget of characters."""
    s = store(spark, d)
    typed = _chosen(spark, d).join(_corpus(spark, d).select(F.col("uri").alias("doc_id"), "doc_type"), "doc_id").withColumnRenamed("doc_id", "uri").withColumnRenamed("turn", "place")
    return enrich.relationships(typed, s.all_edges, s.vertices, graph.time_spans(s.literals))


def statistics_text(spark, d):
    """The overview of the collection for questions on actors and things."""
    s = store(spark, d)
    docs = s.vertices.where("is_doc")
    best = ranks.ranked_documents(s.pagerank, docs.where("fc IN ('Actor', 'Thing')").select("uri", "fc"), 40, 20).join(s.vertices.select("uri", "label"), "uri")
    works = relations.actor_works(s.all_edges).withColumnRenamed("actor", "uri").join(s.vertices.select("uri", "label"), "uri")
    return enrich.overview(graph.type_counts(s.vertices), graph.fc_counts(s.vertices), best, works, relations.summaries(s.shortcuts, 15), s.vertices, ("Actor", "Thing"))


def text_batches(spark, d):
    """Documents in batches of equal cost for a model, by length."""
    sized = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    return retrieval.batches(sized)


def document_vectors(spark, d):
    """Vectors by type: number, least, mean and most of their length."""
    c = _corpus(spark, d).withColumn("n", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    return c.groupBy("doc_type").agg(F.count("*").alias("n"), *(F.round(f("n"), 6).alias(a) for f, a in ((F.min, "least"), (F.avg, "mean"), (F.max, "most"))))


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_dense, hybrid_sparse, hybrid_seeds, hybrid_along, hybrid_fused, typed_channel, typed_channel_central, candidate_features, coherent_selection, dual_merge, triples_enrichment, statistics_text,
        text_batches, document_vectors,
    )
}

_MODIFIER = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in retrieval.TYPE_MODIFIERS.items()) + " END"
_BASE = (
    _FR
    + f""", docr AS (SELECT {_sql_term("id")} AS uri, embedding::DOUBLE[] AS vec, coalesce(label, '') AS label, doc_type, all_types FROM graph_documents),
co AS MATERIALIZED (SELECT uri, min({{'vec': vec, 'label': label, 'doc_type': doc_type, 'all_types': all_types}}) AS x FROM docr WHERE uri <> '' AND uri NOT LIKE '\\_:%' ESCAPE '\\' AND len(vec) = {DIMS} AND len(list_filter(vec, lambda y: y IS NULL OR isnan(y))) = 0 AND len(list_filter(vec, lambda y: y <> 0)) > 0 GROUP BY ALL),
cp AS MATERIALIZED (SELECT uri, x.vec AS vec, x.label AS label, x.doc_type AS doc_type, x.all_types AS all_types FROM co),
dx AS MATERIALIZED (SELECT doc_id, text, {_sql_term("entity_uri")} AS uri FROM documents WHERE {_sql_term("entity_uri")} IN (SELECT uri FROM cp)),
aq AS MATERIALIZED (SELECT doc_id AS query_id, uri, text, vec FROM dx JOIN cp USING (uri) WHERE doc_id % 100 = 0),
gf AS (SELECT {_sql_term("id")} AS uri, unnest(all_types) AS t FROM graph_documents),
ca AS MATERIALIZED (SELECT DISTINCT c.fc, uri AS doc_id FROM gf JOIN fc_classes c ON lower(class_local) = lower(regexp_extract(t, '([^/#]*)$', 1)) WHERE uri IN (SELECT uri FROM cp)),
qf AS MATERIALIZED (SELECT query_id, fc FROM aq JOIN v USING (uri)),
al2 AS MATERIALIZED (SELECT query_id, cp.uri AS doc_id, pow(list_distance(aq.vec, cp.vec), 2) AS distance FROM aq, cp),
dn AS MATERIALIZED (SELECT query_id, doc_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank FROM al2) WHERE rank <= {POOL}),
bt1 AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM dx),
bp AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM bt1 GROUP BY ALL), bl AS (SELECT doc_id, sum(tf) AS dl FROM bp GROUP BY ALL), bn AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM bl), bf AS (SELECT term, count(*) AS df FROM bp GROUP BY ALL),
bs AS (SELECT q.doc_id AS query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf / (p.tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))) AS score FROM bp q JOIN bf USING (term) JOIN bp p USING (term) JOIN bl ON bl.doc_id = p.doc_id, bn WHERE q.doc_id IN (SELECT query_id FROM aq) GROUP BY ALL),
wd AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs WHERE score > 0) WHERE rank <= {5 * POOL}),
sx AS (SELECT query_id, uri AS doc_id, min(rank) AS r FROM wd JOIN dx USING (doc_id) WHERE rank <= {POOL} GROUP BY ALL),
sr AS MATERIALIZED (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS rank FROM sx)"""
)
_SEEDS = (
    _BASE
    + f""", fx AS (SELECT CASE WHEN (SELECT count(*) FROM ca WHERE fc = 'Actor') >= {retrieval.SPARSE} THEN 'Actor' ELSE 'Thing' END AS fc),
sn1 AS (SELECT query_id, al2.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), al2.doc_id) AS rank FROM al2 JOIN ca ON ca.doc_id = al2.doc_id JOIN fx USING (fc)),
tm AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(text, '{_NAMED}')) AS term FROM aq),
tf1 AS (SELECT query_id, term, min(v.uri) AS doc_id FROM tm JOIN v ON lower(trim(label)) = lower(trim(term)) GROUP BY ALL),
sb AS (SELECT query_id, doc_id, min(rank) AS rank FROM (SELECT query_id, doc_id, 0 AS rank FROM tf1 WHERE doc_id IN (SELECT uri FROM cp) UNION ALL SELECT query_id, doc_id, rank FROM sn1 WHERE rank <= {SEEDS}) GROUP BY ALL),
s5f AS (SELECT * FROM (SELECT query_id, doc_id AS uri, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS r FROM sb) WHERE r <= {SEEDS}),
dg AS MATERIALIZED (SELECT uri, count(*) AS degree FROM (SELECT src AS uri FROM ae UNION ALL SELECT dst FROM ae) GROUP BY ALL),
sh AS (SELECT s5f.*, coalesce(degree, 0) >= {retrieval.HUB} AS hub FROM s5f LEFT JOIN dg USING (uri)),
seeds AS MATERIALIZED (SELECT query_id, uri FROM sh QUALIFY NOT hub OR (min(hub::INT) OVER (PARTITION BY query_id) = 1 AND row_number() OVER (PARTITION BY query_id ORDER BY r) = 1)),
pu AS MATERIALIZED (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM ae UNION ALL SELECT dst, src, weight FROM ae) GROUP BY ALL),
px AS MATERIALIZED (SELECT pu.src, dst, w / o AS share FROM pu JOIN (SELECT src, sum(w) AS o FROM pu GROUP BY ALL) z ON z.src = pu.src)"""
)


def _pushed_sql(seeds: str, name: str) -> str:
    """CTEs ending in `name`(query_id, uri, rank), from `seeds` (query_id, uri)."""
    out = f", {name}_0 AS MATERIALIZED (SELECT query_id, uri, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS mass FROM (SELECT DISTINCT query_id, uri FROM {seeds}))"
    for i in range(ROUNDS):
        out += f", {name}_{i + 1} AS MATERIALIZED (SELECT query_id, dst AS uri, sum(0.85::DOUBLE * mass * share) AS mass FROM {name}_{i} JOIN px ON px.src = uri WHERE mass >= {LEAST} GROUP BY ALL)"
    parts = [f"SELECT query_id, uri, CASE WHEN mass >= {LEAST} THEN 0.15::DOUBLE * mass ELSE mass END AS mass FROM {name}_{i}" for i in range(ROUNDS)] + [f"SELECT query_id, uri, mass FROM {name}_{ROUNDS}"]
    return out + f", {name} AS MATERIALIZED (SELECT query_id, uri, sum(mass) AS rank FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"


def _rrf(name: str, *lists: str) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {x}" for x in lists)
    return f""", {name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(1.0::DOUBLE / ({retrieval.RRF} + rank)) AS score FROM ({union}) GROUP BY ALL)) WHERE rank <= {POOL})"""


_ALONG = (
    _SEEDS
    + _pushed_sql("seeds", "ps1")
    + f""", aw AS MATERIALIZED (SELECT * FROM (SELECT query_id, uri AS doc_id, rank AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 12) DESC, uri) AS rank FROM ps1 WHERE uri IN (SELECT uri FROM cp) AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = ps1.query_id AND s.uri = ps1.uri)) WHERE rank <= {POOL})"""
)
_OWN = "NOT EXISTS (SELECT 1 FROM aq WHERE aq.query_id = x.query_id AND aq.uri = x.doc_id)"
_FUSED = (
    _ALONG
    + f""", dn2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dn x WHERE {_OWN}), sr2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM sr x WHERE {_OWN})"""
    + _rrf("fu", "dn2", "sr2", "aw")
)
_TYPED = f""", tn AS MATERIALIZED (SELECT * FROM (SELECT query_id, al2.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), al2.doc_id) AS rank FROM al2 JOIN qf USING (query_id) JOIN ca ON ca.doc_id = al2.doc_id AND ca.fc = qf.fc) WHERE rank <= {POOL}),
tw AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS rank FROM (SELECT query_id, uri AS doc_id, min(rank) AS r FROM wd JOIN dx USING (doc_id) JOIN qf USING (query_id) WHERE EXISTS (SELECT 1 FROM ca WHERE ca.fc = qf.fc AND ca.doc_id = dx.uri) GROUP BY ALL)) WHERE rank <= {POOL})""" + _rrf("ty1", "tn", "tw")
_CENTRAL = f""", bc AS (SELECT uri, rank, fc, row_number() OVER (PARTITION BY fc ORDER BY round(rank, 12) DESC, uri) AS f FROM pr JOIN v USING (uri) WHERE rank > 0 AND uri IN (SELECT uri FROM cp)),
bd AS (SELECT * FROM bc WHERE f <= {POOL} ORDER BY round(rank, 12) DESC, uri LIMIT {10 * POOL}), be AS (SELECT query_id, uri AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 12) DESC, uri) AS rank FROM bd JOIN qf USING (fc))""" + _rrf("ty2", "ty1", "be")
_SLOTS = int(POOL * 0.3)
_POOL = (
    _FUSED
    + _TYPED
    + f""", mm AS (SELECT query_id, doc_id, score FROM fu WHERE rank <= {POOL - _SLOTS}), mt AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM ty1 x WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.query_id = x.query_id AND mm.doc_id = x.doc_id)),
ml AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT * FROM mm UNION ALL SELECT query_id, doc_id, score FROM mt WHERE r <= {_SLOTS})),
mc AS (SELECT ml.*, cp.label, cp.doc_type, cp.all_types, cp.vec, coalesce(doc_type IN ({", ".join(f"'{x}'" for x in retrieval.NON_INFORMATIVE)}) OR len(list_filter(all_types, lambda t: regexp_extract(t, '([^/#]*)$', 1) IN ({", ".join(f"'{x}'" for x in retrieval.NON_INFORMATIVE)}))) > 0, false) AS dull FROM ml JOIN cp ON cp.uri = doc_id WHERE rank <= {POOL}),
md AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, dull ORDER BY rank) AS k FROM mc),
me AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM md WHERE NOT dull OR k <= greatest(1, floor(0.25 * n))),
pool AS MATERIALIZED (SELECT query_id, doc_id, rank, label, doc_type, all_types, vec, CASE WHEN hi - lo < 1e-10 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS norm FROM me),
best AS MATERIALIZED (SELECT query_id, doc_id AS uri FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {SEEDS})"""
    + _pushed_sql("best", "ps2")
    + f""", lk AS (SELECT pool.*, CASE WHEN b.uri IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(w.rank, 0.0) END AS mass FROM pool LEFT JOIN best b ON b.query_id = pool.query_id AND b.uri = doc_id LEFT JOIN ps2 w ON w.query_id = pool.query_id AND w.uri = doc_id),
ln1 AS (SELECT *, min(mass) OVER (PARTITION BY query_id) AS lo, max(mass) OVER (PARTITION BY query_id) AS hi FROM lk),
ub AS MATERIALIZED (SELECT src, dst FROM ae WHERE src <> dst UNION SELECT dst, src FROM ae WHERE src <> dst),
pq AS MATERIALIZED (SELECT DISTINCT aq.uri AS a, doc_id AS b FROM pool JOIN aq USING (query_id) WHERE aq.uri <> doc_id),
na AS MATERIALIZED (SELECT a, dst AS x FROM (SELECT DISTINCT a FROM pq) JOIN ub ON src = a), nb AS MATERIALIZED (SELECT b, dst AS y FROM (SELECT DISTINCT b FROM pq) JOIN ub ON src = b),
ds1 AS MATERIALIZED (SELECT a, b, min(d) AS distance FROM (SELECT a, b, 1 AS d FROM pq JOIN ub ON src = a AND dst = b UNION ALL SELECT a, b, 2 FROM pq JOIN na USING (a) JOIN nb USING (b) WHERE x = y UNION ALL SELECT a, b, 3 FROM pq JOIN na USING (a) JOIN nb USING (b) JOIN ub ON src = x AND dst = y) GROUP BY ALL),
ft AS MATERIALIZED (SELECT l.query_id, l.doc_id, l.rank, l.norm, CASE WHEN hi - lo < 1e-10 THEN 1.0 ELSE (mass - lo) / (hi - lo) END AS link, lower(trim(l.label)) AS label, l.doc_type, coalesce({_MODIFIER.format("l.doc_type")}, list_filter(list_transform(all_types, lambda t: {_MODIFIER.format("regexp_extract(t, '([^/#]*)$', 1)")}), lambda m: m IS NOT NULL)[1], 0.0)::DOUBLE AS modifier,
  coalesce(CASE distance WHEN 1 THEN 0.15 WHEN 2 THEN 0.10 WHEN 3 THEN 0.05 END, 0.0)::DOUBLE AS bonus, coalesce(degree, 0) AS degree, l.vec FROM ln1 l JOIN aq USING (query_id) LEFT JOIN ds1 ON a = aq.uri AND b = l.doc_id LEFT JOIN dg ON dg.uri = l.doc_id)"""
)
# the greedy choice as a recursion: every round adds the best of those left
_CHOSEN = (
    _POOL
    + f""", sm AS MATERIALIZED (SELECT x.query_id, x.doc_id AS a, y.doc_id AS b, list_cosine_similarity(x.vec, y.vec) AS cos, x.label = y.label AND x.label <> '' AS same FROM ft x JOIN ft y USING (query_id)),
pick AS (SELECT query_id, [arg_min(doc_id, {{'v': -round(norm * (1 + modifier), 12), 'd': doc_id}})] AS chosen FROM ft GROUP BY ALL UNION ALL
SELECT query_id, list_append(any_value(chosen), arg_min(doc_id, {{'v': -round(((0.7 * norm + 0.3 * link) - 0.2 * near * CASE WHEN same THEN 0.3 ELSE 1.0 END) * (1 + modifier) + bonus - CASE WHEN degree > {retrieval.MEGA} THEN {retrieval.MEGA_PENALTY} ELSE 0 END, 12), 'd': doc_id}})) FROM (
  SELECT p.query_id, p.chosen, f.doc_id, f.norm, f.link, f.modifier, f.bonus, f.degree, max(sm.cos) AS near, bool_or(sm.same) AS same FROM pick p JOIN ft f USING (query_id) JOIN sm ON sm.query_id = p.query_id AND sm.a = f.doc_id AND list_contains(p.chosen, sm.b)
  WHERE NOT list_contains(p.chosen, f.doc_id) AND len(p.chosen) < 10 GROUP BY ALL) GROUP BY query_id),
fin AS MATERIALIZED (SELECT query_id, arg_max(chosen, len(chosen)) AS chosen FROM pick GROUP BY ALL),
cho AS MATERIALIZED (SELECT query_id, unnest(chosen) AS doc_id, unnest(range(1, len(chosen) + 1))::INTEGER AS turn FROM fin)"""
)
_SKIP = ", ".join(f"'{x}'" for x in enrich.SKIPPED)
ORACLES = {
    "hybrid_dense": _BASE + "SELECT query_id, doc_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM dn",
    "hybrid_sparse": _BASE + "SELECT query_id, doc_id, rank::INTEGER AS rank FROM sr",
    "hybrid_seeds": _SEEDS + "SELECT query_id, uri FROM seeds",
    "hybrid_along": _ALONG + "SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM aw",
    "hybrid_fused": _FUSED + "SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM fu",
    "typed_channel": _BASE + _TYPED + "SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM ty1",
    "typed_channel_central": _BASE + _TYPED + ", " + _pagerank_sql("SELECT src, dst, 1.0::DOUBLE AS w FROM fr", "true") + _CENTRAL + "SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM ty2",
    "candidate_features": _POOL + "SELECT query_id, doc_id, round(norm, 6) AS norm, round(link, 6) AS link, round(modifier, 6) AS modifier, round(bonus, 6) AS bonus, degree FROM ft",
    "coherent_selection": _CHOSEN + "SELECT query_id, doc_id, turn FROM cho",
    "dual_merge": _BASE + "SELECT query_id, doc_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, doc_id) AS rank FROM (SELECT query_id, doc_id, min(place) AS place FROM (SELECT query_id, doc_id, 2 * rank AS place FROM sr UNION ALL SELECT query_id, doc_id, 2 * rank + 1 FROM dn) GROUP BY ALL)) WHERE rank <= 10",
    "text_batches": "WITH s AS (SELECT doc_id AS id, length(text) AS n, CASE WHEN length(text) >= 16000 THEN 16 WHEN length(text) >= 8000 THEN 8 WHEN length(text) >= 4000 THEN 4 ELSE 1 END AS f FROM documents WHERE text IS NOT NULL) SELECT id, f || '-' || ((row_number() OVER (PARTITION BY f ORDER BY n, id) - 1) * f // 64) AS batch FROM s",
    "document_vectors": _BASE + "SELECT doc_type, count(*) AS n, round(min(l), 6) AS least, round(avg(l), 6) AS mean, round(max(l), 6) AS most FROM (SELECT doc_type, sqrt(list_dot_product(vec, vec)) AS l FROM cp) GROUP BY ALL",
    "triples_enrichment": _CHOSEN + _SPANS + f""", dc AS (SELECT cho.query_id, cho.doc_id AS uri, turn AS place, CASE WHEN cp.doc_type IN ({", ".join(f"'{x}'" for x in enrich.FIRST_TYPES)}) THEN 0 ELSE 1 END AS later FROM cho JOIN cp ON cp.uri = cho.doc_id),
ti AS (SELECT query_id, later, place, src AS uri, dst AS other, 'out' AS direction, p_key, predicate_label FROM ae JOIN dc ON dc.uri = src UNION ALL SELECT query_id, later, place, dst, src, 'in', p_key, predicate_label FROM ae JOIN dc ON dc.uri = dst WHERE src <> dst),
tj AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM dc WHERE dc.query_id = ti.query_id AND dc.uri = ti.other) THEN 0 WHEN regexp_matches(p_key, '{"|".join(enrich.FIRST)}') THEN 1 WHEN predicate_label <> '' THEN 2 ELSE 3 END AS priority FROM ti WHERE lower(trim(predicate_label)) NOT IN ({_SKIP})),
tk AS (SELECT *, row_number() OVER (PARTITION BY query_id, uri ORDER BY priority, p_key, direction, other) AS r FROM tj),
tl AS (SELECT tk.*, CASE WHEN direction = 'out' AND p_key IN ('p4_has_time-span', 'p4i_is_time-span_of') AND span IS NOT NULL THEN '  - date: ' || span WHEN direction = 'out' THEN '  - ' || predicate_label || ': ' || coalesce(label, regexp_extract(other, '([^/#]*)$', 1)) ELSE '  - [' || coalesce(label, regexp_extract(other, '([^/#]*)$', 1)) || '] ' || predicate_label END AS line FROM tk LEFT JOIN v ON v.uri = other LEFT JOIN sp ON sp.uri = other WHERE r <= {enrich.SCANNED}),
tm1 AS (SELECT query_id, later, place, uri, line, min(r) AS r FROM tl GROUP BY ALL), tn1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, uri ORDER BY r) AS q FROM tm1),
to1 AS (SELECT query_id, later, place, uri, string_agg(line, chr(10) ORDER BY q) AS lines FROM tn1 WHERE q <= {enrich.LINES} GROUP BY ALL),
tp AS (SELECT to1.*, coalesce(label, regexp_extract(uri, '([^/#]*)$', 1)) || ':' || chr(10) || lines AS s0, greatest({enrich.LEAST_CHARS}, {enrich.CHARS} // count(*) OVER (PARTITION BY query_id)) AS share FROM to1 LEFT JOIN v USING (uri)),
tq AS (SELECT *, CASE WHEN length(s0) > share THEN s0[1:share] || '...' ELSE s0 END AS section FROM tp),
tr AS (SELECT *, sum(length(section) + 2) OVER (PARTITION BY query_id ORDER BY later, place ROWS UNBOUNDED PRECEDING) AS after FROM tq),
ts1 AS (SELECT *, coalesce(max(CASE WHEN after > {enrich.CHARS} THEN 1 END) OVER (PARTITION BY query_id ORDER BY later, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, {enrich.CHARS} - (after - length(section) - 2) - 2 AS left_ FROM tr),
tt AS (SELECT query_id, later, place, CASE WHEN after <= {enrich.CHARS} THEN section WHEN left_ > {enrich.LEAST_PART} THEN section[1:left_] || '...' END AS part FROM ts1 WHERE full_ = 0)
SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY later, place) AS text FROM tt WHERE part IS NOT NULL GROUP BY ALL""",
}
