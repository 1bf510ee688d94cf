"""Queries on the property graph of the given statements, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, labels, ranks, relations, satellites, texts
from ..session import Cut, shared_folder, table
from ..streaming import ingest
from .problems import _sql_term
from .store import store


def _covered():
    """Whether an edge's property begins a derived relation."""
    return relations.code_of(F.col("p_key")).isin(sorted(relations.step0()))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """The edges that no shortcut replaces."""
    return store(spark, d).all_edges.where("edge_type = 'rdf'")


def entity_discovery(spark, d):
    """URIs with statements that are no authority terms."""
    return graph.discovered(table(spark, d, "triples"), table(spark, d, "authority_terms"))


def described_entities(spark, d):
    """URIs with at least one literal that are no authority terms."""
    return graph.discovered(table(spark, d, "triples"), table(spark, d, "authority_terms")).join(store(spark, d).literals.select("uri").distinct(), "uri", "left_semi")


def entity_types(spark, d):
    return store(spark, d).types.groupBy("uri").agg(F.array_join(F.sort_array(F.collect_set("type_uri")), " ").alias("types"))


def class_labels(spark, d):
    """The label of every class in use, and whether its name is a technical one."""
    return labels.class_labels(store(spark, d).types)


def edge_list(spark, d):
    return store(spark, d).edges


def all_edges(spark, d):
    """Plain edges and the shortcuts that replace some of them, in one table."""
    return store(spark, d).all_edges


def vertex_list(spark, d):
    return store(spark, d).vertices


def literal_map(spark, d):
    return store(spark, d).literals.select("uri", "prop", F.array_join("vals", " | ").alias("vals"))


def schema_statements(spark, d):
    """Statements by whether their predicate is one of the schema, with the number of properties."""
    return store(spark, d).statements.groupBy("schema").agg(F.count("*").alias("n"), F.count_distinct("p_key").alias("properties"))


def degree(spark, d):
    return graph.degrees(store(spark, d).edges)


def type_counts(spark, d):
    return graph.type_counts(store(spark, d).vertices)


def fc_counts(spark, d):
    return graph.fc_counts(store(spark, d).vertices)


def neighbours_of_activities(spark, d):
    """All edges of activities with the label of the other end."""
    s = store(spark, d)
    return graph.neighbours(s.edges, s.vertices.where(F.col("uri").contains("/activity/")), s.vertices)


def neighbours_by_predicate(spark, d):
    """Edges of activities, plain and shortcut, by predicate label and direction."""
    s = store(spark, d)
    n = graph.neighbours(s.all_edges, s.vertices.where(F.col("uri").contains("/activity/")))
    return n.groupBy("uri", "predicate_label", "direction", "edge_type").agg(F.count("*").alias("n"))


def within_two_steps(spark, d):
    """Steps from the nearest group, two at most."""
    s = store(spark, d)
    return ranks.distances(s.edges, s.vertices.where(F.col("uri").contains("/group/")), 2)


def distances_of_works(spark, d):
    """Steps of each work from the nearest group, -1 beyond two."""
    s = store(spark, d)
    of = lambda kind: s.vertices.where(F.col("uri").contains(f"/{kind}/"))
    return ranks.distances(s.edges, of("group"), 2, of("work"))


def direct_predicates(spark, d):
    return graph.direct_predicates(_plain(spark, d), store(spark, d).vertices, _covered())


def _anonymous(spark, d):
    s = store(spark, d)
    return graph.anonymous_events(s.vertices, s.edges, s.satellites)


def anonymous_events(spark, d):
    return _anonymous(spark, d)


def contracted_edges(spark, d):
    return graph.contracted(store(spark, d).edges, _anonymous(spark, d)).select("src", "dst", "p_key")


def satellite_kinds(spark, d):
    return store(spark, d).satellites


def satellite_parents(spark, d):
    s = store(spark, d)
    return satellites.parents(s.satellites, s.all_edges)


def time_spans(spark, d):
    """Begin and end of all that is dated, as text."""
    return graph.time_spans(store(spark, d).literals)


def entity_dates(spark, d):
    """The dates of time-spans and of what has one."""
    s = store(spark, d)
    return graph.dates(graph.time_spans(s.literals), s.edges)


def shortcut_edges(spark, d):
    return store(spark, d).shortcuts


def uncovered_edges(spark, d):
    return _plain(spark, d).select("src", "dst", "p_key")


def shortcut_summaries(spark, d):
    return relations.summaries(store(spark, d).shortcuts)


def shortcut_targets(spark, d):
    return relations.listed(store(spark, d).shortcuts)


def shortcut_overlaps(spark, d):
    return relations.overlapping(store(spark, d).shortcuts)


def actor_work_counts(spark, d):
    """Distinct works by actor: by shortcuts from things to actors, and through events of production or use that the actor carried out."""
    return relations.actor_works(store(spark, d).all_edges)


def works_of_editions(spark, d):
    """Works joined on a computed key: the URI of a production with `/production/` read as `/work/`, and whether such a work exists."""
    v = store(spark, d).vertices
    made = v.where(F.col("uri").contains("/production/")).select(F.col("uri").alias("production"), F.regexp_replace("uri", "/production/", "/work/").alias("work"))
    return made.join(v.select(F.col("uri").alias("work"), F.col("label").alias("work_label")), "work", "left").select("production", "work", "work_label")


def _documents_with_fc(spark, d):
    return store(spark, d).vertices.where("is_doc").select("uri", "fc")


def pagerank_top(spark, d):
    """The 20 documents of highest rank over shortcut edges."""
    return ranks.ranked_documents(store(spark, d).pagerank, _documents_with_fc(spark, d), 20).select("uri", F.round("rank", 9).alias("rank"))


def pagerank_per_fc(spark, d):
    """The documents of highest rank, five of each category at most, 100 in all."""
    return ranks.ranked_documents(store(spark, d).pagerank, _documents_with_fc(spark, d), 100, 5).select("uri", F.round("rank", 9).alias("rank"), "fc")


def pagerank_candidates(spark, d):
    """The 20 documents of highest rank among actors and things."""
    docs = _documents_with_fc(spark, d).where("fc IN ('Actor', 'Thing')")
    return ranks.ranked_documents(store(spark, d).pagerank, docs, 20).select("uri", F.round("rank", 9).alias("rank"), "fc")


def personalised_pagerank(spark, d):
    """The 100 documents of highest rank from the agents as starts, over all edges both ways; starts are left out."""
    s = store(spark, d)
    seeds = s.vertices.where(F.col("uri").contains("/agent/")).select("uri")
    found = ranks.pagerank(s.all_edges, seeds=seeds, undirected=True).join(seeds, "uri", "left_anti")
    return ranks.ranked_documents(found, _documents_with_fc(spark, d), 100).select("uri", F.round("rank", 9).alias("rank"))


def preferred_labels(spark, d):
    """The label of every vertex by the order of preference of its literals and names."""
    s = store(spark, d)
    return labels.preferred(s.vertices, s.literals, s.edges)


def labels_found(spark, d):
    """The five vertices at most that have the label of a group or activity."""
    v = store(spark, d).vertices
    return labels.find(v, v.where("uri LIKE '%/group/%' OR uri LIKE '%/activity/%'").select("label").distinct())


def label_search(spark, d):
    """Twenty vertices at most whose label contains a word of the authority terms."""
    terms = table(spark, d, "authority_terms").select(F.explode(F.split(F.lower("label"), "[^a-z]+")).alias("term")).where("length(term) > 4").distinct()
    return labels.search(store(spark, d).vertices, terms)


def _relation_links(spark, d):
    """Shortcuts by relation in the order of the catalogue."""
    place = F.create_map(*(F.lit(x) for i, r in enumerate(relations.COMPACT) for x in (r.id, i)))
    label = F.create_map(*(F.lit(x) for pair in relations.LABELS.items() for x in pair))
    return store(spark, d).shortcuts.select(F.col("src").alias("uri"), F.element_at(place, F.col("relation")).alias("place"), F.element_at(label, F.col("relation")).alias("label"), F.col("dst").alias("other"))


def target_enrichments(spark, d):
    s = store(spark, d)
    return texts.enrichments(_plain(spark, d), s.vertices).withColumn("attributes", F.array_join("attributes", ", "))


def relations_kept(spark, d):
    """Relations of a document whose targets aren't mostly those of a larger one."""
    kept = texts.without_overlaps(texts.shown_targets(_relation_links(spark, d), store(spark, d).vertices))
    return kept.groupBy("uri", "place").agg(F.count("*").alias("shown"))


def _documents(spark, d):
    s = store(spark, d)

    def make():
        plain, spans = _plain(spark, d), graph.time_spans(s.literals)
        told, dates = Cut(texts.enrichments(plain, s.vertices)), Cut(graph.dates(spans, s.edges))
        derived = texts.without_overlaps(Cut(texts.shown_targets(_relation_links(spark, d), s.vertices)).df)
        direct = texts.shown_targets(graph.direct_links(plain, _covered()).select("uri", F.lit(0).alias("place"), "label", "other"), s.vertices)
        lines = texts.relation_lines(derived, told.df, dates.df).withColumn("direct", F.lit(False))
        lines = lines.unionByName(texts.relation_lines(direct, told.df, dates.df).withColumn("direct", F.lit(True)))
        absorbed = texts.absorbed_lines(satellites.parents(s.satellites, s.all_edges), s.vertices, spans)
        return texts.documents(s.vertices, s.literals, Cut(lines).df, absorbed, texts.referred(plain, s.vertices), labels.types_shown(s.types, s.satellites))

    return s.kept("documents", make)


def entity_documents(spark, d):
    return _documents(spark, d)


def entity_markdown(spark, d):
    """The documents as files with a header; the types, Wikidata id and images of those that graph_documents has."""
    s = store(spark, d)
    about = graph.document_facts(table(spark, d, "graph_documents"))
    return texts.markdown(s.vertices.join(_documents(spark, d), "uri").join(about, "uri", "left"))


def entity_records(spark, d):
    return texts.records(store(spark, d).vertices)


def chained_documents(spark, d):
    s = store(spark, d)
    return texts.chained(_documents(spark, d), s.all_edges, s.vertices.select("uri", "label", F.col("doc_type").alias("type")))


def document_lengths(spark, d):
    """Documents by category: number, least, mean and most characters, and tokens estimated at four characters each."""
    n = F.length("doc")
    g = _documents(spark, d).join(store(spark, d).vertices.select("uri", "fc"), "uri").groupBy("fc")
    return g.agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.expr("sum(length(doc)) div count(*)").alias("mean"), F.expr("sum(length(doc) div 4)").alias("tokens"))


def export_counts(spark, d):
    """Vertices and edges of an export, by category of the source."""
    e, v = store(spark, d).edges, store(spark, d).vertices
    n = e.join(v.select(F.col("uri").alias("src"), "fc"), "src", "left").groupBy(F.coalesce("fc", F.lit("")).alias("fc")).agg(F.count("*").alias("edges"))
    return v.groupBy("fc").agg(F.count("*").alias("nodes")).join(n, "fc", "full").select("fc", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def streamed_windows(spark, d):
    """Events counted in daily windows by a stream over the whole table."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    found = ingest.run_once(ingest.windowed(ingest.parquet_stream(spark, d, "events")), folder, ["window_start", "event_type"])
    return found.select("window_start", "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_discovery, described_entities, entity_types, class_labels, edge_list, all_edges, vertex_list, literal_map, schema_statements, degree, type_counts, fc_counts, neighbours_of_activities, neighbours_by_predicate,
        within_two_steps, distances_of_works, direct_predicates, anonymous_events, contracted_edges, satellite_kinds, satellite_parents, time_spans, entity_dates, shortcut_edges, uncovered_edges, shortcut_summaries,
        shortcut_targets, shortcut_overlaps, actor_work_counts, works_of_editions, pagerank_top, pagerank_per_fc, pagerank_candidates, personalised_pagerank, preferred_labels, labels_found, label_search, target_enrichments,
        relations_kept, entity_documents, entity_markdown, entity_records, chained_documents, document_lengths, export_counts, streamed_windows,
    )
}

_SCHEMA = "regexp_matches(p, '" + "|".join(graph.SCHEMA_PATTERNS) + "')"
_WEIGHT = "CASE " + " ".join(f"WHEN p_key = '{k.lower()}' THEN {v}" for k, v in graph.WEIGHTS.items()) + f" ELSE {graph.DEFAULT_WEIGHT} END"
_PRIO = "CASE f.fc " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in graph.FC_PRIORITY.items()) + " ELSE 0 END"
_LOCAL = "regexp_extract({}, '([^/#]*)$', 1)"


def _named(x: str) -> str:
    return f"({x} <> '' AND {x} NOT LIKE '\\_:%' ESCAPE '\\')"


def _in(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(values)) + ")"


_GRAPH = f"""
WITH RECURSIVE d AS (SELECT {_sql_term("subject")} AS s, {_sql_term("predicate")} AS p, {_sql_term("object")} AS o FROM triples),
st AS MATERIALIZED (SELECT s, lower({_LOCAL.format("p")}) AS p_key, o, bool_or({_SCHEMA}) AS schema FROM d WHERE {_named("s")} AND {_named("o")} AND p IS NOT NULL GROUP BY ALL),
pl AS (SELECT lower({_LOCAL.format("property")}) AS p_key, min(label) AS label FROM property_labels GROUP BY ALL),
e AS MATERIALIZED (SELECT s AS src, o AS dst, p_key, coalesce(label, p_key) AS predicate_label, CAST({_WEIGHT} AS DOUBLE) AS weight
  FROM st LEFT JOIN pl USING (p_key) WHERE regexp_matches(s, '^https?://') AND regexp_matches(o, '^https?://') AND NOT schema),
tu AS (SELECT DISTINCT {_sql_term("uri")} AS uri, {_sql_term("type_uri")} AS type_uri FROM entity_types WHERE uri IS NOT NULL AND type_uri IS NOT NULL),
ty AS (SELECT uri, arg_max(f.fc, {_PRIO}) AS fc FROM (SELECT uri, lower({_LOCAL.format("type_uri")}) AS k FROM tu) t JOIN fc_classes f ON lower(f.class_local) = k WHERE {_named("uri")} GROUP BY ALL),
w AS (SELECT {_sql_term("name")} AS uri, label, fc, doc_type, is_doc, loaded_at FROM vertices UNION ALL SELECT uri, NULL, NULL, NULL, NULL, NULL FROM (SELECT src AS uri FROM e UNION SELECT dst FROM e)),
g AS (SELECT uri, min(CASE WHEN label <> '' AND label <> {_LOCAL.format("uri")} THEN {{'t': loaded_at, 'l': label}} END).l AS label, min(nullif(fc, '')) AS written,
  coalesce(min(nullif(doc_type, '')), '') AS doc_type, max(coalesce(is_doc, false)) AS is_doc FROM w WHERE {_named("uri")} GROUP BY ALL),
v AS MATERIALIZED (SELECT uri, coalesce(label, {_LOCAL.format("uri")}) AS label, coalesce(ty.fc, written, '') AS fc, doc_type, is_doc FROM g LEFT JOIN ty USING (uri)),
sk AS (SELECT uri, CASE {" ".join(f"WHEN lower({_LOCAL.format('type_uri')}) IN {_in(c.lower() for c in cs)} THEN {i}" for i, cs in enumerate(satellites.KINDS.values()))} END AS k FROM tu),
sat AS MATERIALIZED (SELECT uri, {list(satellites.KINDS)}[min(k) + 1] AS kind FROM sk WHERE k IS NOT NULL GROUP BY ALL),
rights AS (SELECT DISTINCT uri FROM tu WHERE lower({_LOCAL.format("type_uri")}) IN {_in(c.lower() for c in satellites.RIGHTS_AND_NAMES)})
"""


def _shortcut_sql() -> str:
    """CTEs of the paths, a step each, ending in fr(src, relation, dst) and ae, all edges."""
    ctes, union, seen = [], [], set()
    code = "regexp_extract(p_key, '^([a-z]\\d+i?)_', 1)"
    ctes.append(f"coded AS MATERIALIZED (SELECT DISTINCT src, dst, upper({code}[1]) || {code}[2:] AS code FROM e WHERE {code} <> '')")

    def step(prop: str, many: bool = False) -> str:
        if prop not in seen:
            seen.add(prop)
            fam = relations.family(prop)
            ctes.append(f"s_{prop} AS MATERIALIZED (SELECT src, dst FROM coded WHERE code IN {_in(fam)} UNION SELECT dst, src FROM coded WHERE code IN {_in(relations.inverse(x) for x in fam)})")
        if many and f"{prop}*" not in seen:
            seen.add(f"{prop}*")
            ctes.append(f"c_{prop} AS (SELECT src, dst FROM s_{prop} UNION SELECT c.src, s.dst FROM c_{prop} c JOIN s_{prop} s ON s.src = c.dst)")
            ctes.append(f"m_{prop} AS MATERIALIZED (SELECT * FROM c_{prop})")
        return f"m_{prop}" if many else f"s_{prop}"

    names: dict[tuple, str] = {}
    for r, walk in relations.walks(relations.CATALOGUE, relations.GIVEN):
        for i, (prop, many) in enumerate(walk):
            if (r.domain_fc, walk[: i + 1]) in names:
                continue
            name = names[r.domain_fc, walk[: i + 1]] = f"n{len(names)}"
            if i:
                before = f"(SELECT origin, at_ FROM {names[r.domain_fc, walk[:i]]})"
            else:
                before = f"(SELECT DISTINCT src AS origin, src AS at_ FROM {step(prop)} JOIN v ON v.uri = src WHERE v.fc = '{r.domain_fc}' AND src NOT IN (SELECT uri FROM sat))"
            moved = f"SELECT f.origin, s.dst AS at_ FROM {before} f JOIN {step(prop, many)} s ON s.src = f.at_"
            ctes.append(f"{name} AS MATERIALIZED ({f'SELECT origin, at_ FROM {before} UNION ' if many else 'SELECT DISTINCT * FROM ('}{moved}{'' if many else ')'})")
        barred = " AND origin NOT IN (SELECT uri FROM rights)" * (r.id in relations.OBJECT_DOMAIN) + " AND at_ NOT IN (SELECT uri FROM rights)" * (r.id in relations.OBJECT_RANGE)
        union.append(f"SELECT origin AS src, '{r.id}' AS relation, at_ AS dst FROM {names[r.domain_fc, walk]} LEFT JOIN v ON v.uri = at_ WHERE origin <> at_ AND coalesce(v.fc, '') IN ('', '{r.range_fc}'){barred}")
    ctes.append("fr AS MATERIALIZED (" + " UNION ".join(union) + ")")
    label = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in relations.LABELS.items()) + " END"
    ctes.append("plain AS MATERIALIZED (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.src = e.src AND fr.dst = e.dst))")
    ctes.append(f"ae AS MATERIALIZED (SELECT *, 'rdf' AS edge_type FROM plain UNION ALL SELECT src, dst, relation, {label}, 1.0::DOUBLE, 'fr' FROM fr)")
    return _GRAPH + ", " + ",\n".join(ctes)


_FR = _shortcut_sql()
_COVERED = f"(upper(regexp_extract(p_key, '^([a-z]\\d+i?)_', 1)[1]) || regexp_extract(p_key, '^([a-z]\\d+i?)_', 1)[2:]) IN {_in(relations.step0())}"
_DIRECT = f""", k AS (SELECT * FROM plain WHERE NOT {_COVERED}),
b AS MATERIALIZED (SELECT DISTINCT src AS uri, dst AS other, predicate_label AS label FROM k UNION SELECT dst, src, 'is target of ' || predicate_label FROM k)"""
_BOTH = (
    _DIRECT
    + f""", bt AS (SELECT b.uri, b.label, coalesce(v.label, {_LOCAL.format("other")}) AS target, other FROM b LEFT JOIN v ON v.uri = other),
br AS (SELECT *, row_number() OVER (PARTITION BY uri, label ORDER BY target, other) AS r FROM bt),
dp AS (SELECT uri, label, count(*) AS total, string_agg(CASE WHEN r <= 10 THEN target END, '; ' ORDER BY r) AS targets FROM br GROUP BY ALL)"""
)
_LIT = """, lit AS MATERIALIZED (SELECT s AS uri, p_key AS prop, list_sort(list(DISTINCT o)) AS vals FROM st WHERE regexp_matches(s, '^https?://') AND NOT regexp_matches(o, '^https?://') GROUP BY ALL)"""


def _first(props) -> str:
    return "coalesce(" + ", ".join(f"min(CASE WHEN prop = '{p}' THEN vals[1] END)" for p in props) + ", NULL)"


_SPANS = (
    _LIT
    + f""", ab AS (SELECT uri, {_first(graph.BEGIN)} AS a, {_first(graph.END)} AS b, {_first(graph.WITHIN)} AS c FROM lit WHERE prop IN {_in((*graph.BEGIN, *graph.END, *graph.WITHIN))} GROUP BY ALL),
sp AS MATERIALIZED (SELECT uri, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ' to ' || b WHEN a IS NOT NULL THEN 'from ' || a WHEN b IS NOT NULL THEN 'until ' || b ELSE coalesce(c, '') END AS span FROM ab),
dt AS MATERIALIZED (SELECT uri, coalesce(sp.span, x.far) AS date FROM sp FULL JOIN (SELECT src AS uri, min(span) AS far FROM e JOIN sp ON sp.uri = dst WHERE p_key IN ('p4_has_time-span', 'p4i_is_time-span_of') GROUP BY ALL) x USING (uri))"""
)
_PARENTS = """, pa AS MATERIALIZED (SELECT dst AS uri, sat.kind, min({'p': CASE WHEN edge_type = 'rdf' THEN 0 ELSE 1 END, 's': src}).s AS parent FROM ae JOIN sat ON sat.uri = dst WHERE src NOT IN (SELECT uri FROM sat) GROUP BY ALL)"""


def _told(props) -> str:
    return f"CASE WHEN p_key IN {_in(props)} THEN label END"


_ENRICH = f""", ee AS (SELECT src AS uri, p_key, v.label FROM plain JOIN v ON v.uri = dst WHERE p_key IN {_in((*texts.TAGS, *texts.ATTRIBUTES, *texts.VENUES, *texts.COORDINATES))}),
eg AS (SELECT uri, min({_told(texts.TAGS)}) AS tag, coalesce(list_sort(list(DISTINCT {_told(texts.ATTRIBUTES)}) FILTER ({_told(texts.ATTRIBUTES)} IS NOT NULL))[1:5], []) AS attributes, min({_told(texts.VENUES)}) AS venue, min({_told(texts.COORDINATES)}) AS coordinates FROM ee GROUP BY ALL),
en AS MATERIALIZED (SELECT * FROM (SELECT uri, coalesce(tag, CASE WHEN doc_type NOT IN ('', 'Unknown', 'Entity') THEN doc_type END) AS tag, coalesce(attributes, []) AS attributes, venue, coordinates FROM v LEFT JOIN eg USING (uri))
  WHERE tag IS NOT NULL OR len(attributes) > 0 OR venue IS NOT NULL OR coordinates IS NOT NULL)"""
_PLACE = "CASE relation " + " ".join(f"WHEN '{r.id}' THEN {i}" for i, r in enumerate(relations.COMPACT)) + " END"
_SHOWN = f""", fl AS (SELECT src AS uri, {_PLACE} AS place, p.predicate_label AS label, dst AS other FROM fr JOIN (SELECT DISTINCT p_key, predicate_label FROM ae WHERE edge_type = 'fr') p ON p.p_key = relation),
fs AS MATERIALIZED (SELECT * FROM (SELECT fl.*, coalesce(v.label, {_LOCAL.format("other")}) AS target, count(*) OVER (PARTITION BY fl.uri, place) AS total, row_number() OVER (PARTITION BY fl.uri, place ORDER BY coalesce(v.label, {_LOCAL.format("other")}), other) AS r FROM fl LEFT JOIN v ON v.uri = other) WHERE r <= 10),
fz AS (SELECT uri, place, total, count(*) AS n FROM fs GROUP BY ALL),
fo AS (SELECT a.uri, a.place FROM (SELECT a.uri, a.place AS pa, b.place AS pb, count(*) AS common FROM fs a JOIN fs b ON a.uri = b.uri AND a.other = b.other AND a.place <> b.place GROUP BY ALL) c
  JOIN fz a ON a.uri = c.uri AND a.place = c.pa JOIN fz b ON b.uri = c.uri AND b.place = c.pb WHERE common > 0.8 * least(a.n, b.n) AND (b.total > a.total OR (b.total = a.total AND b.place < a.place))),
fk AS MATERIALIZED (SELECT * FROM fs WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.uri = fs.uri AND fo.place = fs.place))"""
_BASE = "trim(regexp_replace(target, '(?s)^(.+) \\(.*$', '\\1'))"
_WORDS = "array_to_string(list_transform(string_split(replace(prop, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
_FIRST = "CASE prop " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(texts.FIRST_PROPERTIES)) + " ELSE 99 END"
_KIND = "CASE kind WHEN 'appellation' THEN 0 WHEN 'dimension' THEN 1 WHEN 'time' THEN 2 WHEN 'reference' THEN 3 WHEN 'digital' THEN 4 END"
_DOC = (
    _DIRECT
    + _SPANS
    + _PARENTS
    + _ENRICH
    + _SHOWN
    + f""", ds AS (SELECT * FROM (SELECT b.uri, 0 AS place, b.label, other, coalesce(v.label, {_LOCAL.format("other")}) AS target, count(*) OVER (PARTITION BY b.uri, b.label) AS total, row_number() OVER (PARTITION BY b.uri, b.label ORDER BY coalesce(v.label, {_LOCAL.format("other")}), other) AS r FROM b LEFT JOIN v ON v.uri = other) WHERE r <= 10),
al AS (SELECT false AS direct, uri, place, label, other, target, total, r FROM fk UNION ALL SELECT true, uri, place, label, other, target, total, r FROM ds),
s1 AS (SELECT al.*, date, venue, CASE WHEN tag <> 'Time-Span' THEN tag END AS kind, concat_ws(', ', tag, CASE WHEN lower(label) IN {_in(texts.DEPICTIONS)} AND len(attributes) > 0 THEN array_to_string(attributes, ', ') END, coordinates) AS bits FROM al LEFT JOIN en ON en.uri = other LEFT JOIN dt ON dt.uri = other),
s2 AS (SELECT *, CASE WHEN date IS NOT NULL THEN CASE WHEN kind IS NOT NULL THEN target || ' (' || date || ')' ELSE date END WHEN bits <> '' THEN target || ' (' || bits || ')' ELSE target END AS said FROM s1),
s3 AS (SELECT *, count(*) OVER (PARTITION BY direct, uri, place, label, said) AS same, concat_ws(', ', kind, date, venue) AS apart FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN same <= 1 THEN said WHEN apart <> '' THEN target || ' (' || apart || ')' ELSE target || ' [' || regexp_extract(other, '([^/]*)$', 1)[1:30] || ']' END AS said) FROM s3),
s5 AS (SELECT direct, uri, place, label, total, string_agg(said, ', ' ORDER BY r, said) AS said, bool_and(regexp_matches({_BASE}, '^(?:\\d+$|[0-9a-fA-F-]{{32,}})') AND date IS NULL) AS noise, count(DISTINCT {_BASE}) AS labels FROM s4 GROUP BY ALL),
s6 AS (SELECT uri, min({{'direct': direct, 'place': place}}) AS x, upper(label[1]) || label[2:] || ': ' || said AS line FROM s5 WHERE NOT noise AND NOT (total > 5 AND labels <= 2) GROUP BY ALL),
s7 AS (SELECT uri, line, x.direct AS direct, x.place AS place, row_number() OVER (PARTITION BY uri, x.direct ORDER BY x.place, line) AS r FROM s6),
s8 AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY direct, place, line) AS q FROM s7 WHERE r <= 20 OR direct),
rels AS (SELECT uri, list(line ORDER BY q) AS rels FROM s8 WHERE q <= 25 GROUP BY ALL),
l1 AS (SELECT uri, prop, {_WORDS} || ': ' || array_to_string(list_transform(vals[1:3], lambda x: x[1:200]), '; ') AS line, {_FIRST} AS place FROM lit),
l2 AS (SELECT *, row_number() OVER (PARTITION BY uri, place = 99 ORDER BY place, prop) AS q FROM l1),
lits AS (SELECT uri, list(line ORDER BY place, prop) FILTER (place < 99 OR q <= 3) AS lits, list(line ORDER BY prop) AS every FROM l2 GROUP BY ALL),
a1 AS (SELECT pa.parent, pa.kind, pa.uri, CASE WHEN kind = 'time' THEN span ELSE v.label END AS said, coalesce(w.label, '') AS whole FROM pa JOIN v USING (uri) LEFT JOIN sp USING (uri) LEFT JOIN v w ON w.uri = pa.parent WHERE kind IN ('appellation', 'dimension', 'time', 'reference', 'digital')),
a2 AS (SELECT parent, kind, CASE WHEN kind = 'appellation' THEN lower(trim(said)) ELSE uri END AS key, min(said) AS said FROM a1 WHERE said <> '' AND (kind <> 'appellation' OR lower(trim(said)) <> lower(trim(whole))) GROUP BY ALL),
a3 AS (SELECT *, row_number() OVER (PARTITION BY parent, kind ORDER BY said, key) AS r FROM a2),
a4 AS (SELECT parent AS uri, {_KIND} AS place, CASE kind WHEN 'reference' THEN list('Referenced in: ' || said ORDER BY r) ELSE [CASE kind WHEN 'appellation' THEN 'Also known as: ' WHEN 'dimension' THEN 'Dimensions: ' WHEN 'time' THEN 'Time-span: ' ELSE 'Digital: ' END || string_agg(said, ', ' ORDER BY r)] END AS lines FROM a3 WHERE r <= CASE kind WHEN 'digital' THEN 3 ELSE 5 END GROUP BY parent, kind),
absorbed AS (SELECT uri, flatten(list(lines ORDER BY place)) AS absorbed FROM a4 GROUP BY ALL),
r1 AS (SELECT dst AS uri, v.label AS by_, count(*) OVER (PARTITION BY dst) AS n, row_number() OVER (PARTITION BY dst ORDER BY v.label, src) AS r FROM plain JOIN v ON v.uri = src WHERE p_key IN ('p67_refers_to', 'p67i_is_referred_to_by') AND length(v.label) > 3),
rf AS (SELECT uri, ['Referenced by: ' || string_agg(by_, ', ' ORDER BY r) || CASE WHEN n > 10 THEN ' ... and ' || (n - 10) || ' more' ELSE '' END] AS referred FROM r1 WHERE r <= 10 GROUP BY uri, n),
mi AS (SELECT uri, min(replace(regexp_replace({_LOCAL.format("type_uri")}, '(?i)^[a-z]+\\d+[a-z]?_', ''), '_', ' ')) AS type FROM tu WHERE uri IN (SELECT uri FROM sat) GROUP BY ALL),
doc AS MATERIALIZED (SELECT v.uri, array_to_string(CASE WHEN mi.type IS NOT NULL THEN list_concat(['[' || mi.type || '] ' || label, ''], coalesce(every, [])) ELSE
  list_concat(list_concat(list_concat(list_concat(['[' || CASE WHEN fc = '' THEN 'Entity' ELSE fc END || '] ' || label, ''], CASE WHEN len(lits) > 0 THEN list_append(lits, '') ELSE [] END), CASE WHEN len(absorbed) > 0 THEN list_append(absorbed, '') ELSE [] END), coalesce(rels, [])), coalesce(referred, [])) END, chr(10)) AS doc
  FROM v LEFT JOIN lits USING (uri) LEFT JOIN rels USING (uri) LEFT JOIN absorbed USING (uri) LEFT JOIN rf USING (uri) LEFT JOIN mi USING (uri))"""
)


def _pagerank_sql(edges: str, start: str, undirected: bool = False) -> str:
    """CTEs ending in pr(uri, rank); `edges` gives src, dst, w and `start` the uris that mass returns to. Rounds end by the operator's rule."""
    pull = "CASE WHEN x.i = 0 THEN 1.0 WHEN x.i = 1 THEN 1 / (1 - 0.7225 / 2) ELSE 1 / (1 - 0.7225 * x.pull / 4) END" if undirected else "1.0"
    return f"""pe AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM ({edges}) GROUP BY ALL), po AS (SELECT src, sum(w) AS o FROM pe GROUP BY ALL),
pn AS MATERIALIZED (SELECT src AS uri FROM pe UNION SELECT dst FROM pe), ps AS (SELECT uri FROM pn WHERE {start}), px AS MATERIALIZED (SELECT src, dst, 0.85::DOUBLE * (w / o) AS share FROM pe JOIN po USING (src)),
p0 AS MATERIALIZED (SELECT pn.uri, CASE WHEN ps.uri IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (SELECT count(*) FROM ps) END AS st FROM pn LEFT JOIN ps USING (uri)),
it AS (SELECT 0 AS i, 1.0::DOUBLE AS pull, uri, st, st AS rank, 0.0::DOUBLE AS last, 1.0::DOUBLE AS moved FROM p0 UNION ALL
SELECT i, pull, uri, st, rank, last, sum(abs(rank - last)) OVER () FROM (
  SELECT i, pull, uri, st, CASE WHEN i = 1 THEN 0.15::DOUBLE * st + got ELSE pull * (0.15::DOUBLE * st + got - before) + before END AS rank, old AS last FROM (
    SELECT x.i + 1 AS i, ({pull})::DOUBLE AS pull, x.uri, x.st, x.rank AS old, x.last AS before, coalesce(g.got, 0) AS got
    FROM it x LEFT JOIN (SELECT px.dst AS uri, sum(it.rank * share) AS got FROM px JOIN it ON it.uri = px.src GROUP BY ALL) g ON g.uri = x.uri WHERE x.moved >= 1e-6 AND x.i < 200))),
pr AS MATERIALIZED (SELECT uri, rank / sum(rank) OVER () AS rank FROM it WHERE i = (SELECT max(i) FROM it))"""


_PR = _FR + ", " + _pagerank_sql("SELECT src, dst, 1.0::DOUBLE AS w FROM fr", "true")
_RANKED = "SELECT uri, rank, fc, row_number() OVER (PARTITION BY fc ORDER BY round(rank, 12) DESC, uri) AS f FROM pr JOIN v USING (uri) WHERE is_doc AND rank > 0"
_ANON = """, gone AS (SELECT uri FROM v WHERE fc = 'Event' AND label = regexp_extract(uri, '([^/#]*)$', 1) AND uri NOT IN (SELECT src FROM e WHERE p_key IN ('p1_is_identified_by', 'p1i_identifies') AND dst IN (SELECT uri FROM sat))) """
_NAMES = "CASE prop " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(labels.NAMES)) + " END"
_MAKING = "|".join(relations.MAKING)
ORACLES = {
    "entity_discovery": _GRAPH + "SELECT DISTINCT s AS uri FROM d WHERE regexp_matches(s, '^https?://') AND s NOT IN (SELECT uri FROM authority_terms)",
    "described_entities": _GRAPH + _LIT + "SELECT DISTINCT s AS uri FROM d WHERE regexp_matches(s, '^https?://') AND s NOT IN (SELECT uri FROM authority_terms) AND s IN (SELECT uri FROM lit)",
    "entity_types": f"SELECT uri, string_agg(t, ' ' ORDER BY t) AS types FROM (SELECT DISTINCT {_sql_term('uri')} AS uri, {_sql_term('type_uri')} AS t FROM entity_types WHERE uri IS NOT NULL AND type_uri IS NOT NULL) GROUP BY ALL",
    "class_labels": _GRAPH + f"SELECT class, replace(regexp_replace(name, '(?i)^[a-z]+\\d+[a-z]?_', ''), '_', ' ') AS label, regexp_matches(name, '(?i)^[a-z]+\\d+[a-z]?_') AS technical, n FROM (SELECT lower({_LOCAL.format('type_uri')}) AS class, min({_LOCAL.format('type_uri')}) AS name, count(DISTINCT uri) AS n FROM tu GROUP BY 1)",
    "edge_list": _GRAPH + "SELECT * FROM e",
    "all_edges": _FR + "SELECT * FROM ae",
    "vertex_list": _GRAPH + "SELECT * FROM v",
    "literal_map": _GRAPH + _LIT + "SELECT uri, prop, array_to_string(vals, ' | ') AS vals FROM lit",
    "schema_statements": _GRAPH + "SELECT schema, count(*) AS n, count(DISTINCT p_key) AS properties FROM st GROUP BY ALL",
    "degree": _GRAPH + "SELECT uri, count(*) AS degree FROM (SELECT src AS uri FROM e UNION ALL SELECT dst FROM e) GROUP BY ALL",
    "type_counts": _GRAPH + "SELECT CASE WHEN doc_type = '' THEN 'Unknown' ELSE doc_type END AS doc_type, count(*) AS n FROM v WHERE is_doc GROUP BY ALL",
    "fc_counts": _GRAPH + "SELECT fc, count(*) AS n FROM v WHERE fc <> '' GROUP BY ALL",
    "neighbours_of_activities": _GRAPH + f""", n AS (SELECT src AS uri, dst AS other, 'out' AS direction, p_key, predicate_label, weight FROM e WHERE src LIKE '%/activity/%' UNION ALL SELECT dst, src, 'in', p_key, predicate_label, weight FROM e WHERE dst LIKE '%/activity/%')
SELECT n.*, coalesce(v.label, {_LOCAL.format("other")}) AS other_label FROM n LEFT JOIN v ON v.uri = other""",
    "neighbours_by_predicate": _FR + "SELECT uri, predicate_label, direction, edge_type, count(*) AS n FROM (SELECT src AS uri, 'out' AS direction, predicate_label, edge_type FROM ae UNION ALL SELECT dst, 'in', predicate_label, edge_type FROM ae) WHERE uri LIKE '%/activity/%' GROUP BY ALL",
    "within_two_steps": _GRAPH + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), a AS (SELECT uri FROM v WHERE uri LIKE '%/group/%'), b AS (SELECT DISTINCT dst AS uri FROM u JOIN a ON a.uri = src), "
    "c AS (SELECT DISTINCT dst AS uri FROM u JOIN b ON b.uri = src) SELECT uri, min(distance)::INTEGER AS distance FROM (SELECT uri, 0 AS distance FROM a UNION ALL SELECT uri, 1 FROM b UNION ALL SELECT uri, 2 FROM c) GROUP BY ALL",
    "distances_of_works": _GRAPH + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), a AS (SELECT uri FROM v WHERE uri LIKE '%/group/%'), b AS (SELECT DISTINCT dst AS uri FROM u JOIN a ON a.uri = src), "
    "c AS (SELECT DISTINCT dst AS uri FROM u JOIN b ON b.uri = src), r AS (SELECT uri, min(distance)::INTEGER AS distance FROM (SELECT uri, 0 AS distance FROM a UNION ALL SELECT uri, 1 FROM b UNION ALL SELECT uri, 2 FROM c) GROUP BY ALL) "
    "SELECT v.uri, coalesce(distance, -1) AS distance FROM v LEFT JOIN r USING (uri) WHERE v.uri LIKE '%/work/%'",
    "direct_predicates": _FR + _BOTH + "SELECT * FROM dp",
    "anonymous_events": _GRAPH + _ANON + "SELECT uri FROM gone",
    "contracted_edges": _GRAPH + _ANON + "SELECT src, dst, p_key FROM e WHERE src NOT IN (SELECT uri FROM gone) AND dst NOT IN (SELECT uri FROM gone)",
    "satellite_kinds": _GRAPH + "SELECT * FROM sat",
    "satellite_parents": _FR + _PARENTS + "SELECT uri, kind, parent FROM pa",
    "time_spans": _GRAPH + _SPANS + "SELECT uri, span FROM sp",
    "entity_dates": _GRAPH + _SPANS + "SELECT uri, date FROM dt",
    "shortcut_edges": _FR + "SELECT * FROM fr",
    "uncovered_edges": _FR + "SELECT src, dst, p_key FROM plain",
    "shortcut_summaries": _FR + ", c AS (SELECT relation, 's' AS side, src AS uri, count(*) AS n FROM fr GROUP BY ALL UNION ALL SELECT relation, 't', dst, count(*) FROM fr GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY relation, side ORDER BY n DESC, uri) AS r FROM c) "
    "SELECT relation, sum(n) FILTER (side = 's')::BIGINT AS connections, count(*) FILTER (side = 's') AS sources, count(*) FILTER (side = 't') AS targets, string_agg(uri || '=' || n, ' ' ORDER BY r) FILTER (side = 's' AND r <= 50) AS top_sources, string_agg(uri || '=' || n, ' ' ORDER BY r) FILTER (side = 't' AND r <= 50) AS top_targets FROM r GROUP BY ALL",
    "shortcut_targets": _FR + "SELECT src, relation, count(*) AS total, string_agg(CASE WHEN r <= 10 THEN dst END, ' ' ORDER BY dst) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY src, relation ORDER BY dst) AS r FROM fr) GROUP BY ALL",
    "shortcut_overlaps": _FR + ", n AS (SELECT src, relation, count(*) AS n FROM fr GROUP BY ALL), c AS (SELECT a.src, a.relation AS relation_a, b.relation AS relation_b, count(*) AS common FROM fr a JOIN fr b ON a.src = b.src AND a.dst = b.dst AND a.relation < b.relation GROUP BY ALL) "
    "SELECT c.* FROM c JOIN n x ON x.src = c.src AND x.relation = relation_a JOIN n y ON y.src = c.src AND y.relation = relation_b WHERE common > 0.8 * least(x.n, y.n)",
    "actor_work_counts": _FR + f""", ev AS (SELECT src AS work, dst AS event FROM plain WHERE p_key = 'p108i_was_produced_by' OR (p_key = 'p16i_was_used_for' AND regexp_matches(dst, '{_MAKING}'))),
by_ AS (SELECT src AS event, dst AS actor FROM plain WHERE p_key = 'p14_carried_out_by' UNION ALL SELECT dst, src FROM plain WHERE p_key = 'p14i_performed')
SELECT actor, count(DISTINCT work) AS works FROM (SELECT dst AS actor, src AS work FROM fr WHERE relation LIKE 'thing\\_actor%' ESCAPE '\\' UNION ALL SELECT actor, work FROM ev JOIN by_ USING (event)) GROUP BY ALL""",
    "works_of_editions": _GRAPH + "SELECT m.uri AS production, replace(m.uri, '/production/', '/work/') AS work, x.label AS work_label FROM v m LEFT JOIN v x ON x.uri = replace(m.uri, '/production/', '/work/') WHERE m.uri LIKE '%/production/%'",
    "pagerank_top": _PR + f" SELECT uri, round(rank, 9) AS rank FROM ({_RANKED}) ORDER BY round(rank, 12) DESC, uri LIMIT 20",
    "pagerank_per_fc": _PR + f" SELECT uri, round(rank, 9) AS rank, fc FROM ({_RANKED}) WHERE f <= 5 ORDER BY round(rank, 12) DESC, uri LIMIT 100",
    "pagerank_candidates": _PR + f" SELECT uri, round(rank, 9) AS rank, fc FROM ({_RANKED}) WHERE fc IN ('Actor', 'Thing') ORDER BY round(rank, 12) DESC, uri LIMIT 20",
    "personalised_pagerank": _FR + ", " + _pagerank_sql("SELECT src, dst, weight AS w FROM ae UNION ALL SELECT dst, src, weight FROM ae", "uri LIKE '%/agent/%'", True) + f" SELECT uri, round(rank, 9) AS rank FROM ({_RANKED}) WHERE uri NOT LIKE '%/agent/%' ORDER BY round(rank, 12) DESC, uri LIMIT 100",
    "preferred_labels": _GRAPH + _LIT + f""", val AS (SELECT uri, prop, unnest(vals) AS val FROM lit), p1 AS (SELECT DISTINCT src AS owner, dst AS uri FROM e WHERE p_key IN ('p1_is_identified_by', 'p1i_identifies')),
sg AS (SELECT uri, CASE prop WHEN 'preflabel' THEN 1 ELSE 5 END AS stage, val FROM val WHERE prop IN ('preflabel', 'label')
  UNION ALL SELECT owner, 2, label FROM p1 JOIN v USING (uri) WHERE label <> {_LOCAL.format("uri")} AND uri IN (SELECT src FROM e WHERE p_key IN ('p2_has_type', 'p2i_is_type_of') AND dst = '{labels.PREFERRED}')
  UNION ALL SELECT owner, CASE prop WHEN 'label' THEN 4 ELSE 3 END, val FROM p1 JOIN val USING (uri) WHERE prop IN ('p190_has_symbolic_content', 'label')),
sn AS (SELECT uri, stage, min(val) AS val, count(*) AS n FROM sg GROUP BY ALL), sd AS (SELECT uri, min({{'m': CASE WHEN n = 1 THEN 0 ELSE 1 END, 's': stage, 'v': val}}).v AS staged FROM sn GROUP BY ALL),
ls AS (SELECT uri, min({{'p': {_NAMES}, 'v': vals[1]}}).v AS listed FROM lit WHERE prop IN {_in(labels.NAMES)} GROUP BY ALL)
SELECT v.uri, coalesce(staged, listed, label) AS label FROM v LEFT JOIN sd USING (uri) LEFT JOIN ls USING (uri)""",
    "labels_found": _GRAPH + "SELECT wanted, uri, CAST(r AS INTEGER) AS r FROM (SELECT w.label AS wanted, v.uri, row_number() OVER (PARTITION BY w.label ORDER BY v.uri) AS r FROM (SELECT DISTINCT label FROM v WHERE uri LIKE '%/group/%' OR uri LIKE '%/activity/%') w JOIN v ON lower(trim(v.label)) = lower(trim(w.label)) WHERE trim(w.label) <> '') WHERE r <= 5",
    "label_search": _GRAPH + ", t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(label), '[^a-z]+')) AS term FROM authority_terms), x AS (SELECT DISTINCT uri, unnest(regexp_split_to_array(lower(label), '[^\\p{L}\\p{N}]+')) AS word FROM v) "
    "SELECT term, uri, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY uri) AS r FROM (SELECT DISTINCT term, uri FROM t JOIN x ON starts_with(word, term) WHERE length(term) > 4)) WHERE r <= 20",
    "target_enrichments": _FR + _ENRICH + "SELECT uri, tag, array_to_string(attributes, ', ') AS attributes, venue, coordinates FROM en",
    "relations_kept": _FR + _SHOWN + "SELECT uri, place, count(*) AS shown FROM fk GROUP BY ALL",
    "entity_documents": _FR + _DOC + "SELECT uri, doc FROM doc",
    "entity_markdown": _FR + _DOC + f""", gd AS (SELECT {_sql_term("id")} AS uri, list_sort(list_distinct(flatten(list(coalesce(all_types, []))))) AS types, min(wikidata_id) AS wikidata, list_sort(list_distinct(flatten(list(coalesce(images, []))))) AS images FROM graph_documents WHERE id IS NOT NULL GROUP BY ALL)
SELECT regexp_replace(label, '[^\\p{{L}}\\p{{N}}._-]+', '_', 'g')[1:100] || '_' || md5(uri)[1:8] || '.md' AS file_name, '---' || chr(10) || 'URI: ' || uri || chr(10) || 'Label: "' || replace(label, '"', '''') || '"' || chr(10) || 'Type: ' || fc || chr(10) ||
CASE WHEN len(types) > 0 THEN 'Types:' || chr(10) || array_to_string(list_transform(types, lambda x: '  - ' || x), chr(10)) || chr(10) ELSE '' END || coalesce('Wikidata: ' || wikidata || chr(10), '') ||
CASE WHEN len(images) > 0 THEN 'Images:' || chr(10) || array_to_string(list_transform(images[1:5], lambda x: '  - ' || x), chr(10)) || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || doc AS content FROM doc JOIN v USING (uri) LEFT JOIN gd USING (uri)""",
    "entity_records": _GRAPH + "SELECT uri, to_json({'uri': uri, 'label': label, 'fc': fc, 'doc_type': doc_type, 'is_doc': is_doc})::VARCHAR AS record FROM v",
    "chained_documents": _FR + _DOC + """, sz AS (SELECT uri, doc, length(doc) AS n, length(doc) < 400 AND NOT regexp_matches(ltrim(doc), '^\\[(Event|Actor)\\]') AS thin, chr(10) || chr(10) || 'Related entity — ' || label || ' (' || CASE WHEN doc_type = '' THEN 'Entity' ELSE doc_type END || '):' || chr(10) || doc AS part FROM doc JOIN v USING (uri)),
u AS (SELECT src, dst FROM ae WHERE src <> dst UNION SELECT dst, src FROM ae WHERE src <> dst),
sent AS (SELECT u.src, u.dst, a.part, length(a.part) AS m, b.n FROM u JOIN sz a ON a.uri = src AND a.thin JOIN sz b ON b.uri = dst AND NOT b.thin),
kept AS (SELECT *, n + sum(m) OVER (PARTITION BY dst ORDER BY m, src ROWS UNBOUNDED PRECEDING) AS total FROM sent QUALIFY total <= 5000),
more AS (SELECT dst AS uri, string_agg(part, '' ORDER BY m, src) AS more FROM kept GROUP BY ALL)
SELECT uri, doc || coalesce(more, '') AS doc FROM sz LEFT JOIN more USING (uri) WHERE NOT thin UNION ALL SELECT uri, doc FROM sz WHERE thin AND uri NOT IN (SELECT src FROM kept)""",
    "document_lengths": _FR + _DOC + "SELECT fc, count(*) AS n, min(length(doc))::INTEGER AS least, max(length(doc))::INTEGER AS most, CAST(sum(length(doc)) // count(*) AS BIGINT) AS mean, CAST(sum(length(doc) // 4) AS BIGINT) AS tokens FROM doc JOIN v USING (uri) GROUP BY ALL",
    "streamed_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "export_counts": _GRAPH + "SELECT fc, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM (SELECT fc, count(*) AS nodes FROM v GROUP BY ALL) FULL JOIN (SELECT coalesce(v.fc, '') AS fc, count(*) AS edges FROM e LEFT JOIN v ON v.uri = src GROUP BY ALL) USING (fc)",
}
