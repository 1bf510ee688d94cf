"""The property graph in DataFrames: statements, edges, vertices, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.terms import decoded, local_key, local_name, named

# Weights of properties by local name; any other has DEFAULT_WEIGHT.
DEFAULT_WEIGHT = 0.5
WEIGHTS = {
    "P89_falls_within": 0.9, "P89i_contains": 0.9, "P55_has_current_location": 0.9, "P55i_currently_holds": 0.9,
    "P108_has_produced": 0.85, "P108i_was_produced_by": 0.85, "P14_carried_out_by": 0.85, "P14i_performed": 0.85,
    "P94_has_created": 0.85, "P94i_was_created_by": 0.85,
    "P56_bears_feature": 0.8, "P56i_is_found_on": 0.8, "P46_is_composed_of": 0.8, "P46i_forms_part_of": 0.8,
    "K24_portray": 0.7, "K24i_is_portrayed_in": 0.7, "K34_illustrates": 0.7, "K34i_is_illustrated_by": 0.7,
    "P2_has_type": 0.6, "P2i_is_type_of": 0.6, "P4_has_time-span": 0.6, "P4i_is_time-span_of": 0.6,
    "P67_refers_to": 0.5, "P67i_is_referred_to_by": 0.5, "P70_documents": 0.5, "P70i_is_documented_in": 0.5,
    "P1_is_identified_by": 0.4, "P1i_identifies": 0.4,
}
# Patterns of predicates that describe the schema, not the entities.
SCHEMA_PATTERNS = [
    "rdf-syntax-ns#type", "rdf-schema#subClassOf", "rdf-schema#domain", "rdf-schema#range", "rdf-schema#Class", "rdf-schema#subPropertyOf", "rdf-schema#label", "rdf-schema#comment",
    "owl#", "/type", "/subClassOf", "/domain", "/range",
]
# Order in which a category wins over others of the same entity.
FC_PRIORITY = {"Actor": 6, "Event": 5, "Place": 4, "Concept": 3, "Time": 2, "Thing": 1}


def is_schema_predicate(p: Column) -> Column:
    return p.rlike("|".join(x.replace("-", "\\-") for x in SCHEMA_PATTERNS))


def is_uri(term: Column) -> Column:
    return F.coalesce(term.rlike("^https?://"), F.lit(False))


def statements(triples: DataFrame, schema: Column | None = None) -> DataFrame:
    """(s, p_key, o, schema): every statement once, terms decoded; ends that name nothing are left out. p_key is the local name in lower case.

    schema tells whether the predicate, in any way it is written, describes the schema; another condition on `p` may be given for it.
    """
    t = triples.select(decoded(F.col("subject")).alias("s"), decoded(F.col("predicate")).alias("p"), local_key(F.col("predicate")).alias("p_key"), decoded(F.col("object")).alias("o"))
    t = t.where(named(F.col("s")) & named(F.col("o")) & F.col("p").isNotNull())
    # namespaces vary, so a statement is the same if the local name of its predicate is
    return t.groupBy("s", "p_key", "o").agg(F.max(is_schema_predicate(F.col("p")) if schema is None else schema).alias("schema"))


def weight(p_key: Column) -> Column:
    """The weight of a property by its local name in lower case."""
    table = F.create_map(*(F.lit(x) for k, v in WEIGHTS.items() for x in (k.lower(), v)))
    return F.coalesce(F.try_element_at(table, p_key), F.lit(DEFAULT_WEIGHT))


def edges(triples: DataFrame, labels: DataFrame, weights: Column | None = None, schema: Column | None = None) -> DataFrame:
    """`edges_of` all statements of `triples`; `schema` as for `statements`."""
    return edges_of(statements(triples, schema), labels, weights)


def edges_of(st: DataFrame, labels: DataFrame, weights: Column | None = None) -> DataFrame:
    """(src, dst, p_key, predicate_label, weight): statements (s, p_key, o, schema) between URIs that don't describe the schema.

    `labels` (property, label) is small metadata; of several labels of a property the smallest counts. `weights`, a column on p_key, replaces the table of this module.
    """
    named_p = labels.groupBy(local_key(F.col("property")).alias("p_key")).agg(F.min("label").alias("predicate_label"))
    st = st.where(is_uri(F.col("s")) & is_uri(F.col("o")) & ~F.col("schema"))
    w = weight(F.col("p_key")) if weights is None else weights
    return st.join(named_p, "p_key", "left").select(F.col("s").alias("src"), F.col("o").alias("dst"), "p_key", F.coalesce("predicate_label", "p_key").alias("predicate_label"), w.alias("weight"))


def vertices(written: DataFrame, types: DataFrame, fcs: DataFrame, ends: DataFrame) -> DataFrame:
    """(uri, label, fc, doc_type, is_doc): one row per vertex of all its writes, and per (uri) of `ends` that was never written.

    The label is the earliest non-empty one other than the local name, of equally early ones the smallest; the local name if there
    is none. fc is the category of highest priority among the types, else the smallest non-empty written one, else
    empty. doc_type is the smallest non-empty one. A vertex is a document if any write says so.
    """
    w = written.select(decoded(F.col("name")).alias("uri"), "label", "fc", "doc_type", "is_doc", "loaded_at").where(named(F.col("uri")))
    w = w.unionByName(ends.select("uri").distinct(), allowMissingColumns=True)
    good = (F.col("label") != "") & (F.col("label") != local_name(F.col("uri")))
    one = w.groupBy("uri").agg(
        F.min(F.when(good, F.struct("loaded_at", "label")))["label"].alias("label"),
        F.min(F.when(F.col("fc") != "", F.col("fc"))).alias("written"),
        F.min(F.when(F.col("doc_type") != "", F.col("doc_type"))).alias("doc_type"),
        F.max(F.coalesce("is_doc", F.lit(False))).alias("is_doc"),
    )
    by_type = categories(types, fcs)
    return one.join(by_type, "uri", "left").select(
        "uri", F.coalesce("label", local_name(F.col("uri"))).alias("label"), F.coalesce("fc", "written", F.lit("")).alias("fc"), F.coalesce("doc_type", F.lit("")).alias("doc_type"), "is_doc"
    )


def categories(types: DataFrame, fcs: DataFrame) -> DataFrame:
    """(uri, fc): the category of highest priority among an entity's types; `fcs` (class_local, fc) is small metadata."""
    known = fcs.select(F.lower("class_local").alias("k"), F.col("fc")).distinct()
    prio = F.create_map(*(F.lit(x) for k, v in FC_PRIORITY.items() for x in (k, v)))
    t = types.select(decoded(F.col("uri")).alias("uri"), local_key(F.col("type_uri")).alias("k")).where(named(F.col("uri"))).join(known, "k")
    return t.groupBy("uri").agg(F.max_by("fc", F.coalesce(F.try_element_at(prio, F.col("fc")), F.lit(0))).alias("fc"))


def first_few(frame: DataFrame, keys: list[str], order: list, n: int, spread: str) -> DataFrame:
    """The first n rows of each group in `order`, with their place `r` from 1. Groups are ranked in 64 parts by `spread` first, so no task ranks a whole large group."""
    few = frame.withColumn("r", F.row_number().over(W.partitionBy(*keys, F.pmod(F.xxhash64(spread), F.lit(64))).orderBy(*order))).where(F.col("r") <= n)
    return few.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= n)


def in_order(*fields: str):
    """Aggregate: the array of the last of `fields` in the order of all of them."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*fields))), lambda x: x[fields[-1]])


def degrees(e: DataFrame) -> DataFrame:
    """(uri, degree): incident edge ends; a loop counts twice. Ends are pre-aggregated per task, so hubs cost no more than others."""
    return e.select(F.explode(F.array("src", "dst")).alias("uri")).groupBy("uri").agg(F.count("*").alias("degree"))


def neighbours(e: DataFrame, uris: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """Incident edges of the given (uri) in both directions: uri, other, direction and the edge's other columns; with vertices (uri, label) the label of the other end."""
    more = [c for c in e.columns if c not in ("src", "dst")]
    out = e.join(uris.select(F.col("uri").alias("src")), "src", "left_semi").select(F.col("src").alias("uri"), F.col("dst").alias("other"), F.lit("out").alias("direction"), *more)
    into = e.join(uris.select(F.col("uri").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("uri"), F.col("src").alias("other"), F.lit("in").alias("direction"), *more)
    both = out.unionByName(into)
    if v is None:
        return both
    return both.join(v.select(F.col("uri").alias("other"), F.col("label").alias("other_label")), "other", "left").select(*both.columns, F.coalesce("other_label", local_name(F.col("other"))).alias("other_label"))


def document_facts(documents: DataFrame) -> DataFrame:
    """(uri, types, wikidata, images) of (id, all_types, wikidata_id, images): of all rows of an id together, each once, in order; of several Wikidata ids the smallest."""
    each = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(c, lambda x: x.isNotNull())))))
    d = documents.select(decoded(F.col("id")).alias("uri"), "all_types", "wikidata_id", "images").where(named(F.col("uri"))).distinct()
    return d.groupBy("uri").agg(each("all_types").alias("types"), F.min("wikidata_id").alias("wikidata"), each("images").alias("images"))


def images(e: DataFrame, literals: DataFrame, by: str = "p138_represents", value: str = "value") -> DataFrame:
    """(uri, url): addresses of the images that represent an entity, from the literals (uri, prop, vals) of the images."""
    url = literals.where(F.col("prop") == value).select(F.col("uri").alias("src"), F.explode("vals").alias("url")).where(F.col("url").startswith("http"))
    return e.where(F.col("p_key") == by).join(url, "src").select(F.col("dst").alias("uri"), "url").distinct()


def literals(triples: DataFrame) -> DataFrame:
    """`literals_of` all statements of `triples`."""
    return literals_of(statements(triples))


def literals_of(st: DataFrame) -> DataFrame:
    """(uri, prop, vals ARRAY<STRING>): the sorted distinct literals of each property of a URI, from statements (s, p_key, o)."""
    st = st.where(~is_uri(F.col("o")) & is_uri(F.col("s")))
    return st.groupBy(F.col("s").alias("uri"), F.col("p_key").alias("prop")).agg(F.sort_array(F.collect_set("o")).alias("vals"))


def discovered(triples: DataFrame, schema_types: DataFrame) -> DataFrame:
    """(uri): subjects that are URIs and of no schema type; schema_types holds (uri) to leave out."""
    s = triples.select(decoded(F.col("subject")).alias("uri")).where(is_uri(F.col("uri"))).distinct()
    return s.join(schema_types.select("uri"), "uri", "left_anti")


def direct_links(e: DataFrame, covered: Column) -> DataFrame:
    """(uri, other, label): what an entity is linked to directly, by predicate label; incoming links read "is target of ...".

    Edges for which `covered` holds are told by derived relations.
    """
    kept = e.where(~covered)
    ways = F.explode(F.array(
        F.struct(F.col("src").alias("uri"), F.col("dst").alias("other"), F.col("predicate_label").alias("label")),
        F.struct(F.col("dst").alias("uri"), F.col("src").alias("other"), F.concat(F.lit("is target of "), F.col("predicate_label")).alias("label")),
    ))
    return kept.select(ways.alias("x")).select("x.*").distinct()


def direct_predicates(e: DataFrame, v: DataFrame, covered: Column, shown: int = 10) -> DataFrame:
    """(uri, label, total, targets): `direct_links` by label; at most `shown` target labels are listed, smallest first, and total counts all."""
    both = direct_links(e, covered).join(v.select(F.col("uri").alias("other"), F.col("label").alias("target")), "other", "left")
    both = both.select("uri", "label", F.coalesce("target", local_name(F.col("other"))).alias("target"), "other")
    totals = both.groupBy("uri", "label").agg(F.count("*").alias("total"))
    few = first_few(both, ["uri", "label"], ["target", "other"], shown, "other")
    return totals.join(few.groupBy("uri", "label").agg(F.array_join(in_order("r", "target"), "; ").alias("targets")), ["uri", "label"])


def anonymous_events(v: DataFrame, e: DataFrame, satellites: DataFrame) -> DataFrame:
    """(uri): events without a label of their own that aren't identified by a satellite (uri), such as a name; the graph is contracted by leaving them out."""
    names = e.where(F.col("p_key").isin("p1_is_identified_by", "p1i_identifies")).select(F.col("src").alias("uri"), F.col("dst").alias("name"))
    identified = names.join(satellites.select(F.col("uri").alias("name")), "name", "left_semi").select("uri").distinct()
    return v.where((F.col("fc") == "Event") & (F.col("label") == local_name(F.col("uri")))).join(identified, "uri", "left_anti").select("uri")


def contracted(e: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges whose ends both stay."""
    g = gone.select(F.col("uri").alias("src"))
    return e.join(g, "src", "left_anti").join(g.withColumnRenamed("src", "dst"), "dst", "left_anti").select(*e.columns)


# Properties that date a time-span, those that count first named first.
BEGIN = ("p82a_begin_of_the_begin", "p81b_begin_of_the_end")
END = ("p82b_end_of_the_end", "p81a_end_of_the_begin")
WITHIN = ("p82_at_some_time_within", "p81_ongoing_throughout", "p170i_time_is_defined_by")


def time_spans(literals: DataFrame) -> DataFrame:
    """(uri, span): the dates of every entity that has any, from (uri, prop, vals): "a to b", "from a", "until b", or when it lies within.

    Of several values of a property the smallest counts.
    """
    dated = literals.where(F.col("prop").isin(*BEGIN, *END, *WITHIN))
    value = lambda props: F.coalesce(*(F.min(F.when(F.col("prop") == p, F.element_at("vals", 1))) for p in props))
    one = dated.groupBy("uri").agg(value(BEGIN).alias("a"), value(END).alias("b"), value(WITHIN).alias("c"))
    return one.select("uri", time_span_text(F.col("a"), F.col("b"), F.col("c")).alias("span"))


def time_span_text(begin: Column, end: Column, within: Column) -> Column:
    return (
        F.when(begin.isNotNull() & end.isNotNull(), F.concat(begin, F.lit(" to "), end))
        .when(begin.isNotNull(), F.concat(F.lit("from "), begin))
        .when(end.isNotNull(), F.concat(F.lit("until "), end))
        .otherwise(F.coalesce(within, F.lit("")))
    )


def dates(spans: DataFrame, e: DataFrame) -> DataFrame:
    """(uri, date): of what has dates itself, and of what has a time-span that has; of several the smallest."""
    of = e.where(F.col("p_key").isin("p4_has_time-span", "p4i_is_time-span_of")).join(spans.withColumnRenamed("uri", "dst"), "dst").groupBy(F.col("src").alias("uri")).agg(F.min("span").alias("far"))
    return spans.join(of, "uri", "full").select("uri", F.coalesce("span", "far").alias("date"))


def type_counts(v: DataFrame) -> DataFrame:
    """(doc_type, n) of the documents; an empty type is Unknown."""
    return v.where("is_doc").groupBy(F.when(F.col("doc_type") == "", "Unknown").otherwise(F.col("doc_type")).alias("doc_type")).agg(F.count("*").alias("n"))


def fc_counts(v: DataFrame) -> DataFrame:
    return v.where("fc <> ''").groupBy("fc").agg(F.count("*").alias("n"))
