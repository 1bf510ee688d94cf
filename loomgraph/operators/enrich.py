"""Texts on what was found: the relationships of documents within a budget of characters, and an overview of the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.terms import local_name
from .graph import first_few, in_order

# Limits of the texts.
SCANNED, LINES, CHARS, LEAST_CHARS, LEAST_PART = 30, 15, 5000, 200, 100
OVERVIEW_CHARS, TYPES, ACTORS, RELATIONS, ENDS = 3000, 15, 30, 8, 15
# Properties that are told first.
FIRST = (
    "p4_has_time-span", "p82a_begin_of_the_begin", "p82b_end_of_the_end", "p14_carried_out_by", "p14i_performed", "p108_has_produced", "p108i_was_produced_by", "p7_took_place_at", "p55_has_current_location",
    "p53_has_former_or_current_location", "p89_falls_within", "p16_used_specific_object", "p16i_was_used_for", "p12_occurred_in_the_presence_of", "p12i_was_present_at", "p62_depicts", "p62i_is_depicted_by",
    "p46_is_composed_of", "p46i_forms_part_of", "p56_bears_feature", "p56i_is_found_on", "k24_portray", "k24i_portrayed_by", "p9_consists_of", "p9i_forms_part_of",
)
# Labels of predicates that say nothing, and types that come first.
SKIPPED = ("label", "type", "same as", "see also", "")
FIRST_TYPES = (
    "Actor", "E39_Actor", "E21_Person", "Person", "Group", "Human-Made Object", "E22_Human-Made_Object", "E22_Man-Made_Object", "Man-Made Object", "Physical Human-Made Thing", "Activity", "E7_Activity", "Event",
    "E5_Event", "Place", "E53_Place",
)


def predicate_priority(found, p_key, label):
    """0 if the other end was found too, 1 for a property of FIRST, 2 with a label, else 3."""
    return F.when(found, 0).when(F.coalesce(p_key.rlike("|".join(FIRST)), F.lit(False)), 1).when(F.coalesce(label, F.lit("")) != "", 2).otherwise(3)


def relationships(found: DataFrame, edges: DataFrame, vertices: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, text) of documents (query_id, uri, doc_type, place), from edges (src, dst, p_key, predicate_label) and the dates (uri, span) of time-spans.

    A document is told by its label and LINES different lines of its SCANNED first edges: those to other documents found, then of properties of FIRST, then the rest; outgoing `- label: other`, incoming
    `- [other] label`, a time-span by its dates. Documents of FIRST_TYPES come first. Each has its share of CHARS, LEAST_CHARS at least; the text ends where the next would not fit, with a part of it if that has more
    than LEAST_PART characters. Only the edges of documents found are ranked, a hub's in parts.
    """
    docs = found.select("query_id", "uri", F.when(F.col("doc_type").isin(*FIRST_TYPES), 0).otherwise(1).alias("later"), "place")
    label = vertices.select("uri", "label")
    pieces = ("query_id", "later", "place", "uri", "other", "direction", "p_key", "predicate_label")
    out = edges.join(docs.withColumnRenamed("uri", "src"), "src").select("query_id", "later", "place", F.col("src").alias("uri"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "p_key", "predicate_label")
    into = edges.join(docs.withColumnRenamed("uri", "dst"), "dst").where("src <> dst").select("query_id", "later", "place", F.col("dst").alias("uri"), F.col("src").alias("other"), F.lit("in").alias("direction"), "p_key", "predicate_label")
    both = out.unionByName(into).select(*pieces).where(~F.lower(F.trim("predicate_label")).isin(*SKIPPED))
    both = both.join(docs.select("query_id", F.col("uri").alias("other"), F.lit(True).alias("met")), ["query_id", "other"], "left")
    both = both.withColumn("priority", predicate_priority(F.coalesce("met", F.lit(False)), F.col("p_key"), F.col("predicate_label")))
    keys = ["query_id", "later", "place", "uri"]
    few = first_few(both, keys, ["priority", "p_key", "direction", "other"], SCANNED, "other")
    few = few.join(label.withColumnRenamed("uri", "other").withColumnRenamed("label", "other_label"), "other", "left").join(spans.withColumnRenamed("uri", "other"), "other", "left")
    shown = F.coalesce("other_label", local_name(F.col("other")))
    dated = (F.col("direction") == "out") & F.col("p_key").isin("p4_has_time-span", "p4i_is_time-span_of") & F.col("span").isNotNull()
    line = F.when(dated, F.concat(F.lit("  - date: "), "span")).when(F.col("direction") == "out", F.concat(F.lit("  - "), "predicate_label", F.lit(": "), shown)).otherwise(F.concat(F.lit("  - ["), shown, F.lit("] "), "predicate_label"))
    lines = few.withColumn("line", line).groupBy(*keys, "line").agg(F.min("r").alias("r"))
    lines = lines.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("r"))).where(F.col("n") <= LINES)
    told = lines.groupBy(*keys).agg(F.array_join(in_order("n", "line"), "\n").alias("lines")).join(label, "uri", "left")
    told = told.withColumn("section", F.concat(F.coalesce("label", local_name(F.col("uri"))), F.lit(":\n"), "lines"))
    # a question has at most a few documents, so the rest is windows over small groups
    q = W.partitionBy("query_id")
    share = F.greatest(F.lit(LEAST_CHARS), F.expr(f"{CHARS} div n"))
    told = told.withColumn("n", F.count("*").over(q)).withColumn("share", share)
    told = told.withColumn("section", F.when(F.length("section") > F.col("share"), F.concat(F.expr("substring(section, 1, share)"), F.lit("..."))).otherwise(F.col("section")))
    order = q.orderBy("later", "place")
    told = told.withColumn("after", F.sum(F.length("section") + 2).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.length("section") - 2)
    # the first that doesn't fit ends the text
    told = told.withColumn("full", F.coalesce(F.max(F.when(F.col("after") > CHARS, 1)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("full = 0")
    left = F.lit(CHARS) - F.col("before") - 2
    part = F.when(F.col("after") <= CHARS, F.col("section")).when(left > LEAST_PART, F.concat(F.substring("section", F.lit(1), left), F.lit("...")))
    told = told.withColumn("part", part).where("part IS NOT NULL")
    return told.groupBy("query_id").agg(F.array_join(in_order("later", "place", "part"), "\n\n").alias("text"))


def overview(types: DataFrame, fcs: DataFrame, central: DataFrame, works: DataFrame, summaries: DataFrame, vertices: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(text): one row on the whole collection, OVERVIEW_CHARS characters at most.

    types: doc_type, n; fcs: fc, n; central: uri, label, fc, rank; works: uri, label, works; summaries: as of `relations.summaries`. Types by number, TYPES of them; categories by number; the central documents of each of
    `categories`; ACTORS with most works, if actors are asked for; RELATIONS of most connections that begin or end in one of the categories, each with its ENDS. All inputs are small counts or reduced to a few rows first.
    """
    from .relations import COMPACT

    spark = types.sparkSession
    few = lambda f, n, *order: f.orderBy(*order).limit(n)
    counted = lambda name, n: F.concat(name, F.lit(": "), n)
    joined = lambda f, order, text, begin, place: f.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("_t")))), lambda x: x["_t"]), ", ").alias("t")).where("t <> ''").select(F.lit(place).alias("place"), F.lit(0).alias("sub"), F.concat(F.lit(begin), "t").alias("line"))
    total = types.agg(F.sum("n").alias("n")).select(F.lit(0).alias("place"), F.lit(0).alias("sub"), F.concat(F.lit("**Dataset overview**: "), F.coalesce("n", F.lit(0)), F.lit(" entities")).alias("line"))
    lines = total.unionByName(joined(few(types, TYPES, F.desc("n"), "doc_type"), [(-F.col("n")).alias("a"), "doc_type"], counted(F.col("doc_type"), F.col("n")), "Entity types: ", 1))
    lines = lines.unionByName(joined(fcs, [(-F.col("n")).alias("a"), "fc"], counted(F.col("fc"), F.col("n")), "Fundamental Categories: ", 2))
    for i, fc in enumerate(sorted(categories)):
        lines = lines.unionByName(joined(central.where(F.col("fc") == fc), [(-F.round("rank", 12)).alias("a"), "uri"], F.col("label"), f"Top {fc}s by graph centrality: ", 3 + i))
    at = 3 + len(categories)
    if "Actor" in categories:
        lines = lines.unionByName(joined(few(works, ACTORS, F.desc("works"), "uri"), [(-F.col("works")).alias("a"), "uri"], F.concat("label", F.lit(" ("), "works", F.lit(")")), "Top Actors by work count: ", at))
    lines = lines.unionByName(spark.createDataFrame([(at + 1, 0, "")], "place int, sub int, line string"))
    ends = spark.createDataFrame([(r.id, r.label, r.domain_fc, r.range_fc) for r in COMPACT], "relation string, label string, domain_fc string, range_fc string")
    asked = summaries.join(ends, "relation").where(F.col("domain_fc").isin(*categories) | F.col("range_fc").isin(*categories))
    shown = few(asked, RELATIONS, F.desc("connections"), "relation").withColumn("place", F.row_number().over(W.orderBy(F.desc("connections"), "relation")) + at + 1)
    head = F.concat(F.lit("**"), "label", F.lit("** ("), "domain_fc", F.lit(" -> "), "range_fc", F.lit(", "), "connections", F.lit(" connections, "), "sources", F.lit(" sources, "), "targets", F.lit(" targets):"))
    parts = [shown.select("place", F.lit(0).alias("sub"), head.alias("line")), shown.select("place", F.lit(3).alias("sub"), F.lit("").alias("line"))]
    for sub, (column, fc) in enumerate((("top_sources", "domain_fc"), ("top_targets", "range_fc")), 1):
        each = shown.select("place", fc, F.posexplode(F.slice(F.split(column, " "), 1, ENDS)).alias("i", "x")).select("place", fc, "i", F.regexp_extract("x", "^(.*)=", 1).alias("uri"), F.regexp_extract("x", "=([0-9]+)$", 1).alias("n"))
        each = each.join(vertices.select("uri", "label"), "uri", "left").select("place", fc, "i", F.concat(F.coalesce("label", local_name(F.col("uri"))), F.lit(" ("), "n", F.lit(")")).alias("t"))
        parts.append(each.groupBy("place", fc).agg(F.array_join(in_order("i", "t"), ", ").alias("t")).select("place", F.lit(sub).alias("sub"), F.concat(F.lit("  Top "), fc, F.lit("s: "), "t").alias("line")))
    for p in parts:
        lines = lines.unionByName(p)
    whole = lines.agg(F.array_join(in_order("place", "sub", "line"), "\n").alias("text"))
    return whole.select(F.when(F.length("text") > OVERVIEW_CHARS, F.concat(F.substring("text", 1, OVERVIEW_CHARS), F.lit("\n...[truncated]"))).otherwise(F.col("text")).alias("text"))
