"""Documents, records and exports written from the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.terms import local_name
from .graph import first_few, in_order

# Limits of a document.
VALUE_CHARS, VALUES, OTHER_PROPERTIES = 200, 3, 3
TARGETS, RELATION_LINES, LINES, REFERRERS = 10, 20, 25, 10
#: relations with more targets than this but at most two different labels say nothing
FEW = 5
# Literal properties in the order in which a document tells them; three others follow.
FIRST_PROPERTIES = ("label", "preflabel", "altlabel", "name", "title", "description", "note", "comment", "value", "date", "begin_of_the_begin", "end_of_the_end")
# Labels of relations whose targets are told with their attributes.
DEPICTIONS = ("denotes", "portray", "is target of portray", "is denoted by", "is target of is composed of")
# Properties that tell what a target is.
TAGS, ATTRIBUTES = ("p2_has_type", "p2i_is_type_of"), ("k14_has_attribute", "p3_has_note")
VENUES, COORDINATES = ("p7_took_place_at", "p7i_witnessed"), ("p168_place_is_defined_by", "p168i_defines_place")


def base_label(label: Column) -> Column:
    """The label without its last ` (...)`."""
    return F.trim(F.regexp_replace(label, r"(?s)^(.+) \(.*$", "$1"))


def is_noise(label: Column) -> Column:
    """Whether a label is but a number or a hash."""
    return base_label(label).rlike(r"^(?:\d+$|[0-9a-fA-F-]{32,})")


def displayed(prop: Column) -> Column:
    """A property's name in words."""
    return F.initcap(F.replace(prop, F.lit("_"), F.lit(" ")))


def _values(vals: Column) -> Column:
    return F.array_join(F.transform(F.slice(vals, 1, VALUES), lambda x: F.substring(x, 1, VALUE_CHARS)), "; ")


def literal_lines(literals: DataFrame) -> DataFrame:
    """(uri, lits ARRAY<STRING>, every ARRAY<STRING>): lines of FIRST_PROPERTIES and OTHER_PROPERTIES more, and of all properties by name."""
    place = F.create_map(*(F.lit(x) for i, p in enumerate(FIRST_PROPERTIES) for x in (p, i)))
    told = literals.select("uri", "prop", F.concat(displayed(F.col("prop")), F.lit(": "), _values(F.col("vals"))).alias("line"), F.coalesce(F.try_element_at(place, "prop"), F.lit(99)).alias("place"))
    all_ = told.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("place", "prop", "line"))).alias("x"))
    line = lambda x: x["line"]
    first, rest = F.filter("x", lambda x: x["place"] < 99), F.filter("x", lambda x: x["place"] == 99)
    every = F.transform(F.array_sort(F.transform("x", lambda x: F.struct(x["prop"].alias("prop"), x["line"].alias("line")))), line)
    return all_.select("uri", F.transform(F.concat(first, F.slice(rest, 1, OTHER_PROPERTIES)), line).alias("lits"), every.alias("every"))


def enrichments(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(uri, tag, attributes, venue, coordinates): what an entity's plain edges (src, dst, p_key) say of it, in the labels of their ends.

    tag is the smallest label of a type, else doc_type; at most five attributes are kept. Of several venues or coordinates the smallest label counts.
    """
    e = edges.where(F.col("p_key").isin(*TAGS, *ATTRIBUTES, *VENUES, *COORDINATES)).join(vertices.select(F.col("uri").alias("dst"), "label"), "dst")
    told = lambda props: F.when(F.col("p_key").isin(*props), F.col("label"))
    found = e.groupBy(F.col("src").alias("uri")).agg(F.min(told(TAGS)).alias("tag"), F.min(told(VENUES)).alias("venue"), F.min(told(COORDINATES)).alias("coordinates"))
    some = first_few(e.where(F.col("p_key").isin(*ATTRIBUTES)).select(F.col("src").alias("uri"), "label").distinct(), ["uri"], ["label"], 5, "label")
    found = found.join(some.groupBy("uri").agg(F.sort_array(F.collect_list("label")).alias("attributes")), "uri", "left")
    typed = vertices.select("uri", F.when(~F.col("doc_type").isin("", "Unknown", "Entity"), F.col("doc_type")).alias("doc_type"))
    both = typed.join(found, "uri", "left").select("uri", F.coalesce("tag", "doc_type").alias("tag"), F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"), "venue", "coordinates")
    return both.where("tag IS NOT NULL OR size(attributes) > 0 OR venue IS NOT NULL OR coordinates IS NOT NULL")


def shown_targets(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """(uri, place, label, total, other, target, r): the first TARGETS of (uri, place, label, other), by label and uri; total counts all."""
    named = links.join(vertices.select(F.col("uri").alias("other"), F.col("label").alias("target")), "other", "left").withColumn("target", F.coalesce("target", local_name(F.col("other"))))
    totals = links.groupBy("uri", "place", "label").agg(F.count("*").alias("total"))
    return first_few(named, ["uri", "place", "label"], ["target", "other"], TARGETS, "other").join(totals, ["uri", "place", "label"])


def without_overlaps(shown: DataFrame, share: float = 0.8) -> DataFrame:
    """`shown_targets` without those of a relation that shares more than `share` of the fewer targets with one that has more in all, of equally many with an earlier one."""
    sizes = shown.groupBy("uri", "place", "total").agg(F.count("*").alias("n"))
    a = shown.select("uri", "other", F.col("place").alias("pa"))
    common = a.join(a.withColumnRenamed("pa", "pb"), ["uri", "other"]).where("pa <> pb").groupBy("uri", "pa", "pb").agg(F.count("*").alias("common"))
    one = lambda x: sizes.select("uri", F.col("place").alias(f"p{x}"), F.col("total").alias(f"t{x}"), F.col("n").alias(f"n{x}"))
    lost = common.join(one("a"), ["uri", "pa"]).join(one("b"), ["uri", "pb"]).where(F.col("common") > share * F.least("na", "nb")).where("tb > ta OR (tb = ta AND pb < pa)")
    return shown.join(lost.select("uri", F.col("pa").alias("place")).distinct(), ["uri", "place"], "left_anti")


def relation_lines(shown: DataFrame, told: DataFrame, dates: DataFrame) -> DataFrame:
    """(uri, place, line) of `shown_targets`, with what `enrichments` and (uri, date) say of the targets.

    A line is left out if all its targets are noise without a date, or if it has more than FEW targets but at most two different labels. Targets that read the
    same are told apart by type, date and venue, else by the end of their uri.
    """
    t = shown.join(told.withColumnRenamed("uri", "other"), "other", "left").join(dates.withColumnRenamed("uri", "other"), "other", "left")
    tag = F.when(F.col("tag") != "Time-Span", F.col("tag"))
    several = lambda *parts: F.concat_ws(", ", *parts)
    said = several(F.col("tag"), F.when(F.lower("label").isin(*DEPICTIONS), F.concat_ws(", ", "attributes")), F.col("coordinates"))
    in_brackets = lambda x: F.concat(F.col("target"), F.lit(" ("), x, F.lit(")"))
    dated = F.when(tag.isNotNull(), in_brackets(F.col("date"))).otherwise(F.col("date"))
    text = F.when(F.col("date").isNotNull(), dated).when(said != "", in_brackets(said)).otherwise(F.col("target"))
    t = t.withColumn("said", text).withColumn("same", F.count("*").over(W.partitionBy("uri", "place", "label", "said")))
    apart = several(tag, F.col("date"), F.col("venue"))
    end = F.concat(F.col("target"), F.lit(" ["), F.substring(F.regexp_extract("other", r"([^/]*)$", 1), 1, 30), F.lit("]"))
    t = t.withColumn("said", F.when(F.col("same") <= 1, F.col("said")).when(apart != "", in_brackets(apart)).otherwise(end))
    lines = t.groupBy("uri", "place", "label", "total").agg(
        F.array_join(in_order("r", "said"), ", ").alias("said"),
        F.bool_and(is_noise(F.col("target")) & F.col("date").isNull()).alias("noise"),
        F.count_distinct(base_label(F.col("target"))).alias("labels"),
    )
    lines = lines.where("NOT noise").where(~((F.col("total") > FEW) & (F.col("labels") <= 2)))
    return lines.select("uri", "place", "label", F.concat(F.upper(F.substring("label", 1, 1)), F.expr("substring(label, 2)"), F.lit(": "), "said").alias("line"))


def absorbed_lines(satellites: DataFrame, vertices: DataFrame, spans: DataFrame) -> DataFrame:
    """(uri, absorbed ARRAY<STRING>): what satellites (uri, kind, parent) tell in the document of their parent.

    Names other than the parent's label, dimensions and time-spans, five of each; five references and three digital objects. Types are told by relations.
    """
    label = vertices.select("uri", "label")
    s = satellites.where("kind IN ('appellation', 'dimension', 'time', 'reference', 'digital')").join(label, "uri").join(spans, "uri", "left")
    s = s.join(label.select(F.col("uri").alias("parent"), F.col("label").alias("whole")), "parent", "left")
    s = s.withColumn("said", F.when(F.col("kind") == "time", F.col("span")).otherwise(F.col("label"))).where("said <> ''")
    key = F.when(F.col("kind") == "appellation", F.lower(F.trim("said"))).otherwise(F.col("uri"))
    s = s.withColumn("key", key).where("kind <> 'appellation' OR key <> lower(trim(coalesce(whole, '')))")
    s = s.groupBy("parent", "kind", "key").agg(F.min("said").alias("said"))
    few = first_few(s, ["parent", "kind"], ["said", "key"], 5, "key").where("kind <> 'digital' OR r <= 3").groupBy("parent", "kind").agg(in_order("r", "said").alias("said"))
    # How the lines begin, in their order.
    begin = (("appellation", "Also known as: "), ("dimension", "Dimensions: "), ("time", "Time-span: "), ("reference", "Referenced in: "), ("digital", "Digital: "))
    place = F.create_map(*(F.lit(x) for i, (k, _) in enumerate(begin) for x in (k, i)))
    head = F.element_at(F.create_map(*(F.lit(x) for pair in begin for x in pair)), F.col("kind"))
    lines = F.when(F.col("kind") == "reference", F.transform("said", lambda x: F.concat(head, x))).otherwise(F.array(F.concat(head, F.array_join("said", ", "))))
    return few.select("parent", F.element_at(place, F.col("kind")).alias("place"), lines.alias("lines")).groupBy(F.col("parent").alias("uri")).agg(F.flatten(in_order("place", "lines")).alias("absorbed"))


def referred(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(uri, referred): the line of those that refer to an entity by a plain edge, REFERRERS labels of more than three characters, and how many more."""
    into = edges.where(F.col("p_key").isin("p67_refers_to", "p67i_is_referred_to_by")).select(F.col("dst").alias("uri"), "src")
    into = into.join(vertices.select(F.col("uri").alias("src"), F.col("label").alias("by")), "src").where("length(by) > 3")
    few = first_few(into, ["uri"], ["by", "src"], REFERRERS, "src").groupBy("uri").agg(F.array_join(in_order("r", "by"), ", ").alias("by"))
    both = few.join(into.groupBy("uri").agg(F.count("*").alias("n")), "uri")
    more = F.when(F.col("n") > REFERRERS, F.concat(F.lit(" ... and "), F.col("n") - REFERRERS, F.lit(" more"))).otherwise("")
    return both.select("uri", F.concat(F.lit("Referenced by: "), "by", more).alias("referred"))


def documents(vertices: DataFrame, literals: DataFrame, lines: DataFrame, absorbed: DataFrame, referred_: DataFrame, minimal: DataFrame) -> DataFrame:
    """(uri, doc) of every vertex.

    `[category] label`; literals; what satellites tell; relations; who refers to it; a blank line after each of the first three parts that isn't empty. `lines` are (uri, direct, place,
    line): RELATION_LINES of derived relations and then direct ones, LINES in all, equal lines once. What is in `minimal` (uri, type) has its type, label and all literals only.
    """
    kept = lines.groupBy("uri", "line").agg(F.min(F.struct("direct", "place")).alias("x")).select("uri", "line", "x.*")
    place = F.row_number().over(W.partitionBy("uri", "direct").orderBy("place", "line"))
    kept = kept.withColumn("r", place).where((F.col("r") <= RELATION_LINES) | F.col("direct"))
    kept = kept.withColumn("r", F.row_number().over(W.partitionBy("uri").orderBy("direct", "place", "line"))).where(F.col("r") <= LINES)
    rel = kept.groupBy("uri").agg(in_order("r", "line").alias("rels"))
    both = vertices.join(literal_lines(literals), "uri", "left").join(rel, "uri", "left").join(absorbed, "uri", "left").join(referred_, "uri", "left").join(minimal.select("uri", "type"), "uri", "left")
    nothing = F.array().cast("array<string>")
    some = lambda c: F.when(F.size(c) > 0, F.concat(F.col(c), F.array(F.lit("")))).otherwise(nothing)
    head = lambda x: F.array(F.concat(F.lit("["), x, F.lit("] "), F.col("label")), F.lit(""))
    whole = F.concat(head(F.when(F.col("fc") == "", "Entity").otherwise(F.col("fc"))), some("lits"), some("absorbed"), F.coalesce("rels", nothing), F.when(F.col("referred").isNotNull(), F.array("referred")).otherwise(nothing))
    short = F.concat(head(F.col("type")), F.coalesce("every", nothing))
    return both.select("uri", F.array_join(F.when(F.col("type").isNotNull(), short).otherwise(whole), "\n").alias("doc"))


def markdown(documents: DataFrame) -> DataFrame:
    """(file_name, content) of (uri, label, fc, doc, types, wikidata, images): a header between dashes, then the text; names end in the URI's hash.

    types, wikidata and images may be null; at most five images are named.
    """
    safe = F.substring(F.regexp_replace("label", r"[^\p{L}\p{N}._-]+", "_"), 1, 100)
    name = F.concat(safe, F.lit("_"), F.substring(F.md5("uri"), 1, 8), F.lit(".md"))
    listed = lambda title, c, n: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(F.slice(c, 1, n), lambda x: F.concat(F.lit("  - "), x)), "\n"), F.lit("\n"))).otherwise("")
    wiki = F.coalesce(F.concat(F.lit("Wikidata: "), "wikidata", F.lit("\n")), F.lit(""))
    content = F.concat(
        F.lit("---\nURI: "), "uri", F.lit('\nLabel: "'), F.regexp_replace("label", '"', "'"), F.lit('"\nType: '), "fc", F.lit("\n"),
        listed("Types", "types", 1000), wiki, listed("Images", "images", 5), F.lit("---\n\n"), "doc",
    )
    return documents.select(name.alias("file_name"), content.alias("content"))


def write_markdown(named: DataFrame, folder: str) -> None:
    """(file_name, content) rows as text, divided over folders by the first two digits of the hash in the name; one text file per task and folder, a record each."""
    named.withColumn("part", F.regexp_extract("file_name", r"_([0-9a-f]{2})[0-9a-f]{6}\.md$", 1)).select("part", F.to_json(F.struct("file_name", "content")).alias("value")).write.partitionBy("part").text(folder)


def records(documents: DataFrame) -> DataFrame:
    """(uri, record): one JSON object per document."""
    return documents.select("uri", F.to_json(F.struct(*(c for c in documents.columns))).alias("record"))


def chained(documents: DataFrame, edges: DataFrame, about: DataFrame, thin: int = 400, most: int = 5000) -> DataFrame:
    """(uri, doc): documents of fewer than `thin` characters are appended to their neighbours and left out where they have any.

    documents: uri, doc; edges: src, dst; about: uri, label, type, for the heads of sections. Events and actors are never left out. One pass: thin documents aren't passed on to
    other thin ones, so the result doesn't depend on an order. A receiver takes sections in the order of length and URI while the whole stays within `most`
    characters; parallel edges count once. Lengths are ranked before texts are sent, so a hub gets no more text than it keeps.
    """
    sized = documents.select("uri", "doc", F.length("doc").alias("n"))
    thin_ = (F.col("n") < thin) & ~F.ltrim("doc").rlike(r"^\[(?:Event|Actor)\]")
    head = F.concat(F.lit("\n\nRelated entity — "), "label", F.lit(" ("), F.when(F.coalesce("type", F.lit("")) == "", "Entity").otherwise(F.col("type")), F.lit("):\n"))
    small = sized.where(thin_).join(about.select("uri", "label", "type"), "uri").select("uri", "doc", F.concat(head, "doc").alias("part"))
    large = sized.where(~thin_)
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = edges.where("src <> dst").select(ways.alias("x")).select("x.*").distinct()
    sent = both.join(small.select(F.col("uri").alias("src"), F.length("part").alias("m")), "src").join(large.select(F.col("uri").alias("dst"), "n"), "dst")
    # what is kept in the end is kept within its salt as well, so no task sums over all neighbours of a hub
    kept = sent.withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(64)))
    for keys in (("dst", "salt"), ("dst",)):
        w = W.partitionBy(*keys).orderBy("m", "src").rowsBetween(W.unboundedPreceding, 0)
        kept = kept.withColumn("total", F.col("n") + F.sum("m").over(w)).where(F.col("total") <= most)
    texts = kept.join(small.select(F.col("uri").alias("src"), "part"), "src")
    parts = texts.groupBy(F.col("dst").alias("uri")).agg(F.array_join(in_order("m", "src", "part"), "").alias("more"))
    got = large.join(parts, "uri", "left").select("uri", F.concat("doc", F.coalesce("more", F.lit(""))).alias("doc"))
    alone = small.join(kept.select(F.col("src").alias("uri")).distinct(), "uri", "left_anti").select("uri", "doc")
    return got.unionByName(alone)
