"""Labels: which one of an entity's names is shown, and what has a given label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import local_name
from .graph import first_few

# Literal properties that name an entity, by preference.
NAMES = ("preflabel", "p190_has_symbolic_content", "label", "name", "title", "value", "description")
# Fixed value: the type of a preferred name.
PREFERRED = "http://vocab.getty.edu/aat/300404670"


def preferred(vertices: DataFrame, literals: DataFrame, edges: DataFrame, preferred_type: str = PREFERRED) -> DataFrame:
    """(uri, label) of every vertex (uri, label).

    Stages: own preferred labels; labels of names (P1) of the preferred type; the content of names; labels of names; own labels. The first stage with exactly
    one value decides, else the smallest value of the first stage that has any. Without any the first of NAMES that the entity has, else its label as a vertex.
    """
    values = literals.select("uri", "prop", F.explode("vals").alias("val"))
    p1 = edges.where(F.col("p_key").isin("p1_is_identified_by", "p1i_identifies")).select(F.col("src").alias("owner"), F.col("dst").alias("uri")).distinct()
    best = edges.where(F.col("p_key").isin("p2_has_type", "p2i_is_type_of") & (F.col("dst") == preferred_type)).select(F.col("src").alias("uri")).distinct()
    own = values.where("prop IN ('preflabel', 'label')").select("uri", F.when(F.col("prop") == "preflabel", 1).otherwise(5).alias("stage"), "val")
    named = p1.join(best, "uri", "left_semi").join(vertices.select("uri", F.col("label").alias("val")), "uri").where(F.col("val") != local_name(F.col("uri"))).select(F.col("owner").alias("uri"), F.lit(2).alias("stage"), "val")
    content = p1.join(values.where("prop IN ('p190_has_symbolic_content', 'label')"), "uri").select(F.col("owner").alias("uri"), F.when(F.col("prop") == "label", 4).otherwise(3).alias("stage"), "val")
    stages = own.unionByName(named).unionByName(content).groupBy("uri", "stage").agg(F.min("val").alias("val"), F.count("*").alias("n"))
    first = F.min(F.struct(F.when(F.col("n") == 1, 0).otherwise(1).alias("several"), "stage", "val"))
    decided = stages.groupBy("uri").agg(first["val"].alias("staged"))
    place = F.create_map(*(F.lit(x) for i, p in enumerate(NAMES) for x in (p, i)))
    listed = literals.where(F.col("prop").isin(*NAMES)).groupBy("uri").agg(F.min(F.struct(F.element_at(place, F.col("prop")).alias("p"), F.element_at("vals", 1).alias("v")))["v"].alias("listed"))
    return vertices.select("uri", F.col("label").alias("given")).join(decided, "uri", "left").join(listed, "uri", "left").select("uri", F.coalesce("staged", "listed", "given").alias("label"))


def find(vertices: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """(wanted, uri, r): at most `most` vertices (uri, label), smallest first, that have the (label) of `wanted` but for case and outer white space."""
    key = F.lower(F.trim("label"))
    asked = wanted.where("trim(label) <> ''").select(key.alias("key"), F.col("label").alias("wanted")).distinct()
    return first_few(asked.join(vertices.select("uri", key.alias("key")), "key").select("wanted", "uri"), ["wanted"], ["uri"], most, "uri").select("wanted", "uri", "r")


def search(vertices: DataFrame, terms: DataFrame, most: int = 20) -> DataFrame:
    """(term, uri, r): at most `most` vertices with a word of their label that begins with (term), smallest first; case doesn't count.

    Words meet terms by their first letters, as long as the shortest term, so neither side is compared with all of the other.
    """
    shortest = terms.agg(F.min(F.length("term"))).first()[0]
    if not shortest:
        return vertices.select(F.col("uri").alias("term"), "uri", F.lit(1).alias("r")).where("false")
    begin = lambda c: F.substring(c, 1, shortest)
    words = vertices.select("uri", F.explode(F.array_distinct(F.split(F.lower("label"), r"[^\p{L}\p{N}]+"))).alias("word")).withColumn("begin", begin("word"))
    met = words.join(terms.select(F.lower("term").alias("term")).distinct().withColumn("begin", begin("term")), "begin").where(F.col("word").startswith(F.col("term")))
    return first_few(met.select("term", "uri").distinct(), ["term"], ["uri"], most, "uri").select("term", "uri", "r")


def class_label(type_uri: Column) -> Column:
    """`E22_Human-Made_Object` -> `Human-Made Object`."""
    return F.regexp_replace(F.regexp_replace(local_name(type_uri), r"(?i)^[a-z]+\d+[a-z]?_", ""), "_", " ")


def is_technical(name: Column) -> Column:
    """Whether a class goes by its code."""
    return local_name(name).rlike(r"(?i)^[a-z]+\d+[a-z]?_")


def class_labels(types: DataFrame) -> DataFrame:
    """(class, label, technical, n): classes of (uri, type_uri) by local name without regard to case, with the number of entities."""
    c = types.select(F.lower(local_name(F.col("type_uri"))).alias("class"), "type_uri", "uri")
    g = c.groupBy("class").agg(F.min(local_name(F.col("type_uri"))).alias("name"), F.count_distinct("uri").alias("n"))
    return g.select("class", class_label(F.col("name")).alias("label"), is_technical(F.col("name")).alias("technical"), "n")


def types_shown(types: DataFrame, satellites: DataFrame) -> DataFrame:
    """(uri, type): what a satellite's short document is headed by, the smallest label of its classes."""
    return types.join(satellites.select("uri"), "uri", "left_semi").groupBy("uri").agg(F.min(class_label(F.col("type_uri"))).alias("type"))
