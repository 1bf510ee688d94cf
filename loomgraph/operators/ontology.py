"""Tables of an ontology given as statements (subject, predicate, object, lang): labels, classes, inverses, taxonomy, domains and ranges, categories of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import local_name
from ..session import Cut

# Types of properties and classes, by local name.
PROPERTY_TYPES = ("Property", "ObjectProperty", "DatatypeProperty")
CLASS_TYPES = ("Class",)


def _of_type(st: DataFrame, names: tuple[str, ...]) -> DataFrame:
    typed = st.where(local_name(F.col("predicate")) == "type")
    return typed.where(local_name(F.col("object")).isin(*names)).select("subject").distinct()


def _labelled(st: DataFrame, subjects: DataFrame, name: str) -> DataFrame:
    """(name, label): the English label, else the one without a language, else the words of the local name without its code."""
    said = st.where((local_name(F.col("predicate")) == "label") & F.lower("lang").rlike("^(en(-.*)?)?$"))
    best = said.groupBy("subject").agg(F.min(F.struct((F.col("lang") == "").alias("plain"), F.col("object").alias("label")))["label"].alias("label"))
    words = F.trim(F.regexp_replace(F.regexp_replace(local_name(F.col("subject")), r"^[A-Z]+\d+[a-z]?_", ""), "[_-]", " "))
    return subjects.join(best, "subject", "left").select(F.col("subject").alias(name), F.coalesce("label", words).alias("label"))


def property_labels(st: DataFrame) -> DataFrame:
    """(property, label) of all properties."""
    return _labelled(st, _of_type(st, PROPERTY_TYPES), "property")


def classes(st: DataFrame) -> DataFrame:
    """(class, label) of all classes."""
    return _labelled(st, _of_type(st, CLASS_TYPES), "class")


def inverses(st: DataFrame) -> DataFrame:
    """(property, inverse) by local name, both ways."""
    one = st.where(local_name(F.col("predicate")) == "inverseOf").select(local_name(F.col("subject")).alias("property"), local_name(F.col("object")).alias("inverse"))
    return one.unionByName(one.select(F.col("inverse").alias("property"), F.col("property").alias("inverse"))).distinct()


def taxonomy(st: DataFrame) -> DataFrame:
    """(kind, child, parent) by local name: `property` or `class`; links of a name with itself and with blank nodes are left out."""
    kind = F.when(local_name(F.col("predicate")) == "subPropertyOf", "property").when(local_name(F.col("predicate")) == "subClassOf", "class")
    both = st.select(kind.alias("kind"), local_name(F.col("subject")).alias("child"), local_name(F.col("object")).alias("parent"), "subject", "object")
    return both.where("kind IS NOT NULL AND child <> parent AND subject NOT LIKE '\\\\_:%' AND object NOT LIKE '\\\\_:%'").select("kind", "child", "parent").distinct()


def domains_and_ranges(st: DataFrame) -> DataFrame:
    """(property, domain, range) by local name; of several the smallest."""
    at = lambda n: F.min(F.when(local_name(F.col("predicate")) == n, local_name(F.col("object"))))
    return st.where(local_name(F.col("predicate")).isin("domain", "range")).groupBy(local_name(F.col("subject")).alias("property")).agg(at("domain").alias("domain"), at("range").alias("range"))


def below(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(name): the (name) of `seeds` and all below them over (child, parent) links, a level a round; cycles end when nothing new is met."""
    seen = Cut(seeds.select("name").distinct())
    while True:
        new = links.join(seen.df.select(F.col("name").alias("parent")), "parent").select(F.col("child").alias("name")).distinct().join(seen.df, "name", "left_anti")
        nxt = Cut(seen.df.unionByName(new))
        grown = nxt.df.count() > seen.df.count()
        seen.drop()
        seen = nxt
        if not grown:
            return seen.df


def class_categories(links: DataFrame, given: DataFrame) -> DataFrame:
    """(class, fc): the category given to a class (class, fc), else that of the nearest class above that has one, of equally near ones the smallest name's; (child, parent) links."""
    known = Cut(given.select("class", "fc").groupBy("class").agg(F.min("fc").alias("fc")))
    open_ = Cut(links.select(F.col("child").alias("class")).distinct().join(known.df, "class", "left_anti").select("class", F.col("class").alias("at")))
    # the way up passes each class once, so there are no more rounds than classes, also if they form a cycle
    for _ in range(links.select("parent").distinct().count()):
        if open_.df.isEmpty():
            break
        up = open_.df.join(links.select(F.col("child").alias("at"), "parent"), "at").select("class", F.col("parent").alias("at")).distinct()
        met = up.join(known.df.withColumnRenamed("class", "at"), "at").groupBy("class").agg(F.min(F.struct("at", "fc"))["fc"].alias("fc"))
        found = Cut(known.df.unionByName(met))
        rest = Cut(up.join(found.df, "class", "left_anti"))
        known.drop()
        open_.drop()
        known, open_ = found, rest
    return known.df
