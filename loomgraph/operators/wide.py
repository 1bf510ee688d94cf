"""Entity, attribute, value rows -> one row per entity with typed columns.

Method: discover the attribute list and types first, then pivot with one conditional aggregation per attribute,
with explicit duplicate resolution and casting. The pivot is a single shuffle by subject; rows of other attributes are
dropped and repeated statements are merged before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import decoded, local_key, named
from ..functions.typed import typed_text

#: most attributes a catalog may list: each is a column of the wide table
MAX_ATTRIBUTES = 2000


@dataclass(frozen=True)
class Attribute:
    name: str
    col_type: str
    bare_unit: str | None
    many: bool


def discover(triples: DataFrame, catalog: DataFrame, many: tuple[str, ...] = ("technique",)) -> list[Attribute]:
    """The attributes of the catalog (attr, col_type, bare_unit) that occur in the data, in the order of their names.

    The catalog is metadata of at most MAX_ATTRIBUTES rows; a larger one is refused. Local names are
    compared without regard to namespace and case. Attributes in `many` may have several values.
    """
    listed = catalog.where("attr IS NOT NULL").limit(MAX_ATTRIBUTES + 1).collect()
    if len(listed) > MAX_ATTRIBUTES:
        raise ValueError(f"the catalog lists more than {MAX_ATTRIBUTES} attributes")
    by_key = {r["attr"].lower(): r for r in listed}
    keys = triples.select(local_key(F.col("predicate")).alias("k")).where(F.col("k").isin(list(by_key))).distinct()
    found = sorted(r["k"] for r in keys.collect())
    return [Attribute(by_key[k]["attr"], by_key[k]["col_type"], by_key[k]["bare_unit"], by_key[k]["attr"] in many) for k in found]


def typed_rows(triples: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(subject, attr, val): every statement of a listed attribute; val is null where it states nothing of the type."""
    keyed = triples.select(decoded(F.col("subject")).alias("subject"), local_key(F.col("predicate")).alias("_k"), decoded(F.col("object")).alias("_o"))
    keyed = keyed.where(F.col("_k").isin([a.name.lower() for a in attributes]) & named(F.col("subject")) & F.col("_o").isNotNull() & ~F.col("_o").startswith("_:"))

    def of(f):
        return F.coalesce(*(F.when(F.col("_k") == a.name.lower(), F.lit(f(a)).cast("string")) for a in attributes), F.lit(None).cast("string"))

    return keyed.select("subject", of(lambda a: a.name).alias("attr"), typed_text(F.col("_o"), of(lambda a: a.col_type), of(lambda a: a.bare_unit)).alias("val"))


def pivot(triples: DataFrame, catalog: DataFrame) -> tuple[DataFrame, list[Attribute]]:
    """The wide table, and its attributes.

    One row per subject with at least one typed value: `subject` and a STRING column per attribute with
    the typed value as text; an attribute that may have several values is a sorted ARRAY<STRING> of distinct ones
    (null if none). Of several values of an attribute with one, the one stated in most rows wins, of
    equally many the smallest text. Null and empty subjects, null, empty and blank-node objects and values that state
    nothing of the type give no cell; repeated rows count as statements; other columns are ignored. Tables
    without any listed attribute give no rows.
    """
    attributes = discover(triples, catalog)
    if not attributes:
        return triples.select(decoded(F.col("subject")).alias("subject")).where("false"), []
    stated = typed_rows(triples, attributes).groupBy("subject", "attr", "val").agg(F.count("*").alias("n"))

    def cell(a: Attribute):
        here = (F.col("attr") == a.name) & F.col("val").isNotNull()
        if a.many:
            values = F.sort_array(F.collect_set(F.when(here, F.col("val"))))
            return F.when(F.size(values) > 0, values).alias(a.name)
        # the most rows, then the smallest text
        best = F.min(F.when(here, F.struct((-F.col("n")).alias("n"), F.col("val").alias("val"))))
        return best["val"].alias(a.name)

    wide = stated.groupBy("subject").agg(*(cell(a) for a in attributes))
    return wide.where(F.greatest(F.lit(False), *(F.col(a.name).isNotNull() for a in attributes))), attributes


def typed_wide(triples: DataFrame, catalog: DataFrame) -> DataFrame:
    """`pivot` with real column types: INT for int, int_mm and int_g, DECIMAL(20,2), DATE, BOOLEAN, STRING, ARRAY<STRING>."""
    wide, attributes = pivot(triples, catalog)
    types = {"int": "int", "int_mm": "int", "int_g": "int", "decimal2": "decimal(20,2)", "date": "date", "bool": "boolean"}
    return wide.select("subject", *(F.col(a.name) if a.many or a.col_type not in types else F.col(a.name).try_cast(types[a.col_type]).alias(a.name) for a in attributes))


def cells(triples: DataFrame, catalog: DataFrame) -> DataFrame:
    """The cells of the wide table, once each: subject, attr, val."""
    wide, attributes = pivot(triples, catalog)
    if not attributes:
        return wide.select("subject", F.lit(None).cast("string").alias("attr"), F.lit(None).cast("string").alias("val"))
    # a struct per attribute with all its values; attributes without a value are dropped before the second explode
    each = F.array(*(F.struct(F.lit(a.name).alias("attr"), (F.col(a.name) if a.many else F.array(a.name)).alias("vals")) for a in attributes))
    held = wide.select("subject", F.explode(each).alias("c")).select("subject", "c.attr", F.explode("c.vals").alias("val"))
    return held.where("val IS NOT NULL")
