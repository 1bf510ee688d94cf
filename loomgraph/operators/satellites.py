"""Satellites: entities such as names, dimensions and time-spans that are told in the document of the entity they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import local_name

# Classes of satellites by kind; an entity of several kinds has the kind named first.
KINDS = {
    "appellation": ("E41_Appellation", "E42_Identifier", "E35_Title", "E41_E33_Linguistic_Appellation", "E33_E41_Linguistic_Appellation"),
    "type": ("E55_Type", "E56_Language", "E57_Material", "E58_Measurement_Unit", "E98_Currency"),
    "dimension": ("E54_Dimension", "E97_Monetary_Amount"),
    "time": ("E52_Time-Span",),
    "reference": ("PC67_refers_to",),
    "digital": ("D1_Digital_Object", "D9_Data_Object", "D29_Annotation_Object"),
    "other": ("E30_Right",),
}
# Classes of rights and names, with those below them.
RIGHTS_AND_NAMES = ("E30_Right", "E41_Appellation", "E42_Identifier", "E35_Title", "E41_E33_Linguistic_Appellation", "E33_E41_Linguistic_Appellation")


def kinds(types: DataFrame) -> DataFrame:
    """(uri, kind) of all satellites among (uri, type_uri); case and namespace of classes don't count."""
    order = list(KINDS)
    table = F.create_map(*(F.lit(x) for i, k in enumerate(order) for c in KINDS[k] for x in (c.lower(), i)))
    found = types.select("uri", F.try_element_at(table, F.lower(local_name(F.col("type_uri")))).alias("k")).where("k IS NOT NULL")
    return found.groupBy("uri").agg(F.element_at(F.array(*(F.lit(k) for k in order)), F.min("k") + 1).alias("kind"))


def rights_and_names(types: DataFrame) -> DataFrame:
    """(uri) that relations between any objects don't count as objects."""
    return types.where(F.lower(local_name(F.col("type_uri"))).isin([c.lower() for c in RIGHTS_AND_NAMES])).select("uri").distinct()


def parents(satellites: DataFrame, edges: DataFrame) -> DataFrame:
    """(uri, kind, parent): the smallest source of an incoming edge (src, dst, edge_type) that is no satellite itself; plain edges come before shortcuts.

    Satellites without such a source have no row. Sources are reduced per task before the shuffle, so one with many of them does no harm.
    """
    into = edges.join(satellites.select(F.col("uri").alias("dst"), "kind"), "dst").join(satellites.select(F.col("uri").alias("src")), "src", "left_anti")
    first = into.groupBy(F.col("dst").alias("uri"), "kind").agg(F.min(F.struct(F.when(F.col("edge_type") == "rdf", 0).otherwise(1).alias("p"), "src")).alias("x"))
    return first.select("uri", "kind", F.col("x.src").alias("parent"))
