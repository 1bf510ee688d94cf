"""The property graph of an input folder: its tables are written once a session and read by all queries on it.

A table is built when a query first needs it, and is kept in the shared folder until the session ends. The input is taken as fixed meanwhile;
`forget` makes the next query build it anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import decoded
from ..operators import graph, ranks, relations, satellites
from ..session import Cut, spread, table

_STORES: dict[tuple[str, str], Store] = {}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.tables: dict[str, Cut | ranks.Links] = {}

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table `name`, written by the first call, and again if its files are gone."""
        held = self.tables.get(name)
        if held is None or not held.exists():
            held = self.tables[name] = Cut(make()).keep()
        return held.df

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def statements(self) -> DataFrame:
        """(s, p_key, o, schema): the source of edges, literals and ends."""
        return self.kept("statements", lambda: graph.statements(spread(self.table("triples").select("subject", "predicate", "object"))))

    @property
    def edges(self) -> DataFrame:
        return self.kept("edges", lambda: graph.edges_of(self.statements, self.table("property_labels")))

    @property
    def literals(self) -> DataFrame:
        return self.kept("literals", lambda: graph.literals_of(self.statements))

    @property
    def types(self) -> DataFrame:
        """(uri, type_uri), decoded, each once."""
        t = self.table("entity_types").select(decoded(F.col("uri")).alias("uri"), decoded(F.col("type_uri")).alias("type_uri"))
        return self.kept("types", lambda: t.where("uri IS NOT NULL AND type_uri IS NOT NULL").distinct())

    @property
    def vertices(self) -> DataFrame:
        ends = lambda: self.edges.select(F.explode(F.array("src", "dst")).alias("uri"))
        return self.kept("vertices", lambda: graph.vertices(self.table("vertices"), self.types, self.table("fc_classes"), ends()))

    @property
    def satellites(self) -> DataFrame:
        """(uri, kind) of what is told in its parent's document."""
        return self.kept("satellites", lambda: satellites.kinds(self.types))

    @property
    def shortcuts(self) -> DataFrame:
        make = lambda: relations.shortcuts(self.edges, self.vertices, left_out=self.satellites, no_objects=satellites.rights_and_names(self.types))
        return self.kept("shortcuts", make)

    @property
    def all_edges(self) -> DataFrame:
        """(src, dst, p_key, predicate_label, weight, edge_type): shortcuts (`fr`) and the plain edges (`rdf`) that none replaces."""
        return self.kept("all_edges", lambda: relations.merged(self.edges, self.shortcuts))

    @property
    def links(self) -> ranks.Links:
        """All edges in blocks, for personalised ranks."""
        held = self.tables.get("links")
        if held is None or not held.exists():
            held = self.tables["links"] = ranks.Links(self.all_edges).keep()
        return held

    @property
    def pagerank(self) -> DataFrame:
        """(uri, rank) over the shortcut edges, to the tolerance of `ranks`."""
        return self.kept("pagerank", lambda: ranks.pagerank(self.shortcuts.withColumn("weight", F.lit(1.0))))


def store(spark: SparkSession, folder: str) -> Store:
    key = spark.sparkContext.applicationId, folder
    if key not in _STORES:
        _STORES[key] = Store(spark, folder)
    return _STORES[key]


def forget() -> None:
    _STORES.clear()
