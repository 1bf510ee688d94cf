"""Loomgraph: graph, text and table processing as Spark DataFrame jobs."""
