"""Connected components of a graph that lives in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkloom.operators.graph import connected_components


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable by edges (u, v), for each node that has an edge."""
    return connected_components(edges.select("u", "v").toDF("src", "dst"))
