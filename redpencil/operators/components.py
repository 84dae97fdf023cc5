"""Connected components of an edge table by contraction: every round merges neighbours and keeps only edges between groups.

All vertices stand in one hashed order. In a round each takes the first vertex around it for its leader, then that one's
leader. Edges are renamed to the leaders; those inside a group and repeated ones go, so that vertices and edges get fewer
with every round instead of being joined again whole. A star is one group after two rounds at most, and a chain needs a
logarithmic number. The smallest vertex of a group is carried up, and handed down again through the rounds' own tables.

Groups are reduced by partial aggregates. Every table that meets a hub's rows in a join is stored first, as only joins of
plain shuffles are split where one key holds many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.operators.shared import materialize


@dataclass(frozen=True)
class Round:
    """One contraction: (node, leader) of the vertices with edges, and (node, low), the smallest vertex in each new group."""

    leaders: DataFrame
    lows: DataFrame


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (item_no, component) of ``nodes`` (item_no) and ``edges`` (a, b), the component being its smallest node.

    A node without edges is a component of its own. Edges of a node to itself and repeated edges change nothing.
    """
    rounds = contractions(edges)
    found = None
    for contraction in reversed(rounds):
        found = materialize(_handed_down(contraction, found))
    own = nodes.select("item_no")
    if found is None:
        return own.select("item_no", F.col("item_no").alias("component"))
    joined = own.join(found, own["item_no"] == found["node"], "left")
    return materialize(joined.select("item_no", F.coalesce("component", "item_no").alias("component")))


def contractions(edges: DataFrame) -> list[Round]:
    """The rounds from all vertices with edges down to groups without any edge between them."""
    rounds: list[Round] = []
    live = materialize(_between(edges))
    while not live.isEmpty():
        leaders = materialize(_leaders(live))
        own = leaders.withColumn("low", F.col("node")) if not rounds else leaders.join(rounds[-1].lows, "node")
        lows = own.groupBy(F.col("leader").alias("node")).agg(F.min("low").alias("low"))
        rounds.append(Round(leaders, materialize(lows)))
        live = materialize(_between(_renamed(_renamed(live, leaders, "a"), leaders, "b")))
    return rounds


def _between(edges: DataFrame) -> DataFrame:
    """Edges between different vertices, each once, smaller vertex first."""
    return edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _placed(node: str) -> Column:
    """A vertex with its place in the hashed order."""
    return F.struct(F.xxhash64(node).alias("place"), F.col(node).cast("bigint").alias("node"))


def _leaders(edges: DataFrame) -> DataFrame:
    """Rows (node, leader): the leader of the first vertex around a vertex, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.groupBy("a").agg(F.min(_placed("b")).alias("first"))
    first = materialize(around.select(F.col("a").alias("node"), F.least("first", _placed("a"))["node"].alias("leader")))
    return _renamed(first, first, "leader")


def _renamed(rows: DataFrame, leaders: DataFrame, column: str) -> DataFrame:
    """``rows`` with the leader of a vertex in its place. Every vertex has one."""
    names = leaders.select(F.col("node").alias("_node"), F.col("leader").alias("_leader"))
    joined = rows.join(names, F.col(column) == F.col("_node"))
    return joined.select(*[F.col("_leader").alias(c) if c == column else F.col(c) for c in rows.columns])


def _handed_down(contraction: Round, above: DataFrame | None) -> DataFrame:
    """Rows (node, component) of a round's vertices, from those of the round after it; a group that had no edges left ends there."""
    groups = contraction.lows.select(F.col("node").alias("leader"), F.col("low").alias("component"))
    if above is not None:
        known = above.select(F.col("node").alias("leader"), F.col("component").alias("_above"))
        groups = groups.join(known, "leader", "left").select("leader", F.coalesce("_above", "component").alias("component"))
    return contraction.leaders.join(materialize(groups), "leader").select("node", "component")
