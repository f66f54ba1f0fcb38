"""The model of areas: graph, snaps, distances and what the solver needs, as a bundle of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.checkpoints import written
from loopwright.functions import geo
from loopwright.operators import graph, snap


@dataclass
class Model:
    houses: DataFrame
    edges: DataFrame
    segments: DataFrame
    components: DataFrame
    snaps: DataFrame
    dist: DataFrame
    xy: DataFrame
    disconnected: DataFrame

    def solver_houses(self) -> DataFrame:
        """area, house_id, ord, x, y, segment."""
        placed = self.xy.join(self.snaps.select("area", "house_id", "segment"), ["area", "house_id"])
        return placed.join(self.houses.select("area", "house_id", "ord"), ["area", "house_id"]).select("area", "house_id", "ord", "x", "y", "segment")


def build_model(houses: DataFrame, nodes: DataFrame, ways: DataFrame, crossing_penalty: float = 8.0, cell_m: float = snap.CELL_M) -> Model:
    edges = written(graph.edges(nodes, ways))
    segments = written(graph.segments(edges))
    components = written(graph.node_components(nodes, edges))
    snaps = written(snap.snap(houses, nodes, edges, segments, cell_m))
    # only end nodes of edges that have a house are sources
    used = snaps.join(edges.select("area", "edge", "a", "b"), ["area", "edge"])
    sources = used.select("area", F.explode(F.array("a", "b")).alias("source")).distinct()
    metres = written(graph.dijkstra(edges, sources))
    dist = written(snap.house_distances(snaps, edges, metres, crossing_penalty))
    ref = houses.groupBy("area").agg(F.min_by(F.struct("lat", "lon"), "ord").alias("ref"))
    x, y = geo.project(F.col("lat"), F.col("lon"), F.col("ref.lat"), F.col("ref.lon"))
    xy = houses.join(ref, "area").select("area", "house_id", x.alias("x"), y.alias("y"))
    return Model(houses, edges, segments, components, snaps, dist, xy, snap.disconnected(snaps, edges, components))
