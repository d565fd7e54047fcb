"""Biconnected blocks, bridges and cut vertices of networks of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import forest
from tidewright.operators.components import components
from tidewright.storage import discarded, written


def biconnected(edges: list[tuple[int, int, int]]) -> list[list[int]]:
    """Blocks as lists of edge ids of edges (id, u, v), by depth-first search with low points and a stack of edges, without recursion; a self-loop is in no block."""
    near: dict[int, list[tuple[int, int]]] = {}
    for e, u, v in edges:
        if u != v:
            near.setdefault(u, []).append((e, v))
            near.setdefault(v, []).append((e, u))
    depth: dict[int, int] = {}
    low: dict[int, int] = {}
    blocks: list[list[int]] = []
    for root in sorted(near):
        if root in depth:
            continue
        depth[root] = low[root] = 0
        held: list[int] = []
        place: dict[int, int] = {}
        path = [(root, -1, iter(near[root]))]
        while path:
            v, came, ways = path[-1]
            for e, w in ways:
                if e == came:
                    continue
                if w not in depth:
                    depth[w] = low[w] = depth[v] + 1
                    place[e] = len(held)
                    held.append(e)
                    path.append((w, e, iter(near[w])))
                    break
                if depth[w] < depth[v]:
                    held.append(e)
                    low[v] = min(low[v], depth[w])
            else:
                path.pop()
                if path:
                    u = path[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= depth[u]:
                        cut = place[came]
                        blocks.append(sorted(held[cut:]))
                        del held[cut:]
    return blocks


def blocks(edges: DataFrame) -> DataFrame:
    """(edge, from_v, to_v, block, is_bridge) of two-sided edges; a block is named by its smallest edge, a self-loop is in none.

    A tree edge of a spanning forest is named by its lower end. It is in one
    block with the edge above it if an edge beyond the tree leads from below it
    to outside of what hangs below that one, and with another branch's edge if
    an edge beyond the tree joins their lower ends. What is joined so, directly
    or by others, is a block, and an edge beyond the tree is in that of its end
    that the tour reaches later. So blocks are components of a graph with a row
    for each edge at most; no component of the network is one task.
    """
    two = edges.filter("from_v is not null and to_v is not null").select(F.col("edge").cast("long").alias("edge"), F.col("from_v").cast("long").alias("u"), F.col("to_v").cast("long").alias("v"))
    two = written(two, "two-sided")
    tree, labels = forest.spanning_forest(two)
    if tree.isEmpty():
        return two.limit(0).select("edge", F.col("u").alias("from_v"), F.col("v").alias("to_v"), F.col("edge").alias("block"), F.lit(True).alias("is_bridge"))
    tour = forest.euler_tour(tree, labels)
    places = written(forest.numbered(tour), "places")
    extra = written(forest.beyond_tree(two, tree, places), "beyond")
    reached = extra.select(F.col("x").alias("vertex"), F.col("opens_y").alias("p")).union(extra.select("y", "opens_x"))
    reached = reached.groupBy("vertex").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    below = forest.subtrees(tour, reached, {"lo": "min", "hi": "max"})
    upper = tour.select(F.col("child").alias("parent"), F.col("opens").alias("opens_p"), F.col("closes").alias("closes_p"))
    hung = tour.select("child", "parent").join(below.hint("merge"), "child").join(upper.hint("merge"), "parent")
    joined = hung.filter("lo < opens_p or hi > closes_p").select(F.col("child").alias("u"), F.col("parent").alias("v"))
    links = written(joined.union(extra.filter("closes_x < opens_y").select("x", "y")), "block-links")
    named = components(links)
    ends = tour.select("edge", F.col("child").alias("node")).union(extra.select("edge", "y"))
    labelled = written(ends.join(named.hint("merge"), "node", "left").select("edge", F.coalesce("root", "node").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("edge").alias("block"), F.count(F.lit(1)).alias("n"))
    found = labelled.join(least.hint("merge"), "label").select("edge", "block", (F.col("n") == 1).alias("is_bridge"))
    found = written(found.join(two.hint("merge"), "edge").select("edge", F.col("u").alias("from_v"), F.col("v").alias("to_v"), "block", "is_bridge"), "blocks")
    discarded(two, tree, labels, tour, places, extra, links, labelled)
    return found


def cut_vertices(blocked: DataFrame) -> DataFrame:
    """(vertex, n_blocks): vertices of two blocks or more."""
    ends = blocked.select("block", F.explode(F.array("from_v", "to_v")).alias("vertex")).distinct()
    return ends.groupBy("vertex").agg(F.count(F.lit(1)).alias("n_blocks")).filter("n_blocks > 1")


def turned_by_flow(cuts: DataFrame) -> DataFrame:
    """cuts(block, vertex, is_sink, flow) with negative flows made positive by turning their side."""
    back = F.col("flow") < 0
    return cuts.withColumn("is_sink", F.when(back, ~F.col("is_sink")).otherwise(F.col("is_sink"))).withColumn("flow", F.abs("flow"))
