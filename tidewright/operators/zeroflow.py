"""Which parts of a network carry flow: closed objects cut it, and known zeros spread by balance.

Tables throughout. An edge without flow is resting; that rest spreads to the
last edge of each vertex all whose others rest. What is left after that isn't
found by peeling but by counting: an anchor is a one-sided edge that may flow
or an end of an edge beyond a spanning forest, and a tree edge flows if there
are anchors on both of its sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import forest, graph
from tidewright.operators.components import components
from tidewright.storage import discarded, written


def _parts(edges: list[tuple]) -> list[tuple[list, list]]:
    """Connected parts of (edge, from_v, to_v) as edges and vertices, in order of their smallest vertex."""
    root: dict = {}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for _, a, b in edges:
        for v in (a, b):
            if v is not None:
                root.setdefault(v, v)
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups: dict = {}
    for e, a, b in edges:
        groups.setdefault(find(a if a is not None else b), ([], set()))[0].append(e)
        groups[find(a if a is not None else b)][1].update(v for v in (a, b) if v is not None)
    return [(g[0], sorted(g[1])) for _, g in sorted(groups.items())]


def pieces(edges: DataFrame) -> DataFrame:
    """(edge, half, from_v, to_v, is_resting) of edges(edge, from_v, to_v, is_closed, is_resting).

    A closed two-sided edge becomes a sink and a source at rest, a closed
    one-sided one goes. Null flags are false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    long = [F.col(c).cast("long").alias(c) for c in ("edge", "from_v", "to_v")]
    kept = edges.select(*long, flag("is_closed").alias("is_closed"), flag("is_resting").alias("is_resting")).filter("not is_closed or (from_v is not null and to_v is not null)")
    return graph.cut_apart(kept, F.col("is_closed")).select("edge", "half", "from_v", "to_v", (F.col("is_resting") | F.col("is_closed")).alias("is_resting"))


def spread_rest(cut: DataFrame) -> DataFrame:
    """cut(edge, half, from_v, to_v, is_resting) with is_zero: what rests, and what balances say must rest then.

    Edges at rest are taken out first; edges that are left have different ids.
    A tree edge rests if one of its sides has no anchor, an edge beyond the tree
    never does, and a one-sided edge or a self-loop does if it is the only anchor of its part.
    """
    live = written(cut.filter("not is_resting"), "live")
    inner = F.col("from_v").isNotNull() & F.col("to_v").isNotNull() & (F.col("from_v") != F.col("to_v"))
    two = live.filter(inner).select("edge", F.col("from_v").alias("u"), F.col("to_v").alias("v"))
    single = live.filter(~F.coalesce(inner, F.lit(False))).select("edge", F.coalesce("from_v", "to_v").alias("vertex"))
    tree, labels = forest.spanning_forest(two)
    tour = forest.euler_tour(tree, labels)
    extra = forest.beyond_tree(two, tree, forest.numbered(tour))
    ends = single.select("vertex").union(extra.select("x")).union(extra.select("y"))
    anchors = written(ends.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")), "anchors")
    rooted = anchors.join(labels.hint("merge"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    totals = written(rooted.groupBy("root").agg(F.sum("n").alias("total")), "totals")
    below = forest.subtrees(tour, anchors, {"n": "sum"})
    hung = tour.select("edge", "child", "root").join(below.hint("merge"), "child").join(totals.hint("merge"), "root", "left")
    still = hung.filter("n = 0 or n = coalesce(total, 0)").select("edge")
    alone = single.join(labels.hint("merge"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex")).join(totals.filter("total = 1").hint("merge"), "root", "left_semi").select("edge")
    zero = written(still.union(alone).select(F.col("edge").alias("zero")), "zero")
    marked = cut.join(zero.hint("merge"), (F.col("edge") == F.col("zero")) & ~F.col("is_resting"), "left")
    out = written(marked.select("edge", "half", "from_v", "to_v", "is_resting", (F.col("is_resting") | F.col("zero").isNotNull()).alias("is_zero")), "rest")
    discarded(live, tree, labels, tour, anchors, totals, zero)
    return out


def split(edges: DataFrame, least_sources: int = 2) -> DataFrame:
    """(edge, half, from_v, to_v, is_zero, part, is_flow): connected parts of what moves, and of what rests, of edges as pieces() takes them.

    A part is named by its smallest vertex and is_zero. It carries flow if it
    moves and has at least so many one-sided edges: 2 for transport, 1 for
    hydraulics.
    """
    found = spread_rest(pieces(edges))
    both = found.filter("from_v is not null and to_v is not null")
    named = None
    for state in (False, True):
        links = written(both.filter(F.col("is_zero") == state).select(F.col("from_v").alias("u"), F.col("to_v").alias("v")), "part-links")
        rooted = components(links).select(F.lit(state).alias("of"), "node", "root")
        named = rooted if named is None else named.union(rooted)
    at = F.coalesce("from_v", "to_v")
    placed = found.withColumn("at", at).join(named.hint("merge"), (F.col("at") == F.col("node")) & (F.col("is_zero") == F.col("of")), "left")
    placed = written(placed.select("edge", "half", "from_v", "to_v", "is_zero", F.coalesce("root", "at").alias("part")), "placed")
    one = F.count_if(F.col("from_v").isNull() | F.col("to_v").isNull())
    flowing = placed.filter("not is_zero").groupBy("part").agg((one >= least_sources).alias("is_flow")).select(F.col("part").alias("p"), F.lit(False).alias("z"), "is_flow")
    return placed.join(flowing.hint("merge"), (F.col("part") == F.col("p")) & (F.col("is_zero") == F.col("z")), "left").select("edge", "half", "from_v", "to_v", "is_zero", "part", F.coalesce("is_flow", F.lit(False)).alias("is_flow"))


def part_vertices(parts: DataFrame) -> DataFrame:
    """(is_zero, part, is_flow, vertex) of split()."""
    ends = F.explode(F.array("from_v", "to_v"))
    return parts.select("is_zero", "part", "is_flow", ends.alias("vertex")).filter("vertex is not null").distinct()


def common_vertices(parts: DataFrame) -> DataFrame:
    """(is_zero, part, n, vertex) of parts without flow: how many vertices they share with parts that carry flow, and the one if it is one."""
    at = part_vertices(parts)
    flowing = at.filter("is_flow").select("vertex").distinct().withColumn("met", F.lit(True))
    met = at.filter("not is_flow").join(flowing.hint("merge"), "vertex", "left")
    counted = met.groupBy("is_zero", "part").agg(F.count("met").alias("n"), F.min(F.when(F.col("met"), F.col("vertex"))).alias("least"))
    return counted.select("is_zero", "part", "n", F.when(F.col("n") == 1, F.col("least")).alias("vertex"))


def members(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): members(subgraph, local, vertex, is_flow) and members(subgraph, local, edge, half, from_local, to_local) of split().

    Subgraphs are numbered from 0, those with flow first, and so are the
    vertices and edges of each, in order. Numbers come by ranges, so that no task sees all of
    them. Both maps are in the first: graph.descended() goes down it, graph.ascended() up.
    """
    key = F.struct((~F.col("is_flow")).alias("rest"), "is_zero", "part")
    keyed = written(parts.select(key.alias("key"), "is_flow", "edge", "half", "from_v", "to_v"), "keyed")
    numbers = written(graph.renumbered(keyed, "key", "subgraph"), "subgraphs")
    placed = written(keyed.join(numbers.hint("merge"), "key").drop("key"), "placed")
    at = placed.select("subgraph", "is_flow", F.explode(F.array("from_v", "to_v")).alias("vertex")).filter("vertex is not null").distinct()
    vertices = written(_local(at, "vertex").select("subgraph", "local", "vertex", "is_flow"), "members")
    edges = _local(placed, "edge", "half")
    for side in ("from", "to"):
        end = vertices.select(F.col("subgraph").alias("s"), F.col("vertex").alias("w"), F.col("local").alias(f"{side}_local"))
        edges = edges.join(end.hint("merge"), (F.col("subgraph") == F.col("s")) & (F.col(f"{side}_v") == F.col("w")), "left").drop("s", "w")
    return vertices, edges.select("subgraph", "local", "edge", "half", "from_local", "to_local")


def _local(rows: DataFrame, *names: str) -> DataFrame:
    """rows(subgraph, ...) with local: their number within the subgraph by names."""
    place = F.struct("subgraph", *names)
    dense = written(graph.renumbered(rows.select(place.alias("place")), "place", "n"), "dense")
    first = dense.groupBy(F.col("place.subgraph").alias("s")).agg(F.min("n").alias("least"))
    local = dense.join(first.hint("merge"), F.col("place.subgraph") == F.col("s")).select("place", (F.col("n") - F.col("least")).alias("local"))
    return rows.withColumn("place", place).join(local.hint("merge"), "place").drop("place")


def split_again(parts: DataFrame, closed: Column, least_sources: int = 2) -> DataFrame:
    """split() of each part by itself, once more cut at the edges that closed holds for: parts(...) with outer, outer_zero and outer_half beside the new columns.

    Pieces and vertices of different parts get numbers of their own, so one pass
    splits all parts; the numbers are turned back into edges and vertices.
    """
    whole = written(parts.select("*", F.struct("edge", "half").alias("piece"), closed.alias("is_closed")), "outer")
    pieces_of = written(graph.renumbered(whole, "piece", "id"), "piece-ids")
    at = whole.select(F.explode(F.array(F.struct("is_zero", "part", F.col("from_v").alias("vertex")), F.struct("is_zero", "part", F.col("to_v").alias("vertex")))).alias("place")).filter("place.vertex is not null")
    places = written(graph.renumbered(at, "place", "w"), "place-ids")
    inner = whole.join(pieces_of.hint("merge"), "piece")
    for side in ("from", "to"):
        key = places.select("place", F.col("w").alias(f"{side}_w"))
        inner = inner.withColumn("key", F.struct("is_zero", "part", F.col(f"{side}_v").alias("vertex"))).join(key.hint("merge"), F.col("key") == F.col("place"), "left").drop("key", "place")
    again = split(inner.select(F.col("id").alias("edge"), F.col("from_w").alias("from_v"), F.col("to_w").alias("to_v"), "is_closed", F.col("is_zero").alias("is_resting")), least_sources)
    outer = whole.select("piece", F.col("is_zero").alias("outer_zero"), F.col("part").alias("outer"))
    back = again.withColumnRenamed("edge", "id").join(pieces_of.hint("merge"), "id").join(outer.hint("merge"), "piece")
    for name in ("from_v", "to_v", "part"):
        named = places.select(F.col("w").alias(name), F.col("place.vertex").alias("named"))
        back = back.join(named.hint("merge"), name, "left").drop(name).withColumnRenamed("named", name)
    return back.select("outer_zero", "outer", F.col("piece.edge").alias("edge"), F.col("piece.half").alias("outer_half"), "half", "from_v", "to_v", "is_zero", "part", "is_flow")
