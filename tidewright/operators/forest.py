"""Spanning forests, their Euler tours, and what tours answer: intervals of subtrees, ancestors, paths.

Everything is a table, and no component is ever in one task. Rounds are joins
of narrow tables that are written to the shared folder; their number grows with
the logarithm of the network, long chains included. The driver sees counts.

Undirected edges are edges(edge, u, v), all longs, with edge unique and within
2**62 of zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.operators.components import components
from tidewright.storage import discarded, observed, written

#: Places of a tour that are one row of an index.
PIECE = 1024
#: Copies of each row of an upper index, so that many queries of one place are many keys.
SALTS = 32


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A merge join of two sides that both grow with the network; AQE can split hot keys."""
    return left.join(right.hint("merge"), on, how)


def _roots_of(pointers: DataFrame) -> DataFrame:
    """(c, root) of pointers(c, o): o is null at roots; pointers are doubled until all are at a root."""
    now = written(pointers.select("c", F.coalesce("o", "c").alias("o")), "pointers")
    while True:
        ahead = now.select(F.col("c").alias("o"), F.col("o").alias("further"))
        doubled = _joined(now, ahead, "o").select("c", F.col("further").alias("o"), (F.col("further") != F.col("o")).alias("moved"))
        after, seen = observed(doubled, "pointers", moved=F.count_if("moved"))
        discarded(now)
        now = after
        if not seen["moved"]:
            return after.select("c", F.col("o").alias("root"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, labels): tree(edge, u, v) joins what edges join, without a circle; labels(vertex, root) name parts by one of their vertices.

    Each round every part takes its least edge to another part, by a hash of the
    edge so that chains of parts that point to each other stay short, and parts
    that point to each other become one. Edges within a part go, and of those
    between two parts the least stays. Vertices without edges to others are
    left out.
    """
    live, seen = observed(edges.filter("u <> v").select("edge", "u", "v", F.col("u").alias("a"), F.col("v").alias("b"), F.xxhash64("edge").alias("w")), "live", n=F.count(F.lit(1)))
    chosen: list[DataFrame] = []
    maps: list[DataFrame] = []
    while seen["n"]:
        both = live.select(F.col("a").alias("c"), F.col("b").alias("o"), "w", "edge", "u", "v").union(live.select(F.col("b").alias("c"), F.col("a").alias("o"), "w", "edge", "u", "v"))
        taken = written(both.groupBy("c").agg(F.min(F.struct("w", "edge", "o", "u", "v")).alias("m")).select("c", "m.*"), "taken")
        chosen.append(written(taken.select("edge", "u", "v").distinct(), "tree"))
        back = taken.select(F.col("c").alias("o"), F.col("edge").alias("back"))
        mutual = (F.col("edge") == F.col("back")) & (F.col("c") < F.col("o"))
        roots = written(_roots_of(_joined(taken.select("c", "o", "edge"), back, "o").select("c", F.when(~mutual, F.col("o")).alias("o"))), "roots")
        maps.append(roots)
        moved = live
        for side in ("a", "b"):
            moved = _joined(moved, roots.select(F.col("c").alias(side), F.col("root").alias(f"{side}_root")), side).drop(side).withColumnRenamed(f"{side}_root", side)
        low, high = F.least("a", "b"), F.greatest("a", "b")
        fewer = moved.filter("a <> b").groupBy(low.alias("p"), high.alias("q")).agg(F.min(F.struct("w", "edge", "u", "v", "a", "b")).alias("m"))
        rest, seen = observed(fewer.select("m.edge", "m.u", "m.v", "m.a", "m.b", "m.w"), "live", n=F.count(F.lit(1)))
        discarded(live, taken)
        live = rest
    spark = edges.sparkSession
    if not chosen:
        return spark.createDataFrame([], "edge long, u long, v long"), spark.createDataFrame([], "vertex long, root long")
    labels = maps[-1].select(F.col("c").alias("vertex"), "root")
    for lower in reversed(maps[:-1]):
        above = labels.select(F.col("vertex").alias("root"), F.col("root").alias("top"))
        labels = _joined(lower.withColumnRenamed("c", "vertex"), above, "root", "left").select("vertex", F.coalesce("top", "root").alias("root"))
    tree = chosen[0]
    for more in chosen[1:]:
        tree = tree.union(more)
    tree, labels = written(tree, "tree"), written(labels, "labels")
    discarded(*chosen, *maps)
    return tree, labels


def _around(arcs: DataFrame) -> DataFrame:
    """(tail, edge, follow, last): the edge after each one around its tail, the first after the last; arcs(tail, edge).

    Rows are dealt by ranges of both columns, so a vertex of many edges is many
    tasks; the places where a vertex goes over to another range are mended by
    a row for each vertex and range.
    """
    dealt = written(arcs.repartitionByRange("tail", "edge").withColumn("part", F.spark_partition_id()), "around")
    near = Window.partitionBy("tail", "part").orderBy("edge")
    ranges = dealt.groupBy("tail", "part").agg(F.min("edge").alias("first"))
    along = Window.partitionBy("tail").orderBy("part")
    whole = Window.partitionBy("tail")
    ahead = ranges.select("tail", "part", F.lead("first").over(along).alias("ahead"), F.min("first").over(whole).alias("least"))
    stepped = dealt.withColumn("step", F.lead("edge").over(near))
    return _joined(stepped, ahead, ["tail", "part"]).select("tail", "edge", F.coalesce("step", "ahead", "least").alias("follow"), F.coalesce("step", "ahead").isNull().alias("last"))


def euler_tour(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """(root, edge, parent, child, opens, closes): places of each tree edge on the way down and back along its part's tour.

    A tour goes around every vertex from its root on; places end at 0, so they
    are negative, and what hangs below an edge is between its two places. An
    arc's place is its distance from the tour's end, found by doubling.
    """
    ends = tree.select("edge", F.col("u").alias("tail"), F.col("v").alias("head"), F.lit(0).alias("side")).union(tree.select("edge", F.col("v").alias("tail"), F.col("u").alias("head"), F.lit(1).alias("side")))
    arc = lambda edge, side: F.shiftleft(edge, 1) + side
    around = written(_around(ends.select("tail", "edge")), "around")
    sides = ends.select(F.col("tail").alias("at"), F.col("edge").alias("follow"), F.col("side").alias("next_side"))
    met = _joined(ends, around.select(F.col("tail").alias("head"), "edge", "follow", "last"), ["head", "edge"])
    met = _joined(met, labels.select(F.col("vertex").alias("head"), "root"), "head")
    ahead = _joined(met.withColumnRenamed("head", "at"), sides, ["at", "follow"])
    stops = F.col("last") & (F.col("at") == F.col("root"))
    first = ahead.select(arc(F.col("edge"), F.col("side")).alias("a"), F.when(~stops, arc(F.col("follow"), F.col("next_side"))).alias("to"), F.when(stops, F.lit(0)).otherwise(1).cast("long").alias("far"), "root")
    now, seen = observed(first, "tour", n=F.count("to"))
    discarded(around)
    while seen["n"]:
        further = now.select(F.col("a").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        doubled = _joined(now, further, "to", "left").select("a", F.col("next").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), "root")
        after, seen = observed(doubled, "tour", n=F.count("to"))
        discarded(now)
        now = after
    place = now.select(F.shiftright("a", 1).alias("edge"), F.pmod("a", F.lit(2)).alias("side"), (-F.col("far")).alias("place"), "root")
    by_edge = place.groupBy("edge").agg(F.min("place").alias("opens"), F.max("place").alias("closes"), F.min_by("side", "place").alias("side"), F.min("root").alias("root"))
    down = F.col("side") == 0
    tour = written(_joined(by_edge, tree, "edge").select("root", "edge", F.when(down, F.col("u")).otherwise(F.col("v")).alias("parent"), F.when(down, F.col("v")).otherwise(F.col("u")).alias("child"), "opens", "closes"), "euler")
    discarded(now)
    return tour


def numbered(tour: DataFrame) -> DataFrame:
    """(vertex, root, opens, closes): the interval of each vertex's subtree; a root's is around the whole tour."""
    roots = tour.groupBy("root").agg((F.min("opens") - 1).alias("opens")).select(F.col("root").alias("vertex"), "root", "opens", F.lit(1).cast("long").alias("closes"))
    return tour.select(F.col("child").alias("vertex"), "root", "opens", "closes").union(roots)


#: What an interval can be asked for: how one row's array gives it, and how parts of an answer go together.
_ASKED = {"min": (F.array_min, F.min), "max": (F.array_max, F.max), "sum": (lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + F.coalesce(x, F.lit(0).cast("long"))), F.sum)}


def over_intervals(values: DataFrame, queries: DataFrame, asked: dict[str, str]) -> DataFrame:
    """(id, <each of asked>): the min, max or sum of columns of values(root, place, ...) with place between opens and closes of queries(id, root, opens, closes).

    Places of a root are without gaps. Pieces of PIECE places are one row each,
    and an interval is two ends of pieces at most, and whole pieces between
    them, which are looked up in the same way one level up.
    """
    spread, level = queries.select("id", "root", F.col("opens").alias("i"), F.col("closes").alias("j")).filter("i <= j"), 0
    parts: DataFrame | None = None
    piece = lambda c: F.floor(F.col(c) / PIECE).cast("long")
    while True:
        rows = values.withColumn("piece", piece("place")).groupBy("root", "piece").agg(F.min("place").alias("from_place"), F.array_sort(F.collect_list(F.struct("place", *asked))).alias("held"))
        rows = written(rows, "pieces")
        alone = piece("i") == piece("j")
        end_of = (piece("i") + 1) * PIECE - 1
        left = F.struct(F.col("i"), F.when(alone, F.col("j")).otherwise(end_of).alias("j"))
        right = F.struct(F.when(alone, None).otherwise(piece("j") * PIECE).alias("i"), F.col("j"))
        asks = spread.select("id", "root", F.explode(F.array(left, right)).alias("x")).select("id", "root", "x.i", "x.j").filter("i is not null").withColumn("piece", piece("i"))
        on = ["root", "piece"]
        index = rows
        if level:
            asks = asks.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
            index = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            on = [*on, "salt"]
        met = _joined(asks, index, on)
        inside = lambda c: F.slice(F.col("held")[c], (F.col("i") - F.col("from_place") + 1).cast("int"), (F.col("j") - F.col("i") + 1).cast("int"))
        answers = met.select("id", *[_ASKED[how][0](inside(c)).alias(c) for c, how in asked.items()])
        parts = answers if parts is None else parts.union(answers)
        middle = spread.select("id", "root", (piece("i") + 1).alias("i"), (piece("j") - 1).alias("j")).filter("i <= j")
        middle, seen = observed(middle, "middle", n=F.count(F.lit(1)))
        if not seen["n"]:
            return parts.groupBy("id").agg(*[_ASKED[how][1](c).alias(c) for c, how in asked.items()])
        values = rows.select("root", F.col("piece").alias("place"), *[_ASKED[how][0](F.col("held")[c]).alias(c) for c, how in asked.items()])
        spread, level = middle, level + 1


def along_tour(tour: DataFrame, at_vertices: DataFrame, columns: dict[str, str]) -> DataFrame:
    """values for over_intervals(): columns of at_vertices(vertex, ...) where a tour comes down to the vertex, null where it goes back."""
    down = _joined(tour.select("root", F.col("opens").alias("place"), F.col("child").alias("vertex")), at_vertices, "vertex", "left").select("root", "place", *columns)
    return down.unionByName(tour.select("root", F.col("closes").alias("place"), *[F.lit(None).cast("long").alias(c) for c in columns]))


def subtrees(tour: DataFrame, at_vertices: DataFrame, asked: dict[str, str]) -> DataFrame:
    """(child, <each of asked>) of at_vertices(vertex, ...) over all vertices below each tree edge, its child included."""
    queries = tour.select(F.col("child").alias("id"), "root", "opens", "closes")
    return over_intervals(along_tour(tour, at_vertices, asked), queries, asked).withColumnRenamed("id", "child")


def beyond_tree(edges: DataFrame, tree: DataFrame, places: DataFrame) -> DataFrame:
    """(edge, x, y, and opens and closes of both): edges between different vertices that aren't in tree; x opens first."""
    rest = edges.filter("u <> v").join(tree.select("edge"), "edge", "left_anti")
    for side in ("u", "v"):
        rest = _joined(rest, places.select(F.col("vertex").alias(side), F.col("opens").alias(f"o_{side}"), F.col("closes").alias(f"c_{side}")), side)
    turned = F.col("o_u") > F.col("o_v")
    pick = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    return rest.select("edge", pick("u", "v", "x"), pick("v", "u", "y"), pick("o_u", "o_v", "opens_x"), pick("c_u", "c_v", "closes_x"), pick("o_v", "o_u", "opens_y"), pick("c_v", "c_u", "closes_y"))


def ancestors(tour: DataFrame) -> list[DataFrame]:
    """Tables (vertex, up): the ancestor 2**k steps up, for k from 0 on, of vertices that have one; opens and closes are those of up."""
    table = written(tour.select(F.col("child").alias("vertex"), F.col("parent").alias("up")), "ancestors")
    out = [table]
    while True:
        ahead = out[-1].select(F.col("vertex").alias("up"), F.col("up").alias("further"))
        after = written(_joined(out[-1], ahead, "up").select("vertex", F.col("further").alias("up")), "ancestors")
        if after.isEmpty():
            discarded(after)
            return out
        out.append(after)


def fundamental_cycles(edges: DataFrame) -> DataFrame:
    """(cycle, edge): for each edge beyond a spanning forest, that edge, which names the cycle, and the tree's way back.

    From both ends, jumps of ancestors that halve in length find how far below
    the lowest common ancestor each is; the way up is then cut in halves until
    each row is one tree edge. A self-loop is a cycle of its own.
    """
    tree, labels = spanning_forest(edges)
    loops = edges.filter("u = v").select(F.col("edge").alias("cycle"), "edge")
    if tree.isEmpty():
        return loops
    tour = euler_tour(tree, labels)
    places = written(numbered(tour), "places")
    extra = written(beyond_tree(edges, tree, places), "beyond")
    up = ancestors(tour)
    climbing = extra.select(F.col("edge").alias("cycle"), F.col("x").alias("v"), F.col("opens_y").alias("other"), (F.col("closes_x") < F.col("opens_y")).alias("apart")).union(extra.select("edge", "y", "opens_x", F.lit(True)))
    now = written(climbing.filter("apart").select("cycle", F.col("v").alias("start"), "v", "other", F.lit(0).cast("long").alias("steps")), "climb")
    for k in range(len(up) - 1, -1, -1):
        reach = _joined(up[k], places.select(F.col("vertex").alias("up"), "opens", "closes"), "up").withColumnRenamed("vertex", "v")
        jump = F.col("up").isNotNull() & ~F.col("other").between(F.col("opens"), F.col("closes"))
        after = written(_joined(now, reach, "v", "left").select("cycle", "start", F.when(jump, F.col("up")).otherwise(F.col("v")).alias("v"), "other", (F.col("steps") + F.when(jump, 1 << k).otherwise(0)).alias("steps")), "climb")
        discarded(now)
        now = after
    way = written(now.select("cycle", F.col("start").alias("v"), (F.col("steps") + 1).alias("n")), "way")
    discarded(now)
    for k in range(len(up) - 1, -1, -1):
        long = way.filter(F.col("n") > (1 << k))
        upper = _joined(long, up[k].withColumnRenamed("vertex", "v"), "v").select("cycle", F.col("up").alias("v"), (F.col("n") - (1 << k)).alias("n"))
        after = written(way.select("cycle", "v", F.least(F.col("n"), F.lit(1 << k)).cast("long").alias("n")).union(upper), "way")
        discarded(way)
        way = after
    steps = _joined(way.select("cycle", "v"), tour.select(F.col("child").alias("v"), "edge"), "v").select("cycle", "edge")
    return steps.union(extra.select(F.col("edge").alias("cycle"), "edge")).union(loops)


def nested_cycles(cycles: DataFrame) -> DataFrame:
    """(edge, nest) of fundamental_cycles(): cycles that share an edge, directly or through others, are one nest, named by its smallest edge.

    Two such cycles meet along one path of the tree, so they share two vertices
    or more if they share an edge.
    """
    rooted = components(cycles.select(F.col("cycle").alias("u"), F.col("edge").alias("v")))
    edges = cycles.select("edge").distinct()
    return _joined(edges, rooted.withColumnRenamed("node", "edge"), "edge", "left").select("edge", F.coalesce("root", "edge").alias("nest"))
