"""Graph operators on edges(edge, from_v, to_v); a null end makes an edge one-sided.

Iterations over large networks are driver loops whose every round is a join of
narrow tables that is written to the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.operators.components import components as _star_components
from tidewright.storage import discarded, observed, written


def ends(edges: DataFrame) -> DataFrame:
    """(vertex, edge, incidence): -1 where an edge leaves a vertex, +1 where it enters one; a sparse incidence matrix."""
    pairs = F.array(F.struct(F.col("from_v").alias("vertex"), F.lit(-1).alias("incidence")), F.struct(F.col("to_v").alias("vertex"), F.lit(1).alias("incidence")))
    return edges.select("edge", F.inline(pairs)).filter("vertex is not null").select("vertex", "edge", "incidence")


def vertices(edges: DataFrame) -> DataFrame:
    return ends(edges).select("vertex").distinct()


def incidences(edges: DataFrame) -> DataFrame:
    """(vertex, inlets, outlets): sorted edge lists of each vertex."""
    return ends(edges).groupBy("vertex").agg(
        F.array_sort(F.collect_list(F.when(F.col("incidence") == 1, F.col("edge")))).alias("inlets"), F.array_sort(F.collect_list(F.when(F.col("incidence") == -1, F.col("edge")))).alias("outlets")
    )


def degrees(edges: DataFrame, at_least: int = 0) -> DataFrame:
    return ends(edges).groupBy("vertex").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") >= at_least)


def source_vertices(edges: DataFrame) -> DataFrame:
    """Vertices that no two-sided edge enters."""
    two = edges.filter("from_v is not null and to_v is not null")
    return vertices(two).join(two.select(F.col("to_v").alias("vertex")), "vertex", "left_anti")


def sink_vertices(edges: DataFrame) -> DataFrame:
    """Vertices that no two-sided edge leaves."""
    two = edges.filter("from_v is not null and to_v is not null")
    return vertices(two).join(two.select(F.col("from_v").alias("vertex")), "vertex", "left_anti")


def split_incidences(edges: DataFrame, first_given: int) -> DataFrame:
    """ends() with part reduced (vertices below first_given) or given (the others, counted from 0)."""
    given = F.col("vertex") >= first_given
    return ends(edges).select("edge", "incidence", F.when(given, "given").otherwise("reduced").alias("part"), F.when(given, F.col("vertex") - first_given).otherwise(F.col("vertex")).alias("row"))


def oriented(edges: DataFrame, flow: str = "flow") -> DataFrame:
    """edges turned so that no flow is negative."""
    back = F.col(flow) < 0
    return edges.select(*[c for c in edges.columns if c not in ("from_v", "to_v", flow)], F.when(back, F.col("to_v")).otherwise(F.col("from_v")).alias("from_v"), F.when(back, F.col("from_v")).otherwise(F.col("to_v")).alias("to_v"), F.abs(flow).alias(flow))


def components(edges: DataFrame, keep: Column | None = None) -> DataFrame:
    """(vertex, component): connected parts of the graph of the edges that keep allows; isolated vertices are parts of their own."""
    allowed = edges if keep is None else edges.filter(keep)
    rooted = _star_components(allowed.filter("from_v is not null and to_v is not null").select(F.col("from_v").cast("long").alias("u"), F.col("to_v").cast("long").alias("v")))
    return vertices(edges).join(rooted.withColumnRenamed("node", "vertex"), "vertex", "left").select("vertex", F.coalesce("root", F.col("vertex").cast("long")).alias("component"))


def quotient(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges between different labels, with from_label and to_label, of labels(vertex, label)."""
    a = labels.select(F.col("vertex").alias("from_v"), F.col("label").alias("from_label"))
    b = labels.select(F.col("vertex").alias("to_v"), F.col("label").alias("to_label"))
    return edges.join(a, "from_v").join(b, "to_v").filter("from_label <> to_label")


def induced(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Two-sided edges with both ends in inside(vertex)."""
    return edges.join(inside.select(F.col("vertex").alias("from_v")), "from_v", "left_semi").join(inside.select(F.col("vertex").alias("to_v")), "to_v", "left_semi").select(edges.columns)


def boundary(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges with exactly one end in inside(vertex); inside_v is that end."""
    mark = inside.select(F.col("vertex"), F.lit(True).alias("in")).distinct()
    a = mark.select(F.col("vertex").alias("from_v"), F.col("in").alias("a"))
    b = mark.select(F.col("vertex").alias("to_v"), F.col("in").alias("b"))
    flagged = edges.join(a, "from_v", "left").join(b, "to_v", "left")
    return flagged.filter(F.coalesce("a", F.lit(False)) != F.coalesce("b", F.lit(False))).withColumn("inside_v", F.when(F.col("a"), F.col("from_v")).otherwise(F.col("to_v"))).drop("a", "b")


def hops(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(vertex, rank, before): least number of edges, in either direction, from starts(vertex), and the smallest neighbour one step nearer."""
    both = edges.select(F.col("from_v").alias("u"), F.col("to_v").alias("v")).unionByName(edges.select(F.col("to_v").alias("u"), F.col("from_v").alias("v"))).filter("u is not null and v is not null and u <> v").distinct()
    both = written(both, "hops")
    layers = Layers(written(starts.select("vertex").distinct().select("vertex", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("before")), "hops"))
    rank = 0
    while True:
        rank += 1
        near = both.join(layers.last.select(F.col("vertex").alias("u")), "u").groupBy(F.col("v").alias("vertex")).agg(F.min("u").cast("long").alias("before"))
        for known in layers.latest:  # a neighbour of one layer is in it or in those beside it
            near = near.join(known.select("vertex"), "vertex", "left_anti")
        fresh = written(near.select("vertex", F.lit(rank).alias("rank"), "before"), "hops")
        if fresh.isEmpty():
            return layers.all()
        layers.add(fresh)


class Layers:
    """Tables that rounds add one by one; every few of them are written as one, so that the union stays short."""

    def __init__(self, first: DataFrame, every: int = 16) -> None:
        self.done: list[DataFrame] = []
        self.open = [first]
        self.every = every
        self.latest = [first]

    @property
    def last(self) -> DataFrame:
        return self.latest[-1]

    def add(self, layer: DataFrame) -> None:
        self.open.append(layer)
        self.latest = [self.latest[-1], layer]
        if len(self.open) >= self.every:
            self.done.append(written(self._union(self.open), "layers"))
            self.open = []
            if len(self.done) >= self.every:
                self.done = [written(self._union(self.done), "layers")]

    def all(self) -> DataFrame:
        return self._union(self.done + self.open)

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _hung_up(single: DataFrame) -> DataFrame:
    """(v, u, a, b): for each v of single(v, u, a, b), the vertex where its chain of single edges begins, and the map x -> max(x + a, b) along it.

    Maps of this kind give one of this kind again, so chains are doubled:
    their number of rounds is the logarithm of the longest. Raises if a chain
    never ends.
    """
    now = written(single.select("v", "u", "a", "b"), "chains")
    longest, rounds = now.count(), 0
    while True:
        above = now.select(F.col("v").alias("u"), F.col("u").alias("u2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        met = now.join(above.hint("merge"), "u", "left")
        after, seen = observed(
            met.select("v", F.coalesce("u2", "u").alias("u"), (F.col("a") + F.coalesce("a2", F.lit(0))).alias("a"), F.when(F.col("u2").isNull(), F.col("b")).otherwise(F.greatest(F.col("b2") + F.col("a"), F.col("b"))).alias("b"), F.col("u2").isNotNull().alias("moved")),
            "chains",
            moved=F.count_if("moved"),
        )
        discarded(now)
        now, rounds = after, rounds + 1
        if not seen["moved"]:
            return after.drop("moved")
        if 1 << rounds > 2 * longest:
            raise ValueError("the graph has a cycle")


def levels(edges: DataFrame) -> DataFrame:
    """(vertex, level): 0 for vertices that no edge enters, else one more than the highest level before; raises on cycles.

    The level of a vertex is max(x + a, b) of the level x before it, for each
    edge that is left. Each round, vertices with one edge left hang on where
    their chain begins, by doubling, and hand that on to the vertices after
    them; edges from one vertex to another become one; and what hangs on a vertex whose
    level is known leaves. So a chain or a tree of any length takes as many rounds
    as its length has digits in base two, and a network as many as what is left
    of it when chains are single edges has levels.
    """
    kind = edges.schema["from_v"].dataType
    live = edges.filter("from_v is not null and to_v is not null").select(F.col("from_v").alias("u"), F.col("to_v").alias("v"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    counts = {"n": F.count(F.lit(1)), "loops": F.count_if(F.col("u") == F.col("v"))}
    live, seen = observed(live, "level-edges", **counts)
    if seen["loops"]:
        raise ValueError("the graph has a cycle")
    entered = live.select(F.col("v").alias("vertex")).distinct()
    known = written(vertices(edges).join(entered.hint("merge"), "vertex", "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    layers = Layers(known)
    hanging: list[DataFrame] = []
    while seen["n"]:
        many = live.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("v").alias("w"))
        single = live.join(many.hint("merge"), F.col("v") == F.col("w"), "left_anti")
        hung = written(_hung_up(single), "hung")
        if hung.isEmpty():
            raise ValueError("the graph has a cycle")
        hanging.append(hung)
        above = hung.select(F.col("v").alias("u"), F.col("u").alias("top"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        rest = live.join(many.hint("merge"), F.col("v") == F.col("w"), "left_semi").join(above.hint("merge"), "u", "left")
        moved = rest.select(F.coalesce("top", "u").alias("u"), "v", (F.col("a") + F.coalesce("a2", F.lit(0))).alias("a"), F.when(F.col("top").isNull(), F.col("b")).otherwise(F.greatest(F.col("b2") + F.col("a"), F.col("b"))).alias("b"))
        joined = moved.groupBy("u", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        joined, seen = observed(_met_by_known(joined, layers.all()), "level-edges", **counts)
        if seen["loops"]:
            raise ValueError("the graph has a cycle")
        discarded(live)
        live = joined
    for hung in reversed(hanging):
        tops = layers.all().select(F.col("vertex").alias("u"), "level")
        layers.add(written(hung.join(tops.hint("merge"), "u").select(F.col("v").alias("vertex"), F.greatest(F.col("level") + F.col("a"), F.col("b")).alias("level")), "levels"))
    return layers.all().select(F.col("vertex").cast(kind).alias("vertex"), F.col("level").cast("int").alias("level"))


def _met_by_known(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges(u, v, a, b) with all that come to a vertex from known(vertex, level) ones made one, from one of them."""
    met = edges.join(known.select(F.col("vertex").alias("u"), "level").hint("merge"), "u", "left")
    sure = met.filter("level is not null").groupBy("v").agg(F.min_by(F.struct("u", "level"), "u").alias("m"), F.max(F.greatest(F.col("level") + F.col("a"), F.col("b"))).alias("least"))
    at_least = sure.select("m.u", "v", F.lit(0).cast("long").alias("a"), F.greatest(F.col("least"), F.col("m.level")).alias("b"))
    return met.filter("level is null").select("u", "v", "a", "b").unionByName(at_least)


def cut_apart(edges: DataFrame, splittable: Column) -> DataFrame:
    """edges with each splittable one cut into a sink half and a source half, both at rest."""
    whole = edges.filter(~splittable).withColumn("half", F.lit("whole"))
    cut = edges.filter(splittable)
    none = F.lit(None).cast(edges.schema["from_v"].dataType)
    sink = cut.withColumn("to_v", none).withColumn("half", F.lit("sink"))
    source = cut.withColumn("from_v", none).withColumn("half", F.lit("source"))
    return whole.unionByName(sink).unionByName(source)


def renumbered(items: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): dense numbers from 0 in order, by ranges: no task sees all of them."""
    distinct = items.select(column).distinct()
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(distinct.repartitionByRange(parts, column).withColumn("part", F.spark_partition_id()), "numbers")
    before, at = {}, 0
    for r in sorted(ranged.groupBy("part").count().collect()):
        before[r["part"]], at = at, at + r["count"]
    offset = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])
    return ranged.select(column, (F.try_element_at(offset, F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1).cast("long").alias(name))


def jumpers_collapsed(jumpers: DataFrame) -> DataFrame:
    """(port, vertex): ports that jumpers(u, v) connect are one vertex; vertices are numbered from 0 by their smallest port."""
    rooted = _star_components(jumpers.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    ports = jumpers.select(F.col("u").cast("long").alias("node")).union(jumpers.select(F.col("v").cast("long"))).distinct()
    full = ports.join(rooted, "node", "left").select(F.col("node").alias("port"), F.coalesce("root", "node").alias("root"))
    return full.join(renumbered(full, "root", "vertex"), "root").select("port", "vertex")


def descended(places: DataFrame, members: DataFrame) -> DataFrame:
    """places(vertex, ...) for each subgraph that has them, with local: members(subgraph, local, vertex)."""
    return places.join(members, "vertex")


def ascended(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows(subgraph, local, ...) with their vertex; raises where a row has none."""
    found = rows.join(members, ["subgraph", "local"], "left")
    return found.withColumn("vertex", F.when(F.col("vertex").isNull(), F.raise_error(F.lit("a place of a subgraph has no vertex")).cast(members.schema["vertex"].dataType)).otherwise(F.col("vertex")))
