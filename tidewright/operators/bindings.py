"""Bindings of places to subgraphs, blocks, names and positions, and counts over them.

Membership tables have a row for each place: members(subgraph, vertex, local),
blocked(edge, from_v, to_v, block, is_bridge) as operators.blocks gives them,
measurements(binding_type, place, ...) with binding_type vertex, edge1 or edge2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import graph


def _fail(text: str, *parts, kind: str = "boolean") -> Column:
    return F.raise_error(F.concat(F.lit(text), *[F.col(p).cast("string") for p in parts])).cast(kind)


def descended_once(places: DataFrame, members: DataFrame, key: str = "vertex") -> DataFrame:
    """places(key, ...) in the one subgraph that each has in members(subgraph, key, local); none or several raise."""
    counted = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("subgraph").alias("subgraph"), F.first("local").alias("local"))
    found = places.join(counted, key, "left")
    kind = members.schema["subgraph"].dataType.simpleString()
    one = F.when(F.coalesce("n", F.lit(0)) == 1, F.col("subgraph")).otherwise(_fail("not in exactly one subgraph: ", key, kind=kind))
    return found.withColumn("subgraph", one).drop("n")


def rebound(measurements: DataFrame, members: DataFrame) -> DataFrame:
    """measurements(binding_type, place, ...) in every subgraph that has their place: members(subgraph, binding_type, place, local)."""
    return measurements.join(members, ["binding_type", "place"])


def rebound_to_flow(measurements: DataFrame, members: DataFrame, flowing: DataFrame) -> DataFrame:
    """Measurements bound to parts without flow, moved to the vertex that their part shares with parts that have some.

    members(subgraph, vertex) are the vertices of all parts, flowing(subgraph)
    the parts with flow; measurements(subgraph, binding_type, place, ...). Those
    of parts with flow stay. A part without flow that shares no vertex, or
    several, with parts that have some raises if it has measurements.
    """
    with_flow = members.join(flowing, "subgraph", "left_semi").select("vertex", F.col("subgraph").alias("to_part"))
    at_rest = members.join(flowing, "subgraph", "left_anti")
    common = at_rest.join(with_flow, "vertex").groupBy("subgraph").agg(F.countDistinct("vertex").alias("n"), F.min("vertex").alias("common"), F.min("to_part").alias("to_part"))
    stay = measurements.join(flowing, "subgraph", "left_semi")
    moved = measurements.join(flowing, "subgraph", "left_anti").join(common, "subgraph", "left")
    fine = F.coalesce("n", F.lit(0)) == 1
    place = F.when(fine, F.col("common")).otherwise(_fail("no single vertex shared with flow by part ", "subgraph", kind="bigint"))
    rest = [c for c in measurements.columns if c not in ("subgraph", "binding_type", "place")]
    return stay.select("subgraph", "binding_type", "place", *rest).unionByName(moved.select(F.col("to_part").alias("subgraph"), F.lit("vertex").alias("binding_type"), place.cast(measurements.schema["place"].dataType).alias("place"), *rest))


def bound_to_blocks(measurements: DataFrame, blocked: DataFrame) -> DataFrame:
    """measurements(binding_type, place, ...) with kind and id in the tree of blocks.

    Vertices and one-sided edges keep their number; a bridge is its block; one
    on an edge within a larger block has no place in the tree and is left out.
    """
    of = blocked.select(F.col("edge").alias("place"), "block", "is_bridge")
    rest = measurements.filter("binding_type <> 'edge2'").select("*", F.col("binding_type").alias("kind"), F.col("place").cast("long").alias("id"))
    bridges = measurements.filter("binding_type = 'edge2'").join(of.filter("is_bridge"), "place").select(*measurements.columns, F.lit("block").alias("kind"), F.col("block").cast("long").alias("id"))
    return rest.unionByName(bridges)


def named(places: DataFrame, names: DataFrame) -> DataFrame:
    """places(binding_type, place, ...) with their name in names(binding_type, place, name); one without a name raises."""
    found = places.join(names, ["binding_type", "place"], "left")
    return found.withColumn("name", F.when(F.col("name").isNull(), _fail("no object at ", "binding_type", "place", kind="string")).otherwise(F.col("name")))


def inverted(items: DataFrame, index: str = "index", value: str = "value") -> DataFrame:
    """(value, index): where each value stands, the last place of several."""
    return items.groupBy(value).agg(F.max(index).alias(index))


def block_of_edges(blocked: DataFrame) -> DataFrame:
    return blocked.select("edge", "block")


def blocks_of_vertices(blocked: DataFrame) -> DataFrame:
    """(vertex, blocks): the sorted blocks that each vertex is in."""
    ends = blocked.select("block", F.explode(F.array("from_v", "to_v")).alias("vertex")).distinct()
    return ends.groupBy("vertex").agg(F.array_sort(F.collect_list("block")).alias("blocks"))


def reordered(items: DataFrame, order: DataFrame) -> DataFrame:
    """items(place, ...) with the position that order(place, original) gives them back."""
    return items.join(order, "place").withColumn("place", F.col("original")).drop("original")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def edges_of_parts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(subgraph, edges): sorted edges of each subgraph whose ends are all in it."""
    ends = F.array_compact(F.array("from_v", "to_v"))
    listed = edges.select("edge", F.explode(ends).alias("vertex"), F.size(ends).alias("n"))
    whole = listed.join(members.select("subgraph", "vertex"), "vertex").groupBy("subgraph", "edge", "n").count().filter("count = n")
    return whole.groupBy("subgraph").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def block_imbalance(blocked: DataFrame, flows: DataFrame) -> DataFrame:
    """(block, imbalance): what flows into each block less what flows out, at its connectors.

    A connector is a vertex of the block; its flow is what the edges of other
    blocks and one-sided edges, flows(edge, from_v, to_v, flow), bring there.
    """
    inside = blocked.select("edge", F.col("block").alias("own"))
    sides = F.array(F.struct(F.col("from_v").alias("vertex"), (-F.col("flow")).alias("signed")), F.struct(F.col("to_v").alias("vertex"), F.col("flow").alias("signed")))
    brought = flows.filter("flow is not null").join(inside, "edge", "left").select("own", F.inline(sides)).filter("vertex is not null")
    ends = blocked.select("block", F.explode(F.array("from_v", "to_v")).alias("vertex")).distinct()
    outer = ends.join(brought, "vertex").filter(F.col("own").isNull() | (F.col("own") != F.col("block")))
    return outer.groupBy("block").agg(F.sum("signed").alias("imbalance"))


def lumped_blocks(blocked: DataFrame, kinds: DataFrame) -> DataFrame:
    """(block, is_lumped, is_propagatable) of kinds(edge, kind, flow): no pipe in it, and a finite flow on each of its edges."""
    known = F.col("flow").isNotNull() & ~F.isnan("flow")
    return blocked.select("edge", "block").join(kinds, "edge").groupBy("block").agg(F.bool_and(F.col("kind") != "pipe").alias("is_lumped"), F.bool_and(known).alias("is_propagatable"))


def blocks_of_forest(blocked: DataFrame, cut: DataFrame) -> DataFrame:
    """Blocks of a network whose edges cut(edge, from_v, to_v) were cut before: each of them is put back as a bridge named by itself."""
    return blocked.unionByName(cut.select("edge", "from_v", "to_v", F.col("edge").cast("long").alias("block"), F.lit(True).alias("is_bridge")))


def levels_within(blocked: DataFrame) -> DataFrame:
    """(block, vertex, level): how far each vertex is from where its block begins, along the edges; a block with a circle raises."""
    in_block = lambda c: F.concat_ws("/", F.col("block").cast("string"), F.col(c).cast("string")).alias(c)
    found = graph.levels(blocked.select("edge", in_block("from_v"), in_block("to_v")))
    parts = F.split("vertex", "/")
    return found.select(parts[0].cast("long").alias("block"), parts[1].cast("long").alias("vertex"), F.col("level").cast("long").alias("level"))


def ports_as_vertices(jumpers: DataFrame) -> DataFrame:
    """(object, ports): for each object a map of its ports to the vertices that jumpers(from_object, from_port, to_object, to_port) make of them.

    Ports that jumpers join, directly or by others, are one vertex, numbered
    from 0 by the smallest object and port. A jumper with one end only raises.
    """
    whole = F.col("from_object").isNotNull() & F.col("to_object").isNotNull()
    checked = jumpers.withColumn("from_port", F.when(whole, F.col("from_port")).otherwise(F.raise_error(F.lit("a jumper hangs")).cast("long")))
    port = lambda o, p: F.shiftleft(F.col(o).cast("long"), 20) + F.col(p)
    collapsed = graph.jumpers_collapsed(checked.select(port("from_object", "from_port").alias("u"), port("to_object", "to_port").alias("v")))
    placed = collapsed.select(F.shiftright("port", 20).alias("object"), F.col("port").bitwiseAND((1 << 20) - 1).alias("n"), "vertex")
    return placed.groupBy("object").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "vertex")))).alias("ports"))


def ends_of_objects(ports: DataFrame) -> DataFrame:
    """(object, from_v, to_v): port 1 is where an object begins, port 2 where it ends."""
    return ports.select("object", F.try_element_at("ports", F.lit(1).cast("long")).alias("from_v"), F.try_element_at("ports", F.lit(2).cast("long")).alias("to_v"))


def ports_in_use(jumpers: DataFrame) -> DataFrame:
    """(object, port, n): jumpers at each port."""
    ends = F.array(F.struct(F.col("from_object").alias("object"), F.col("from_port").alias("port")), F.struct(F.col("to_object").alias("object"), F.col("to_port").alias("port")))
    return jumpers.select(F.inline(ends)).groupBy("object", "port").agg(F.count(F.lit(1)).alias("n"))


def visited(ends: DataFrame, flags: DataFrame, wanted: bool = True) -> DataFrame:
    """ends(vertex, edge, ...) of edges that flags(edge) lists, or of the others."""
    return ends.join(flags, "edge", "left_semi" if wanted else "left_anti")


def sizes(edges: DataFrame) -> DataFrame:
    """(n_edges1, n_edges2, n_vertices, max_vertex) of a network."""
    one = F.col("from_v").isNull() | F.col("to_v").isNull()
    counted = edges.agg(F.count_if(one).alias("n_edges1"), F.count_if(~one).alias("n_edges2"), F.max(F.greatest("from_v", "to_v")).alias("max_vertex"))
    return counted.crossJoin(graph.vertices(edges).agg(F.count(F.lit(1)).alias("n_vertices"))).select("n_edges1", "n_edges2", "n_vertices", "max_vertex")  # one row each


def computed_as(states: DataFrame) -> DataFrame:
    """states(name, is_opened) with model_type: what is closed splits the network, what is open hands through at once."""
    return states.withColumn("model_type", F.when(F.col("is_opened"), "Instant").otherwise("Splittable"))


def single_flow_part(parts: DataFrame) -> DataFrame:
    """The one row of parts(subgraph, is_flow, ...) with flow; none or several raise."""
    counted = parts.filter("is_flow").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*parts.columns)).alias("part"))
    return counted.withColumn("n", F.when(F.col("n") == 1, F.col("n")).otherwise(_fail("parts with flow: ", "n", kind="bigint"))).filter("n = 1").select("part.*")


def filled(places: DataFrame, averages: DataFrame) -> DataFrame:
    """(place, family, value, confident): every place with the averages(family, value) of the whole network, never confident."""
    return places.crossJoin(F.broadcast(averages.select("family", "value"))).withColumn("confident", F.lit(False))  # a handful of quantities


def unsure(rows: DataFrame) -> DataFrame:
    """rows with nothing confident."""
    return rows.withColumn("confident", F.lit(False))


def put_together(problems: list[DataFrame]) -> DataFrame:
    """Diagnostics of parts as one table; columns that a part lacks are null."""
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
