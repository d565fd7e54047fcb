import pytest

from tidewright.operators import bindings


def test_a_place_in_no_or_two_subgraphs_raises(spark):
    places = spark.createDataFrame([(1,), (2,)], "vertex long")
    members = spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "subgraph string, vertex long, local long")
    assert sorted(map(tuple, bindings.descended_once(places, members).collect())) == [(1, "a", 0), (2, "a", 1)]
    for bad in (members.filter("vertex = 1"), members.unionByName(members)):
        with pytest.raises(Exception, match="exactly one subgraph"):
            bindings.descended_once(places, bad).collect()


def test_measurements_of_parts_at_rest_need_one_common_vertex(spark):
    members = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (2, 7)], "subgraph long, vertex long")
    flowing = spark.createDataFrame([(1,)], "subgraph long")
    seen = spark.createDataFrame([(0, "edge2", 5, 1.0), (1, "vertex", 3, 2.0)], "subgraph long, binding_type string, place long, value double")
    assert sorted(map(tuple, bindings.rebound_to_flow(seen, members, flowing).collect())) == [(1, "vertex", 2, 1.0), (1, "vertex", 3, 2.0)]
    for extra in ([(2, "vertex", 7, 3.0)], []):
        bad = members if extra else members.unionByName(spark.createDataFrame([(1, 1)], "subgraph long, vertex long"))
        rows = seen.unionByName(spark.createDataFrame(extra, seen.schema)) if extra else seen
        with pytest.raises(Exception, match="no single vertex"):
            bindings.rebound_to_flow(rows, bad, flowing).collect()


BLOCKED = [(0, 1, 2, 0, False), (1, 2, 3, 0, False), (2, 1, 3, 0, False), (3, 3, 4, 3, True)]
SCHEMA = "edge long, from_v long, to_v long, block long, is_bridge boolean"


def test_blocks_balance_at_their_connectors(spark):
    blocked = spark.createDataFrame(BLOCKED, SCHEMA)
    flows = spark.createDataFrame([(10, None, 1, 2.0), (11, 2, None, 0.5), (3, 3, 4, 1.4), (12, 4, None, 1.5), (0, 1, 2, None)], "edge long, from_v long, to_v long, flow double")
    got = {r["block"]: r["imbalance"] for r in bindings.block_imbalance(blocked, flows).collect()}
    assert got == pytest.approx({0: 0.1, 3: -1.5})
    assert {(r["block"], r["vertex"], r["level"]) for r in bindings.levels_within(blocked).collect()} == {(0, 1, 0), (0, 2, 1), (0, 3, 2), (3, 3, 0), (3, 4, 1)}
    seen = spark.createDataFrame([("edge2", 0), ("edge2", 3), ("vertex", 4), ("edge1", 10)], "binding_type string, place long")
    assert sorted((r["kind"], r["id"]) for r in bindings.bound_to_blocks(seen, blocked).collect()) == [("block", 3), ("edge1", 10), ("vertex", 4)]


def test_one_part_with_flow(spark):
    parts = spark.createDataFrame([(0, False, 3), (1, True, 4)], "subgraph long, is_flow boolean, n long")
    assert tuple(bindings.single_flow_part(parts).first()) == (1, True, 4)
    for bad in (parts.filter("not is_flow"), parts.unionByName(parts)):
        with pytest.raises(Exception, match="parts with flow"):
            bindings.single_flow_part(bad).collect()
    both = bindings.put_together([parts.select("subgraph"), parts])
    assert both.count() == 4 and both.filter("n is null").count() == 2
    assert not any(r["confident"] for r in bindings.unsure(parts.withColumn("confident", parts.is_flow)).collect())


def test_names_and_hanging_jumpers(spark):
    with pytest.raises(Exception, match="no object"):
        bindings.named(spark.createDataFrame([("vertex", 1)], "binding_type string, place long"), spark.createDataFrame([], "binding_type string, place long, name string")).collect()
    jumpers = spark.createDataFrame([(1, 2, 2, 1), (1, 2, 3, 1)], "from_object long, from_port long, to_object long, to_port long")
    assert {(r["object"], r["from_v"], r["to_v"]) for r in bindings.ends_of_objects(bindings.ports_as_vertices(jumpers)).collect()} == {(1, None, 0), (2, 0, None), (3, 0, None)}
    with pytest.raises(Exception, match="hangs"):
        bindings.ports_as_vertices(spark.createDataFrame([(1, 2, None, None)], jumpers.schema)).collect()
