"""Forests, tours, blocks, cycles, levels and splits against plain searches."""

import random

import pytest

from tidewright.operators import blocks, forest, graph, zeroflow


def net(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge long, from_v long, to_v long")


def mixed(seed, n, m, chain):
    """A random multigraph with self-loops, repeated edges and a chain, in random order."""
    draw = random.Random(seed)
    pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(chain)]
    draw.shuffle(pairs)
    return pairs


CASES = [mixed(2, 40, 60, 20), [(0, 1), (0, 1), (1, 2), (2, 2)], []]


@pytest.mark.parametrize("pairs", CASES)
def test_blocks_equal_a_depth_first_search(spark, pairs):
    got = {r["edge"]: (r["block"], r["is_bridge"], r["from_v"], r["to_v"]) for r in blocks.blocks(net(spark, [*pairs, (None, 3)])).collect()}
    assert got == {e: (min(b), len(b) == 1, *pairs[e]) for b in blocks.biconnected([(i, a, b) for i, (a, b) in enumerate(pairs)]) for e in b}


@pytest.mark.parametrize("pairs", CASES[:1])
def test_cycles_are_single_ways_round_and_nests_are_blocks(spark, pairs):
    edges = net(spark, pairs).toDF("edge", "u", "v")
    table = forest.fundamental_cycles(edges)
    cycles = {}
    for cycle, edge in table.collect():
        cycles.setdefault(cycle, []).append(edge)
    for cycle, ways in cycles.items():
        met = [v for e in ways for v in set(pairs[e])]
        assert cycle in ways
        assert len(set(ways)) == len(ways)
        assert len(ways) == 1 or all(met.count(v) == 2 for v in met)
    parts = {r["component"] for r in graph.components(net(spark, pairs)).collect()}
    assert len(cycles) == len(pairs) - len({v for p in pairs for v in p}) + len(parts)
    blocked = {r["edge"]: r["block"] for r in blocks.blocks(net(spark, pairs)).collect() if not r["is_bridge"]}
    loops = {i: i for i, (a, b) in enumerate(pairs) if a == b}
    assert {r["edge"]: r["nest"] for r in forest.nested_cycles(table).collect()} == blocked | loops


@pytest.mark.parametrize("piece", [2, 1024])
def test_intervals_of_subtrees(spark, monkeypatch, piece):
    monkeypatch.setattr(forest, "PIECE", piece)
    draw = random.Random(3)
    pairs = [(draw.randrange(max(0, i - 3), i), i) for i in range(1, 60)]
    edges = net(spark, pairs).toDF("edge", "u", "v")
    tree, labels = forest.spanning_forest(edges)
    assert tree.count() == 59
    assert {r["vertex"] for r in labels.collect()} == set(range(60))
    assert labels.select("root").distinct().count() == 1
    tour = forest.euler_tour(tree, labels)
    values = {v: draw.randrange(-50, 50) for v in range(0, 60, 2)}
    found = forest.subtrees(tour, spark.createDataFrame(list(values.items()), "vertex long, x long").selectExpr("vertex", "x lo", "x hi", "x total"), {"lo": "min", "hi": "max", "total": "sum"})
    children = {}
    for r in tour.collect():
        children.setdefault(r["parent"], []).append(r["child"])

    def below(v):
        return [v, *[w for c in children.get(v, []) for w in below(c)]]

    for r in found.collect():
        mine = [values[v] for v in below(r["child"]) if v in values]
        assert (r["lo"], r["hi"], r["total"]) == (min(mine, default=None), max(mine, default=None), sum(mine))


def plain_levels(pairs):
    before = {v: set() for p in pairs for v in p}
    for a, b in pairs:
        before[b].add(a)
    level = {}

    def at(v):
        if v not in level:
            level[v] = 1 + max(map(at, before[v])) if before[v] else 0
        return level[v]

    for v in sorted(before):
        at(v)
    return level


@pytest.mark.parametrize(("n", "m", "chain", "seed"), [(60, 70, 40, 2), (30, 200, 0, 3)])
def test_levels_equal_longest_paths(spark, n, m, chain, seed):
    pairs = [(a, b) for a, b in mixed(seed, n, m, chain) if a < b]
    assert {r["vertex"]: r["level"] for r in graph.levels(net(spark, [*pairs, (None, 7), (5, None)])).collect()} == plain_levels([*pairs]) | ({} if any(7 in p for p in pairs) else {7: 0}) | ({} if any(5 in p for p in pairs) else {5: 0})


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 1)], [(0, 1), (1, 2), (2, 3), (3, 1), (5, 2), (7, 3), (5, 1)], [(1, 1)]])
def test_levels_of_a_circle_raise(spark, pairs):
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(net(spark, pairs)).collect()


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 20_000
    chain = spark.range(n).selectExpr("id edge", "id * 7919 % 20011 x", "id").selectExpr("edge", "id from_v", "id + 1 to_v")
    rounds = []
    kept = graph.observed
    monkeypatch.setattr(graph, "observed", lambda df, label, **asked: rounds.append(label) or kept(df, label, **asked))
    top = graph.levels(chain).selectExpr("max(level)", "count(*)").first()
    assert tuple(top) == (n, n + 1)
    assert len([x for x in rounds if x == "chains"]) <= 25


def plain_split(edges, least):
    """{(edge, half): (is_zero, part, is_flow)} of (edge, from_v, to_v, is_closed, is_resting), by taking out edges one by one."""
    cut = []
    for e, a, b, closed, resting in edges:
        if not closed:
            cut.append((e, "whole", a, b, resting))
        elif a is not None and b is not None:
            cut += [(e, "sink", a, None, True), (e, "source", None, b, True)]
    zero = {(e, h) for e, h, _, _, rests in cut if rests}
    while True:
        at = {}
        for e, h, a, b, _ in cut:
            if (e, h) not in zero:
                for v in {a, b} - {None}:
                    at.setdefault(v, set()).add((e, h))
        last = {next(iter(s)) for s in at.values() if len(s) == 1}
        if not last:
            break
        zero |= last
    out = {}
    for state in (False, True):
        mine = [x for x in cut if ((x[0], x[1]) in zero) == state]
        root = {}

        def find(v, root=root):
            while root.setdefault(v, v) != v:
                v = root[v]
            return v

        for _, _, a, b, _ in mine:
            if a is not None and b is not None:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        ones = {}
        for _, _, a, b, _ in mine:
            if a is None or b is None:
                part = find(a if b is None else b)
                ones[part] = ones.get(part, 0) + 1
        for e, h, a, b, _ in mine:
            part = find(a if a is not None else b)
            out[e, h] = (state, part, not state and ones.get(part, 0) >= least)
    return out


NETWORK = "edge long, from_v long, to_v long, is_closed boolean, is_resting boolean"


def gated(seed):
    draw = random.Random(seed)
    n = draw.choice([6, 15, 30])
    two = [(i, draw.randrange(n), draw.randrange(n), draw.random() < 0.2, draw.random() < 0.1) for i in range(int(n * draw.choice([0.8, 1.1])))]
    one = [(100 + i, *draw.choice([(None, draw.randrange(n)), (draw.randrange(n), None)]), draw.random() < 0.2, draw.random() < 0.3) for i in range(n // 2)]
    return two + one


@pytest.mark.parametrize(("seed", "least"), [(1, 2), (2, 1)])
def test_splits_equal_taking_out_one_by_one(spark, seed, least):
    edges = gated(seed)
    parts = zeroflow.split(spark.createDataFrame(edges, NETWORK), least)
    rows = parts.collect()
    assert {(r["edge"], r["half"]): (r["is_zero"], r["part"], r["is_flow"]) for r in rows} == plain_split(edges, least)
    vertices, members = (x.collect() for x in zeroflow.members(parts))
    at = {(r["subgraph"], r["local"]): r["vertex"] for r in vertices}
    for s in {r["subgraph"] for r in vertices}:
        mine = sorted((r["local"], r["vertex"]) for r in vertices if r["subgraph"] == s)
        assert [i for i, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for _, v in mine)
    back = {(r["edge"], r["half"]): (at.get((r["subgraph"], r["from_local"])), at.get((r["subgraph"], r["to_local"]))) for r in members}
    assert back == {(r["edge"], r["half"]): (r["from_v"], r["to_v"]) for r in rows}
    flowing = {v for r in rows if r["is_flow"] for v in (r["from_v"], r["to_v"])} - {None}
    for r in zeroflow.common_vertices(parts).collect():
        mine = {v for x in rows if (x["is_zero"], x["part"], x["is_flow"]) == (r["is_zero"], r["part"], False) for v in (x["from_v"], x["to_v"])} - {None}
        assert r["n"] == len(mine & flowing)
        assert r["vertex"] == (min(mine & flowing) if r["n"] == 1 else None)


def test_parts_are_split_again(spark):
    edges = gated(4)
    first = zeroflow.split(spark.createDataFrame(edges, NETWORK), 1)
    rows = first.collect()
    again = zeroflow.split_again(first, first.edge % 4 == 0, 1).collect()
    got, want = {}, {}
    for r in again:
        got[r["outer_zero"], r["outer"], r["edge"], r["outer_half"], r["half"]] = (r["is_zero"], r["part"], r["is_flow"])
    for zero, part in {(r["is_zero"], r["part"]) for r in rows}:
        mine = [r for r in rows if (r["is_zero"], r["part"]) == (zero, part)]
        names = {i: (r["edge"], r["half"]) for i, r in enumerate(mine)}
        inner = plain_split([(i, r["from_v"], r["to_v"], r["edge"] % 4 == 0, zero) for i, r in enumerate(mine)], 1)
        want |= {(zero, part, *names[i], half): found for (i, half), found in inner.items()}
    assert got == want
