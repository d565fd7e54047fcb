"""What a network's topology says about its meters: constraints between them, and flows through blocks with loops.

Topologies are small, so these run on the driver, once for each version of the
topology; what they give is applied to whole histories by operators.flows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewright.operators import flows
from tidewright.operators.blocks import biconnected
from tidewright.operators.zeroflow import _parts


def constraints(edges: list[tuple], metered: set) -> tuple[list[tuple], list[int]]:
    """((constraint, edge, sign) of the balances that meters must meet, parts that lack meters).

    The network of (edge, from_v, to_v) is cut at metered two-sided edges. A
    part all of whose ends are metered has one balance: what enters it leaves
    it. With one end less it has none to spare; with more lacking it is named.
    """
    halves = []
    for e, a, b in edges:
        if e in metered and a is not None and b is not None:
            halves += [((e, -1), a, None), ((e, 1), None, b)]
        else:
            halves.append(((e, -1 if b is None else 1 if a is None else 0), a, b))
    rows, lacking = [], []
    ends = {name: (a, b) for name, a, b in halves}
    for part, (names, _) in enumerate(_parts(halves)):
        open_ends = [n for n in names if None in ends[n]]
        unmetered = [n for n in open_ends if n[0] not in metered]
        if not unmetered and open_ends:
            rows += [(part, e, sign) for e, sign in open_ends]
        elif len(unmetered) > 1:
            lacking.append(part)
    net: dict[tuple, int] = {}
    for part, e, sign in rows:
        net[part, e] = net.get((part, e), 0) + sign
    return [(part, e, sign) for (part, e), sign in sorted(net.items(), key=str) if sign], lacking


def analysed(meters: DataFrame, edges: list[tuple], time: str = "t") -> DataFrame:
    """meters(t, edge, measured) with corrected and delta by every balance the topology has; meters in none keep their values."""
    metered = {r["edge"] for r in meters.select("edge").distinct().collect()}
    rows, _ = constraints(edges, metered)
    kind = meters.schema["edge"].dataType.simpleString()
    return flows.reconciled(meters, meters.sparkSession.createDataFrame(rows, f"constraint long, edge {kind}, sign long"), time)


def loops_of(edges: list[tuple], metered: list) -> list[list]:
    """The loops, as lists of two-sided edges, that are left when metered edges are cut."""
    two = [(e, a, b) for e, a, b in edges if a is not None and b is not None and e not in set(metered)]
    return [[two[i][0] for i in block] for block in biconnected([(i, a, b) for i, (_, a, b) in enumerate(two)]) if len(block) > 1]


def compile_block_flows(edges: list[tuple], metered: list, halve_pairs: bool = False, connectors: bool = False) -> tuple[dict, list, list]:
    """flows.compile_flows() on the tree of blocks: loops are nodes with a balance of their own.

    Metered edges cut the network first, so a meter within a loop opens it. A
    bridge or one-sided edge gets the combination of meters that the balances
    of vertices and blocks give it; an edge within a loop gets none, unless
    halve_pairs: two parallel edges that are a block each carry half of it. With
    connectors, what flows from vertex v into loop i is there as ("into", i, v).
    """
    asked = set(metered)
    loops = loops_of(edges, metered)
    ends = {e: (a, b) for e, a, b in edges}
    inside = {e for loop in loops for e in loop}
    tree, halves = [], {}
    for e, a, b in edges:
        if e in asked and a is not None and b is not None:
            halves[e] = (("half", e, 0), ("half", e, 1))
            tree += [(halves[e][0], a, None), (halves[e][1], None, b)]
        elif e not in inside:
            tree.append((e, a, b))
    for i, loop in enumerate(loops):
        for v in sorted({v for e in loop for v in ends[e]}):
            tree.append((("into", i, v), v, ("loop", i)))
    listed = [h for m in metered for h in halves.get(m, (m,))]
    known, useless, _ = flows.compile_flows(tree, listed)
    whole = {h: e for e, pair in halves.items() for h in pair}
    joined: dict = {}
    for e, combination in known.items():
        sums: dict = {}
        for m, c in combination.items():
            sums[whole.get(m, m)] = sums.get(whole.get(m, m), 0.0) + c
        joined[e] = {m: c for m, c in sums.items() if c}
    known = {e: c for e, c in joined.items() if e not in whole} | {e: {e: 1.0} for e in halves}
    if halve_pairs:
        for i, loop in enumerate(loops):
            if len(loop) == 2 and set(ends[loop[0]]) == set(ends[loop[1]]):
                for e in loop:
                    into = known.get(("into", i, ends[e][0]))
                    if into is not None:
                        known[e] = {m: c / 2 for m, c in into.items()}
    spare = set(useless)
    if not connectors:
        known = {e: c for e, c in known.items() if not (isinstance(e, tuple) and e[:1] == ("into",))}
    return known, [m for m in metered if all(h in spare for h in halves.get(m, (m,)))], [e for e, _, _ in edges if e not in known]


def block_levels(edges: list[tuple], sources: list) -> dict:
    """Level of each vertex and, as ("loop", i), of each loop, in steps along the tree of blocks from the source vertices; raises if some can't be reached."""
    two = [(e, a, b) for e, a, b in edges if a is not None and b is not None]
    number = {i: x for i, x in enumerate(two)}
    found = biconnected([(i, a, b) for i, (_, a, b) in number.items()])
    near: dict = {}
    for k, block in enumerate(found):
        vertices = sorted({v for i in block for v in number[i][1:]})
        if len(block) == 1:
            near.setdefault(vertices[0], set()).add(vertices[-1])
            near.setdefault(vertices[-1], set()).add(vertices[0])
        else:
            for v in vertices:
                near.setdefault(v, set()).add(("loop", k))
                near.setdefault(("loop", k), set()).add(v)
    level = dict.fromkeys(sources, 0)
    front, away = list(sources), 0
    while front:
        away += 1
        fresh = {w for v in front for w in near.get(v, ()) if w not in level}
        level.update(dict.fromkeys(fresh, away))
        front = list(fresh)
    if rest := [v for v in near if v not in level]:
        raise ValueError(f"not reached from the sources: {rest[:5]}")
    return level
