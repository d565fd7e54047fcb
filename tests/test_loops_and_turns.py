import math

import numpy as np
import pytest

from tidewright.operators import advection, transport
from tidewright.operators.transport import Edge

#: Two sources feed a triangle of gates at different corners; it feeds a pair of pipes and, at the third corner, an outlet.
LOOPED = [
    Edge("s1", "source", None, 0), Edge("s2", "source", None, 1),
    Edge("a", "lumped", 0, 1), Edge("b", "lumped", 1, 2), Edge("c", "lumped", 0, 2),
    Edge("out", "source", 2, None), Edge("link", "lumped", 1, 3), Edge("p1", "pipe", 3, 4, 800.0, 0.5), Edge("p2", "pipe", 4, 3, 800.0, 0.5), Edge("end", "source", 4, None),
]
NOMINAL = [("s1", 800.0), ("s2", 900.0), ("s3", 950.0)]


def run(spark, edges, meters, **options):
    entering = spark.createDataFrame(NOMINAL, "name string, nominal double")
    rows, useless, lacking = transport.metered_transport(edges, spark.createDataFrame(meters, "step long, name string, flow double"), entering, **options)
    return {(r["step"], r["name"]): r for r in rows.collect()}, useless, lacking


def test_a_loop_of_gates_mixes_as_one(spark):
    got, useless, lacking = run(spark, LOOPED, [(0, "s1", 3.0), (0, "s2", 1.0), (0, "out", 1.0)])
    after = (2 * 800 + 1 * 900) / 3  # the loop gives 2 to the corner where the second source joins
    assert useless == [] and lacking == ["a", "b", "c"]
    assert {n for _, n in got} == {e.name for e in LOOPED}
    for name in ("link", "p1", "p2", "end", "out", "a", "b", "c"):
        assert got[0, name]["outlet"] == pytest.approx(after if name in ("link", "p1", "p2", "end") else 800.0), name
    assert got[0, "p1"]["flow"] == got[0, "p2"]["flow"] == pytest.approx(1.5) and got[0, "a"]["flow"] is None
    both = [Edge("s3", "source", None, 2), *LOOPED]
    got, _, _ = run(spark, both, [(0, "s1", 3.0), (0, "s2", 1.0), (0, "out", 1.0), (0, "s3", 2.0)])
    mixture = (3 * 800 + 1 * 950) / 4
    assert got[0, "a"]["outlet"] == pytest.approx(mixture) and got[0, "a"]["confident"] is False


def test_a_meter_opens_a_loop(spark):
    got, _, lacking = run(spark, LOOPED, [(0, "s1", 3.0), (0, "s2", 1.0), (0, "out", 1.0), (0, "c", 0.5)])
    assert lacking == []
    assert got[0, "a"]["outlet"] == 800.0 and got[0, "link"]["outlet"] == pytest.approx((2.5 * 800 + 1.0 * 900) / 3.5)
    assert got[0, "out"]["outlet"] == pytest.approx((0.5 * 800 + 0.5 * (2.5 * 800 + 900) / 3.5) / 1.0)


def test_a_loop_of_pipes_is_an_error(spark):
    pipes = [Edge(e.name, "pipe" if e.name == "b" else e.kind, e.from_v, e.to_v, 500.0, 0.5) for e in LOOPED]
    with pytest.raises(ValueError, match="pipes in a loop"):
        run(spark, pipes, [(0, "s1", 3.0), (0, "s2", 1.0), (0, "out", 1.0)])


LINE = [Edge("s1", "source", None, 0), Edge("pipe", "pipe", 0, 1, 2000.0, 0.6), Edge("s2", "source", None, 1)]


def test_pipes_go_on_where_flows_turn(spark):
    rng = np.random.default_rng(1)
    flows = [0.3] * 7 + [-0.2] * 5 + [0.0] * 3 + [-0.1] * 4 + [0.4] * 9
    flows = [f * (1 + 0.2 * rng.random()) for f in flows]
    got, _, _ = run(spark, LINE, [(s, "s1", f) for s, f in enumerate(flows)] + [(s, "s2", -f) for s, f in enumerate(flows)], dt=60.0)
    n, cell = advection.uniform_cells(2000.0)
    cells, last = None, None
    for step, f in enumerate(flows):
        if f == 0:
            assert (step, "pipe") not in got
            continue
        last = 800.0 if f > 0 else 900.0
        cells = np.full(n, last) if cells is None else advection.fv_step(cells, last, last, f / (math.pi * 0.36 / 4), cell, 60.0)
        assert got[step, "pipe"]["outlet"] == pytest.approx(cells[-1] if f > 0 else cells[0], rel=1e-12), step
        assert got[step, "pipe"]["inlet"] == last
    assert {s for s, n in got if n == "pipe"} == {s for s, f in enumerate(flows) if f}


def test_too_many_turns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(transport, "MOST_RUNS", 3)
    flows = [0.3, -0.3] * 4
    with pytest.raises(ValueError, match="turn"):
        run(spark, LINE, [(s, "s1", f) for s, f in enumerate(flows)] + [(s, "s2", -f) for s, f in enumerate(flows)], dt=60.0)
