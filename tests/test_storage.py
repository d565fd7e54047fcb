import os

import numpy as np
import pytest

from tidewright import storage
from tidewright.operators.components import components


class Session:
    """As much of a session as shared_dir asks."""

    def __init__(self, master, named=None):
        self.master, self.sparkContext, self.conf, self.named = master, self, self, named
        self.applicationId = f"app-{master}"

    def get(self, key, default=None):
        return self.named

    def getConf(self):
        return self


def test_shared_dir_is_the_named_one_or_a_local_sessions_own():
    assert storage.shared_dir(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local", "local[4]", "local[*]"):
        assert os.path.isdir(storage.shared_dir(Session(master)))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(Session(master))


def test_written_tables_can_be_read_and_discarded(spark):
    table = storage.written(spark.range(5), "five")
    path = table.scratch_path
    assert path.startswith(storage.shared_dir(spark)) and os.path.isdir(path)
    assert sorted(r["id"] for r in table.collect()) == list(range(5))
    storage.discarded(table)
    assert not os.path.exists(path)
    storage.discarded(spark.range(3))


def test_components_of_numbers_and_of_pairs(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (230, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(80)]
    root = {x: x for ab in links for x in ab}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= root[a] != root[b]
            root[a] = root[b] = least
    want = {(n, r) for n, r in root.items() if sum(v == r for v in root.values()) > 1}
    before = set(os.listdir(storage.scratch_dir(spark)))
    frame = spark.createDataFrame(links, "u long, v long").repartition(3)
    rooted = components(frame)
    assert {tuple(r) for r in rooted.collect()} == want and rooted.count() == len(want)
    assert len(set(os.listdir(storage.scratch_dir(spark))) - before) == 1
    paired = frame.selectExpr("struct(-u as a, u as b) as u", "struct(-v as a, v as b) as v")
    got = {(r["node"]["b"], r["root"]["b"]) for r in components(paired).collect()}
    largest = {r: max(n for n, x in want if x == r) for _, r in want}
    assert got == {(n, largest[r]) for n, r in want}
