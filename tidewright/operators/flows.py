"""Mass balance: imbalances, reconciliation of redundant meters, and flows that follow from metered ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Meters weigh by the inverse of their size, which is at least this.
LEAST_SCALE = 1e-8


def imbalances(edges: DataFrame, flow: str = "flow") -> DataFrame:
    """(vertex, imbalance): inflow less outflow over edges with a known flow."""
    pairs = F.array(F.struct(F.col("from_v").alias("vertex"), (-F.col(flow)).alias("signed")), F.struct(F.col("to_v").alias("vertex"), F.col(flow).alias("signed")))
    return edges.filter(F.col(flow).isNotNull()).select(F.inline(pairs)).filter("vertex is not null").groupBy("vertex").agg(F.sum("signed").alias("imbalance"))


def reconciled_single(meters: DataFrame, balance: list[str]) -> DataFrame:
    """meters(balance, measured, sign) with corrected, delta and residual, for one constraint sum(sign * corrected) = 0 in each balance.

    Least squares with weights 1 / max(|measured|, 1e-8) has a closed form:
    each meter takes a part of the residual in proportion to its size.
    """
    sized = meters.withColumn("scale", F.greatest(F.abs("measured"), F.lit(LEAST_SCALE)))
    sums = sized.groupBy(*balance).agg(F.sum(F.col("sign") * F.col("measured")).alias("residual"), F.sum("scale").alias("scales"))
    shift = F.col("sign") * F.col("scale") * F.col("residual") / F.col("scales")
    return sized.join(sums, balance).withColumn("delta", -shift).withColumn("corrected", F.col("measured") - shift).drop("scale", "scales")


def adjustable(meters: DataFrame, balance: list[str], share: float) -> DataFrame:
    """meters with adjusted: false where a flow is below share of the largest of its balance and so keeps its value."""
    most = meters.groupBy(*balance).agg(F.max(F.abs("measured")).alias("largest"))
    return meters.join(most, balance).withColumn("adjusted", F.abs("measured") >= share * F.col("largest")).drop("largest")


def reconciled(meters: DataFrame, incidence: DataFrame, time: str = "t") -> DataFrame:
    """meters(t, edge, measured) with corrected and delta for any number of balances incidence(constraint, edge, sign).

    Meters of one time are solved together by the Lagrange system of weighted
    least squares; times are independent tasks. The incidence is a network's
    own, not the data's, so it travels with the function.
    """
    rows = [(r["constraint"], r["edge"], float(r["sign"])) for r in incidence.collect()]
    names = sorted({c for c, _, _ in rows})

    def solve(layer: pd.DataFrame) -> pd.DataFrame:
        layer = layer.sort_values("edge").reset_index(drop=True)
        place = {e: i for i, e in enumerate(layer["edge"])}
        a = np.zeros((len(names), len(layer)))
        for c, e, s in rows:
            if e in place:
                a[names.index(c), place[e]] += s
        m = layer["measured"].to_numpy(float)
        scale = np.maximum(np.abs(m), LEAST_SCALE)
        used = np.abs(a).sum(1) > 0
        a = a[used]
        lagrange = np.linalg.lstsq((a * scale) @ a.T, a @ m, rcond=None)[0] if len(a) else np.zeros(0)
        corrected = m - scale * (a.T @ lagrange)
        return layer.assign(corrected=corrected, delta=corrected - m)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in meters.schema.fields)
    return meters.groupBy(time).applyInPandas(solve, f"{fields}, corrected double, delta double")


def corrected_by_factors(flows: DataFrame, factors: DataFrame, key: str) -> DataFrame:
    """flows(key, value) times factors(key, factor); 1 where a key has no factor."""
    return flows.join(factors, key, "left").withColumn("value", F.col("value") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def compile_flows(edges: list[tuple], metered: list) -> tuple[dict, list, list]:
    """Which linear combination of meters gives each edge's flow: ({edge: {meter: coefficient}}, useless meters, edges without a flow).

    edges are (edge, from_v, to_v) with None for the outside. Meters are taken
    in their order; whenever a vertex has a single edge without a flow, its
    balance gives that edge one. A meter on an edge that has a flow already is
    useless. It depends on the network and on the places of the meters only, so
    it is made once and then applied to any number of times by flows_of().
    """
    at: dict = {}
    for e, a, b in edges:
        if a is not None:
            at.setdefault(a, []).append((e, -1))
        if b is not None:
            at.setdefault(b, []).append((e, 1))
    ends = {e: [v for v in (a, b) if v is not None] for e, a, b in edges}
    known: dict = {}
    useless = []
    for meter in metered:
        if meter in known:
            useless.append(meter)
            continue
        known[meter] = {meter: 1.0}
        todo = list(ends[meter])
        while todo:
            v = todo.pop()
            open_edges = [(e, s) for e, s in at[v] if e not in known]
            if len(open_edges) != 1:
                continue
            (e, sign), total = open_edges[0], {}
            for other, s in at[v]:
                for m, c in known.get(other, {}).items():
                    total[m] = total.get(m, 0.0) - s * sign * c
            known[e] = {m: c for m, c in total.items() if c}
            todo += ends[e]
    return known, useless, [e for e, _, _ in edges if e not in known]


def flows_of(measured: DataFrame, known: dict) -> DataFrame:
    """(t, edge, flow) for all times of measured(t, edge, value) by the compiled combinations."""
    spark = measured.sparkSession
    rows = [(e, m, c) for e, combination in known.items() for m, c in combination.items()]
    kind = measured.schema["edge"].dataType.simpleString()
    table = spark.createDataFrame(rows, f"to_edge {kind}, edge {kind}, coefficient double")
    return measured.join(F.broadcast(table), "edge").groupBy("t", F.col("to_edge")).agg(F.sum(F.col("coefficient") * F.col("value")).alias("flow")).withColumnRenamed("to_edge", "edge")  # the network's size


def redundant_parts(parts: DataFrame) -> DataFrame:
    """parts(part, n_meters, n_ends) with redundancy: what is more than n_ends - 1 meters; raises if a part has fewer."""
    short = F.col("n_meters") < F.col("n_ends") - 1
    return parts.withColumn("is_redundant", F.when(short, F.raise_error(F.concat(F.lit("too few meters in part "), F.col("part").cast("string"))).cast("boolean")).otherwise(F.col("n_meters") >= F.col("n_ends")))


def is_at_rest(flow: Column, limit: float = 1e-12) -> Column:
    return F.abs(flow) <= limit
