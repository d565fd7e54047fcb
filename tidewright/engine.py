"""The engine's façade: a network from JSON, then steady solves, steps and results."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np

from tidewright.operators import advection, hydraulics

#: Density of a pipe's first filling, and the time step of step() if none is given.
DENSITY, STEP_SECONDS = 850.0, 30.0


@dataclass
class Engine:
    """One network, held on the driver: its size is that of its scheme. Histories and many scenarios go through the DataFrame operators."""

    edges: dict[str, dict]
    cells: dict[str, np.ndarray] = field(default_factory=dict)
    trust: dict[str, np.ndarray] = field(default_factory=dict)
    pressures: dict[int, float] = field(default_factory=dict)
    flows: dict[str, float] = field(default_factory=dict)
    time: float = 0.0

    @classmethod
    def from_json(cls, topology: str, objects: str) -> Engine:
        """topology: {name: {from?, to?}}; objects: {kind: {name: parameters}} with kinds pipe(s), valve(s), source(s), resistance(s), pump(s), check_valve(s)."""
        edges = {name: {"edge": name, "from_v": ends.get("from"), "to_v": ends.get("to"), "kind": None, "params": {}} for name, ends in json.loads(topology).items()}
        for kind, named in json.loads(objects).items():
            kind = kind.removesuffix("s")
            for name, p in named.items():
                if name not in edges:
                    raise ValueError(f"object {name} has no edge")
                e = edges[name]
                if e["kind"]:
                    raise ValueError(f"two objects are called {name}")
                e["kind"] = kind
                if kind == "source":
                    e["pressure"], e["flow"] = p.get("pressure"), p.get("std_volflow")
                    e["density"] = p.get("density")
                elif kind == "pipe":
                    e["params"] = {"length": abs(p["X_end"] - p["X_start"]), "diameter": p["Diameter"], **{k: v for k, v in p.items() if k in ("viscosity", "roughness", "rise", "density")}}
                elif kind == "valve":
                    e["params"] = {"opening": p.get("initial_opening", 0.0), "xi": p.get("xi", 0.0), "diameter": p.get("diameter", 0.0)}
                elif kind == "check_valve":
                    e["params"] = {"opening": p.get("opening", 1.0), "xi": p.get("hydraulic_resistance", 0.0), "diameter": p.get("diameter", 0.0)}
                else:
                    e["params"] = dict(p)
        if bare := [n for n, e in edges.items() if not e["kind"]]:
            raise ValueError(f"edges without an object: {', '.join(bare)}")
        return cls(edges)

    def control(self, bounds: str) -> None:
        """Apply controls {valves, resistances, check_valves: {name: {opening or is_opened}}, pumps: {name: {is_running, frequency}}, sources: {name: {pressure, std_vol_flow, density_std_out}}}; what isn't named stays."""
        given = json.loads(bounds)
        given = given.get("controls", given)
        if given.get("improvers"):
            raise ValueError("controls of improvers aren't supported")
        for name, c in {**given.get("valves", {}), **given.get("resistances", {}), **given.get("check_valves", {})}.items():
            self.edges[name]["params"]["opening"] = c["opening"] if "opening" in c else float(c["is_opened"])
        for name, c in given.get("pumps", {}).items():
            if self.edges.get(name, {}).get("kind") != "pump":
                raise ValueError(f"controls of pumps name what isn't one: {name}")
            if "is_running" in c:
                self.edges[name]["params"]["is_started"] = bool(c["is_running"])
            if "frequency" in c:
                self.edges[name]["params"]["frequency"] = float(c["frequency"])
        for name, c in given.get("sources", {}).items():
            e = self.edges[name]
            if "pressure" in c:
                e["pressure"], e["flow"] = c["pressure"], None
            if "std_vol_flow" in c:
                e["flow"], e["pressure"] = c["std_vol_flow"], None
            e["density"] = c.get("density_std_out", e.get("density"))

    def solve(self, bounds: str = "{}") -> bool:
        """Steady pressures and flows; pipes are filled with what comes in at their start."""
        self.control(bounds)
        self.pressures, self.flows, converged = hydraulics.solve_network(list(self.edges.values()), start=self.known() or None)
        self.filled()
        return converged

    def known(self) -> dict[int, float]:
        """The pressures that a solve starts from."""
        return {v: p for v, p in self.pressures.items() if p is not None}

    def filled(self) -> None:
        """Give pipes that hold nothing yet their first filling."""
        for name, e in self.edges.items():
            if e["kind"] == "pipe" and name not in self.cells:
                n, _ = advection.uniform_cells(e["params"]["length"])
                self.cells[name], self.trust[name] = np.full(n, DENSITY), np.zeros(n)

    def step(self, dt: float = STEP_SECONDS, bounds: str = "{}") -> bool:
        """Solve at the present densities, then carry them on for dt."""
        converged = self.solve(bounds)
        self.carry(dt)
        return converged

    def carry(self, dt: float = STEP_SECONDS) -> None:
        """Carry densities on for dt with the present flows."""
        entering = self._densities()
        for name, cells in self.cells.items():
            e = self.edges[name]
            _, cell = advection.uniform_cells(e["params"]["length"])
            velocity = self.flows[name] / (math.pi * e["params"]["diameter"] ** 2 / 4)
            parts = max(1, math.ceil(abs(velocity) * dt / cell))
            (a, sure_a), (b, sure_b) = entering.get(e["from_v"], (cells[0], 0.0)), entering.get(e["to_v"], (cells[-1], 0.0))
            for _ in range(parts):
                cells = advection.fv_step(cells, a, b, velocity, cell, dt / parts)
                self.trust[name] = advection.fv_step(self.trust[name], sure_a, sure_b, velocity, cell, dt / parts)
            self.cells[name] = cells
            e["params"]["density"] = float(cells.mean())
        self.time += dt

    def _densities(self) -> dict[int, tuple[float, float]]:
        """Density and confidence of the mixture at each vertex: its inlets by flow, downstream from sources and pipes' ends."""
        at: dict[int, tuple[float, float]] = {}
        for _ in range(len(self.edges) + 1):
            sums: dict[int, list[float]] = {}
            for name, e in self.edges.items():
                q = self.flows.get(name, 0.0)
                into, out_of = (e["to_v"], e["from_v"]) if q >= 0 else (e["from_v"], e["to_v"])
                if into is None or q == 0:
                    continue
                if name in self.cells:
                    i = -1 if q >= 0 else 0
                    value = (self.cells[name][i], self.trust[name][i])
                elif out_of is None:
                    value = (e.get("density") or DENSITY, 1.0 if e.get("density") else 0.0)
                elif out_of in at:
                    value = at[out_of]
                else:
                    continue
                s = sums.setdefault(into, [0.0, 0.0, 1.0])
                s[0] += abs(q)
                s[1] += abs(q) * value[0]
                s[2] = min(s[2], value[1])
            now = {v: (s[1] / s[0], s[2]) for v, s in sums.items()}
            if now == at:
                break
            at = now
        return at

    def results(self) -> str:
        """The present layer as JSON; numbers are texts."""
        pipes = {
            n: {
                "std_volumetric_flow": str(self.flows.get(n)),
                "coordinates": [str(i * advection.uniform_cells(self.edges[n]["params"]["length"])[1]) for i in range(len(c))],
                "profiles": {"density_std": [str(x) for x in c], "density_std_confidence": [str(bool(t > 0.95)).lower() for t in self.trust[n]]},
            }
            for n, c in self.cells.items()
        }
        sources = {n: {"std_volumetric_flow": str(self.flows.get(n))} for n, e in self.edges.items() if e["kind"] == "source"}
        return json.dumps({"layers": [{"step": str(self.time), "buffers": {"pipes": pipes, "sources": sources}}]})

    def state(self) -> str:
        return json.dumps({"cells": {n: c.tolist() for n, c in self.cells.items()}, "trust": {n: t.tolist() for n, t in self.trust.items()}, "pressures": list(self.pressures.items()), "time": self.time})

    def restore(self, state: str) -> None:
        s = json.loads(state)
        self.cells = {n: np.array(c) for n, c in s["cells"].items()}
        self.trust = {n: np.array(t) for n, t in s["trust"].items()}
        self.pressures, self.time = dict(map(tuple, s["pressures"])), s["time"]
