"""Settings with the usual values, and their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Newton:
    rounds: int = 100
    line_search_rounds: int = 100
    tolerance: float = 1e-6
    pressure_spread: float = 0.0


@dataclass
class Flows:
    least_share: float = 1e-8
    halve_pairs: bool = False
    rebind_resting: bool = True


@dataclass
class Properties:
    density_std: bool = False
    viscosity_working: bool = False
    temperature: bool = False
    sulfur: bool = False
    improver: bool = False


@dataclass
class Settings:
    """Everything a run may set; what a JSON text doesn't name keeps its value here."""

    cell_metres: float = 200.0
    confident_above: float = 0.95
    method: str = "flows_from_meters"
    first_state_as_control: bool = True
    last_control_holds: bool = True
    newton: Newton = field(default_factory=Newton)
    flows: Flows = field(default_factory=Flows)
    properties: Properties = field(default_factory=Properties)

    def __post_init__(self) -> None:
        if self.method not in ("flows_from_meters", "flows_from_pressures"):
            raise ValueError(f"unknown method {self.method}")
        if not 0 < self.flows.least_share < 1:
            raise ValueError("least_share must be between 0 and 1")


def _over(kind, given: dict):
    out = {}
    for f in fields(kind):
        if f.name in given:
            inner = f.default_factory if is_dataclass(getattr(f, "default_factory", None)) else None
            out[f.name] = _over(inner, given[f.name]) if inner else given[f.name]
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"no setting is called {', '.join(sorted(unknown))}")
    return kind(**out)


def parse(text: str) -> Settings:
    return _over(Settings, json.loads(text or "{}"))
