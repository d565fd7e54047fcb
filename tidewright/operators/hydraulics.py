"""Nodal pressures of hydraulic networks by Newton's method; scenarios are the parallel axis.

Edge laws are callables flow(p_in, p_out, params); LAWS is the registry that
applications add their own to.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import profiles
from tidewright.functions.scalar import GRAVITY, OPEN_ABOVE
from tidewright.operators.scenarios import dealt, whole

#: A flow changes by at least this per pascal, which keeps closed edges solvable.
LEAST_SLOPE = 1e-9
#: Pascals over which the first round's slopes are taken, each way.
FIRST_REACH = 1e5
NEWTON_ROUNDS, NEWTON_STEP, LAST_STEPS = 100, 1e-6, 3


def _signed_root(x: float) -> float:
    return math.copysign(math.sqrt(abs(x)), x)


def quadratic_law(p_in: float, p_out: float, params: dict) -> float:
    """Q = root of the pressure drop over a resistance."""
    return _signed_root((p_in - p_out) / params["resistance"])


def local_law(p_in: float, p_out: float, params: dict) -> float:
    """A valve or another local resistance; closed below an opening of a thousandth."""
    if params.get("opening", 1.0) <= OPEN_ABOVE:
        return 0.0
    area = math.pi * params["diameter"] ** 2 / 4
    return area * _signed_root(2 * (p_in - p_out) / (params["xi"] * params.get("density", 850.0)))


def friction(re: float, roughness: float) -> float:
    """The friction factor of functions.scalar.friction_isaev, for numbers."""
    re = abs(re)
    if re < 2320:
        return 64 / max(re, 1.0)
    if re < 4000:
        share = 1 - math.exp(-0.002 * (re - 2320))
        return 64 / re * (1 - share) + 0.3164 / re**0.25 * share
    return (-1.8 * math.log10(6.8 / re + (roughness / 3.7) ** 1.1)) ** -2


def pipe_loss(flow: float, params: dict) -> float:
    """Pressure at the start less that at the end of a pipe that carries flow."""
    d, rho = params["diameter"], params.get("density", 850.0)
    v = flow / (math.pi * d**2 / 4)
    loss = friction(v * d / params.get("viscosity", 1e-5), params.get("roughness", 1.25e-4) / d) * params["length"] / d * rho * v * abs(v) / 2
    return loss + rho * GRAVITY * params.get("rise", 0.0)


def bracketed_root(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-12, rounds: int = 200) -> float:
    """A root of f between low and high, where its sign changes: secants, kept within the bracket and halved if they stall."""
    a, b, fa, fb = low, high, f(low), f(high)
    if fa == 0 or fb == 0:
        return a if fa == 0 else b
    if fa * fb > 0:
        raise ValueError("the signs at the ends of the bracket are equal")
    for i in range(rounds):
        x = (a + b) / 2 if i % 3 == 2 else b - fb * (b - a) / (fb - fa)
        fx = f(x)
        if fx == 0 or abs(b - a) <= tolerance * max(1.0, abs(x)):
            return x
        if fa * fx < 0:
            b, fb = x, fx
        else:
            a, fa = x, fx
    return (a + b) / 2


def bracketed_roots(f: Callable[[np.ndarray, np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, tolerance: float = 1e-12, rounds: int = 200) -> np.ndarray:
    """bracketed_root() of many functions: f takes values and the numbers of the functions that they are for."""
    every = np.arange(len(low))
    a, b, fa, fb = low.copy(), high.copy(), f(low, every), f(high, every)
    if (fa * fb > 0).any():
        raise ValueError("the signs at the ends of the bracket are equal")
    root = np.where(fa == 0, a, b)
    of = np.flatnonzero((fa != 0) & (fb != 0))
    for i in range(rounds):
        if not len(of):
            break
        x = (a[of] + b[of]) / 2 if i % 3 == 2 else b[of] - fb[of] * (b[of] - a[of]) / (fb[of] - fa[of])
        fx = f(x, of)
        done = (fx == 0) | (np.abs(b[of] - a[of]) <= tolerance * np.maximum(1.0, np.abs(x)))
        root[of[done]] = x[done]
        of, x, fx = of[~done], x[~done], fx[~done]
        up = fa[of] * fx < 0
        b[of[up]], fb[of[up]] = x[up], fx[up]
        a[of[~up]], fa[of[~up]] = x[~up], fx[~up]
    root[of] = (a[of] + b[of]) / 2
    return root


def pipe_law(p_in: float, p_out: float, params: dict) -> float:
    """The flow whose loss is the given drop; the loss rises with flow, so a bracket always closes."""
    drop = p_in - p_out
    reach = 1.0
    f = lambda q: pipe_loss(q, params) - drop
    while f(-reach) > 0 or f(reach) < 0:
        reach *= 4
    return bracketed_root(f, -reach, reach)


#: Effective diameter and resistance of a stopped pump; flows, in m3/h, that head curves hold for.
STOPPED_DIAMETER, STOPPED_RESISTANCE = 0.1, 100.0
CURVE_FLOWS = (0.0, 6000.0)
HOUR = 3600.0


def pump_curve(params: dict) -> list[tuple]:
    """The head curve, in metres over m3/h, of a scheme's head_characteristic or of numbers head_0 to head_3."""
    given = params.get("head_characteristic")
    coefficients = list(given) if given is not None else [params[f"head_{i}"] for i in range(4) if f"head_{i}" in params]
    if not coefficients:
        raise ValueError("a pump needs a head_characteristic")
    return profiles.head_curve([*coefficients, *[0.0] * (4 - len(coefficients))], *CURVE_FLOWS)


def pump_ratio(params: dict) -> float:
    """Relative frequency times what is left of the wheel; the frequency is relative as schemes have it (initial_frequency), or changed by control (frequency)."""
    return params.get("frequency", params.get("initial_frequency") or 1.0) * (1.0 - (params.get("rotor_wheel_reducing") or 0.0))


def pump_law(p_in: float, p_out: float, params: dict) -> float:
    """A running pump's flow at the head between its ends, on its curve at its speed; a stopped one is an open resistance, whatever the direction."""
    rho = params.get("density", 850.0)
    if not params.get("is_started", params.get("is_initially_started", True)):
        return local_law(p_in, p_out, {"diameter": STOPPED_DIAMETER, "xi": STOPPED_RESISTANCE, "density": rho})
    if "fall" in params:  # head - fall * Q**2, in m3/s
        return _signed_root((params["head"] * pump_ratio(params) ** 2 - (p_out - p_in) / (rho * GRAVITY)) / params["fall"])
    if "curve" not in params:
        params["curve"] = pump_curve(params)
    return profiles.flow_at(params["curve"], (p_out - p_in) / (rho * GRAVITY), pump_ratio(params)) / HOUR


def pump_power(flow: float, params: dict) -> float:
    """Watts that a running pump takes: lifting the flow by its head, over its efficiency."""
    rate = flow * HOUR
    head = profiles.head_at(params.get("curve") or pump_curve(params), rate, pump_ratio(params))
    efficiency = sum(c * rate**i for i, c in enumerate(params["efficiency_characteristic"]))
    return params.get("density", 850.0) * GRAVITY * head * flow / efficiency


LAWS: dict[str, Callable[[float, float, dict], float]] = {"resistance": quadratic_law, "local": local_law, "valve": local_law, "check_valve": local_law, "pipe": pipe_law, "pump": pump_law}

#: Fixed value: kinds that a closing cuts in two.
SPLITTABLE = frozenset(["local", "valve", "check_valve"])
#: A part of more unknown pressures than this is solved by conjugate gradients over its edges, a smaller one by elimination.
ELIMINATE = 300


def is_closed(e: dict) -> bool:
    return e["kind"] in SPLITTABLE and (e.get("params") or {}).get("opening", 1.0) <= OPEN_ABOVE


@dataclass
class Part:
    """A connected part of a network without its closed edges: numbers of its vertices, edges between them, given pressures and inflows."""

    vertices: list
    edges: list[dict] = field(default_factory=list)
    given: dict = field(default_factory=dict)
    inflow: dict = field(default_factory=dict)


def split(edges: list[dict]) -> list[Part]:
    """The parts that closed objects leave, in order of their smallest vertex."""
    root: dict = {}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for e in edges:
        ends = [v for v in (e["from_v"], e["to_v"]) if v is not None]
        for v in ends:
            root.setdefault(v, v)
        if len(ends) == 2 and not is_closed(e):
            a, b = find(ends[0]), find(ends[1])
            root[max(a, b)] = min(a, b)
    parts = {}
    for v in sorted(root):
        parts.setdefault(find(v), Part([])).vertices.append(v)
    for e in edges:
        ends = [v for v in (e["from_v"], e["to_v"]) if v is not None]
        part = parts[find(ends[0])]
        if len(ends) == 2:
            if not is_closed(e):
                part.edges.append(e)
        elif e.get("pressure") is not None:
            part.given[ends[0]] = float(e["pressure"])
        elif e.get("flow"):
            part.inflow[ends[0]] = part.inflow.get(ends[0], 0.0) + (1.0 if e["from_v"] is None else -1.0) * float(e["flow"])
    return list(parts.values())


def _solved(size: int, a: np.ndarray, b: np.ndarray, slope_in: np.ndarray, slope_out: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The Newton step: a and b are the places of edges' ends among the unknown pressures, -1 for a given one."""
    if size > ELIMINATE and np.allclose(slope_in, -slope_out, rtol=1e-6):
        x, inner = np.zeros(size), (a >= 0, b >= 0)
        diagonal = np.zeros(size)
        np.add.at(diagonal, a[inner[0]], slope_in[inner[0]])
        np.add.at(diagonal, b[inner[1]], slope_in[inner[1]])

        def times(v):
            through = slope_in * (np.where(inner[0], v[a], 0.0) - np.where(inner[1], v[b], 0.0))
            out = np.zeros(size)
            np.add.at(out, a[inner[0]], through[inner[0]])
            np.add.at(out, b[inner[1]], -through[inner[1]])
            return out

        left = r.copy()
        z = left / diagonal
        way, now = z.copy(), left @ z
        for _ in range(10 * size):
            if np.abs(left).max() <= 1e-13 * max(1e-300, np.abs(r).max()):
                break
            moved = times(way)
            share = now / (way @ moved)
            x += share * way
            left -= share * moved
            z = left / diagonal
            now, before = left @ z, now
            way = z + now / before * way
        return x
    jacobian = np.zeros((size, size))
    for v, sign in ((a, -1.0), (b, 1.0)):
        for w, slope in ((a, slope_in), (b, slope_out)):
            both = (v >= 0) & (w >= 0)
            np.add.at(jacobian, (v[both], w[both]), sign * slope[both])
    return np.linalg.solve(jacobian, -r)


def root_coefficient(e: dict) -> float:
    """What the signed root of the drop is multiplied by, if that is the edge's law; not a number otherwise."""
    params, law = e.get("params") or {}, LAWS[e["kind"]]
    if law is quadratic_law:
        return 1 / math.sqrt(params["resistance"])
    if law is local_law and params.get("opening", 1.0) > OPEN_ABOVE:
        return math.pi * params["diameter"] ** 2 / 4 * math.sqrt(2 / (params["xi"] * params.get("density", 850.0)))
    return 0.0 if law is local_law else math.nan


def solve_part(part: Part, spread: float = 0.0, start: dict | None = None) -> tuple[dict, dict, bool]:
    """(pressure by vertex, flow by edge, whether it converged) of a part with a given pressure, by Newton's method.

    Unknown pressures are numbered first. Slopes are taken over a reach that
    starts wide and shrinks each round, as roots are steep at rest. Steps are
    halved while they don't lessen the residual; once converged, a few full steps
    with close slopes follow as long as they lessen it.
    """
    unknown = [v for v in part.vertices if v not in part.given]
    place = {v: i for i, v in enumerate(unknown)}
    known = {v: p for v, p in part.given.items()}
    inflow = np.array([part.inflow.get(v, 0.0) for v in unknown])
    a, b = (np.array([place.get(e[c], -1) for e in part.edges], int) for c in ("from_v", "to_v"))
    fixed = [np.array([known.get(e[c], 0.0) for e in part.edges]) for c in ("from_v", "to_v")]
    rng = np.random.default_rng(10)
    x = np.array([(start or {}).get(v, float(np.mean(list(known.values())))) for v in unknown]) + spread * (rng.random(len(unknown)) - 0.5)

    def ends(x):
        return np.where(a >= 0, x[a] if len(x) else 0.0, fixed[0]), np.where(b >= 0, x[b] if len(x) else 0.0, fixed[1])

    def law(i, p, q):
        e = part.edges[i]
        if e.get("params") is None:
            e["params"] = {}
        return LAWS[e["kind"]](float(p), float(q), e["params"])

    root = np.array([root_coefficient(e) for e in part.edges])
    others = np.flatnonzero(np.isnan(root)).tolist()

    def flows(p, q):
        drop = p - q
        out = root * np.sign(drop) * np.sqrt(np.abs(drop))
        for i in others:
            out[i] = law(i, p[i], q[i])
        return out

    def residual(x):
        q = flows(*ends(x))
        r = inflow.copy()
        np.add.at(r, a[a >= 0], -q[a >= 0])
        np.add.at(r, b[b >= 0], q[b >= 0])
        return r

    r, converged, last = (residual(x) if unknown else np.zeros(0)), not unknown, 0
    for i in range(NEWTON_ROUNDS if unknown else 0):
        p, q = ends(x)
        least = 1e-11 * np.maximum(np.abs(p), np.abs(q)) + 1e-9
        h = 100 * least if converged else np.maximum(least, FIRST_REACH / 4**i)
        slope_in = np.maximum((flows(p + h, q) - flows(p - h, q)) / (2 * h), LEAST_SLOPE)
        slope_out = np.minimum((flows(p, q + h) - flows(p, q - h)) / (2 * h), -LEAST_SLOPE)
        step = _solved(len(unknown), a, b, slope_in, slope_out, r)
        share = 1.0
        while share > 1e-3 and np.abs(residual(x + share * step)).sum() > np.abs(r).sum() * (1 - 1e-4 * share):
            share /= 2
        if converged and (share < 1.0 or last == LAST_STEPS):
            break
        x = x + share * step
        r = residual(x)
        last += converged
        converged |= bool(np.sqrt(((share * step / np.maximum(1, np.abs(x))) ** 2).sum()) / len(unknown) < NEWTON_STEP and np.abs(r).max() < 1e-5 * max(1.0, float(np.abs(inflow).max())))
    pressures = {v: float(known[v]) if v in known else float(x[place[v]]) for v in part.vertices}
    return pressures, {e["edge"]: law(i, pressures[e["from_v"]], pressures[e["to_v"]]) for i, e in enumerate(part.edges)}, bool(converged)


def solve_network(edges: list[dict], spread: float = 0.0, start: dict | None = None) -> tuple[dict, dict, bool]:
    """(pressure by vertex, flow by edge, whether all parts converged).

    edges have edge, from_v, to_v and either kind and params (two-sided), or,
    one-sided, pressure or flow. Closed objects cut the network, and each part
    is solved on its own. A part without a given pressure carries no flow and
    has no pressures (None); it is an error if flow is given there. A check
    valve is a resistance that is open or closed, it doesn't close by itself.
    """
    parts = split(edges)
    if not any(p.given for p in parts):
        raise ValueError("a network needs a given pressure")
    pressures, flows, converged = {}, {e["edge"]: 0.0 for e in edges}, True
    for part in parts:
        if part.given:
            p, q, fine = solve_part(part, spread, start)
            pressures |= p
            flows |= q
            converged &= fine
        elif any(part.inflow.values()):
            raise ValueError(f"flow is given but no pressure in the part of vertex {part.vertices[0]}")
        else:
            pressures |= dict.fromkeys(part.vertices)
    net = dict.fromkeys(pressures, 0.0)
    for e in edges:
        if e["from_v"] is not None and e["to_v"] is not None:
            net[e["from_v"]] -= flows[e["edge"]]
            net[e["to_v"]] += flows[e["edge"]]
    for part in parts:
        for v, q in part.inflow.items():
            net[v] += q
    shared = {}
    for e in edges:
        if (e["from_v"] is None) != (e["to_v"] is None):
            v, sign = (e["to_v"], 1.0) if e["from_v"] is None else (e["from_v"], -1.0)
            if e.get("pressure") is None:
                flows[e["edge"]] = float(e.get("flow") or 0.0)
            else:  # of several at one vertex the first brings what is missing
                flows[e["edge"]] = 0.0 if v in shared else -sign * net[v]
                shared[v] = True
    return pressures, flows, converged


@dataclass
class Solved:
    """Results of networks of one shape: which of them, names of vertices and edges, and a row of each for every network; a pressure that isn't known is not a number."""

    which: list[int]
    vertices: list
    edges: list
    pressures: np.ndarray
    flows: np.ndarray
    converged: np.ndarray


#: Numbers that the matrices of networks that are solved together have at most.
TOGETHER = 10_000_000


def _pump_flows(params: list[dict]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """pump_law() of many pumps at once: a function of the pressures at both ends and the numbers of the pumps."""
    rho = np.array([p.get("density", 850.0) for p in params], float)
    runs = np.array([bool(p.get("is_started", p.get("is_initially_started", True))) for p in params])
    ratio = np.array([pump_ratio(p) if r else 1.0 for p, r in zip(params, runs, strict=True)], float)
    falls = np.array([r and "fall" in p for p, r in zip(params, runs, strict=True)])
    head, fall = (np.array([float(p[c]) if f else 1.0 for p, f in zip(params, falls, strict=True)]) for c in ("head", "fall"))
    stopped = math.pi * STOPPED_DIAMETER**2 / 4 * np.sqrt(2 / (STOPPED_RESISTANCE * rho))
    curved = runs & ~falls
    left, middle, right, start, end = np.zeros((len(params), 2)), np.zeros((len(params), 4)), np.zeros((len(params), 2)), np.zeros(len(params)), np.zeros(len(params))
    seen: dict = {}
    for i in np.flatnonzero(curved):
        p = params[i]
        if "curve" not in p:
            given = p.get("head_characteristic")
            key = tuple(given) if given is not None else tuple(p.get(f"head_{k}") for k in range(4))
            if key not in seen:
                seen[key] = pump_curve(p)
            p["curve"] = seen[key]
        (_, start[i], left[i]), (_, end[i], middle[i]), (_, _, right[i]) = p["curve"]

    def cubic(c, x):
        return c[:, 0] + c[:, 1] * x + c[:, 2] * x**2 + c[:, 3] * x**3

    def on_curve(lift, of):
        h, c = lift / ratio[of] ** 2, middle[of]
        first, last = (h - left[of, 0]) / left[of, 1], (h - right[of, 0]) / right[of, 1]
        a, b = start[of].copy(), end[of].copy()
        inside = (cubic(c, b) <= h) & (h <= cubic(c, a))
        for _ in range(200):
            m = (a + b) / 2
            over = cubic(c, m) > h
            low, high = np.where(over, m, a), np.where(over, b, m)
            if (low == a).all() and (high == b).all():
                break
            a, b = low, high
        none = ~((first <= start[of]) | inside | (last >= end[of]))
        if none.any():
            raise ValueError("no flow has this head")
        return np.where(first <= start[of], first, np.where(inside, (a + b) / 2, last)) * ratio[of] / HOUR

    def flows(p, q, of):
        drop = p - q
        lift = -drop / (rho[of] * GRAVITY)
        rest = (head[of] * ratio[of] ** 2 - lift) / fall[of]
        out = np.where(falls[of], np.sign(rest) * np.sqrt(np.abs(rest)), stopped[of] * np.sign(drop) * np.sqrt(np.abs(drop)))
        on = np.flatnonzero(curved[of])
        if len(on):
            out[on] = on_curve(lift[on], of[on])
        return out

    return flows


def _each_flow(law: Callable, params: list[dict]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    return lambda p, q, of: np.array([law(float(x), float(y), params[i]) for x, y, i in zip(p, q, of, strict=True)])


def _solve_alike(part: Part, ways: list[list[dict]], given: np.ndarray, inflow: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """solve_part() of parts of one shape: (pressures by vertex, flows by edge, converged), a row for each part.

    ways has each edge of every part; given is not a number where a pressure is
    unknown, and there start is where Newton's method begins. Every part has
    its own steps, halvings and end, so it doesn't matter which ones it is
    solved with.
    """
    unknown = np.flatnonzero(np.isnan(given[0])) if len(given) else np.zeros(0, int)
    place = {v: i for i, v in enumerate(part.vertices)}
    ends = [np.array([place[e[c]] for e in part.edges], int) for c in ("from_v", "to_v")]
    slot = np.full(len(part.vertices), -1)
    slot[unknown] = np.arange(len(unknown))
    a, b = slot[ends[0]], slot[ends[1]]
    for e in (e for way in ways for e in way if e.get("params") is None):
        e["params"] = {}
    root = np.array([[root_coefficient(e) for e in way] for way in ways], float).reshape(len(ways), len(given))
    others = {}
    for j in np.flatnonzero(np.isnan(root).any(1)):
        law, params = LAWS[ways[j][0]["kind"]], [e["params"] for e in ways[j]]
        others[int(j)] = _pump_flows(params) if law is pump_law else _each_flow(law, params)
    pressures = np.where(np.isnan(given), start, given)

    def through(p, q, of):
        drop = p - q
        out = root[:, of].T * np.sign(drop) * np.sqrt(np.abs(drop))
        for j, law in others.items():
            out[:, j] = law(p[:, j], q[:, j], of)
        return out

    def at_ends(x, of):
        full = given[of]
        full[:, unknown] = x
        return full[:, ends[0]], full[:, ends[1]]

    def residual(x, of):
        q = through(*at_ends(x, of), of)
        r = inflow[of][:, unknown]
        for j in range(len(part.edges)):
            if a[j] >= 0:
                r[:, a[j]] -= q[:, j]
            if b[j] >= 0:
                r[:, b[j]] += q[:, j]
        return r

    def step_of(slope_in, slope_out, r):
        size = len(unknown)
        if size > ELIMINATE:
            return np.stack([_solved(size, a, b, slope_in[k], slope_out[k], r[k]) for k in range(len(r))])
        jacobian = np.zeros((len(r), size, size))
        for j in range(len(part.edges)):
            for v, sign in ((a[j], -1.0), (b[j], 1.0)):
                for w, slope in ((a[j], slope_in), (b[j], slope_out)):
                    if v >= 0 and w >= 0:
                        jacobian[:, v, w] += sign * slope[:, j]
        return np.linalg.solve(jacobian, -r[:, :, None])[:, :, 0]

    n = len(given)
    every = np.arange(n)
    converged, last, live = np.full(n, not len(unknown)), np.zeros(n, int), np.full(n, bool(len(unknown)))
    x = pressures[:, unknown]
    r = residual(x, every) if len(unknown) else np.zeros((n, 0))
    most_in = np.abs(inflow[:, unknown]).max(1, initial=1.0)
    for i in range(NEWTON_ROUNDS):
        of = np.flatnonzero(live)
        if not len(of):
            break
        p, q = at_ends(x[of], of)
        least = 1e-11 * np.maximum(np.abs(p), np.abs(q)) + 1e-9
        h = np.where(converged[of][:, None], 100 * least, np.maximum(least, FIRST_REACH / 4**i))
        slope_in = np.maximum((through(p + h, q, of) - through(p - h, q, of)) / (2 * h), LEAST_SLOPE)
        slope_out = np.minimum((through(p, q + h, of) - through(p, q - h, of)) / (2 * h), -LEAST_SLOPE)
        step = step_of(slope_in, slope_out, r[of])
        share, now = np.ones(len(of)), np.abs(r[of]).sum(1)
        moved = residual(x[of] + step, of)
        while True:
            over = np.flatnonzero((share > 1e-3) & (np.abs(moved).sum(1) > now * (1 - 1e-4 * share)))
            if not len(over):
                break
            share[over] /= 2
            moved[over] = residual(x[of[over]] + share[over, None] * step[over], of[over])
        ends_here = converged[of] & ((share < 1.0) | (last[of] == LAST_STEPS))
        live[of[ends_here]] = False
        go = np.flatnonzero(~ends_here)
        of, step = of[go], share[go, None] * step[go]
        x[of] += step
        r[of] = moved[go]
        last[of] += converged[of]
        near = np.sqrt(((step / np.maximum(1, np.abs(x[of]))) ** 2).sum(1)) / len(unknown) < NEWTON_STEP
        converged[of] |= near & (np.abs(r[of]).max(1) < 1e-5 * most_in[of])
    pressures[:, unknown] = x
    return pressures, through(pressures[:, ends[0]], pressures[:, ends[1]], every), converged


def _solve_shape(networks: list[list[dict]], starts: list[dict | None]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """solve_network() of networks of one shape: (vertices, pressures, flows, converged)."""
    like, n = networks[0], len(networks)
    parts = split(like)
    if not any(p.given for p in parts):
        raise ValueError("a network needs a given pressure")
    number = {id(e): j for j, e in enumerate(like)}
    vertices = [v for p in parts for v in p.vertices]
    place = {v: i for i, v in enumerate(vertices)}
    pressures, flows, net, inflow = np.full((n, len(vertices)), np.nan), np.zeros((n, len(like))), np.zeros((n, len(vertices))), np.zeros((n, len(vertices)))
    given = np.full((n, len(vertices)), np.nan)
    one_sided = [(j, place[e["to_v"] if e["from_v"] is None else e["from_v"]], 1.0 if e["from_v"] is None else -1.0) for j, e in enumerate(like) if (e["from_v"] is None) != (e["to_v"] is None)]
    for j, v, sign in one_sided:
        if like[j].get("pressure") is not None:
            given[:, v] = [w[j]["pressure"] for w in networks]
        else:
            flows[:, j] = [w[j].get("flow") or 0.0 for w in networks]
            inflow[:, v] += sign * flows[:, j]
    fine = np.ones(n, bool)
    for part in parts:
        at = [place[v] for v in part.vertices]
        if not part.given:
            if inflow[:, at].any():
                raise ValueError(f"flow is given but no pressure in the part of vertex {part.vertices[0]}")
            continue
        known = [place[v] for v in part.given]
        start = np.tile(given[:, known].mean(1)[:, None], (1, len(at)))
        for k, s in enumerate(starts):
            if s:
                start[k] = [s.get(v, start[k, 0]) for v in part.vertices]
        own = [number[id(e)] for e in part.edges]
        pressures[:, at], flows[:, own], sure = _solve_alike(part, [[w[j] for w in networks] for j in own], given[:, at], inflow[:, at], start)
        fine &= sure
    for j, e in enumerate(like):
        if e["from_v"] is not None and e["to_v"] is not None:
            net[:, place[e["from_v"]]] -= flows[:, j]
            net[:, place[e["to_v"]]] += flows[:, j]
    net += inflow
    shared: set = set()
    for j, v, sign in one_sided:
        if like[j].get("pressure") is not None:  # of several at one vertex the first brings what is missing
            flows[:, j] = 0.0 if v in shared else -sign * net[:, v]
            shared.add(v)
    return vertices, pressures, flows, fine


def solve_networks(networks: list[list[dict]], starts: list[dict | None] | None = None) -> list[Solved]:
    """solve_network() of many networks: those of one shape (edges, kinds, what is closed or given) are solved together, a row each."""
    starts = starts if starts is not None else [None] * len(networks)
    alike: dict[tuple, list[int]] = {}
    for i, edges in enumerate(networks):
        alike.setdefault(tuple((e["edge"], e["from_v"], e["to_v"], e["kind"], is_closed(e), e.get("pressure") is None) for e in edges), []).append(i)
    out = []
    for of in alike.values():
        like = networks[of[0]]
        size = max(len(like), min(ELIMINATE, 2 * len(like)) ** 2)
        most = max(1, TOGETHER // max(1, size))
        for k in range(0, len(of), most):
            which = of[k : k + most]
            vertices, pressures, flows, converged = _solve_shape([networks[i] for i in which], [starts[i] for i in which])
            out.append(Solved(which, vertices, [e["edge"] for e in like], pressures, flows, converged))
    return out


#: Rows of edges that are solved together, about.
EDGE_ROWS = 50_000


def nodal_pressures(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vertex, pressure, converged) for each scenario of edges(keys, edge, from_v, to_v, kind, params map, pressure, flow); scenarios of one shape are solved together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts in whole(batches, keys, EDGE_ROWS):
            listed = table.drop_columns(keys).to_pylist()
            none = lambda v: None if v is None or v != v else v
            for e in listed:
                e["params"], e["pressure"], e["flow"] = dict(e["params"] or {}), none(e["pressure"]), none(e["flow"])
            ends = [*firsts[1:], len(listed)]
            for s in solve_networks([listed[a:b] for a, b in zip(firsts, ends, strict=True)]):
                n, rows = len(s.vertices), pa.array(np.repeat(firsts[s.which], len(s.vertices)))
                arrays = [table[k].combine_chunks().take(rows) for k in keys]
                arrays += [pa.array(np.tile(np.array(s.vertices, np.int64), len(s.which))), pa.array(s.pressures.ravel(), from_pandas=True), pa.array(np.repeat(s.converged, n))]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "vertex", "pressure", "converged"])

    types = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)
    given = edges.select(*keys, "edge", F.col("from_v").cast("long").alias("from_v"), F.col("to_v").cast("long").alias("to_v"), "kind", "params", "pressure", "flow")
    return dealt(given, keys).mapInArrow(run, f"{types}, vertex long, pressure double, converged boolean")


def euler_profile(gradient: Callable[[int, float], float], start: float, steps: list[float], corrected: bool = False) -> list[float]:
    """Values of y' = gradient(i, y) after each step; corrected takes the mean of the slopes at both ends."""
    out = [start]
    for i, h in enumerate(steps):
        slope = gradient(i, out[-1])
        if corrected:
            slope = (slope + gradient(i + 1, out[-1] + h * slope)) / 2
        out.append(out[-1] + h * slope)
    return out
