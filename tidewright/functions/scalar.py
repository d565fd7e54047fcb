"""Scalar laws of flow measurement and pipe hydraulics as Column expressions.

Everything here stays inside whole-stage code generation; nothing calls Python
on the executors. Arguments are columns or numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gravity, 0 degrees Celsius, the standard and the technical atmosphere.
GRAVITY = 9.81
ZERO_CELSIUS = 273.15
ATMOSPHERE = 101325.0
TECHNICAL_ATMOSPHERE = 98067.0
#: A cell is confident above the first; a valve is open above the second; a hydraulic source is at rest up to the third.
CONFIDENT = 0.95
OPEN_ABOVE = 1e-3
AT_REST = 1e-12
#: The temperatures, in kelvins, of a three-point viscosity table.
VISCOSITY_POINTS = (273.15, 293.15, 323.15)


def col(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def sgn(x) -> Column:
    return F.signum(col(x))


def pseudo_sgn(x) -> Column:
    """Sign with zero counted as positive."""
    return F.when(col(x) >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def sqr(x) -> Column:
    return col(x) * col(x)


def ssqrt(x) -> Column:
    """Square root that keeps the sign."""
    return sgn(x) * F.sqrt(F.abs(col(x)))


def ssqr(x) -> Column:
    """Square that keeps the sign."""
    return sgn(x) * sqr(x)


def is_finite(x) -> Column:
    """Neither null, NaN nor infinite."""
    c = col(x)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def lerp(a, b, share) -> Column:
    return col(a) * (1 - col(share)) + col(b) * col(share)


def polyval(coefficients: Column, x) -> Column:
    """Sum of coefficients[i] * x**i over an array, by Horner's rule from the highest power down."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * col(x) + c)


def poly_integral(coefficients: Column) -> Column:
    """Coefficients of the integral that is zero at zero."""
    return F.concat(F.array(F.lit(0.0)), F.transform(coefficients, lambda c, i: c / (i + 1)))


def range_index(ends: Column, x) -> Column:
    """Index of the first range whose end is above x; null beyond the last."""
    return F.array_min(F.filter(F.transform(ends, lambda e, i: F.when(col(x) < e, i)), lambda i: i.isNotNull()))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def in_range(x, a, b) -> Column:
    """Within the closed range of a and b in either order."""
    return col(x).between(F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def circle_area(diameter) -> Column:
    return F.lit(math.pi) * sqr(diameter) / 4


def local_resistance_flow(p_in, p_out, density, diameter, resistance) -> Column:
    """Volume flow through a local resistance; negative against a higher outlet pressure."""
    return circle_area(diameter) * ssqrt(2.0 * (col(p_in) - col(p_out)) / (col(resistance) * col(density)))


def local_resistance_loss(flow, density, diameter, resistance) -> Column:
    """Pressure loss of a local resistance at a given flow: the inverse of local_resistance_flow."""
    return col(resistance) * col(density) / 2 * ssqr(col(flow) / circle_area(diameter))


def friction_shifrinson(roughness) -> Column:
    return 0.11 * F.pow(col(roughness), F.lit(0.25))


def friction_altshul(reynolds, roughness) -> Column:
    return 0.11 * F.pow(col(roughness) + 68 / col(reynolds), F.lit(0.25))


def friction_isaev(reynolds, roughness) -> Column:
    """Friction factor over all regimes: laminar, a smoothed passage, then Isaev's turbulent formula."""
    re = F.abs(col(reynolds))
    share = 1 - F.exp(-0.002 * (re - 2320))
    passage = 64 / re * (1 - share) + 0.3164 / F.pow(re, F.lit(0.25)) * share
    turbulent = 1 / sqr(-1.8 * F.log10(6.8 / re + F.pow(col(roughness) / 3.7, F.lit(1.1))))
    return F.when(re < 1, F.lit(64.0)).when(re < 2320, 64 / re).when(re < 4000, passage).otherwise(turbulent)


def drag_reduction(kind: str, coefficients: list[float], concentration) -> Column:
    """Effectiveness of a drag-reducing additive by one of four formulas."""
    c = col(concentration)
    if kind == "polynomial":
        if not coefficients:
            raise ValueError("a polynomial needs coefficients")
        return polyval(F.array(*[F.lit(float(a)) for a in coefficients]), c)
    if len(coefficients) != 2:
        raise ValueError(f"{kind} needs two coefficients")
    a, b = coefficients
    if kind == "virk":
        return a * (b * c) / (1 + b * c)
    if kind == "virk_modified":
        return c / (a + b * c)
    if kind == "potential":
        return a * F.pow(c, F.lit(b))
    raise ValueError(f"unknown formula {kind}")


def density_at(nominal, compression, pressure, nominal_pressure) -> Column:
    return col(nominal) * (1 + col(compression) * (col(pressure) - col(nominal_pressure)))


def wall_compression(diameter, poisson, elasticity, thickness) -> Column:
    return col(diameter) * (1 - sqr(poisson)) / (col(elasticity) * col(thickness))


def sound_velocity(density, wall, fluid) -> Column:
    """Wave speed from the density and the compression ratios of wall and fluid."""
    return F.sqrt(1 / (col(density) * (col(wall) + col(fluid))))


def viscosity_filonov(viscosity, temperature0, coefficient, temperature) -> Column:
    return col(viscosity) * F.exp(-col(coefficient) * (col(temperature) - col(temperature0)))


def viscosity_coefficient(v1, t1, v2, t2) -> Column:
    """The temperature coefficient of viscosity_filonov through two points."""
    return F.ln(col(v1) / col(v2)) / (col(t2) - col(t1))


def viscosity_model(v0, v20, v50) -> Column:
    """struct(kind, a, b, c) of a curve through viscosities at 0, 20 and 50 degrees Celsius.

    constant: a. filonov: a * exp(-b * (T - 20 C)). vogel: a * exp(c / (T - b)).
    """
    t0, t1, t2 = VISCOSITY_POINTS
    first, second = F.ln(col(v0) / col(v20)), F.ln(col(v20) / col(v50))
    bend = (t2 - t1) / (t1 - t0) * first / second
    theta = (t2 - bend * t0) / (1 - bend)
    none = F.lit(None).cast("double")

    def model(kind: str, a: Column, b: Column = none, c: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("double").alias("a"), b.alias("b"), c.alias("c"))

    flat = (F.abs(col(v50) / col(v0) - 1) < 1e-4) & (F.abs(col(v20) / col(v50) - 1) < 1e-4)
    return (
        F.when(flat, model("constant", col(v0)))
        .when(F.abs(bend - 1) < 1e-4, model("filonov", col(v20), first / (t1 - t0)))
        .otherwise(model("vogel", col(v50) * F.pow(col(v50) / col(v0), 1 / (bend - 1)), theta, (t0 - theta) * (t1 - theta) / (t1 - t0) * first))
    )


def viscosity_of(model: Column, temperature) -> Column:
    t = col(temperature)
    return (
        F.when(model["kind"] == "constant", model["a"])
        .when(model["kind"] == "filonov", model["a"] * F.exp(-model["b"] * (t - VISCOSITY_POINTS[1])))
        .otherwise(model["a"] * F.exp(model["c"] / (t - model["b"])))
    )


def viscosity_adapted(table: Column, working, temperature) -> Column:
    """An array of three viscosities, scaled so that its curve meets the working point."""
    factor = col(working) / viscosity_of(viscosity_model(table[0], table[1], table[2]), temperature)
    return F.transform(table, lambda v: v * factor)


def shukhov_temperature(start, ambient, heat_transfer, diameter, capacity, mass_flow, x) -> Column:
    """Temperature of the fluid after x metres of a pipe that gives heat to its surroundings."""
    return col(ambient) + (col(start) - col(ambient)) * F.exp(-F.lit(math.pi) * col(heat_transfer) * col(diameter) * col(x) / (col(capacity) * F.abs(col(mass_flow))))


def thermal_diffusivity(conductivity, density, capacity) -> Column:
    return col(conductivity) / (col(density) * col(capacity))


def diffusion_coefficient(friction, velocity, diameter) -> Column:
    """Longitudinal mixing in a pipe."""
    return 3.211 * F.sqrt(col(friction)) * col(velocity) * col(diameter)


def pressure_gradient(flow, density, viscosity, diameter, roughness, slope) -> Column:
    """dp/dx of a pipe at a given flow: friction and the slope of its profile."""
    velocity = col(flow) / circle_area(diameter)
    friction = friction_isaev(velocity * col(diameter) / col(viscosity), roughness)
    return -friction / col(diameter) * col(density) * ssqr(velocity) / 2 - col(density) * GRAVITY * col(slope)


def displacement_time(length, diameter, flow) -> Column:
    """Seconds in which a flow replaces what a pipe holds."""
    return col(length) * circle_area(diameter) / col(flow)


def argument_increment(steps: Column, arguments: Column) -> Column:
    """Size of a step against the arguments, each by at least 1, over their number."""
    parts = F.zip_with(steps, arguments, lambda d, x: d / F.greatest(F.lit(1.0), F.abs(x)))
    return F.sqrt(inner_product(parts, parts)) / F.size(steps)


def flag_text(flag: Column) -> Column:
    """Text of a boolean that may be unknown."""
    return F.when(flag.isNull(), "undefined").when(flag, "true").otherwise("false")


def fix_small(weight) -> Column:
    """Weights near zero are moved off it by 1e-8 in their own direction."""
    w = col(weight)
    return F.when(F.abs(w) < 1e-8, w + pseudo_sgn(w) * 1e-8).otherwise(w)
