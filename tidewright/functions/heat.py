"""Heat of pipes: stationary profiles and explicit steps, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.scalar import circle_area, col, friction_shifrinson

#: The radiation constant as these models have it, emissivities of both walls, and the part of conduction.
RADIATION, EMISSIVITY, CONDUCTION_PART = 5.76e-8, 0.075, 0.04


def friction_heating(mass_flow, density, diameter, roughness, heat_transfer) -> Column:
    """By how much friction lifts the temperature that a fluid tends to above its surroundings."""
    velocity = col(mass_flow) / (circle_area(diameter) * col(density))
    return friction_shifrinson(roughness) * col(density) * F.pow(F.abs(velocity), F.lit(3.0)) / (8 * col(heat_transfer))


def shukhov(start, ambient, mass_flow, density, capacity, diameter, roughness, heat_transfer, x) -> Column:
    """Temperature after x metres: an exponential passage from start to the surroundings, friction included."""
    tends = col(ambient) + friction_heating(mass_flow, density, diameter, roughness, heat_transfer)
    return tends + (col(start) - tends) * F.exp(-math.pi * col(diameter) * col(heat_transfer) * col(x) / (col(capacity) * F.abs(col(mass_flow))))


def shukhov_profile(n: Column, dx, **pipe) -> Column:
    """Array of shukhov() at 0, dx, ... of n points."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: shukhov(x=i * col(dx), **pipe))


def layer_transfer(diameter, thickness, conductivity) -> Column:
    """Heat transfer coefficient of a cylindrical layer, at its inner wall."""
    return 2 * col(conductivity) / (col(diameter) * F.ln((col(diameter) + 2 * col(thickness)) / col(diameter)))


def conducted(inner, outer, diameter, thickness, conductivity) -> Column:
    return -layer_transfer(diameter, thickness, conductivity) * (col(inner) - col(outer))


def radiated(inner, outer, diameter, thickness, emissivity_in=EMISSIVITY, emissivity_out=EMISSIVITY) -> Column:
    ratio = col(diameter) / (col(diameter) + 2 * col(thickness))
    reduced = 1 / (1 / col(emissivity_in) + ratio * (1 / col(emissivity_out) - 1))
    return -reduced * RADIATION * (F.pow(col(inner), F.lit(4.0)) - F.pow(col(outer), F.lit(4.0)))


def conducted_and_radiated(inner, outer, diameter, thickness, conductivity, part=CONDUCTION_PART) -> Column:
    return conducted(inner, outer, diameter, thickness, conductivity) * col(part) + radiated(inner, outer, diameter, thickness) * (1 - col(part))


def soil_flow(fluid, soil, ambient, a, b, c, f) -> Column:
    """Heat flow of the two-part soil model: from the fluid's and the soil's rise above the surroundings."""
    return (col(a) + col(b) * col(c)) * (col(fluid) - col(ambient)) + col(f) * col(b) * (col(soil) - col(ambient))


def soil_step(fluid, soil, ambient, c, f, dt) -> Column:
    """Mean temperature of the soil after dt."""
    return col(soil) + col(dt) * (col(c) * (col(fluid) - col(ambient)) + col(f) * (col(soil) - col(ambient)))


def fluid_step(temperature, heat_flow, mass_flow, density, capacity, diameter, roughness, dt) -> Column:
    """Temperature of a fluid particle after dt, by which time it is one cell further on."""
    velocity = col(mass_flow) / (circle_area(diameter) * col(density))
    source = 4 * col(heat_flow) / (col(density) * col(capacity) * col(diameter)) + friction_shifrinson(roughness) * F.pow(velocity, F.lit(3.0)) / (2 * col(capacity) * col(diameter))
    return col(temperature) + col(dt) * source
