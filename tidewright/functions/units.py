"""Units of tag values and names of measured quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.scalar import ATMOSPHERE, TECHNICAL_ATMOSPHERE, ZERO_CELSIUS

#: Unit, divisor and what is then subtracted, so that value / divisor - offset is in SI.
UNITS = [
    ("m3/s", 1.0, 0.0),
    ("m3/h-m3/s", 3600.0, 0.0),
    ("m3/h", 3600.0, 0.0),
    ("kg/m3", 1.0, 0.0),
    ("K-C", 1.0, -ZERO_CELSIUS),
    ("K", 1.0, 0.0),
    # Gauge pressures: the offset is one standard atmosphere in pascals.
    ("kgf/cm2(e)", 1 / TECHNICAL_ATMOSPHERE, -ATMOSPHERE),
    ("kgf/cm2", 1 / TECHNICAL_ATMOSPHERE, -ATMOSPHERE),
    ("kgf/cm2(a)", 1 / TECHNICAL_ATMOSPHERE, 0.0),
    ("MPa", 1e-6, 0.0),
    ("Pa", 1.0, 0.0),
    ("mm^2/s-m^2/s", 1e6, 0.0),
]

#: Quantities that are measured, flows first.
FLOWS = ["mass_flow", "vol_flow_std", "vol_flow_working"]
PROPERTIES = ["temperature", "density_working", "density_std", "viscosity_working", "sulfur", "mass_flow_improver", "vol_flow_improver", "pressure"]
MEASURED = FLOWS + PROPERTIES

#: Codes of valve states; a code that isn't here, or the first one, is an error.
VALVE_CODE_ERROR = -1
VALVE_CODES = {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def to_si(value: Column, unit: Column) -> Column:
    """value in SI; a unit that isn't in UNITS leaves it as it is."""
    divisor = F.create_map(*[F.lit(x) for u, d, _ in UNITS for x in (u, d)])
    offset = F.create_map(*[F.lit(x) for u, _, o in UNITS for x in (u, o)])
    known = F.coalesce(unit, F.lit(""))
    return value / F.coalesce(F.try_element_at(divisor, known), F.lit(1.0)) - F.coalesce(F.try_element_at(offset, known), F.lit(0.0))


def is_flow(mtype: Column) -> Column:
    return mtype.isin(FLOWS)


def is_endogenous(mtype: Column) -> Column:
    return ~is_flow(mtype)


def quantity_and_side(key: Column) -> tuple[Column, Column]:
    """The quantity and the side (Inlet, Outlet or null) that a name such as density_std_in means."""
    side = F.regexp_extract(key, r"_(in|out)$", 1)
    return F.regexp_replace(key, r"_(in|out)$", ""), F.when(side == "in", "Inlet").when(side == "out", "Outlet")


def open_by_code(code: Column) -> Column:
    """Whether a valve code means open; raises for the error code and for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in VALVE_CODES.items() for x in kv])
    state = F.try_element_at(table, code.cast("int"))
    return F.when(state.isNotNull(), state).when(code.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("no valve state has code "), code.cast("string"))).cast("boolean"))
