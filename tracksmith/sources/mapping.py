"""Mapping plans: which source field goes where, in what unit, with what default. A plan becomes one select list."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import altitude_m, speed_mps

TARGETS = ("device_id", "ts_utc", "lat", "lon", "speed_mps", "heading_deg", "alt_m", "hdop", "src")

# Names that sources give to the canonical fields, and the units that a name's ending tells.
SYNONYMS = {
    "device_id": ("device_id", "device", "unit", "vehicle_id", "tracker_id", "asset_id", "id", "deviceId", "device.id"),
    "ts_utc": ("ts_utc", "timestamp", "time", "datetime", "event_time", "ts", "dateTime"),
    "lat": ("lat", "latitude", "location.lat"),
    "lon": ("lon", "lng", "longitude", "location.lng"),
    "speed_mps": ("speed_mps", "speed", "speed_kph", "speed_mph", "speed_knots", "speedKph", "vehicle.speedKph"),
    "heading_deg": ("heading_deg", "heading", "course", "bearing"),
    "alt_m": ("alt_m", "alt", "altitude", "altitude_m", "altitude_ft", "elevation"),
    "hdop": ("hdop",),
}
UNIT_ENDINGS = {"_kph": "kph", "Kph": "kph", "_mph": "mph", "_knots": "knots", "_ft": "ft"}


@dataclass(frozen=True)
class MappingPlan:
    """field_map: source to target, later ones win; unit_map: target to unit; defaults: for fields the source lacks."""

    field_map: Mapping[str, str]
    unit_map: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    vendor: str = "generic"


def field_names(schema: T.StructType, prefix: str = "") -> list[str]:
    """Names of all fields that are no structs; those inside structs with dots."""
    out = []
    for f in schema.fields:
        nested = isinstance(f.dataType, T.StructType)
        out += field_names(f.dataType, f"{prefix}{f.name}.") if nested else [prefix + f.name]  # type: ignore[arg-type]
    return out


def inferred(names: list[str], vendor: str = "generic", units: bool = True, speed_unit: str | None = None) -> MappingPlan:
    """The plan that the names suggest; with units=False no unit is read from a name."""
    field_map, unit_map = {}, {}
    for target, known in SYNONYMS.items():
        for source in known:
            match = next((n for n in names if n.lower() == source.lower()), None)
            if match is not None and match not in field_map:
                field_map[match] = target
                unit = next((u for ending, u in UNIT_ENDINGS.items() if match.endswith(ending)), None)
                if units and unit:
                    unit_map[target] = unit
                elif speed_unit and target == "speed_mps" and match.lower() == "speed":
                    unit_map[target] = speed_unit
                break
    return MappingPlan(field_map, unit_map, {} if vendor != "file" else {"src": "file"}, vendor)


#: Vendors' plans, by name: from the names of a source's fields to its plan.
VENDORS = {
    "generic": lambda names: inferred(names),
    "geotab": lambda names: inferred(names, "geotab", speed_unit="kph"),
    "samsara": lambda names: inferred(names, "samsara", speed_unit="kph"),
}


def plan_for(vendor: str, schema: T.StructType) -> MappingPlan:
    if vendor not in VENDORS:
        raise ValueError(f"Unknown vendor: {vendor}")
    return VENDORS[vendor](field_names(schema))


def mapped(df: DataFrame, plan: MappingPlan) -> dict[str, Column]:
    """A column for each target; null where neither the source nor a default gives one. src is always the vendor."""
    known = set(field_names(df.schema))
    out: dict[str, Column] = {}
    for source, target in plan.field_map.items():
        if source in known:
            out[target] = F.col(".".join(f"`{p}`" for p in source.split(".")) if source not in df.columns else f"`{source}`")
    for target, value in plan.defaults.items():
        out.setdefault(target, F.lit(value))
    for target, unit in plan.unit_map.items():
        if target in out:
            convert = altitude_m if target == "alt_m" else speed_mps
            out[target] = convert(out[target].try_cast("double"), unit)
    out["src"] = F.lit(plan.vendor)
    return {t: out.get(t, F.lit(None)) for t in TARGETS}
