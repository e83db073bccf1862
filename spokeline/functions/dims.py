"""Dimension values of the network: routing weights, tiers, labels, styles."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cost per metre of each connection type for the profile `safest`, and the least cost of an edge of it.
WEIGHTS = {
    "MUP_P": 0.15, "MUP_U": 0.2, "BL-MUP": 0.15, "NG": 0.5, "BBL": 0.5, "BL": 1.8, "SR_LT": 1.5, "SC": 1.8, "BL-SR_LT": 1.6,
    "SR_MT": 12.0, "BL-SR_MT": 10.0, "BL_VHT": 15.0, "DC": 3.0, "SR_DC": 3.5, "BL-DC": 2.5, "SR_MT-DC": 15.0,
    "_GAP": 2.0, "_GAP_BUSY": 40.0, "_GAP_MAJOR": 200.0, "_PREF": 3.0,
}
MIN_COSTS = {"SR_MT": 1200.0, "BL-SR_MT": 800.0, "BL_VHT": 1500.0, "SR_MT-DC": 1500.0, "_GAP": 80.0, "_GAP_BUSY": 3000.0, "_GAP_MAJOR": 10000.0}
OTHER_WEIGHT, PREFERRED_WEIGHT, LEAST_WEIGHT = 3.0, 0.5, 0.15
PROFILES = {"safest": (WEIGHTS, MIN_COSTS)}
# Routing tier of each connection type; types that are not named have none.
TIERS = {
    "path": ("MUP_P", "MUP_U", "BL-MUP"), "good": ("NG", "BBL"), "lane": ("BL", "SR_LT", "SC", "BL-SR_LT"),
    "caution": ("SR_MT", "BL-SR_MT", "BL_VHT", "_GAP_BUSY"), "avoid": ("DC", "SR_DC", "BL-DC", "SR_MT-DC", "_GAP_MAJOR"), "none": ("_GAP",),
}
# Tier, style and label of the overlay.
OVERLAY_TIERS = {"best": ("MUP_P", "MUP_U", "BL-MUP"), "good": ("NG", "BBL"), "ok": ("BL", "BL-SR_LT", "SR_LT", "SC"), "avoid": ("DC", "SR_DC", "BL-DC", "SR_MT-DC")}
OVERLAY_STYLES = {"best": ("#00c853", 4, 0.85, None), "good": ("#2ecc71", 3, 0.8, None), "ok": ("#2196f3", 3, 0.75, None), "caution": ("#ff9800", 2, 0.7, None), "avoid": ("#e74c3c", 2, 0.75, "6,4")}
LABELS = {
    "MUP_P": "Multi-Use Path (Paved)", "MUP_U": "Multi-Use Path (Unpaved)", "NG": "Neighborhood Greenway", "BBL": "Buffered Bike Lane", "BL": "Bike Lane",
    "BL-MUP": "Bike Lane / Multi-Use Path", "BL-SR_LT": "Bike Lane / Shared Road (Low Traffic)", "BL-SR_MT": "Bike Lane / Shared Road (Med Traffic)",
    "BL_VHT": "Bike Lane (Very High Traffic)", "BL-DC": "Bike Lane (Difficult Connection)", "SR_LT": "Shared Road (Low Traffic)", "SR_MT": "Shared Road (Medium Traffic)",
    "SC": "Signed Connection", "SR_DC": "Shared Road (Difficult Connection)", "SR_MT-DC": "Shared Road (Med Traffic, Difficult)", "DC": "Difficult Connection",
}
# Road classes of major severity; every other class is secondary.
MAJOR_ROADS = ("trunk", "trunk_link", "primary", "primary_link", "motorway", "motorway_link")
ROAD_CLASSES = ("trunk", "primary", "secondary", "motorway", "trunk_link", "primary_link", "secondary_link", "motorway_link")


def lookup(values: dict, key: Column) -> Column:
    """The value of a key in a small fixed table, null if it has none."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def edge_cost(distance: Column, ct: Column, profile: str = "safest") -> Column:
    weights, least = PROFILES[profile]
    return F.greatest(distance * F.coalesce(lookup(weights, ct), F.lit(OTHER_WEIGHT)), F.coalesce(lookup(least, ct), F.lit(0.0)))


def _by_kind(kinds: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {ct: kind for kind, cts in kinds.items() for ct in cts}


def routing_tier(ct: Column) -> Column:
    return lookup(_by_kind(TIERS), ct)


def overlay_tier(ct: Column) -> Column:
    return F.coalesce(lookup(_by_kind(OVERLAY_TIERS), F.upper(F.coalesce(ct, F.lit("")))), F.lit("caution"))


def severity_rank(highway: Column) -> Column:
    """2 major, 1 secondary."""
    return F.when(highway.isin(*MAJOR_ROADS), 2).otherwise(1)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 2, "major").when(rank == 1, "secondary")
