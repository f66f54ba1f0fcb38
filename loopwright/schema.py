"""Relations, tunables and fixed values of the library.

Every relation has an `area` column: areas are independent, and so are (area, seed, weights) runs of the solver; they are the
unit of parallel work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

POINT = "struct<lat:double,lon:double>"
HOUSES = "area string, house_id string, ord int, lat double, lon double, label string, street string, flagged boolean, manual boolean"
NODES = "area string, node_id bigint, ord int, lat double, lon double"
WAYS = "area string, way_id bigint, way_ord int, name string, highway string, nodes array<bigint>"
ELEMENTS = "array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
FEATURES = "array<struct<attributes:struct<PIN:string,SiteAddress:string,UseCodeDescription:string>,geometry:struct<rings:array<array<array<double>>>>>>"

UNASSIGNED = -1
UNREACHABLE = 1e6
SAME_STREET_TOLERANCE_M = 15.0
DEFAULT_LINK_M = 80.0
COMPACT_K, NEIGHBORS, MAX_RUN = 6, 8, 6
COMPACT_SPACING_M, SIZE_SOFT_M = 30.0, 3.0
MAX_HISTORY = 100
# Fixed values of the annealing: up to which draw a change is one house, a run, all mates (else a swap); tries and changes that set the first
# temperature, its share of their mean (or of the score, without any), the last temperature in parts of it, restarts from the best.
ONE_HOUSE, RUN_OF_MATES, ALL_MATES = 0.45, 0.7, 0.9
HEAT_TRIES, HEAT_CHANGES, HEAT_SHARE, HEAT_OF_SCORE, COLD, RESTARTS = 400, 50, 0.2, 0.001, 0.001, 8
PROJECT_VERSION = 1


@dataclass(frozen=True)
class Weights:
    maxRoute: float = 1.0
    total: float = 0.3
    toleranceFrac: float = 0.1
    tolerance: float = 2.0
    compact: float = 2.5


@dataclass(frozen=True)
class Config:
    groups: int = 6
    crossingPenalty: float = 8.0
    iterations: int = 8000
    seed: int = 1
    walkSpeed: float = 1.2
    secPerHouse: float = 20.0
    weights: Weights = field(default_factory=Weights)


def effective_tolerance(mean: float, weights: Weights) -> float:
    finite = lambda x: max(0.0, x) if math.isfinite(x) else 0.0
    return max(finite(weights.tolerance), math.floor(finite(weights.toleranceFrac) * max(0.0, mean)))


# Limits of the configuration in saved projects: lowest, highest, whole numbers only.
CONFIG_LIMITS = {
    "groups": (2, 12, True),
    "iterations": (0, 200000, True),
    "crossingPenalty": (0, 1000, False),
    "seed": (-(2**53 - 1), 2**53 - 1, True),
    "walkSpeed": (0.1, 5, False),
    "secPerHouse": (0, 600, False),
}
WEIGHT_LIMITS = {"toleranceFrac": (0, 1), "tolerance": (0, 20), "compact": (0, 100)}
