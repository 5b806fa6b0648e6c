"""Options of graph building and search, with the defaults and bounds that are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Highway classes that make roads.
INCLUDED_HIGHWAYS = ("trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service")
EARTH_RADIUS_M = 6371000.0
MAX_WAYS = 50_000
MAX_NATIVE_NODES = 35_000
MAX_SKETCH_POINTS, MAX_SKETCH_PARTS = 150, 10
#: Seconds, restarts and iterations of each speed preset.
PRESETS = {"fast": (5, 2, 300), "normal": (10, 3, 400), "thorough": (20, 5, 550)}


def _checked(options, bounds: dict[str, tuple[float, float]]) -> None:
    for name, (low, high) in bounds.items():
        value = getattr(options, name)
        if not low <= value <= high:
            raise ValueError(f"{name} is {value}, not within {low} and {high}")


@dataclass(frozen=True)
class GraphOptions:
    connect_by_osm_id: bool = True
    snap_endpoints: bool = False
    snap_epsilon_m: float = 3.0
    merge_roads: bool = True
    merge_distance_m: float = 20.0
    merge_angle_deg: float = 22.0
    merge_min_overlap_m: float = 100.0
    merge_min_overlap_ratio: float = 0.25
    merge_anchor_delta_m: float = 2.0
    merge_max_anchor_offset_m: float = 0.0
    split_crossings: bool = False
    prune_chains: bool = True
    prune_angle_deg: float = 10.0

    def __post_init__(self) -> None:
        _checked(self, {"snap_epsilon_m": (0, 100), "merge_distance_m": (0, 200), "merge_angle_deg": (0, 90), "merge_min_overlap_ratio": (0, 1), "prune_angle_deg": (0, 180)})

    @classmethod
    def from_dict(cls, values: dict) -> "GraphOptions":
        """Known keys override the defaults; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})


@dataclass(frozen=True)
class Weights:
    rotation: float = 0.38
    scale: float = 0.02
    shape: float = 1.0
    turn: float = 0.0
    unreachable: float = 1e6
    out_of_graph: float = 2.0
    fallback: float = 0.3
    local_offset: float = 0.5
    coverage: float = 0.35


@dataclass(frozen=True)
class SearchOptions:
    seed: int = 0
    restarts: int = 1
    iterations: int = 250
    t_start: float = 0.05
    t_end: float = 0.001
    step_translate: float = 0.08
    step_rotate: float = 0.35
    step_scale: float = 0.12
    stride: int = 5
    step_floor: float = 0.03
    local_trials: int = 4
    max_candidates: int = 5
    score_margin: float = 0.015
    diversity_min: float = 0.12
    grid_positions: int = 4
    grid_angles: int = 3
    grid_scales: int = 3

    def __post_init__(self) -> None:
        _checked(self, {"restarts": (1, 64), "iterations": (1, 20_000), "max_candidates": (1, 20), "local_trials": (1, 50)})
