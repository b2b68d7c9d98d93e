"""Settings of a fit, checked when they are made."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class FitSettings:
    """What a cuboid fit may do and when it counts as complete."""

    max_cuboids: int = 64
    resolution: int = 160
    detail_factor: float = 2.0
    tolerance: float | None = None
    target_coverage: float = 0.999
    target_surface_support: float = 0.95
    target_component_coverage: float = 0.0
    exterior_penalty: float = 2.0
    shell_layers: int = 1
    prescreen: int = 32
    finalists: int = 3
    seed: int = 0

    def __post_init__(self) -> None:
        _need(1 <= self.max_cuboids <= 4096, "max_cuboids must be from 1 to 4096")
        _need(4 <= self.resolution <= 2048, "resolution must be from 4 to 2048")
        _need(math.isfinite(self.detail_factor) and self.detail_factor > 0, "detail_factor must be positive")
        _need(self.tolerance is None or (math.isfinite(self.tolerance) and self.tolerance > 0), "tolerance must be positive")
        for name in ("target_coverage", "target_surface_support", "target_component_coverage"):
            _need(0 <= getattr(self, name) <= 1, f"{name} must be from 0 to 1")
        _need(self.target_coverage > 0, "target_coverage must be above 0")
        _need(math.isfinite(self.exterior_penalty) and self.exterior_penalty >= 0, "exterior_penalty must not be negative")
        _need(self.shell_layers >= 1 and self.prescreen >= 1 and self.finalists >= 1, "counts must be at least 1")


@dataclass(frozen=True)
class LineSettings:
    """Fitting of straight edge lines."""

    distance_factor: float = 1.5
    gap_factor: float = 4.0
    minimum_support: int = 10
    trials: int = 200
    maximum_lines: int = 64
    tangent_factor: float = 6.0
    tangent_neighbors: int = 24
    minimum_linearity: float = 0.6
    quiet_rounds: int = 3
    merge_degrees: float = 5.0

    def __post_init__(self) -> None:
        _need(self.distance_factor > 0 and self.gap_factor > 0 and self.tangent_factor > 0, "factors must be positive")
        _need(self.minimum_support >= 2 and self.trials >= 1 and self.maximum_lines >= 0, "counts are too small")
        _need(self.tangent_neighbors >= 5 and self.quiet_rounds >= 1, "counts are too small")
        _need(0 <= self.minimum_linearity <= 1 and 0 <= self.merge_degrees < 90, "linearity is a share, merge_degrees below 90")


@dataclass(frozen=True)
class SurfaceSettings:
    """Segmentation into surface regions."""

    neighbor_factor: float = 3.5
    angle_degrees: float = 25.0
    residual_factor: float = 0.75
    minimum_region: int = 20

    def __post_init__(self) -> None:
        _need(self.neighbor_factor > 0 and self.residual_factor > 0, "factors must be positive")
        _need(0 < self.angle_degrees < 90, "angle_degrees must be between 0 and 90")
        _need(self.minimum_region >= 1, "minimum_region must be at least 1")


def reconstruction_layers(shell_layers: int, spacing: float, width: float) -> int:
    return max(shell_layers, math.ceil(0.75 * spacing / width))


def check_grid(shape: tuple[int, int, int], limit_bytes: int, bytes_per_cell: int = 64) -> int:
    """Bytes a dense grid would take; raises before anything is made if that is above the limit."""
    need = shape[0] * shape[1] * shape[2] * bytes_per_cell
    _need(need <= limit_bytes, f"a grid of {shape} needs {need} bytes; {limit_bytes} are allowed")
    return need


def worker_count(workers: int) -> int:
    """0: up to 4 of the available CPUs."""
    _need(isinstance(workers, int) and not isinstance(workers, bool) and workers >= 0, "workers must be a whole number, not negative")
    return workers or min(4, len(os.sched_getaffinity(0)))


def up_rotation(axis: str) -> list[list[float]]:
    """Rotation that takes a source's up axis (one of +x -x +y -y +z -z) to +y."""
    table = {
        "+y": [[1, 0, 0], [0, 1, 0], [0, 0, 1]],
        "-y": [[1, 0, 0], [0, -1, 0], [0, 0, -1]],
        "+z": [[1, 0, 0], [0, 0, 1], [0, -1, 0]],
        "-z": [[1, 0, 0], [0, 0, -1], [0, 1, 0]],
        "+x": [[0, -1, 0], [1, 0, 0], [0, 0, 1]],
        "-x": [[0, 1, 0], [-1, 0, 0], [0, 0, 1]],
    }
    _need(axis in table, f"unknown up axis {axis}")
    return [[float(v) for v in row] for row in table[axis]]
