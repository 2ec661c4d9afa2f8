"""Operator parameters with the defaults users expect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Tiling:
    """Patch size as a share of the frame, stride as a share of the patch."""

    frac: float = 0.25
    step: float = 0.5


@dataclass(frozen=True)
class Matching:
    ratio: float = 0.8
    min_matches: int = 4
    box_accuracy: float = 0.9
    reproj_threshold: float = 1.0
    max_added: int = 4
    # Bound on four-pair samples of one fit; fewer are drawn once enough pairs agree.
    max_samples: int = 2000


@dataclass(frozen=True)
class Tracking:
    min_distance: float = 5.0
    quality: float = 0.001
    every: int = 1
    length: int = 15


@dataclass(frozen=True)
class Blocks:
    """Descriptor geometry: block side, cells per axis, temporal cells, bins."""

    size: int = 32
    cells: int = 2
    t_cells: int = 3
    bins: int = 8

    @property
    def dim(self) -> int:
        return self.cells * self.cells * self.bins


@dataclass(frozen=True)
class Display:
    length: int = 15
    fps: int = 15
    window_seconds: int = 5
    last_seconds: int = 2

    @property
    def window_frames(self) -> int:
        return self.window_seconds * self.fps
