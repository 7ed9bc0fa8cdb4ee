"""Settings of the engine, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Sampling, visibility and option settings. The defaults are fixed values of the data model."""

    frame_rate: int = 25
    clip_frames: int = 8
    frame_stride: int = 2
    min_visible_fraction: float = 0.7
    min_pixels: int = 500
    step_seconds: float = 0.04
    move_distance: float = 0.05
    move_degrees: float = 5.0
    mass_margin: float = 0.1
    seed: int = 42


DEFAULT = EngineConfig()
