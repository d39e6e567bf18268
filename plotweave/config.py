"""Tunables of the contour and stroke runs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class WorkArea:
    """Drawable page or machine area in millimetres."""

    width_mm: float
    height_mm: float
    margin_mm: float
    centred: bool = True
    flip_y: bool = False


A4_PAGE = WorkArea(210.0, 297.0, 10.0, flip_y=True)
GANTRY_AREA = WorkArea(150.0, 270.0, 5.0)


@dataclass(frozen=True)
class ContourConfig:
    spacing_px: float = 15.0
    min_area: float = 20.0
    min_perimeter: float = 20.0
    mode: str = "all"
    threshold: int = 127
    corner_angle_deg: float = 140.0
    corner_window: int = 8
    corner_separation: int = 17


@dataclass(frozen=True)
class StrokeConfig:
    threshold: int = 127
    min_component_area: int = 20
    vertex_radius: int = 1
    simplify_px: float = 0.75
    segmentation_mode: str = "auto"
    model_threshold: float = 0.5
