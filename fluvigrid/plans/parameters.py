"""Parameter tables of the water-balance model: land cover and flow."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LandCover:
    relht: tuple[float, ...]
    rellai: tuple[float, ...]
    alb: float
    albsn: float
    ksnvp: float
    z0g: float
    maxht: float
    maxlai: float
    mxrtln: float
    mxkpl: float
    fxylem: float
    glmax: float
    lwidth: float
    cr: float
    rootden: tuple[float, ...]


# Land-cover classes; day-value pairs for height and leaf area, root shares of layers of 100 mm.
_FOREST_ROOTS = (0.22, 0.17, 0.13, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.02, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01)
_SUMMER = (1, 0, 100, 0, 213, 1, 278, 1, 308, 0, 366, 0)
LAND_COVER = {
    "Coniferous Forest": LandCover((1, 1, 366, 1), (1, 1, 366, 1), 0.14, 0.14, 0.3, 0.02, 25, 6, 3100, 8, 0.5, 0.53, 0.004, 0.5, _FOREST_ROOTS),
    "Grass Land": LandCover((1, 0.1, 115, 0.1, 145, 1, 268, 1, 298, 1, 366, 0.1), (1, 0, 115, 0, 145, 1, 268, 1, 298, 0, 366, 0), 0.2, 0.5, 1, 0.01, 0.5, 3, 1000, 8, 0, 0.8, 0.01, 0.7, (0.44, 0.25, 0.14, 0.08, 0.04, 0.02, 0.01, 0.01)),
    "Cultivated": LandCover(_SUMMER, _SUMMER, 0.22, 0.5, 1, 0.005, 0.3, 3, 110, 8, 0, 1.1, 0.1, 0.7, (0.34, 0.22, 0.15, 0.1, 0.07, 0.04, 0.03, 0.02, 0.1, 0.1, 0.1, 0.1)),
    "Deciduous Forest": LandCover((1, 1, 366, 1), (1, 0, 54, 0, 84, 1, 299, 1, 329, 0, 366, 0), 0.18, 0.23, 0.3, 0.02, 25, 6, 3000, 8, 0.5, 0.53, 0.1, 0.6, _FOREST_ROOTS),
}
#: Depth of direct infiltration (mm) and its exponent; all other flow paths are closed and drainage is free.
FLOW = {"topdown": (0.0, 0.0), "uni500": (500.0, 1.0)}


def land_cover(name: str) -> LandCover:
    if name not in LAND_COVER:
        raise ValueError(f"unknown land cover {name!r}; there are {', '.join(LAND_COVER)}")
    return LAND_COVER[name]


def flow(name: str) -> tuple[float, float]:
    if name not in FLOW:
        raise ValueError(f"unknown flow {name!r}; there are {', '.join(FLOW)}")
    return FLOW[name]
