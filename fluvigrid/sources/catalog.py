"""Product catalogue: grids, intervals, file names and encodings of the supported data products."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Grid:
    """A regular grid with its outer edges; rows count from the top, ``iy`` from the bottom."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    nx: int
    ny: int

    @property
    def resx(self) -> float:
        return (self.xmax - self.xmin) / self.nx

    @property
    def resy(self) -> float:
        return (self.ymax - self.ymin) / self.ny


@dataclass(frozen=True)
class Product:
    """A gridded product; ``bytes`` is the width of a cell in the binary file, ``first`` the first step of a year."""

    name: str
    grid: Grid
    interval: int
    first: timedelta
    time_format: str
    file_pattern: str
    phenomenon: str
    uom: str
    bytes: int = 2
    dbz: bool = False
    precision: float = 1.0
    max_value: int = 4095
    crs: str = "stereographic"
    is_sum: bool = False
    archive: str | None = None

    def steps(self, year: int) -> tuple[datetime, datetime]:
        """First and last step of a year."""
        start = datetime(year, 1, 1) + self.first
        span = datetime(year + 1, 1, 1) - start
        count = -(-int(span.total_seconds()) // self.interval)
        return start, start + timedelta(seconds=self.interval * (count - 1))

    def file_name(self, t: datetime, prediction: int | None = None) -> str:
        name = self.file_pattern.replace("%%time%%", t.strftime(self.time_format))
        return name.replace("%%prediction%%", "" if prediction is None else f"{prediction:03d}")

    def latest(self, now: datetime) -> datetime:
        """The newest step that can be there at ``now``: steps run from midnight's offset at the product's interval."""
        day = now.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=1)
        offset = timedelta(seconds=int(self.first.total_seconds()) % self.interval)
        steps = int((now - day - offset).total_seconds() // self.interval)
        return day + offset + timedelta(seconds=steps * self.interval)


# Fixed values of the published product descriptions.
EXTENT_900 = Grid(-523.4622, 376.5378, -4658.645, -3758.645, 900, 900)
EXTENT_1100 = Grid(-443.4622, 456.5378, -4758.645, -3658.645, 900, 1100)
RADAR = {
    "SF": Product("SF", EXTENT_900, 3600, timedelta(minutes=50), "%y%m%d%H%M", "raa01-sf_10000-%%time%%-dwd---bin", "precipitation", "mm/24h", 2, False, 0.1, 4095),
    "RW": Product("RW", EXTENT_900, 3600, timedelta(minutes=50), "%y%m%d%H%M", "raa01-rw_10000-%%time%%-dwd---bin", "precipitation", "mm/h", 2, False, 0.1, 4095, archive=".gz"),
    "RX": Product("RX", EXTENT_900, 300, timedelta(0), "%y%m%d%H%M", "raa01-rx_10000-%%time%%-dwd---bin", "reflectivity", "dbZ", 1, True, 1.0, 248),
    "FX": Product("FX", EXTENT_900, 300, timedelta(0), "%y%m%d%H%M", "FX%%time%%_%%prediction%%_MF002", "reflectivity", "dbZ", 2, True, 0.1, 4095, archive=".tar.bz2"),
    "YW": Product("YW", EXTENT_1100, 300, timedelta(0), "%y%m%d%H%M", "raa01-yw2017.002_10000-%%time%%-dwd---bin", "precipitation", "mm/5min", 2, False, 0.01, 4095),
}
FORECAST = {
    "tot_prec": Product("tot_prec", Grid(-0.01, 17.01, 42.99, 57.01, 851, 701), 10800, timedelta(0), "%Y%m%d%H", "%%prediction%%/tot_prec_%%time%%.grib2", "precipitation", "mm", crs="longlat", is_sum=True),
}
FULL_HORIZON_HOUR, FULL_HORIZON, SHORT_HORIZON = 3, 45, 27
#: Classes of the hourly precipitation map: lower limits, each class open below and closed above, the last without end.
PRECIPITATION_LIMITS = (0.0, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 25.0, 40.0, 60.0, 80.0)
GAUGE_PARAMETERS = ("Q_15min", "Q_1h", "Q_1d")
GAUGE_REQUEST_DAYS = 9
GAUGE_TIME_ZONE = "Europe/Berlin"


def radar(name: str) -> Product:
    if name not in RADAR:
        raise ValueError(f"unknown radar product {name!r}; there are {', '.join(RADAR)}")
    return RADAR[name]


def horizon(run_hour: int) -> int:
    """Last forecast step of a run: the 03 UTC run reaches further than the others."""
    return FULL_HORIZON if run_hour == FULL_HORIZON_HOUR else SHORT_HORIZON


def grids(spark: SparkSession) -> DataFrame:
    """The catalogue as a small dimension table."""
    rows = [(p.name, p.grid.xmin, p.grid.xmax, p.grid.ymin, p.grid.ymax, p.grid.nx, p.grid.ny, p.interval, p.phenomenon, p.uom, p.crs) for p in (*RADAR.values(), *FORECAST.values())]
    return spark.createDataFrame(rows, "product string, xmin double, xmax double, ymin double, ymax double, nx int, ny int, interval_s int, phenomenon string, uom string, crs string")
