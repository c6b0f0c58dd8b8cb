"""Column roles and settings shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Columns:
    """Names of the roles an operator may need; pass a copy to use other names."""

    id: str = "id"
    unit: str = "unit"
    state: str = "state"
    date: str = "dt"
    year: str = "year"
    month: str = "month"
    quarter: str = "quarter"
    week: str = "week"
    target: str = "loss"
    weight: str = "weight"
    lat: str = "lat"
    lon: str = "lon"
    category: str = "category"
    station: str = "station"
    population: str = "population"
    cell: str = "cell"

    @property
    def unit_keys(self) -> list[str]:
        return [self.state, self.unit]

    @property
    def unit_year_keys(self) -> list[str]:
        return [self.state, self.unit, self.year]

    @property
    def time(self) -> list[str]:
        return [self.year, self.month]


@dataclass(frozen=True)
class Settings:
    """The defaults a run uses when a caller gives none."""

    max_lag: int = 12
    rolling_windows: tuple[int, ...] = (3, 6, 12)
    ema_span: int = 6
    cell_resolution: int = 6
    train_years: tuple[int, ...] = (2021, 2022, 2023)
    val_years: tuple[int, ...] = (2024,)
    test_years: tuple[int, ...] = (2025, 2026)
    cv_splits: int = 5
    cv_gap: int = 1
    background_rows: int = 100
    display_features: int = 20
    top_hotspots: int | None = None  # all cells
    map_cells: int = 500  # of one map document
    top_units: int = 20
    cache_ttl_seconds: int = 300
    refresh_seconds: int = 900
    requests_per_minute: int = 100
    unit_year_cap: int = 400
    category_first_year: int = 2021


COLUMNS = Columns()
SETTINGS = Settings()
