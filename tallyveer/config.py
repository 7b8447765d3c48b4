"""Parameters of an analysis run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from tallyveer.schema import ATTRIBUTION_DIMENSIONS, METRIC_LABELS


@dataclass(frozen=True)
class AnalysisConfig:
    """All knobs in one immutable record.

    ``series_keys`` partitions every operator: with ``("region",)`` each region
    gets its own scorecard, drivers, forecast and advice in the same job.
    """

    series_keys: tuple[str, ...] = ()
    metrics: tuple[str, ...] = tuple(METRIC_LABELS)
    dimensions: tuple[str, ...] = ATTRIBUTION_DIMENSIONS

    # windows
    lookback: int = 14
    min_dates: int = 10
    as_of: dt.date | None = None

    # "ratio" = daily revenue / daily orders; "sum_of_groups" = sum of the
    # per-group ratios of the rolled-up fact
    aov: str = "ratio"

    # detection
    contamination: float = 0.08
    # points that represent a series in its isolation scores, at every length
    grid_points: int = 256
    score_critical: float = -0.15
    score_warning: float = -0.05
    change_critical: float = -20.0
    change_warning: float = -10.0

    # attribution
    min_share_pct: float = 5.0
    min_incident_loss: float = 100.0
    min_holiday_delta: float = 1.0
    # drivers a series' document lists, best first; None lists all. With a number
    # the document also tells how many there are and whether it leaves some out
    document_drivers: int | None = None

    # forecast
    horizon: int = 7
    trend_rows: int = 60
    stable_pct: float = 0.5
    band_sigma: float = 1.5
    band_relative: float = 0.05
    # "all" floors centre and both bounds at zero, "lower" only the lower bound
    clip: str = "all"
    # "linear_trend", "trend_weekday" or "piecewise_weekly"
    model: str = "linear_trend"
    # piecewise_weekly: knots of the trend, and how strongly changes and weekly waves are shrunk
    change_points: int = 8
    change_penalty: float = 0.05
    wave_penalty: float = 0.01

    def __post_init__(self) -> None:
        if self.aov not in ("ratio", "sum_of_groups"):
            raise ValueError(f"aov must be 'ratio' or 'sum_of_groups', not {self.aov!r}")
        if self.clip not in ("all", "lower"):
            raise ValueError(f"clip must be 'all' or 'lower', not {self.clip!r}")
        if self.model not in ("linear_trend", "trend_weekday", "piecewise_weekly"):
            raise ValueError(f"unknown forecast model {self.model!r}")
        if self.change_points < 1 or min(self.change_penalty, self.wave_penalty) <= 0:
            raise ValueError("change_points must be at least 1, penalties above 0")
        if self.lookback < 1 or self.horizon < 1 or self.trend_rows < 2:
            raise ValueError("lookback and horizon need at least 1 row, trend_rows at least 2")
        if self.document_drivers is not None and self.document_drivers < 0:
            raise ValueError("document_drivers must be None (all) or at least 0")
        if not 0.0 < self.contamination <= 0.5:
            raise ValueError("contamination must lie in (0, 0.5]")
        unknown = set(self.metrics) - set(METRIC_LABELS)
        if unknown:
            raise ValueError(f"unknown metrics {sorted(unknown)}")

    def with_(self, **changes: object) -> AnalysisConfig:
        return replace(self, **changes)
