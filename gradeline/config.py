"""Settings of a search, with the reference values of its flags as defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Units, and the constants of search and scoring.
EARTH_M = 6_371_000.0
KM_PER_DEGREE = 111.0
MILE_M = 1609.34
FOOT_PER_M = 3.28084
FEET_PER_MILE = 5280.0
PENALTY_FAR, PENALTY_NONE = 2.5, 3.0
ROAD_RADII_M = (300.0, 1000.0, 2500.0)
CACHE_DAYS = 30
GRADE_BANDS = (
    (-100.0, 0.0, "<0%"),
    (0.0, 2.0, "0-2%"),
    (2.0, 4.0, "2-4%"),
    (4.0, 6.0, "4-6%"),
    (6.0, 8.0, "6-8%"),
    (8.0, 10.0, "8-10%"),
    (10.0, 100.0, "10%+"),
)


@dataclass(frozen=True)
class MatchConfig:
    """What a search looks for. Fields that make no sense raise ValueError."""

    lat: float = 40.0
    lon: float = -105.3
    radius_km: float = 15.0
    box_km: float = 4.0
    min_window_frac: float = 0.75
    max_window_frac: float = 1.15
    length_steps: int = 7
    start_step_frac: float = 0.02
    least_step_m: float = 10.0
    max_segment_mult: float = 3.0
    grade_bin_mi: float = 0.25
    access_check: bool = True
    access_near_m: float = 400.0
    access_far_m: float = 1200.0
    weight_shape: float = 1.0
    weight_distribution: float = 0.6
    weight_gain: float = 4.0
    emd_points: int = 100
    top: int = 10
    reversible: bool = True
    activity_type: str = "running"
    exact_roads: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.min_window_frac <= self.max_window_frac:
            raise ValueError("min_window_frac must be positive and at most max_window_frac")
        if min(self.weight_shape, self.weight_distribution, self.weight_gain) < 0:
            raise ValueError("weights must not be negative")
        if self.top < 0 or self.length_steps < 1 or self.emd_points < 2:
            raise ValueError("top, length_steps and emd_points must count something")
        if min(self.radius_km, self.box_km, self.grade_bin_mi, self.start_step_frac) <= 0:
            raise ValueError("sizes must be positive")
        if not self.access_near_m < self.access_far_m:
            raise ValueError("access_near_m must be less than access_far_m")

    @property
    def bin_m(self) -> float:
        return self.grade_bin_mi * MILE_M

    @property
    def length_fracs(self) -> list[float]:
        """Window lengths as parts of the target's, evenly spaced with both ends."""
        n, low, high = self.length_steps, self.min_window_frac, self.max_window_frac
        step = (high - low) / max(n - 1, 1)
        return [high if n > 1 and i == n - 1 else low + i * step for i in range(n)]

    def start_step_m(self, target_m: float) -> float:
        return max(target_m * self.start_step_frac, self.least_step_m)
