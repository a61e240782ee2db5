"""Model parameters and the enumerations of the data model."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the data model.
SEXES = ("male", "female")
NATIONALITIES = ("ESP", "EXT")
LEVELS = ("section", "barrio", "district", "city")
STATUSES = ("unchanged", "exact_harmonisation", "estimated_harmonisation", "unreliable")
MAX_AGE = 130
SECTION_PREFIX = "28079"
DISTRICTS = 21
# The age presets offered to readers (low, high).
PRESET_BANDS = ((10, 17), (18, 24), (25, 34), (35, 44), (45, 54), (55, 64), (65, 74), (75, 130))


@dataclass(frozen=True)
class Params:
    """One comparison window. ``terminal_age`` is the first age too open to age forward."""

    start_year: int = 2015
    end_year: int = 2025
    terminal_age: int = 100
    min_expected: float = 20.0
    overlap_tolerance: float = 1e-3
    material_overlap: float = 1e-6
    prefix: str = SECTION_PREFIX

    def __post_init__(self) -> None:
        if self.end_year <= self.start_year:
            raise ValueError("end year must be later than start year")
        if not self.interval < self.terminal_age <= MAX_AGE + 1:
            raise ValueError("terminal age must lie above the interval and within the age domain")
        if self.min_expected < 0 or not 0 <= self.overlap_tolerance < 1:
            raise ValueError("thresholds outside their domain")

    @property
    def interval(self) -> int:
        return self.end_year - self.start_year

    def presets(self) -> list[tuple[str, int, int]]:
        """(preset, low, high): all cohorts, the clipped bands, and the unmodelled births."""
        top = self.terminal_age - 1
        clipped = [
            (f"{max(low, self.interval)}-{high}", max(low, self.interval), min(high, top))
            for low, high in PRESET_BANDS
            if max(low, self.interval) <= min(high, top)
        ]
        return [("cohorts", self.interval, top), *clipped, ("born", 0, self.interval - 1)]
