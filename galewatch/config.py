"""Settings of the engine; those that operators tune in production can come from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    # scoring and quality
    confidence_threshold: float = 0.6
    detection_min_range_km: float = 40.0
    detection_min_gates: int = 100
    min_heatmap_edge_margin: float = 0.10
    near_edge_margin: float = 0.10
    # segmentation
    cell_dbz_threshold: float = 40.0
    cell_min_gates: int = 20
    cell_min_range_km: float = 10.0
    shear_threshold: float = 0.0
    shear_half_rays: int = 10
    shear_half_gates: int = 10
    sweep_tolerance_deg: float = 0.3
    split_cut_tolerance_deg: float = 0.5
    # chips
    chip_azimuth_span_deg: float = 60.0
    chip_range_m: float = 60_000.0
    chip_azimuth_bins: int = 120
    chip_range_gates: int = 240
    target_elevations: tuple[float, ...] = (0.5, 0.9)
    # tracking
    track_confirm_scans: int = 2
    track_confirm_window_scans: int = 3
    track_match_base_km: float = 15.0
    track_max_speed_kmh: float = 120.0
    track_activation_match_km: float = 45.0
    track_activation_weight: float = 0.35
    track_max_missed_scans: int = 2
    # scheduling, seconds
    hot_poll_seconds: int = 60
    active_poll_seconds: int = 120
    quiet_poll_seconds: int = 300
    max_quiet_poll_seconds: int = 900
    no_scan_poll_seconds: int = 600
    error_backoff_seconds: int = 300
    max_error_backoff_seconds: int = 1800
    quiet_multiplier: float = 1.5
    poll_interval_seconds: int = 300
    # retention, seconds
    processed_ttl_seconds: int = 259_200
    track_ttl_seconds: int = 21_600
    include_tdwr: bool = False

    def __post_init__(self) -> None:
        if self.track_confirm_scans < 1:
            raise ValueError("track_confirm_scans must be at least 1")
        if self.track_confirm_window_scans < self.track_confirm_scans:
            raise ValueError("track_confirm_window_scans must not be below track_confirm_scans")
        if self.track_max_missed_scans < 0:
            raise ValueError("track_max_missed_scans must not be negative")
        if self.quiet_multiplier < 1:
            raise ValueError("quiet_multiplier must be at least 1")

    @property
    def track_history(self) -> int:
        """Observations that a track keeps."""
        return max(self.track_confirm_window_scans, self.track_max_missed_scans + 1) + 3

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "GALEWATCH_") -> EngineConfig:
        """Settings named like PREFIX + FIELD in capitals; others keep their defaults."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                default = f.default
                if isinstance(default, bool):
                    found[f.name] = raw.strip().lower() in ("1", "true", "yes")
                elif isinstance(default, tuple):
                    found[f.name] = tuple(float(x) for x in raw.split(","))
                else:
                    found[f.name] = type(default)(raw)
        return cls(**found)
