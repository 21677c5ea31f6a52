"""Tunables shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CaptionConfig:
    # The published defaults of the timeline data product.
    sample_fps: float = 2.0
    roi_top: float = 0.45
    roi_bottom: float = 0.84
    min_ocr_confidence: float = 0.55
    text_similarity_threshold: float = 0.68
    max_missing_seconds: float = 0.8
    min_event_duration: float = 0.10
    boundary_ocr_budget: int = 2
    discovery_ocr_budget: int = 24
    discovery_change_threshold: float = 2.0
    preview_interval_seconds: float = 1.0
    preview_ring_size: int = 8
    thumbnail_limit: int = 5
    asr_pad_seconds: float = 0.45
    asr_correction_threshold: float = 0.72
    eval_text_threshold: float = 0.72
    roi_sample_frames: int = 16
    roi_y_tolerance: float = 0.06
    roi_min_score: float = 0.48
    event_page_size: int = 500
    poll_interval_seconds: float = 2.0
    poll_max_attempts: int = 900
    poll_max_errors: int = 5
    # Spark-side tunables: the widest stretch of one timeline handled as a unit.
    chunk_seconds: float = 600.0
    join_bin_seconds: float = 8.0

    def __post_init__(self) -> None:
        if not 0.25 <= self.sample_fps <= 10:
            raise ValueError("sample_fps must be within 0.25 and 10")
        if self.max_missing_seconds < 0.001:
            raise ValueError("max_missing_seconds must be at least 0.001")

    @property
    def interval(self) -> float:
        return 1.0 / self.sample_fps

    @property
    def track_reach(self) -> float:
        """Longest silence a caption track can bridge."""
        return self.max_missing_seconds + self.interval + 1e-6
