"""Limits and thresholds of every operator; defaults are the published default configuration."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SegmentLimits:
    max_seconds: float = 60.0
    min_seconds: float = 5.0
    pause_break_ms: int = 900
    max_words: int = 150
    tolerance_seconds: float = 0.25
    unit_max_ms: int = 12_000
    unit_max_words: int = 40
    unit_clause_min_ms: int = 8_000
    unit_clause_min_words: int = 24
    dense_seconds: float = 40.0
    dense_words: int = 90
    dense_sentences: int = 4
    lookahead_tokens: int = 8


@dataclass(frozen=True)
class SceneLimits:
    fallback_scene_seconds: int = 30
    edge_inset_ms: int = 350
    images_per_scene: int = 4
    extra_sample_every_seconds: int = 4
    max_frames_per_scene: int = 8
    min_frames_per_scene: int = 1
    phash_max_distance: int = 10
    probe_window_ms: int = 600
    probe_step_ms: int = 300
    planned_score_ratio: float = 0.92
    central_region_weight: float = 1.5
    grid_size: int = 4
    drop_low_quality: bool = False


@dataclass(frozen=True)
class PaletteLimits:
    sample_step_seconds: float = 0.25
    min_scene_duration_seconds: float = 6.0
    max_boundary_shift_seconds: float = 3.0
    min_segment_seconds: float = 1.5
    stable_window_seconds: float = 1.0
    edge_guard_seconds: float = 0.75
    min_saturation_delta: float = 30.0
    min_colorfulness_delta: float = 8.0
    min_histogram_distance: float = 0.25
    min_confidence: float = 0.75

    @property
    def min_window_samples(self) -> int:
        return max(2, int(round(self.stable_window_seconds / self.sample_step_seconds / 2)))


@dataclass(frozen=True)
class ChunkLimits:
    max_words: int = 1000
    max_segments: int = 8
    qa_gap_ms: int = 12_000
    attach_ms: int = 5_000
    window_segments: int = 80
    context_segments: int = 3
    title_chars: int = 80
    boundary_reason_chars: int = 160
    notes_chars: int = 240
    topic_chars: int = 80
    max_topics: int = 6


@dataclass(frozen=True)
class ClaimLimits:
    max_per_chunk: int = 5
    max_retries: int = 3
    max_topics: int = 8
    schema_version: int = 3


@dataclass(frozen=True)
class Limits:
    segment: SegmentLimits = field(default_factory=SegmentLimits)
    scene: SceneLimits = field(default_factory=SceneLimits)
    palette: PaletteLimits = field(default_factory=PaletteLimits)
    chunk: ChunkLimits = field(default_factory=ChunkLimits)
    claim: ClaimLimits = field(default_factory=ClaimLimits)
    context_before_ms: int = 5_000
    context_after_ms: int = 2_000
    bootstrap_scene_limit: int = 12
    bootstrap_max_images: int = 12
    duration_mismatch_seconds: float = 1.0


DEFAULTS = Limits()
