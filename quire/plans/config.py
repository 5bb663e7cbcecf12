"""Thresholds of the layout operators. Names that end in _ratio are relative to the page."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Overlap:
    duplicate_iou: float = 0.90
    duplicate_edge_ratio: float = 0.003
    duplicate_area: float = 0.85
    fragment_horizontal: float = 0.50
    fragment_gap_ratio: float = 0.012
    boundary_overlap: float = 0.20


@dataclass(frozen=True)
class Containment:
    strong: float = 0.92
    center: float = 0.72
    near: float = 0.82
    near_protrusion_ratio: float = 0.004
    max_child_parent_area: float = 0.85
    panel_label_chars: int = 12
    paragraph_chars: int = 80
    identifier_chars: int = 24
    trusted_figure_area_ratio: float = 0.65


@dataclass(frozen=True)
class Caption:
    max_gap_ratio: float = 0.10
    min_overlap: float = 0.18
    blocker_overlap: float = 0.25
    accept: float = 0.35
    margin: float = 0.15


@dataclass(frozen=True)
class TableContext:
    max_gap_ratio: float = 0.10
    min_overlap: float = 0.18
    accept: float = 4.5
    margin: float = 0.6
    boundary_ratio: float = 0.008
    wide: float = 0.72
    fragment_gap_ratio: float = 0.018
    fragment_lines: float = 1.8
    fragment_overlap: float = 0.30
    fragment_edge_ratio: float = 0.025
    fragment_accept: float = 4.5
    fragment_margin: float = 0.75


@dataclass(frozen=True)
class Formula:
    padding_ratio: float = 0.001
    min_retained: float = 0.45
    min_fragment_height_ratio: float = 0.006
    min_fragment_area_ratio: float = 0.0002
    min_survivor_score: float = 0.80
    score_margin: float = 0.20
    min_coverage: float = 0.55
    min_horizontal: float = 0.45
    min_block_width_ratio: float = 0.08
    max_inline_height_ratio: float = 0.018
    boundary_band: float = 0.35


@dataclass(frozen=True)
class EquationCrop:
    margin_height: float = 0.30
    min_margin_ratio: float = 0.006
    max_margin_ratio: float = 0.018
    clearance_height: float = 0.12
    corridor_overlap: float = 0.20


@dataclass(frozen=True)
class Filters:
    title_y: tuple[float, float] = (0.15, 0.42)
    body_anchor_y: float = 0.70
    lower_metadata_y: float = 0.68
    hard_footer_y: float = 0.92
    header_band_ratio: float = 0.14
    footer_y: float = 0.88
    min_repeat_pages: int = 2
    figure_header_y: float = 0.12
    figure_footer_y: float = 0.90
    role_confidence: float = 0.78
    role_gap_ratio: float = 0.035
    role_overlap: float = 0.45
    role_words: int = 120
    metadata_fields: int = 2
    metadata_heading_words: int = 10
    metadata_heading_gap_ratio: float = 0.025
    metadata_min_gap_ratio: float = 0.008
    metadata_max_gap_ratio: float = 0.035
    metadata_overlap: float = 0.35
    metadata_left_ratio: float = 0.025


@dataclass(frozen=True)
class ReadingOrder:
    column_gap_ratio: float = 0.04
    wide: float = 0.75


@dataclass(frozen=True)
class Failures:
    max_failed_pages: int = 3
    max_failed_ratio: float = 0.10


@dataclass(frozen=True)
class Config:
    overlap: Overlap = field(default_factory=Overlap)
    containment: Containment = field(default_factory=Containment)
    caption: Caption = field(default_factory=Caption)
    table: TableContext = field(default_factory=TableContext)
    formula: Formula = field(default_factory=Formula)
    crop: EquationCrop = field(default_factory=EquationCrop)
    filters: Filters = field(default_factory=Filters)
    order: ReadingOrder = field(default_factory=ReadingOrder)
    failures: Failures = field(default_factory=Failures)

    def with_options(self, **sections: dict) -> Config:
        """A copy with some values replaced; unknown sections and keys are errors, and so are ratios outside 0 to 1."""
        known = {f.name for f in fields(self)}
        if unknown := sections.keys() - known:
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        out = self
        for name, values in sections.items():
            section = getattr(out, name)
            if unknown := values.keys() - {f.name for f in fields(section)}:
                raise ValueError(f"unknown keys of {name}: {sorted(unknown)}")
            for key, value in values.items():
                if key.endswith("_ratio") and not 0 <= value <= 1:
                    raise ValueError(f"{name}.{key} is outside 0 to 1")
            out = replace(out, **{name: replace(section, **values)})
        return out


DEFAULT = Config()
