"""Settings: sections with typed fields and defaults, read from and written to YAML."""

from __future__ import annotations

import dataclasses
import logging
import os
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Literal

log = logging.getLogger(__name__)


class ConfigError(ValueError):
    """A setting that is unknown or has a value it cannot have."""


def _env(name: str):
    return field(default_factory=lambda: os.getenv(name, ""))


def _of(*values: Any):
    return field(default_factory=lambda: list(values))


# The names and defaults of all settings, as existing YAML files have them.
@dataclass
class API:
    """Keys, models and limits of remote models."""

    anthropic_api_key: str = _env("ANTHROPIC_API_KEY")
    openai_api_key: str = _env("OPENAI_API_KEY")
    claude_model: str = "claude-opus-4-5"
    claude_fast: str = "claude-sonnet-4-20250514"
    openai_model: str = "gpt-4o"
    max_concurrent_api_calls: int = 3
    api_retry_attempts: int = 5
    api_retry_min_wait: float = 1.0
    api_retry_max_wait: float = 60.0
    max_tokens_correction: int = 4096
    max_tokens_analysis: int = 2048
    max_tokens_summary: int = 1024


@dataclass
class Extraction:
    """What is read from a file."""

    render_dpi: int = 300
    render_dpi_ocr: int = 400
    render_colorspace: str = "RGB"
    text_density_threshold: float = 0.05
    image_area_threshold: float = 0.10
    diagram_aspect_ratio_min: float = 0.2
    text_extract_mode: Literal["fast", "layout", "full"] = "full"
    extract_fonts: bool = True
    table_extraction_method: Literal["camelot", "pdfplumber", "paddleocr", "all"] = "all"
    camelot_flavor: Literal["lattice", "stream"] = "lattice"


@dataclass
class Enhancement:
    """Steps on pictures."""

    enable_denoising: bool = True
    denoise_strength: float = 10.0
    enable_clahe: bool = True
    clahe_clip_limit: float = 3.0
    clahe_grid_size: int = 8
    enable_sharpening: bool = True
    sharpen_sigma: float = 1.5
    sharpen_amount: float = 1.5
    enable_super_resolution: bool = True
    sr_model: Literal["RealESRGAN_x4plus", "RealESRGAN_x4plus_anime", "RealESRGAN_x2plus", "realesr-general-x4v3"] = "RealESRGAN_x4plus_anime"
    sr_outscale: float = 4.0
    sr_tile: int = 512
    sr_tile_pad: int = 10
    sr_half: bool = True
    sr_gpu_id: int | None = 0
    enable_vectorization: bool = True
    vectorize_threshold: int = 128
    vectorize_min_area: int = 50
    enable_face_restoration: bool = True
    face_model: Literal["GFPGANv1.4", "GFPGANv1.3", "RestoreFormer"] = "GFPGANv1.4"
    output_format: Literal["PNG", "JPEG", "WEBP"] = "PNG"
    jpeg_quality: int = 97
    png_compress: int = 1


@dataclass
class OCR:
    """Recognition engines and correction."""

    engine_priority: list[Literal["tesseract", "easyocr", "paddleocr", "surya"]] = _of("paddleocr", "tesseract", "easyocr")
    tesseract_lang: str = "eng"
    tesseract_oem: int = 3
    tesseract_psm: int = 6
    tesseract_dpi: int = 300
    easyocr_langs: list[str] = _of("en")
    easyocr_gpu: bool = True
    easyocr_detail: int = 1
    paddle_lang: str = "en"
    paddle_use_gpu: bool = True
    paddle_use_angle_classifier: bool = True
    min_confidence: float = 0.6
    ensemble_strategy: Literal["voting", "confidence", "longest"] = "confidence"
    enable_ai_correction: bool = True
    enable_spell_correction: bool = True
    enable_grammar_fix: bool = True
    enable_unicode_fix: bool = True


@dataclass
class Diagram:
    """Figures."""

    enable_ai_analysis: bool = True
    enable_reconstruction: bool = False
    enable_vectorization: bool = True
    embed_as_vector: bool = True
    min_diagram_size_px: int = 100
    diagram_types: list[str] = _of("flowchart", "schematic", "graph", "table", "formula", "equation", "map", "photo", "logo")


@dataclass
class Pipeline:
    """Scope, output and state of a run."""

    pages: str | None = None
    skip_text_pages: bool = False
    skip_image_pages: bool = False
    workers: int = field(default_factory=lambda: min(4, os.cpu_count() or 1))
    batch_size: int = 5
    output_dpi: int = 300
    output_suffix: str = "_enhanced"
    embed_searchable_text: bool = True
    compress_output: bool = True
    optimize_output: bool = True
    enable_checkpoint: bool = True
    checkpoint_db: str = "state"
    compute_ssim: bool = True
    compute_psnr: bool = True
    save_report: bool = True


def _fits(value: Any, kind: Any) -> bool:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is Literal:
        return value in args
    if origin is list:
        return isinstance(value, list) and all(_fits(v, args[0]) for v in value)
    if args:
        return any(_fits(value, a) for a in args)
    if kind is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, kind)


def _section(kind: type, values: dict[str, Any] | None):
    """A section from a mapping; ConfigError for unknown names and values of another type."""
    types = typing.get_type_hints(kind)
    for name, value in (values or {}).items():
        if name not in types:
            raise ConfigError(f"unknown setting {kind.__name__.lower()}.{name}")
        if not _fits(value, types[name]):
            raise ConfigError(f"{kind.__name__.lower()}.{name} cannot be {value!r}")
    return kind(**(values or {}))


@dataclass
class Config:
    """All sections."""

    api: API = field(default_factory=API)
    extraction: Extraction = field(default_factory=Extraction)
    enhancement: Enhancement = field(default_factory=Enhancement)
    ocr: OCR = field(default_factory=OCR)
    diagram: Diagram = field(default_factory=Diagram)
    pipeline: Pipeline = field(default_factory=Pipeline)

    @classmethod
    def of(cls, values: dict[str, Any]) -> Config:
        """From nested mappings; sections and settings left out have their defaults.

        A section ``api`` that gives no key, with none in the environment, is warned of; without the section there is no warning.
        """
        kinds = typing.get_type_hints(cls)
        if unknown := sorted(values.keys() - kinds.keys()):
            raise ConfigError(f"unknown sections: {', '.join(unknown)}")
        if isinstance(values.get("api"), dict) and not values["api"].get("anthropic_api_key") and not os.getenv("ANTHROPIC_API_KEY"):
            log.warning("no API key set: steps that ask a remote model are left out")
        return cls(**{name: _section(kinds[name], v) for name, v in values.items()})

    @classmethod
    def read(cls, path: str | Path) -> Config:
        """From a YAML file."""
        import yaml

        return cls.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    def write(self, path: str | Path) -> None:
        """To a YAML file, sections and settings in their order."""
        import yaml

        Path(path).write_text(yaml.safe_dump(dataclasses.asdict(self), default_flow_style=False, sort_keys=False), encoding="utf-8")


def load(path: str | Path = "config.yaml") -> Config:
    """The file's settings where it exists, else the defaults."""
    return Config.read(path) if Path(path).exists() else Config()
