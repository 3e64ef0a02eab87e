"""Typed engine configuration, read from YAML or mappings and validated on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

REQUIRED = ("detection", "system", "visualization")


@dataclass(frozen=True)
class Detection:
    conf_threshold: float = 0.30
    conf_ball: float = 0.18
    interval: int = 1


@dataclass(frozen=True)
class Kinematics:
    window: int = 18
    least_points: int = 4
    least_kmh: float = 2.0
    most_kmh: float = 38.0
    alpha: float = 0.75


@dataclass(frozen=True)
class Possession:
    radius_m: float = 1.8
    contest_m: float = 0.40
    hold_frames: int = 2


@dataclass(frozen=True)
class Engine:
    fps: float = 25.0
    vote_window: int = 15
    detection: Detection = field(default_factory=Detection)
    kinematics: Kinematics = field(default_factory=Kinematics)
    possession: Possession = field(default_factory=Possession)

    def __post_init__(self):
        for name in ("conf_threshold", "conf_ball"):
            if not 0.0 < getattr(self.detection, name) < 1.0:
                raise ValueError(f"detection.{name} must lie between 0 and 1")
        if self.fps <= 0:
            object.__setattr__(self, "fps", 25.0)


def _made(kind, values: Mapping):
    return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})


def validate(raw: Mapping) -> None:
    """Sections and thresholds that a configuration file needs."""
    missing = [s for s in REQUIRED if s not in raw]
    if missing:
        raise ValueError(f"missing sections: {', '.join(missing)}")
    for key, value in raw["detection"].items():
        if key.startswith("conf") and not 0.0 < float(value) < 1.0:
            raise ValueError(f"detection.{key} must lie between 0 and 1")


def engine(raw: Mapping | None = None) -> Engine:
    raw = dict(raw or {})
    parts = {f.name: _made(k, raw.get(f.name, {})) for f, k in ((f, {"detection": Detection, "kinematics": Kinematics, "possession": Possession}.get(f.name)) for f in fields(Engine)) if k}
    plain = {k: raw[k] for k in ("fps", "vote_window") if k in raw}
    return Engine(**plain, **parts)


def load(path: str | Path) -> dict:
    """A YAML file; a relative path that is not there is looked up beside the package."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    path = Path(path)
    if not path.is_absolute() and not path.exists():
        path = Path(__file__).resolve().parent.parent / path
    return yaml.safe_load(path.read_text()) or {}
