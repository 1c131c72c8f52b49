"""Generator settings from YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Splits:
    train: float = 0.7
    val: float = 0.15
    holdout: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    seed: int = 42
    days: int = 60
    step_minutes: int = 10
    start: str = "2024-04-01 00:00:00"
    splits: Splits = field(default_factory=Splits)

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        """Unknown keys are ignored; `splits` may be nested under `temporal`. A missing file or another suffix is an error."""
        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(path)
        if path.suffix in (".yaml", ".yml"):
            import yaml

            body = yaml.safe_load(path.read_text()) or {}
        elif path.suffix == ".json":
            body = json.loads(path.read_text())
        else:
            raise ValueError(f"unknown suffix {path.suffix!r}")
        splits = dict(body.get("splits") or {})
        splits = {**splits.pop("temporal", {}), **splits}
        known = lambda c, d: {f.name: d[f.name] for f in fields(c) if f.name in d}
        parts = known(Splits, splits)
        if "holdout" in parts:
            parts["holdout"] = tuple(parts["holdout"])
        return cls(**{**known(cls, body), "splits": Splits(**parts)})
