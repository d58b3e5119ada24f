"""Run configurations: nested scalars that stay on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class RunConfig:
    """What one scoring run reads, applies and writes."""

    signal: str = "cp"
    model: str = ""
    tag: str = ""
    builder: str = "rated_samples"
    builder_kwargs: dict = field(default_factory=dict)
    matcher: str = "patches"
    matcher_kwargs: dict = field(default_factory=dict)
    methods: tuple[str, ...] = ()
    min_fg_fraction: float | None = 0.05
    stripper: str = "regex"
    skip_style: bool = False
    variant: str = "global_bg"
    max_samples: int | None = None
    dump_patch_arrays: bool = False
    out: str = ""

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, default=str).encode()).hexdigest()


def parse(text: str) -> dict:
    """JSON, or YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("the configuration is no JSON, and no YAML reader is installed") from missing
        return yaml.safe_load(text)


def load(path: str, **overrides: object) -> RunConfig:
    """A configuration file with overrides; unknown settings raise."""
    values = parse(Path(path).read_text()) | {k: v for k, v in overrides.items() if v is not None}
    known = {f.name for f in fields(RunConfig)}
    unknown = set(values) - known
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "methods" in values:
        values["methods"] = tuple(values["methods"])
    return RunConfig(**values)


def fraction_or_none(text: str) -> float | None:
    """A command-line threshold: a number, or none to keep all."""
    return None if text.strip().lower() == "none" else float(text)
