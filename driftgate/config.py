"""Settings from a TOML file; unknown keys are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from driftgate.operators.checks import Settings
from driftgate.operators.verdict import Policy


@dataclass(frozen=True)
class Config:
    checks: Settings = field(default_factory=Settings)
    gate: Policy = field(default_factory=Policy)


def _made(kind, values: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown keys in {where}: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def parse(text: str) -> Config:
    raw = tomllib.loads(text)
    if unknown := set(raw) - {"checks", "gate"}:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    return Config(_made(Settings, raw.get("checks", {}), "checks"), _made(Policy, raw.get("gate", {}), "gate"))


def load(start: str, name: str = "driftgate.toml") -> Config:
    """The nearest file of that name in the folder or above it; defaults without one."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / name).is_file():
            return parse((folder / name).read_text())
    return Config()
