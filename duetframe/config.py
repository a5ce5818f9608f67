"""Settings as frozen values; they enter plans as literals."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class UtilityConfig:
    lambda_round: float = 0.02
    lambda_token: float = 1e-5
    leader_margin: float = 0.03
    follower_margin: float = 0.02
    weight_min: float = 0.3
    weight_max: float = 2.0
    weight_power: float = 0.65


@dataclass(frozen=True)
class IncentiveConfig:
    """How much an effort estimate is worth; base differs between sampling (0.03) and evaluation (0.035)."""

    base: float = 0.03
    reference: float = 256.0
    scale: float = 256.0
    gamma: float = 0.45
    max_multiplier: float = 3.0
    least: float = 0.0
    most: float = 0.25
    max_step: float = 0.08


@dataclass(frozen=True)
class RoleBoundaryConfig:
    code_block: float = 0.08
    function_def: float = 0.10
    assertion: float = 0.06
    test_scaffold: float = 0.06
    code_intent: float = 0.03
    most: float = 0.25
    enabled: bool = True


@dataclass(frozen=True)
class FollowerConfig:
    beta_pass: float = 1.0
    beta_delta: float = 0.5
    lambda_token: float = 1e-4
    margin: float = 0.02
    min_pass_rate_delta: float = 0.0
    min_chosen_pass_rate: float = 0.0
    require_chosen_passed: bool = False
    require_repair_improvement: bool = True
    partial_scale: float = 0.5


def load(path: str) -> dict[str, Any]:
    """A JSON or TOML file as a dict, with its own path and its project's root (the folder above the file's)."""
    p = Path(path)
    table = tomllib.loads(p.read_text("utf-8")) if p.suffix == ".toml" else json.loads(p.read_text("utf-8"))
    return table | {"_config_path": str(p.resolve()), "_project_root": str(p.resolve().parent.parent)}


def section(table: dict[str, Any], name: str, required: bool = False) -> dict[str, Any]:
    """A section; {} if it isn't there, KeyError then if it is required, TypeError if it is no table."""
    if name not in table and required:
        raise KeyError(name)
    got = table.get(name, {})
    if not isinstance(got, dict):
        raise TypeError(f"{name} must be a table")
    return got


def resolve(table: dict[str, Any], path: str | None) -> str | None:
    """A path relative to the project's root; absolute ones and None stay."""
    if not path:
        return None
    return path if Path(path).is_absolute() else str(Path(table["_project_root"]) / path)


def from_section(kind, table: dict[str, Any]):
    """The settings class with what the section has of it."""
    return kind(**{f.name: table[f.name] for f in fields(kind) if f.name in table})
