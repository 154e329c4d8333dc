"""Configuration of a scan, on the driver: defaults, then files, then overrides."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from verdigris.schemas import SCANNERS

# Fixed defaults.
DEFAULTS: dict[str, Any] = {
    "report_root": "reports",
    "state_root": ".state",
    "default_timeout_seconds": 120,
    "enabled_scanners": [],
    "disabled_scanners": [],
    "excludes": [],
    "payload": {"max_bytes_per_finding": 16_384, "max_bytes_global": 10_485_760, "redact": True},
    "secrets": {"history_commit_limit": 5_000, "history_size_limit_mb": 1_000, "add_patterns": [], "remove_patterns": []},
    "thresholds": {"warn_score": 80, "fail_score": 60, "high_security_findings": 3},
    "scanner_settings": {},
}
ALIASES = {"reports_dir": "report_root", "site_dir": "report_root"}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Tables merge key by key; anything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def renamed(values: Mapping[str, Any]) -> dict[str, Any]:
    """Old names as new ones; a new name that is there too wins."""
    out = {k: v for k, v in values.items() if k not in ALIASES}
    for old, new in ALIASES.items():
        if old in values:
            out.setdefault(new, values[old])
    return out


def checked(config: dict[str, Any]) -> dict[str, Any]:
    """The configuration, if its keys and scanner names are known and no scanner is both on and off."""
    unknown = set(config) - set(DEFAULTS)
    for table in ("payload", "secrets", "thresholds"):
        unknown |= {f"{table}.{k}" for k in set(config[table]) - set(DEFAULTS[table])}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    on, off = set(config["enabled_scanners"]), set(config["disabled_scanners"])
    strange = (on | off | set(config["scanner_settings"])) - set(SCANNERS)
    if strange:
        raise ValueError(f"unknown scanners: {', '.join(sorted(strange))}")
    if on & off:
        raise ValueError(f"scanners both enabled and disabled: {', '.join(sorted(on & off))}")
    return config


def load(*files: Path, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults under files, in order, under overrides that are not None. Missing files are skipped."""
    config = dict(DEFAULTS)
    for path in files:
        if path.is_file():
            config = merged(config, renamed(tomllib.loads(path.read_text())))
    return checked(merged(config, renamed({k: v for k, v in (overrides or {}).items() if v is not None})))


def history_gate(commits: int | None, size_mb: float | None, config: Mapping[str, Any], force: bool = False) -> dict[str, Any]:
    """Whether a repository's history may be scanned, and why not: commits are judged before size. What
    cannot be read counts as none."""
    limits = config["secrets"]
    if force:
        return {"allowed": True, "reason": "forced"}
    if (commits or 0) > limits["history_commit_limit"]:
        return {"allowed": False, "reason": "commit_limit_exceeded"}
    if int(size_mb or 0) > limits["history_size_limit_mb"]:
        return {"allowed": False, "reason": "size_limit_exceeded"}
    return {"allowed": True, "reason": "within_limits"}


def framework_policy(frameworks: list[str]) -> list[str]:
    """Scanners to leave out: those for Django, where there is none."""
    return [] if "django" in frameworks else [s for s in SCANNERS if s.startswith("django_")]
