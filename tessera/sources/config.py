"""Settings: TOML files in layers, checked; search profiles."""

from __future__ import annotations

import copy
import os
import tomllib
from dataclasses import dataclass
from typing import Any

# Sections, keys and defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "retrieval": {"default_profile": "lean", "max_search_results": 5},
    "safety": {"enable_inspection": True, "max_line_length": 300, "max_lines": 100, "max_total_bytes": 20 * 1024, "exec_timeout_ms": 5000},
    "editing": {"mode": "smart_anchor", "default_anchors": False, "read_mode": "plain", "syntax_gate": "warn"},
    "ui": {"enable_footer": True},
    "instructions": {"enabled": True},
}
CHOICES = {
    ("retrieval", "default_profile"): ("auto", "lean", "hybrid", "full", "off"),
    ("editing", "mode"): ("smart_anchor", "standard"),
    ("editing", "read_mode"): ("auto", "plain", "anchored"),
    ("editing", "syntax_gate"): ("warn", "block"),
}
BOUNDS = {
    ("retrieval", "max_search_results"): (1, 15),
    ("safety", "max_line_length"): (20, 10_000),
    ("safety", "max_lines"): (1, 10_000),
    ("safety", "max_total_bytes"): (64, 10 * 1024 * 1024),
    ("safety", "exec_timeout_ms"): (100, 120_000),
}
PASSED_OVER = {("retrieval", k) for k in ("enable_tools", "repo_map_budget", "repo_map_min_files", "repo_map_min_bytes")}
UNSAFE_KEYS = ("__proto__", "constructor", "prototype")


class ConfigError(ValueError):
    pass


def validate(config: dict[str, dict[str, Any]]) -> None:
    for section, values in config.items():
        if section not in DEFAULTS or not isinstance(values, dict):
            raise ConfigError(f"{section}: no such table")
        for key, value in values.items():
            at, name = (section, key), f"{section}.{key}"
            if key not in DEFAULTS[section]:
                raise ConfigError(f"{name}: no such key")
            if at in CHOICES:
                if value not in CHOICES[at]:
                    raise ConfigError(f"{name} must be one of {', '.join(CHOICES[at])}")
            elif at in BOUNDS:
                lo, hi = BOUNDS[at]
                if isinstance(value, bool) or not isinstance(value, int) or not lo <= value <= hi:
                    raise ConfigError(f"{name} must be an integer from {lo} to {hi}")
            elif not isinstance(value, bool):
                raise ConfigError(f"{name} must be true or false")


def parse(text: str) -> dict[str, Any]:
    """TOML; arrays of tables and keys that name object internals are refused."""
    out = tomllib.loads(text)

    def check(x: Any) -> None:
        if isinstance(x, dict):
            if bad := [k for k in x if k in UNSAFE_KEYS]:
                raise ConfigError(f"key {bad[0]} is refused")
            for v in x.values():
                check(v)
        elif isinstance(x, list) and any(isinstance(v, dict) for v in x):
            raise ConfigError("arrays of tables are refused")

    check(out)
    return out


def merged(base: dict, layer: dict) -> dict:
    """``base`` under ``layer``, checked as a whole; ``base`` stays as it was."""
    out = copy.deepcopy(base)
    for section, values in layer.items():
        if not isinstance(values, dict):
            raise ConfigError(f"{section} must be a table")
        out.setdefault(section, {}).update({k: v for k, v in values.items() if (section, k) not in PASSED_OVER})
    validate(out)
    return out


def layered(*texts: str | None) -> tuple[dict, list[str]]:
    """Defaults under each layer in turn; a layer with any fault is skipped whole and its fault told."""
    config, faults = copy.deepcopy(DEFAULTS), []
    for text in texts:
        if text is None:
            continue
        try:
            config = merged(config, parse(text))
        except (ConfigError, tomllib.TOMLDecodeError) as x:
            faults.append(str(x))
    return config, faults


def to_toml(config: dict[str, dict[str, Any]]) -> str:
    def value(v: Any) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int | float):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'

    return "\n".join(f"[{s}]\n" + "".join(f"{k} = {value(v)}\n" for k, v in kv.items()) for s, kv in config.items())


@dataclass(frozen=True)
class SearchProfile:
    asked: str
    effective: str
    width: int
    threshold: float
    batch: int


def profile(name: str = "auto", cpus: int | None = None) -> SearchProfile:
    """``auto`` is full from 8 CPUs on, hybrid from 4, else lean."""
    n = cpus if cpus is not None else os.cpu_count() or 1
    effective = ("full" if n >= 8 else "hybrid" if n >= 4 else "lean") if name == "auto" else name
    if effective not in ("lean", "hybrid", "full", "off"):
        raise ConfigError(f"no profile {name}")
    width, threshold, batch = {"full": (768, 0.55, 2), "hybrid": (256, 0.55, 1)}.get(effective, (0, 0.0, 1))
    return SearchProfile(name, effective, width, threshold, batch)


def save_profile(folder: str | os.PathLike, name: str) -> None:
    """Keep the choice of a profile; a new file takes the old one's place at once."""
    profile(name)
    part = os.path.join(folder, ".profile")
    with open(part, "w", encoding="utf-8") as f:
        f.write(name)
    os.replace(part, os.path.join(folder, "profile"))


def saved_profile(folder: str | os.PathLike) -> str:
    """The choice that was kept; ``auto`` where there is none, or none that is known."""
    try:
        with open(os.path.join(folder, "profile"), encoding="utf-8") as f:
            return profile(f.read().strip()).asked
    except (OSError, ConfigError):
        return "auto"
