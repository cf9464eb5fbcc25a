"""Options, and where they come from: arguments over a named file over a dot file over a manifest's key."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields

UNITS = {"": 1, "b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}
GROUPS = {"js-ts": ["javascript", "typescript", "jsx", "tsx"]}


def parse_size(text: str) -> int:
    """Bytes of ``1.5mb`` and the like; units are of 1024."""
    found = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]*)\s*", text)
    if not found or found[2].lower() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * UNITS[found[2].lower()])


def parse_mappings(text: str) -> dict[str, str]:
    """``format:a,b;other:c`` as {a: format, b: format, c: other}."""
    out = {}
    for part in filter(None, map(str.strip, text.split(";"))):
        name, _, values = part.partition(":")
        out |= {v.strip(): name.strip() for v in values.split(",") if v.strip()}
    return out


def parse_groups(text: str) -> list[list[str]]:
    """``a,b;c,d`` or presets as groups of formats that share a pool; groups that overlap are one."""
    merged: list[set[str]] = []
    for part in filter(None, map(str.strip, text.split(";"))):
        group = set(GROUPS.get(part) or [x.strip() for x in part.split(",") if x.strip()])
        for other in [g for g in merged if g & group]:
            merged.remove(other)
            group |= other
        merged.append(group)
    return [sorted(g) for g in merged]


def parse_isolation(text: str) -> list[list[str]]:
    """``a|b,c|d`` as groups of folders; groups of fewer than two are dropped."""
    groups = [[x.strip() for x in part.split("|") if x.strip()] for part in text.split(",")]
    return [g for g in groups if len(set(g)) > 1]


@dataclass
class Options:
    paths: list[str] = field(default_factory=list)
    min_tokens: int = 50
    min_lines: int = 5
    max_lines: int | None = None
    max_size: str = "1mb"
    mode: str = "mild"
    formats: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    ignore_pattern: list[str] = field(default_factory=list)
    pattern: str | None = None
    ignore_case: bool = False
    skip_local: bool = False
    skip_isolated: list[list[str]] = field(default_factory=list)
    cross_formats: list[list[str]] = field(default_factory=list)
    formats_exts: dict[str, str] = field(default_factory=dict)
    formats_names: dict[str, str] = field(default_factory=dict)
    reporters: list[str] = field(default_factory=lambda: ["console"])
    output: str = "report"
    threshold: float | None = None
    exit_code: int = 0
    gitignore: bool = True
    excludes_file: str | None = None
    follow_links: bool = False
    lossy: bool = False
    absolute: bool = False
    store: str | None = None
    store_path: str | None = None
    store_namespace: str = ""
    baseline: str | None = None
    sarif_error_tokens: int | None = None
    summary: bool = False
    summary_top: int = 10
    summary_by: str = "tokens"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(map(str.title, rest))


def coerce(raw: dict) -> tuple[dict, list[str]]:
    """Known options of a JSON object, with strings for lists split and negated switches turned; warnings for the rest."""
    known = {camel(f.name): f for f in fields(Options)} | {f.name: f for f in fields(Options)} | {camel(f.name).lower(): f for f in fields(Options)}
    out, warnings = {}, []
    for key, value in raw.items():
        f = known.get(key) or known.get(camel(key.replace("-", "_")))
        negated = known.get(key[2:3].lower() + key[3:]) if key.startswith("no") else None
        if f is None and negated is not None and isinstance(value, bool):
            f, value = negated, not value
        if f is None:
            warnings.append(f"unknown option {key!r}")
            continue
        if f.name in ("formats", "ignore", "ignore_pattern", "reporters", "paths") and isinstance(value, str):
            value = [x.strip() for x in value.split(",") if x.strip()]
        parsers = {"formats_exts": parse_mappings, "formats_names": parse_mappings, "cross_formats": parse_groups, "skip_isolated": parse_isolation}
        if f.name in parsers and isinstance(value, str):
            value = parsers[f.name](value)
        if f.name in ("min_tokens", "min_lines", "max_lines", "exit_code", "summary_top", "sarif_error_tokens") and not isinstance(value, int):
            raise TypeError(f"{key}: a number is asked for")
        out[f.name] = value
    return out, warnings


def load(arguments: dict | None = None, config: str | None = None, folder: str = ".", dotfile: str = ".refrain.json", manifest: str = "package.json", key: str = "refrain") -> tuple[Options, list[str]]:
    """Options and warnings. The first of named file, dot file and manifest that exists is read; its relative paths are of its own folder."""
    raw: dict = {}
    for path, inner in ((config, None), (os.path.join(folder, dotfile), None), (os.path.join(folder, manifest), key)):
        if path and os.path.exists(path):
            with open(path) as f:
                raw = json.load(f)
            raw = raw if inner is None else raw.get(inner, {})
            if raw:
                base = os.path.dirname(path)
                if "paths" in raw:
                    raw["paths"] = [p if os.path.isabs(p) else os.path.normpath(os.path.join(base, p)) for p in ([raw["paths"]] if isinstance(raw["paths"], str) else raw["paths"])]
                break
        elif path and path == config:
            raise FileNotFoundError(path)
    found, warnings = coerce(raw)
    return Options(**found | {k: v for k, v in (arguments or {}).items() if v is not None}), warnings
