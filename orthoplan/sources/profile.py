"""Convention profiles: a folder of JSON parts, checked as a whole; every problem is reported at once."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Roles, optional legend keys, segment classes, stroke styles, the reserved class.
ROLES = ["Equipment", "FlowArrow", "Nozzle", "PipeOffPageConnector", "PipingComponent", "ProcessInstrumentationFunction"]
LEGEND_KEYS = ["component_class", "equipment_type", "shape"]
SEGMENTS, STYLES, RESERVED = ["PipingNetworkSegment", "SignalLine"], ["solid", "dashed"], "unclassified"


class ProfileError(ValueError):
    def __init__(self, bundle: str, problems: list[str]):
        super().__init__(f"profile {bundle}: " + "; ".join(problems))
        self.problems = problems


@dataclass
class Profile:
    name: str
    version: str
    legend: dict[str, dict] = field(default_factory=dict)
    tag_grammar: dict[str, str] = field(default_factory=dict)
    line_semantics: dict[str, str] = field(default_factory=dict)
    line_styles: dict[str, str] = field(default_factory=dict)

    def identity(self) -> dict:
        return {"name": self.name, "version": self.version}

    def legend_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, e["role"], e.get("equipment_type"), e.get("component_class"), e.get("shape")) for c, e in self.legend.items()]
        return spark.createDataFrame(rows, "symbol_class string, role string, equipment_type string, component_class string, shape string")


def checked(parts: dict[str, object], bundle: str = "profile") -> Profile:
    """parts: each part's JSON value; line_styles may be missing."""
    bad: list[str] = []

    def part(name: str, needed: bool = True) -> dict:
        v = parts.get(name)
        if v is None and name not in parts:
            if needed:
                bad.append(f"{name}.json: missing")
            return {}
        if isinstance(v, Exception) or not isinstance(v, dict):
            bad.append(f"{name}.json: {v if isinstance(v, Exception) else 'not an object'}")
            return {}
        return v

    who, legend, grammar, semantics, styles = part("profile"), part("legend"), part("tag_grammar"), part("line_semantics"), part("line_styles", False)
    bad += [f"profile.json: unknown key {k!r}" for k in sorted(set(who) - {"name", "version"})]
    bad += [f"profile.json: {k!r} is a non-empty string" for k in ("name", "version") if "profile" in parts and not (isinstance(who.get(k), str) and who[k])]
    if "legend" in parts and legend == {}:
        bad.append("legend.json: empty")
    if "tag_grammar" in parts and grammar == {}:
        bad.append("tag_grammar.json: empty")
    for c, e in legend.items():
        if c == RESERVED:
            bad.append(f"legend.json: {c!r} is reserved")
        elif not isinstance(e, dict):
            bad.append(f"legend.json: {c!r} is not an object")
        else:
            bad += [f"legend.json: {c!r} has an unknown key {k!r}" for k in sorted(set(e) - {"role", *LEGEND_KEYS})]
            bad += [f"legend.json: {c!r} has the role {e.get('role')!r}, not one of {ROLES}"] * (e.get("role") not in ROLES)
            bad += [f"legend.json: {c!r}: {k} is a string" for k in LEGEND_KEYS if e.get(k) is not None and not isinstance(e[k], str)]
    for c, p in grammar.items():
        if c == RESERVED or not isinstance(p, str):
            bad.append(f"tag_grammar.json: {c!r} is reserved or no pattern")
            continue
        try:
            re.compile(p)
        except re.error as e:
            bad.append(f"tag_grammar.json: {c!r} does not compile ({e})")
    bad += [f"line_semantics.json: {c!r} maps to {s!r}, not one of {SEGMENTS}" for c, s in semantics.items() if s not in SEGMENTS]
    bad += [f"line_styles.json: {s!r} is not one of {STYLES} with a class" for s, c in styles.items() if s not in STYLES or not isinstance(c, str) or not c]
    if bad:
        raise ProfileError(bundle, bad)
    return Profile(who["name"], who["version"], legend, grammar, semantics, styles)


def load(bundle: str | Path) -> Profile:
    parts: dict[str, object] = {}
    for name in ("profile", "legend", "tag_grammar", "line_semantics", "line_styles"):
        path = Path(bundle) / f"{name}.json"
        if path.is_file():
            try:
                parts[name] = json.loads(path.read_text(encoding="utf-8"))
            except (OSError, ValueError) as e:
                parts[name] = e
    return checked(parts, str(bundle))
