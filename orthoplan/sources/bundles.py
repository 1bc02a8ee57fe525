"""Detector artifacts on disk: prototypes with a manifest that vouches for them, and a legend's glyphs.

An artifact is a folder with manifest.json and one gray PNG a prototype. Its version is a digest of everything that decides
what the detector does, so an edited artifact, one of another profile, or one trained at another scale is refused.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, unquote

import numpy as np

from orthoplan.operators.raster import detector, normalize, png
from orthoplan.sources import profile as profiles
from orthoplan.sources import sinks

# Fixed value: the form of this package's own artifacts.
FORM = "orthoplan-symbol-detector/1"


class ArtifactError(ValueError):
    """An artifact that must not be used, and why."""


@dataclass
class Model:
    """What a detector matches with, and the name that its detections carry."""

    prototypes: list[detector.Prototype]
    component: str
    legend: bool = False


def stamp(manifest: dict, prototypes: dict[str, np.ndarray]) -> str:
    """Twelve digits of all that decides what the detector does: form, profile, scale, classes and pixels."""
    h = hashlib.sha256(json.dumps([manifest[k] for k in ("format", "profile", "long_side", "classes")], sort_keys=True, ensure_ascii=False).encode())
    for name, values in sorted(prototypes.items()):
        h.update(f"{name} {values.shape}".encode() + values.tobytes())
    return h.hexdigest()[:12]


def put(folder: str | Path, prototypes: list[detector.Prototype], identity: dict, sources: list[dict] | None = None) -> dict:
    """Writes an artifact, the manifest last, and returns the manifest."""
    if not prototypes:
        raise ArtifactError(f"there are no symbol examples to train a detector of {identity} on")
    folder, classes, pixels = Path(folder), {}, {}
    for p in prototypes:
        name = f"prototypes/{quote(p.name, safe='@')}.png"
        pixels[name] = p.values
        entry = {"prototype": name, "name": p.name, "width": p.size[0], "height": p.size[1], "threshold": p.threshold, "direction": p.direction and list(p.direction)}
        classes.setdefault(p.symbol_class, []).append(entry)
    manifest = {"format": FORM, "profile": identity, "long_side": normalize.LONG_SIDE, "classes": classes, "sources": sources or []}
    manifest["version"] = stamp(manifest, pixels)
    for name, values in pixels.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(png.encode(255 - values))  # as a sheet: ink is dark
    sinks.put_json(folder / "manifest.json", manifest)
    return manifest


def trained(folder: str | None, identity: dict) -> Model:
    """A verified artifact for sheets of one profile."""
    if not folder:
        raise ArtifactError("the trained detector is chosen with its artifact: trained:<artifact folder>")
    path = Path(folder) / "manifest.json"
    if not path.is_file():
        raise ArtifactError(f"{folder} is no detector artifact: it has no manifest.json")
    manifest = json.loads(path.read_text(encoding="utf-8"))
    if manifest.get("format") != FORM:
        raise ArtifactError(f"{path} is of the form {manifest.get('format')!r}, not {FORM}")
    pixels, out = {}, []
    for symbol_class, entries in sorted(manifest["classes"].items()):
        for e in entries:
            values = 255 - png.decode((Path(folder) / e["prototype"]).read_bytes())
            if values.shape != (e["height"], e["width"]):
                raise ArtifactError(f"{e['prototype']} has {values.shape[::-1]} pixels, its manifest says {(e['width'], e['height'])}")
            pixels[e["prototype"]] = values
            out.append(detector.Prototype(symbol_class, values, e["threshold"], e["direction"] and tuple(e["direction"]), e["name"]))
    found = stamp(manifest, pixels)
    if found != manifest.get("version"):
        raise ArtifactError(f"{folder} was modified after training: it is stamped {manifest.get('version')!r}, its content is {found}")
    if manifest["long_side"] != normalize.LONG_SIDE:
        raise ArtifactError(f"{folder} was trained at a long side of {manifest['long_side']} pixels, sheets are normalized to {normalize.LONG_SIDE}")
    if manifest["profile"] != identity:
        raise ArtifactError(f"{folder} was trained for the profile {manifest['profile']}, the sheets are of {identity}")
    return Model(out, f"symbol_detector:trained@{found}")


def legend(folder: str | None, identity: dict) -> Model:
    """A profile folder's glyphs (glyphs/<class>.png) as prototypes. An arrow's glyph says nothing of its direction and is refused."""
    if not folder:
        raise ArtifactError("the legend-nn detector is chosen with a profile folder: legend-nn:<profile folder>")
    who = profiles.load(folder)
    if who.identity() != identity:
        raise ArtifactError(f"the legend is of the profile {who.identity()}, the sheets are of {identity}")
    files = sorted((Path(folder) / "glyphs").glob("*.png"))
    if not files:
        raise ArtifactError(f"{folder} has no glyphs/*.png to compare symbols with")
    h, out = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()), []
    for f in files:
        name = unquote(f.stem)
        if name not in who.legend:
            raise ArtifactError(f"the glyph {f.name} names {name!r}, which the legend does not list")
        if who.legend[name]["role"] == "FlowArrow":
            raise ArtifactError(f"the glyph {f.name} is a FlowArrow, whose direction a glyph cannot tell")
        gray = png.decode(f.read_bytes())
        out.append(detector.glyph(name, gray))
        h.update(f"{f.name} {gray.shape}".encode() + gray.tobytes())
    return Model(out, f"symbol_detector:legend-nn@{h.hexdigest()[:12]}", legend=True)
