"""Degraded copies of sheets, and the same maps for their labels."""

from __future__ import annotations

import json
import math
import random
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from orthoplan.functions import geometry as g

# JPEG's luminance quantization table (Annex K).
QUANT = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
_k = np.arange(8)
DCT = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def _number(v, what: str, whole: bool = False) -> None:
    if isinstance(v, bool) or not isinstance(v, int if whole else (int, float)) or not math.isfinite(v):
        raise ValueError(f"{what}, got {v!r}")


@dataclass(frozen=True)
class Blur:
    radius: int = 1

    def __post_init__(self):
        _number(self.radius, "a blur radius is a whole number of pixels from 1", whole=True)
        if self.radius < 1:
            raise ValueError("a blur radius is a whole number of pixels from 1")

    def apply(self, gray: np.ndarray, rng) -> np.ndarray:
        n = 2 * self.radius + 1

        def rows(a):
            p = np.pad(a.astype(np.int64), ((0, 0), (self.radius + 1, self.radius)), mode="edge")
            s = np.cumsum(p, axis=1)
            return (s[:, n:] - s[:, :-n] + self.radius) // n

        return rows(rows(gray).T).T.astype(np.uint8)


@dataclass(frozen=True)
class Skew:
    angle_deg: float = 1.0

    def __post_init__(self):
        _number(self.angle_deg, "a skew angle is a finite number of degrees")

    def apply(self, gray: np.ndarray, rng) -> np.ndarray:
        h, w = gray.shape
        c, s = math.cos(math.radians(self.angle_deg)), math.sin(math.radians(self.angle_deg))
        dy = np.arange(h) + 0.5 - h / 2
        sx = np.cumsum(np.column_stack([w / 2 + (0.5 - w / 2) * c + dy * s, np.full((h, w - 1), c)]), axis=1) - 0.5
        sy = np.cumsum(np.column_stack([h / 2 - (0.5 - w / 2) * s + dy * c, np.full((h, w - 1), -s)]), axis=1) - 0.5
        x, y = np.floor(sx).astype(int), np.floor(sy).astype(int)
        fx, fy = sx - x, sy - y
        paper = np.pad(gray.astype(np.float64), 1, constant_values=255)
        at = lambda yy, xx: paper[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]
        v = (1 - fy) * (1 - fx) * at(y, x) + (1 - fy) * fx * at(y, x + 1) + fy * (1 - fx) * at(y + 1, x) + fy * fx * at(y + 1, x + 1)
        return np.minimum(255, (v + 0.5).astype(int)).astype(np.uint8)


@dataclass(frozen=True)
class Noise:
    sigma: float = 8.0

    def __post_init__(self):
        _number(self.sigma, "noise sigma is a positive number of gray levels")
        if self.sigma <= 0:
            raise ValueError("noise sigma is a positive number of gray levels")

    def apply(self, gray: np.ndarray, rng) -> np.ndarray:
        add = np.array([rng.gauss(0.0, self.sigma) for _ in range(gray.size)]).reshape(gray.shape)
        return np.clip(np.rint(gray + add), 0, 255).astype(np.uint8)


@dataclass(frozen=True)
class Compression:
    quality: int = 30

    def __post_init__(self):
        _number(self.quality, "a compression quality is a whole number from 1 to 100", whole=True)
        if not 1 <= self.quality <= 100:
            raise ValueError("a compression quality is a whole number from 1 to 100")

    def table(self) -> np.ndarray:
        scale = 5000 // self.quality if self.quality < 50 else 200 - 2 * self.quality
        return np.clip((np.array(QUANT) * scale + 50) // 100, 1, 255).reshape(8, 8)

    def apply(self, gray: np.ndarray, rng) -> np.ndarray:
        h, w = gray.shape
        p = np.pad(gray, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(np.float64) - 128
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        q = self.table()
        coarse = np.rint(DCT @ blocks @ DCT.T / q) * q
        out = np.trunc(DCT.T @ coarse @ DCT + 128.5).transpose(0, 2, 1, 3).reshape(p.shape)
        return np.clip(out, 0, 255).astype(np.uint8)[:h, :w]


KINDS = {"blur": Blur, "skew": Skew, "noise": Noise, "compression": Compression}


@dataclass(frozen=True)
class Variant:
    name: str
    seed: int | str
    transforms: tuple

    def __post_init__(self):
        if not self.name or "/" in self.name or self.name in (".", ".."):
            raise ValueError(f"a variant's name is a folder name, got {self.name!r}")
        if not self.transforms:
            raise ValueError(f"variant {self.name!r} has no transforms")


def transform(config: dict):
    kind = KINDS.get(config.get("kind"))
    if kind is None:
        raise ValueError(f"a transform is one of {sorted(KINDS)}, got {config.get('kind')!r}")
    rest = {k: v for k, v in config.items() if k != "kind"}
    if unknown := set(rest) - set(kind.__dataclass_fields__):
        raise ValueError(f"unknown keys {sorted(unknown)} of a {config['kind']}")
    return kind(**rest)


def config(t) -> dict:
    return {"kind": next(k for k, c in KINDS.items() if c is type(t))} | asdict(t)


def variants(text: str) -> list[Variant]:
    """From a JSON list of {name, seed, transforms}."""
    given = json.loads(text)
    if not isinstance(given, list) or not given:
        raise ValueError("variants are a list with at least one entry")
    out = []
    for v in given:
        if not isinstance(v, dict) or set(v) != {"name", "seed", "transforms"}:
            raise ValueError(f"a variant has name, seed and transforms, got {v!r}")
        out.append(Variant(v["name"], v["seed"], tuple(map(transform, v["transforms"]))))
    if len({v.name.lower() for v in out}) < len(out):
        raise ValueError("variants' names differ in more than case")
    return out


def degraded(gray: np.ndarray, transforms, seed) -> np.ndarray:
    """Each stage has a random stream of its own."""
    for i, t in enumerate(transforms):
        kind = config(t)["kind"]
        gray = t.apply(gray, random.Random(f"{seed}/{i}/{kind}"))
    return gray


def moved(p: Column, transforms, width: Column, height: Column) -> Column:
    """A label's point on the degraded sheet; only skew moves anything."""
    for t in transforms:
        if isinstance(t, Skew):
            from pyspark.sql import functions as F

            p = g.rotated(p, F.lit(float(t.angle_deg)), g.point(width / 2, height / 2))
    return p


def moved_box(b: Column, transforms, width: Column, height: Column) -> Column:
    """The hull of the moved corners, on the canvas; null if nothing of it is left."""
    return g.clipped(g.mapped_box(b, lambda p: moved(p, transforms, width, height)), width, height)


def degraded_sheets(sheets: DataFrame, all_variants: list[Variant]) -> DataFrame:
    """Every sheet in every variant: document, sheet, variant, width, height, raster."""

    def rows(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                gray = np.frombuffer(r.raster, np.uint8).reshape(r.height, r.width)
                for v in all_variants:
                    out.append((r.document, r.sheet, v.name, r.width, r.height, degraded(gray, v.transforms, f"{v.seed}/{r.sheet}").tobytes()))
            yield pd.DataFrame(out, columns=["document", "sheet", "variant", "width", "height", "raster"])

    return sheets.select("document", "sheet", "width", "height", "raster").mapInPandas(rows, "document string, sheet int, variant string, width int, height int, raster binary")
