"""Symbols by correlation with prototypes: learned from labelled crops, or taken from a legend's glyphs."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

UNCLASSIFIED = "unclassified"
#: The class of a row that tells why a sheet could not be read; its evidence is the reason.
FAULT = "#fault"


def reason(e: Exception) -> dict:
    return {"component": FAULT, "evidence": f"{type(e).__name__}: {e}"}


def pixels(r) -> np.ndarray:
    """The raster of a row(width, height, raster)."""
    if r.raster is None:
        raise ValueError(f"sheet {r.sheet} has no raster")
    if len(r.raster) != r.width * r.height:
        raise ValueError(f"the raster of sheet {r.sheet} has {len(r.raster)} bytes, not {r.width} x {r.height}")
    return np.frombuffer(r.raster, np.uint8).reshape(r.height, r.width)
# Ink, least side, share and floor of a threshold, context ring, ink ratios, suppression by overlap and by
# containment, directions, and the legend's bands: acceptance, floor, claimed ink.
INK, SIDE, SHARE, FLOOR, RING, LOW, HIGH, OVERLAP, CONTAINED, SECTORS = 128, 2, 0.85, 0.25, 2, 0.45, 2.5, 0.3, 0.65, 8
ACCEPT, NEAR, CLAIMED = 0.6, 0.35, 0.5


@dataclass(frozen=True)
class Prototype:
    symbol_class: str
    values: np.ndarray  # quantized ink shares, height x width bytes
    threshold: float
    direction: tuple[float, float] | None = None
    name: str = ""

    @property
    def size(self) -> tuple[int, int]:
        return self.values.shape[1], self.values.shape[0]


def resampled(bits: np.ndarray, width: int, height: int) -> np.ndarray:
    """Shrinking keeps any ink, growing takes the nearest pixel."""
    h, w = bits.shape
    if (w, h) == (width, height):
        return bits

    def pooled(a, n, size):
        low = [i * size // n for i in range(n)]
        high = [max(lo + 1, math.ceil((i + 1) * size / n)) for i, lo in enumerate(low)]
        return np.stack([a[i:j].any(axis=0) for i, j in zip(low, high)])

    return pooled(pooled(bits.astype(bool), height, h).T, width, w).T


def correlation(ink: np.ndarray, cross: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Pearson's, of binary windows with a prototype; 0 where either is uniform."""
    n, s, q = p.size, p.sum(), (p * p).sum()
    below = np.sqrt(np.maximum(0, (n * q - s * s) * (n * ink - ink * ink)))
    return np.divide(n * cross - s * ink, below, out=np.zeros_like(below), where=below > 0)


def learned(symbol_class: str, crops: list[tuple[np.ndarray, tuple | None]]) -> list[Prototype]:
    """crops(bits, unit direction or None) -> a prototype for each direction that is there, those without first."""
    groups: dict[int | None, list] = {}
    for bits, v in crops:
        key = None if v is None else round(math.atan2(v[1], v[0]) / (2 * math.pi / SECTORS)) % SECTORS
        groups.setdefault(key, []).append((bits, v))
    out = []
    for key in sorted(groups, key=lambda k: -1 if k is None else k):
        group = groups[key]
        middle = lambda xs: sorted(xs)[len(xs) // 2]
        width, height = (max(SIDE, middle([b.shape[a] for b, _ in group])) for a in (1, 0))
        same = np.stack([resampled(b, width, height) for b, _ in group]).astype(float)
        values = np.rint(255 * same.sum(axis=0) / len(group)).astype(np.uint8)
        p = values / 255
        scores = correlation(same.sum(axis=(1, 2)), (same * p).sum(axis=(1, 2)), p)
        mean = None
        if key is not None:
            x, y = (sum(v[i] for _, v in group) / len(group) for i in (0, 1))
            mean = (round(x / math.hypot(x, y), 6), round(y / math.hypot(x, y), 6))
        out.append(Prototype(symbol_class, values, round(max(FLOOR, SHARE * scores.min()), 6), mean, symbol_class + (f"@{key}" if key is not None else "")))
    return out


def version(prototypes: list[Prototype], profile: dict) -> str:
    """Of an artifact's content: twelve digits."""
    head = [[p.symbol_class, list(p.size), p.threshold, p.direction] for p in prototypes]
    h = hashlib.sha256(json.dumps({"profile": profile, "prototypes": head}, sort_keys=True).encode())
    for p in prototypes:
        h.update(p.values.tobytes())
    return h.hexdigest()[:12]


def integral(bits: np.ndarray) -> np.ndarray:
    return np.pad(bits.astype(np.int64).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))


def windows(bits: np.ndarray, sums: np.ndarray, p: Prototype) -> Iterator[tuple[float, Prototype, int, int]]:
    """Windows whose ink can match and whose correlation reaches the threshold. Only those that pass the first test are
    correlated."""
    w, h = p.size
    if w > bits.shape[1] or h > bits.shape[0]:
        return
    values = p.values / 255
    ink = sums[h:, w:] - sums[:-h, w:] - sums[h:, :-w] + sums[:-h, :-w]
    y, x = np.nonzero((ink >= max(1.0, LOW * values.sum())) & (ink <= HIGH * values.sum()) & (ink != w * h))
    view = np.lib.stride_tricks.sliding_window_view(bits, (h, w))
    for at in range(0, len(x), 4096):
        part = slice(at, at + 4096)
        cross = np.tensordot(view[y[part], x[part]].astype(float), values, axes=([1, 2], [0, 1]))
        score = correlation(ink[y[part], x[part]].astype(float), cross, values)
        for i in np.flatnonzero(score >= p.threshold):
            yield float(score[i]), p, int(x[at + i]), int(y[at + i])


def trimmed(p: Prototype, x: int, y: int) -> tuple[float, float, float, float]:
    w, h = p.size
    rx, ry = min(RING, (w - SIDE) // 2), min(RING, (h - SIDE) // 2)
    return float(x + rx), float(y + ry), float(x + w - rx), float(y + h - ry)


def suppressed(box: tuple, kept: np.ndarray) -> bool:
    """The box reports ink that a kept one already reports."""
    if not len(kept):
        return False
    w = np.minimum(box[2], kept[:, 2]) - np.maximum(box[0], kept[:, 0])
    h = np.minimum(box[3], kept[:, 3]) - np.maximum(box[1], kept[:, 1])
    both = np.where((w > 0) & (h > 0), w * h, 0.0)
    own, areas = (box[2] - box[0]) * (box[3] - box[1]), (kept[:, 2] - kept[:, 0]) * (kept[:, 3] - kept[:, 1])
    return bool(((both > 0) & ((both / (own + areas - both) >= OVERLAP) | (both / np.minimum(own, areas) >= CONTAINED))).any())


def claimed(window: tuple, kept: list[tuple], sums: np.ndarray) -> bool:
    """Half of the window's ink or more lies in kept windows."""
    ink = lambda a, b, c, d: int(sums[d, c] - sums[b, c] - sums[d, a] + sums[b, a])
    got = 0
    for k in kept:
        a, b, c, d = max(window[0], k[0]), max(window[1], k[1]), min(window[2], k[2]), min(window[3], k[3])
        got += ink(a, b, c, d) if c > a and d > b else 0
    return got >= CLAIMED * ink(*window) and bool(kept)


def detected(gray: np.ndarray, prototypes: list[Prototype], legend: bool = False) -> list[dict]:
    """The best score takes the ink; equal scores go by class and place. With a legend's glyphs, scores under the acceptance
    are reported unclassified unless kept windows explain their ink."""
    bits = gray < INK
    sums = integral(bits)
    found = sorted((c for p in prototypes for c in windows(bits, sums, p)), key=lambda c: (-c[0], c[1].symbol_class, c[3], c[2]))
    boxes, kept, out = np.zeros((0, 4)), [], []
    for score, p, x, y in found:
        box = trimmed(p, x, y)
        window = (x, y, x + p.size[0], y + p.size[1])
        if suppressed(box, boxes) or (legend and score < ACCEPT and claimed(window, kept, sums)):
            continue
        boxes = np.vstack([boxes, box])
        kept.append(window)
        if legend:
            near = f"nearest Legend Dictionary entry {p.symbol_class!r} (glyph {p.name}) at ({x}, {y}): score {score:.3f}, distance {1 - score:.3f}"
            sure = score >= ACCEPT
            evidence = f"{near} (accept >= {ACCEPT})" if sure else f"{near}, below acceptance {ACCEPT} — surfaced unclassified rather than force-assigned"
            name = p.symbol_class if sure else UNCLASSIFIED
        else:
            name, evidence = p.symbol_class, f"prototype {p.symbol_class} ({p.size[0]}x{p.size[1]}) matched at ({x}, {y}) with score {score:.3f} (threshold {p.threshold})"
        out.append({"symbol_class": name, "bbox": box, "confidence": min(1.0, score), "evidence": evidence, "direction": p.direction})
    return out


def glyph(symbol_class: str, gray: np.ndarray) -> Prototype:
    """A legend's glyph as a prototype; a uniform one can match nothing."""
    bits = gray < INK
    if min(bits.shape) < SIDE + 2 * RING or bits.all() or not bits.any():
        raise ValueError(f"the glyph of {symbol_class!r} is too small or uniform")
    return Prototype(symbol_class, (bits * 255).astype(np.uint8), NEAR, None, f"{symbol_class}.png")


SYMBOLS = "document string, sheet int, pos int, id string, symbol_class string, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double, provenance struct<component:string,evidence:string>, direction struct<x:double,y:double>"


def detections(sheets: DataFrame, prototypes: list[Prototype], component: str, legend: bool = False) -> DataFrame:
    """sheets(document, sheet, width, height, raster) -> symbols. The prototypes, one or a few for each class of a profile, are
    broadcast once. A sheet that cannot be read gives one row of the class FAULT."""
    if not prototypes:
        raise ValueError(f"{component} has no prototypes to find symbols with")
    held = sheets.sparkSession.sparkContext.broadcast(prototypes)

    def rows(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    found = detected(pixels(r), held.value, legend)
                except Exception as e:  # one bad sheet never stops a run
                    out.append((r.document, r.sheet, -1, None, FAULT, None, 0.0, reason(e), None))
                    continue
                for i, d in enumerate(found):
                    v = None if d["direction"] is None else dict(zip("xy", d["direction"]))
                    out.append((r.document, r.sheet, i, f"p{r.sheet}-sym{i}", d["symbol_class"], dict(zip(("x0", "y0", "x1", "y1"), d["bbox"])), d["confidence"], {"component": component, "evidence": d["evidence"]}, v))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ("document s", "sheet s", "pos s", "id s", "symbol_class s", "bbox s", "confidence s", "provenance s", "direction s")])

    return sheets.select("document", "sheet", "width", "height", "raster").mapInPandas(rows, SYMBOLS)


def crops(sheets: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled crops in the normalized frame with their ring of context: symbol_class, width, height, bits, direction.

    sheets: normalized; labels(document, sheet, symbol_class, bbox in the normalized frame, direction). Boxes that left the
    canvas are dropped.
    """
    from pyspark.sql import functions as F

    by = ["document", "sheet"]
    per = labels.groupBy(*by).agg(F.collect_list(F.struct("symbol_class", "bbox", "direction")).alias("labels"))

    def rows(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                bits = np.frombuffer(r.raster, np.uint8).reshape(r.height, r.width) < INK
                for x in r.labels:
                    b = x["bbox"]
                    x0, y0 = max(0, math.floor(b["x0"]) - RING), max(0, math.floor(b["y0"]) - RING)
                    x1, y1 = min(r.width, math.ceil(b["x1"]) + RING), min(r.height, math.ceil(b["y1"]) + RING)
                    if x1 - x0 >= SIDE and y1 - y0 >= SIDE:
                        v = x["direction"]
                        n = math.hypot(v["x"], v["y"]) if v is not None else 0
                        crop = bits[y0:y1, x0:x1]
                        out.append((x["symbol_class"], x1 - x0, y1 - y0, crop.astype(np.uint8).tobytes(), {"x": v["x"] / n, "y": v["y"] / n} if n else None))
            yield pd.DataFrame(out, columns=["symbol_class", "width", "height", "bits", "direction"])

    return sheets.join(per, by).select("width", "height", "raster", "labels").mapInPandas(rows, "symbol_class string, width int, height int, bits binary, direction struct<x:double,y:double>")


PROTOTYPES = "symbol_class string, name string, width int, height int, values binary, threshold double, direction array<double>, examples long"


def trained(all_crops: DataFrame) -> DataFrame:
    """One prototype a class and direction; a class's crops meet in one task, as their sizes' median needs them all."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["width", "height", "bits"])
        given = [(np.frombuffer(r.bits, np.uint8).reshape(r.height, r.width).astype(bool), None if r.direction is None else (r.direction["x"], r.direction["y"])) for r in pdf.itertuples()]
        out = [(p.symbol_class, p.name, *p.size, p.values.tobytes(), p.threshold, None if p.direction is None else list(p.direction), len(given)) for p in learned(pdf["symbol_class"].iloc[0], given)]
        return pd.DataFrame(out, columns=["symbol_class", "name", "width", "height", "values", "threshold", "direction", "examples"])

    return all_crops.groupBy("symbol_class").applyInPandas(fit, PROTOTYPES)


def gathered(table: DataFrame) -> list[Prototype]:
    """A profile's prototypes, some tens, on the driver."""
    return [Prototype(r.symbol_class, np.frombuffer(bytes(r["values"]), np.uint8).reshape(r.height, r.width), r.threshold, None if r.direction is None else tuple(r.direction), r.name) for r in table.orderBy("symbol_class", "name").toLocalIterator()]
