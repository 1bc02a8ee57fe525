"""Training sets from topology artifacts: labels, links, rasters and degraded variants as an evaluation folder.

An artifact that is not sound is an error row; it never stops the others.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplan.operators import label_factory
from orthoplan.operators.raster import degrade, png
from orthoplan.plans.tables import written
from orthoplan.sources import records, sinks

PAGES = "page int, width int, height int, raster binary"


def labels(spark: SparkSession, pattern: str, spans: DataFrame, dpi: int = label_factory.DPI) -> dict[str, DataFrame]:
    """All sound artifacts' labels and links, and the errors of the others."""
    found = written(records.artifacts(spark, pattern), "artifacts")
    nodes, edges = records.exploded(found)
    scale = dpi / 72
    return {
        "symbols": label_factory.symbol_labels(nodes, scale=scale), "lines": label_factory.line_labels(edges, scale=scale), "texts": label_factory.text_labels(nodes, edges, spans, scale=scale),
        "links": label_factory.connectivity(nodes, edges), "errors": found.filter("error IS NOT NULL").select("page", "error"),
    }


def put(root: str | Path, profile: dict, made: dict[str, DataFrame], rasters: DataFrame) -> dict:
    """labels/, connectivity/ and sheets/ under root, sheet by sheet; rasters(sheet, width, height, raster). Labels are written
    last, so a folder with labels is whole."""
    from urllib.parse import quote

    root, n = Path(root), 0
    key = quote(profile["name"], safe="") + "@" + quote(profile["version"], safe="")
    for r in rasters.toLocalIterator():
        path = root / "sheets" / f"sheet_{r.sheet}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png.encode(np.frombuffer(r.raster, np.uint8).reshape(r.height, r.width)))
    plain = made["links"].groupBy("sheet").agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "target", F.struct("direction", "direction_sources", "line_numbers", "confidence", "provenance").alias("attributes"))))).alias("links"))
    for r in made["symbols"].select("sheet").distinct().join(plain, "sheet", "left").toLocalIterator():
        sinks.put_json(root / "connectivity" / f"sheet_{r.sheet}.json", {"profile": profile, "sheet": r.sheet, "links": json.loads(r.links or "[]")})
    e = label_factory.examples(made["symbols"], made["lines"], made["texts"])
    flat = lambda c: F.when(F.col(c).isNotNull(), F.array(*[F.col(c)[k] for k in ("x0", "y0", "x1", "y1")]))
    line = F.transform("polyline", lambda p: F.array(p["x"], p["y"]))
    e = e.withColumn("detection", F.to_json(F.struct("id", "sheet", "symbol_class", "line_class", "text_class", "string", flat("bbox").alias("bbox"), line.alias("polyline"), "confidence", "provenance")))
    per = e.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("kind_ord", "pos", "id", "kind", "detection"))).alias("e"))
    for r in per.toLocalIterator():
        examples = {x.id: {"verdict": "pass", "kind": x.kind, "detection": json.loads(x.detection)} for x in r.e}
        sinks.put_json(root / "labels" / key / f"sheet_{r.sheet}.json", {"profile": profile, "sheet": r.sheet, "examples": examples})
        n += 1
    return {"sheets": n, "root": str(root)}


def put_variants(root: str | Path, profile: dict, made: dict[str, DataFrame], rasters: DataFrame, variants: list[degrade.Variant], width: int, height: int) -> list[dict]:
    """Each degraded variant as a folder of its own under variants/."""
    sheets = rasters.select(F.lit("d").alias("document"), "sheet", "width", "height", "raster")
    copies = written(degrade.degraded_sheets(sheets, variants), "variants")
    out = []
    for v in variants:
        s, n, t, k = label_factory.degraded_labels(made["symbols"], made["lines"], made["texts"], made["links"], v.transforms, width, height)
        moved = {"symbols": s, "lines": n, "texts": t, "links": k}
        out.append(put(Path(root) / "variants" / v.name, profile, moved, copies.filter(F.col("variant") == v.name)) | {"variant": v.name})
    return out


