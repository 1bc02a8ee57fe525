"""A sheet's detections as an SVG overlay, one string a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoplan.functions.text import escaped


def number(c: Column) -> Column:
    """Without a trailing zero part."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), r"0+$", ""), r"\.$", "")


def element(kind: Column, detection_id: Column, verdict: Column, title: Column, bbox: Column, polyline: Column) -> Column:
    attributes = F.concat(F.lit(' data-id="'), escaped(detection_id), F.lit('"'), F.coalesce(F.concat(F.lit(' data-verdict="'), escaped(verdict), F.lit('"')), F.lit("")))
    title = F.concat(F.lit("<title>"), escaped(title), F.lit("</title>"))
    x0, y0, x1, y1 = (bbox[k] for k in ("x0", "y0", "x1", "y1"))
    rect = F.concat(F.lit('<rect class="'), kind, F.lit('"'), attributes, F.lit(' x="'), number(x0), F.lit('" y="'), number(y0), F.lit('" width="'), number(x1 - x0), F.lit('" height="'), number(y1 - y0), F.lit('">'), title, F.lit("</rect>"))
    points = F.array_join(F.transform(polyline, lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]))), " ")
    line = F.concat(F.lit('<polyline class="line"'), attributes, F.lit(' points="'), points, F.lit('">'), title, F.lit("</polyline>"))
    return F.when(kind == "line", line).otherwise(rect)


def overlays(detections: DataFrame, sizes: DataFrame) -> DataFrame:
    """detections(document, sheet, kind, kind_ord, pos, id, verdict, title, bbox, polyline), sizes(document, sheet, width, height)
    -> document, sheet, svg: symbols, lines and texts in their order."""
    e = element(*[F.col(c) for c in ("kind", "id", "verdict", "title", "bbox", "polyline")])
    body = detections.groupBy("document", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind_ord", "pos", e.alias("e")))), lambda x: x["e"]), "").alias("body"))
    head = F.concat(F.lit('<svg viewBox="0 0 '), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit('">'))
    return sizes.join(body, ["document", "sheet"], "left").select("document", "sheet", F.concat(head, F.coalesce("body", F.lit("")), F.lit("</svg>")).alias("svg"))
