"""Annotated sheets as detections: what a perfect detector and reader would give.

sheets(document, sheet, annotations struct<symbols array<...>, lines array<...>, texts array<...>>)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT = "struct<x:double,y:double>"
ANNOTATIONS = f"struct<symbols:array<struct<symbol_class:string,bbox:{BOX},direction:{POINT}>>,lines:array<struct<polyline:array<{POINT}>,line_class:string>>,texts:array<struct<string:string,text_class:string,bbox:{BOX}>>>"
SHEETS = f"document string, sheet int, width int, height int, raster binary, annotations {ANNOTATIONS}"


def noised(s: Column) -> Column:
    """Digits as the letters that they are mistaken for."""
    return F.translate(s, "05182", "OSIBZ")


def _rows(sheets: DataFrame, part: str, mark: str) -> DataFrame:
    """A sheet without annotations gives no rows; missing() names it."""
    d = sheets.select("document", "sheet", F.posexplode(F.col(f"annotations.{part}")).alias("pos", "a")).select("document", "sheet", "pos", "a.*")
    return d.withColumn("id", F.concat(F.lit("p"), F.col("sheet").cast("string"), F.lit(mark), F.col("pos").cast("string"))).withColumn("confidence", F.lit(1.0))


def missing(sheets: DataFrame) -> DataFrame:
    """document, sheet, reason of the sheets that have no annotations."""
    return sheets.filter("annotations IS NULL").select("document", "sheet", F.concat(F.lit("sheet "), F.col("sheet").cast("string"), F.lit(" has no annotations")).alias("reason"))


def _provenance(component: str, what: str) -> Column:
    return F.struct(F.lit(component).alias("component"), F.concat(F.lit(what), F.col("pos").cast("string")).alias("evidence"))


def symbols(sheets: DataFrame) -> DataFrame:
    return _rows(sheets, "symbols", "-sym").withColumn("provenance", _provenance("stub-symbol-detector", "annotation symbol "))


def lines(sheets: DataFrame) -> DataFrame:
    return _rows(sheets, "lines", "-line").withColumn("provenance", _provenance("stub-line-reader", "annotation line "))


def texts(sheets: DataFrame, noise: bool = False) -> DataFrame:
    d = _rows(sheets, "texts", "-text").withColumn("provenance", _provenance("stub-text-recognizer", "annotation text "))
    d = d.withColumn("string", noised(F.col("string"))) if noise else d
    none = F.lit(None).cast("string")
    return d.withColumns({"raw_string": none, "correction": none})
