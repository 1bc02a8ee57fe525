"""The synthetic sheet: two tanks, a valve between them, a bubble, an off-page connector and an arrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orthoplan.operators import lexicon, plant
from orthoplan.operators.assembly import Assembly, assembled
from orthoplan.sources import annotations
from orthoplan.sources.annotations import noised  # noqa: F401

SYMBOLS = [("tank", (20, 80, 60, 140), None), ("nozzle", (58, 106, 66, 114), None), ("gate_valve", (180, 100, 200, 120), None), ("tank", (320, 80, 360, 140), None), ("instrument_bubble", (180, 30, 200, 50), None), ("opc", (365, 160, 395, 180), None), ("flow_arrow", (115, 105, 125, 115), (1, 0))]
LINES = [([(66, 110), (180, 110)], "pipe"), ([(200, 110), (320, 110)], "pipe"), ([(340, 140), (340, 170), (365, 170)], "pipe")]
TEXTS = [("T-101", "equipment_tag", (20, 60, 60, 72)), ("V-101", "equipment_tag", (175, 125, 205, 137)), ("T-102", "equipment_tag", (320, 60, 360, 72)), ("PI-100", "instrument_tag", (178, 50, 202, 62)), ("150-GA-001", "line_number", (90, 90, 150, 100)), ("DW02-0003", "opc_label", (367, 163, 393, 177))]
LEGEND = [("tank", "Equipment", "tank", None, "capsule"), ("nozzle", "Nozzle", None, None, None), ("gate_valve", "PipingComponent", "valve", "GateValve", None), ("instrument_bubble", "ProcessInstrumentationFunction", "instrument", None, None), ("opc", "PipeOffPageConnector", "line", None, None), ("flow_arrow", "FlowArrow", None, None, None)]
GRAMMAR = {"equipment_tag": r"[A-Z]-\d{3}", "instrument_tag": r"[A-Z]{2}-\d{3}", "line_number": r"\d{2,3}-[A-Z]{2}-\d{3}", "opc_label": r"[A-Z]{2}\d{2}-\d{4}", "opc_direction": r"(?:FROM|TO) [A-Z]{2}\d{2}-\d{4}"}
SEMANTICS = {"pipe": "PipingNetworkSegment", "signal": "SignalLine"}


def _box(b):
    return tuple(map(float, b))


def _point(p):
    return None if p is None else tuple(map(float, p))


def sheet(symbols=None, lines=None, texts=None, number: int = 1, document: str = "synthetic", raster: bytes | None = None) -> tuple:
    symbols, lines, texts = (SYMBOLS if symbols is None else symbols), (LINES if lines is None else lines), (TEXTS if texts is None else texts)
    a = ([(c, _box(b), _point(v)) for c, b, v in symbols], [([_point(p) for p in ps], k) for ps, k in lines], [(s, c, _box(b)) for s, c, b in texts])
    return (document, number, 400, 200, raster, a)


def sheets(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows) or [sheet()], annotations.SHEETS)


def legend(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEGEND, "symbol_class string, role string, equipment_type string, component_class string, shape string")


def assembly(spark: SparkSession, *rows: tuple, noise: bool = False) -> Assembly:
    s = sheets(spark, *rows)
    texts = lexicon.decoded(annotations.texts(s, noise), GRAMMAR)
    return assembled(annotations.symbols(s), annotations.lines(s), texts, legend(spark))


def plant_edges(spark: SparkSession) -> DataFrame:
    return plant.edges(assembly(spark)).select("sheet", "source", "target", "direction", "confidence", "provenance")
