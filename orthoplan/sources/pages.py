"""Pages of drawing files as rasters and text spans, by any renderer that reads one page at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Page:
    """A rendered page: gray pixels row by row, and its text layer as (string, box in points)."""

    width: int
    height: int
    raster: bytes
    spans: list[tuple[str, list[float]]] = field(default_factory=list)


def pymupdf_reader() -> Callable[[str, int, int], Page]:
    """read(path, page, dpi) with PyMuPDF; refused by name if it is not installed."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("pages are rendered by PyMuPDF, which is not installed; give read_pages another reader") from e

    def read(path: str, page: int, dpi: int) -> Page:
        with pymupdf.open(path) as doc:
            p = doc[page - 1]
            image = p.get_pixmap(matrix=pymupdf.Matrix(dpi / 72, dpi / 72), colorspace=pymupdf.csGRAY, alpha=False)
            lines = [line for block in p.get_text("dict")["blocks"] for line in block.get("lines", [])]
            return Page(image.width, image.height, bytes(image.samples), [(s["text"], [float(v) for v in s["bbox"]]) for line in lines for s in line["spans"]])

    return read


PAGES = "path string, page int, dpi int, width int, height int, raster binary, spans array<struct<string:string,bbox:array<double>>>, error string"


def read_pages(requests: DataFrame, reader: Callable[[str, int, int], Page] | None = None) -> DataFrame:
    """requests(path, page, dpi) -> + width, height, raster, spans, error. A page that cannot be read is an error row."""
    read = reader or pymupdf_reader()

    def rows(batches):
        for pdf in batches:
            out = []
            for path, page, dpi in zip(pdf["path"], pdf["page"], pdf["dpi"]):
                try:
                    p = read(path, int(page), int(dpi))
                    out.append((path, page, dpi, p.width, p.height, p.raster, [{"string": s, "bbox": list(b)} for s, b in p.spans], None))
                except Exception as e:  # one bad page never stops the others
                    out.append((path, page, dpi, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page", "dpi", "width", "height", "raster", "spans", "error"]).astype({"width": "Int32", "height": "Int32"})

    return requests.select("path", "page", "dpi").mapInPandas(rows, PAGES)


def spans_of(pages: DataFrame) -> DataFrame:
    """page, pos, string, bbox, as the label factory takes them."""
    return pages.filter("error IS NULL").select("page", F.posexplode("spans").alias("pos", "s")).select("page", "pos", "s.*")
