"""Scanned PDFs as sheets, with no PDF library: enough of the format for one gray image a page.

Every page is classified before any raster is taken; a document with vector marks on a page is refused as a whole.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Operators that paint paths or show text.
VECTOR = {b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"sh", b"Tj", b"TJ", b"'", b'"'}
OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[^\s<>\[\]()/]+|[\[\]]|<<|>>", re.S)


class IntakeError(ValueError):
    pass


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise IntakeError("not a PDF")
        self.objects = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
        if not self.objects:
            raise IntakeError("a PDF without plain objects")

    def head(self, n: int) -> bytes:
        return self.objects.get(n, b"").split(b"stream", 1)[0]

    def stream(self, n: int) -> bytes:
        """The object's stream, inflated if it says so."""
        head, _, body = self.objects.get(n, b"").partition(b"stream")
        body = body.lstrip(b"\r").removeprefix(b"\n")
        size = re.search(rb"/Length\s+(\d+)(\s+\d+\s+R)?", head)
        length = None if not size else int(self.objects.get(int(size[1]), b"0")) if size[2] else int(size[1])
        body = body[:length] if length is not None else body.rsplit(b"endstream", 1)[0]
        return zlib.decompress(body) if b"/FlateDecode" in head else body

    def refs(self, text: bytes) -> list[int]:
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", text)]

    def value(self, head: bytes, key: bytes) -> bytes:
        """A key's dictionary, array or reference as text; references to dictionaries are followed."""
        m = re.search(rb"/" + key + rb"\b\s*", head)
        if not m:
            return b""
        rest = head[m.end() :]
        if r := re.match(rb"(\d+)\s+\d+\s+R", rest):
            return self.head(int(r[1])) if key in (b"Resources", b"XObject") else r[0]
        if rest.startswith(b"<<"):
            depth, at = 0, 0
            for t in re.finditer(rb"<<|>>", rest):
                depth += 1 if t[0] == b"<<" else -1
                at = t.end()
                if not depth:
                    break
            return rest[:at]
        return re.match(rb"\[[^\]]*\]|/?[^\s/>]+", rest)[0]

    def pages(self) -> list[int]:
        root = next((n for n in self.objects if re.search(rb"/Type\s*/Catalog", self.head(n))), None)
        out: list[int] = []
        todo = self.refs(self.value(self.head(root), b"Pages")) if root is not None else []
        while todo:
            n = todo.pop(0)
            if re.search(rb"/Type\s*/Pages\b", self.head(n)):
                todo = self.refs(self.value(self.head(n), b"Kids")) + todo
            else:
                out.append(n)
        return out

    def inspected(self, content: bytes, resources: bytes, depth: int = 0) -> tuple[bool, list[int]]:
        """Whether the content paints vector marks, and the images it draws; forms are walked to depth 8."""
        names = dict(re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"XObject")))
        vector, images, last = False, [], b""
        for t in TOKEN.findall(re.sub(rb"\bBI\b.*?\bEI\b", b" ", content, flags=re.S)):
            if t in VECTOR:
                vector = True
            elif t == b"Do" and last[1:] in names:
                n = int(names[last[1:]])
                if re.search(rb"/Subtype\s*/Image", self.head(n)):
                    images.append(n)
                elif re.search(rb"/Subtype\s*/Form", self.head(n)) and depth < 8:
                    v, more = self.inspected(self.stream(n), self.value(self.head(n), b"Resources"), depth + 1)
                    vector, images = vector or v, images + more
            last = t
        return vector, images

    def raster(self, n: int, sheet: int) -> tuple[int, int, bytes]:
        head = self.head(n)
        number = lambda k, d=0: int((re.search(rb"/" + k + rb"\s+(\d+)", head) or [0, d])[1])
        filters = set(re.findall(rb"/\w+Decode\b", head))
        if filters - {b"/FlateDecode"}:
            raise IntakeError(f"the image on sheet {sheet} uses {', '.join(sorted(f.decode() for f in filters))}")
        if not re.search(rb"/ColorSpace\s*/DeviceGray", head) or number(b"BitsPerComponent", 8) != 8:
            raise IntakeError(f"the image on sheet {sheet} is not 8-bit gray")
        w, h, data = number(b"Width"), number(b"Height"), self.stream(n)
        if len(data) != w * h:
            raise IntakeError(f"the image on sheet {sheet} has {len(data)} bytes, not {w * h}")
        return w, h, data


def sheets_of(data: bytes) -> list[tuple[int, int, bytes]]:
    pdf = Pdf(data)
    found = []
    for n in pdf.pages():
        head = pdf.head(n)
        content = b"\n".join(pdf.stream(r) for r in pdf.refs(pdf.value(head, b"Contents")))
        found.append(pdf.inspected(content, pdf.value(head, b"Resources")))
    if vector := [i for i, (v, _) in enumerate(found, 1) if v]:
        raise IntakeError(f"vector line work or text on sheet {', '.join(map(str, vector))}: not a scan")
    for i, (_, images) in enumerate(found, 1):
        if len(images) != 1:
            raise IntakeError(f"sheet {i} has {len(images)} images, not one")
    return [pdf.raster(images[0], i) for i, (_, images) in enumerate(found, 1)]


def scanned(files: DataFrame) -> DataFrame:
    """files(path, content), as read by the binaryFile source -> document, sheet, width, height, raster, error: the sheets of
    each document, or one row with the reason why the whole document is refused."""

    def rows(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    out += [(name, i, w, h, r, None) for i, (w, h, r) in enumerate(sheets_of(content), 1)]
                except (IntakeError, zlib.error) as e:
                    out.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["document", "sheet", "width", "height", "raster", "error"]).astype({"sheet": "Int32", "width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(rows, "document string, sheet int, width int, height int, raster binary, error string")


def load(spark, path: str) -> DataFrame:
    """The sheets of one or many PDFs; refuses if any document is refused."""
    found = scanned(spark.read.format("binaryFile").load(path))
    return found.select("document", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("document", F.lit(": "), "error"))).otherwise(F.col("sheet")).cast("int").alias("sheet"), "width", "height", "raster")
