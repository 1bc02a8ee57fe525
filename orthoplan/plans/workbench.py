"""The review workbench's service: states, queues, overlays, figures and verdicts of one run folder, over HTTP.

Records are read once for each question; verdicts and the activity log are appended, and the latest verdict counts.
"""

from __future__ import annotations

import html
import json
import re
import threading
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplan.operators import overlay, review
from orthoplan.plans.kpi import display_kpi
from orthoplan.sources import records, sinks

VERDICTS = "profile_name string, profile_version string, sheet int, detection_id string, verdict string, kind string, detection string, correction string, seq long"


class Workbench:
    def __init__(self, spark: SparkSession, run: str | Path, labels: str | Path | None = None, clock: Callable[[], datetime] | None = None, idle_minutes: float = review.IDLE_MINUTES):
        self.spark, self.run = spark, Path(run)
        self.labels = Path(labels) if labels else self.run / "labels"
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.idle, self.lock = idle_minutes, threading.Lock()

    def records(self) -> DataFrame:
        return records.records(self.spark, f"file://{self.run}/detections/*")

    def detections(self) -> DataFrame:
        return records.detections(self.records())

    def verdicts(self) -> DataFrame:
        log = self.labels / "verdicts.jsonl"
        return self.spark.read.schema(VERDICTS).json(f"file://{log}") if log.exists() else self.spark.createDataFrame([], VERDICTS)

    def events(self) -> DataFrame:
        log = self.labels / "activity.jsonl"
        rows = [(self.run.name, i, x) for i, x in enumerate(log.read_text(encoding="utf-8").split("\n"))] if log.exists() else []
        return records.parsed_events(self.spark.createDataFrame(rows, "document string, line_no long, value string"))

    def progress(self) -> list[dict]:
        j = review.judged(self.detections(), self.verdicts()).groupBy("sheet").agg(F.count("*").alias("total"), F.count("verdict").alias("decided"))
        s = self.records().select("sheet", "readable").join(j, "sheet", "left").fillna(0, ["total", "decided"])
        state = F.when(F.col("readable"), review.review_state(F.col("decided"), F.col("total"))).otherwise("unreadable")
        return [r.asDict() for r in s.select("sheet", state.alias("state"), "decided", "total").orderBy("sheet").collect()]

    def known(self, sheet: int) -> bool:
        return not self.records().filter(F.col("readable") & (F.col("sheet") == sheet)).isEmpty()

    def queue(self, sheet: int, kind: str | None = None) -> dict:
        if kind and kind not in review.KINDS:
            raise ValueError(f"a kind is one of {list(review.KINDS)}, got {kind!r}")
        d = self.detections().filter(F.col("sheet") == sheet)
        d = d.filter(F.col("kind") == kind) if kind else d
        left = review.queue(d, self.verdicts()).orderBy("rank").select("id", "kind", "confidence").collect()
        return {"sheet": sheet, "kind": kind, "total": d.count(), "remaining": len(left), "queue": [r.asDict() for r in left]}

    def raster(self, sheet: int) -> bytes | None:
        path = self.run / "sheets" / f"sheet_{sheet}.png"
        return path.read_bytes() if path.is_file() else None

    def examples(self, sheet: int) -> dict:
        """A sheet's latest verdicts, by detection."""
        rows = review.latest_verdicts(self.verdicts().filter(F.col("sheet") == sheet)).orderBy("detection_id").collect()
        given = lambda r: {"verdict": r.verdict, "kind": r.kind, "detection": json.loads(r.detection)} | ({"correction": json.loads(r.correction)} if r.correction else {})
        return {"sheet": sheet, "examples": {r.detection_id: given(r) for r in rows}}

    def index(self) -> str:
        """The start page: every sheet with its state, and the key figures."""
        f = next(x for x in self.kpi() if x["level"] == "overall")
        rows = "".join(f'<li><a href="/sheet/{s["sheet"]}">Sheet {s["sheet"]}</a>: {s["state"]}, {s["decided"]} of {s["total"]} decided</li>' for s in self.progress())
        figures = f"corrections per 100 symbols: {display_kpi(f['corrections_per_100_symbols'])}; minutes per accepted sheet: {display_kpi(f['minutes_per_accepted_sheet'])}"
        return f"<!doctype html><title>Review</title><h1>{html.escape(self.run.name)}</h1><p>{figures}</p><ul>{rows}</ul>"

    def page(self, sheet: int) -> str | None:
        """A sheet's page: the scan, its overlay, and a button for each verdict. To open it is activity."""
        svg = self.overlay(sheet)
        if svg is None:
            return None
        self.opened(sheet)
        buttons = "".join(f'<button data-verdict="{v}">{v}</button>' for v in review.VERDICTS)
        return f'<!doctype html><title>Sheet {sheet}</title><p><a href="/">all sheets</a> {buttons}</p><div style="position:relative"><img src="/sheet/{sheet}/raster.png" alt="">{svg}</div>'

    def overlay(self, sheet: int) -> str | None:
        d = review.judged(self.detections().filter(F.col("sheet") == sheet), self.verdicts())
        x = F.from_json("detection", "symbol_class STRING, line_class STRING, text_class STRING, string STRING, bbox ARRAY<DOUBLE>, polyline ARRAY<ARRAY<DOUBLE>>")
        d = d.withColumn("x", x)
        box = F.struct(*[F.col("x.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
        line = F.transform("x.polyline", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        title = F.concat_ws(" ", F.coalesce("x.symbol_class", "x.line_class", "x.text_class"), "x.string", "id", F.lit("conf"), "confidence")
        d = d.withColumns({"bbox": box, "polyline": line, "title": title})
        size = F.from_json("normalization", "original_size ARRAY<INT>")["original_size"]
        sizes = self.records().filter(F.col("sheet") == sheet).select(F.col("run").alias("document"), "sheet", size[0].alias("width"), size[1].alias("height"))
        row = overlay.overlays(d, sizes).first()
        return row and row.svg

    def kpi(self) -> list[dict]:
        s = self.records().select(F.col("run").alias("document"), "sheet", F.col("profile.name").alias("profile_name"), F.col("profile.version").alias("profile_version"), "readable")
        rows = review.sheet_rows(s, self.detections(), self.verdicts(), self.events().filter("at IS NOT NULL"), self.idle)
        return [r.asDict() for r in review.kpi_report(rows).collect()]

    def opened(self, sheet: int) -> dict:
        with self.lock:
            return sinks.append_event(self.labels / "activity.jsonl", self.clock().isoformat(), "open", sheet)

    def judge(self, sheet: int, detection_id: str, verdict: str, correction: dict | None = None) -> dict:
        """Checks a verdict, appends it to the store and then to the log."""
        found = self.detections().filter((F.col("sheet") == sheet) & (F.col("id") == detection_id)).first()
        if found is None:
            raise KeyError(f"sheet {sheet} has no detection {detection_id!r}")
        c = correction or {}
        allowed = {"symbol": {"bbox"}, "line": {"polyline"}, "text": {"bbox", "string"}}[found.kind]
        if set(c) - allowed:
            raise ValueError(f"a {found.kind} is corrected by {sorted(allowed)}, got {sorted(c)}")
        args = (F.lit(found.kind), F.lit(verdict), F.from_json(F.lit(json.dumps(c)), "bbox ARRAY<DOUBLE>, polyline ARRAY<ARRAY<DOUBLE>>, string STRING"))
        why = self.spark.range(1).select(review.example_problem(args[0], args[1], args[2]["bbox"], args[2]["polyline"], args[2]["string"], F.lit(correction is not None)).alias("why")).first().why
        if why:
            raise ValueError(why)
        with self.lock:
            log = self.labels / "verdicts.jsonl"
            log.parent.mkdir(parents=True, exist_ok=True)
            seq = sum(1 for _ in log.open(encoding="utf-8")) if log.exists() else 0
            row = {"profile_name": found.profile_name, "profile_version": found.profile_version, "sheet": sheet, "detection_id": detection_id, "verdict": verdict, "kind": found.kind, "detection": found.detection, "correction": json.dumps(correction) if correction else None, "seq": seq}
            with log.open("a", encoding="utf-8") as f:
                f.write(json.dumps(row, ensure_ascii=False) + "\n")
            sinks.append_event(self.labels / "activity.jsonl", self.clock().isoformat(), "verdict", sheet, detection_id=detection_id, verdict=verdict)
        return row


def server(bench: Workbench, port: int = 0) -> ThreadingHTTPServer:
    """GET /, /progress, /kpi, /sheet/N, /sheet/N/queue[?kind=], /sheet/N/overlay.svg, /sheet/N/raster.png, /sheet/N/verdicts; POST
    /sheet/N/verdicts (detection_id, verdict, correction). On this machine only."""
    plain, page, picture = "application/json; charset=utf-8", "text/html; charset=utf-8", "image/svg+xml; charset=utf-8"

    def sheet_page(n: int, part: str, query: dict):
        """(body, type) of a part of a sheet's pages, None if there is none."""
        if part == "overlay.svg":
            bench.opened(n)
            return bench.overlay(n), picture
        if part == "raster.png":
            return bench.raster(n), "image/png"
        if part == "":
            return bench.page(n), page
        if not bench.known(n):
            return None, plain
        return {"queue": lambda: bench.queue(n, query.get("kind", [None])[0]), "verdicts": lambda: bench.examples(n)}[part](), plain

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def answer(self, status: int, body, kind: str = plain) -> None:
            data = body if isinstance(body, bytes) else (body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            url = urlsplit(self.path)
            try:
                if url.path == "/":
                    return self.answer(200, bench.index(), page)
                if url.path == "/progress":
                    return self.answer(200, bench.progress())
                if url.path in ("/kpi", "/kpi.json"):
                    return self.answer(200, bench.kpi())
                if m := re.fullmatch(r"/sheets?/(\d+)/?(|queue|verdicts|overlay\.svg|raster\.png)", url.path):
                    body, kind = sheet_page(int(m[1]), m[2], parse_qs(url.query))
                    return self.answer(200, body, kind) if body is not None else self.answer(404, {"error": f"there is no such page of sheet {m[1]}"})
            except ValueError as e:
                return self.answer(400, {"error": str(e)})
            return self.answer(404, {"error": "no such page"})

        def do_POST(self):
            m = re.fullmatch(r"/sheets?/(\d+)/verdicts", self.path)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                if not m:
                    return self.answer(404, {"error": "no such page"})
                if not isinstance(body, dict):
                    return self.answer(400, {"error": "a verdict is a JSON object"})
                return self.answer(200, bench.judge(int(m[1]), body.get("detection_id", body.get("id")), body.get("verdict"), body.get("correction")))
            except KeyError as e:
                return self.answer(404, {"error": str(e)})
            except ValueError as e:
                return self.answer(400, {"error": str(e)})

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
