"""Figures of several runs, the service's pages, training, the reading set and page readers."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from test_evaluation import PROFILE, folder  # noqa: F401
from test_workbench import bench  # noqa: F401

from orthoplan.operators.raster import png
from orthoplan.plans import evaluation, kpi, ocr_set, training
from orthoplan.plans.workbench import Workbench, server
from orthoplan.sources import bundles, pages
from orthoplan.sources import profile as profiles


def test_pages_of_the_service(bench):  # noqa: F811
    (bench.run / "sheets").mkdir()
    (bench.run / "sheets" / "sheet_1.png").write_bytes(png.encode(np.zeros((2, 3), np.uint8)))
    s = server(bench)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{s.server_port}"
    get = lambda path: urllib.request.urlopen(root + path).read()

    def status(path, body=None):
        try:
            return urllib.request.urlopen(urllib.request.Request(root + path, body)).status
        except urllib.error.HTTPError as e:
            return e.code

    index = get("/").decode()
    assert 'href="/sheet/1"' in index and "not yet measurable" in index
    page = get("/sheet/1").decode()
    assert all(f'data-verdict="{v}"' in page for v in ("pass", "reject", "edit")) and 'src="/sheet/1/raster.png"' in page and "<svg" in page
    assert png.decode(get("/sheet/1/raster.png")).shape == (2, 3)
    assert [status(p) for p in ("/sheet/9", "/sheet/2", "/sheet/2/raster.png", "/sheet/9/queue", "/sheet/1/queue?kind=pipe", "/extract")] == [404, 404, 404, 404, 400, 404]
    assert status("/sheet/1/verdicts", json.dumps({"detection_id": "a", "verdict": "pass"}).encode()) == 200
    assert status("/sheet/1/verdicts", b"[1]") == 400
    got = json.loads(get("/sheet/1/verdicts"))
    assert got["examples"]["a"]["verdict"] == "pass" and list(got["examples"]) == ["a"]
    s.shutdown()


def test_figures_of_several_runs(spark, bench, tmp_path):  # noqa: F811
    bench.judge(1, "a", "pass")
    bench.judge(1, "b", "reject")
    bench.judge(1, "l", "pass")
    other = tmp_path / "other"
    (other / "detections").mkdir(parents=True)
    (other / "detections" / "sheet_1.json").write_text((bench.run / "detections" / "sheet_1.json").read_text())
    (other / "plant_model_dexpi.json").write_text(json.dumps({"sourceDrawing": "drawing 7"}))
    first, second = kpi.run_figures(bench), kpi.run_figures(Workbench(spark, other))
    r = kpi.report([first, second])
    assert [(f["document"], f["total"], f["accepted"]) for f in r["documents"]] == [("drawing 7", 1, 0), ("run", 2, 1)]
    assert r["profiles"][0]["documents"] == ["drawing 7", "run"] and r["overall"]["total"] == 3 and r["overall"]["corrections_per_100_symbols"] == 50.0
    text = kpi.summary(r)
    assert "corrections per 100 symbols: 50.0 (1 of 2 reviewed)" in text and "not yet measurable" in text
    with pytest.raises(ValueError, match="idle threshold"):
        kpi.report([first, kpi.run_figures(Workbench(spark, other, idle_minutes=3.0))])


def test_training_writes_an_artifact_that_loads(spark, folder, tmp_path):  # noqa: F811
    manifest = training.train(spark, [str(folder)], PROFILE, str(tmp_path / "model"))
    assert set(manifest["classes"]) == {"tank", "nozzle", "gate_valve", "instrument_bubble", "opc", "flow_arrow"}
    assert manifest["sources"] == [{"root": str(folder), "sheets": 2, "examples": 14}]
    assert bundles.trained(str(tmp_path / "model"), PROFILE.identity()).component.endswith(manifest["version"])
    with pytest.raises(ValueError, match="at least one"):
        training.train(spark, [], PROFILE, str(tmp_path / "none"))


def test_reading_set(spark, tmp_path):
    gray, tags = ocr_set.sheet(3, "s")
    again = ocr_set.sheet(3, "s")
    assert (gray == again[0]).all() and tags == again[1] and tags != ocr_set.sheet(4, "s")[1]
    assert len(tags) == 12 and {t.text_class for t in tags} == set(ocr_set.TAGS)
    rest = gray.copy()
    rest[[1, -2]] = rest[:, [1, -2]] = 255
    for t in tags:
        x0, y0, x1, y1 = map(int, t.bbox)
        assert (gray[y0:y1, x0:x1] == 0).any()
        rest[y0:y1, x0:x1] = 255
    assert (rest == 255).all()
    made = ocr_set.put(str(tmp_path), 2, 0)
    assert made["tags"] == {"clean": 24, "degraded": 24}
    who = profiles.load(tmp_path / "profile")
    truth = evaluation.EvalSet(spark, f"file://{tmp_path}/degraded", who)
    assert truth.tags.count() == 24
    assert evaluation.gate_report(evaluation.EvalSet(spark, f"file://{tmp_path}/clean", who), who)["metrics"]["tag"]["exact_match"] == 1.0


def test_page_readers(spark):
    def read(path, page, dpi):
        if page > 1:
            raise IndexError("no such page")
        return pages.Page(2, 1, b"\x00\xff", [("T-1", [0.0, 0.0, 9.0, 5.0])])

    got = pages.read_pages(spark.createDataFrame([("a.pdf", 1, 72), ("a.pdf", 2, 72)], "path string, page int, dpi int"), read)
    rows = {r.page: r for r in got.collect()}
    assert (rows[1].width, rows[1].height, bytes(rows[1].raster)) == (2, 1, b"\x00\xff") and rows[2].error == "IndexError: no such page"
    assert [(r.page, r.pos, r.string) for r in pages.spans_of(got).collect()] == [(1, 0, "T-1")]
    with pytest.raises(RuntimeError, match="PyMuPDF"):
        pages.read_pages(got.select("path", "page", "dpi"))
