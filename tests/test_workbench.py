import json
import threading
import urllib.error
import urllib.request
from datetime import datetime, timedelta, timezone

import pytest

from orthoplan.plans.workbench import Workbench, server


@pytest.fixture
def bench(spark, tmp_path):
    folder = tmp_path / "run" / "detections"
    folder.mkdir(parents=True)
    prov = {"component": "c", "evidence": "e"}
    record = {
        "sheet": 1, "profile": {"name": "p", "version": "0"}, "normalization": {"original_size": [400, 200]},
        "symbols": [{"id": "a", "sheet": 1, "confidence": 0.9, "provenance": prov, "symbol_class": "tank", "bbox": [1, 2, 3, 4]}, {"id": "b", "sheet": 1, "confidence": 0.4, "provenance": prov, "symbol_class": "tank", "bbox": [1, 2, 3, 4]}],
        "lines": [{"id": "l", "sheet": 1, "confidence": 0.4, "provenance": prov, "line_class": "pipe", "polyline": [[0, 0], [5, 5]]}], "texts": [],
    }
    (folder / "sheet_1.json").write_text(json.dumps(record))
    (folder / "sheet_2.json").write_text("{")
    now = [datetime(2024, 1, 1, tzinfo=timezone.utc)]

    def clock():
        now[0] += timedelta(minutes=2)
        return now[0]

    return Workbench(spark, tmp_path / "run", clock=clock)


def test_review_over_http(bench):
    s = server(bench)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{s.server_port}"
    get = lambda path: urllib.request.urlopen(root + path).read().decode()

    def post(body):
        try:
            return urllib.request.urlopen(urllib.request.Request(f"{root}/sheets/1/verdicts", json.dumps(body).encode(), method="POST")).status
        except urllib.error.HTTPError as e:
            return e.code

    assert [x["id"] for x in json.loads(get("/sheets/1/queue"))["queue"]] == ["b", "l", "a"]
    assert '<polyline class="line" data-id="l"' in get("/sheets/1/overlay.svg")
    assert [post({"id": "a", "verdict": "pass"}), post({"id": "b", "verdict": "edit", "correction": {"bbox": [1, 2, 3, 5]}}), post({"id": "l", "verdict": "reject"})] == [200, 200, 200]
    assert [post({"id": "zz", "verdict": "pass"}), post({"id": "a", "verdict": "maybe"}), post({"id": "a", "verdict": "pass", "correction": {"bbox": [1, 2, 3, 4]}}), post({"id": "a", "verdict": "edit", "correction": {"string": "x"}})] == [404, 400, 400, 400]
    assert [(x["sheet"], x["state"]) for x in json.loads(get("/progress"))] == [(1, "reviewed"), (2, "unreadable")]
    overall = next(x for x in json.loads(get("/kpi.json")) if x["level"] == "overall")
    assert (overall["accepted_timed"], overall["unreadable"], overall["minutes_total"], overall["corrections_per_100_symbols"]) == (1, 1, 6.0, 50.0)
    s.shutdown()
