import numpy as np
import pandas as pd
import pytest

from orthoplan.operators.raster import lines, normalize, png
from orthoplan.plans import fixture


def drawn(symbols=fixture.SYMBOLS, runs=fixture.LINES, size=(200, 400)):
    """Boxes as outlines, runs as strokes of one pixel."""
    a = np.full(size, 255, np.uint8)

    def stroke(p, q):
        n = int(max(abs(q[0] - p[0]), abs(q[1] - p[1])))
        for t in range(n + 1):
            a[round(p[1] + (q[1] - p[1]) * t / max(1, n)), round(p[0] + (q[0] - p[0]) * t / max(1, n))] = 0

    for _, (x0, y0, x1, y1), _ in symbols:
        for p, q in (((x0, y0), (x1, y0)), ((x1, y0), (x1, y1)), ((x1, y1), (x0, y1)), ((x0, y1), (x0, y0))):
            stroke(p, q)
    for points, _ in runs:
        for p, q in zip(points, points[1:]):
            stroke(p, q)
    return a


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (40, 25)])
def test_png_round_trip(shape):
    a = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (png.decode(png.encode(a)) == a).all()


def test_png_filters_and_damage():
    above = np.array([10, 20, 250], np.uint8)
    row = np.array([5, 250, 9], np.uint8)
    assert png.unfiltered(1, row, above).tolist() == [5, 255, 8]
    assert png.unfiltered(2, row, above).tolist() == [15, 14, 3]
    assert png.unfiltered(3, row, above).tolist() == [10, 9, 138]
    assert png.unfiltered(4, row, above).tolist() == [15, 14, 3]
    data = bytearray(png.encode(np.zeros((4, 4), np.uint8)))
    for bad in (b"no", bytes(data[:-9]), bytes(data[:20]) + b"\x99" + bytes(data[21:])):
        with pytest.raises(png.PngError):
            png.decode(bad)


def test_png_tables(spark):
    files = spark.createDataFrame([("a", png.encode(np.full((2, 3), 7, np.uint8))), ("b", b"junk")], "path string, content binary")
    rows = {r.path: r for r in png.decoded(files).collect()}
    assert (rows["a"].width, rows["a"].height, bytes(rows["a"].raster)) == (3, 2, b"\x07" * 6)
    assert rows["b"].error and rows["b"].raster is None


@pytest.mark.parametrize("angle", [3.2, -2.4, 0.75])
def test_skew_is_found_within_a_tenth(angle):
    a = np.full((300, 500), 255, np.uint8)
    a[60:240:30, 40:460] = 0
    turned = normalize.turned(a, -angle)
    assert abs(normalize.skew(turned, 127) - angle) <= 0.1
    _, frame = normalize.normalized(turned)
    assert frame.normalized_size == (400, 240) and frame.scale == 0.8


def test_clean_sheet_keeps_its_frame():
    a = drawn()
    out, frame = normalize.normalized(a)
    assert (frame.angle_degrees, frame.scale, frame.threshold) == (0.0, 1.0, 0) and (out == a).all()


def test_line_through_valve_and_arrow():
    symbols = [(f"s{i}", c, b) for i, (c, b, _) in enumerate(fixture.SYMBOLS)]
    got = lines.network(drawn(), symbols, {"flow_arrow"})
    ends = [(r.points[0], r.points[-1]) for r in got]
    assert len(got) == 3
    assert ends[0][0][0] == pytest.approx(67, abs=2) and ends[0][1][0] == pytest.approx(179, abs=2) and got[0].crossed == ["s6"]
    assert ends[1][0][0] == pytest.approx(201, abs=2) and len(got[2].points) == 3


def test_dashes_make_one_run_and_branches_three():
    a = np.full((60, 120), 255, np.uint8)
    for x in range(10, 80, 12):
        a[30, x : x + 8] = 0
    got = lines.network(a, [], set())
    assert len(got) == 1 and got[0].gaps == 5 and len(got[0].points) == 2
    t = np.full((60, 120), 255, np.uint8)
    t[30, 10:100] = 0
    t[30:55, 50] = 0
    assert len(lines.network(t, [], set())) == 3


def test_simplified_closed_loop():
    square = [(0, 0), (5, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert lines.simplified(square) == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


def test_line_network_table(spark):
    row = fixture.sheet(raster=drawn().tobytes())
    s = fixture.sheets(spark, row)
    from orthoplan.sources import annotations

    got = lines.line_network(s, annotations.symbols(s), fixture.legend(spark), {"solid": "pipe", "dashed": "signal"}).orderBy("pos").collect()
    assert [(r.id, r.line_class) for r in got] == [(f"p1-line{i}", "pipe") for i in range(3)]
    n = normalize.normalized_sheets(s).first()
    assert n.normalization.original_size == [400, 200] and bytes(n.raster) == drawn().tobytes()


def test_normalized_sheets_leave_a_worker_in_small_frames():
    """Eight by four pixels become 400 by 200: a batch of small sheets must not be held whole."""

    class Table:
        def select(self, *_):
            return self

        def mapInPandas(self, rows, _):  # noqa: N802
            return rows

    rng = np.random.default_rng(0)
    small = [rng.integers(0, 256, 32, np.uint8).tobytes() for _ in range(300)]
    rasters = [*small, None, b"\1"]
    batch = pd.DataFrame({"document": "d", "sheet": range(302), "width": 8, "height": 4, "raster": rasters})
    frames = list(normalize.normalized_sheets(Table())([batch]))
    assert max(sum(len(r or b"") for r in f["raster"]) for f in frames) <= 5_000_000
    out = pd.concat(frames)
    assert out["sheet"].tolist() == list(range(302))
    assert out["raster"].tolist()[:300] == [normalize.normalized(np.frombuffer(r, np.uint8).reshape(4, 8))[0].tobytes() for r in small]
    assert out["raster"].tolist()[300:] == [None, b"\1"]
