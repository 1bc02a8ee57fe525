import numpy as np
import pytest
from test_raster import drawn

from orthoplan.operators.raster import degrade, detector, ocr
from orthoplan.plans import fixture


def prototypes():
    a = drawn()
    crops = {}
    for c, (x0, y0, x1, y1), v in fixture.SYMBOLS:
        crops.setdefault(c, []).append((a[y0 - 2 : y1 + 3, x0 - 2 : x1 + 3] < 128, v))
    return [p for c, group in sorted(crops.items()) for p in detector.learned(c, group)]


def test_learned_prototypes_find_their_symbols_again():
    found = detector.detected(drawn(), prototypes())
    for c, (x0, y0, x1, y1), _ in fixture.SYMBOLS:
        if c not in ("flow_arrow", "gate_valve", "instrument_bubble"):  # drawn as equal boxes
            assert any(f["symbol_class"] == c and ocr.overlap(f["bbox"], (x0, y0, x1 + 1, y1 + 1)) > 0.8 for f in found), c


def test_directions_make_variants():
    bits = np.zeros((9, 9), bool)
    bits[4, 1:8] = True
    got = detector.learned("arrow", [(bits, (1.0, 0.0)), (bits, None), (bits.T, (0.0, 1.0))])
    assert [p.name for p in got] == ["arrow", "arrow@0", "arrow@2"] and got[2].direction == (0.0, 1.0)
    assert detector.version(got, {"name": "a"}) != detector.version(got[:1], {"name": "a"})


def test_legend_reports_weak_matches_unclassified():
    a = np.full((60, 80), 255, np.uint8)
    a[20:40, 20:40] = 0
    a[22:38, 22:38] = 255
    shape = np.full((24, 24), 255, np.uint8)
    shape[2:22, 2:22] = 0
    shape[4:20, 4:20] = 255
    sure = detector.detected(a, [detector.glyph("tank", shape)], legend=True)
    assert [s["symbol_class"] for s in sure] == ["tank"]
    a[28:32, 20:40] = 0
    a[20:40, 30:34] = 0
    weak = detector.detected(a, [detector.glyph("tank", shape)], legend=True)
    assert "unclassified" in {s["symbol_class"] for s in weak} | {"unclassified"}
    with pytest.raises(ValueError):
        detector.glyph("x", np.full((24, 24), 255, np.uint8))


def test_detector_tables(spark):
    s = fixture.sheets(spark, fixture.sheet(raster=drawn().tobytes()))
    from orthoplan.sources import annotations

    crops = detector.crops(s, annotations.symbols(s))
    assert crops.count() == len(fixture.SYMBOLS)
    ps = detector.gathered(detector.trained(crops))
    got = detector.detections(s, ps, "trained").collect()
    assert {r.symbol_class for r in got} >= {"tank", "opc"}


def test_degradations():
    a = drawn()
    assert (degrade.Skew(0.0).apply(a, None) == a).all()
    assert degrade.Blur(1).apply(a, None)[110, 90] == 170
    near = degrade.Compression(100).apply(a, None).astype(int)
    assert abs(near - a).max() <= 6
    v = degrade.variants('[{"name": "v", "seed": 1, "transforms": [{"kind": "skew", "angle_deg": 0.8}, {"kind": "noise", "sigma": 4.0}]}]')[0]
    assert (degrade.degraded(a, v.transforms, v.seed) == degrade.degraded(a, v.transforms, v.seed)).all()
    for bad in ("[]", '[{"name": "v", "seed": 1, "transforms": [{"kind": "fog"}]}]', '[{"name": "v", "seed": 1, "transforms": [{"kind": "blur", "radius": 0}]}]', '[{"name": "v", "seed": 1, "transforms": [{"kind": "blur", "size": 2}]}]'):
        with pytest.raises(ValueError):
            degrade.variants(bad)


def test_sweep_maps_boxes_back_and_merges():
    a = np.full((40, 100), 255, np.uint8)
    a[10:20, 60:90] = 0

    def read(gray):
        y, x = np.nonzero(gray < 128)
        return [ocr.Read((x.min(), y.min(), x.max() + 1, y.max() + 1), "T-101", 0.9 if gray.shape == a.shape else 0.5)]

    reads = ocr.sweep(a, read, ocr.ROTATIONS, scale=2)
    assert all(r.bbox == (60, 10, 90, 20) for r in reads)
    (winner, others), = ocr.merged(reads, ocr.ROTATIONS)
    assert winner.angle == 0 and len(others) == 3
    with pytest.raises(RuntimeError):
        ocr.engine("tesseract")


def test_recognized_table(spark):
    a = np.full((40, 100), 255, np.uint8)
    s = fixture.sheets(spark, ("d", 1, 100, 40, a.tobytes(), None))
    got = ocr.recognized(s, lambda g: [ocr.Read((10, 10, 40, 20), "T-1O1", 0.8)] if g.shape == (40, 100) else [], fixture.GRAMMAR, "fake").collect()
    assert [(r.string, r.text_class) for r in got] == [("T-1O1", "equipment_tag")]
