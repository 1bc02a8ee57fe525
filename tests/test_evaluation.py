import json

import pytest
from test_raster import drawn

from orthoplan.operators.raster import degrade
from orthoplan.plans import digitize, evaluation, factory, fixture
from orthoplan.sources import sinks
from orthoplan.sources.profile import Profile

PROFILE = Profile("synthetic-test", "0", {c: {"role": r, "equipment_type": e, "component_class": k, "shape": s} for c, r, e, k, s in fixture.LEGEND}, fixture.GRAMMAR, fixture.SEMANTICS, {"solid": "pipe", "dashed": "signal"})
KEY = "synthetic-test@0"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    from orthoplan.operators.raster import png

    root = tmp_path_factory.mktemp("eval")
    for n in (1, 2):
        examples = {}
        for i, (c, b, v) in enumerate(fixture.SYMBOLS):
            examples[f"p{n}-sym{i}"] = {"verdict": "pass", "kind": "symbol", "detection": {"id": f"p{n}-sym{i}", "symbol_class": c, "bbox": list(b), "direction": v}}
        for i, (s, c, b) in enumerate(fixture.TEXTS):
            fix = {"correction": {"string": s}} if i == 0 else {}
            examples[f"p{n}-text{i}"] = {"verdict": "edit" if fix else "pass", "kind": "text", "detection": {"id": f"p{n}-text{i}", "text_class": c, "string": "read wrongly" if fix else s, "bbox": list(b)}} | fix
        examples[f"p{n}-gone"] = {"verdict": "reject", "kind": "symbol", "detection": {"id": f"p{n}-gone", "symbol_class": "tank", "bbox": [0, 0, 9, 9]}}
        sinks.put_json(root / "labels" / KEY / f"sheet_{n}.json", {"profile": PROFILE.identity(), "sheet": n, "examples": examples})
        links = [("sym0", "sym2", "known"), ("sym2", "sym3", "unknown"), ("sym3", "sym5", "unknown")]
        sinks.put_json(root / "connectivity" / f"sheet_{n}.json", {"profile": PROFILE.identity(), "links": [{"source": f"p{n}-{a}", "target": f"p{n}-{b}", "attributes": {"direction": d}} for a, b, d in links]})
        (root / "sheets").mkdir(exist_ok=True)
        (root / "sheets" / f"sheet_{n}.png").write_bytes(png.encode(drawn()))
    return root


def test_perfect_components_pass_every_gate(spark, folder):
    truth = evaluation.EvalSet(spark, f"file://{folder}", PROFILE)
    r = evaluation.gate_report(truth, PROFILE)
    assert r["passed"], r
    assert (r["metrics"]["symbol"]["tp"], r["metrics"]["tag"]["truth"], r["metrics"]["connectivity"]["tp"]) == (14, 12, 6)
    assert r["metrics"]["connectivity"]["direction"] == {"truth_known": 2, "agreeing": 2, "conflicting": 0, "unasserted": 0}
    with pytest.raises(ValueError):
        evaluation.compare(truth, PROFILE, [digitize.Config()])


def test_eval_sets_are_refused_as_a_whole(spark, folder):
    with pytest.raises(ValueError):
        evaluation.EvalSet(spark, f"file://{folder}", Profile("other", "0"))
    (folder / "connectivity" / "sheet_2.json").rename(folder / "kept.json")
    with pytest.raises(ValueError, match="connectivity"):
        evaluation.EvalSet(spark, f"file://{folder}", PROFILE)
    (folder / "kept.json").rename(folder / "connectivity" / "sheet_2.json")


def test_label_factory_writes_a_training_folder(spark, tmp_path):
    node = lambda i, kind, **k: {"id": i, "kind": kind, "xy": [40.0 * i + 20, 30.0]} | k
    art = {"page": 3, "nodes": [node(0, "equipment", tag="T-1", shape="tank", bbox=[10.0, 20.0, 30.0, 40.0]), node(1, "valve", subclass="gate")], "edges": [{"a": 0, "b": 1, "style": "solid", "points": [[30.0, 30.0], [52.0, 30.0]], "line_numbers": [], "direction": "ab", "direction_source": "arrow"}], "direction_stats": {}}
    src = tmp_path / "run" / "topology"
    src.mkdir(parents=True)
    (src / "topology_page3.json").write_text(json.dumps(art))
    (src / "topology_page4.json").write_text(json.dumps({"page": 4, "nodes": [], "edges": []}))
    spans = spark.createDataFrame([(3, 0, "T-1", [10.0, 10.0, 20.0, 14.0])], "page int, pos int, string string, bbox array<double>")
    made = factory.labels(spark, f"file://{src}/*.json", spans, dpi=72)
    assert [(r.page, r.error) for r in made["errors"].collect()] == [(4, "missing direction_stats")]
    rasters = spark.createDataFrame([(3, 100, 60, drawn(runs=[], symbols=[("a", (10, 20, 30, 40), None)], size=(60, 100)).tobytes())], "sheet int, width int, height int, raster binary")
    assert factory.put(tmp_path / "out", PROFILE.identity(), made, rasters)["sheets"] == 1
    link = json.loads((tmp_path / "out/connectivity/sheet_3.json").read_text())["links"][0]
    assert (link["source"], link["target"], link["attributes"]["direction"]) == ("p3-node0", "p3-node1", "known")
    labels = json.loads((tmp_path / f"out/labels/{KEY}/sheet_3.json").read_text())["examples"]
    assert sorted(labels) == ["p3-edge0", "p3-node0", "p3-node1", "p3-span0"] and labels["p3-span0"]["detection"]["text_class"] == "equipment_tag"
    v = degrade.variants('[{"name": "soft", "seed": 1, "transforms": [{"kind": "blur"}]}]')
    assert factory.put_variants(tmp_path / "out", PROFILE.identity(), made, rasters, v, 100, 60)[0]["sheets"] == 1
    assert (tmp_path / "out/variants/soft/sheets/sheet_3.png").exists()
