import json

import pytest
from pyspark.sql import functions as F
from test_raster import drawn

from orthoplan.operators import batch, label_factory, lexicon, overlay, plant, review
from orthoplan.plans import digitize, fixture
from orthoplan.sources import pdf, profile, records, sinks
from orthoplan.streaming import activity


def edge_set(a):
    return sorted((r.source, r.target, r.direction) for r in plant.edges(a).collect())


@pytest.fixture(scope="module")
def whole(spark):
    return fixture.assembly(spark)


def test_synthetic_sheet(whole):
    assert edge_set(whole) == [("T-101", "V-101", "known"), ("T-102", "OPC-DW02-0003", "unknown"), ("V-101", "T-102", "unknown")]
    assert sorted(r.tag for r in plant.nodes(whole).collect()) == ["OPC-DW02-0003", "PI-100", "T-101", "T-102", "V-101"]
    known = plant.edges(whole).filter("direction = 'known'").first()
    assert known.direction_sources == ["arrow:p1-sym6"] and known.line_numbers == ["150-GA-001"]


def test_plant_model_numbers_and_shape(whole):
    m = plant.plant_model(whole, "synthetic", {"name": "t", "version": "0"}, fixture.SEMANTICS)
    c = m["conceptualModel"]
    assert {k: len(v) for k, v in c.items()} == {"Equipment": 2, "Nozzle": 1, "PipingComponent": 1, "ProcessInstrumentationFunction": 1, "PipingNetworkSegment": 4, "PipeOffPageConnector": 1, "PipingNode": 1}
    assert [e["id"] for e in c["Equipment"]] == ["p1n0", "p1n3"] and c["Nozzle"][0] | {"provenance": 0} == {"sheet": 1, "id": "p1n1", "position": [62.0, 110.0], "equipment": "p1n0", "subTagName": None, "confidence": 1.0, "provenance": 0}
    first = c["PipingNetworkSegment"][0]
    assert (first["id"], first["from"], first["to"], first["length"], first["flowDirection"], first["flowDirectionSource"], first["lineNumber"]) == ("p1s0", "p1n1", "p1n2", 114.0, "from_to", "arrow", ["150-GA-001"])
    assert c["PipingNode"][0]["nodeType"] == "corner" and "flowDirection" not in c["PipingNetworkSegment"][1]


def test_script_is_ordered_and_honest(whole, tmp_path):
    summary = sinks.put_script(tmp_path / "g.cypher", plant.nodes(whole), plant.edges(whole))
    lines = (tmp_path / "g.cypher").read_text().splitlines()
    assert lines[2].startswith("CREATE CONSTRAINT") and summary["nodes"] == 5 and summary["relationships"] == 3
    assert 'MERGE (n:PlantItem {tag: "T-101"}) SET n:Tank, n += {"' not in lines[3] and lines[3].startswith('MERGE (n:PlantItem {tag: "T-101"}) SET n:Tank, n += {tag: "T-101", name: "T-101", equipment_type: "tank", detection_confidence: 1.0, sheets: [1]}')
    assert sum("FLOWS_TO" in x for x in lines[3:]) == 1
    for bad in ("bolt://db.example.com:7687", "bolt+s://localhost", "http://localhost"):
        with pytest.raises(ValueError):
            sinks.local_endpoint(bad)
    assert sinks.local_endpoint("bolt://127.0.0.1:7687")


def branch(extra=(), third=True, arrows=()):
    tanks = [("tank", (0, 80, 20, 120), None), ("tank", (180, 80, 200, 120), None)] + [("tank", (80, 160, 120, 190), None)] * third
    runs = [([(20, 100), (100, 100)], "pipe"), ([(100, 100), (180, 100)], "pipe")] + [([(100, 100), (100, 160)], "pipe")] * third
    names = [("A-001", "equipment_tag", (0, 70, 20, 78)), ("B-001", "equipment_tag", (180, 70, 200, 78))] + [("C-001", "equipment_tag", (80, 192, 120, 198))] * third
    return fixture.sheet([*tanks, *arrows], runs, [*names, *extra])


RIGHT, LEFT = ("flow_arrow", (55, 95, 65, 105), (1, 0)), ("flow_arrow", (135, 95, 145, 105), (-1, 0))


def test_branches_chains_and_conflicts(spark):
    assert edge_set(fixture.assembly(spark, branch())) == [("A-001", "B-001", "unknown"), ("A-001", "C-001", "unknown"), ("B-001", "C-001", "unknown")]
    assert edge_set(fixture.assembly(spark, branch(third=False, arrows=[RIGHT]))) == [("A-001", "B-001", "known")]
    assert edge_set(fixture.assembly(spark, branch(third=False, arrows=[RIGHT, LEFT]))) == [("A-001", "B-001", "conflict")]


def test_propagation_keeps_its_origin(spark):
    a = fixture.assembly(spark, branch(third=False, arrows=[RIGHT]))
    got = {(r.run, r.orientation, r.propagated) for r in a.evidence.collect()}
    assert got == {(0, "from_to", False), (1, "from_to", True)}
    assert plant.edges(a).first().direction_sources == ["arrow:p1-sym2", "propagated(arrow:p1-sym2)"]


def test_bad_sheets_fail_alone(spark):
    off = fixture.sheet([*fixture.SYMBOLS, ("flow_arrow", (5, 5, 9, 9), (1, 0))], number=2)
    unknown = fixture.sheet([("what", (0, 0, 5, 5), None)], [], [], number=3)
    twice = fixture.sheet(texts=[*fixture.TEXTS, ("T-103", "equipment_tag", (20, 60, 60, 72))], number=4)
    a = fixture.assembly(spark, fixture.sheet(), off, unknown, twice)
    assert sorted(r.sheet for r in a.problems.collect()) == [2, 3, 4]
    assert {r.sheet for r in a.terminals.collect()} == {1}


def test_lexicon_cases(spark):
    cases = [("T-101", "equipment_tag"), ("T-1O1", "equipment_tag"), ("FT-S01", "instrument_tag"), ("1SO-GA-OO1", "line_number"), ("T-ABC", "equipment_tag"), ("x", "none"), ("SO", "two"), ("O" * 20, "many")]
    grammar = fixture.GRAMMAR | {"two": r"\d[A-Z0-9]", "many": r"\d{20}"}
    rows = [(i, s, c, 1.0, ("c", "e"), None, None) for i, (s, c) in enumerate(cases)]
    d = spark.createDataFrame(rows, "pos int, string string, text_class string, confidence double, provenance struct<component:string,evidence:string>, raw_string string, correction string")
    got = lexicon.decoded(d, grammar).orderBy("pos").collect()
    assert [(r.string, r.resolved, round(r.confidence, 3)) for r in got] == [("T-101", True, 1.0), ("T-101", True, 0.9), ("FT-501", True, 0.9), ("150-GA-001", True, 0.9), ("T-ABC", False, 0.5), ("x", False, 0.5), ("SO", False, 0.5), ("O" * 20, False, 0.5)]
    assert got[1].correction == "O->0 at index 3" and got[6].candidates == ["50", "5O"] and "too degraded" in got[7].provenance.evidence
    assert lexicon.classify("T-1O1", fixture.GRAMMAR) == "equipment_tag" and lexicon.classify("?", fixture.GRAMMAR) is None


def test_review_figures(spark):
    det = [("doc", s, "p", "0", f"s{s}-{i}", "symbol" if i < 3 else "text", 0 if i < 3 else 2, i, 1 - i / 10) for s in (1, 2) for i in range(4)]
    d = spark.createDataFrame(det, "document string, sheet int, profile_name string, profile_version string, id string, kind string, kind_ord int, pos int, confidence double")
    v = [("p", "0", 1, f"s1-{i}", "reject" if i == 0 else "pass", "symbol" if i < 3 else "text", i) for i in range(4)] + [("p", "0", 1, "s1-0", "edit", "symbol", 9), ("p", "0", 2, "gone", "pass", "symbol", 1)]
    v = spark.createDataFrame(v, "profile_name string, profile_version string, sheet int, detection_id string, verdict string, kind string, seq int")
    lines = ['{"at": "2024-01-01T10:00:00+00:00", "event": "open", "sheet": 1}', '{"at": "2024-01-01T10:04:00", "event": "verdict", "sheet": 1}', '{"at": "2024-01-01T10:14:00+00:00", "event": "open", "sheet": 7}', '{"at": "2024-01-01T10:40:00+00:00", "event": "open", "sheet": 2}', "", '{"at": "2024-01-01T10:41']
    log = records.parsed_events(spark.createDataFrame([("doc", i, x) for i, x in enumerate(lines)], activity.LINES))
    assert log.filter("at IS NULL").count() == 1 and log.count() == 5
    events = log.filter("at IS NOT NULL")
    sheets = spark.createDataFrame([("doc", 1, "p", "0", True), ("doc", 2, "p", "0", True), ("doc", 3, None, None, False)], "document string, sheet int, profile_name string, profile_version string, readable boolean")
    rows = review.sheet_rows(sheets, d, v, events)
    got = {r.level: r for r in review.kpi_report(rows).collect()}
    assert set(got) == {"document", "profile", "overall"}
    r = got["overall"]
    assert (r.total, r.accepted, r.accepted_timed, r.unreadable, r.minutes_total, r.minutes_per_accepted_sheet) == (3, 1, 1, 1, 14.0, 14.0)
    assert r.corrections_per_100_symbols == pytest.approx(100 / 3) and got["profile"].total == 2
    assert [x.id for x in review.queue(d, v).filter("sheet = 2").orderBy("rank").collect()] == ["s2-3", "s2-2", "s2-1", "s2-0"]
    assert [x.detection_id for x in review.stale(d, v).collect()] == ["gone"]


def test_stream_of_events_gives_the_batch_minutes(spark, tmp_path):
    lines = [("doc", i, json.dumps({"at": f"2024-01-01T10:{m:02d}:00", "event": "open", "sheet": s})) for i, (m, s) in enumerate([(0, 1), (4, 2), (9, 1), (30, 1), (31, 2)])]
    spark.createDataFrame(lines, activity.LINES).write.json(str(tmp_path / "in"))
    stream = activity.events(spark.readStream.schema(activity.LINES).json(str(tmp_path / "in")))
    q = activity.minutes(stream).writeStream.outputMode("update").format("memory").queryName("minutes").start()
    q.processAllAvailable()
    q.stop()
    got = {r.sheet: r.minutes for r in spark.table("minutes").collect()}
    batch_ = {r.sheet: r.minutes for r in review.attribute_minutes(records.parsed_events(spark.createDataFrame(lines, activity.LINES))).collect()}
    assert got == batch_ == {1: 5.0, 2: 5.0}


def test_verdict_upserts(spark, tmp_path):
    put = activity.upsert(str(tmp_path / "v"))
    s = "profile_name string, profile_version string, sheet int, detection_id string, verdict string, kind string, seq long"
    put(spark.createDataFrame([("p", "0", 1, "a", "pass", "symbol", 1), ("p", "0", 1, "b", "pass", "symbol", 2)], s), 0)
    for _ in range(2):
        put(spark.createDataFrame([("p", "0", 1, "a", "reject", "symbol", 3)], s), 1)
    assert {r.detection_id: r.verdict for r in spark.read.parquet(str(tmp_path / "v/v1")).collect()} == {"a": "reject", "b": "pass"}


def test_profile_problems_come_together(tmp_path):
    with pytest.raises(profile.ProfileError) as e:
        profile.checked({"profile": {"name": "x"}, "legend": {"unclassified": {}, "a": {"role": "?"}}, "tag_grammar": {"t": "("}, "line_semantics": {"l": "no"}, "line_styles": {"dotted": "x"}})
    assert len(e.value.problems) == 6
    for name, v in (("profile", {"name": "n", "version": "1"}), ("legend", {"tank": {"role": "Equipment"}}), ("tag_grammar", {"t": "a"}), ("line_semantics", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(v))
    assert profile.load(tmp_path).identity() == {"name": "n", "version": "1"}


def minimal_pdf(contents: list[bytes], raster=b"\x00" * 6, colors=b"/DeviceGray"):
    import zlib

    data = zlib.compress(raster)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(contents))) + b"] /Count %d >>" % len(contents)]
    objects.append(b"<< /Type /XObject /Subtype /Image /Width 3 /Height 2 /ColorSpace " + colors + b" /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % len(data) + data + b"\nendstream")
    for i, c in enumerate(contents):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << /Im0 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d >>\nstream\n" % len(c) + c + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>"


def test_pdf_intake(spark):
    scan = b"q 3 0 0 2 0 0 cm /Im0 Do Q"
    assert pdf.sheets_of(minimal_pdf([scan, scan])) == [(3, 2, b"\x00" * 6)] * 2
    for bad in (minimal_pdf([scan, b"0 0 m 1 1 l S"]), minimal_pdf([scan, b"q Q"]), minimal_pdf([scan], colors=b"/DeviceRGB"), minimal_pdf([scan], raster=b"12"), b"junk"):
        with pytest.raises(pdf.IntakeError):
            pdf.sheets_of(bad)
    rows = pdf.scanned(spark.createDataFrame([("x/a.pdf", minimal_pdf([scan])), ("x/b.pdf", b"junk")], "path string, content binary")).collect()
    assert sorted((r.document, r.sheet, r.error is None) for r in rows if r.sheet) == [("a.pdf", 1, True)] and sum(r.error is not None for r in rows) == 1


NODE = "page int, pos int, id long, kind string, xy array<double>, tag string, full_tag string, shape string, subclass string, bbox array<double>, labels array<string>, equipment int"
EDGE = "page int, pos int, a long, b long, style string, points array<array<double>>, line_numbers array<string>, direction string, direction_source string"


def artifact(spark):
    node = lambda i, kind, **k: (1, i, i, kind, [10.0 * i, 10.0], k.get("tag"), None, k.get("shape"), k.get("subclass"), k.get("bbox"), k.get("labels"), k.get("equipment"))
    nodes = [node(0, "equipment", tag="T-1", shape="tank", bbox=[0.0, 0.0, 10.0, 10.0]), node(1, "nozzle", equipment=0), node(2, "junction"), node(3, "valve", subclass="gate"), node(4, "instrument", tag="PT 00204")]
    edge = lambda i, a, b, **k: (1, i, a, b, k.get("style", "solid"), [[0.0, 0.0], [1.0, 1.0]], k.get("numbers"), k.get("direction"), "arrow" if k.get("direction") else None)
    edges = [edge(0, 0, 1, style="internal"), edge(1, 1, 2, direction="ab", numbers=["N-1"]), edge(2, 2, 3, direction="ab"), edge(3, 2, 4)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_label_factory(spark):
    nodes, edges = artifact(spark)
    assert sorted(r.symbol_class for r in label_factory.symbol_labels(nodes).collect()) == ["equipment_tank", "gate_valve", "instrument_bubble", "nozzle"]
    got = {(r.source, r.target): (r.direction, r.line_numbers, r.provenance.rsplit("edges ")[1]) for r in label_factory.connectivity(nodes, edges).collect()}
    assert got == {("p1-node0", "p1-node3"): ("known", ["N-1"], "1, 2"), ("p1-node0", "p1-node4"): ("unknown", ["N-1"], "1, 3"), ("p1-node3", "p1-node4"): ("unknown", None, "2, 3")}
    spans = spark.createDataFrame([(1, 0, "T-1", [0.0, 0.0, 1.0, 1.0]), (1, 1, "00204", [38.0, 8.0, 42.0, 12.0]), (1, 2, " ", [0.0] * 4), (1, 3, "note", [0.0] * 4), (1, 4, "N-1", [0.0] * 4)], "page int, pos int, string string, bbox array<double>")
    assert {r.string: r.text_class for r in label_factory.text_labels(nodes, edges, spans).collect()} == {"T-1": "equipment_tag", "00204": "instrument_tag", "note": "free_text", "N-1": "line_number"}
    assert label_factory.line_labels(edges).count() == 3 and label_factory.missing_keys({"page": 1}) == ["nodes", "edges", "direction_stats"]


def test_degraded_labels_drop_what_left(spark):
    from orthoplan.operators.raster import degrade

    nodes, edges = artifact(spark)
    symbols, lines_, links = label_factory.symbol_labels(nodes, scale=1.0), label_factory.line_labels(edges, scale=1.0), label_factory.connectivity(nodes, edges)
    s, n, t, k = label_factory.degraded_labels(symbols, lines_, symbols, links, (degrade.Blur(1),), 22, 30)
    assert s.count() == 2 and {(r.source, r.target) for r in k.collect()} == set() and n.count() == 3


def test_digitize_from_pixels(spark, tmp_path):
    p = profile.Profile("synthetic-test", "0", {c: {"role": r, "equipment_type": e, "component_class": k, "shape": s} for c, r, e, k, s in fixture.LEGEND}, fixture.GRAMMAR, fixture.SEMANTICS, {"solid": "pipe", "dashed": "signal"})
    sheets = fixture.sheets(spark, fixture.sheet(raster=drawn().tobytes()))
    run, coverage = digitize.resumed(sheets, str(tmp_path / "state"), p)
    got = sorted((r.source, r.target, r.direction) for r in run.edges.collect())
    assert got == [("T-101", "V-101", "known"), ("T-102", "OPC-DW02-0003", "unknown"), ("V-101", "T-102", "unknown")]
    c = coverage.first()
    assert (c.total_sheets, c.succeeded, c.failed, c.skipped_by_resume) == (1, 1, 0, 0)
    r = digitize.records(run, p).first()
    assert (len(r.symbols), len(r.lines), len(r.texts)) == (7, 3, 6)
    _, again = digitize.resumed(sheets, str(tmp_path / "state"), p)
    assert again.first().skipped_by_resume == 1
    with pytest.raises(batch.StateError):
        batch.check_manifest({"document": "a"}, {"document": "b"})
    assert digitize.parsed("detector=trained:x,reader=rapidocr:a,b").reader == "rapidocr:a,b"
    with pytest.raises(ValueError):
        digitize.parsed("detector=magic")


def test_overlay_and_training_set(spark, whole, tmp_path):
    t = whole.terminals.select("document", "sheet", F.lit("symbol").alias("kind"), F.lit(0).alias("kind_ord"), F.col("ord").alias("pos"), "id", F.lit("pass").alias("verdict"), F.lit("a <b>").alias("title"), "bbox", F.lit(None).cast("array<struct<x:double,y:double>>").alias("polyline"))
    svg = overlay.overlays(t, spark.createDataFrame([("synthetic", 1, 400, 200)], "document string, sheet int, width int, height int")).first().svg
    assert svg.startswith('<svg viewBox="0 0 400 200"><rect class="symbol" data-id="p1-sym0" data-verdict="pass" x="20" y="80" width="40" height="60"><title>a &lt;b&gt;</title></rect>')
    v = spark.createDataFrame([("p", "0", 2, "b", "reject", "symbol", '{"symbol_class": "x", "bbox": [1]}', None, 1), ("p", "0", 1, "a", "edit", "text", '{"text_class": "t", "string": "u", "bbox": [1]}', '{"string": "v"}', 1)], "profile_name string, profile_version string, sheet int, detection_id string, verdict string, kind string, detection string, correction string, seq int")
    out = sinks.put_training_set(tmp_path / "t.jsonl", v, {"name": "p", "version": "0"})
    lines_ = [json.loads(x) for x in (tmp_path / "t.jsonl").read_text().splitlines()]
    assert out["examples"] == {"positive": 0, "negative": 1, "corrected": 1} and lines_[0]["label"] == {"text_class": "t", "string": "v", "bbox": [1]} and lines_[1]["label"] is None
    assert sinks.put_verdict_store(tmp_path / "labels", v) == 2
    assert records.verdicts(spark, f"file://{tmp_path}/labels/*/sheet_*.json").count() == 2


def test_record_files(spark, tmp_path):
    folder = tmp_path / "run1" / "detections"
    folder.mkdir(parents=True)
    good = {"sheet": 9, "profile": {"name": "p", "version": "0"}, "normalization": {}, "symbols": [{"id": "a", "confidence": 0.5}], "lines": [], "texts": [{"id": "b"}]}
    (folder / "sheet_2.json").write_text(json.dumps(good))
    (folder / "sheet_10.json").write_text("{broken")
    (folder / "sheet_2.json.tmp").write_text("x")
    got = records.records(spark, f"file://{folder}/*")
    assert [(r.run, r.sheet, r.readable) for r in got.orderBy("sheet").collect()] == [("run1", 2, True), ("run1", 10, False)]
    assert [(r.kind, r.id, r.sheet) for r in records.detections(got).orderBy("kind_ord").collect()] == [("symbol", "a", 2), ("text", "b", 2)]


def test_ends_at_one_place_and_equal_boxes_are_met_once(spark):
    """2,000 ends at 50 places and 400 boxes of 8 shapes: the joins make rows for places, not for every pair that touches."""
    from orthoplan.operators import assembly

    ends = [(i % 2, i, 0, (float(i % 50) * 5, float(i % 25) * 3)) for i in range(2000)]
    ends += [(0, 1, 0, (5000.0, 5000.0)), (1, 9000, 0, (None, 1.0)), (None, None, 0, (1.0, 1.0))]  # a key again elsewhere, no place, no sheet
    shape = lambda j: (float(j % 8) * 10, 0.0, 120.0 + j % 8 * 10, 60.0)
    boxes = [(j % 2, 1000 - j // 16, j if j % 16 > 9 else None, shape(j)) for j in range(400)]
    e = spark.createDataFrame(ends, "sheet int, run int, end int, p struct<x:double,y:double>")
    b = spark.createDataFrame(boxes, "sheet int, terminal int, nozzle int, bbox struct<x0:double,y0:double,x1:double,y1:double>")

    def touching(sheet, p):
        return [(n is None, t, -1 if n is None else n) for s, t, n, (x0, y0, x1, y1) in boxes if s == sheet and p[0] is not None and x0 - 2 <= p[0] <= x1 + 2 and y0 - 2 <= p[1] <= y1 + 2]

    hits = {}
    for s, r, k, p in ends:
        hits.setdefault((s, r, k), []).extend(touching(s, p))
    first = {key: min(h)[1:] if h else (None, None) for key, h in hits.items()}
    want = [(s, r, k, p, first[s, r, k][0], None if first[s, r, k][1] == -1 else first[s, r, k][1]) for s, r, k, p in ends]

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = assembly.attach_ends(e, b, by=["sheet"])
        rows = [(r.sheet, r.run, r.end, tuple(r.p), r.terminal, r.nozzle) for r in got.collect()]
        made, todo = 0, [got._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                made += node.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert len(ends) <= made <= len(ends) + 2 * 50 * 8
