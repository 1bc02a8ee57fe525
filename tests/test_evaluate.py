import random

import pytest
from pyspark.sql import functions as F

from orthoplan.functions import geometry as g
from orthoplan.functions import text as tx
from orthoplan.operators import evaluate
from orthoplan.operators.graph import components, components_by


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(3)
    rows = {side: [(s, i, (x := rng.randint(0, 30), y := rng.randint(0, 30), x + rng.randint(3, 15), y + rng.randint(3, 15)), rng.choice(["a", "b", None])) for s in range(6) for i in range(25)] for side in "pt"}
    schema = "sheet int, pos int, bbox struct<x0:double,y0:double,x1:double,y1:double>, cls string"
    frames = {side: spark.createDataFrame([(s, i, tuple(map(float, b)), c) for s, i, b, c in r], schema) for side, r in rows.items()}
    return rows, frames


def candidates(rows):
    return [(s, i, j, iou(b, d)) for s, i, b, c in rows["p"] for t, j, d, e in rows["t"] if s == t and iou(b, d) >= 0.3 and (c is None or e is None or c == e)]


def test_pairs_plain_and_gridded(boxes):
    rows, f = boxes
    want = sorted((s, i, j, round(v, 9)) for s, i, j, v in candidates(rows))
    for d in (evaluate.candidate_pairs(f["p"], f["t"], 0.3), evaluate.gridded_pairs(f["p"], f["t"], 7.0, 0.3)):
        assert sorted((r.sheet, r.p, r.t, round(r.iou, 9)) for r in d.collect()) == want


def test_greedy_matching(boxes):
    rows, f = boxes
    want, used_p, used_t = set(), set(), set()
    for s, i, j, v in sorted(candidates(rows), key=lambda c: (-c[3], c[1], c[2])):
        if (s, i) not in used_p and (s, j) not in used_t:
            used_p.add((s, i))
            used_t.add((s, j))
            want.add((s, i, j))
    got = evaluate.greedy_match(evaluate.candidate_pairs(f["p"], f["t"], 0.3))
    assert {(r.sheet, r.p, r.t) for r in got.collect()} == want
    s = evaluate.micro(evaluate.box_scores(got, f["p"], f["t"])).first()
    assert (s.tp, s.fp, s.fn) == (len(want), 150 - len(want), 150 - len(want))


def test_link_directions_consume_copies_in_order(spark):
    schema = "sheet int, pos int, source string, target string, direction string"
    truth = spark.createDataFrame([(1, 0, "a", "b", "known"), (1, 1, "a", "b", "known"), (1, 2, "b", "a", "known"), (1, 3, "c", "d", "known"), (1, 4, "c", "d", "unknown")], schema)
    pred = spark.createDataFrame([(1, 0, "b", "a", "known"), (1, 1, "a", "b", "known"), (1, 2, "a", "b", "conflict"), (1, 3, "d", "c", "unknown")], schema)
    got = {(r.low, r.high): (r.agreeing, r.conflicting, r.unasserted) for r in evaluate.link_directions(pred, truth).collect()}
    assert got == {("a", "b"): (1, 2, 0), ("c", "d"): (0, 0, 1)}
    c = {(r.low, r.high): (r.tp, r.fp, r.fn) for r in evaluate.link_counts(pred, truth).collect()}
    assert c == {("a", "b"): (3, 0, 0), ("c", "d"): (1, 0, 1)}


def test_gates_shut_without_a_score(spark):
    got = {r.metric: (r.score, r.passed) for r in evaluate.gates(spark.createDataFrame([("symbol_f1", 0.9), ("tag_exact_match", 0.97)], "metric string, score double")).collect()}
    assert got == {"symbol_f1": (0.9, True), "tag_exact_match": (0.97, False), "connectivity_f1": (None, False)}
    assert tuple(evaluate.micro(spark.createDataFrame([], "tp long, fp long, fn long")).first()) == (0, 0, 0, None, None, None)


def test_components_agree(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)]
    e = spark.createDataFrame(rows, "a long, b long")
    one = {(r.id, r.component) for r in components(e).collect()}
    assert one == {(r.id, r.component) for r in components_by(e.withColumn("s", F.lit(1)), ["s"]).select("id", "component").collect()}


def test_geometry_and_text(spark):
    row = lambda *cs: tuple(spark.range(1).select(*cs).first())
    p = lambda x, y: g.point(F.lit(x), F.lit(y))
    n = F.struct(F.lit(3.0).alias("angle_degrees"), F.lit(0.5).alias("scale"), F.array(F.lit(400), F.lit(200)).alias("original_size"))
    back = g.to_original(g.to_normalized(p(12.0, 150.0), n), n)
    x, y = row(back["x"], back["y"])
    assert (x, y) == pytest.approx((12.0, 150.0))
    b = g.box(*map(F.lit, (1, 2, 4, 9)))
    turned = [g.unrotated_box(b, F.lit(100), F.lit(50), F.lit(a)) for a in (0, 90, 180, 270)]
    assert [tuple(r) for r in row(*turned)] == [(1, 2, 4, 9), (2, 46, 9, 49), (96, 41, 99, 48), (91, 1, 98, 4)]
    assert row(g.sector(p(1.0, 0.0)), g.sector(p(-1.0, -0.01)), g.sector(p(0.0, -1.0))) == (0, 4, 6)
    assert row(tx.graph_label(F.lit("heat_pump")), tx.graph_label(F.lit("check_valve")), tx.swaps(F.lit("T-1O1"), F.lit("T-101"))) == ("Heat_pump", "CheckValve", "O->0 at index 3")
    assert row(tx.round1(F.lit(0.15)), tx.round1(F.lit(0.35)), tx.profile_key(F.lit("a b/c"), F.lit("1"))) == (0.1, 0.3, "a%20b%2Fc@1")
