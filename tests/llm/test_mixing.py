import random

from orthoplan.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def filled(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by repeated resharing."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, fixed, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        rest, share = total - sum(fixed.values()), sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / share > most * sizes[s]}
        if not over:
            return fixed | {s: rest * w[s] / share for s in open_}
        fixed |= {s: most * sizes[s] for s in over}
        open_ -= over
    return fixed


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["hot"] * 8 + ["b", "c", None, "ü", "", "tiny"]), "clash", 1) for i in range(3000)]
    rows += [(7, "same row", "b", None, None)] * 3 + [(None, None, None, None, None), (None, "no id", "c", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * 300, (s, taken[s], targets[s])
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again)
    drawn = mixing.drawn(docs)
    assert drawn.columns == docs.columns and drawn.count() == sum(r["copies"] for r in got)


def test_empty_and_zero(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, " \t", "a", None, None)], SCHEMA)).collect()
    assert [r["taken"] for r in rows] == [0, 0] and all(r["target"] == 0 for r in rows)
