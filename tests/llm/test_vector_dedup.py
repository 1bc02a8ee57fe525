import math
import random

import numpy as np

from orthoplan.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows):
    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        n = np.sqrt(x @ x)
        return x / n if n > 0 else None

    u = [unit(r[1]) if r[0] is not None and r[2] is not None else None for r in rows]
    links = [[j for j in range(len(rows)) if j != i and u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.98] for i in range(len(rows))]
    comp = {}
    for i, r in enumerate(rows):
        if i in comp:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen), key=lambda x: (x is None, x))
        comp |= {j: low for j in seen}
    return sorted((str(r[0]), len(links[i]), str(comp[i]), comp[i] == r[0]) for i, r in enumerate(rows))


def test_matches_brute_force_with_a_group_far_wider_than_the_window(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        base = rng.standard_normal(16)
        for _ in range(random.Random(c).choice([1, 2, 4])):
            rows.append((base + rng.standard_normal(16) * rng.choice([0.02, 0.1]), c % 3))
    hot = rng.standard_normal(16)
    rows += [(hot + rng.standard_normal(16) * 0.12, 1) for _ in range(250)] + [(hot, 1)] * 40 + [(hot * 2, 1), (hot, 2), (hot, None)]
    rows = [(i, [float(x) for x in np.float32(v)], label, "x") for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1, None), (n + 1, [0.0] * 16, 1, None), (n + 2, [float("nan")] * 16, 1, None), (n + 3, [None, 1.0], 1, None), (n + 4, [1.0, 2.0], 1, None), (n + 4, [1.0, 2.0], 1, None), (n + 5, [], 1, None), (None, [1.0, 2.0], 1, None), (n + 6, [float("inf"), 1.0], 1, None), (n + 7, [1e-30, 2e-30], 1, None)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [(a, b, c, d or a == "None") for a, b, c, d in brute(rows)]


def test_empty_table(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_more_passes_for_larger_tables():
    assert vector_dedup.passes_for(10**9, 0.98) > vector_dedup.passes_for(1000, 0.98) >= 2


def test_pairs_in_a_dense_topic_are_found(spark):
    rng = np.random.default_rng(5)
    n, pairs = 6000, 300
    centre = np.ones(64) / 8
    v = centre * 0.95**0.5 + rng.standard_normal((n, 64)) * (0.05 / 64) ** 0.5
    v /= np.linalg.norm(v, axis=1)[:, None]
    copies = v[:pairs] + rng.standard_normal((pairs, 64)) * (0.035 / 64) ** 0.5
    v = np.float32(np.concatenate([v, copies]))
    got = vector_dedup.near_vectors(spark.createDataFrame([(i, x.tolist(), 1, "x") for i, x in enumerate(v)], SCHEMA).repartition(4)).collect()
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    assert near.sum() > 200
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(near.sum(axis=1).tolist()))
