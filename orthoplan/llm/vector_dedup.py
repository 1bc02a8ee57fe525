"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors of a label are ordered by the signs of their projections on random directions, and all that
share the leading signs are compared with each other in double precision, chunk against chunk. Pairs at the threshold are
linked, links of all passes are united. How many signs lead follows from the largest label's size, so that evenly spread
vectors fall into runs of about a window; a dense topic makes longer runs, which are compared as a whole. So a pair right
at the threshold is found in a pass with a probability that no other vector changes, and the number of passes follows
from it and the wanted recall. Equal vectors are one row from the start.

The runs serve to find components. How many links a vector has is then counted exactly inside its component, chunk
against chunk, with nothing listed.

Skew: long runs and large components are compared by pairs of chunks.

Nulls and odd rows: vectors that are null, zero, or hold null or non-finite components, and rows with a null label or id,
link with nothing (n_links 0, themselves their component, kept). Vectors of other lengths are not compared. Repeated rows
are vectors of their own and link with each other. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplan.llm import scratch
from orthoplan.llm.components import components
from orthoplan.llm.runs import groups

WINDOW = 32
CHUNK = 1024
#: Rows of a chunk that are compared at a time.
STEP = 256
BITS = 63


def passes_for(largest: int, threshold: float, recall: float = 0.9999, window: int = WINDOW) -> int:
    """A pair at the threshold shares a sign with probability `same`, and all leading_signs() with `found` or more."""
    same = 1 - math.acos(threshold) / math.pi
    found = same ** max(1.0, math.log2(max(2, largest) / window) + 1)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def leading_signs(largest: int, window: int = WINDOW) -> int:
    """As many as part evenly spread vectors into runs of about a window."""
    return min(BITS, math.ceil(math.log2(max(2, largest) / window))) if largest > window else 0


def usable(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, label, dim, ok, digest, vec (float64 bytes, of length 1)."""

    def rows(batches):
        for b in batches:
            out = {"dim": [], "ok": [], "digest": [], "vec": []}
            for v, ident, label in zip(b.column("embedding"), b.column("vec_id"), b.column("label")):
                x = None if v.as_py() is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                norm = 0.0 if x is None or not len(x) else float(np.abs(x).max())
                ok = bool(0 < norm < math.inf and ident.is_valid and label.is_valid)
                if ok:
                    x = x / norm
                    x = x / np.sqrt(np.dot(x, x))
                out["dim"].append(len(x) if ok else 0)
                out["ok"].append(ok)
                out["digest"].append(hashlib.md5((v.values.to_numpy(zero_copy_only=False) + 0.0).tobytes()).digest() if ok else None)
                out["vec"].append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(out["dim"], pa.int32()), pa.array(out["ok"]), pa.array(out["digest"], pa.binary()), pa.array(out["vec"], pa.binary())],
                ["vec_id", "label", "dim", "ok", "digest", "vec"],
            )

    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return d.mapInArrow(rows, "vec_id long, label string, dim int, ok boolean, digest binary, vec binary")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def runs_of(classes: DataFrame, passes: int, signs: int, seed: int) -> DataFrame:
    """classes(id, label, dim, vec) -> pass, label, dim, key (the leading signs), id for every pass."""

    def rows(batches):
        weights = np.uint64(1) << np.arange(signs - 1, -1, -1, dtype=np.int64).astype(np.uint64)
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                v = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.float64).reshape(-1, dim)
                for p in range(passes):
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([seed, p, int(dim)]).standard_normal((int(dim), signs))
                    key = ((v @ planes[p, dim] > 0) @ weights).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), part.column("label"), part.column("dim"), pa.array(key), part.column("id")], ["pass", "label", "dim", "key", "id"])

    return classes.select("id", "label", "dim", "vec").mapInArrow(rows, "pass int, label string, dim int, key long, id long")


def run_links(keys: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Links of all pairs of a run; of a group's links only those that join what the group has not joined yet."""

    def rows(batches):
        for t, edges in groups(batches, ["run", "c1", "c2"]):
            ids, chunk, vec = t.column("id").to_numpy(), t.column("chunk").to_numpy(), t.column("vec")
            out = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                v = matrix(vec.slice(lo, hi - lo))
                c = chunk[lo:hi]
                joined = np.arange(hi - lo)
                for at in range(0, hi - lo, STEP):
                    near = v[at : at + STEP] @ v.T >= threshold
                    if c[0] != c[-1]:
                        near &= c[at : at + STEP, None] < c[None, :]
                    for i in np.flatnonzero(near.any(axis=1)):
                        other = np.flatnonzero(near[i] & (joined != joined[at + i]))
                        if len(other):
                            names, place = np.unique(joined[other], return_index=True)
                            out += [(ids[lo + at + i], ids[lo + j]) for j in other[place]]
                            joined[np.isin(joined, names)] = joined[at + i]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    keys = keys.withColumn("run", F.xxhash64("pass", "label", "dim", "key"))
    run = ["run", "dim"]
    sizes = scratch.written(keys.groupBy(*run).agg(F.count("*").alias("size")).filter("size > 1"), "runs")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    r = keys.join(sizes, run).withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    r = r.select("run", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "id").join(classes.select("id", "vec"), "id")
    r = r.repartition("run", "c1", "c2").sortWithinPartitions("run", "c1", "c2", "chunk")
    return r.mapInArrow(rows, "a long, b long").distinct()


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """members(component, size, id, m, vec) -> id, n: copies at the threshold in the component, other than the class itself."""

    def rows(batches):
        for t, edges in groups(batches, ["component", "c1", "c2"]):
            ids, m, chunk = t.column("id").to_numpy(), t.column("m").to_numpy(), t.column("chunk").to_numpy()
            c1, c2, vec = t.column("c1").to_numpy(), t.column("c2").to_numpy(), t.column("vec")
            n = np.zeros(len(ids), np.int64)
            for lo, hi in zip(edges[:-1], edges[1:]):
                v = matrix(vec.slice(lo, hi - lo))
                near = v @ v.T >= threshold
                np.fill_diagonal(near, False)
                if c1[lo] < c2[lo]:
                    near &= chunk[lo:hi, None] != chunk[None, lo:hi]
                n[lo:hi] = near @ m[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    r = members.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    r = r.select("component", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "id", "m", "vec")
    r = r.repartition("component", "c1", "c2").sortWithinPartitions("component", "c1", "c2")
    return r.mapInArrow(rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, seed: int = 8, window: int = WINDOW) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    rows = scratch.written(usable(vectors), "vectors")
    good = rows.filter("ok")
    classes = scratch.written(good.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.min_by("vec", "vec_id").alias("vec")), "vector-classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    keys = scratch.written(runs_of(classes, passes_for(largest, threshold, window=window), leading_signs(largest, window), seed), "signs")
    linked = scratch.written(components(run_links(keys, classes, threshold)), "vector-components")
    sizes = linked.groupBy("component").agg(F.count("*").alias("size"))
    counts = link_counts(linked.join(sizes, "component").join(classes.select("id", "m", "vec"), "id"), threshold)
    found = classes.select("label", "dim", "digest", "id", "m").join(linked, "id", "left").join(counts, "id", "left")
    found = found.select("label", "dim", "digest", F.coalesce("component", "id").alias("component"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    out = rows.select("vec_id", "label", "dim", "digest").join(found, ["label", "dim", "digest"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
