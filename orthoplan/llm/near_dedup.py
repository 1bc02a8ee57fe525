"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Documents with equal shingle sets are one class from the start and only its smallest id takes part. Every tree starts
with all classes in its root. A root picks minwise coordinates at random, each with probability 1 / (threshold x number
of coordinates), and sends a class to a child for each picked coordinate, by the class's value there: a pair agrees in
each with the probability of its similarity. Trees are drawn until their picks reach the wanted recall at the threshold.
Every child is first linked through pivots (its smallest id, for each chunk of it). Children that still hold several
components are compared exhaustively, chunk against chunk, whatever their size: paths end there, as each further level
would lose pairs. Sketches only choose what is compared; every link is confirmed on the full shingle sets of the texts.

Skew: rows of a large node are spread over chunks, groups of equal sets are one row, and joins back from a group to its
rows are plain joins that adaptive execution splits. Pairs within a group are not listed: once connected, members are
not compared again.

Nulls and odd rows: null or wordless texts have no shingles and link with nothing; rows without an id are returned with
a null component and kept. Rows with the same id count as one document that has the links of each. Repeated rows have
the same component. Texts are read whole, the longest ones portion by portion. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplan.llm import scratch
from orthoplan.llm.components import components
from orthoplan.llm.runs import groups
from orthoplan.llm.shingles import mixed, shared, shingles

#: Minwise coordinates of a sketch.
COORDINATES = 128
#: Wanted share, of pairs right at the threshold, that meet in a common child of some root.
RECALL = 0.99999
#: Children of all roots, at most: a bit each.
MOST_SLOTS = 62
#: Rows of a chunk of a node, about; two chunks at a time are held in memory.
CHUNK = 1024
#: Groups up to this size are compared all at once, larger ones row by row.
TINY = 32
#: Standard deviations that a sketch's estimate may lie under the threshold.
SLACK = 4.0
_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """The minwise values of a set, 32 bits each."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, (s[at : at + 2048, None] * _SEEDS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, d1, d2 (two sums that name the set), sketch, low (the lowest byte of each value)."""

    def rows(batches):
        for b in batches:
            n, d1, d2, sk, low = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                d1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int(mixed(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).astype(np.int64)))
                v = sketch(s) if len(s) else None
                sk.append(None if v is None else v.tobytes())
                low.append(None if v is None else v.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(sk, pa.binary()), pa.array(low, pa.binary())], ["doc_id", "n", "d1", "d2", "sketch", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, d1 long, d2 long, sketch binary, low binary")


def picks(root: int, threshold: float) -> np.ndarray:
    """The coordinates that a root branches on."""
    coordinate = mixed(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1))
    return np.flatnonzero(mixed(coordinate ^ np.uint64(root)) < np.uint64(int(2**64 / (threshold * COORDINATES))))


def slots_for(threshold: float, recall: float = RECALL) -> int:
    """How many different coordinates the roots need: a pair at the threshold agrees in each with that probability."""
    n = math.ceil(math.log(1 - recall) / math.log(1 - threshold)) if threshold < 1 else 1
    if n > MOST_SLOTS:
        raise ValueError(f"a threshold of {threshold} needs {n} coordinates for a recall of {recall}; {MOST_SLOTS} are the most")
    return n


def roots_of(seed: int, threshold: float) -> list[int]:
    """Roots drawn until their picks are as many different coordinates as the recall needs; a root without picks, with one that is taken or with too many is drawn anew."""
    roots, taken, at, wanted = [], set(), 0, slots_for(threshold)
    while len(taken) < wanted:
        root = int(mixed(np.array([at + (seed << 32)], np.uint64))[0])
        own = set(picks(root, threshold).tolist())
        if own and not own & taken and len(own | taken) <= wanted:
            roots.append(root)
            taken |= own
        at += 1
    return roots


def slots(seed: int, threshold: float) -> np.ndarray:
    """The coordinate of each child of the roots, tree by tree."""
    return np.concatenate([picks(v, threshold) for v in roots_of(seed, threshold)])


def children(classes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """classes(id, sketch) -> node, id, slot: a row for each child of a root; slot is the child's place in slots()."""

    def rows(batches):
        places = slots(seed, threshold)
        roots = np.concatenate([np.full(len(picks(v, threshold)), v, np.uint64) for v in roots_of(seed, threshold)])
        for b in batches:
            values = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            nodes = mixed(mixed(values[:, places] + (places.astype(np.uint64) << np.uint64(32))) ^ roots)
            ids = b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), len(places))))
            slot = np.tile(np.arange(len(places), dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().astype(np.int64)), ids, pa.array(slot)], ["node", "id", "slot"])

    return classes.mapInArrow(rows, "node long, id long, slot int")


def bytes_matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)


def full_matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)


PAIRS = "a long, b long"


def pair_batch(a, b):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def to_pivots(members: DataFrame, least: int) -> DataFrame:
    """For each group (node, chunk): every row with the group's smallest id, or else with the most alike of the rows just before it."""

    def rows(batches):
        for t, edges in groups(batches, ["node", "chunk"]):
            ids, sk = t.column("id").to_numpy(), bytes_matrix(t)
            first = np.repeat(edges[:-1], np.diff(edges))
            best, partner = (sk == sk[first]).sum(axis=1), first.copy()
            place = np.arange(len(ids))
            best[place == first] = -1
            done = best >= least
            for d in range(1, 9):
                i = np.flatnonzero(~done & (place - d >= first))
                if not len(i):
                    break
                alike = (sk[i] == sk[i - d]).sum(axis=1)
                better = alike > best[i]
                best[i[better]], partner[i[better]] = alike[better], i[better] - d
            i = np.flatnonzero(best >= least)
            yield pair_batch(ids[partner[i]], ids[i])

    return members.repartition("node", "chunk").sortWithinPartitions("node", "chunk", "id").mapInArrow(rows, PAIRS).distinct()


GROUP = ["node", "c1", "c2"]
MEMBERS = "node long, c1 int, c2 int, slot int, ready long, chunk int, id long, component long"


def candidates(t: pa.Table, edges: np.ndarray, least: int, coordinates: np.ndarray):
    """Places (i, j) of alike rows of one group, from different components and, in a group of two chunks, from different
    chunks. Of the nodes that two rows have in common only the first (among those compared) gives the pair."""
    comp, chunk, full = t.column("component").to_numpy(), t.column("chunk").to_numpy(), full_matrix(t)
    sk, value = full.astype(np.uint8), full[:, coordinates]
    slot, ready = t.column("slot").to_numpy(), t.column("ready").to_numpy()
    bit = np.int64(1) << np.arange(len(coordinates), dtype=np.int64)
    between = t.column("c1").to_numpy() < t.column("c2").to_numpy()
    size, last = np.repeat(np.diff(edges), np.diff(edges)), np.repeat(edges[1:], np.diff(edges))
    place = np.arange(len(comp))

    def kept(i, j):
        ok = (sk[i] == sk[j]).sum(axis=1) >= least
        i, j = (i[ok] if isinstance(i, np.ndarray) else np.full(np.count_nonzero(ok), i)), j[ok]
        common = ((value[i] == value[j]) @ bit) & ready[i]
        first = common & -common == np.int64(1) << slot[i].astype(np.int64)
        return i[first], j[first]

    for d in range(1, TINY):
        i = np.flatnonzero((size <= TINY) & (place + d < last))
        if not len(i):
            break
        i = i[(comp[i] != comp[i + d]) & (~between[i] | (chunk[i] != chunk[i + d]))]
        yield kept(i, i + d)
    for i in np.flatnonzero((size > TINY) & (place + 1 < last)):
        rest = slice(i + 1, last[i])
        yield kept(i, np.flatnonzero((comp[rest] != comp[i]) & ((chunk[rest] != chunk[i]) | ~between[i])) + i + 1)


def with_candidates(members: DataFrame, least: int, coordinates: np.ndarray) -> DataFrame:
    """The rows of a group (node, c1, c2) that have a candidate in it: sketches only, and no pair leaves the task."""

    def rows(batches):
        for t, edges in groups(batches, GROUP):
            some = np.zeros(len(t), bool)
            for i, j in candidates(t, edges, least, coordinates):
                some[i] = some[j] = True
            yield from t.select(["node", "c1", "c2", "slot", "ready", "chunk", "id", "component"]).filter(pa.array(some)).to_batches()

    return members.repartition(*GROUP).sortWithinPartitions(*GROUP, "id").mapInArrow(rows, MEMBERS)


def exhaustive(members: DataFrame, least: int, percent: int, coordinates: np.ndarray) -> DataFrame:
    """members with sketches and full sets -> links that join components: every candidate pair of a group is confirmed on
    the sets unless links found in the group have joined its components by then."""

    def rows(batches):
        for t, edges in groups(batches, GROUP):
            ids, comp = t.column("id").to_numpy(), t.column("component").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            size = np.array([len(x) for x in sets])
            group = np.searchsorted(edges, np.arange(len(ids)), side="right").tolist()
            parent: dict[tuple[int, int], tuple[int, int]] = {}

            def find(i):
                x = (group[i], int(comp[i]))
                while (y := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(y, y)
                return x

            def alike(p, q):
                """Which of the rows q are linked with row p."""
                every = np.concatenate([sets[j] for j in q])
                at = np.searchsorted(sets[p], every)
                at[at == size[p]] = 0
                both = np.add.reduceat((sets[p][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size[q])[:-1]]))
                return q[100 * both >= percent * (size[p] + size[q] - both)]

            out = []
            for i, j in candidates(t, edges, least, coordinates):
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                for part in np.split(j, np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
                    p = int(i[0])
                    i = i[len(part) :]
                    q = np.array([x for x in part.tolist() if find(x) != find(p)], np.int64)
                    for x in alike(p, q).tolist() if len(q) else []:
                        if (a := find(p)) != (b := find(x)):
                            parent[a] = b
                            out.append((ids[p], ids[x]))
            yield pair_batch([x for x, _ in out], [y for _, y in out])

    ordered = members.repartition(*GROUP).sortWithinPartitions(*GROUP, "id")
    return ordered.mapInArrow(rows, PAIRS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents with the given ids; by a merge join at every size, as neither side is bounded."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("merge"), "doc_id", "left_semi")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles (sorted, as bytes)."""

    def rows(batches):
        for b in batches:
            sets = [shingles(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return texts_of(docs, ids).mapInArrow(rows, "id long, shingles binary")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 x shared >= percent x united. Texts of documents in no pair stay out of the joins."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = scratch.written(texts_of(docs, ids), "pair-texts")

    def rows(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                key = hash(ta)
                if key not in seen:
                    seen.clear()
                    seen[key] = shingles(ta)
                x, y = seen[key], shingles(tb)
                both = shared(x, y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pair_batch([p[0] for p in out], [p[1] for p in out])

    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    full = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    links = scratch.written(full.select("a", "b", "ta", "tb").mapInArrow(rows, PAIRS), "links")
    scratch.removed(docs.sparkSession, texts)
    return links


def near_duplicates(docs: DataFrame, percent: int = 75, seed: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    threshold = percent / 100
    least = int(COORDINATES * threshold - SLACK * (COORDINATES * threshold * (1 - threshold)) ** 0.5)
    sets = scratch.written(sketches(docs), "sets")
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.written(known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("sketch", "low"), "doc_id").alias("s")).select("d1", "d2", "n", "id", "s.*"), "classes")
    small = classes.select("id", F.col("low").alias("sketch")).dropDuplicates(["id"])
    whole = classes.select("id", "sketch").dropDuplicates(["id"])
    coordinates = slots(seed, threshold)

    # classes in the nodes that hold more than one
    first = scratch.written(children(classes.select("id", "sketch"), threshold, seed), "first-nodes")
    nodes = scratch.written(first.join(first.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "node"), "nodes")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CHUNK)).cast("int")
    same_id = known.join(classes.select("d1", "d2", "n", "id"), ["d1", "d2", "n"]).groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("a", "b")
    pairs = scratch.written(to_pivots(nodes.withColumn("chunk", chunk).join(small, "id"), least), "pairs")
    links = confirmed(pairs, docs, percent).unionByName(same_id)
    linked = scratch.written(components(links), "components")
    spark = docs.sparkSession
    scratch.removed(spark, first, pairs)

    # what stays apart in common nodes
    with_component = nodes.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = with_component.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("node")
    here = scratch.written(with_component.join(open_, "node"), "open-nodes")
    in_slots = here.groupBy("id").agg(F.expr("bit_or(shiftleft(1L, slot)) AS ready"))
    n_chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    ready = here.join(in_slots, "id").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    ready = ready.withColumn("c1", F.least("chunk", "other")).withColumn("c2", F.greatest("chunk", "other"))
    late = with_candidates(ready.join(whole, "id").select(*GROUP, "slot", "ready", "chunk", "id", "component", "sketch"), least, coordinates)
    late = scratch.written(late, "candidates")
    scratch.removed(spark, here, nodes)
    if not late.isEmpty():
        sets_of = scratch.written(full_sets(docs, late.select(F.col("id").alias("doc_id")).distinct()), "full-sets")
        new = exhaustive(late.join(whole, "id").join(sets_of, "id"), least, percent, coordinates)
        linked = scratch.written(components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new)), "components")
        scratch.removed(spark, sets_of)
    scratch.removed(spark, late)

    found = classes.select("d1", "d2", "n", "id").join(linked, "id", "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component_id"))
    rows = sets.select("doc_id", "n", "d1", "d2")
    out = rows.join(found, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
