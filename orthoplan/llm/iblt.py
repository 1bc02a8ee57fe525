"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions alone.

A text's paragraphs are its lines, long ones in runs of WORDS words; their digests form a set. A sketch adds each digest
to three cells, each in a third of its own; a cell holds a count and the exclusive ors of its digests and of their
checks. Sketches of two versions subtract cell by cell: what they share cancels, and peeling takes out the digests of
cells that hold one, until nothing is left. If something is left, sketches several times as large are tried; if the last
of them cannot be peeled either, the two sets are subtracted themselves. Likeness is one minus the digests recovered over
those of both versions, so it is exact in every case.

Sketches are kept as their non-empty cells in order, so the work follows the number of paragraphs, not of cells. The
fingerprint is the smallest sketch as text. The next document is found in buckets of neighbouring ids, cut at
approximate quantiles, so no task sees the order as a whole; the first documents of the buckets close the gaps.

Nulls: a null text counts as empty; the empty text has no paragraphs and two of them are alike (1.0). Null ids come after
all others. Rows with equal ids are ordered by their text's hash; repeated rows follow one another. Texts are read whole.
With one row, that row is its own next document. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoplan.llm import scratch

WORDS = 16
#: Cells of the fingerprint.
CELLS = 24
#: Documents of a bucket of neighbouring ids, on average, and buckets at most: beyond both, buckets grow.
BUCKET = 1024
BUCKETS = 250_000
#: Sorted entries that are summed together.
BLOCK = 16
#: Rounds of peeling; a sketch that can be peeled at its load takes far fewer.
ROUNDS = 30
PIECE = rf"(?:[^ \n]*+ ){{0,{WORDS - 1}}}[^ \n]*+[ \n]?"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """The set of the text's paragraph digests, sorted."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), 0), lambda p: F.when(F.right(p, F.lit(1)).isin(" ", "\n"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p))
    return F.sort_array(F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p))))


def entries(keys: Column, sign: int, third: Column, salt: int) -> Column:
    """Three cells for each key."""

    def of(k):
        return let(F.xxhash64(k, F.lit(salt)), lambda h: F.array(*[_cell(h, r, third, sign, k) for r in range(3)]))

    return F.flatten(F.transform(keys, of))


def _cell(h, r, third, sign, k):
    place = F.pmod(F.shiftrightunsigned(h, 21 * r).bitwiseAND(F.lit(2097151).cast("long")), third) + third * r
    return F.struct(place.cast("long").alias("cell"), F.lit(sign).cast("int").alias("n"), k.alias("key"), F.xxhash64(k).alias("check"))


_TYPE = "array<struct<cell:bigint,n:int,key:bigint,check:bigint>>"


def folded(rows: Column) -> Column:
    """Sorted entries summed by cell; empty cells go. Appending copies, so for few cells only."""

    def closed(acc):
        cur = acc["cur"]
        return F.when((cur["n"] == 0) & (cur["key"] == 0) & (cur["check"] == 0), acc["done"]).otherwise(F.array_append(acc["done"], cur))

    def add(acc, e):
        cur = acc["cur"]
        both = F.struct(cur["cell"].alias("cell"), (cur["n"] + e["n"]).alias("n"), cur["key"].bitwiseXOR(e["key"]).alias("key"), cur["check"].bitwiseXOR(e["check"]).alias("check"))
        same = cur["cell"] == e["cell"]
        return F.struct(F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"), F.when(same, both).otherwise(e).alias("cur"))

    nothing = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))
    start = F.struct(F.array().cast(_TYPE).alias("done"), nothing.alias("cur"))
    return F.aggregate(rows, start, add, closed)


def cells(rows: Column) -> Column:
    """Entries summed by cell, block by block of the sorted entries, so that time follows their number.

    A block begins behind the entries that belong to the cell before it. Only a cell with more entries than a block has
    could come out in two parts; the next round of peeling sums those again.
    """

    def begin(e, i):
        """Place (from 0) of the first entry at or behind BLOCK * i that begins a cell."""
        at = i * BLOCK
        before = F.get(e, at - 1)["cell"]
        return F.when(i == 0, F.lit(0)).otherwise(F.least(F.size(e), at + F.size(F.filter(F.slice(e, at + 1, F.lit(BLOCK)), lambda x: x["cell"] == before))))

    def blocks(e):
        last = F.floor((F.size(e) - 1) / BLOCK).cast("int")

        def block(i):
            bounds = F.struct(begin(e, i).alias("lo"), F.when(i == last, F.size(e)).otherwise(begin(e, i + 1)).alias("hi"))
            return let(bounds, lambda b: folded(F.slice(e, b["lo"] + 1, F.greatest(F.lit(0), b["hi"] - b["lo"]))))

        return F.when(F.size(e) == 0, e).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), last), block)))

    return let(F.sort_array(rows), blocks)


def sketch(keys: Column, third: Column, salt: int = 0) -> Column:
    """Of few cells."""
    return folded(F.sort_array(entries(keys, 1, third, salt)))


def as_text(keys: Column, sketched: Column) -> Column:
    """Number of digests, then place, count, digests and checks of every cell that is not empty."""
    parts = F.transform(sketched, lambda c: F.concat_ws(".", c["cell"], c["n"], F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"]))))
    return F.concat_ws(";", F.size(keys).cast("string"), F.array_join(parts, ","))


def total(rows: Column, of) -> Column:
    """Exclusive or of a number of each row."""
    return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, r: acc.bitwiseXOR(of(r)))


def recovered(difference: Column, third: Column, salt: int) -> Column:
    """Digests that peeling takes out of a subtracted sketch, or null if some remain.

    Each key lies once in each third, so the first third's exclusive or, of digests and of checks, is that of all keys
    left: when the keys of a round account for it, the rest is empty and need not be summed once more.
    """

    def pure(state):
        return F.filter(state["cells"], lambda c: c["n"].isin(1, -1) & (c["check"] == F.xxhash64(c["key"])))

    def of_sign(good, sign):
        return F.array_distinct(F.transform(F.filter(good, lambda c: c["n"] == sign), lambda c: c["key"]))

    def peel(state, keys):
        both = F.concat(keys["a"], keys["b"])
        first = F.filter(state["cells"], lambda c: c["cell"] < third)
        done = (total(first, lambda c: c["key"]) == total(both, lambda k: k)) & (total(first, lambda c: c["check"]) == total(both, lambda k: F.xxhash64(k)))
        left = F.concat(state["cells"], entries(keys["a"], -1, third, salt), entries(keys["b"], 1, third, salt))
        rest = F.when(done, F.array().cast(_TYPE)).otherwise(cells(left))
        return F.struct(rest.alias("cells"), (state["found"] + F.size(keys["a"]) + F.size(keys["b"])).alias("found"), (F.size(keys["a"]) + F.size(keys["b"]) == 0).alias("stuck"))

    def step(state, _):
        go = (F.size(state["cells"]) > 0) & ~state["stuck"]
        split = lambda good: let(F.struct(of_sign(good, 1).alias("a"), of_sign(good, -1).alias("b")), lambda keys: peel(state, keys))
        return F.when(go, let(pure(state), split)).otherwise(state)

    start = F.struct(difference.alias("cells"), F.lit(0).alias("found"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(F.size(s["cells"]) == 0, s["found"]))


def negative(sketched: Column) -> Column:
    return F.transform(sketched, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["key"].alias("key"), c["check"].alias("check")))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column, differ: float) -> Column:
    """Of two sets of digests by their sketches: the kept ones first, if about the share differ of all digests is expected
    to remain and fits in them; then larger ones. Larger sketches have more empty cells, which cost nothing here, and most
    are peeled in one round."""
    size = F.size(a) + F.size(b)
    third = F.lit(CELLS // 3).cast("long")
    tries = [F.when(size * differ <= 0.8 * CELLS, recovered(folded(F.sort_array(F.concat(sketch_a, negative(sketch_b)))), third, 0))]
    for salt, factor in ((1, 20), (2, 40), (3, 80)):
        larger = (size * factor + CELLS).cast("long")
        tries.append(let(larger, lambda t, s=salt: recovered(cells(F.concat(entries(a, 1, t, s), entries(b, -1, t, s))), t, s)))
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.coalesce(*tries, exact) / size)


def with_bucket(d: DataFrame) -> DataFrame:
    """d(doc_id, ...) -> + bucket: its place among approximate quantiles of the ids, found in two steps. The quantiles' error is
    a quarter of a bucket. Rows without an id are dealt to buckets behind all others by their text's hash."""
    stats = d.agg(F.count("doc_id").alias("n"), F.count("*").alias("all")).first()
    parts = max(1, min(BUCKETS, stats["n"] // BUCKET))
    bounds = d.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    coarse = F.from_json(F.lit(json.dumps([f[0] for f in fine[1:]])), "array<bigint>")
    within = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
    place = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id")))
    found = let(place, lambda p: p * step + F.size(F.filter(F.element_at(within, p + 1), lambda b: b <= F.col("doc_id"))))
    rest = max(1, min(BUCKETS, (stats["all"] - stats["n"]) // BUCKET))
    unknown = F.floor((F.col("k") / 2.0**64 + 0.5) * rest).cast("int")  # in the order of k, as within a bucket
    return d.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(bounds) + 2 + unknown).otherwise(found))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_bucket(d.withColumn("k", F.xxhash64("text")))
    order = [F.col("doc_id").asc_nulls_last(), F.col("k")]
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "k")
    first = scratch.written(d.groupBy("bucket").agg(F.min_by("text", rank).alias("first_text")), "bucket-firsts")
    buckets = first.select("bucket")  # one row a bucket: a window over all of them is small
    every = Window.orderBy("bucket")
    after = buckets.select("bucket", F.coalesce(F.lead("bucket").over(every), F.min("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    closing = after.join(first.withColumnRenamed("bucket", "after"), "after").select("bucket", "first_text")
    w = Window.partitionBy("bucket").orderBy(*order)
    d = d.withColumn("lead_text", F.lead("text").over(w))
    d = d.join(closing, "bucket").withColumn("next_text", F.coalesce("lead_text", "first_text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    d = d.select("doc_id", "text", n.cast("long").alias("n_chars"), "next_text", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"))
    third = F.lit(CELLS // 3).cast("long")
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next_text")).alias("c"))
    d = d.select("*", *[sketch(F.col(x), third).alias(f"s{x}") for x in "ab"])
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a"), F.col("sa")).alias("fingerprint"), as_text(F.col("b"), F.col("sb")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"), 0.35).alias("near_edited"),
        likeness(F.col("a"), F.col("c"), F.col("sa"), sketch(F.col("c"), third), 1.0).alias("near_next"),
    )
