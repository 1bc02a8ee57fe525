"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (target / size of the source). The running sum of
expected copies over the source's documents, plus one random offset for the source, emits a document once for each
integer that its step crosses. Documents are ordered by size, so the words taken stay within about one document of the
target. The running sum needs the rank of each document in its source; a hot source never meets in one task, because
ranks are put together level by level: sizes within a source, then blocks of ids within blocks of ids (at most 65,536 in
each), whatever the ids are, then rows within the smallest block.

Nulls and ties: a null text has size 0; null is a source of its own (the last one); null ids come first of their size and
are ordered, as repeated ids are, by a hash of the text. Repeated rows are separate documents, which take neighbouring
ranks in one task. Texts are read whole, whatever their length. An empty table gives an empty result. The input's columns
pass through renamed by their place, so their names cannot clash with internal ones; size, source_size, target, copies and
taken are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoplan.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of an id that a level of blocks leaves out, and the names of the levels, smallest first.
BITS = 16
LEVELS = ("block", "block2", "block3")
ADDED = ("size", "source_size", "target", "copies", "taken")
SOURCE = ["none", "name"]
SIZE = [*SOURCE, "size", "known"]


def weighted(sources: DataFrame, weights: list[int], most: float) -> DataFrame:
    """sources(source, source_size) -> + weight, target: shares of the total by weight, none above most times its size.

    A single window over one row per source: with the sources in the order in which they reach their cap, the common
    level is the first that no later source's cap undercuts.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1)
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level)
    common = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return s.withColumn("target", F.least(common * F.col("weight"), F.col("cap"))).select("source", "source_size", "weight", "target")


def offset(seed: int):
    """A number in [0, 1) for each source."""
    name = F.when(F.col("source").isNull(), F.lit(f"{seed}:null")).otherwise(F.concat(F.lit(f"{seed}:s:"), F.col("source")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def before(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows(..., n) -> + at: the sum of n over the rows that come before it."""
    return rows.withColumn("at", F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def starts_of(blocks: DataFrame) -> DataFrame:
    """blocks(SIZE..., block, n) -> SIZE..., block, at: how many rows of the source come before the block."""
    levels = [blocks]
    for low, high in zip(LEVELS, LEVELS[1:]):
        levels[-1] = levels[-1].withColumn(high, F.shiftright(low, BITS))
        levels.append(levels[-1].groupBy(*SIZE, high).agg(F.sum("n").alias("n")))
    sizes = levels[-1].groupBy(*SIZE).agg(F.sum("n").alias("n"))
    at, key = before(sizes, SOURCE, ["size", "known"]).select(*SIZE, F.col("at").alias("above")), SIZE
    for rows, name in zip(levels[::-1], LEVELS[::-1]):
        at = before(rows, key, [name]).join(at, key).select(*SIZE, name, (F.col("at") + F.col("above")).alias("above"))
        key = [*SIZE, name]
    return at.withColumnRenamed("above", "at")


def own_names(docs: DataFrame) -> dict[str, str]:
    """The input's columns by place, in0, in1 and so on: names that no internal column has."""
    return {c: f"in{i}" for i, c in enumerate(docs.columns)}


def ranked(docs: DataFrame, weights: list[int], most: float, seed: int) -> DataFrame:
    """docs(doc_id, text, source, ...) -> its columns by own_names(), size, source_size, target, copies, taken."""
    kept = own_names(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.xxhash64("text")  # here, so that a query without texts does not move them
    ident = F.coalesce(F.col("doc_id").cast("long"), tie)
    d = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in kept.items()], F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), size.alias("size"), F.col("doc_id").isNotNull().alias("known"), ident.alias("ident"), tie.alias("tie"))
    d = d.withColumn("block", F.shiftright("ident", BITS))
    blocks = scratch.written(d.groupBy(*SIZE, "block").agg(F.count("*").alias("n")), "mix-blocks")
    rates = weighted(sizes_of_sources(blocks), weights, most).withColumn("u", offset(seed))
    rates = rates.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", "u")
    rank = F.row_number().over(Window.partitionBy(*SIZE, "block").orderBy("ident", "tie"))
    out = d.join(starts_of(blocks).join(rates, SOURCE), [*SIZE, "block"]).withColumn("i", rank + F.col("at"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(F.col("i") * rate + F.col("u")) - F.floor((F.col("i") - 1) * rate + F.col("u"))
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select(*kept.values(), *ADDED)


def mix(docs: DataFrame, weights: list[int] | None = None, most: float = 3.0, seed: int = 9) -> DataFrame:
    """docs(doc_id, text, source, ...) -> the same columns + size, source_size, target, copies, taken."""
    out = ranked(docs, weights or [1, 2, 3], most, seed)
    return out.select(*[F.col(v).alias(c) for c, v in own_names(docs).items() if c.lower() not in ADDED], *ADDED)


def sizes_of_sources(blocks: DataFrame) -> DataFrame:
    s = blocks.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    return s.select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size")


def drawn(docs: DataFrame, weights: list[int] | None = None, most: float = 3.0, seed: int = 9) -> DataFrame:
    """The mix itself: every document as often as it is drawn, with the columns of docs."""
    m = ranked(docs, weights or [1, 2, 3], most, seed).filter(F.col("copies") > 0)
    kept = own_names(docs)
    return m.select(*kept.values(), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*[F.col(v).alias(c) for c, v in kept.items()])
