"""Evaluation: box matching, tag and link scores, gates.

boxes(sheet, pos, bbox struct, cls, string) for each side; links(sheet, pos, source, target, direction).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoplan.functions import geometry as g

IOU = 0.5
VERSION = "1"
# Metric and least score of each gate.
GATES = [("symbol_f1", 0.90), ("tag_exact_match", 0.98), ("connectivity_f1", 0.70)]


def candidate_pairs(pred: DataFrame, truth: DataFrame, least: float = IOU, by_class: bool = True, by: list[str] | None = None) -> DataFrame:
    """Pairs of a sheet with compatible classes (null fits any) and enough overlap: by..., p, t, iou.

    An equi join on the sheet; where sheets hold very many boxes, use gridded_pairs.
    """
    by = by or ["sheet"]
    a = pred.select(*by, F.col("pos").alias("p"), F.col("bbox").alias("pb"), F.col("cls").alias("pc"))
    b = truth.select(*by, F.col("pos").alias("t"), F.col("bbox").alias("tb"), F.col("cls").alias("tc"))
    pairs = a.join(b, by).withColumn("iou", g.iou(F.col("pb"), F.col("tb"))).filter(F.col("iou") >= least)
    if by_class:
        pairs = pairs.filter(F.col("pc").isNull() | F.col("tc").isNull() | (F.col("pc") == F.col("tc")))
    return pairs.select(*by, "p", "t", "iou")


def gridded_pairs(pred: DataFrame, truth: DataFrame, cell: float, least: float = IOU, by_class: bool = True, by: list[str] | None = None) -> DataFrame:
    """candidate_pairs through a grid: only boxes that share a cell meet, so no sheet is joined with itself as a whole."""
    by = by or ["sheet"]

    def cells(d):
        b = F.col("bbox")
        x = F.sequence(F.floor(b["x0"] / cell), F.floor(b["x1"] / cell))
        y = F.sequence(F.floor(b["y0"] / cell), F.floor(b["y1"] / cell))
        return d.withColumn("gx", F.explode(x)).withColumn("gy", F.explode(y))

    return candidate_pairs(cells(pred), cells(truth), least, by_class, [*by, "gx", "gy"]).groupBy(*by, "p", "t").agg(F.first("iou").alias("iou"))


def greedy_match(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One-to-one: the best overlap first, then by place. Sequential within a sheet, on the pruned pairs only; sheets stream
    through a task in order, so none is a call or a frame of its own."""
    by = by or ["sheet"]

    def match(batches):
        sheet, used_p, used_t = None, set(), set()
        for pdf in batches:
            keep = []
            for *key, p, t in zip(*(pdf[c] for c in by), pdf["p"], pdf["t"]):
                if key != sheet:
                    sheet, used_p, used_t = key, set(), set()
                free = p not in used_p and t not in used_t
                if free:
                    used_p.add(p)
                    used_t.add(t)
                keep.append(free)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    ordered = pairs.repartition(*by).sortWithinPartitions(*by, F.desc("iou"), "p", "t")
    return ordered.mapInPandas(match, pairs.schema)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [F.try_divide(tp.cast("double"), tp + fp).alias("precision"), F.try_divide(tp.cast("double"), tp + fn).alias("recall"), F.try_divide(2.0 * tp, 2 * tp + fp + fn).alias("f1")]


def box_scores(matches: DataFrame, pred: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn for each sheet; a sheet without predictions misses all."""
    by = by or ["sheet"]
    n = [d.groupBy(*by).agg(F.count("*").alias(c)) for d, c in ((truth, "n_truth"), (pred, "n_pred"), (matches, "tp"))]
    s = n[0].join(n[1], by, "full").join(n[2], by, "left").fillna(0, ["n_truth", "n_pred", "tp"])
    return s.select(*by, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"))


def micro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    s = scores.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return s.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def tag_scores(pred: DataFrame, truth: DataFrame, least: float = IOU) -> DataFrame:
    """Per sheet: truth tags and how many were read exactly by the box that matches them best."""
    m = greedy_match(candidate_pairs(pred, truth, least, by_class=False))
    exact = m.join(pred.select("sheet", F.col("pos").alias("p"), F.col("string").alias("ps")), ["sheet", "p"]).join(truth.select("sheet", F.col("pos").alias("t"), F.col("string").alias("ts")), ["sheet", "t"])
    exact = exact.groupBy("sheet").agg(F.count_if(F.col("ps") == F.col("ts")).alias("exact"))
    return truth.groupBy("sheet").agg(F.count("*").alias("truth")).join(exact, "sheet", "left").fillna(0, ["exact"])


def pair(source: Column, target: Column) -> list[Column]:
    return [F.least(source, target).alias("low"), F.greatest(source, target).alias("high")]


def link_counts(pred: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Copies of each unordered pair on both sides: by..., low, high, tp, fp, fn."""
    by = by or ["sheet"]
    n = [d.select(*by, *pair(F.col("source"), F.col("target"))).groupBy(*by, "low", "high").agg(F.count("*").alias(c)) for d, c in ((pred, "cp"), (truth, "ct"))]
    both = n[0].join(n[1], [*by, "low", "high"], "full").fillna(0, ["cp", "ct"])
    return both.select(*by, "low", "high", F.least("cp", "ct").alias("tp"), F.greatest(F.col("cp") - F.col("ct"), F.lit(0)).alias("fp"), F.greatest(F.col("ct") - F.col("cp"), F.lit(0)).alias("fn"))


DIRECTIONS = ["agreeing", "conflicting", "unasserted"]


def link_directions(pred: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of the truth links with a known direction, per pair: agreeing, conflicting and unasserted.

    In truth order each takes one predicted copy: one that agrees, else the first that asserts anything. Both sides come as
    one stream, pair by pair, predictions first; a task holds the asserting copies of one pair at a time.
    """
    by = by or ["sheet"]
    keys = [*by, "low", "high"]
    row = lambda d, side: d.select(*by, "pos", *pair(F.col("source"), F.col("target")), (F.col("source") <= F.col("target")).alias("up"), "direction", F.lit(side).alias("side"))
    both = row(pred.filter("direction IN ('known', 'conflict')"), 0).unionByName(row(truth.filter("direction = 'known'"), 1))
    both = both.repartition(*keys).sortWithinPartitions(*keys, "side", "pos").select(*keys, "up", "direction", "side")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*keys).schema) + ", " + ", ".join(f"{c} long" for c in DIRECTIONS)

    def consume(batches):
        now, left, counts = None, [], [0, 0, 0]
        for pdf in batches:
            out = []
            for *key, up, direction, side in zip(*(pdf[c].tolist() for c in pdf.columns)):
                if key != now:
                    if sum(counts):
                        out.append((*now, *counts))
                    now, left, counts = key, [], [0, 0, 0]
                if side == 0:
                    left.append(up if direction == "known" else None)
                    continue
                agrees = up in left
                counts[0 if agrees else 1 if left else 2] += 1
                if left:
                    left.pop(left.index(up) if agrees else 0)
            yield pd.DataFrame(out, columns=[*keys, *DIRECTIONS])
        if sum(counts):
            yield pd.DataFrame([(*now, *counts)], columns=[*keys, *DIRECTIONS])

    return both.mapInPandas(consume, schema)


def predicted_links(edges: DataFrame, terminals: DataFrame, matches: DataFrame) -> DataFrame:
    """Plant edges between truth ids: a tag stands for its first terminal; one without a match becomes `?` and its id.

    edges(sheet, pos, source, target, direction), terminals(sheet, ord, node_tag, id), matches(sheet, id, truth_id)
    """
    first = terminals.groupBy("sheet", "node_tag").agg(F.min_by("id", "ord").alias("id")).join(matches, ["sheet", "id"], "left")
    name = first.select("sheet", "node_tag", F.coalesce("truth_id", F.concat(F.lit("?"), F.col("id"))).alias("name"))
    e = edges.join(name.select("sheet", F.col("node_tag").alias("source"), F.col("name").alias("s")), ["sheet", "source"], "left")
    e = e.join(name.select("sheet", F.col("node_tag").alias("target"), F.col("name").alias("t")), ["sheet", "target"], "left")
    return e.select("sheet", "pos", F.col("s").alias("source"), F.col("t").alias("target"), "direction")


def gates(scores: DataFrame) -> DataFrame:
    """scores(metric, score) against the gates; a gate without a score is shut."""
    g_ = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("threshold")) for m, t in GATES]))
    rows = scores.sparkSession.range(1).select(g_)
    return rows.join(scores, "metric", "left").select("metric", "threshold", "score", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).alias("passed"))
