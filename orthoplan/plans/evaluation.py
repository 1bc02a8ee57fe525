"""Evaluation sets and the gate report of one or several configurations."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplan.operators import evaluate
from orthoplan.operators.raster import png
from orthoplan.plans import digitize
from orthoplan.plans.tables import written
from orthoplan.sources import records
from orthoplan.sources.profile import Profile

LINK = "struct<source:string,target:string,attributes:struct<direction:string>>"
BOX = "array<double>"


def box_of(a):
    return F.when(F.size(a) == 4, F.struct(*[a[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


class EvalSet:
    """truth tables of an evaluation folder: labels/<profile>/sheet_N.json, sheets/sheet_N.png, connectivity/sheet_N.json.

    Refuses what does not fit: no labelled sheet, a sheet without raster or connectivity, connectivity of another profile.
    """

    def __init__(self, spark: SparkSession, root: str, profile: Profile, document: str = "eval"):
        mine = (F.col("profile_name") == profile.name) & (F.col("profile_version") == profile.version)
        v = written(records.verdicts(spark, f"{root}/labels/*/sheet_*.json").filter(mine), "labels")
        detection = F.from_json("detection", f"id STRING, symbol_class STRING, line_class STRING, text_class STRING, string STRING, bbox {BOX}, polyline ARRAY<ARRAY<DOUBLE>>, direction {BOX}")
        fixed = F.from_json("correction", f"string STRING, bbox {BOX}, polyline ARRAY<ARRAY<DOUBLE>>")
        d = v.filter("verdict <> 'reject'").withColumns({"d": detection, "c": fixed})
        d = d.withColumn("bbox", F.coalesce("c.bbox", "d.bbox")).withColumn("string", F.coalesce("c.string", "d.string"))
        labelled = v.select("sheet").distinct()
        files = spark.read.format("binaryFile").load(f"{root}/sheets/sheet_*.png").select("path", "content")
        rasters = png.decoded(files).withColumn("sheet", F.regexp_extract("path", r"sheet_(\d+)\.png$", 1).cast("int"))
        links = records.numbered(spark, f"{root}/connectivity/sheet_*.json").withColumn("j", F.from_json("value", f"profile STRUCT<name:STRING,version:STRING>, links ARRAY<{LINK}>"))
        known = links.filter((F.col("j.profile.name") == profile.name) & (F.col("j.profile.version") == profile.version))
        if labelled.isEmpty():
            raise ValueError(f"no labelled sheets for {profile.identity()} under {root}")
        for what, have in (("raster", rasters.filter("error IS NULL")), ("connectivity of this profile", known)):
            lack = [r.sheet for r in labelled.join(have.select("sheet"), "sheet", "left_anti").orderBy("sheet").limit(20).collect()]
            if lack:
                raise ValueError(f"sheets {lack} have no {what}")
        pos = F.row_number().over(_by_sheet("detection_id")) - 1
        s = d.filter("kind = 'symbol'").withColumn("pos", pos)
        t = d.filter(F.col("kind") == "text").filter(F.col("d.text_class").isin(*profile.tag_grammar)).withColumn("pos", pos)
        self.symbols = s.select("sheet", "pos", F.col("detection_id").alias("id"), box_of(F.col("bbox")).alias("bbox"), F.col("d.symbol_class").alias("cls"), F.lit(None).cast("string").alias("string"))
        self.tags = t.select("sheet", "pos", F.col("detection_id").alias("id"), box_of(F.col("bbox")).alias("bbox"), F.lit(None).cast("string").alias("cls"), "string")
        self.links = known.join(labelled, "sheet", "left_semi").select("sheet", F.posexplode("j.links").alias("pos", "l")).select("sheet", "pos", "l.source", "l.target", F.col("l.attributes.direction").alias("direction"))
        xy = lambda a: F.struct(a[0].alias("x"), a[1].alias("y"))
        direction = F.when(F.size("d.direction") == 2, xy(F.col("d.direction")))
        part = lambda kind, row: F.filter(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("detection_id", row.alias("r"))))), lambda x: x.isNotNull())
        a = d.groupBy("sheet").agg(
            part("symbol", F.struct(F.col("d.symbol_class").alias("symbol_class"), box_of(F.col("bbox")).alias("bbox"), direction.alias("direction"))).alias("symbols"),
            part("line", F.struct(F.transform(F.coalesce("c.polyline", "d.polyline"), xy).alias("polyline"), F.col("d.line_class").alias("line_class"))).alias("lines"),
            part("text", F.struct("string", F.col("d.text_class").alias("text_class"), box_of(F.col("bbox")).alias("bbox"))).alias("texts"),
        )
        rows = lambda c: F.transform(c, lambda x: x["r"]).alias(c)
        a = a.select("sheet", F.struct(rows("symbols"), rows("lines"), rows("texts")).alias("annotations"))
        sheets = rasters.join(labelled, "sheet", "left_semi").join(a, "sheet", "left")
        self.sheets = sheets.select(F.lit(document).alias("document"), "sheet", "width", "height", "raster", "annotations")


def _by_sheet(order: str):
    from pyspark.sql import Window

    return Window.partitionBy("sheet").orderBy(order)


def scores(run: digitize.Run, truth: EvalSet) -> dict[str, DataFrame]:
    """Per sheet: symbols (tp, fp, fn), tags (truth, exact), links (tp, fp, fn) and directions. A sheet that could not be
    digitized has no predictions (a run holds none), so its truth counts as missed."""
    pred = run.symbols.select("sheet", "pos", "id", "bbox", F.col("symbol_class").alias("cls"))
    texts = run.texts.select("sheet", "pos", "bbox", F.lit(None).cast("string").alias("cls"), "string")
    m = written(evaluate.greedy_match(evaluate.candidate_pairs(pred, truth.symbols)), "matches")
    ids = m.join(pred.select("sheet", F.col("pos").alias("p"), "id"), ["sheet", "p"]).join(truth.symbols.select("sheet", F.col("pos").alias("t"), F.col("id").alias("truth_id")), ["sheet", "t"]).select("sheet", "id", "truth_id")
    e = run.edges.withColumn("pos", (F.col("part") * 1_000_000 + F.col("k")).cast("int")).select("sheet", "pos", "source", "target", "direction")
    links = written(evaluate.predicted_links(e, run.assembly.terminals.select("sheet", "ord", "node_tag", "id"), ids), "links")
    counts = evaluate.link_counts(links, truth.links).groupBy("sheet").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return {"symbol": evaluate.box_scores(m, pred, truth.symbols), "tag": evaluate.tag_scores(texts, truth.tags), "connectivity": counts, "direction": evaluate.link_directions(links, truth.links)}


def gate_report(truth: EvalSet, profile: Profile, config: digitize.Config | None = None, **seams) -> dict:
    """One configuration's report: coverage, failures, micro-averaged metrics, gates."""
    began = time.monotonic()
    config = config or digitize.Config()
    run = digitize.digitized(truth.sheets, profile, config=config, **seams)
    s = scores(run, truth)
    failures = [{"sheet": r.sheet, "reason": r.reason} for r in run.assembly.problems.select("sheet", "reason").distinct().orderBy("sheet").toLocalIterator()]
    symbol, link = (evaluate.micro(s[k]).first().asDict() for k in ("symbol", "connectivity"))
    tag = s["tag"].agg(F.coalesce(F.sum("truth"), F.lit(0)).alias("truth"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact")).first().asDict()
    tag["exact_match"] = tag["exact"] / tag["truth"] if tag["truth"] else None
    way = s["direction"].agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("agreeing", "conflicting", "unasserted")]).first().asDict()
    link["direction"] = {"truth_known": sum(way.values())} | way
    found = {"symbol_f1": symbol["f1"], "tag_exact_match": tag["exact_match"], "connectivity_f1": link["f1"]}
    table = truth.sheets.sparkSession.createDataFrame(list(found.items()), "metric string, score double")
    gates = [r.asDict() for r in evaluate.gates(table).collect()]
    total = truth.sheets.count()
    bad = len({f["sheet"] for f in failures})
    return {
        "harness_version": evaluate.VERSION, "profile": profile.identity(), "config": vars(config), "seconds": time.monotonic() - began, "coverage": {"total_sheets": total, "succeeded": total - bad, "failed": bad},
        "failures": failures, "metrics": {"symbol": symbol, "tag": tag, "connectivity": link}, "gates": gates, "passed": all(g["passed"] for g in gates),
    }


def compare(truth: EvalSet, profile: Profile, configs: list[digitize.Config], **seams) -> list[dict]:
    if len(configs) < 2:
        raise ValueError("a comparison has two configurations or more")
    return [gate_report(truth, profile, c, **seams) for c in configs]
