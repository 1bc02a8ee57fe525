"""From detections to plant items, runs and evidence: joins within a sheet, and two sequential kernels per sheet.

symbols(document, sheet, pos, id, symbol_class, bbox, confidence, provenance, direction)
lines(document, sheet, pos, id, polyline, line_class, confidence, provenance)
texts(document, sheet, pos, id, string, text_class, bbox, confidence, provenance, resolved)
legend(symbol_class, role, equipment_type, component_class, shape)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoplan.functions import geometry as g
from orthoplan.functions import text as tx
from orthoplan.plans.tables import written

SHEET = ["document", "sheet"]
SNAP, ARROW = 2.0, 3.0
UNCLASSIFIED = "unclassified"
# Roles of plant items, and the roles that each class of text may name.
EQUIPMENT, COMPONENT, INSTRUMENT, CONNECTOR = "Equipment", "PipingComponent", "ProcessInstrumentationFunction", "PipeOffPageConnector"
TERMINALS = [EQUIPMENT, COMPONENT, INSTRUMENT, CONNECTOR]
TARGETS = {"equipment_tag": [EQUIPMENT, COMPONENT], "instrument_tag": [INSTRUMENT], "opc_label": [CONNECTOR], "opc_direction": [CONNECTOR]}


@dataclass
class Assembly:
    terminals: DataFrame  # SHEET, ord, id, role, ..., tag, tag_id, labels, node_tag, node_name, combined_*
    nozzles: DataFrame  # SHEET, ord, id, terminal, ...
    runs: DataFrame  # SHEET, ord, id, polyline, ..., ends array<struct<terminal,nozzle,junction>>, line_numbers, flow
    junctions: DataFrame  # SHEET, junction, point, ords array<int>
    evidence: DataFrame  # SHEET, run, seq, orientation, source, evidence_id, propagated
    problems: DataFrame  # SHEET, reason


def nearest(left: DataFrame, right: DataFrame, on: list[str], distance: Column, order: str, keep: list[str], key: list[str]) -> DataFrame:
    """For each left row (key) the right row at the least distance, the first in order among equals."""
    j = left.join(right, on)
    return j.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(distance, F.col(order))).alias("n")).select(*key, "n.*")


def nearest_along(left: DataFrame, right: DataFrame, on: list[str], value: str, order: str, key: list[str]) -> DataFrame:
    """nearest() along one axis: left(on, key, value), right(on, order, value) -> key, order of the right row with the nearest
    value, the first in order among equals. Two sorted passes instead of every pair."""
    places = right.groupBy(*on, value).agg(F.min(order).alias("o"))
    none = F.lit(None).cast(places.schema["o"].dataType)
    every = places.select(*on, value, "o", *[F.lit(None).cast(left.schema[k].dataType).alias(k) for k in key], F.lit(0).alias("side"))
    every = every.unionByName(left.select(*on, value, none.alias("o"), *key, F.lit(1).alias("side")))
    place = F.when(F.col("side") == 0, F.struct(F.col(value).alias("v"), "o"))
    up = Window.partitionBy(*on).orderBy(F.col(value), "side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*on).orderBy(F.col(value).desc(), "side").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("below", F.last(place, ignorenulls=True).over(up)).withColumn("above", F.last(place, ignorenulls=True).over(down)).filter("side = 1")
    ranked = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(value) - F.col(f"{c}.v")).alias("d"), F.col(f"{c}.o").alias("o"))) for c in ("below", "above")]
    return found.withColumn("n", F.least(*ranked)).filter("n IS NOT NULL").select(*key, F.col("n.o").alias(order))


#: Side of the grid cells in which run ends meet boxes.
CELL = 64.0


def attach_ends(ends: DataFrame, boxes: DataFrame, tolerance: float = SNAP, by: list[str] | None = None, cell: float = CELL) -> DataFrame:
    """ends(by, run, end, p), boxes(by, terminal, nozzle, bbox) -> the end's first touching box: nozzles of all terminals before
    any terminal's own box, each in order. Not the nearest one. Ends at one place are looked up once, equal boxes count as the
    first of them, and a place meets the boxes of its grid cell only. Ends that share a key share the first of their boxes."""
    by = by or SHEET
    across = lambda low, high: F.sequence(*[F.floor((F.col(f"bbox.{c}") + t) / cell) for c, t in ((low, -tolerance), (high, tolerance))])
    rank = F.struct(F.col("nozzle").isNull().alias("own"), "terminal", "nozzle")
    tiles = boxes.groupBy(*by, "bbox").agg(F.min(rank).alias("a")).withColumn("gx", F.explode(across("x0", "x1"))).withColumn("gy", F.explode(across("y0", "y1")))
    placed = ends.withColumn("x", F.col("p.x")).withColumn("y", F.col("p.y"))
    places = placed.select(*by, "x", "y").distinct().withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    hit = places.join(tiles, [*by, "gx", "gy"]).filter(g.near_box(g.point(F.col("x"), F.col("y")), F.col("bbox"), tolerance))
    first = hit.groupBy(*by, "gx", "gy", "x", "y").agg(F.min("a").alias("a")).drop("gx", "gy")  # by the join's own keys: no further shuffle
    key = Window.partitionBy(*by, "run", "end")
    found = placed.join(first, [*by, "x", "y"], "left").withColumn("a", F.min("a").over(key))
    return found.select(*by, "run", "end", "p", "a.terminal", "a.nozzle")


def loose_junctions(ends: DataFrame) -> DataFrame:
    """Loose run ends that meet: each joins the first cluster whose first point is within reach; clusters of one are dropped.
    In order of runs and ends, so sequential within a sheet."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        anchors, member = [], []
        for p in pdf.sort_values(["run", "end"])["p"]:
            k = next((i for i, a in enumerate(anchors) if ((a["x"] - p["x"]) ** 2 + (a["y"] - p["y"]) ** 2) ** 0.5 <= SNAP), len(anchors))
            if k == len(anchors):
                anchors.append(p)
            member.append(k)
        out = pdf.sort_values(["run", "end"]).assign(junction=member)
        out["x"] = [anchors[k]["x"] for k in member]
        out["y"] = [anchors[k]["y"] for k in member]
        return out[out.groupby("junction")["run"].transform("size") > 1][[*SHEET, "run", "end", "junction", "x", "y"]]

    loose = ends.filter("terminal IS NULL").select(*SHEET, "run", "end", "p")
    return loose.groupBy(*SHEET).applyInPandas(cluster, "document string, sheet int, run int, end int, junction int, x double, y double")


EVIDENCE = "document string, sheet int, run int, seq int, orientation string, source string, evidence_id string, propagated boolean"


def propagated(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """Seeds and what follows from them: a direction crosses junctions of exactly two run ends, keeps its origin, reaches each
    run once, and a run in conflict passes nothing on. A breadth-first walk within a sheet."""

    def walk(key, s: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        evidence: dict[int, list[tuple]] = {}
        for r in s.sort_values("seq").itertuples() if "seq" in s else ():
            evidence.setdefault(r.run, []).append((r.orientation, r.source, r.evidence_id, False))
        m = m if "run" in m else pd.DataFrame(columns=["run", "end", "junction"])  # a side without rows comes without columns
        at = {(r.run, r.end): r.junction for r in m.itertuples()}
        meets: dict[int, list[tuple[int, int]]] = {}
        for r in m.sort_values(["run", "end"]).itertuples():
            meets.setdefault(r.junction, []).append((r.run, r.end))

        def flow(run):
            got = evidence.get(run, [])
            if len({e[0] for e in got}) != 1:
                return None
            return next((e for e in got if not e[3]), got[0])

        todo = [run for run in sorted(evidence) if flow(run)]
        for run in todo:
            if (f := flow(run)) is None:
                continue
            for end in (0, 1):
                both = meets.get(at.get((run, end)), [])
                if len(both) != 2 or both[0][0] == both[1][0]:
                    continue
                other, other_end = both[0] if both[1][0] == run else both[1]
                if any(e[1:3] == f[1:3] for e in evidence.get(other, [])):
                    continue
                out = (f[0] == "from_to") == (end == 1)
                forward = out == (other_end == 0)
                evidence.setdefault(other, []).append(("from_to" if forward else "to_from", f[1], f[2], True))
                if flow(other):
                    todo.append(other)
        rows = [(*key, run, i, *e) for run, es in evidence.items() for i, e in enumerate(es)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EVIDENCE.split(", ")])

    members = members.select(*[F.col(c).alias(c) for c in (*SHEET, "run", "end", "junction")])  # attributes of its own, whatever it shares with seeds
    return seeds.groupBy(*SHEET).cogroup(members.groupBy(*SHEET)).applyInPandas(walk, EVIDENCE)


def flows(evidence: DataFrame) -> DataFrame:
    """Per run: conflict (its evidence points both ways), flow (of the first evidence, seeds before propagated, if it does not) and
    all references."""
    e = evidence.groupBy(*SHEET, F.col("run").alias("ord")).agg(
        (F.count_distinct("orientation") > 1).alias("conflict"), F.min_by(F.struct("orientation", "source", "propagated"), F.struct("propagated", "seq")).alias("f"),
        F.array_sort(F.collect_set(tx.evidence_ref(F.col("source"), F.col("evidence_id"), F.col("propagated")))).alias("refs"),
    )
    return e.select(*SHEET, "ord", "conflict", F.when(~F.col("conflict"), F.col("f")).alias("flow"), "refs")


def _order(*columns: Column) -> Column:
    return F.struct(*[c.cast("int").alias(f"o{i}") for i, c in enumerate(columns)]).alias("o")


def assembled(symbols: DataFrame, lines: DataFrame, texts: DataFrame, legend: DataFrame, faults: DataFrame | None = None) -> Assembly:
    """The legend is a profile's dictionary, some hundred rows, and is broadcast. faults(document, sheet, reason): of sheets that
    could not be read; they count as problems."""
    known = symbols.filter(F.col("symbol_class") != UNCLASSIFIED).join(F.broadcast(legend.withColumn("listed", F.lit(True))), "symbol_class", "left")
    problems = [known.filter("listed IS NULL").select(*SHEET, F.concat(F.lit("symbol class "), "symbol_class", F.lit(" ("), "id", F.lit(") is not in the legend")).alias("reason"))]
    terminals = known.filter(F.col("role").isin(*TERMINALS)).withColumnRenamed("pos", "ord")
    nozzles = known.filter("role = 'Nozzle'").withColumnRenamed("pos", "ord")
    arrows = known.filter("role = 'FlowArrow'")
    runs = lines.withColumnRenamed("pos", "ord")

    parents = terminals.filter(F.col("role") == EQUIPMENT).select(*SHEET, F.col("ord").alias("terminal"), F.col("bbox").alias("tb"))
    parent = nearest(nozzles, parents, SHEET, g.dist(g.center(F.col("bbox")), g.center(F.col("tb"))), "terminal", ["terminal"], [*SHEET, "ord"])
    nozzles = written(nozzles.join(parent, [*SHEET, "ord"], "left"), "nozzles")
    problems.append(nozzles.filter("terminal IS NULL").select(*SHEET, F.concat(F.lit("nozzle "), "id", F.lit(" has no equipment")).alias("reason")))

    boxes = terminals.select(*SHEET, F.col("ord").alias("terminal"), F.lit(None).cast("int").alias("nozzle"), "bbox")
    boxes = boxes.unionByName(nozzles.filter("terminal IS NOT NULL").select(*SHEET, "terminal", F.col("ord").alias("nozzle"), "bbox"))
    ends = runs.select(*SHEET, F.col("ord").alias("run"), F.posexplode(F.array(F.element_at("polyline", 1), F.element_at("polyline", -1))).alias("end", "p"))
    ends = attach_ends(ends, boxes)
    ends = written(ends, "ends")
    members = written(loose_junctions(ends), "junction-members")
    ends = ends.join(members.select(*SHEET, "run", "end", "junction"), [*SHEET, "run", "end"], "left")

    read = texts.filter("resolved").withColumn("c", g.center(F.col("bbox")))
    numbers = read.filter("text_class = 'line_number'").select(*SHEET, "pos", "string", "c")
    numbers = nearest(numbers, runs.select(*SHEET, F.col("ord").alias("run"), "polyline"), SHEET, g.polyline_dist(F.col("c"), F.col("polyline")), "run", ["run"], [*SHEET, "pos", "string"])
    per_run = numbers.groupBy(*SHEET, F.col("run").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "string"))), lambda x: x["string"]).alias("line_numbers"))

    roles = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in TARGETS.items() for x in kv])
    tagging = read.withColumn("roles", roles[F.col("text_class")]).filter("roles IS NOT NULL").select(*SHEET, "pos", F.col("id").alias("text_id"), "string", "text_class", F.col("confidence").alias("text_confidence"), "roles", "c")
    places = terminals.select(*SHEET, F.col("ord").alias("terminal"), "role", F.col("bbox").alias("tb"))
    fits = tagging.join(places, SHEET).filter(F.array_contains("roles", F.col("role")))
    key = [*SHEET, "pos", "text_id", "string", "text_class", "text_confidence"]
    on = fits.groupBy(*key).agg(F.min_by("terminal", F.struct(g.dist(F.col("c"), g.center(F.col("tb"))), "terminal")).alias("terminal"))
    names = on.filter("text_class <> 'opc_direction'").groupBy(*SHEET, F.col("terminal").alias("ord")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "string", "text_id", "text_confidence", "text_class"))).alias("named")
    )
    terminals = terminals.join(names, [*SHEET, "ord"], "left")
    first = F.element_at("named", 1)
    terminals = terminals.withColumns({
        "tag": F.when(F.size("named") > 0, first["string"]), "tag_id": F.when(F.size("named") > 0, first["text_id"]), "tag_confidence": F.when(F.size("named") > 0, first["text_confidence"]),
        "labels": F.when(F.col("role") == CONNECTOR, F.coalesce(F.transform("named", lambda x: x["string"]), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
    })
    problems.append(terminals.filter((F.col("role") != CONNECTOR) & (F.size("named") > 1)).select(*SHEET, F.concat(F.lit("terminal "), "id", F.lit(" is tagged twice")).alias("reason")))
    args = [F.col(c) for c in ("role", "labels", "tag", "id")]
    terminals = terminals.withColumns({
        "node_tag": tx.node_tag(*args), "node_name": tx.node_name(*args), "combined_confidence": F.least("confidence", "tag_confidence"),
        "combined_evidence": tx.combined_evidence(F.col("provenance.evidence"), F.col("tag_id")),
    }).drop("named", "listed")

    # seeds: arrows in order, then direction texts by terminal, text, run and end
    a = arrows.select(*SHEET, "pos", "id", "direction", g.center(F.col("bbox")).alias("c"))
    near = a.join(runs.select(*SHEET, F.col("ord").alias("run"), "polyline"), SHEET).filter(g.polyline_dist(F.col("c"), F.col("polyline")) <= ARROW)
    near = near.withColumn("leg", g.nearest_leg(F.col("c"), F.col("polyline"))).drop("polyline")
    hits = a.join(near.groupBy(*SHEET, "pos").agg(F.count("*").alias("n"), F.first(F.struct("run", "leg")).alias("h")), [*SHEET, "pos"], "left")
    problems.append(hits.filter("coalesce(n, 0) <> 1").select(*SHEET, F.concat(F.lit("flow arrow "), "id", F.lit(" is not on exactly one run")).alias("reason")))
    problems.append(arrows.filter("direction IS NULL").select(*SHEET, F.concat(F.lit("flow arrow "), "id", F.lit(" has no direction")).alias("reason")))
    leg = F.col("h.leg")
    dot = (leg["b"]["x"] - leg["a"]["x"]) * F.col("direction.x") + (leg["b"]["y"] - leg["a"]["y"]) * F.col("direction.y")
    seeds = hits.filter("n = 1 AND direction IS NOT NULL").select(*SHEET, F.col("h.run").alias("run"), _order(F.lit(0), F.col("pos"), F.lit(0), F.lit(0), F.lit(0)), F.when(dot >= 0, "from_to").otherwise("to_from").alias("orientation"), F.lit("arrow").alias("source"), F.col("id").alias("evidence_id"))
    says = on.filter("text_class = 'opc_direction'").withColumn("word", F.upper(F.element_at(F.split(F.trim("string"), r"\s+"), 1)))
    problems.append(says.filter("word NOT IN ('TO', 'FROM')").select(*SHEET, F.concat(F.lit("direction text "), "text_id", F.lit(" starts with neither TO nor FROM")).alias("reason")))
    touch = says.filter("word IN ('TO', 'FROM')").join(ends.select(*SHEET, "terminal", "run", "end"), [*SHEET, "terminal"])
    along = (F.col("end") == 1) == (F.col("word") == "TO")
    seeds = seeds.unionByName(touch.select(*SHEET, "run", _order(F.lit(1), F.col("terminal"), F.col("pos"), F.col("run"), F.col("end")), F.when(along, "from_to").otherwise("to_from").alias("orientation"), F.lit("connector").alias("source"), F.col("text_id").alias("evidence_id")))
    seeds = seeds.withColumn("seq", F.row_number().over(Window.partitionBy(*SHEET, "run").orderBy("o"))).drop("o")
    evidence = written(propagated(seeds, members), "evidence")

    flow = flows(evidence)
    both = ends.groupBy(*SHEET, F.col("run").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("end", "terminal", "nozzle", "junction"))), lambda e: F.struct(e["terminal"].alias("terminal"), e["nozzle"].alias("nozzle"), e["junction"].alias("junction"))).alias("ends"))
    runs = runs.join(both, [*SHEET, "ord"]).join(per_run, [*SHEET, "ord"], "left").join(flow, [*SHEET, "ord"], "left")
    runs = runs.withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    junctions = members.groupBy(*SHEET, "junction").agg(F.first(g.point(F.col("x"), F.col("y"))).alias("point"), F.array_sort(F.collect_list("run")).alias("ords"))
    terminals, runs = written(terminals, "terminals"), written(runs, "runs")
    problems += [] if faults is None else [faults]
    every = written(reduce(DataFrame.unionByName, problems), "problems")
    sound = lambda d: d.join(every.select(*SHEET).distinct(), SHEET, "left_anti")
    return Assembly(sound(terminals), sound(nozzles), sound(runs), sound(junctions), sound(evidence), every)
