"""Key figures of several reviewed runs at once: per document, per profile and overall, on one stated basis."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplan.operators import review
from orthoplan.plans.tables import written
from orthoplan.sources import records


def document_of(run: str | Path) -> str:
    """A run's document: as the manifest of its state says, else its plant model, else its folder."""

    def said(path: str, key: str) -> str | None:
        f = Path(run) / path
        value = json.loads(f.read_text(encoding="utf-8")).get(key) if f.is_file() else None
        return value if isinstance(value, str) and value else None

    return records.document_name(said("state/_manifest.json", "document"), said("plant_model_dexpi.json", "sourceDrawing"), Path(run).resolve().name)


@dataclass
class RunFigures:
    """One run's sheets with their counts, and what its activity log says of anything else."""

    document: str
    folder: str
    idle_minutes: float
    rows: DataFrame
    events: int
    unreadable_lines: int
    minutes_outside: float


def run_figures(bench) -> RunFigures:
    """Of a workbench on a run folder (plans.workbench)."""
    name = document_of(bench.run)
    own = lambda d: d.withColumn("document", F.lit(name))
    found = bench.records()
    sheets = found.select(F.lit(name).alias("document"), "sheet", F.col("profile.name").alias("profile_name"), F.col("profile.version").alias("profile_version"), "readable")
    log = own(bench.events())
    events = log.filter("at IS NOT NULL")
    rows = written(review.sheet_rows(sheets, own(records.detections(found)), bench.verdicts(), events, bench.idle), "kpi-rows")
    n = log.agg(F.count("at").alias("events"), F.count_if(F.col("at").isNull()).alias("bad")).first()
    outside = review.minutes_outside(sheets, events, bench.idle).agg(F.sum("minutes_outside_artifacts")).first()[0]
    return RunFigures(name, str(bench.run), bench.idle, rows, n.events, n.bad, outside or 0.0)


def report(runs: list[RunFigures]) -> dict:
    """The figures of all runs; refused if they were not computed on one basis."""
    basis = sorted({r.idle_minutes for r in runs})
    if len(basis) != 1:
        raise ValueError(f"a report states one idle threshold, these runs have {basis or 'none'}")
    every = reduce(DataFrame.unionByName, [r.rows for r in runs])
    figures = [r.asDict() for r in review.kpi_report(every).collect()]
    at = lambda level: [f for f in figures if f["level"] == level]
    whose = {(r.profile_name, r.profile_version): r.documents for r in every.filter("profile_name IS NOT NULL").groupBy("profile_name", "profile_version").agg(F.array_sort(F.collect_set("document")).alias("documents")).collect()}
    logs = {r.document: {"run": r.folder, "events": r.events, "unreadable_lines": r.unreadable_lines, "minutes_outside_artifacts": r.minutes_outside} for r in runs}
    return {
        "basis": {"idle_threshold_minutes": basis[0]}, "overall": at("overall")[0],
        "documents": [f | logs[f["document"]] for f in sorted(at("document"), key=lambda f: f["document"])],
        "profiles": [f | {"documents": whose[f["profile_name"], f["profile_version"]]} for f in sorted(at("profile"), key=lambda f: (f["profile_name"], f["profile_version"]))],
    }


def display_kpi(value: float | None) -> str:
    """A figure for people; one that cannot be known yet is not a zero."""
    return "not yet measurable" if value is None else f"{value:.1f}"


def summary(r: dict) -> str:
    """The report as text."""

    def lines(title: str, f: dict) -> list[str]:
        return [
            title, f"  corrections per 100 symbols: {display_kpi(f['corrections_per_100_symbols'])} ({f['symbol_corrections']} of {f['symbol_reviewed']} reviewed)",
            f"  minutes per accepted sheet: {display_kpi(f['minutes_per_accepted_sheet'])} ({f['accepted']} of {f['total']} sheets accepted, {f['accepted_timed']} timed)",
        ]

    out = lines(f"overall, breaks from {r['basis']['idle_threshold_minutes']:g} minutes on", r["overall"])
    for f in r["documents"]:
        out += lines(f"document {f['document']} ({f['run']})", f)
    for f in r["profiles"]:
        out += lines(f"profile {f['profile_name']}@{f['profile_version']}: {', '.join(f['documents'])}", f)
    return "\n".join(out)


def of_folders(spark: SparkSession, folders: list[str], idle_minutes: float = review.IDLE_MINUTES) -> dict:
    from orthoplan.plans.workbench import Workbench

    return report([run_figures(Workbench(spark, f, idle_minutes=idle_minutes)) for f in folders])
