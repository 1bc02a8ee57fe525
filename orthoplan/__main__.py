"""python -m orthoplan <command>: the same functions from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="orthoplan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    d = command("digitize", "pdf", "profile", "out")
    d.add_argument("--config", default="")
    d.add_argument("--state")
    command("evaluate", "root", "profile").add_argument("--config", action="append", default=[])
    k = sub.add_parser("kpi")
    k.add_argument("runs", nargs="+")
    k.add_argument("--idle-minutes", type=float, default=10.0)
    k.add_argument("--text", action="store_true")
    t = command("train", "profile", "out")
    t.add_argument("roots", nargs="+")
    f = command("labels", "artifacts", "spans", "rasters", "profile", "out")
    f.add_argument("--dpi", type=int, default=150)
    f.add_argument("--variants", help="a JSON file of degradations")
    o = command("ocr-set", "out")
    o.add_argument("--sheets", type=int, default=12)
    o.add_argument("--seed", default="0")
    command("export", "run", "name", "version", "out")
    command("workbench", "run").add_argument("--port", type=int, default=8765)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "digitize":
        from orthoplan.plans import digitize
        from orthoplan.sources import pdf, profile, sinks
        from orthoplan.sources.annotations import ANNOTATIONS

        who, config = profile.load(a.profile), digitize.parsed(a.config)
        sheets = pdf.load(spark, a.pdf).withColumn("annotations", F.lit(None).cast(ANNOTATIONS))
        run, coverage = digitize.resumed(sheets, a.state or f"{a.out}/state", who, config)
        stored = digitize.put_outputs(run, sheets, who, a.pdf.rsplit("/", 1)[-1], a.out)
        report = digitize.run_report(run, coverage, who)
        sinks.put_json(f"{a.out}/run_report.json", report)
        print(json.dumps(stored | {"coverage": report["coverage"], "failures": report["failures"]}))
    elif a.command == "evaluate":
        from orthoplan.plans import digitize, evaluation
        from orthoplan.sources import profile

        who = profile.load(a.profile)
        truth = evaluation.EvalSet(spark, a.root, who)
        configs = [digitize.parsed(c) for c in a.config or [""]]
        reports = [evaluation.gate_report(truth, who, c) for c in configs]
        print(json.dumps(reports if len(reports) > 1 else reports[0], indent=1))
        return 0 if all(r["passed"] for r in reports) else 1
    elif a.command == "kpi":
        from orthoplan.plans import kpi

        found = kpi.of_folders(spark, a.runs, a.idle_minutes)
        print(kpi.summary(found) if a.text else json.dumps(found, indent=1))
    elif a.command == "train":
        from orthoplan.plans import training
        from orthoplan.sources import profile

        print(json.dumps(training.train(spark, a.roots, profile.load(a.profile), a.out)))
    elif a.command == "labels":
        from orthoplan.operators.raster import degrade
        from orthoplan.plans import factory
        from orthoplan.sources import profile

        made = factory.labels(spark, a.artifacts, spark.read.json(a.spans, "page int, pos int, string string, bbox array<double>"), dpi=a.dpi)
        rasters, who = spark.read.parquet(a.rasters), profile.load(a.profile).identity()
        print(json.dumps(factory.put(a.out, who, made, rasters) | {"errors": [r.asDict() for r in made["errors"].collect()]}))
        if a.variants:
            with open(a.variants, encoding="utf-8") as v:
                size = rasters.agg(F.max("width").alias("w"), F.max("height").alias("h")).first()
                print(json.dumps(factory.put_variants(a.out, who, made, rasters, degrade.variants(v.read()), size.w, size.h)))
    elif a.command == "ocr-set":
        from orthoplan.plans import ocr_set

        print(json.dumps(ocr_set.put(a.out, a.sheets, a.seed)))
    else:
        from orthoplan.plans.workbench import Workbench, server
        from orthoplan.sources import sinks

        bench = Workbench(spark, a.run)
        if a.command == "export":
            print(json.dumps(sinks.put_training_set(a.out, bench.verdicts(), {"name": a.name, "version": a.version})))
        else:
            server(bench, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
