"""From sheets to a plant model: one Python pass over each sheet's pixels, then joins; and the resumable run of it."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplan.functions import geometry as g
from orthoplan.operators import batch, lexicon, plant
from orthoplan.operators.assembly import SHEET, Assembly, assembled
from orthoplan.operators.raster import detector, lines, normalize, ocr, png
from orthoplan.plans.tables import written
from orthoplan.sources import annotations, bundles, sinks
from orthoplan.sources import records as records_source
from orthoplan.sources.profile import Profile

DETECTORS, READERS, STORES = ("stub", "trained", "legend-nn"), ("stub", "rapidocr", "tesseract", "easyocr", "apple-vision"), ("cypher-script", "neo4j")
PLAIN = ("stub", "cypher-script")


def chosen(spec: str, names: tuple[str, ...], what: str) -> tuple[str, str | None]:
    """`name` or `name:options`, refused by name."""
    name, _, options = spec.partition(":")
    if name not in names:
        raise ValueError(f"a {what} is one of {list(names)}, got {spec!r}")
    return name, options or None


@dataclass
class Config:
    detector: str = "stub"
    reader: str = "stub"
    store: str = "cypher-script"

    def __post_init__(self):
        for spec, names, what in ((self.detector, DETECTORS, "detector"), (self.reader, READERS, "reader"), (self.store, STORES, "store")):
            name, options = chosen(spec, names, what)
            if options and name in PLAIN:
                raise ValueError(f"the {what} {name!r} takes no options, got {options!r}")


def parsed(spec: str) -> Config:
    """`detector=stub,reader=rapidocr:a=1,b=2`: a comma separates settings only before a setting's name."""
    import re

    out = {}
    for part in re.split(r",(?=(?:detector|reader|store)=)", spec) if spec else []:
        key, eq, value = part.partition("=")
        if not eq or key not in Config.__dataclass_fields__:
            raise ValueError(f"a setting is detector=, reader= or store=, got {part!r}")
        out[key] = value
    return Config(**out)


@dataclass
class Run:
    normalized: DataFrame
    symbols: DataFrame
    lines: DataFrame
    texts: DataFrame
    assembly: Assembly
    nodes: DataFrame
    edges: DataFrame


def in_normalized_frame(sheets: DataFrame, norm: DataFrame) -> DataFrame:
    """Annotations moved with their sheets."""
    d = sheets.drop("width", "height", "raster").join(norm, SHEET)
    n = F.col("normalization")
    to = lambda p: g.to_normalized(p, n)
    turn = lambda v: F.when(v.isNotNull(), g.rotated(v, -n["angle_degrees"], g.point(F.lit(0), F.lit(0))))
    a = F.col("annotations")
    moved = F.struct(
        F.transform(a["symbols"], lambda s: F.struct(s["symbol_class"].alias("symbol_class"), g.mapped_box(s["bbox"], to).alias("bbox"), turn(s["direction"]).alias("direction"))).alias("symbols"),
        F.transform(a["lines"], lambda s: F.struct(F.transform(s["polyline"], to).alias("polyline"), s["line_class"].alias("line_class"))).alias("lines"),
        F.transform(a["texts"], lambda s: F.struct(s["string"].alias("string"), s["text_class"].alias("text_class"), g.mapped_box(s["bbox"], to).alias("bbox"))).alias("texts"),
    )
    return d.withColumn("annotations", F.when(a.isNotNull(), moved))


def in_original_frame(d: DataFrame, norm: DataFrame) -> DataFrame:
    """Detections back on the sheet as it was scanned."""
    d = d.join(norm.select(*SHEET, "normalization"), SHEET)
    n = F.col("normalization")
    to = lambda p: g.to_original(p, n)
    if "bbox" in d.columns:
        d = d.withColumn("bbox", g.mapped_box(F.col("bbox"), to))
    if "polyline" in d.columns:
        d = d.withColumn("polyline", F.transform("polyline", to))
    if "direction" in d.columns:
        d = d.withColumn("direction", F.when(F.col("direction").isNotNull(), g.rotated(F.col("direction"), n["angle_degrees"], g.point(F.lit(0), F.lit(0)))))
    return d.drop("normalization")


def model_of(config: Config, profile: Profile, prototypes: list | None = None) -> bundles.Model | None:
    """What the chosen detector matches with: loaded and verified, or the prototypes given; none for the stub."""
    kind, folder = chosen(config.detector, DETECTORS, "detector")
    if kind == "stub":
        return None
    if prototypes and not folder:
        return bundles.Model(prototypes, f"symbol_detector:{kind}", kind == "legend-nn")
    return (bundles.trained if kind == "trained" else bundles.legend)(folder, profile.identity())


def digitized(sheets: DataFrame, profile: Profile, prototypes: list | None = None, read=None, config: Config | None = None) -> Run:
    """sheets(document, sheet, width, height, raster, annotations). Rasters are read in one pass each; everything after that is
    relational and keyed by sheet. A sheet that cannot be read is a problem of the assembly, with its reason, and costs
    nothing but itself. prototypes and read stand in for a detector's artifact and a reader's engine."""
    config = config or Config()
    spark = sheets.sparkSession
    model = model_of(config, profile, prototypes)
    kind, options = chosen(config.reader, READERS, "reader")
    options = ocr.options(options)
    if kind != "stub" and read is None:
        ocr.engine(kind)  # refused here, not in every task
    legend = profile.legend_table(spark)
    norm = written(normalize.normalized_sheets(sheets), "normalized")
    moved = in_normalized_frame(sheets, norm)
    symbols = annotations.symbols(moved) if model is None else detector.detections(norm, model.prototypes, model.component, model.legend)
    symbols = written(symbols, "symbols")
    found = written(lines.line_network(norm, symbols.filter("pos >= 0"), legend, profile.line_styles), "lines")
    if kind == "stub":
        texts = annotations.texts(moved)
    else:
        raw = ocr.recognized(norm, read or kind, profile.tag_grammar, kind, **options)
        texts = raw.withColumns({"raw_string": F.lit(None).cast("string"), "correction": F.lit(None).cast("string")})
    texts = written(texts, "read-texts")
    faults = [d.filter("pos < 0").select(*SHEET, F.col("provenance.evidence").alias("reason")) for d in (symbols, found, texts)]
    faults += [annotations.missing(sheets)] if model is None or kind == "stub" else []
    texts = written(lexicon.decoded(texts.filter("pos >= 0"), profile.tag_grammar), "texts")
    faults = written(reduce(DataFrame.unionByName, faults).distinct(), "faults")
    without = lambda d, bad: d.join(bad.select(*SHEET).distinct(), SHEET, "left_anti")
    s, n, t = (without(in_original_frame(d.filter("pos >= 0"), norm), faults) for d in (symbols, found, texts))
    a = assembled(s, n, t, legend, faults)
    s, n, t = (without(d, a.problems) for d in (s, n, t))
    return Run(norm, s, n, t, a, plant.nodes(a), plant.edges(a))


def listed(d: DataFrame, name: str) -> DataFrame:
    rest = [c for c in d.columns if c not in SHEET]
    return d.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias(name))


def records(run: Run, profile: Profile) -> DataFrame:
    """One nested record a digitized sheet, detections in their order."""
    done = run.normalized.join(run.assembly.problems.select(*SHEET).distinct(), SHEET, "left_anti")
    out = done.select(*SHEET, "normalization", F.struct(F.lit(profile.name).alias("name"), F.lit(profile.version).alias("version")).alias("profile"))
    for d, name in ((run.symbols, "symbols"), (run.lines, "lines"), (run.texts, "texts")):
        out = out.join(listed(d, name), SHEET, "left")
    return out


def record_files(run: Run, profile: Profile) -> DataFrame:
    """document, sheet, json: each record as the record reader expects it."""
    box = lambda b: F.when(b.isNotNull(), F.array(*[b[c] for c in ("x0", "y0", "x1", "y1")]))
    xy = lambda p: F.when(p.isNotNull(), F.array(p["x"], p["y"]))
    base = lambda r: [r["id"].alias("id"), F.col("sheet"), r["confidence"].alias("confidence"), r["provenance"].alias("provenance")]
    none = F.array().cast("array<string>")
    r = records(run, profile)
    parts = {
        "symbols": lambda x: F.struct(*base(x), x["symbol_class"].alias("symbol_class"), box(x["bbox"]).alias("bbox"), xy(x["direction"]).alias("direction")),
        "lines": lambda x: F.struct(*base(x), F.transform(x["polyline"], xy).alias("polyline"), x["line_class"].alias("line_class")),
        "texts": lambda x: F.struct(*base(x), x["string"].alias("string"), x["text_class"].alias("text_class"), box(x["bbox"]).alias("bbox"), x["raw_string"].alias("raw_string"), x["correction"].alias("correction"), x["resolved"].alias("resolved"), F.coalesce(x["candidates"], none).alias("candidates")),
    }
    text = F.to_json(F.struct("sheet", "profile", "normalization", *[F.transform(k, f).alias(k) for k, f in parts.items()]))
    for k in parts:  # a part without rows is null, which to_json leaves out
        text = F.when(F.col(k).isNull(), F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(f',"{k}":[]}}'))).otherwise(text)
    return r.select(*SHEET, text.alias("json"))


def put_files(files: DataFrame, folder: str) -> None:
    """files(path, content binary) -> files under folder, written by the executors that hold them: a shared folder."""

    def write(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for r in rows:
            path = f"{root}/{r.path}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path + ".tmp") as out:
                out.write(bytes(r.content))
            store.move(path + ".tmp", path)

    files.select("path", "content").foreachPartition(write)


def from_records(found: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readable records (sources.records) -> symbols, lines, texts as they were detected."""
    point = lambda a: F.when(F.size(a) == 2, F.struct(a[0].alias("x"), a[1].alias("y")))
    box = F.when(F.size("bbox") == 4, F.struct(*[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]))

    def flat(part: str) -> DataFrame:
        d = found.filter("readable").select(F.lit(document).alias("document"), F.col("sheet").alias("number"), F.posexplode(part).alias("pos", "d")).select("document", "number", "pos", "d.*")
        return d.drop("sheet").withColumnRenamed("number", "sheet")

    symbols = flat("symbols").withColumn("bbox", box).withColumn("direction", point(F.col("direction")))
    runs = flat("lines").withColumn("polyline", F.transform("polyline", point))
    return symbols, runs, flat("texts").withColumn("bbox", box)


def put_outputs(run: Run, sheets: DataFrame, profile: Profile, document: str, out: str) -> dict:
    """What a run leaves behind: detections/sheet_N.json, sheets/sheet_N.png, the plant model and the load script.

    Model and script are built from all records of the folder, so a run in several goes ends as one without a stop does.
    """
    uri = out if "://" in out else f"file://{os.path.abspath(out)}"
    name = lambda folder, kind: F.concat(F.lit(f"{folder}/sheet_"), F.col("sheet").cast("string"), F.lit(kind)).alias("path")
    put_files(record_files(run, profile).select(name("detections", ".json"), F.encode("json", "UTF-8").alias("content")), uri)
    done = sheets.join(run.assembly.problems.select(*SHEET).distinct(), SHEET, "left_anti").filter("raster IS NOT NULL").select(*SHEET, "width", "height", "raster")
    put_files(png.encoded(done).select(name("sheets", ".png"), F.col("png").alias("content")), uri)
    found = records_source.records(sheets.sparkSession, f"{uri}/detections/*")
    whole = assembled(*from_records(found, document), profile.legend_table(sheets.sparkSession))
    sinks.put_json(f"{out}/plant_model_dexpi.json", plant.plant_model(whole, document, profile.identity(), profile.line_semantics))
    return sinks.put_script(f"{out}/plant_graph.cypher", plant.nodes(whole), plant.edges(whole))


STATE = "document string, sheet int, status string, reason string"


def _shared_file(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def kept_manifest(spark, state_path: str) -> dict | None:
    """The manifest that the state at a path was begun with."""
    store, p = _shared_file(spark, f"{state_path}/_manifest.json")
    if not store.exists(p):
        return None
    return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(store.open(p), "UTF-8"))


def resumed(sheets: DataFrame, state_path: str, profile: Profile, config: Config | None = None, found_manifest: dict | None = None, **seams) -> tuple[Run, DataFrame]:
    """Digitizes what has no succeeded state yet, appends the outcome to the state table, and reports the coverage.

    State belongs to one document, profile and configuration: its manifest is written first and compared ever after
    (found_manifest: in place of the kept one). A sheet's own faults fail that sheet alone; it is tried again next time.
    """
    spark = sheets.sparkSession
    numbers = sheets.select(*SHEET).orderBy(*SHEET).collect()  # a drawing package has some hundred sheets
    now = batch.manifest(", ".join(sorted({r.document for r in numbers})), [r.sheet for r in numbers], asdict(profile), asdict(config or Config()))
    found = found_manifest if found_manifest is not None else kept_manifest(spark, state_path)
    batch.check_manifest(found, now)
    store, path = _shared_file(spark, state_path)
    if found is None:
        begun = store.create(_shared_file(spark, f"{state_path}/_manifest.json")[1])
        begun.write(json.dumps(now, ensure_ascii=False).encode())
        begun.close()
    tables = store.exists(path) and any(not f.getPath().getName().startswith(("_", ".")) for f in store.listStatus(path))
    state = spark.read.schema(STATE).parquet(state_path) if tables else spark.createDataFrame([], STATE)
    done = written(state.filter("status = 'succeeded'").select(*SHEET).distinct(), "done")
    todo = sheets.join(done, SHEET, "left_anti")
    run = digitized(todo, profile, config=config, **seams)
    why = run.assembly.problems.groupBy(*SHEET).agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    outcome = written(todo.select(*SHEET).join(why, SHEET, "left").select(*SHEET, F.when(F.col("reason").isNull(), "succeeded").otherwise("failed").alias("status"), "reason"), "outcome")
    outcome.write.mode("append").parquet(state_path)
    return run, batch.coverage(sheets, outcome.select(*SHEET, "status").unionByName(done.withColumn("status", F.lit("succeeded"))), done)


def run_report(run: Run, coverage: DataFrame, profile: Profile, threshold: float = batch.LOW_CONFIDENCE) -> dict:
    """Coverage, failures with their reasons, and the gaps that a reviewer should see first."""
    found = batch.gaps(*[d.select(*SHEET, "pos", "id", "confidence", *extra) for d, extra in ((run.texts, ["resolved"]), (run.symbols, []), (run.lines, []))], threshold)
    return {
        "profile": profile.identity(), "low_confidence_threshold": threshold, "coverage": [r.asDict() for r in coverage.orderBy("document").collect()],
        "failures": [r.asDict() for r in run.assembly.problems.distinct().orderBy(*SHEET, "reason").toLocalIterator()],
        "gaps": [{"document": r.document, "sheet": r.sheet, "id": r.id, "kind": r.kind, "confidence": r.confidence} for r in found.orderBy(*SHEET, "section", "pos").toLocalIterator()],
    }
