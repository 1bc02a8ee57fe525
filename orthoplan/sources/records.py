"""Run folders: detection records, activity logs, verdict stores, artifacts, evaluation sets. Tolerant of bad files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROV = "struct<component:string,evidence:string>"
_BASE = f"id:string,sheet:int,confidence:double,provenance:{_PROV}"
SYMBOL = f"struct<{_BASE},symbol_class:string,bbox:array<double>,direction:array<double>>"
LINE = f"struct<{_BASE},polyline:array<array<double>>,line_class:string>"
TEXT = f"struct<{_BASE},string:string,text_class:string,bbox:array<double>,raw_string:string,correction:string,resolved:boolean,candidates:array<string>>"
RECORD = f"sheet INT, profile STRUCT<name:STRING,version:STRING>, normalization STRING, symbols ARRAY<{SYMBOL}>, lines ARRAY<{LINE}>, texts ARRAY<{TEXT}>, bad STRING"
KINDS = (("symbol", "symbols"), ("line", "lines"), ("text", "texts"))
MODE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}


def numbered(spark: SparkSession, pattern: str, prefix: str = "sheet_") -> DataFrame:
    """Whole files named <prefix><number>.json: run (the folder above), sheet, value. The name is the sheet's identity; other
    files are passed over."""
    parts = F.split("_metadata.file_path", "/")
    d = spark.read.text(pattern, wholetext=True).select("value", F.element_at(parts, -1).alias("name"), F.element_at(parts, -3).alias("run"))
    n = F.regexp_extract("name", rf"^{prefix}(\d+)\.json$", 1)
    return d.filter(n != "").select("run", n.cast("int").alias("sheet"), "value")


def records(spark: SparkSession, pattern: str) -> DataFrame:
    """One row a record: run, sheet, readable, profile, symbols, lines, texts. An unreadable one stays, with nothing in it."""
    d = numbered(spark, pattern).withColumn("r", F.from_json("value", RECORD, MODE))
    r = F.col("r")
    whole = r.isNotNull() & r["bad"].isNull() & r["profile"]["name"].isNotNull() & r["symbols"].isNotNull() & r["lines"].isNotNull() & r["texts"].isNotNull()
    some = lambda c: F.when(F.coalesce(whole, F.lit(False)), c)
    return d.select("run", "sheet", F.coalesce(whole, F.lit(False)).alias("readable"), *[some(r[c]).alias(c) for c in ("profile", "normalization", "symbols", "lines", "texts")])


def detections(rows: DataFrame) -> DataFrame:
    """Records flattened in their order: symbols, lines, texts."""
    out = None
    for k, (kind, part) in enumerate(KINDS):
        d = rows.select(F.col("run").alias("document"), "sheet", F.col("profile.name").alias("profile_name"), F.col("profile.version").alias("profile_version"), F.posexplode(part).alias("pos", "d"))
        d = d.select("document", F.col("sheet"), "profile_name", "profile_version", F.lit(kind).alias("kind"), F.lit(k).alias("kind_ord"), "pos", F.col("d.id").alias("id"), F.col("d.confidence").alias("confidence"), F.to_json("d").alias("detection"))
        out = d if out is None else out.unionByName(d)
    return out


EVENT = "at STRING, event STRING, sheet STRING, bad STRING"


def parsed_events(lines: DataFrame) -> DataFrame:
    """lines(document, line_no, value) -> + at, event, sheet; at is null where the line cannot be read. A time without an offset
    is UTC (the session's zone); blank lines go."""
    d = lines.filter(F.trim("value") != "").withColumn("e", F.from_json("value", EVENT, MODE))
    at = F.to_utc_timestamp(F.try_to_timestamp("e.at"), "UTC")
    whole = F.col("e.bad").isNull() & at.isNotNull() & F.col("e.event").isNotNull() & F.col("e.sheet").rlike(r"^-?\d+$")
    return d.select("document", "line_no", F.when(whole, at).alias("at"), F.when(whole, F.col("e.event")).alias("event"), F.when(whole, F.col("e.sheet").cast("int")).alias("sheet"))


def activity(spark: SparkSession, pattern: str) -> DataFrame:
    """Activity logs (JSON lines), a file a document; a line's place in its file breaks ties in time."""
    d = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("document"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parsed_events(d)


VERDICT = "MAP<STRING, STRUCT<verdict:STRING,kind:STRING,detection:STRING,correction:STRING>>"


def verdicts(spark: SparkSession, pattern: str) -> DataFrame:
    """Verdict stores: <root>/<profile key>/sheet_N.json with an example for each detection id."""
    d = spark.read.text(pattern, wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"sheet_(\d+)\.json$", 1).cast("int").alias("sheet"))
    d = d.withColumn("s", F.from_json("value", f"profile STRUCT<name:STRING,version:STRING>, examples {VERDICT}"))
    return d.filter("sheet IS NOT NULL").select("sheet", F.col("s.profile.name").alias("profile_name"), F.col("s.profile.version").alias("profile_version"), F.explode("s.examples").alias("detection_id", "e")).select("*", "e.*").drop("e").withColumn("seq", F.lit(0))


ARTIFACT = "page INT, nodes ARRAY<STRUCT<id:BIGINT,kind:STRING,xy:ARRAY<DOUBLE>,tag:STRING,full_tag:STRING,shape:STRING,subclass:STRING,bbox:ARRAY<DOUBLE>,labels:ARRAY<STRING>,equipment:INT>>, edges ARRAY<STRUCT<a:BIGINT,b:BIGINT,style:STRING,points:ARRAY<ARRAY<DOUBLE>>,line_numbers:ARRAY<STRING>,direction:STRING,direction_source:STRING>>, direction_stats MAP<STRING,INT>, bad STRING"


def artifacts(spark: SparkSession, pattern: str) -> DataFrame:
    """Topology artifacts in page order: page, nodes, edges, error (what is missing)."""
    d = numbered(spark, pattern, "topology_page").withColumn("a", F.from_json("value", ARTIFACT, MODE))
    keys = F.array(*[F.when(F.col(f"a.{k}").isNull(), F.lit(k)) for k in ("page", "nodes", "edges", "direction_stats")])
    missing = F.array_join(F.array_compact(keys), ", ")
    return d.select(F.col("sheet").alias("page"), "a.nodes", "a.edges", F.when(F.col("a.bad").isNotNull(), "not JSON").when(missing != "", F.concat(F.lit("missing "), missing)).alias("error"))


def exploded(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of sound artifacts."""
    ok = found.filter("error IS NULL")
    return tuple(ok.select("page", F.posexplode(c).alias("pos", "x")).select("page", "pos", "x.*") for c in ("nodes", "edges"))


def document_name(manifest: str | None, source: str | None, folder: str) -> str:
    """A run's document: as its manifest says, else its plant model, else its folder."""
    return manifest or source or folder
