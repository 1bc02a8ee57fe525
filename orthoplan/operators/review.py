"""Review: latest verdicts, states, queues, minutes and key figures.

detections(document, sheet, profile_name, profile_version, id, kind, kind_ord, pos, confidence)
verdicts(profile_name, profile_version, sheet, detection_id, verdict, kind, seq, ...)
events(document, at TIMESTAMP, line_no, event, sheet)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE_MINUTES = 10.0
KINDS = ("symbol", "line", "text")
VERDICTS = ("pass", "reject", "edit")


def review_state(decided: Column, total: Column) -> Column:
    return F.when(decided == total, "reviewed").when(decided == 0, "untouched").otherwise("in progress")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. One aggregate with map-side combine; nothing is sorted."""
    rest = [c for c in log.columns if c not in keys]
    rank = F.struct(*order)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def latest_verdicts(log: DataFrame) -> DataFrame:
    return latest(log, ["profile_name", "profile_version", "sheet", "detection_id"], ["seq"])


#: Least length of a stretch of a timeline that one task sorts.
STRETCH_MINUTES = 60.0


def stretched(events: DataFrame, idle_minutes: float) -> tuple[DataFrame, int]:
    """+ stretch: the number of the fixed stretch of time that the event falls in. A stretch is never shorter than a break, so
    the event behind a stretch's last one, if no break lies between them, is the first of the next stretch. A timeline is
    thus sorted stretch by stretch, however long it is."""
    idle = int(idle_minutes * 60_000_000)
    length = max(int(STRETCH_MINUTES * 60_000_000), idle)
    return events.withColumn("stretch", F.floor(F.unix_micros("at") / F.lit(length)).cast("long")), idle


def intervals(events: DataFrame, by: list[str], idle_minutes: float = IDLE_MINUTES) -> DataFrame:
    """+ micros: time to the timeline's (by) next event, null after a break or the last event."""
    e, idle = stretched(events, idle_minutes)
    first = e.groupBy(*by, (F.col("stretch") - 1).alias("stretch")).agg(F.min("at").alias("beyond"))
    e = e.join(first, [*by, "stretch"], "left")
    w = Window.partitionBy(*by, "stretch").orderBy("at", "line_no")
    gap = F.unix_micros(F.coalesce(F.lead("at").over(w), F.col("beyond"))) - F.unix_micros("at")
    return e.withColumn("micros", F.when(gap <= F.lit(idle), gap)).drop("stretch", "beyond")


def attribute_minutes(events: DataFrame, by: list[str] | None = None, idle_minutes: float = IDLE_MINUTES) -> DataFrame:
    """Minutes of each sheet: an interval up to the next event anywhere on the timeline goes to the sheet that opened it.

    Whole microseconds are summed and divided once, so the order of summing does not matter.
    """
    by = ["document"] if by is None else by
    kept = intervals(events, by, idle_minutes).filter("micros IS NOT NULL")
    return kept.groupBy(*by, "sheet").agg((F.sum("micros") / F.lit(60_000_000.0)).alias("minutes"))


def timed_sheets(events: DataFrame) -> DataFrame:
    return events.filter("event = 'verdict'").select("document", "sheet").distinct()


def sessions(events: DataFrame, by: list[str], idle_minutes: float = IDLE_MINUTES) -> DataFrame:
    """+ session: number of the stretch without a break, from 0. Breaks are counted stretch by stretch; the sums of the
    stretches before, one row each, are added."""
    e, idle = stretched(events, idle_minutes)
    w = Window.partitionBy(*by, "stretch").orderBy("at", "line_no")
    e = e.withColumn("new", F.when(F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > F.lit(idle), 1).otherwise(0))
    whole = e.groupBy(*by, "stretch").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("new").alias("inner"))
    line = Window.partitionBy(*by).orderBy("stretch")
    rest = F.unix_micros("first") - F.unix_micros(F.lag("last").over(line))
    whole = whole.withColumn("opens", F.when(rest > F.lit(idle), 1).otherwise(0))
    before = F.sum(F.col("opens") + F.col("inner")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inner")
    e = e.join(whole.select(*by, "stretch", before.alias("before")), [*by, "stretch"])
    return e.withColumn("session", F.col("before") + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("stretch", "new", "before")


def judged(detections: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Detections with their latest verdict, if any; verdicts on detections that the records do not hold fall out here."""
    v = latest_verdicts(verdicts).select("profile_name", "profile_version", "sheet", F.col("detection_id").alias("id"), "verdict", F.col("kind").alias("verdict_kind"))
    return detections.join(v, ["profile_name", "profile_version", "sheet", "id"], "left")


def refused(j: DataFrame) -> DataFrame:
    """Judged rows whose stored kind or verdict the contract does not know."""
    return j.filter(F.col("verdict").isNotNull() & ~(F.col("verdict").isin(*VERDICTS) & F.coalesce(F.col("verdict_kind").isin(*KINDS), F.lit(False))))


def stale(detections: DataFrame, verdicts: DataFrame) -> DataFrame:
    keys = ["profile_name", "profile_version", "sheet"]
    return latest_verdicts(verdicts).join(detections.select(*keys, F.col("id").alias("detection_id")), [*keys, "detection_id"], "left_anti")


def queue(detections: DataFrame, verdicts: DataFrame, kind: str | None = None) -> DataFrame:
    """Undecided detections, least confident first, then in record order."""
    keys = ["profile_name", "profile_version", "sheet"]
    v = verdicts.select(*keys, F.col("detection_id").alias("id"))
    d = detections.filter(F.col("kind") == kind) if kind else detections
    left = d.join(v, [*keys, "id"], "left_anti")
    w = Window.partitionBy("document", "sheet").orderBy("confidence", "kind_ord", "pos")
    return left.withColumn("rank", F.row_number().over(w))


def _counts(kind: str) -> list[Column]:
    of = F.col("verdict_kind") == kind
    out = [F.count_if(of).alias(f"{kind}_reviewed")]
    out += [F.count_if(of & (F.col("verdict") == v)).alias(f"{kind}_{v}") for v in VERDICTS]
    return [*out, F.count_if(of & F.col("verdict").isin("reject", "edit")).alias(f"{kind}_corrections")]


COUNTS = [f"{k}_{c}" for k in KINDS for c in ("reviewed", *VERDICTS, "corrections")]


def sheet_rows(sheets: DataFrame, detections: DataFrame, verdicts: DataFrame, events: DataFrame, idle_minutes: float = IDLE_MINUTES) -> DataFrame:
    """One row a sheet. sheets(document, sheet, profile_name, profile_version, readable): every record, unreadable ones with
    a null profile."""
    j = judged(detections, verdicts)
    per = j.groupBy("document", "sheet").agg(F.count("*").alias("detections"), F.count("verdict").alias("decided"), *[c for k in KINDS for c in _counts(k)])
    rows = sheets.join(per, ["document", "sheet"], "left").join(attribute_minutes(events, idle_minutes=idle_minutes), ["document", "sheet"], "left")
    rows = rows.join(timed_sheets(events).withColumn("timed", F.lit(True)), ["document", "sheet"], "left")
    rows = rows.fillna(0, ["decided", "minutes", *COUNTS]).withColumn("timed", F.coalesce("timed", F.lit(False)))
    rows = rows.withColumn("detections", F.when(F.col("readable"), F.coalesce("detections", F.lit(0))))
    return rows.withColumn("accepted", F.coalesce((F.col("detections") > 0) & (F.col("decided") == F.col("detections")), F.lit(False)))


def metrics() -> list[Column]:
    """Aggregates over sheet rows: the same for a document, a profile and everything."""
    on_timed = F.col("accepted") & F.col("timed")
    sums = [F.sum(c).alias(c) for c in COUNTS]
    return [
        F.try_divide(F.lit(100.0) * F.sum("symbol_corrections"), F.sum("symbol_reviewed")).alias("corrections_per_100_symbols"),
        F.try_divide(F.sum(F.when(on_timed, F.col("minutes"))), F.count_if(on_timed)).alias("minutes_per_accepted_sheet"),
        F.count("*").alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(on_timed).alias("accepted_timed"),
        F.count_if(F.col("accepted") & ~F.col("timed")).alias("accepted_untimed"), F.count_if(F.col("detections").isNull()).alias("unreadable"),
        F.sum("minutes").alias("minutes_total"), F.coalesce(F.sum(F.when(on_timed, F.col("minutes"))), F.lit(0.0)).alias("minutes_on_timed_accepted"), *sums,
    ]


def kpi_report(rows: DataFrame) -> DataFrame:
    """Key figures per document, per profile (readable sheets only) and overall, in one pass of grouping sets."""
    sets = rows.groupingSets([["document"], ["profile_name", "profile_version"], []], "document", "profile_name", "profile_version")
    out = sets.agg(F.grouping_id().alias("g"), *metrics())
    level = F.when(F.col("g") == 3, "document").when(F.col("g") == 4, "profile").otherwise("overall")
    return out.withColumn("level", level).filter("level <> 'profile' OR profile_name IS NOT NULL").drop("g")


def minutes_outside(sheets: DataFrame, events: DataFrame, idle_minutes: float = IDLE_MINUTES) -> DataFrame:
    """Per document: minutes on sheets that it has no record of."""
    m = attribute_minutes(events, idle_minutes=idle_minutes).join(sheets.select("document", "sheet"), ["document", "sheet"], "left_anti")
    return m.groupBy("document").agg(F.sum("minutes").alias("minutes_outside_artifacts"))


def supervised_labels(verdicts: DataFrame) -> DataFrame:
    """What a verdict says is true: the detection as passed, or as corrected; rejected ones have no label.

    verdicts: detection and correction are structs with (some of) bbox, polyline, string.
    """
    fields = [f for f in ("bbox", "polyline", "string") if f in verdicts.schema["correction"].dataType.names]
    fixed = [F.when(F.col("verdict") == "edit", F.coalesce(F.col(f"correction.{f}"), F.col(f"detection.{f}"))).otherwise(F.col(f"detection.{f}")).alias(f) for f in fields]
    return verdicts.withColumn("label", F.when(F.col("verdict") != "reject", F.struct(*fixed)))


def example_problem(kinds: Column, verdict: Column, bbox: Column, polyline: Column, string: Column, corrected: Column) -> Column:
    """Why a verdict may not be stored, or null. corrected: whether a correction came with it."""
    finite = lambda xs: F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), "unknown verdict")
        .when(~F.coalesce(kinds.isin(*KINDS), F.lit(False)), "unknown kind")
        .when((verdict != "edit") & corrected, "only an edit carries a correction")
        .when((verdict == "edit") & ~corrected, "an edit needs a correction")
        .when(bbox.isNotNull() & ((kinds == "line") | (F.size(bbox) != 4) | ~finite(bbox)), "bbox is four finite numbers of a symbol or text")
        .when(polyline.isNotNull() & ((kinds != "line") | (F.size(polyline) < 2) | ~F.forall(polyline, lambda p: (F.size(p) == 2) & finite(p))), "polyline is at least two finite points of a line")
        .when(string.isNotNull() & (kinds != "text"), "string belongs to a text")
    )


def training_examples(verdicts: DataFrame, source: str | None = None) -> DataFrame:
    """The latest verdicts as training examples, in the export's order (rank)."""
    sort = F.when(F.col("verdict") == "pass", "positive").when(F.col("verdict") == "reject", "negative").otherwise("corrected")
    w = Window.partitionBy("profile_name", "profile_version").orderBy("sheet", "detection_id")
    return latest_verdicts(verdicts).withColumn("example", sort).withColumn("source", F.lit(source).cast("string")).withColumn("rank", F.row_number().over(w))
