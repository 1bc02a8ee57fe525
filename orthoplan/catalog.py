"""The registry: each operator applied to a domain-shaped view of the driver tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoplan.functions import geometry as g
from orthoplan.functions import text as tx
from orthoplan.operators import assembly, evaluate, graph, lexicon, plant, review
from orthoplan.plans import fixture
from orthoplan.sources import annotations, records

FLAGSHIP = "attribute_minutes"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- review -----------------------------------------------------------------


def log(spark, d) -> DataFrame:
    """events as one activity log: users are sheets, purchases are verdicts."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "verdict").otherwise(F.col("event_type"))
    return e.select(F.lit("doc").alias("document"), F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("at"), F.col("event_id").alias("line_no"), F.col("user_id").alias("sheet"), kind.alias("event"), "value", "props")


GAPS = "SELECT user_id AS sheet, epoch_us(lead(ts) OVER (ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events"


@query(f"SELECT sheet, sum(gap) / 60000000.0::DOUBLE AS minutes FROM ({GAPS}) WHERE gap <= 600000000 GROUP BY sheet")
def attribute_minutes(spark, d):
    return review.attribute_minutes(log(spark, d)).drop("document")


@query("SELECT DISTINCT user_id AS sheet FROM events WHERE event_type = 'purchase'")
def timed_sheets(spark, d):
    return review.timed_sheets(log(spark, d)).select("sheet")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_verdict(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return review.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT user_id, session, count(*) AS events, min(event_id) AS first_event FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
    SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 600000000 THEN 1 ELSE 0 END AS new FROM events))
GROUP BY user_id, session
""")
def idle_sessions(spark, d):
    s = review.sessions(log(spark, d), ["document", "sheet"])
    return s.groupBy(F.col("sheet").alias("user_id"), "session").agg(F.count("*").alias("events"), F.min("line_no").alias("first_event"))


@query("SELECT count(*) AS lines, count(*) FILTER (event_id % 10 <> 0) AS readable, CAST(sum(CASE WHEN event_id % 10 <> 0 THEN user_id END) AS BIGINT) AS sheets, count(DISTINCT CASE WHEN event_id % 10 <> 0 THEN ts END) AS times FROM events")
def unreadable_events(spark, d):
    """events as lines of an activity log, every tenth one torn."""
    e = table(spark, d, "events")
    at = F.date_format(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.to_json(F.struct(at.alias("at"), F.col("event_type").alias("event"), F.col("user_id").alias("sheet")))
    torn = F.when(F.col("event_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    p = records.parsed_events(e.select(F.lit("doc").alias("document"), F.col("event_id").alias("line_no"), torn.alias("value")))
    return p.agg(F.count("*").alias("lines"), F.count("at").alias("readable"), F.sum(F.col("sheet").cast("long")).alias("sheets"), F.count_distinct("at").alias("times"))


def detections(spark, d) -> DataFrame:
    """documents as detections: sources are sheets, languages are kinds."""
    k = F.when(F.col("lang") == "en", "symbol").when(F.col("lang") == "fr", "line").otherwise("text")
    doc = table(spark, d, "documents")
    return doc.select(F.lit("doc").alias("document"), F.col("source").alias("sheet"), F.lit("p").alias("profile_name"), F.lit("0").alias("profile_version"), F.col("doc_id").alias("id"), k.alias("kind"), F.lit(0).alias("kind_ord"), F.col("doc_id").alias("pos"), F.col("n_chars").cast("double").alias("confidence"), "n_chars")


def verdicts(spark, d) -> DataFrame:
    lab = table(spark, d, "labels").join(detections(spark, d).select("profile_name", "profile_version", "sheet", "kind", F.col("id").alias("doc_id")), "doc_id")
    v = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "edit").otherwise("pass")
    return lab.select("profile_name", "profile_version", "sheet", F.col("doc_id").alias("detection_id"), v.alias("verdict"), "kind", F.lit(1).alias("seq"))


KIND = "CASE lang WHEN 'en' THEN 'symbol' WHEN 'fr' THEN 'line' ELSE 'text' END"
VERDICT = "CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'edit' ELSE 'pass' END"


@query("""
SELECT source, total, decided, CASE WHEN decided = total THEN 'reviewed' WHEN decided = 0 THEN 'untouched' ELSE 'in progress' END AS state
FROM (SELECT source, count(*) AS total, count(l.doc_id) AS decided FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
""")
def review_state(spark, d):
    n = review.judged(detections(spark, d), verdicts(spark, d)).groupBy(F.col("sheet").alias("source")).agg(F.count("*").alias("total"), F.count("verdict").alias("decided"))
    return n.withColumn("state", review.review_state(F.col("decided"), F.col("total")))


@query("""
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def review_queue(spark, d):
    return review.queue(detections(spark, d), verdicts(spark, d)).select(F.col("id").alias("doc_id"), F.col("sheet").alias("source"), F.col("rank").cast("long").alias("rank"))


@query(f"""
SELECT {KIND} AS kind, count(*) AS reviewed, count(*) FILTER ({VERDICT} = 'pass') AS passed, count(*) FILTER ({VERDICT} = 'reject') AS rejected,
       count(*) FILTER ({VERDICT} = 'edit') AS edited
FROM documents JOIN labels USING (doc_id) GROUP BY 1
""")
def kpi_by_kind(spark, d):
    n = review.judged(detections(spark, d), verdicts(spark, d)).agg(*[c for k in review.KINDS for c in review._counts(k)])
    of = lambda k: F.struct(F.lit(k).alias("kind"), *[F.col(f"{k}_{c}").alias(v) for c, v in (("reviewed", "reviewed"), ("pass", "passed"), ("reject", "rejected"), ("edit", "edited"))])
    return n.select(F.inline(F.array(*[of(k) for k in review.KINDS]))).filter("reviewed > 0")


@query(f"""
WITH j AS (SELECT source, {KIND} AS kind, CASE WHEN l.doc_id IS NOT NULL THEN {VERDICT} END AS v FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT source, count(*) AS n, count(v) AS decided, count(*) FILTER (kind = 'symbol' AND v IS NOT NULL) AS rev, count(*) FILTER (kind = 'symbol' AND v <> 'pass') AS cor FROM j GROUP BY source)
SELECT CASE WHEN grouping(source) = 1 THEN 'overall' ELSE 'document' END AS level, source, count(*) AS total, count(*) FILTER (n > 0 AND decided = n) AS accepted,
       CASE WHEN sum(rev) > 0 THEN 100.0::DOUBLE * sum(cor) / sum(rev) END AS corrections_per_100_symbols
FROM s GROUP BY GROUPING SETS ((source), ())
""")
def kpi_report(spark, d):
    det = detections(spark, d).withColumn("document", F.col("sheet"))
    sheets = det.select("document", "sheet", F.lit(None).cast("string").alias("profile_name"), F.lit(None).cast("string").alias("profile_version"), F.lit(True).alias("readable")).distinct()
    events = log(spark, d).withColumn("sheet", F.col("sheet").cast("string"))
    r = review.kpi_report(review.sheet_rows(sheets, det, verdicts(spark, d), events))
    return r.select("level", F.col("document").alias("source"), "total", "accepted", "corrections_per_100_symbols")


@query("SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM documents n WHERE n.doc_id = l.doc_id + 1 AND n.source = d.source)")
def stale_verdicts(spark, d):
    """Verdicts on the detection numbered next: stale where the sheet has no such detection."""
    v = verdicts(spark, d).withColumn("detection_id", F.col("detection_id") + 1)
    return review.stale(detections(spark, d), v).select((F.col("detection_id") - 1).alias("doc_id"))


@query(f"""
SELECT doc_id, source, {VERDICT} AS verdict, CASE {VERDICT} WHEN 'pass' THEN 'positive' WHEN 'reject' THEN 'negative' ELSE 'corrected' END AS example,
       row_number() OVER (ORDER BY source, doc_id) AS rank FROM documents JOIN labels USING (doc_id)
""")
def training_export(spark, d):
    return review.training_examples(verdicts(spark, d)).select(F.col("detection_id").alias("doc_id"), F.col("sheet").alias("source"), "verdict", "example", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT l_orderkey, section, count(*) AS gaps, round(min(confidence), 6) AS least FROM (
  SELECT l_orderkey, 'unresolved-text' AS section, l_discount AS confidence FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, 'text', l_discount FROM lineitem WHERE l_returnflag = 'A' AND l_discount < 0.05::DOUBLE
  UNION ALL SELECT l_orderkey, 'symbol', l_discount FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_discount < 0.05::DOUBLE
  UNION ALL SELECT l_orderkey, 'line', l_discount FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND l_discount < 0.05::DOUBLE)
GROUP BY l_orderkey, section
""")
def low_confidence_gaps(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_discount").alias("confidence"))
    resolved = F.col("l_returnflag") != "R"
    texts = li.filter("l_returnflag IN ('R', 'A')").select("l_orderkey", "confidence", resolved.alias("resolved"))
    from orthoplan.operators.batch import gaps

    symbols, lines = li.filter("l_returnflag = 'N' AND l_linestatus = 'O'"), li.filter("l_returnflag = 'N' AND l_linestatus = 'F'")
    every = gaps(texts, symbols.select("l_orderkey", "confidence"), lines.select("l_orderkey", "confidence"), 0.05)
    name = F.when(F.col("kind") == "unresolved-text", F.col("kind")).otherwise(F.element_at(F.array(F.lit("text"), F.lit("symbol"), F.lit("line")), F.col("section")))
    return every.groupBy("l_orderkey", name.alias("section")).agg(F.count("*").alias("gaps"), F.round(F.min("confidence"), 6).alias("least"))


# --- evaluation -------------------------------------------------------------

BOX = "l_partkey % 40 AS x0, l_suppkey % 30 AS y0, l_partkey % 40 + l_quantity AS x1, l_suppkey % 30 + 20 AS y1"
IOU = """CASE WHEN least(p.x1, t.x1) > greatest(p.x0, t.x0) AND least(p.y1, t.y1) > greatest(p.y0, t.y0) THEN
  (least(p.x1, t.x1) - greatest(p.x0, t.x0)) * (least(p.y1, t.y1) - greatest(p.y0, t.y0))
  / ((p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - (least(p.x1, t.x1) - greatest(p.x0, t.x0)) * (least(p.y1, t.y1) - greatest(p.y0, t.y0))) ELSE 0 END"""
RANK = "row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice)"


def boxes(spark, d, flag: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag)
    x, y = F.col("l_partkey") % 40, F.col("l_suppkey") % 30
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("sheet"), pos.cast("long").alias("pos"), g.box(x, y, x + F.col("l_quantity"), y + 20).alias("bbox"), F.col("l_linestatus").alias("cls"), F.col("l_linestatus").alias("string"))


PAIRS = f"""
WITH b AS (SELECT l_orderkey AS sheet, l_returnflag AS f, l_linestatus AS cls, {RANK} AS pos, {BOX} FROM lineitem)
SELECT p.sheet, p.pos AS p, t.pos AS t, round({IOU}, 6) AS iou FROM b p JOIN b t ON p.sheet = t.sheet AND p.f = 'R' AND t.f = 'A' AND p.cls = t.cls WHERE {IOU} >= 0.3
"""


@query(PAIRS)
def iou_candidates(spark, d):
    return evaluate.candidate_pairs(boxes(spark, d, "R"), boxes(spark, d, "A"), 0.3).withColumn("iou", F.round("iou", 6))


@query(PAIRS)
def gridded_iou_candidates(spark, d):
    return evaluate.gridded_pairs(boxes(spark, d, "R"), boxes(spark, d, "A"), 25.0, 0.3).withColumn("iou", F.round("iou", 6))


GREEDY = """
WITH RECURSIVE b AS (SELECT l_orderkey AS sheet, l_returnflag AS f, l_linestatus AS cls, {rank} AS pos, {box} FROM lineitem),
pairs AS (SELECT p.sheet, p.pos AS p, t.pos AS t, {iou} AS iou, p.cls AS ps, t.cls AS ts FROM b p JOIN b t ON p.sheet = t.sheet AND p.f = 'R' AND t.f = 'A' {cls} WHERE {iou} >= 0.3),
ordered AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY iou DESC, p, t) AS k FROM pairs),
r AS (SELECT sheet, k, p, t, iou, ps, ts, [p] AS up, [t] AS ut, true AS kept FROM ordered WHERE k = 1
      UNION ALL SELECT n.sheet, n.k, n.p, n.t, n.iou, n.ps, n.ts, CASE WHEN list_contains(up, n.p) OR list_contains(ut, n.t) THEN up ELSE list_append(up, n.p) END,
      CASE WHEN list_contains(up, n.p) OR list_contains(ut, n.t) THEN ut ELSE list_append(ut, n.t) END, NOT (list_contains(up, n.p) OR list_contains(ut, n.t))
      FROM r JOIN ordered n ON n.sheet = r.sheet AND n.k = r.k + 1)
"""


@query(GREEDY.format(rank=RANK, box=BOX, iou=IOU, cls="AND p.cls = t.cls") + "SELECT sheet, p, t, round(iou, 6) AS iou FROM r WHERE kept")
def greedy_match(spark, d):
    return evaluate.greedy_match(evaluate.candidate_pairs(boxes(spark, d, "R"), boxes(spark, d, "A"), 0.3)).withColumn("iou", F.round("iou", 6))


@query(GREEDY.format(rank=RANK, box=BOX, iou=IOU, cls="") + """, n AS (SELECT sheet, count(*) FILTER (ps = ts) AS exact FROM r WHERE kept GROUP BY sheet)
SELECT t.sheet, t.truth, coalesce(n.exact, 0) AS exact FROM (SELECT sheet, count(*) AS truth FROM b WHERE f = 'A' GROUP BY sheet) t LEFT JOIN n USING (sheet)""")
def tag_scores(spark, d):
    return evaluate.tag_scores(boxes(spark, d, "R"), boxes(spark, d, "A"), 0.3)


def links(spark, d, flag: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag)
    direction = F.when(F.col("l_linestatus") == "F", "known").otherwise("unknown")
    return li.select(F.lit(0).alias("sheet"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), (F.col("l_partkey") % 50).alias("source"), (F.col("l_suppkey") % 50).alias("target"), direction.alias("direction"))


COUNTS = """
WITH n AS (SELECT least(l_partkey % 50, l_suppkey % 50) AS low, greatest(l_partkey % 50, l_suppkey % 50) AS high,
                  count(*) FILTER (l_returnflag = 'R') AS cp, count(*) FILTER (l_returnflag = 'A') AS ct FROM lineitem GROUP BY 1, 2),
s AS (SELECT CAST(sum(least(cp, ct)) AS BIGINT) AS tp, CAST(sum(greatest(cp - ct, 0)) AS BIGINT) AS fp, CAST(sum(greatest(ct - cp, 0)) AS BIGINT) AS fn FROM n),
p AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM s)
"""


@query(COUNTS + "SELECT * FROM p")
def link_f1(spark, d):
    return evaluate.micro(evaluate.link_counts(links(spark, d, "R"), links(spark, d, "A")))


@query("""
WITH RECURSIVE l AS (
  SELECT l_returnflag AS f, least(l_partkey % 50, l_suppkey % 50) AS low, greatest(l_partkey % 50, l_suppkey % 50) AS high, l_partkey % 50 <= l_suppkey % 50 AS up,
         row_number() OVER (PARTITION BY l_returnflag, least(l_partkey % 50, l_suppkey % 50), greatest(l_partkey % 50, l_suppkey % 50) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'F'
), c AS (SELECT low, high, list(up ORDER BY k) AS copies FROM l WHERE f = 'R' GROUP BY low, high),
t AS (SELECT l.low, l.high, l.k, l.up, coalesce(c.copies, []) AS copies FROM l LEFT JOIN c ON c.low = l.low AND c.high = l.high WHERE f = 'A'),
r AS (
  SELECT low, high, 0::BIGINT AS k, any_value(copies) AS left_, 0 AS agreeing, 0 AS conflicting, 0 AS unasserted FROM t GROUP BY low, high
  UNION ALL
  SELECT r.low, r.high, t.k, CASE WHEN len(left_) = 0 THEN left_ ELSE list_concat(left_[1:greatest(list_position(left_, t.up), 1) - 1], left_[greatest(list_position(left_, t.up), 1) + 1:]) END,
         agreeing + CASE WHEN list_contains(left_, t.up) THEN 1 ELSE 0 END, conflicting + CASE WHEN len(left_) > 0 AND NOT list_contains(left_, t.up) THEN 1 ELSE 0 END,
         unasserted + CASE WHEN len(left_) = 0 THEN 1 ELSE 0 END
  FROM r JOIN t ON t.low = r.low AND t.high = r.high AND t.k = r.k + 1
)
SELECT 0 AS sheet, low, high, max_by(agreeing, k)::BIGINT AS agreeing, max_by(conflicting, k)::BIGINT AS conflicting, max_by(unasserted, k)::BIGINT AS unasserted FROM r GROUP BY low, high
""")
def link_directions(spark, d):
    return evaluate.link_directions(links(spark, d, "R"), links(spark, d, "A"))


SIDE = "SELECT least(l_partkey % 50, l_suppkey % 50) AS low, greatest(l_partkey % 50, l_suppkey % 50) AS high FROM lineitem WHERE l_returnflag = "


@query(f"{SIDE} 'R' INTERSECT ALL {SIDE} 'A'")
def link_intersect(spark, d):
    return _copies(spark, d, "tp")


@query(f"{SIDE} 'R' EXCEPT ALL {SIDE} 'A'")
def link_except(spark, d):
    return _copies(spark, d, "fp")


def _copies(spark, d, count: str):
    """Each pair as often as it is counted."""
    n = evaluate.link_counts(links(spark, d, "R"), links(spark, d, "A")).filter(F.col(count) > 0)
    return n.select("low", "high", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("copy")).drop("copy")


@query(COUNTS + """SELECT * FROM (SELECT 'symbol_f1' AS metric, 0.9::DOUBLE AS threshold, NULL::DOUBLE AS score, false AS passed
UNION ALL SELECT 'tag_exact_match', 0.98::DOUBLE, recall, coalesce(recall >= 0.98::DOUBLE, false) FROM p UNION ALL SELECT 'connectivity_f1', 0.7::DOUBLE, f1, coalesce(f1 >= 0.7::DOUBLE, false) FROM p)""")
def gate_report(spark, d):
    s = link_f1(spark, d).select(F.inline(F.array(F.struct(F.lit("connectivity_f1").alias("metric"), F.col("f1").alias("score")), F.struct(F.lit("tag_exact_match").alias("metric"), F.col("recall").alias("score")))))
    return evaluate.gates(s)


@query("""
WITH s AS (SELECT l_shipdate::DATE AS day, count(*) FILTER (l_returnflag = 'R') AS tp, count(*) FILTER (l_returnflag = 'A') AS fp, count(*) FILTER (l_returnflag = 'N' AND l_quantity < 5) AS fn FROM lineitem GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, tp, fp, fn, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM s
""")
def prf_null_safe(spark, d):
    li = table(spark, d, "lineitem").withColumn("day", F.col("l_shipdate").cast("date").cast("string"))
    of = lambda c: F.when(c, 1).otherwise(0)
    rows = li.select("day", of(F.col("l_returnflag") == "R").alias("tp"), of(F.col("l_returnflag") == "A").alias("fp"), of((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 5)).alias("fn"))
    return evaluate.micro(rows, ["day"])


# --- joins ------------------------------------------------------------------

PART_BOX = "p_partkey * 7 % 900 AS x0, p_partkey * 11 % 300 AS y0, p_partkey * 7 % 900 + 60 + p_size AS x1, p_partkey * 11 % 300 + 40 AS y1"


def part_boxes(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    x, y = k * 7 % 900, k * 11 % 300
    nozzle = F.when(k % 3 == 0, k.cast("int"))
    return table(spark, d, "part").select((k % 20).alias("sheet"), (k / 4).cast("long").alias("terminal"), nozzle.alias("nozzle"), g.box(x, y, x + 60 + F.col("p_size"), y + 40).alias("bbox"))


@query(f"""
WITH b AS (SELECT p_partkey % 20 AS sheet, p_partkey // 4 AS terminal, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS nozzle, {PART_BOX} FROM part),
e AS (SELECT o_orderkey AS run, o_orderkey % 20 AS sheet, o_orderkey % 1000 AS x, o_custkey % 400 AS y FROM orders),
h AS (SELECT run, terminal, nozzle, row_number() OVER (PARTITION BY run ORDER BY nozzle IS NULL, terminal, nozzle) AS k
      FROM e JOIN b ON e.sheet = b.sheet AND x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2)
SELECT e.run, h.terminal, h.nozzle FROM e LEFT JOIN h ON h.run = e.run AND k = 1
""")
def endpoint_attach(spark, d):
    from orthoplan.operators.assembly import attach_ends

    o = table(spark, d, "orders")
    ends = o.select((F.col("o_orderkey") % 20).alias("sheet"), F.col("o_orderkey").alias("run"), F.lit(0).alias("end"), g.point(F.col("o_orderkey") % 1000, F.col("o_custkey") % 400).alias("p"))
    return attach_ends(ends, part_boxes(spark, d), by=["sheet"]).select("run", "terminal", F.col("nozzle").cast("long").alias("nozzle"))


@query("""
SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) = 1
""")
def nearest_terminal(spark, d):
    from orthoplan.operators.assembly import nearest_along

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey", F.col("s_acctbal").alias("balance"))
    return nearest_along(c, s, ["n"], "balance", "s_suppkey", ["c_custkey"])


@query("""
SELECT x.l_orderkey, x.l_partkey, x.l_suppkey, x.l_linenumber, x.l_extendedprice, arg_min(t.n, (sqrt(power(x.l_quantity - t.q, 2) + power(x.l_partkey % 100 - t.y, 2)), t.n)) AS terminal
FROM lineitem x JOIN (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_quantity AS q, l_partkey % 100 AS y FROM lineitem WHERE l_returnflag = 'N') t ON t.o = x.l_orderkey
WHERE x.l_returnflag <> 'N' GROUP BY ALL
""")
def nearest_item(spark, d):
    """Orders are sheets; their open lines are terminals in the plane of quantity and part, the others texts."""
    from orthoplan.operators.assembly import nearest

    li = table(spark, d, "lineitem").withColumn("p", g.point(F.col("l_quantity"), F.col("l_partkey") % 100))
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    right = li.filter("l_returnflag = 'N'").select("l_orderkey", F.col("l_linenumber").alias("terminal"), F.col("p").alias("q")).distinct()
    return nearest(li.filter("l_returnflag <> 'N'").select(*key, "p"), right, ["l_orderkey"], g.dist(F.col("p"), F.col("q")), "terminal", ["terminal"], key)


@query("""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(text), '[A-Z]+')) AS w FROM documents),
c AS (SELECT upper(r_name) AS w, 0 AS part, 'region' AS cls FROM region UNION ALL SELECT upper(n_name), 1, 'nation' FROM nation UNION ALL SELECT DISTINCT upper(source), 2, 'source' FROM documents WHERE source IS NOT NULL),
h AS (SELECT doc_id, arg_min(cls, part) AS cls FROM w JOIN c USING (w) GROUP BY doc_id)
SELECT doc_id, coalesce(cls, 'free_text') AS text_class FROM documents LEFT JOIN h USING (doc_id)
""")
def text_class(spark, d):
    """The first claim on any word of a text names its class."""
    from orthoplan.operators.label_factory import first_claims

    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z]+"), F.lit(0)))).alias("string"))
    claim = lambda t, c, cls, part: t.select(F.upper(c).alias("string"), F.lit(cls).alias("text_class"), F.struct(F.lit(part).alias("part"), F.upper(c).alias("k")).alias("ord"), F.lit(part).alias("part"))
    claims = claim(table(spark, d, "region"), "r_name", "region", 0).unionByName(claim(table(spark, d, "nation"), "n_name", "nation", 1))
    claims = claims.unionByName(claim(docs.select("source").filter("source IS NOT NULL").distinct(), "source", "source", 2))
    hit = words.join(first_claims(claims), "string").groupBy("doc_id").agg(F.min_by("text_class", "part").alias("text_class"))
    return docs.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("text_class", F.lit("free_text")).alias("text_class"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def resume_anti(spark, d):
    from orthoplan.operators.batch import pending

    state = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed").alias("status"))
    return pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("sheet")), state).select(F.col("sheet").alias("o_orderkey"))


# --- text -------------------------------------------------------------------


@query("SELECT c_custkey, translate(c_name, '05182', 'OSIBZ') AS noised FROM customer")
def stub_noise(spark, d):
    return table(spark, d, "customer").select("c_custkey", fixture.noised(F.col("c_name")).alias("noised"))


@query(r"""
WITH t AS (SELECT p_partkey, translate(p_brand, '15', 'IS') AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(s, 'Brand#[0-9]{1,2}') THEN s ELSE translate(s, 'IS', '15') END AS string, true AS resolved,
       CASE WHEN regexp_full_match(s, 'Brand#[0-9]{1,2}') THEN NULL ELSE s END AS raw_string,
       CASE WHEN regexp_full_match(s, 'Brand#[0-9]{1,2}') THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence
FROM t
""")
def decode_tags(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.translate("p_brand", "15", "IS").alias("string"), F.lit("brand").alias("text_class"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("raw_string"), F.lit(None).cast("string").alias("correction"), F.struct(F.lit("stub").alias("component"), F.lit("e").alias("evidence")).alias("provenance"))
    return lexicon.decoded(p, {"brand": r"Brand#\d{1,2}"}).select("p_partkey", "string", "resolved", "raw_string", "confidence")


@query(r"""
WITH n AS (SELECT c_name AS s FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part),
f AS (SELECT s, regexp_full_match(s, 'Customer#[0-9]+') AS a, regexp_full_match(s, '[A-Z][a-z]+#[0-9]+') AS b FROM n)
SELECT s, CASE WHEN a AND b THEN NULL WHEN a THEN 'customer' WHEN b THEN 'named' END AS text_class, count(*) AS n FROM f GROUP BY 1, 2
""")
def classify_class(spark, d):
    s = table(spark, d, "customer").select(F.col("c_name").alias("s")).unionAll(table(spark, d, "supplier").select("s_name")).unionAll(table(spark, d, "part").select("p_name"))
    return lexicon.classified(s, {"customer": r"Customer#[0-9]+", "named": r"[A-Z][a-z]+#[0-9]+"}, "s").groupBy("s", "text_class").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'OPC-' || CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE o_orderkey::VARCHAR END
  ELSE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN c_name END, 'UNTAGGED-' || o_orderkey) END AS node_tag,
  CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN c_name || ' / ' || c_mktsegment ELSE 'off-page connector' END
  ELSE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN c_name END, 'UNTAGGED-' || o_orderkey) END AS node_name
FROM orders JOIN customer ON c_custkey = o_custkey
""")
def node_tags(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    role = F.when(F.col("o_orderstatus") == "O", tx.OFF_PAGE).otherwise("Equipment")
    labels = F.when(F.col("o_orderkey") % 2 == 0, F.array("c_name", "c_mktsegment")).otherwise(F.array().cast("array<string>"))
    args = (role, labels, F.when(F.col("o_orderkey") % 3 == 0, F.col("c_name")), F.col("o_orderkey").cast("string"))
    return j.select("o_orderkey", tx.node_tag(*args).alias("node_tag"), tx.node_name(*args).alias("node_name"))


@query("SELECT n_nationkey, 'MERGE (n:' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' {tag: \"' || r_name || '\"})' AS statement FROM nation JOIN region ON r_regionkey = n_regionkey")
def cypher_nodes(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.select("n_nationkey", F.concat(F.lit("MERGE (n:"), tx.graph_label(F.col("n_name")), F.lit(" {tag: "), tx.json_literal("r_name"), F.lit("})")).alias("statement"))


# --- graph ------------------------------------------------------------------


@query("""
SELECT l_orderkey, count(DISTINCT l_linestatus) > 1 AS conflict, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS orientation,
       string_agg(DISTINCT CASE WHEN l_linenumber > 3 THEN 'propagated(' || l_returnflag || ':' || l_linenumber || ')' ELSE l_returnflag || ':' || l_linenumber END, ',' ORDER BY CASE WHEN l_linenumber > 3 THEN 'propagated(' || l_returnflag || ':' || l_linenumber || ')' ELSE l_returnflag || ':' || l_linenumber END) AS refs
FROM lineitem GROUP BY l_orderkey
""")
def evidence_direction(spark, d):
    """Orders as runs, their lines as evidence."""
    li = table(spark, d, "lineitem")
    e = li.select(F.lit("doc").alias("document"), F.lit(0).alias("sheet"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seq"), F.col("l_linestatus").alias("orientation"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").cast("string").alias("evidence_id"), (F.col("l_linenumber") > 3).alias("propagated"))
    return assembly.flows(e).select(F.col("ord").alias("l_orderkey"), "conflict", F.col("flow.orientation").alias("orientation"), F.array_join("refs", ",").alias("refs"))


# The orders of a customer are a sheet's vertices; one is linked with the customer's order before it if their states are the same.
ISLANDS = """
WITH o AS (SELECT o_orderkey AS id, o_custkey AS sheet, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER w THEN 0 ELSE 1 END AS opens FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY sheet ORDER BY id) AS n FROM o), c AS (SELECT id, sheet, min(id) OVER (PARTITION BY sheet, n) AS component FROM i)
"""


def edges(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.when(F.lag("o_orderstatus").over(w) == F.col("o_orderstatus"), F.lag("o_orderkey").over(w))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("a"), F.coalesce(before, "o_orderkey").alias("b"))


@query(ISLANDS + "SELECT id, component FROM c")
def components(spark, d):
    return graph.components(edges(spark, d).select("a", "b"))


@query(ISLANDS + "SELECT sheet, id, component FROM c")
def components_by_group(spark, d):
    return graph.components_by(edges(spark, d), ["sheet"])


def artifact(spark, d) -> tuple[DataFrame, DataFrame]:
    """orders as one topology artifact a customer: open ones are valves, the others corners of the pipe, each joined to the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), (F.row_number().over(w) - 1).alias("pos"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "valve").otherwise("corner").alias("kind"), F.lag("o_orderkey").over(w).alias("before"))
    xy = F.array((F.col("id") % 400).cast("double"), (F.col("page") % 300).cast("double"))
    none = lambda kind: F.lit(None).cast(kind)
    nodes = o.select("page", "pos", "id", "kind", xy.alias("xy"), none("string").alias("tag"), none("string").alias("full_tag"), none("string").alias("shape"), F.when(F.col("id") % 2 == 0, "gate").alias("subclass"), none("array<double>").alias("bbox"), none("array<string>").alias("labels"), none("int").alias("equipment"))
    numbers = F.array(F.concat(F.lit("L"), (F.col("id") % 3).cast("string")))
    e = o.filter("before IS NOT NULL").select("page", "pos", F.col("before").alias("a"), F.col("id").alias("b"), F.when(F.col("id") % 5 == 0, "dashed").otherwise("solid").alias("style"), F.array(xy, F.array((F.col("before") % 400).cast("double"), (F.col("page") % 300).cast("double"))).alias("points"), numbers.alias("line_numbers"), F.lit("ab").alias("direction"), F.lit("arrow").alias("direction_source"))
    return nodes, e


@query("""
WITH o AS (SELECT o_custkey AS page, o_orderkey AS id, o_orderstatus = 'O' AS valve, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
v AS (SELECT *, lag(id) OVER w AS before, lag(pos) OVER w AS at FROM o WHERE valve WINDOW w AS (PARTITION BY page ORDER BY id)),
n AS (SELECT v.page, v.id, string_agg(DISTINCT 'L' || o.id % 3, ',' ORDER BY 'L' || o.id % 3) AS numbers, string_agg(o.pos::VARCHAR, ', ' ORDER BY o.pos) AS between_ FROM v JOIN o ON o.page = v.page AND o.pos > v.at AND o.pos <= v.pos WHERE v.before IS NOT NULL GROUP BY ALL)
SELECT page AS sheet, 'p' || page || '-node' || v.before AS source, 'p' || page || '-node' || v.id AS target, 'known' AS direction, 'arrow' AS direction_sources, n.numbers AS line_numbers,
       'label-factory:topology: topology artifact edges ' || n.between_ AS provenance
FROM v JOIN n USING (page, id)
""")
def pair_links(spark, d):
    """Ground-truth links: valves that follow each other, with everything on the pipe between them."""
    from orthoplan.operators.label_factory import connectivity

    c = connectivity(*artifact(spark, d))
    return c.select("sheet", "source", "target", "direction", F.array_join("direction_sources", ",").alias("direction_sources"), F.array_join("line_numbers", ",").alias("line_numbers"), "provenance")


@query("""
SELECT o_custkey AS sheet, 'p' || o_custkey || '-node' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'gate_valve' ELSE 'valve' END AS symbol_class, (o_orderkey % 400 - 8.0::DOUBLE) * 2.0::DOUBLE AS x0, (o_custkey % 300 - 8.0::DOUBLE) * 2.0::DOUBLE AS y0,
       (o_orderkey % 400 + 8.0::DOUBLE) * 2.0::DOUBLE AS x1, (o_custkey % 300 + 8.0::DOUBLE) * 2.0::DOUBLE AS y1, 'topology artifact node ' || o_orderkey || ' (valve)' AS evidence FROM orders WHERE o_orderstatus = 'O'
""")
def symbol_labels(spark, d):
    from orthoplan.operators.label_factory import symbol_labels as of

    s = of(artifact(spark, d)[0], scale=2.0)
    return s.select("sheet", "id", "symbol_class", "bbox.*", F.col("provenance.evidence").alias("evidence"))


@query("""
WITH o AS (SELECT o_custkey AS page, o_orderkey AS id, row_number() OVER w - 1 AS pos, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT page AS sheet, 'p' || page || '-edge' || pos AS id, CASE WHEN id % 5 = 0 THEN 'signal' ELSE 'pipe' END AS line_class, 2.0::DOUBLE * (id % 400) AS x0, 2.0::DOUBLE * (before % 400) AS x1, 2.0::DOUBLE * (page % 300) AS y FROM o WHERE before IS NOT NULL
""")
def line_labels(spark, d):
    from orthoplan.operators.label_factory import line_labels as of

    n = of(artifact(spark, d)[1], scale=2.0)
    return n.select("sheet", "id", "line_class", F.col("polyline")[0]["x"].alias("x0"), F.col("polyline")[1]["x"].alias("x1"), F.col("polyline")[0]["y"].alias("y"))


@query("SELECT o_custkey AS page, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'p' || o_custkey || '-node' || o_orderkey END AS terminal FROM orders")
def terminal_names(spark, d):
    from orthoplan.operators.label_factory import terminal_names as of

    return of(artifact(spark, d)[0])


def equipment(spark, d) -> tuple[DataFrame, DataFrame]:
    """parts as equipment and instruments of one artifact a size, and lines that carry brands."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    none = lambda kind: F.lit(None).cast(kind)
    kind = F.element_at(F.array(F.lit("equipment"), F.lit("instrument"), F.lit("off-page")), (k % 3 + 1).cast("int"))
    nodes = p.select(F.col("p_size").alias("page"), k.alias("pos"), k.alias("id"), kind.alias("kind"), F.array((k % 90).cast("double"), (k % 70).cast("double")).alias("xy"), F.col("p_brand").alias("tag"), F.when(k % 2 == 0, F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).alias("full_tag"), none("string").alias("shape"), none("string").alias("subclass"), none("array<double>").alias("bbox"), F.when(k % 3 == 2, F.array(F.concat(F.lit(" "), F.col("p_type")))).alias("labels"), none("int").alias("equipment"))
    e = p.select(F.col("p_size").alias("page"), k.alias("pos"), k.alias("a"), k.alias("b"), F.lit("solid").alias("style"), F.array().cast("array<array<double>>").alias("points"), F.array(F.col("p_brand"), F.col("p_name")).alias("line_numbers"), none("string").alias("direction"), none("string").alias("direction_source"))
    return nodes, e


CLAIMS = """
WITH c AS (
  SELECT p_size AS page, trim(p_brand) AS string, 'equipment_tag' AS cls, 0 AS part, p_partkey AS pos, 0 AS k, 'equipment node ' || p_partkey AS detail FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_size, trim(p_brand), 'instrument_tag', 0, p_partkey, 0, 'instrument node ' || p_partkey FROM part WHERE p_partkey % 3 = 1
  UNION ALL SELECT p_size, p_brand || '-' || p_size, 'instrument_tag', 0, p_partkey, 1, 'instrument node ' || p_partkey FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0
  UNION ALL SELECT p_size, trim(p_type), 'opc_label', 0, p_partkey, 0, 'off-page node ' || p_partkey FROM part WHERE p_partkey % 3 = 2
  UNION ALL SELECT p_size, trim(p_brand), 'line_number', 1, p_partkey, 0, 'edge ' || p_partkey FROM part UNION ALL SELECT p_size, trim(p_name), 'line_number', 1, p_partkey, 0, 'edge ' || p_partkey FROM part
), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page, string ORDER BY part, pos, k) = 1)
"""


@query(CLAIMS + "SELECT page, string, cls AS text_class, detail FROM f")
def known_strings(spark, d):
    from orthoplan.operators.label_factory import known_strings as of

    return of(*equipment(spark, d))


@query(CLAIMS + """, s AS (SELECT p_size AS page, p_partkey AS pos, CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 4 = 1 THEN p_brand WHEN p_partkey % 4 = 2 THEN p_name ELSE upper(p_name) END AS string FROM part)
SELECT s.page AS sheet, s.pos, s.string, coalesce(cls, 'free_text') AS text_class, 'PDF text layer span ' || s.pos || ' of page ' || s.page || coalesce('; matches ' || cls || ' ' || chr(39) || s.string || chr(39) || ' from topology artifact ' || detail, '; matches no artifact string') AS evidence
FROM s LEFT JOIN f ON f.page = s.page AND f.string = s.string
""")
def text_labels(spark, d):
    """Spans far from every bubble: a known string or free text."""
    from orthoplan.operators.label_factory import text_labels as of

    p, k = table(spark, d, "part"), F.col("p_partkey")
    string = F.when(k % 4 == 0, F.col("p_type")).when(k % 4 == 1, F.col("p_brand")).when(k % 4 == 2, F.col("p_name")).otherwise(F.upper("p_name"))
    spans = p.select(F.col("p_size").alias("page"), k.alias("pos"), string.alias("string"), F.array(*[F.lit(x) for x in (5000.0, 5000.0, 5010.0, 5010.0)]).alias("bbox"))
    return of(*equipment(spark, d), spans).select("sheet", "pos", "string", "text_class", F.col("provenance.evidence").alias("evidence"))


@query("""
WITH o AS (SELECT o_custkey AS sheet, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS run, min(o_orderkey) OVER (PARTITION BY o_custkey) AS seed FROM orders)
SELECT sheet, run, 'from_to' AS orientation, 'arrow' AS source, seed::VARCHAR AS evidence_id, run > 0 AS propagated FROM o
""")
def propagated(spark, d):
    """A customer's orders as a chain of runs: the first one's arrow reaches them all."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(F.lit("doc").alias("document"), F.col("o_custkey").cast("int").alias("sheet"), (F.row_number().over(w) - 1).alias("run"), F.col("o_orderkey").alias("k"), F.lead("o_orderkey").over(w).isNotNull().alias("more"))
    seeds = o.filter("run = 0").select("document", "sheet", "run", F.lit(1).alias("seq"), F.lit("from_to").alias("orientation"), F.lit("arrow").alias("source"), F.col("k").cast("string").alias("evidence_id"))
    ends = o.select("document", "sheet", "run", F.explode(F.array(F.when(F.col("run") > 0, F.lit(0)), F.when(F.col("more"), F.lit(1)))).alias("end")).filter("end IS NOT NULL")
    members = ends.withColumn("junction", F.col("run") + F.col("end") - 1)
    return assembly.propagated(seeds, members).select("sheet", "run", "orientation", "source", "evidence_id", "propagated")


@query("""
WITH o AS (SELECT o_custkey AS sheet, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS run, o_orderkey % 6 AS place FROM orders),
f AS (SELECT sheet, place, min(run) AS first, count(*) AS n FROM o GROUP BY ALL), j AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY first) - 1 AS junction FROM f)
SELECT o.sheet, run, 0 AS "end", junction, place * 10.0::DOUBLE AS x FROM o JOIN j USING (sheet, place) WHERE n > 1
""")
def loose_junctions(spark, d):
    """Loose ends at six places of a sheet: those that share one are a junction."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(F.lit("doc").alias("document"), F.col("o_custkey").cast("int").alias("sheet"), (F.row_number().over(w) - 1).alias("run"), F.lit(0).alias("end"), g.point(F.col("o_orderkey") % 6 * 10, F.lit(0)).alias("p"), F.lit(None).cast("int").alias("terminal"))
    return assembly.loose_junctions(o).select("sheet", "run", "end", "junction", "x")


@query("SELECT p_name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sheets FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def cross_sheet_links(spark, d):
    from orthoplan.operators.plant import cross_sheet_links as of

    runs = table(spark, d, "part").select(F.lit("doc").alias("document"), F.col("p_brand").alias("sheet"), F.array("p_name").alias("line_numbers"))
    return of(assembly.Assembly(None, None, runs, None, None, None)).select(F.col("lineNumber").alias("p_name"), F.array_join("sheets", ",").alias("sheets"))


ORDERED = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice, 'p' || l_orderkey || 'n' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDERED}) - 1) AS number FROM lineitem")
def record_numbering(spark, d):
    """Orders as sheets, their lines as terminals."""
    from orthoplan.operators.plant import allocations

    w = Window.partitionBy("l_orderkey").orderBy(*[c.strip() for c in ORDERED.split(",")])
    li = table(spark, d, "lineitem").select(F.lit("doc").alias("document"), F.col("l_orderkey").alias("sheet"), F.row_number().over(w).alias("ord"), "l_partkey", "l_extendedprice")
    none = lambda schema: spark.createDataFrame([], schema)
    end = "struct<terminal:int,nozzle:int,junction:int>"
    a = assembly.Assembly(li, none("document string, sheet long, ord int, terminal int"), none(f"document string, sheet long, ord int, polyline array<struct<x:double,y:double>>, ends array<{end}>"), None, None, None)
    n = allocations(a).select("sheet", F.col("ref").alias("ord"), "number")
    return li.join(n, ["sheet", "ord"]).select(F.col("sheet").alias("l_orderkey"), "l_partkey", "l_extendedprice", "number")


# --- geometry ---------------------------------------------------------------


def polylines(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    p = F.array(g.point(F.col("l_partkey") % 100, F.col("l_suppkey") % 50), g.point(F.col("l_quantity"), F.col("l_linenumber") * 9), g.point(F.col("l_orderkey") % 80, F.col("l_quantity") * 2))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", p.alias("polyline"))


VERTICES = "SELECT *, l_partkey % 100 AS ax, l_suppkey % 50 AS ay, l_quantity AS bx, l_linenumber * 9 AS by_, l_orderkey % 80 AS cx, l_quantity * 2 AS cy FROM lineitem"


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice, round(sqrt((ax-bx)*(ax-bx) + (ay-by_)*(ay-by_)) + sqrt((bx-cx)*(bx-cx) + (by_-cy)*(by_-cy)), 6) AS length FROM ({VERTICES})")
def polyline_length(spark, d):
    return polylines(spark, d).select("l_orderkey", "l_partkey", "l_extendedprice", F.round(g.length(F.col("polyline")), 6).alias("length"))


@query(f"""
SELECT l_orderkey, l_partkey, l_extendedprice, i, round(x0::DOUBLE, 6) AS x0, round(y0::DOUBLE, 6) AS y0, round(x1::DOUBLE, 6) AS x1, round(y1::DOUBLE, 6) AS y1 FROM (
  SELECT l_orderkey, l_partkey, l_extendedprice, 0 AS i, ax AS x0, ay AS y0, bx AS x1, by_ AS y1 FROM ({VERTICES})
  UNION ALL SELECT l_orderkey, l_partkey, l_extendedprice, 1, bx, by_, cx, cy FROM ({VERTICES}))
""")
def segments(spark, d):
    s = polylines(spark, d).select("l_orderkey", "l_partkey", "l_extendedprice", F.explode(g.legs(F.col("polyline"))).alias("s"))
    return s.select("l_orderkey", "l_partkey", "l_extendedprice", "s.i", *[F.round(F.col(f"s.{v}.{c}"), 6).alias(f"{c}{n}") for n, v in enumerate("ab") for c in "xy"])


SEGMENT = """
  CASE WHEN {ax} = {bx} AND {ay} = {by} THEN sqrt(power(50 - {ax}, 2) + power(25 - {ay}, 2)) ELSE
  sqrt(power(50 - ({ax} + t * ({bx} - {ax})), 2) + power(25 - ({ay} + t * ({by} - {ay})), 2)) END"""


@query(f"""
SELECT l_orderkey, l_partkey, l_extendedprice, round({SEGMENT.format(ax="ax", ay="ay", bx="bx", by="by_")}, 6) AS dist FROM (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((50 - ax) * (bx - ax) + (25 - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0)::DOUBLE)) AS t FROM ({VERTICES}))
""")
def seg_distance(spark, d):
    p = polylines(spark, d)
    v = F.col("polyline")
    return p.select("l_orderkey", "l_partkey", "l_extendedprice", F.round(g.segment_dist(g.point(F.lit(50), F.lit(25)), v[0], v[1]), 6).alias("dist"))


@query("""
WITH b AS (SELECT l_orderkey, l_partkey, l_extendedprice, l_partkey % 100 AS x0, l_suppkey % 50 AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey % 50 + l_linenumber AS y1 FROM lineitem),
c AS (SELECT *, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM b),
m AS (SELECT *, (cos(radians(-2.5)) * (x - 200) - sin(radians(-2.5)) * (y - 100) + 200) * 0.5::DOUBLE AS u, (sin(radians(-2.5)) * (x - 200) + cos(radians(-2.5)) * (y - 100) + 100) * 0.5::DOUBLE AS v FROM c)
SELECT l_orderkey, l_partkey, l_extendedprice, round(min(u), 6) AS x0, round(min(v), 6) AS y0, round(max(u), 6) AS x1, round(max(v), 6) AS y1
FROM m GROUP BY l_orderkey, l_partkey, l_extendedprice, x0, y0, m.x1, m.y1
""".replace("x0, y0, m.x1, m.y1", "m.x0, m.y0, m.x1, m.y1"))
def frame_map(spark, d):
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 50
    norm = F.struct(F.lit(2.5).alias("angle_degrees"), F.lit(0.5).alias("scale"), F.array(F.lit(400), F.lit(200)).alias("original_size"))
    b = g.box(x, y, x + F.col("l_quantity"), y + F.col("l_linenumber"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", b.alias("b")).distinct()
    m = li.withColumn("m", g.mapped_box(F.col("b"), lambda p: g.to_normalized(p, norm)))
    return m.select("l_orderkey", "l_partkey", "l_extendedprice", *[F.round(F.col(f"m.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


CLIP = "SELECT *, greatest(x0, 0) AS a, greatest(y0, 0) AS b, least(x1, 90) AS c, least(y1, 60) AS e FROM (SELECT l_orderkey, l_partkey, l_extendedprice, l_linenumber, l_partkey % 140 - 30 AS x0, l_suppkey % 90 - 20 AS y0, l_partkey % 140 - 30 + l_quantity / 2 AS x1, l_suppkey % 90 - 20 + l_linenumber * 3 AS y1 FROM lineitem)"


def _clipped(spark, d) -> DataFrame:
    x, y = F.col("l_partkey") % 140 - 30, F.col("l_suppkey") % 90 - 20
    b = g.box(x, y, x + F.col("l_quantity") / 2, y + F.col("l_linenumber") * 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber", g.clipped(b, F.lit(90), F.lit(60)).alias("b"))


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice, a::DOUBLE AS x0, b::DOUBLE AS y0, c::DOUBLE AS x1, e::DOUBLE AS y1 FROM ({CLIP}) WHERE a < c AND b < e")
def clip_boxes(spark, d):
    return _clipped(spark, d).filter("b IS NOT NULL").select("l_orderkey", "l_partkey", "l_extendedprice", "b.*")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM ({CLIP}) WHERE NOT (a < c AND b < e))")
def drop_vanished(spark, d):
    """Links whose end vanished from the canvas go with it."""
    gone = _clipped(spark, d).filter("b IS NULL").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(gone, "o_orderkey", "left_anti")


# --- small operators ----------------------------------------------------------


@query("""
SELECT c_custkey, array_to_string(list_transform(list_filter(range(1, length(c_name) + 1), lambda i: c_name[i] = '0'), lambda i: '0->O at index ' || (i - 1)), ', ') AS swaps FROM customer
""")
def repaired_places(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.swaps(F.col("c_name"), F.translate("c_name", "0", "O")).alias("swaps"))


@query("SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '; tagged by text ' || p_brand ELSE '' END AS evidence FROM part")
def combined_evidence(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.combined_evidence(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).alias("evidence"))


@query("SELECT DISTINCT p_name, p_type, replace(url_encode(p_name), '+', '%20') || '@' || replace(url_encode(p_type), '+', '%20') AS key FROM part")
def profile_keys(spark, d):
    return table(spark, d, "part").select("p_name", "p_type").distinct().withColumn("key", tx.profile_key("p_name", "p_type"))


@query("""
SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped, regexp_matches(text, '[一-鿿]') AS cjk FROM documents
""")
def escaped_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.escaped(F.col("text")).alias("escaped"), tx.has_cjk(F.col("text")).alias("cjk"))


ITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
ITEMS = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_partkey % 100 AS x0, l_suppkey % 50 AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey % 50 + l_linenumber AS y1, l_linenumber % 4 * 90 AS angle, l_quantity, l_linenumber AS n FROM lineitem"


def item_boxes(spark, d) -> DataFrame:
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 50
    return table(spark, d, "lineitem").withColumn("b", g.box(x, y, x + F.col("l_quantity"), y + F.col("l_linenumber")))


@query(f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
  CASE angle WHEN 90 THEN y0 WHEN 180 THEN 400 - x1 WHEN 270 THEN 400 - y1 ELSE x0 END::DOUBLE AS x0, CASE angle WHEN 90 THEN 200 - x1 WHEN 180 THEN 200 - y1 WHEN 270 THEN x0 ELSE y0 END::DOUBLE AS y0,
  CASE angle WHEN 90 THEN y1 WHEN 180 THEN 400 - x0 WHEN 270 THEN 400 - y0 ELSE x1 END::DOUBLE AS x1, CASE angle WHEN 90 THEN 200 - x0 WHEN 180 THEN 200 - y0 WHEN 270 THEN x1 ELSE y1 END::DOUBLE AS y1
FROM ({ITEMS})
""")
def unturned_boxes(spark, d):
    return item_boxes(spark, d).select(*ITEM, g.unrotated_box(F.col("b"), F.lit(400), F.lit(200), F.col("l_linenumber") % 4 * 90).alias("u")).select(*ITEM, "u.*")


@query(f"""
WITH v AS (SELECT *, l_quantity - 25 AS vx, n * 7 - 20 AS vy FROM ({ITEMS}))
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round((x0 + x1) / 2, 6)::DOUBLE AS cx, round((y0 + y1) / 2.0::DOUBLE, 6) AS cy, round(vx / sqrt(vx * vx + vy * vy), 6) AS ux,
  CAST((round_even(atan2(vy, vx) / (pi() / 4), 0) + 8) % 8 AS INTEGER) AS sector, (x0 + 2)::DOUBLE AS tx0, (y0 + n - 2)::DOUBLE AS ty1, x1 > 20 AND x0 < 60 AND y1 > 0 AND y0 < 30 AS visible FROM v
""")
def box_facts(spark, d):
    """Centres, unit vectors and their sectors, windows without their ring, and what shows on a canvas of 40 by 30 at (20, 0)."""
    b, v = F.col("b"), g.point(F.col("l_quantity") - 25, F.col("l_linenumber") * 7 - 20)
    trimmed = g.trimmed_box(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])
    shown = g.visible(F.transform(g.corners(b), lambda p: g.point(p["x"] - 20, p["y"])), F.lit(40), F.lit(30))
    rows = item_boxes(spark, d).withColumn("u", g.unit(v)).withColumn("c", g.center(b))
    return rows.select(*ITEM, F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), F.round("u.x", 6).alias("ux"), g.sector(F.col("u")).alias("sector"), trimmed["x0"].alias("tx0"), trimmed["y1"].alias("ty1"), shown.alias("visible"))


@query(f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round(200 + (x0 - 200) * cos(radians(2.5)) - (y0 - 100) * sin(radians(2.5)), 6) AS x, round(100 + (x0 - 200) * sin(radians(2.5)) + (y0 - 100) * cos(radians(2.5)), 6) AS y FROM ({ITEMS})
""")
def degraded_points(spark, d):
    """Places on a skewed copy of a sheet; blur and noise move nothing."""
    from orthoplan.operators.raster import degrade

    made = (degrade.Skew(2.5), degrade.Blur(1))
    p = degrade.moved(g.point(F.col("l_partkey") % 100, F.col("l_suppkey") % 50), made, F.lit(400), F.lit(200))
    return table(spark, d, "lineitem").withColumn("p", p).select(*ITEM, F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""
SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unknown verdict' WHEN source IS NULL THEN 'unknown kind' WHEN lang <> 'de' AND n_chars % 2 = 0 THEN 'only an edit carries a correction'
  WHEN lang = 'de' AND n_chars % 2 = 1 THEN 'an edit needs a correction' WHEN n_chars % 3 = 0 THEN 'bbox is four finite numbers of a symbol or text' END AS problem FROM documents
""")
def refused_verdicts(spark, d):
    doc = table(spark, d, "documents")
    verdict = F.when(F.col("lang") == "en", "pass").when(F.col("lang") == "fr", "reject").when(F.col("lang") == "de", "edit").otherwise("maybe")
    box = F.when(F.col("n_chars") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(float("nan")), F.lit(4.0))).otherwise(F.array(*[F.lit(float(k)) for k in range(4)]))
    none = F.lit(None).cast("array<array<double>>")
    return doc.select("doc_id", review.example_problem(F.when(F.col("source").isNotNull(), "symbol"), verdict, box, none, F.lit(None).cast("string"), F.col("n_chars") % 2 == 0).alias("problem"))


@query(f"SELECT doc_id, CASE {VERDICT} WHEN 'reject' THEN NULL WHEN 'edit' THEN CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END ELSE source END AS string FROM documents JOIN labels USING (doc_id)")
def supervised_labels(spark, d):
    """What a verdict says is true of a text: sources as read, languages as corrected."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "edit").otherwise("pass")
    v = j.select("doc_id", verdict.alias("verdict"), F.struct(F.col("source").alias("string")).alias("detection"), F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("string")).alias("correction"))
    return review.supervised_labels(v).select("doc_id", F.col("label.string").alias("string"))


@query("""
SELECT o_custkey::VARCHAR AS document, count(*) AS total_sheets, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 3 <> 0) AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed,
       count(*) FILTER (o_orderkey % 3 = 0) AS skipped_by_resume, count(*) FILTER (o_orderstatus <> 'F') AS digitized FROM orders GROUP BY o_custkey
""")
def run_coverage(spark, d):
    """Customers as runs, orders as sheets: every third was there before, the filled ones failed."""
    from orthoplan.operators.batch import coverage

    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("document"), F.col("o_orderkey").alias("sheet"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"))
    return coverage(o, o, o.filter("sheet % 3 = 0"))


@query(f"SELECT 'doc' AS document, sum(gap) / 60000000.0::DOUBLE AS minutes_outside_artifacts FROM ({GAPS}) WHERE gap <= 600000000 AND sheet NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def minutes_outside(spark, d):
    """Activity on sheets that the run has no record of: records are those of even customers."""
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.lit("doc").alias("document"), F.col("c_custkey").alias("sheet"))
    return review.minutes_outside(known, log(spark, d)).withColumn("minutes_outside_artifacts", F.col("minutes_outside_artifacts"))


@query("""
WITH e AS (SELECT o_orderkey, o_custkey AS a, o_custkey % 7 + 1 AS b FROM orders), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 't' || c_custkey ELSE '?s' || c_custkey END AS name FROM customer)
SELECT 0 AS sheet, o_orderkey AS pos, x.name AS source, y.name AS target, 'unknown' AS direction FROM e LEFT JOIN n x ON x.k = a LEFT JOIN n y ON y.k = b
""")
def predicted_links(spark, d):
    """Customers are terminals, the even ones matched with a truth symbol; orders are edges."""
    c = table(spark, d, "customer")
    at, own = F.lit(0).alias("sheet"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id")
    terminals = c.select(at, F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("node_tag"), own)
    matches = c.filter("c_custkey % 2 = 0").select(at, own, F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("truth_id"))
    e = table(spark, d, "orders").select(at, F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("source"), (F.col("o_custkey") % 7 + 1).cast("string").alias("target"), F.lit("unknown").alias("direction"))
    return evaluate.predicted_links(e, terminals, matches)


# --- kernels ----------------------------------------------------------------


def rasters(spark, d) -> DataFrame:
    """A little sheet a document: the 32 hex digits of its text's digest as eight by four gray pixels."""
    digest = F.encode(F.md5(F.coalesce("text", F.lit(""))), "UTF-8")
    return table(spark, d, "documents").select(F.lit("doc").alias("document"), F.col("doc_id").cast("int").alias("sheet"), F.lit(8).alias("width"), F.lit(4).alias("height"), digest.alias("raster"))


@query("""
WITH p AS (SELECT doc_id, unnest(list_transform(string_split(md5(coalesce(text, '')), ''), lambda c: ascii(c))) AS v FROM documents),
h AS (SELECT doc_id, v, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT doc_id, v, sum(n) OVER w AS w0, sum(v * n) OVER w AS s0, sum(n) OVER (PARTITION BY doc_id) AS w, sum(v * n) OVER (PARTITION BY doc_id) AS s FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY v)),
b AS (SELECT doc_id, v, (w0 * (w - w0))::DOUBLE * ((s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0))) AS between_ FROM c WHERE w > w0)
SELECT doc_id, arg_max(v, (round(between_, 6), -v)) AS threshold, 400 AS width, 200 AS height, 50.0::DOUBLE AS scale FROM b GROUP BY doc_id
""")
def otsu_histogram(spark, d):
    """Otsu's threshold and the size of the normalized sheet."""
    from orthoplan.operators.raster import normalize

    n = normalize.normalized_sheets(rasters(spark, d))
    return n.select(F.col("sheet").cast("long").alias("doc_id"), "normalization.threshold", "width", "height", "normalization.scale")


@query("SELECT doc_id, md5(coalesce(text, '')) AS pixels, 8 AS width, 4 AS height FROM documents")
def png_round_trip(spark, d):
    from orthoplan.operators.raster import png

    files = png.encoded(rasters(spark, d)).select(F.col("sheet").cast("string").alias("path"), F.col("png").alias("content"))
    return png.decoded(files).select(F.col("path").cast("long").alias("doc_id"), F.decode("raster", "UTF-8").alias("pixels"), "width", "height")


@query("""
SELECT p_brand, 'x' || p_brand AS name, list_sort(list(p_size))[count(*) // 2 + 1] + 4 AS width, list_sort(list(p_size % 7))[count(*) // 2 + 1] + 4 AS height, 0.25::DOUBLE AS threshold, count(*) AS examples FROM part GROUP BY p_brand
""")
def upper_median(spark, d):
    """Prototypes of solid crops: the upper median of either side, the least threshold, as nothing can be told apart."""
    from orthoplan.operators.raster import detector

    w, h = F.col("p_size") + 4, F.col("p_size") % 7 + 4
    crops = table(spark, d, "part").select(F.concat(F.lit("x"), "p_brand").alias("symbol_class"), w.alias("width"), h.alias("height"), F.encode(F.repeat(F.lit("\u0001"), w * h), "UTF-8").alias("bits"), F.lit(None).cast("struct<x:double,y:double>").alias("direction"))
    return detector.trained(crops).select(F.substring("symbol_class", 2, 100).alias("p_brand"), "name", "width", "height", "threshold", "examples")


# --- the fixture sheet: what must come out of it is written down ---------------


@query("""SELECT * FROM (VALUES (1, 'T-101', 'V-101', 'known', 1.0::DOUBLE), (1, 'V-101', 'T-102', 'unknown', 1.0::DOUBLE), (1, 'T-102', 'OPC-DW02-0003', 'unknown', 1.0::DOUBLE)) v(sheet, source, target, direction, confidence)""")
def digitize_synthetic(spark, d):
    """The whole way from annotations to a plant graph on the fixture sheet; no driver table."""
    return fixture.plant_edges(spark).drop("provenance")


@query("""SELECT * FROM (VALUES (0, 'T-101', 'T-101', 'tank', ''), (2, 'V-101', 'V-101', 'valve', ''), (3, 'T-102', 'T-102', 'tank', ''), (4, 'PI-100', 'PI-100', 'instrument', ''), (5, 'OPC-DW02-0003', 'DW02-0003', 'line', 'DW02-0003')) v(ord, tag, name, equipment_type, labels)""")
def fixture_nodes(spark, d):
    """The plant graph's nodes: five symbols name a plant item."""
    return plant.nodes(fixture.assembly(spark)).select("ord", "tag", "name", "equipment_type", F.array_join("labels", ",").alias("labels"))


@query("""SELECT * FROM (VALUES ('terminal', 0, 'p1n0'), ('nozzle', 1, 'p1n1'), ('terminal', 2, 'p1n2'), ('terminal', 3, 'p1n3'), ('terminal', 4, 'p1n4'), ('terminal', 5, 'p1n5'), ('corner', 2, 'p1n6')) v(kind, ref, number)""")
def fixture_numbers(spark, d):
    """Node numbers: the tank's nozzle comes right behind it, the one corner of the three runs last."""
    return plant.allocations(fixture.assembly(spark)).select("kind", "ref", "number")


@query("""
SELECT * FROM (VALUES ('p1s0', 'p1n1', 'p1n2', 114.0::DOUBLE, 'from_to', 'arrow'), ('p1s1', 'p1n2', 'p1n3', 120.0::DOUBLE, NULL, NULL), ('p1s2', 'p1n3', 'p1n6', 30.0::DOUBLE, NULL, NULL), ('p1s3', 'p1n6', 'p1n5', 25.0::DOUBLE, NULL, NULL)) v(id, "from", "to", length, flow, flow_source)
""")
def fixture_segments(spark, d):
    s = plant.segments(fixture.assembly(spark), fixture.SEMANTICS)
    return s.select("id", "from", "to", "length", F.col("flowDirection").alias("flow"), F.col("flowDirectionSource").alias("flow_source"))


@query("""SELECT * FROM (VALUES ('Equipment', 2), ('Nozzle', 1), ('PipingComponent', 1), ('ProcessInstrumentationFunction', 1), ('PipingNetworkSegment', 4), ('PipeOffPageConnector', 1), ('PipingNode', 1)) v(kind, records)""")
def fixture_records(spark, d):
    out = plant.records(fixture.assembly(spark), fixture.SEMANTICS)
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").cast("int").alias("records")).select(F.lit(k).alias("kind"), "records") for k, t in out.items()])


@query("""SELECT * FROM (VALUES (0, 'T-101'), (1, 'V-101'), (2, 'T-102'), (3, 'PI-100'), (4, '150-GA-001'), (5, 'DW02-0003')) v(pos, string)""")
def fixture_repairs(spark, d):
    """The fixture's texts with every digit misread, decoded again."""
    t = lexicon.decoded(annotations.texts(fixture.sheets(spark), True), fixture.GRAMMAR)
    return t.filter("resolved").select("pos", "string")


@query("""
SELECT * FROM (VALUES (0, 'p1-line0', 'pipe'), (1, 'p1-line1', 'pipe')) v(pos, id, line_class)
""")
def fixture_lines(spark, d):
    """Two strokes that meet a symbol's box between them: two runs, whatever the symbol's own ink."""
    import numpy as np

    from orthoplan.operators.raster import lines

    a = np.full((200, 400), 255, np.uint8)
    a[110, 40:181], a[110, 200:321], a[100:121, 180:201] = 0, 0, 0
    s = fixture.sheets(spark, fixture.sheet(symbols=[("gate_valve", (180, 100, 200, 120), None)], lines=[], texts=[], raster=a.tobytes()))
    return lines.line_network(s, annotations.symbols(s), fixture.legend(spark), {"solid": "pipe"}).select("pos", "id", "line_class")
