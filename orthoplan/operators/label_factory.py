"""Training labels from topology artifacts: boxes, lines, texts and ground-truth links.

nodes(page, pos, id, kind, xy array<double>, tag, full_tag, shape, subclass, bbox array<double>, labels array<string>, equipment int)
edges(page, pos, a, b, style, points array<array<double>>, line_numbers array<string>, direction, direction_source)
spans(page, pos, string, bbox array<double>)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoplan.functions import geometry as g
from orthoplan.functions import text as tx
from orthoplan.operators.graph import components_by

COMPONENT = "label-factory:topology"
DPI = 150
# Kinds of node, half extents of synthesized boxes in points, line classes of stroke styles.
TERMINALS = ["equipment", "valve", "instrument", "off-page", "nozzle"]
THROUGH = ["junction", "corner", "dead-end"]
HALF = {"instrument": (16.4, 16.4), "valve": (8.0, 8.0), "nozzle": (4.0, 4.0), "off-page": (16.0, 8.0)}
LINE_CLASSES = {"solid": "pipe", "dashed": "signal"}
REQUIRED = ("page", "nodes", "edges", "direction_stats")


def first_claims(claims: DataFrame) -> DataFrame:
    """claims(by..., string, text_class, ord, ...) -> the first claim of each string."""
    key = [c for c in ("page", "string") if c in claims.columns]
    rest = [c for c in claims.columns if c not in (*key, "ord")]
    return claims.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*key, "r.*")


def missing_keys(artifact: dict) -> list[str]:
    """Keys that an artifact of the current form has and this one lacks."""
    return [k for k in REQUIRED if k not in artifact]


def symbol_class(kind: Column, shape: Column, subclass: Column) -> Column:
    some = lambda c: c.isNotNull() & (c != "")
    return (
        F.when(kind == "equipment", F.when(some(shape), F.concat(F.lit("equipment_"), shape)).otherwise("equipment"))
        .when(kind == "valve", F.when(some(subclass), F.concat(subclass, F.lit("_valve"))).otherwise("valve"))
        .when(kind == "instrument", "instrument_bubble")
        .when(kind == "off-page", "opc")
        .otherwise("nozzle")
    )


def node_box(kind: Column, xy: Column, bbox: Column) -> Column:
    """In points: as drawn, else of the kind's size about the node."""
    half = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in HALF.items() for x in kv])[kind]
    around = g.box(xy[0] - half[0], xy[1] - half[1], xy[0] + half[0], xy[1] + half[1])
    return F.when(bbox.isNotNull(), g.box(bbox[0], bbox[1], bbox[2], bbox[3])).otherwise(around)


def scaled_box(b: Column, scale: float) -> Column:
    return g.box(*[b[k] * scale for k in ("x0", "y0", "x1", "y1")])


def provenance(evidence: Column) -> Column:
    return F.struct(F.lit(COMPONENT).alias("component"), evidence.alias("evidence"))


def symbol_labels(nodes: DataFrame, source: str = "artifact", scale: float = DPI / 72) -> DataFrame:
    """Pass-through geometry has no label; an unknown kind is an error."""
    known = F.when(F.col("kind").isin(*TERMINALS, *THROUGH), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit(f"{source}: unknown kind of node "), F.col("kind"))))
    n = nodes.withColumn("kind", known).filter(F.col("kind").isin(*TERMINALS))
    return n.select(
        F.col("page").alias("sheet"), "pos", tx.node_label(F.col("page"), F.col("id")).alias("id"), symbol_class(F.col("kind"), F.col("shape"), F.col("subclass")).alias("symbol_class"), scaled_box(node_box(F.col("kind"), F.col("xy"), F.col("bbox")), scale).alias("bbox"),
        F.lit(1.0).alias("confidence"), provenance(F.concat(F.lit(f"topology {source} node "), F.col("id").cast("string"), F.lit(" ("), F.col("kind"), F.lit(")"))).alias("provenance"),
    )


def line_labels(edges: DataFrame, source: str = "artifact", scale: float = DPI / 72) -> DataFrame:
    style = F.coalesce("style", F.lit("solid"))
    classes = F.create_map(*[F.lit(x) for kv in LINE_CLASSES.items() for x in kv])
    pos = F.col("pos").cast("string")
    return edges.filter(style != "internal").select(
        F.col("page").alias("sheet"), "pos", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-edge"), pos).alias("id"), F.coalesce(classes[style], style).alias("line_class"),
        F.transform("points", lambda p: g.point(p[0] * scale, p[1] * scale)).alias("polyline"), F.lit(1.0).alias("confidence"), provenance(F.concat(F.lit(f"topology {source} edge "), pos, F.lit(" ("), style, F.lit(")"))).alias("provenance"),
    )


def known_strings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What an artifact says is written on its sheet: page, string, text_class, detail; the first claim of a string stands."""
    one = lambda d, string, cls, part, k=0: d.select("page", F.trim(string).alias("string"), F.lit(cls).alias("text_class"), F.struct(F.lit(part).alias("part"), F.col("pos").alias("pos"), F.lit(k).alias("k")).alias("ord"), F.concat(F.lit("equipment node " if cls == "equipment_tag" else "instrument node " if cls == "instrument_tag" else "off-page node " if cls == "opc_label" else "edge "), (F.col("pos") if cls == "line_number" else F.col("id")).cast("string")).alias("detail"))
    kind = lambda k: nodes.filter(F.col("kind") == k)
    claims = one(kind("equipment"), F.col("tag"), "equipment_tag", 0)
    for k, c in enumerate(("tag", "full_tag")):
        claims = claims.unionByName(one(kind("instrument"), F.col(c), "instrument_tag", 0, k))
    claims = claims.unionByName(one(kind("off-page").withColumn("l", F.explode("labels")), F.col("l"), "opc_label", 0))
    claims = claims.unionByName(one(edges.withColumn("l", F.explode("line_numbers")), F.col("l"), "line_number", 1))
    return first_claims(claims.filter("string <> ''"))


def text_labels(nodes: DataFrame, edges: DataFrame, spans: DataFrame, source: str = "artifact", scale: float = DPI / 72) -> DataFrame:
    """Spans by an equal known string, else as a token of the first bubble that holds them, else as free text."""
    s = spans.withColumn("string", F.trim("string")).filter("string <> ''").withColumn("b", g.box(*[F.col("bbox")[i] for i in range(4)]))
    s = s.join(known_strings(nodes, edges).withColumnRenamed("text_class", "known"), ["page", "string"], "left")
    tokens = F.array_distinct(F.split(F.replace(F.concat_ws(" ", "tag", "full_tag"), F.lit("-"), F.lit(" ")), r"\s+"))
    bubbles = nodes.filter("kind = 'instrument'").select("page", F.col("pos").alias("bubble"), F.col("id").alias("node"), F.col("tag").alias("node_tag"), tokens.alias("tokens"), node_box(F.col("kind"), F.col("xy"), F.col("bbox")).alias("nb"))
    hit = s.filter("known IS NULL").join(bubbles, "page").filter(F.array_contains("tokens", F.col("string")) & g.near_box(g.center(F.col("b")), F.col("nb")))
    hit = hit.groupBy("page", "pos").agg(F.min_by(F.struct("node", "node_tag"), "bubble").alias("h"))
    s = s.join(hit, ["page", "pos"], "left")
    cls = F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("h").isNotNull(), "instrument_tag").otherwise("free_text")
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    why = (
        F.when(F.col("known").isNotNull(), F.concat(F.lit("; matches "), "known", F.lit(" "), q(F.col("string")), F.lit(f" from topology {source} "), "detail"))
        .when(F.col("h").isNotNull(), F.concat(F.lit("; token of instrument tag "), q(F.col("h.node_tag")), F.lit(f" (topology {source} node "), F.col("h.node").cast("string"), F.lit(")")))
        .otherwise("; matches no artifact string")
    )
    where = F.concat(F.lit("PDF text layer span "), F.col("pos").cast("string"), F.lit(" of page "), F.col("page").cast("string"))
    return s.select(
        F.col("page").alias("sheet"), "pos", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-span"), F.col("pos").cast("string")).alias("id"), "string", cls.alias("text_class"),
        scaled_box(F.col("b"), scale).alias("bbox"), F.lit(1.0).alias("confidence"), provenance(F.concat(where, why)).alias("provenance"),
    )


def terminal_names(nodes: DataFrame, source: str = "artifact") -> DataFrame:
    """page, id, terminal: symbols stand for themselves, a nozzle for the item that its number among the drawn boxes names,
    pass-through geometry for nothing."""
    items = nodes.filter("bbox IS NOT NULL").select("page", (F.row_number().over(Window.partitionBy("page").orderBy("pos")) - 1).alias("equipment"), F.col("id").alias("item"), F.col("kind").alias("item_kind"))
    n = nodes.join(items, ["page", "equipment"], "left")
    fault = lambda what: F.raise_error(F.concat(F.lit(f"{source}: nozzle node "), F.col("id").cast("string"), F.lit(what)))
    parent = F.when(F.col("item").isNull(), fault(" names no drawn item")).when(F.col("item_kind").isin(*THROUGH), fault(" folds into something that is no plant item")).otherwise(tx.node_label(F.col("page"), F.col("item")))
    name = F.when(F.col("kind").isin(*THROUGH), F.lit(None).cast("string")).when(F.col("kind") == "nozzle", parent).otherwise(tx.node_label(F.col("page"), F.col("id")))
    return n.select("page", "id", name.alias("terminal"))


def _linked(pairs: DataFrame, source: str) -> DataFrame:
    """pairs(page, a, b, a_out, b_out, sources, numbers, edges) with a < b -> links."""
    known = F.coalesce(F.col("a_out") != F.col("b_out"), F.lit(False))
    down = known & ~F.col("a_out")
    edges = F.array_join(F.transform("edges", lambda e: e.cast("string")), ", ")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return pairs.select(
        F.col("page").alias("sheet"), F.when(down, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(down, F.col("a")).otherwise(F.col("b")).alias("target"), F.when(known, "known").otherwise("unknown").alias("direction"),
        F.when(known, some("sources")).alias("direction_sources"), some("numbers").alias("line_numbers"), F.lit(1.0).alias("confidence"), F.concat(F.lit(f"{COMPONENT}: topology {source} edges "), edges).alias("provenance"),
    )


def connectivity(nodes: DataFrame, edges: DataFrame, source: str = "artifact") -> DataFrame:
    """Ground-truth links: edges between two items one by one; items around the same pass-through geometry pair by pair, each
    pair with all that lies inside. A direction holds if both ends agree within themselves and differ from each other."""
    names = terminal_names(nodes, source)
    e = edges.filter(F.coalesce("style", F.lit("solid")) != "internal").withColumn("line_numbers", F.coalesce("line_numbers", F.array().cast("array<string>")))
    for end in "ab":
        t = names.select("page", F.col("id").alias(end), F.col("terminal").alias(f"t{end}"), F.lit(True).alias(f"has_{end}"))
        e = e.join(t, ["page", end], "left")
    sound = F.when(F.col("has_a") & F.col("has_b"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{source}: edge "), F.col("pos").cast("string"), F.lit(" names an unknown node"))))
    e = e.filter(sound)
    directed = F.col("direction").isin("ab", "ba")
    out = lambda end: F.when(directed, (F.col("direction") == "ab") == F.lit(end == "a"))
    src = F.when(directed, F.array_compact(F.array("direction_source"))).otherwise(F.array().cast("array<string>"))
    d = e.filter("ta IS NOT NULL AND tb IS NOT NULL AND ta <> tb")
    swap = F.col("ta") > F.col("tb")
    direct = d.select("page", F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), F.when(swap, out("b")).otherwise(out("a")).alias("a_out"), F.when(swap, out("a")).otherwise(out("b")).alias("b_out"), src.alias("sources"), F.array_sort(F.array_distinct("line_numbers")).alias("numbers"), F.array("pos").alias("edges"))

    inner = e.filter("ta IS NULL AND tb IS NULL")
    rim = e.filter("(ta IS NULL) <> (tb IS NULL)").withColumn("through", F.when(F.col("ta").isNull(), F.col("a")).otherwise(F.col("b")))
    rim = rim.withColumn("terminal", F.coalesce("ta", "tb")).withColumn("out", F.when(F.col("ta").isNotNull(), out("a")).otherwise(out("b")))
    comp = components_by(inner.select("page", "a", "b").unionByName(rim.select("page", F.col("through").alias("a"), F.col("through").alias("b"))), ["page"])
    inside = inner.join(comp.withColumnRenamed("id", "a"), ["page", "a"]).groupBy("page", "component").agg(F.collect_list("pos").alias("in_edges"), F.flatten(F.collect_list("line_numbers")).alias("in_numbers"))
    ends = rim.join(comp.withColumnRenamed("id", "through"), ["page", "through"]).groupBy("page", "component", "terminal").agg(
        F.when((F.count_distinct("out") == 1) & (F.count("out") == F.count("*")), F.first("out")).alias("out"), F.flatten(F.collect_list(src)).alias("src"), F.flatten(F.collect_list("line_numbers")).alias("nums"), F.collect_list("pos").alias("es"),
    )
    pairs = ends.alias("x").join(ends.alias("y"), ["page", "component"]).filter("x.terminal < y.terminal").join(inside, ["page", "component"], "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    merged = lambda t, *cs: F.array_sort(F.array_distinct(F.concat(*[none(F.col(c), t) for c in cs])))
    meeting = pairs.select("page", F.col("x.terminal").alias("a"), F.col("y.terminal").alias("b"), F.col("x.out").alias("a_out"), F.col("y.out").alias("b_out"), merged("string", "x.src", "y.src").alias("sources"), merged("string", "x.nums", "y.nums", "in_numbers").alias("numbers"), merged("int", "x.es", "y.es", "in_edges").alias("edges"))
    return _linked(direct.unionByName(meeting), source)


def degraded_labels(symbols: DataFrame, lines: DataFrame, texts: DataFrame, links: DataFrame, transforms, width: int, height: int):
    """Labels moved as their sheet's pixels were; what left the canvas goes, and links to it go with it."""
    from orthoplan.operators.raster import degrade

    w, h = F.lit(width), F.lit(height)
    moved = lambda d: d.withColumn("bbox", degrade.moved_box(F.col("bbox"), transforms, w, h))
    s = moved(symbols)
    gone = s.filter("bbox IS NULL").select("sheet", "id")
    kept = lines.withColumn("polyline", F.transform("polyline", lambda p: degrade.moved(p, transforms, w, h))).filter(g.visible(F.col("polyline"), w, h))
    for end in ("source", "target"):
        links = links.join(gone.withColumnRenamed("id", end), ["sheet", end], "left_anti")
    return s.filter("bbox IS NOT NULL"), kept, moved(texts).filter("bbox IS NOT NULL"), links


def examples(symbols: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Every label as a pass verdict: symbols, then lines, then texts."""
    out = None
    for k, (kind, d) in enumerate((("symbol", symbols), ("line", lines), ("text", texts))):
        d = d.withColumns({"kind": F.lit(kind), "kind_ord": F.lit(k), "verdict": F.lit("pass")})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
