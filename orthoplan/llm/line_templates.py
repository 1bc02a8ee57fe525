"""Line dedup by a fixed-depth tree of line templates, with DataFrame functions alone.

Every line is brought into log form: white space collapsed, each token that holds a digit replaced by a wildcard. The
tree sends a line down by its number of tokens, then by its leading tokens (DEPTH of them). In a leaf with lines of
several forms, a position's token stays in the template if at least min_docs documents have it there; other positions
are generalised to wildcards. A line whose template would keep less than SHARE of its positions is a template of its
own. A template found in at least min_docs documents is recurring: its lines stay in the first of them (smallest id)
and are dropped from all others. Lines of fewer than min_tokens tokens say too little and stay.

min_docs is a count, so in a corpus large enough a field's frequent values reach it and split their template by value.
With constant_share a token stays only if it also has that share of its leaf's documents, which holds at every size.

Identity: a form and a template are named by two independent 64-bit hashes each, a row by its id and a hash of its text.

Skew: a recurring line is one row of counts before anything is joined; counts are aggregated before the shuffle, and the
joins back to lines and tokens are plain joins that adaptive execution splits. Only lines of leaves with several forms are
taken apart into tokens, one line for each form.

Nulls: a null text stays null, has no lines and drops none; null ids come after all others in the choice of the first
document. Rows equal in id and text count as one document and get the same answer. A text left without lines is empty.
Empty texts stay. Texts are read whole, a row for each line. An empty table gives an empty result. Other columns pass
through renamed by their place, so their names cannot clash with internal ones; n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplan.llm import scratch

DEPTH = 3
SHARE = 0.7
ADDED = ("n_lines", "n_dropped")
#: What names a row, and a line's form.
ROW, FORM = ["doc_id", "k"], ["h", "h2"]
_FIRST = "struct(doc_id IS NULL AS unknown, doc_id, k)"


def form(line):
    """The line in log form. Most lines hold neither odd white space nor a digit, and are only searched for them."""
    odd = reduce(or_, [line.contains(c) for c in ("  ", "\t", "\x0b", "\x0c", "\r")])
    one = F.trim(F.when(odd, F.regexp_replace(line, r"[\x09-\x0D ]+", " ")).otherwise(line))
    return F.when(one.rlike("[0-9]"), F.regexp_replace(one, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(one)


def n_tokens(m):
    return F.length(m) - F.length(F.replace(m, F.lit(" "))) + 1


def named(*values) -> tuple:
    """Two independent hashes."""
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["k"] == b["k"])


def lines_of(docs: DataFrame, min_tokens: int) -> DataFrame:
    """docs(doc_id, k, text) -> a row for each line that is long enough: k, doc_id, idx, h, h2 (its form), leaf.

    The form is exploded from an array of one, so that it is computed once and not again for each use.
    """
    rows = docs.select("k", "doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    rows = rows.select("k", "doc_id", "idx", F.explode(F.array(form(F.col("line")))).alias("m"))
    m = F.col("m")
    h, h2 = named(m)
    return rows.filter(n_tokens(m) >= min_tokens).select("k", "doc_id", "idx", h.alias("h"), h2.alias("h2"), F.xxhash64(n_tokens(m), F.substring_index(m, " ", DEPTH)).alias("leaf"))


def templates(docs: DataFrame, units: DataFrame, min_docs: int, constant_share: float) -> DataFrame:
    """units(h, h2, leaf, docs, first, rep) -> h, h2, docs, first of its template, for the forms of leaves that hold several."""
    leaves = units.groupBy("leaf").agg(F.count("*").alias("forms"), F.sum("docs").alias("d")).filter(f"forms > 1 AND d >= {min_docs}")
    leaves = leaves.select("leaf", F.greatest(F.lit(float(min_docs)), F.col("d") * constant_share).alias("least"))
    pending = units.join(leaves, "leaf")
    places = pending.groupBy(F.col("rep.doc_id").alias("doc_id"), F.col("rep.k").alias("k")).agg(F.collect_list(F.struct(*FORM, "leaf", "least", "docs", F.col("rep.idx").alias("idx"))).alias("p"))
    text_lines = docs.select(*ROW, F.split("text", "\n").alias("ls"))
    found = text_lines.join(places.hint("merge"), same_row(text_lines, places)).select("ls", F.explode("p").alias("p"))
    tokens = F.split(form(F.element_at("ls", F.col("p.idx") + 1)), " ")
    tokens = found.select("p.*", F.posexplode(tokens).alias("pos", "token")).select(*FORM, "leaf", "least", "docs", "pos", F.xxhash64("token").alias("t"))
    tokens = scratch.written(tokens.groupBy(*FORM, "leaf", "pos", "t").agg(F.first("docs").alias("docs"), F.first("least").alias("least")), "form-tokens")
    common = tokens.groupBy("leaf", "pos", "t").agg(F.sum("docs").alias("d"), F.first("least").alias("least")).filter("d >= least").select("leaf", "pos", "t", F.lit(True).alias("stays"))
    own = tokens.join(common, ["leaf", "pos", "t"], "left").select(*FORM, "leaf", "pos", F.when(F.col("stays"), F.col("t")).alias("t"))
    own = own.groupBy(*FORM, "leaf").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("t", F.lit(0)).alias("t")))).alias("ts"), (F.count("t") / F.count("*")).alias("share"))
    t, t2 = named("leaf", "ts")
    shared = F.col("share") >= SHARE
    of = own.select(*FORM, F.when(shared, t).otherwise(F.col("h")).alias("tid"), F.when(shared, t2).otherwise(F.col("h2")).alias("tid2"))
    of = scratch.written(of.join(units.select(*FORM, "docs", "first"), FORM), "templates")
    scratch.removed(docs.sparkSession, tokens)
    groups = of.groupBy("tid", "tid2").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
    return of.select(*FORM, "tid", "tid2").join(groups, ["tid", "tid2"]).select(*FORM, "docs", "first")


def dropped_lines(docs: DataFrame, min_docs: int, min_tokens: int, constant_share: float) -> DataFrame:
    """docs(doc_id, k, text) -> doc_id, k, dropped: the numbers of the lines that go."""
    lines = scratch.written(lines_of(docs, min_tokens), "lines")
    once = lines.groupBy(*FORM, *ROW).agg(F.min("idx").alias("idx"), F.first("leaf").alias("leaf"))
    units = once.groupBy(*FORM).agg(F.first("leaf").alias("leaf"), F.count("*").alias("docs"), F.min(F.expr(_FIRST)).alias("first"), F.min(F.struct("k", "doc_id", "idx")).alias("rep"))
    units = scratch.written(units, "forms")
    general = templates(docs, units, min_docs, constant_share)
    single = units.join(general.select(*FORM), FORM, "left_anti").select(*FORM, "docs", "first")
    recurring = single.unionByName(general).filter(F.col("docs") >= min_docs).select(*FORM, "first")
    others = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k") == F.col("first.k")))
    return lines.join(recurring, FORM).filter(others).groupBy(*ROW).agg(F.collect_list("idx").alias("dropped"))


def deduplicated(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, constant_share: float = 0.0) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns, text without the dropped lines, + n_lines, n_dropped."""
    keep = {c: f"in{i}" for i, c in enumerate(docs.columns) if c.lower() not in ADDED}
    rest = [v for c, v in keep.items() if c.lower() != "text"]
    d = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in keep.items() if v in rest], F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("k"))
    drops = dropped_lines(d.select(*ROW, "text").filter("text IS NOT NULL"), min_docs, min_tokens, constant_share)
    ls = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(1), F.size(ls)), F.transform("dropped", lambda i: i + 1))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(ls, i)), "\n"))
    out = d.join(drops.hint("merge"), same_row(d, drops), "left").select(*rest, "text", "dropped")
    counts = (F.when(F.col("text").isNull(), 0).otherwise(F.size(ls)).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*[(F.col(v) if v in rest else text).alias(c) for c, v in keep.items()], *counts)
