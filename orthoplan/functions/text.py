"""Tags, labels and literals as Column expressions, and the few Python functions that SQL has no equal for."""

from __future__ import annotations

import json
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

OFF_PAGE = "PipeOffPageConnector"
# Graph labels of equipment types of several words.
LABELS = {"check_valve": "CheckValve", "control_valve": "ControlValve", "heat_exchanger": "HeatExchanger", "relief_valve": "ReliefValve"}


def node_tag(role: Column, labels: Column, tag: Column, detection_id: Column) -> Column:
    """The name of a plant item: an off-page connector's by its first label, else the tag, else by the detection."""
    first = F.when(F.size(labels) > 0, F.element_at(labels, 1))
    return F.when(role == OFF_PAGE, F.concat(F.lit("OPC-"), F.coalesce(first, detection_id))).otherwise(F.coalesce(tag, F.concat(F.lit("UNTAGGED-"), detection_id)))


def node_name(role: Column, labels: Column, tag: Column, detection_id: Column) -> Column:
    several = F.when(F.size(labels) > 0, F.array_join(labels, " / ")).otherwise(F.lit("off-page connector"))
    return F.when(role == OFF_PAGE, several).otherwise(node_tag(role, labels, tag, detection_id))


def evidence_ref(source: Column, evidence_id: Column, propagated: Column) -> Column:
    ref = F.concat_ws(":", source, evidence_id)
    return F.when(propagated, F.concat(F.lit("propagated("), ref, F.lit(")"))).otherwise(ref)


def combined_evidence(evidence: Column, tag_id: Column) -> Column:
    return F.concat(evidence, F.coalesce(F.concat(F.lit("; tagged by text "), tag_id), F.lit("")))


def swaps(raw: Column, fixed: Column) -> Column:
    """The places at which a repaired string differs: `r->c at index i`."""
    n = F.least(F.length(raw), F.length(fixed))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def at(s, i):
        return F.substring(s, i, F.lit(1))

    changed = F.filter(places, lambda i: at(raw, i) != at(fixed, i))
    return F.array_join(F.transform(changed, lambda i: F.concat(at(raw, i), F.lit("->"), at(fixed, i), F.lit(" at index "), (i - 1).cast("string"))), ", ")


def capitalized(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, F.lit(1), F.lit(1))), F.lower(F.substring(s, F.lit(2), F.length(s))))


def graph_label(equipment_type: Column) -> Column:
    several = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(several[equipment_type], capitalized(equipment_type))


def escaped(s: Column) -> Column:
    """For HTML and SVG text and attributes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def has_cjk(s: Column) -> Column:
    return s.rlike("[一-鿿]")


def node_label(sheet: Column, node_id: Column) -> Column:
    return F.concat(F.lit("p"), sheet.cast("string"), F.lit("-node"), node_id.cast("string"))


@F.pandas_udf(DoubleType())
def round1(x: pd.Series) -> pd.Series:
    """One decimal, half-even on the exact binary value; SQL's rounding works on the decimal form."""
    return x.map(lambda v: None if v != v else round(v, 1))


@F.pandas_udf(StringType())
def json_literal(s: pd.Series) -> pd.Series:
    """A string as a JSON literal with non-ASCII characters as they are."""
    return s.map(lambda v: None if v is None else json.dumps(v, ensure_ascii=False))


@F.pandas_udf(StringType())
def profile_key(name: pd.Series, version: pd.Series) -> pd.Series:
    """Folder name of a profile: both parts percent-quoted (a blank becomes %20, which SQL's url_encode does not do)."""
    return pd.Series([quote(n, safe="") + "@" + quote(v, safe="") for n, v in zip(name, version)])
