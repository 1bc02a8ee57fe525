"""Decoding of tag strings against a profile's grammar, with repairs of confusable characters.

Grammars are the users' own regular expressions, so they run under Python's re; Java's differ in digits and anchors.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplan.functions import text as tx

# Characters that reads confuse, the most variants tried, and confidence factors.
PAIRS = ["O0", "S5", "I1", "B8", "Z2"]
BUDGET = 65_536
CORRECTED, UNRESOLVED = 0.9, 0.5
OTHER = {a: b for p in PAIRS for a, b in (p, p[::-1])}


def variants(s: str) -> list[str] | None:
    """All strings that differ in confusable characters, or None beyond the budget."""
    if 2 ** sum(c in OTHER for c in s) > BUDGET:
        return None
    return ["".join(v) for v in itertools.product(*[(c, OTHER[c]) if c in OTHER else (c,) for c in s])]


def repairs(s: str, pattern: str) -> list[str] | None:
    found = variants(s)
    return None if found is None else sorted(v for v in found if v != s and re.fullmatch(pattern, v))


def classify(s: str, grammar: dict[str, str]) -> str | None:
    """The one class that the string fits or, if it fits none, the one that a repair of it fits."""
    fits = [c for c, p in grammar.items() if re.fullmatch(p, s)]
    if not fits:
        found = variants(s) or []
        fits = [c for c, p in grammar.items() if any(re.fullmatch(p, v) for v in found)]
    return fits[0] if len(fits) == 1 else None


def decoded(texts: DataFrame, grammar: dict[str, str]) -> DataFrame:
    """texts(string, text_class, confidence, provenance, raw_string, correction, ...) -> the same, decoded, + resolved, candidates.

    The grammar, a few patterns, travels in the function; each distinct (class, string) of a batch is tried once.
    """

    @F.pandas_udf("struct<kind:string,fits:array<string>>")
    def outcome(strings: pd.Series, classes: pd.Series) -> pd.DataFrame:
        seen: dict[tuple, tuple] = {}

        def of(s, c):
            pattern = grammar.get(c)
            if pattern is None:
                return "no grammar", []
            if re.fullmatch(pattern, s):
                return "exact", []
            fits = repairs(s, pattern)
            return ("degraded", []) if fits is None else (("none", "one")[len(fits)] if len(fits) < 2 else "many", fits)

        out = []
        for k in zip(strings, classes):
            if k not in seen:
                seen[k] = of(*k)
            out.append(seen[k])
        return pd.DataFrame(out, columns=["kind", "fits"])

    @F.pandas_udf("string")
    def shown(s: pd.Series) -> pd.Series:
        return s.map(repr)

    @F.pandas_udf("string")
    def listed(s: pd.Series) -> pd.Series:
        return s.map(lambda v: str(list(v)))

    d = texts.withColumn("_o", outcome("string", "text_class"))
    kind, fixed, quoted, cls = F.col("_o.kind"), F.try_element_at("_o.fits", F.lit(1)), shown("string"), F.col("text_class")
    fix = F.when(kind == "one", tx.swaps(F.col("string"), fixed))
    note = (
        F.when(kind == "exact", F.concat(F.lit("matches "), cls, F.lit(" grammar")))
        .when(kind == "no grammar", F.concat(F.lit("no grammar for class "), shown("text_class"), F.lit(" — cannot verify, unresolved")))
        .when(kind == "degraded", F.concat(quoted, F.lit(f" is too degraded to repair (more than {BUDGET} confusion-set variants) — unresolved")))
        .when(kind == "one", F.concat(F.lit("corrected "), quoted, F.lit(" -> "), shown(fixed), F.lit(" ("), fix, F.lit(") to match "), cls, F.lit(" grammar")))
        .when(kind == "none", F.concat(quoted, F.lit(" does not match "), cls, F.lit(" grammar and no confusion-set repair does — unresolved")))
        .otherwise(F.concat(quoted, F.lit(" has "), F.size("_o.fits").cast("string"), F.lit(" grammar-valid repairs "), listed("_o.fits"), F.lit(" — ambiguous, unresolved")))
    )
    d = d.withColumn("_note", note).withColumn("_fix", fix)
    resolved = kind.isin("exact", "one")
    new = {
        "raw_string": F.when(kind == "exact", F.col("raw_string")).otherwise(F.col("string")),
        "correction": F.when(kind == "exact", F.col("correction")).otherwise(F.col("_fix")),
        "resolved": resolved,
        "candidates": F.when(kind == "many", F.col("_o.fits")).otherwise(F.array().cast("array<string>")),
        "confidence": F.col("confidence") * F.when(kind == "exact", 1.0).when(kind == "one", CORRECTED).otherwise(UNRESOLVED),
        "provenance": F.struct(F.col("provenance.component").alias("component"), F.concat(F.col("provenance.evidence"), F.lit("; lexicon: "), F.col("_note")).alias("evidence")),
        "string": F.when(kind == "one", fixed).otherwise(F.col("string")),
    }
    return d.withColumns(new).drop("_o", "_note", "_fix")


def classified(reads: DataFrame, grammar: dict[str, str], column: str = "string") -> DataFrame:
    @F.pandas_udf("string")
    def cls(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else classify(v, grammar))

    return reads.withColumn("text_class", cls(column))
