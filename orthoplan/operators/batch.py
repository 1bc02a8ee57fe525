"""Resumable runs: what is still to do, the record of failures, gaps and the report."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.7


class StateError(ValueError):
    """Persisted state that a run cannot go on from."""


def pending(sheets: DataFrame, state: DataFrame) -> DataFrame:
    """Sheets without a succeeded state; failed ones are tried again. One anti join."""
    return sheets.join(state.filter("status = 'succeeded'").select("sheet"), "sheet", "left_anti")


def attempted(sheets: DataFrame, digitize, schema: str) -> DataFrame:
    """digitize(row dict) -> record dict (JSON) for each sheet; an error becomes a failed row with its reason."""

    def rows(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append((row["document"], int(row["sheet"]), "succeeded", None, json.dumps(digitize(row), ensure_ascii=False)))
                except Exception as e:  # one bad sheet never stops a run
                    out.append((row["document"], int(row["sheet"]), "failed", f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(out, columns=["document", "sheet", "status", "reason", "record"])

    return sheets.mapInPandas(rows, schema)


STATE = "document string, sheet int, status string, reason string, record string"


def fingerprint(profile: dict) -> str:
    """Of a profile's whole content."""
    return hashlib.sha256(json.dumps(profile, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def manifest(document: str, sheets: list[int], profile: dict, config: dict) -> dict:
    identity = {"name": profile["name"], "version": profile["version"], "content_fingerprint": fingerprint(profile)}
    return {"document": document, "sheets": sheets, "profile": identity, "config": config}


def check_manifest(found: dict | None, now: dict) -> None:
    """State belongs to one document, profile and configuration."""
    if found is not None and found != now:
        raise StateError("the state belongs to another run: " + ", ".join(sorted(k for k in now if found.get(k) != now[k])) + " differ")


def gaps(texts: DataFrame, symbols: DataFrame, lines: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Unresolved texts and detections under the threshold: texts, then symbols, then lines (section)."""
    low = F.col("confidence") < threshold
    t = texts.filter(~F.col("resolved") | low).withColumn("kind", F.when(~F.col("resolved"), "unresolved-text").otherwise("low-confidence")).withColumn("section", F.lit(1))
    s = symbols.filter(low).withColumn("kind", F.lit("low-confidence")).withColumn("section", F.lit(2))
    n = lines.filter(low).withColumn("kind", F.lit("low-confidence")).withColumn("section", F.lit(3))
    return t.unionByName(s, allowMissingColumns=True).unionByName(n, allowMissingColumns=True)


def coverage(sheets: DataFrame, state: DataFrame, resumed: DataFrame) -> DataFrame:
    """Counts of a run: sheets(document, sheet), state(document, sheet, status), resumed(document, sheet): skipped ones."""
    key = ["document", "sheet"]
    j = sheets.select(*key).join(resumed.select(*key).withColumn("skipped", F.lit(True)), key, "left").join(state.select(*key, "status"), key, "left")
    ok, skip = F.col("status") == "succeeded", F.col("skipped").isNotNull()
    return j.groupBy("document").agg(
        F.count("*").alias("total_sheets"), F.count_if(ok & ~skip).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(skip).alias("skipped_by_resume"), F.count_if(ok).alias("digitized"),
    )
