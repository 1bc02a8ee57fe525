"""A detector trained on labelled folders: crops of all of them, one prototype a class and direction, a verified artifact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplan.operators.raster import detector, normalize
from orthoplan.plans import digitize
from orthoplan.plans.evaluation import EvalSet
from orthoplan.plans.tables import written
from orthoplan.sources import annotations, bundles
from orthoplan.sources.profile import Profile


def crops_of(spark: SparkSession, root: str, profile: Profile) -> tuple[DataFrame, dict]:
    """The labelled symbols of one folder in the normalized frame, and what the folder gave."""
    truth = EvalSet(spark, root if "://" in root else f"file://{root}", profile)
    norm = written(normalize.normalized_sheets(truth.sheets), "normalized")
    found = written(detector.crops(norm, annotations.symbols(digitize.in_normalized_frame(truth.sheets, norm))), "crops")
    return found, {"root": root, "sheets": norm.count(), "examples": found.count()}


def train(spark: SparkSession, roots: list[str], profile: Profile, out: str) -> dict:
    """Clean folders and degraded ones together, so that thresholds allow for what degradation does. Returns the manifest."""
    if not roots:
        raise ValueError("training needs at least one labelled folder")
    parts = [crops_of(spark, r, profile) for r in roots]
    every = reduce(DataFrame.unionByName, [c for c, _ in parts])
    return bundles.put(out, detector.gathered(detector.trained(every.filter(F.col("symbol_class").isNotNull()))), profile.identity(), [s for _, s in parts])
