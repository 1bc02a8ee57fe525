"""The incremental forms: reviewer minutes from a stream of events, and verdicts upserted batch by batch.

Batch recomputation sorts the whole history again, so a late event changes earlier minutes. The stream cannot: events
later than the watermark are left to the next recomputation (operators.review), which stays the truth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orthoplan.operators import review
from orthoplan.sources.records import parsed_events

LINES = "document STRING, line_no LONG, value STRING"


def events(lines: DataFrame) -> DataFrame:
    """A stream of log lines as events; unreadable ones go (the batch reader counts them)."""
    return parsed_events(lines).filter("at IS NOT NULL")


def minutes(stream: DataFrame, idle_minutes: float = review.IDLE_MINUTES, late: str = "10 minutes") -> DataFrame:
    """Of each document's timeline: whenever an event closes an interval, its sheet's minutes so far. The state is the last event
    and a number for each sheet."""
    idle = int(idle_minutes * 60_000_000)

    def close(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last_line, last_sheet, sheets, micros = state.get if state.exists else (None, None, None, [], [])
        total = dict(zip(sheets, micros))
        rows = pd.concat(list(batches)).sort_values(["at", "line_no"])
        changed = {}
        for at, line, sheet in zip(rows["at"], rows["line_no"], rows["sheet"]):
            now = at.value // 1000
            if last_at is not None and (now, line) < (last_at, last_line):
                continue
            if last_at is not None and now - last_at <= idle:
                changed[last_sheet] = total[last_sheet] = total.get(last_sheet, 0) + now - last_at
            last_at, last_line, last_sheet = now, int(line), int(sheet)
        state.update((last_at, last_line, last_sheet, list(total), list(total.values())))
        yield pd.DataFrame([(key[0], s, m / 6e7) for s, m in changed.items()], columns=["document", "sheet", "minutes"])

    return stream.withWatermark("at", late).groupBy("document").applyInPandasWithState(
        close, "document string, sheet int, minutes double", "last_at long, last_line long, last_sheet int, sheets array<int>, micros array<long>", "update", GroupStateTimeout.NoTimeout
    )


def windows(stream: DataFrame, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and distinct sheets of each document in windows of event time."""
    return stream.withWatermark("at", late).groupBy("document", F.window("at", length)).agg(F.count("*").alias("events"), F.approx_count_distinct("sheet").alias("sheets"))


def upsert(path: str):
    """For writeStream.foreachBatch: the verdict table at path with the batch's verdicts in place of older ones.

    Each version is a folder of its own, named by the batch, so a repeated batch writes the same result again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs
        root = fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName()[1:]) for s in files.listStatus(root)] if files.exists(root) else []
        before = max((n for n in done if n < number), default=None)
        log = batch if before is None else spark.read.parquet(f"{path}/v{before}").unionByName(batch, allowMissingColumns=True)
        review.latest_verdicts(log).write.mode("overwrite").parquet(f"{path}/v{number}")

    return apply
