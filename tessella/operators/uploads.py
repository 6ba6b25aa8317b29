"""Uploads: which parts have come, and how far the guarded stages are.

``events`` has upload_id, event_id, ts_ms, kind, part, stage and expected, all from an
append-only log.  Parts are sets, so their state needs no fold: those after the last
abort count, each once.  Status is a fold, as a stage counts only if it expects the
number of stages that have counted before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.scan import parts_of

EVENTS = "upload_id long, event_id long, ts_ms long, kind string, part int, stage string, expected int"
STATE = "upload_id long, status string, stage_seq int, heartbeat_at long"


def received_parts(events: DataFrame) -> DataFrame:
    """(upload_id, parts, received, missing, resume_at) of each upload that has a start: its parts since the last abort, and the first to send again (null: none).

    The last ``start`` says how many parts there are; parts outside 1 to that number do not count.
    """
    at = F.struct("ts_ms", "event_id")
    marks = events.groupBy("upload_id").agg(F.max_by(F.when(F.col("kind") == "start", F.col("part")), F.when(F.col("kind") == "start", at)).alias("parts"), F.max(F.when(F.col("kind") == "abort", at)).alias("aborted")).where("parts is not null")
    # An upload's parts are told apart before they meet its marks, so a part that is sent again and again is one row.
    own = events.where("kind = 'part'").groupBy("upload_id", "part").agg(F.max(at).alias("at"))
    came = own.join(marks, "upload_id").where(F.col("part").between(1, F.col("parts")) & (F.col("aborted").isNull() | (F.col("at") > F.col("aborted"))))
    sets = came.groupBy("upload_id").agg(F.collect_set("part").alias("came"))
    out = marks.join(sets, "upload_id", "left").withColumn("came", F.coalesce("came", F.array().cast("array<int>")))
    every = F.when(F.col("parts") > 0, F.sequence(F.lit(1), F.greatest("parts", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("missing", F.array_except(every, F.col("came")))
    return out.select("upload_id", "parts", F.size("came").alias("received"), "missing", F.get("missing", F.lit(0)).alias("resume_at"))


def upload_states(events: DataFrame) -> DataFrame:
    """Status of each upload (``STATE``): a stage of the expected number moves it on, a late failure or one after a cancellation does not count."""
    ordered = events.select("upload_id", "event_id", "ts_ms", "kind", "stage", "expected").repartition("upload_id").sortWithinPartitions("upload_id", "ts_ms", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, status, seq, beat = None, "uploaded", 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([status]), pa.array([seq], pa.int32()), pa.array([beat], pa.int64())], names=["upload_id", "status", "stage_seq", "heartbeat_at"])

        for begins, part in parts_of(batches, ["upload_id"]):
            if begins:
                if own is not None:
                    yield row()
                own, status, seq, beat = part.column("upload_id")[0].as_py(), "uploaded", 0, None
            for ts, kind, stage, expected in zip(*(part.column(c).to_pylist() for c in ("ts_ms", "kind", "stage", "expected")), strict=True):
                if kind == "stage" and expected == seq:
                    status, seq, beat = stage, seq + 1, ts
                elif kind == "fail" and status != "cancelled" and expected in (None, seq):
                    status, beat = "error", ts
                elif kind == "cancel":
                    status = "cancelled"
                elif kind == "heartbeat":
                    beat = ts
        if own is not None:
            yield row()

    return ordered.mapInArrow(run, STATE)
