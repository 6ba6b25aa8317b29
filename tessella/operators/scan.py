"""Parallel scans: running values, neighbours and folds over ordered rows, however many one key has.

A window over a key is one task's work.  Here the rows of a key are dealt into
buckets by a column that grows with their order (a time or an index, divided by a
width), and each operator runs twice: first within each bucket, then over one small
row a bucket, whose result is joined back to the bucket's rows.  A fold goes the
same way if its state is one of a few: a bucket's events together are a table from the
state before to the state after, and tables compose.

``key`` may be hot; ``bucket`` is what spreads it.  Rows of one key and bucket are
one task's work, so its width is chosen to hold a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a bucket of indexes, and of one of times in ms.
INDEXES, TIMES = 10_000, 3_600_000


def bucket_of(column: Column, width: int) -> Column:
    """The bucket of an index or a time; grows with it."""
    return F.floor(column / width).cast("long")


def running(rows: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[Column | str], **sums: Column) -> DataFrame:
    """``rows`` with running sums of columns up to and including each row, named as given.

    The order must be total within a bucket, or rows that tie get their sums in any order.
    """
    dealt = rows.withColumn("_bucket", bucket)
    own = W.partitionBy(*key, "_bucket")
    inside = dealt.select("*", *(F.sum(c).over(own.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)).alias(f"_own_{n}") for n, c in sums.items()))
    totals = dealt.groupBy(*key, "_bucket").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*key, "_bucket", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_all_{n}") for n in sums))
    joined = _joined(inside, offsets, [*key, "_bucket"])
    return joined.select(*(joined[c] for c in rows.columns), *((F.col(f"_own_{n}") + F.col(f"_all_{n}")).alias(n) for n in sums))


def _joined(rows: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """``small`` has one row for each of ``rows``' keys; null keys meet each other."""
    named = small.select(*(F.col(c).alias(f"_s{k}") for k, c in enumerate(on)), *(c for c in small.columns if c not in on))
    same = F.lit(True)
    for k, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    return rows.join(named, same).drop(*(f"_s{k}" for k in range(len(on))))


def numbered(rows: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """``rows`` with their number, from 1, in each key's order."""
    return running(rows, key, bucket, order, **{name: F.lit(1).cast("long")})


def neighbour(rows: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[str], columns: dict[str, str], ahead: bool = False) -> DataFrame:
    """``rows`` with columns of the row before (or ``ahead``): ``columns`` names them by their new names.

    ``order`` names columns that together tell a key's rows apart.
    """
    step, sign = (F.lead, 1) if ahead else (F.lag, -1)
    there = F.struct(F.lit(True).alias("_is"), *(F.col(c).alias(n) for n, c in columns.items()))
    dealt = rows.withColumn("_bucket", bucket).withColumn("_there", there)
    inside = dealt.withColumn("_near", step("_there").over(W.partitionBy(*key, "_bucket").orderBy(*order)))
    ends = dealt.groupBy(*key, "_bucket").agg((F.min_by if ahead else F.max_by)("_there", F.struct(*order)).alias("_end"))
    far = ends.select(*key, "_bucket", step("_end").over(W.partitionBy(*key).orderBy("_bucket")).alias("_far"))
    joined = _joined(inside, far, [*key, "_bucket"])
    near = F.coalesce("_near", "_far")
    return joined.select(*(joined[c] for c in rows.columns), *(near[n].alias(n) for n in columns))


def parts_of(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Parts of sorted rows of one key each, with whether a part begins the key."""
    last: tuple | None = None
    for rows in batches:
        changed = np.zeros(max(0, rows.num_rows - 1), dtype=bool)
        for c in key:
            a, b = rows.column(c).slice(1), rows.column(c).slice(0, max(0, rows.num_rows - 1))
            changed |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), rows.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False) if rows.num_rows else ():
            own = tuple(rows.column(c)[start].as_py() for c in key)
            yield own != last, rows.slice(start, end - start)
            last = own


def _with(rows: pa.RecordBatch, columns: Sequence[str], **more: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *(pa.array(v, pa.list_(pa.int64()) if n == "_table" else pa.int64()) for n, v in more.items())], names=[*columns, *more])


def folded(rows: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[str], value: str, states: int, step: Callable[[np.ndarray, int], np.ndarray], start: int = 0) -> DataFrame:
    """``rows`` with the fold's state ``before`` and ``after`` each row.

    States are 0 to ``states`` - 1 and ``start`` is the first; ``step`` takes an array of states and a row's value
    (an integer that is not null) to the states after it.  The first pass folds every bucket from all states at
    once; states that have met go on as one, so it soon costs little more than one fold.
    """
    dealt = rows.withColumn("_bucket", bucket)
    own, types = [*key, "_bucket"], {f.name: f.dataType.simpleString() for f in dealt.schema}
    names, kept = ", ".join(f"`{c}` {types[c]}" for c in own), list(rows.columns)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, live, held = np.arange(states), np.arange(states), None  # live[at[s]]: where state s has come to
        for begins, part in parts_of(batches, own):
            if begins:
                if held is not None:
                    yield _with(held, own, _table=[live[at].tolist()])
                at, live, held = np.arange(states), np.arange(states), part.slice(0, 1)
            for v in part.column(value).to_pylist():
                live = step(live, v)
                if len(live) > 1:
                    live, merged = np.unique(live, return_inverse=True)
                    at = merged[at]
        if held is not None:
            yield _with(held, own, _table=[live[at].tolist()])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for begins, part in parts_of(batches, key):
            state, found = start if begins else state, []
            for table in part.column("_table"):
                found.append(state)
                state = table[state].as_py()
            yield _with(part, own, _state=found)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.array([start])
        for begins, part in parts_of(batches, own):
            if begins:
                state = np.array([part.column("_state")[0].as_py()])
            before, after = [], []
            for v in part.column(value).to_pylist():
                before.append(int(state[0]))
                state = step(state, v)
                after.append(int(state[0]))
            yield _with(part, kept, before=before, after=after)

    made = dealt.select(*own, *(c for c in dict.fromkeys([*order, value]) if c not in own)).repartition(*own).sortWithinPartitions(*own, *order).mapInArrow(tables, f"{names}, _table array<long>")
    first = made.repartition(*key).sortWithinPartitions(*own).mapInArrow(starts, f"{names}, _state long")
    again = _joined(dealt, first, own).repartition(*own).sortWithinPartitions(*own, *order)
    return again.mapInArrow(walked, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", before long, after long")
