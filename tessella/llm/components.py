"""Groups compared block by block, and connected components, for links between rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import dropped, written

#: Members of a block; a task holds two blocks of one group at a time.
BLOCK = 512


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between positions a and b of ``ids`` as stars: each linked id and the least id of its component."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))  # positions by ascending id, so that the least label is the least id
    a, b = place[a], place[b]
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[order][moved], ids[order][label[moved]]


def compare_groups(members: DataFrame, payload: list[str], links: Callable[[list[np.ndarray | list]], tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> DataFrame:
    """Distinct links (id, root) found inside groups.

    ``members`` has g (group), n (members of the group), id and the payload.  A
    large group is split into blocks, and each pair of blocks is a unit of work
    of its own, so that no task holds a whole group.  ``links`` gets the
    payload's columns of a unit's rows and returns the positions it links; of
    those only a spanning star a component leaves the task, never all pairs.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("id"), blocks)).otherwise(0).cast("int")
    rows = members.select("g", "id", *payload, blocks.alias("blocks"), own.alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", *payload)
    sorted_ = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(1 + len(payload))]
        key = None

        def unit() -> tuple[np.ndarray, np.ndarray] | None:
            if len(held[0]) < 2:
                return None
            ids = np.array(held[0], dtype=np.int64)
            a, b = links(held[1:])
            return forest(ids, a, b) if len(a) else None

        for batch in batches:
            out_a, out_b = [], []
            names = ["g", "i", "j", "id", *payload]
            for g, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (g, i, j) != key:
                    if found := unit():
                        out_a.append(found[0])
                        out_b.append(found[1])
                    key, held = (g, i, j), [[] for _ in range(1 + len(payload))]
                for column, value in zip(held, rest, strict=True):
                    column.append(value)
            if out_a:
                yield pa.RecordBatch.from_pydict({"id": np.concatenate(out_a), "root": np.concatenate(out_b)})
        if found := unit():
            yield pa.RecordBatch.from_pydict({"id": found[0], "root": found[1]})

    return sorted_.mapInArrow(run, "id long, root long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (id, root): the least id that each can reach.

    Labels go along the links and then jump to their label's label, so a chain
    of length n takes about log n rounds.  Each round is a table in the shared
    folder.
    """
    both = written(links.select("id", "root").union(links.select(F.col("root").alias("id"), F.col("id").alias("root"))).where("id <> root").distinct(), "links")
    labels = written(both.groupBy("id").agg(F.min("root").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    # Each round's table goes once the next is written.
    while True:
        near = both.join(labels.select(F.col("id").alias("root"), F.col("component").alias("c")), "root").groupBy("id").agg(F.min("c").alias("c"))
        met = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("c"))
        jumped = met.join(labels.select(F.col("id").alias("c"), F.col("component").alias("cc")), "c", "left").select("id", "old", F.least("c", F.coalesce("cc", "c")).alias("component"))
        new = written(jumped, "labels")
        dropped(labels)
        labels = new
        if not new.where("component <> old").limit(1).count():
            dropped(both)
            return new.select("id", "component")
