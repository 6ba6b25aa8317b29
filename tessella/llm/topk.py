"""Exact top-k search by inner product (operator 9).

Vectors become integers, are sorted by descending length, packed into blocks
and written once, in runs, to the shared folder.  A rotation from the vectors' second moments (the right singular
vectors of all rows, from a 64 x 64 table that Spark sums) gathers their energy
in the leading coordinates.  A group of query blocks walks a run of vector blocks
from the longest down, read from the run's files: a block is passed over for a
query once length times length cannot reach its k-th score (later blocks of the
run are shorter still), the run ends when that holds for all, and a vector is
passed over once the partial sum over the leading coordinates plus the product of
the residual lengths (Cauchy-Schwarz) cannot.  What is left is scored exactly.

Groups and runs are independent tasks; each returns at most k rows a query.
Only queries are shuffled to them, so the shuffle grows with the vectors, and
what is read with how far the groups must walk.

Edge cases: vectors that are null, empty, of another length than most, or hold
null or non-finite components take no part; ties go to the smaller id; rows
that share the query's id count as its own row; fewer than k candidates give
fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm._shared import fresh_path

SCALE, K, EVERY = 256, 5, 50
#: Vectors and queries of a block.
BLOCK, QUERIES = 8_192, 512
#: Share of the energy that the leading coordinates hold.
ENERGY = 0.9
BLOCKS = "g long, kind int, top double, place long, ids binary, rows binary"
FOUND = "query_id long, vec_id long, score long"


def integers(table: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(i, v): usable vectors as floor(scale * x)."""
    bad = F.exists(F.col("x"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("x")).where(F.col("i").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select("i", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def moments(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of v v' over all rows; tasks send one partial sum each, Spark adds them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": np.arange(width * width, dtype=np.int32), "x": total.ravel()})

    sums = rows.select("v").mapInArrow(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")
    return sums.x.to_numpy().reshape(width, width)


def blocks(rows: DataFrame, width: int, size: int, kind: int, by_length: bool) -> DataFrame:
    """Rows packed into blocks of one g each; with ``by_length`` from the longest vectors down."""
    if by_length:
        squared = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("l", squared).repartitionByRange(n, F.desc("l")).sortWithinPartitions(F.desc("l"), "i")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 32
        ids, parts, count, group = [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal ids, parts, count, place
            x = np.concatenate(parts)
            top = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()))
            out = pa.RecordBatch.from_pydict({"g": [group], "kind": pa.array([kind], pa.int32()), "top": [top], "place": [place], "ids": [np.concatenate(ids).astype("<i8").tobytes()], "rows": [x.astype("<i8").tobytes()]})
            ids, parts, count, place = [], [], 0, place + 1
            return out

        for batch in batches:
            own, x, groups = np.asarray(batch.column("i")), _matrix(batch.column("v"), width), np.asarray(batch.column("g"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(own)]])
            for start, end in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if count and groups[start] != group:
                    yield flush()
                group = int(groups[start])
                for a in range(start, end, size):
                    ids.append(own[a : min(end, a + size)])
                    parts.append(x[a : min(end, a + size)])
                    count += len(ids[-1])
                    if count >= size:
                        yield flush()
        if count:
            yield flush()

    return rows.select("g", "i", "v").mapInArrow(packed, BLOCKS)


def run_of_blocks(folder: str, width: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(greatest length, ids, vectors) of a run's blocks, longest first, one in memory at a time."""
    fs, local = pafs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(local, allow_not_found=True)) if f.path.endswith(".parquet"))

    def of(path: str) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(1, columns=["top", "ids", "rows"]):
                for top, ids, x in zip(*(batch.column(c).to_pylist() for c in ("top", "ids", "rows")), strict=True):
                    yield top, np.frombuffer(ids, dtype="<i8"), np.frombuffer(x, dtype="<i8").reshape(-1, width)

    return heapq.merge(*map(of, files), key=lambda b: -b[0])


class Search:
    """A block of queries on its way through a run of vector blocks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, lead: int, k: int) -> None:
        self.ids, self.q, self.rotation, self.lead, self.k = ids, q.astype(np.float64), rotation, lead, k
        turned = self.q @ rotation
        self.head, self.rest = turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
        self.length = np.sqrt((self.q**2).sum(axis=1))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), ascending
        self.least = np.full(len(ids), -np.inf)  # the k-th score so far

    def open_at(self, top: float) -> bool:
        """Whether vectors no longer than ``top`` can still matter to any query."""
        return bool((top * self.length + 1e-9 * (1 + top * self.length) >= self.least).any())

    def see(self, ids: np.ndarray, v: np.ndarray, top: float) -> None:
        # What rounding can add to a bound.
        slack = 1e-9 * (1 + top * self.length)
        live = np.flatnonzero(top * self.length + slack >= self.least)
        if not len(live):
            return
        x = v.astype(np.float64)
        turned = x @ self.rotation
        rest = np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))
        bound = self.head[live] @ turned[:, : self.lead].T + self.rest[live, None] * rest[None, :]
        open_ = bound + slack[live, None] >= self.least[live, None]
        columns = np.flatnonzero(open_.any(axis=0))
        if not len(columns):
            return
        exact = top * float(self.length.max()) < 2**52
        scores = self.q[live] @ x[columns].T if exact else (self.q[live].astype(np.int64) @ v[columns].T)
        ids = ids[columns]
        for row, at in enumerate(live.tolist()):
            own = scores[row]
            usable = ids != self.ids[at]
            good = np.flatnonzero(usable & (own >= self.least[at]))
            if len(good) > self.k:
                kth = np.partition(own[good], len(good) - self.k)[len(good) - self.k]
                good = good[own[good] >= kth]
            if len(good):
                best = sorted([*self.found[at], *((-int(s), int(i)) for s, i in zip(own[good], ids[good], strict=True))])[: self.k]
                self.found[at] = best
                if len(best) == self.k:
                    self.least[at] = -best[-1][0]

    def result(self) -> pa.RecordBatch:
        flat = [(int(q), i, -s) for q, own in zip(self.ids, self.found, strict=True) for s, i in own]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])


def top_k(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, *, block: int = BLOCK, queries: int = QUERIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by ``every``."""
    spark = table.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    usable = integers(table, id_col, vec_col, scale)
    common = usable.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], result)
    width, total = common.n, common["count"]
    rows = usable.where(F.size("v") == width)
    energy, vectors = np.linalg.eigh(moments(rows, width))
    rotation, energy = vectors[:, ::-1], np.maximum(energy[::-1], 0)
    lead = min(width, int(np.searchsorted(np.cumsum(energy), ENERGY * energy.sum())) + 1)
    # Enough runs to keep all cores busy, few enough for a run to prune well.
    groups = max(1, -(-total // every // queries))
    runs = max(1, min(-(-total // block), -(-3 * spark.sparkContext.defaultParallelism // groups)))
    path = fresh_path(spark, "vectors")
    stored = blocks(rows.withColumn("g", F.lit(0).cast("long")), width, block, 1, True).withColumn("r", F.pmod(F.xxhash64("place"), F.lit(runs)).cast("int"))
    # Every run gets blocks of all lengths, longest first; a row group holds a few blocks.
    stored.repartition(runs, "r").sortWithinPartitions("r", F.desc("top"), "place").write.partitionBy("r").option("parquet.block.size", str(16 << 20)).parquet(path)
    asked = rows.where(F.pmod("i", F.lit(every)) == 0).withColumn("g", F.pmod(F.xxhash64("i"), F.lit(groups)))
    asked = blocks(asked.repartition(groups, "g").sortWithinPartitions("g", "i"), width, queries, 0, False)
    # A group of queries meets every run: the given set is asked of all rows, a block at a time.
    asked = asked.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    meeting = asked.repartition(runs * groups, "g", "r").sortWithinPartitions("g", "r", "place")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def through(run: int, search: list[Search]) -> Iterator[pa.RecordBatch]:
            for top, ids, x in run_of_blocks(f"{path}/r={run}", width):
                if not any(s.open_at(top) for s in search):
                    break
                for s in search:
                    s.see(ids, x, top)
            for s in search:
                yield s.result()

        key, search = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                r = {c: batch.column(c)[n].as_py() for c in ("g", "r", "ids", "rows")}
                if (r["g"], r["r"]) != key:
                    if search:
                        yield from through(key[1], search)
                    key, search = (r["g"], r["r"]), []
                search.append(Search(np.frombuffer(r["ids"], dtype="<i8"), np.frombuffer(r["rows"], dtype="<i8").reshape(-1, width), rotation, lead, k))
        if search:
            yield from through(key[1], search)

    found = meeting.mapInArrow(walk, FOUND)
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT vec_id, unnest(v) AS c, unnest(range(len(v))) AS d FROM ints
), scores AS (
  SELECT q.vec_id AS query_id, f.vec_id, CAST(sum(q.c * f.c) AS BIGINT) AS score FROM flat q JOIN flat f ON q.d = f.d AND q.vec_id <> f.vec_id
  WHERE q.vec_id % {EVERY} = 0 GROUP BY q.vec_id, f.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {K}"""
