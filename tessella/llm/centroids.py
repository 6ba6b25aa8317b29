"""Centroid clustering with Elkan's bounds (operator 13).

Vectors become integers and travel in blocks, one row each, from round to round
through tables in the shared folder.  A block keeps for every vector an upper bound
on the distance to its own centroid and a lower bound on the distance to each.  In
a round no other centroid is looked at where half its distance from the vector's
own, or the vector's cached lower bound on it, is more than the upper bound; what
is left is measured.  After a round the bounds move with the centroids.

Bounds are floating-point numbers that every step rounds away from the truth, and
a centroid is passed over only if it is strictly farther, so ties are always
measured; measured distances are compared as exact integers.  Tasks add up their
vectors by cluster, Spark adds up these partial sums, and the driver sees one sum
per centroid and component.

Edge cases: vectors that are null, of another length, or hold null or non-finite
components take no part; components beyond +-2^62 are held there; a distance or
sum of distances beyond a long is null; rows with a null id are vectors like any
other, but are taken last when centroids start; vectors that repeat an id are each
a row, and start in the order of their components; with fewer vectors than
centroids there are as many centroids as vectors; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import dropped, written

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Vectors of a block.
BLOCK = 4_096
#: Components up to which float64 products, and int64 sums, of whole vectors are exact.
IN_FLOAT, IN_LONG = 1 << 22, 1 << 27
MOST, LONG = 1 << 62, 2**63 - 1
#: More than all rounding in a distance's root and its sums.
SLACK = 1e-12
BLOCKS = "ids array<long>, width int, vectors binary, cluster binary, upper binary, lower binary, part int, sums array<decimal(38,0)>, n long, inertia decimal(38,0)"


def integers(table: DataFrame, width: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(i, v): usable vectors as floor(scale * x)."""
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("x")).where((F.size("x") == width) & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    held = lambda c: F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))
    return rows.select("i", F.transform("x", lambda c: F.floor(held(c)).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, count: int) -> np.ndarray:
    """The vectors of the smallest digests of their ids, at most ``count``."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("i").cast("string")), 256)
    return np.array([r.v for r in rows.orderBy(F.asc_nulls_last(digest), "v").select("v").limit(count).collect()], dtype=object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from one centroid, in whatever kind of integer holds them."""
    most = max(int(np.abs(x).max(initial=0)), max(map(abs, c.tolist()), default=0))
    if most < IN_LONG:
        d = x - c.astype(np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - c
    return (d * d).sum(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def gaps(centroids: np.ndarray) -> np.ndarray:
    """At most half the distance of each two centroids."""
    d = (centroids[:, None, :] - centroids[None, :, :]) ** 2
    return _down(_root(d.sum(axis=2)) / 2)


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move rows of x to their nearest centroids, in place, with their bounds; returns the number of distances measured."""
    half = gaps(centroids)
    others = half + np.where(np.eye(len(half), dtype=bool), np.inf, 0)
    measured = 0
    # Strictly nearer than half the way to any other centroid: nothing to look at.
    open_ = np.flatnonzero(upper >= others.min(axis=1)[cluster])
    if not len(open_):
        return 0
    own, best = x[open_], np.empty(len(open_), dtype=object)
    now, up = cluster[open_], np.empty(len(open_))
    for k in range(len(centroids)):
        at = np.flatnonzero(now == k)
        if len(at):
            d = squared(own[at], centroids[k])
            best[at], up[at], lower[open_[at], k] = d, _up(_root(d)), _down(_root(d))
            measured += len(at)
    start = now.copy()
    for k in range(len(centroids)):
        at = np.flatnonzero((start != k) & (now != k) & (half[now, k] <= up) & (lower[open_, k] <= up))
        if len(at):
            d = squared(own[at], centroids[k])
            measured += len(at)
            lower[open_[at], k] = _down(_root(d))
            better = (d < best[at]) | ((d == best[at]) & (k < now[at]))
            moved = at[better]
            best[moved], now[moved], up[moved] = d[better], k, _up(_root(d[better]))
    cluster[open_], upper[open_] = now, up
    return measured


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """At least how far each centroid has moved."""
    return _up(_root(((new - old) ** 2).sum(axis=1)))


def _kind(x: np.ndarray) -> int:
    """Bytes that every component fits."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)


def _rows(schema: pa.Schema, **values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _schema() -> pa.Schema:
    big = pa.decimal128(38, 0)
    return pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), *((c, pa.binary()) for c in ("vectors", "cluster", "upper", "lower")), ("part", pa.int32()), ("sums", pa.list_(big)), ("n", pa.int64()), ("inertia", big)])


def blocks(rows: DataFrame, width: int, count: int, size: int) -> DataFrame:
    """Vectors in blocks, with bounds that say nothing yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema()
        for batch in batches:
            every = np.asarray(batch.column("v").flatten()).reshape(-1, width)
            for a in range(0, batch.num_rows, size):
                x = every[a : a + size]
                kind = _kind(x)
                yield _rows(schema, ids=batch.column("i").slice(a, size).to_pylist(), width=kind, vectors=x.astype(f"<i{kind}").tobytes(), cluster=np.zeros(len(x), "<i4").tobytes(), upper=np.full(len(x), np.inf).tobytes(), lower=np.zeros((len(x), count)).tobytes())

    return rows.mapInArrow(run, BLOCKS)


def assigned(state: DataFrame, centroids: np.ndarray, shift: np.ndarray | None, last: bool) -> DataFrame:
    """Blocks after one assignment, and one row a task and centroid of what it has added up.

    ``shift`` says how far the centroids have moved since the bounds were made.  The last round adds exact
    distances, of which ``sums`` has the row's own.
    """
    width, count = centroids.shape[1], len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema()
        sums, n, inertia = np.zeros((count, width), dtype=object), np.zeros(count, dtype=np.int64), [0] * count
        for batch in batches:
            for ids, kind, vectors, c, u, low in zip(batch.column("ids").to_pylist(), *(batch.column(f).to_pylist() for f in ("width", "vectors", "cluster", "upper", "lower")), strict=True):
                x = np.frombuffer(vectors, f"<i{kind}").astype(np.int64).reshape(-1, width)
                cluster, upper, lower = np.frombuffer(c, "<i4").copy(), np.frombuffer(u).copy(), np.frombuffer(low).reshape(-1, count).copy()
                if shift is not None:
                    upper = _up(upper + shift[cluster])
                    lower = np.maximum(_down(lower) - _up(shift), 0)
                    lower = _down(lower)
                assign(x, centroids, cluster, upper, lower)
                distances = np.zeros(len(x), dtype=object) if last else None
                wide = x if int(np.abs(x).max(initial=0)) < IN_LONG else x.astype(object)
                for k in range(count):
                    at = np.flatnonzero(cluster == k)
                    if not len(at):
                        continue
                    n[k] += len(at)
                    sums[k] += wide[at].sum(axis=0).astype(object)
                    if last:
                        distances[at] = squared(x[at], centroids[k])
                        inertia[k] += int(distances[at].sum())
                yield _rows(schema, ids=ids, width=kind, vectors=None if last else vectors, cluster=cluster.astype("<i4").tobytes(), upper=upper.tobytes(), lower=None if last else lower.tobytes(), sums=[Decimal(int(d)) if d <= LONG else None for d in distances] if last else None)
        for k in range(count):
            if n[k]:
                yield _rows(schema, part=k, sums=None if last else [Decimal(int(s)) for s in sums[k]], n=int(n[k]), inertia=Decimal(inertia[k]) if inertia[k] < 10**38 else None)

    return state.mapInArrow(run, BLOCKS)


def means(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Exact floors of each centroid's mean; a centroid without vectors stays."""
    rows = state.where("part IS NOT NULL")
    sums = rows.select("part", F.posexplode("sums").alias("at", "s")).groupBy("part", "at").agg(F.sum("s").alias("s")).collect()
    counts = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    new = old.copy()
    for r in sums:
        new[r.part, r.at] = int(r.s) // counts[r.part]
    return new


def clusters(table: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, *, width: int = WIDTH, scale: int = SCALE, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    spark, result = table.sparkSession, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = integers(table, width, scale, id_col, vec_col)
    centroids = first_centroids(rows, count)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id long, distance long, {result}").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    zstd = {"compression": "zstd"}
    state, shift = written(blocks(rows, width, len(centroids), block), "vectors", **zstd), None
    for _ in range(rounds):
        after = written(assigned(state.where("part IS NULL"), centroids, shift, False), "vectors", **zstd)
        dropped(state)
        new = means(after, centroids)
        state, shift, centroids = after, moved(centroids, new), new
    last = written(assigned(state.where("part IS NULL"), centroids, shift, True), "vectors", **zstd)
    dropped(state)
    total = [(r.part, int(r.s) if r.s is not None else None) for r in last.where("part IS NOT NULL").groupBy("part").agg(F.when(F.count("inertia") == F.count(F.lit(1)), F.try_sum("inertia")).alias("s")).collect()]
    fits = lambda s: s if s is not None and s <= LONG else None
    every = None if any(s is None for _, s in total) else sum(s for _, s in total)
    named = [(k, fits(s), fits(every), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, s in total]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                cluster = pa.array(np.frombuffer(batch.column("cluster")[n].as_py(), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[n].values, cluster, batch.column("sums")[n].values.cast(pa.int64())], names=["vec_id", "cluster", "distance"])

    found = last.where("part IS NULL").select("ids", "cluster", "sums").mapInArrow(each, "vec_id long, cluster int, distance long")
    # One row a centroid.
    return found.join(F.broadcast(spark.createDataFrame(named, result)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """The same by all distances."""
    nearest = """a{r} AS (
  SELECT vec_id, v, cluster, distance FROM (
    SELECT vec_id, v, c.cluster, list_sum(list_transform(list_zip(v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, c.cluster) AS o FROM ints, c{r} c
  ) WHERE o = 1
)"""
    moved_ = """s{r} AS (
  SELECT cluster, d, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS d FROM a{r}) GROUP BY cluster, d
), m{r} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS c FROM s{r} GROUP BY cluster
), c{n} AS (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (cluster)
)"""
    steps = ", ".join(f"{nearest.format(r=r)}, {moved_.format(r=r, n=r + 1)}" for r in range(ROUNDS))
    return f"""
WITH ints AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT * FROM ints ORDER BY sha256('1:' || vec_id), v LIMIT {CENTROIDS})
), {steps}, {nearest.format(r=ROUNDS)}
SELECT vec_id, a.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.cluster"""
