"""Operator 12, centroid clustering by Lloyd's rounds with ns-bounds.

Components become integers (floor(SCALE * x)), so distances, sums and means are exact.  The centroids of all rounds are kept.  For each vector
and centroid a lower bound of the distance is stored with the round in which it was evaluated, and for its own centroid an upper bound.  In a
later round a bound is loosened by the norm of that centroid's total displacement since then, not by the sum of its drifts round by round.
Where some loosened lower bound does not lie above the upper bound, the vector's own distance is evaluated and whatever still fails is too,
exactly; all others keep their centroid.  A margin for rounding goes to the side of evaluating once more.

A round is one pass over the stored vectors and bounds, in which each task also sums the vectors that changed centroid; those sums (a few rows a
task) are aggregated by Spark and applied to the totals.  The centroids' history, (rounds + 1) * clusters * dimensions integers, is broadcast.
A round's table is deleted once the next is written.

Vectors that are null, have another length, or hold null or non-finite components take no part; nor do those with a component beyond MOST, whose
distances would not fit a long.  Rows that repeat an id are vectors of their own.  A null id is last in the order of the seeds; equal seeds' hashes
are ordered by vector.  Fewer vectors than clusters give as many clusters; equal centroids leave the later one empty, and it stays where it is.
An empty table gives an empty result.  Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, read_table, stored

SCALE = 1024
DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Largest component; its integers lie within 2**27 and squared distances of 64 of them in a long.
MOST = 1 << 17
#: Rounding of bounds, relative to what is added up.
MARGIN = 1e-9
#: Up to this size of integers, products in double precision are exact.
_DOUBLE = 1 << 21

_STATE = "moved boolean, vec_id long, v array<int>, cluster int, upper double, upper_at int, lower array<double>, lower_at array<int>, sums array<long>"
_LAST = "vec_id long, cluster int, distance long"


@dataclass
class Clustering:
    #: (vec_id, cluster, distance) of each vector
    assigned: DataFrame
    #: the last round's centroids
    centroids: np.ndarray
    #: distances evaluated in each round, of clusters * vectors
    evaluated: list[int]


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[vector, centroid], exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _DOUBLE:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


class Bounds:
    """Assigned centroids and bounds of a batch of vectors."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray):
        self.cluster, self.upper, self.upper_at, self.lower, self.lower_at = cluster, upper, upper_at, lower, lower_at

    @classmethod
    def first(cls, x: np.ndarray, c: np.ndarray) -> Bounds:
        d = squared_distances(x, c)
        cluster, lower = d.argmin(axis=1), np.sqrt(d)
        return cls(cluster, lower[np.arange(len(x)), cluster], np.zeros(len(x), dtype=np.int64), lower, np.zeros(d.shape, dtype=np.int64))

    def assign(self, x: np.ndarray, history: np.ndarray) -> int:
        """Assigns each vector to the nearest of the last centroids in history; returns how many distances were evaluated."""
        now, (n, k) = len(history) - 1, self.lower.shape
        drift = np.sqrt(((history - history[-1]).astype(np.float64) ** 2).sum(axis=2))
        rows = np.arange(n)
        gone, moved = drift[self.lower_at, np.arange(k)], drift[self.upper_at, self.cluster]
        upper = (self.upper + moved) * (1 + MARGIN) + MARGIN
        lower = self.lower - gone - MARGIN * (self.lower + gone + 1)
        lower[rows, self.cluster] = np.inf
        open_ = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
        if not len(open_):
            return 0
        far = np.iinfo(np.int64).max
        exact = np.full((len(open_), k), far)
        own = self.cluster[open_]
        for j in range(k):
            of = own == j
            exact[of, j] = squared_distances(x[open_[of]], history[now, j : j + 1])[:, 0]
        near = np.sqrt(exact[np.arange(len(open_)), own])
        fails = lower[open_] <= (near * (1 + MARGIN) + MARGIN)[:, None]
        for j in range(k):
            of = fails[:, j]
            exact[of, j] = squared_distances(x[open_[of]], history[now, j : j + 1])[:, 0]
        i, j = np.nonzero(exact < far)
        self.lower[open_[i], j] = np.sqrt(exact[i, j])
        self.lower_at[open_[i], j] = now
        self.cluster[open_] = best = exact.argmin(axis=1)
        self.upper[open_] = np.sqrt(exact[np.arange(len(open_)), best])
        self.upper_at[open_] = now
        return len(i)


def _lists(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _as_lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))


def _read_bounds(batch: pa.RecordBatch, k: int) -> Bounds:
    number = lambda name, kind: batch.column(name).to_numpy(zero_copy_only=False).astype(kind)
    return Bounds(number("cluster", np.int64), number("upper", np.float64), number("upper_at", np.int64), _lists(batch.column("lower"), k, np.float64), _lists(batch.column("lower_at"), k, np.int64))


def _pass(shared):
    """A round: rows of vectors with their bounds, then a row for each centroid with the sums and number of vectors that it gained, and of distances evaluated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        k, dim = history.shape[1:]
        gained, evaluated = np.zeros((k, dim + 2), dtype=np.int64), 0
        schema = pa.schema([("moved", pa.bool_()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("upper_at", pa.int32()), ("lower", pa.list_(pa.float64())), ("lower_at", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])
        for batch in batches:
            x, n = _lists(batch.column("v"), dim, np.int64), batch.num_rows
            if len(history) == 1:
                bounds, old = Bounds.first(x, history[0]), np.full(n, -1)
                evaluated += n * k
            else:
                bounds = _read_bounds(batch, k)
                old = bounds.cluster.copy()
                evaluated += bounds.assign(x, history)
            one = np.concatenate([x, np.ones((n, 1), dtype=np.int64), np.zeros((n, 1), dtype=np.int64)], axis=1)
            for j in range(k):
                gained[j] += one[(bounds.cluster == j) & (old != j)].sum(axis=0) - one[(old == j) & (bounds.cluster != j)].sum(axis=0)
            columns = [pa.nulls(n, pa.bool_()), batch.column("vec_id"), batch.column("v"), pa.array(bounds.cluster, pa.int32()), pa.array(bounds.upper), pa.array(bounds.upper_at, pa.int32())]
            columns += [_as_lists(bounds.lower, pa.float64()), _as_lists(bounds.lower_at, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        gained[0, -1] = evaluated
        columns = [pa.array([True] * k), *(pa.nulls(k, schema.field(i).type) for i in (1, 2)), pa.array(np.arange(k), pa.int32()), *(pa.nulls(k, schema.field(i).type) for i in range(4, 8))]
        yield pa.RecordBatch.from_arrays([*columns, _as_lists(gained, pa.int64())], schema=schema)

    return run


def _last_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        k, dim = history.shape[1:]
        for batch in batches:
            x = _lists(batch.column("v"), dim, np.int64)
            bounds = Bounds.first(x, history[0]) if len(history) == 1 else _read_bounds(batch, k)
            if len(history) > 1:
                bounds.assign(x, history)
            d = x - history[-1][bounds.cluster]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(bounds.cluster, pa.int32()), pa.array((d * d).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return run


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    e = F.col("embedding")
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.size(e) == dimensions).where(usable)
    return rows.select("vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> Clustering:
    """vectors (vec_id, embedding, ...) to their clusters after so many rounds and one last assignment."""
    spark = vectors.sparkSession
    now = stored(integer_vectors(vectors, dimensions), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = [r.v for r in now.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()]
    if not seeds:
        return Clustering(spark.createDataFrame([], _LAST), np.zeros((0, dimensions), dtype=np.int64), [])
    history = np.array([seeds], dtype=np.int64)
    totals, evaluated = [[0] * (dimensions + 2) for _ in seeds], [0]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(history)
        before, now = now, stored(now.mapInArrow(_pass(shared), _STATE), "round")
        shared.destroy()
        discard(before)
        gained = now.where("moved").select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("n"))
        for r in gained.collect():
            totals[r.cluster][r.pos] += int(r.n)
        evaluated.append(totals[0][-1])
        fresh = [[s // t[-2] for s in t[:-2]] if t[-2] else old.tolist() for t, old in zip(totals, history[-1], strict=True)]
        history = np.concatenate([history, np.array([fresh], dtype=np.int64)])
        now = now.where("moved IS NULL")
    shared = spark.sparkContext.broadcast(history)
    assigned = stored(now.mapInArrow(_last_pass(shared), _LAST), "assigned")
    discard(now)
    return Clustering(assigned, history[-1], np.diff(evaluated).tolist())


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    inertia = {r.cluster: int(r.n) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
    rows = [(j, inertia[j], sum(inertia.values()), digest(c)) for j, c in enumerate(found.centroids) if j in inertia]
    # a row for each cluster
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(rounds: int = ROUNDS) -> str:
    """The rounds one after the other, every distance evaluated."""
    nearest = "SELECT rid, c, d FROM (SELECT v.rid, k.c, CAST(list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{t} k) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1"
    parts = [
        "r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings)",
        "v AS MATERIALIZED (SELECT rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM r WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h, e LIMIT 8))",
    ]
    for t in range(rounds):
        parts.append(f"a{t} AS MATERIALIZED ({nearest.format(t=t)})")
        parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.e, k.e) AS e FROM c{t} k LEFT JOIN (SELECT c, list(x ORDER BY i) AS e FROM
            (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.e) AS x, unnest(range(64)) AS i FROM a{t} a JOIN v USING (rid)) GROUP BY c, i)) GROUP BY c) m USING (c))""")
    parts.append(f"f AS MATERIALIZED ({nearest.format(t=rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, CAST(f.c AS INTEGER) AS cluster, f.d AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.e, ',')) AS centroid_sha256 FROM f JOIN v USING (rid) JOIN c{rounds} k ON k.c = f.c"""


OP12_SQL = _op12_sql()
