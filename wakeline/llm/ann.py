"""Operator 7, approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample (principal axes, then iterative quantisation from several starts) turn each vector into BITS signs, cut
into SUBSTRINGS parts of 16.  Each part has an index from its value to the rows that have it.  Probing all values within REACH bits of
the query's part, in every part, retrieves by the pigeonhole principle every code within a Hamming radius of RADIUS (a code beyond REACH in
every part differs in more bits than that), and whatever else agrees that well in some part.  All that is retrieved is ranked by the
exact cosine in double precision.  Where a query retrieves fewer than TARGET rows of a block for each neighbour asked for, probing goes on: part by
part with one bit more, until it does; only a table of fewer rows than that is retrieved whole.  ``verified`` tells how many rows a query was compared with.

Vectors stay where they are read: a task indexes them in blocks of BLOCK_ROWS and sends on the k best of each query.  Queries are broadcast
in slices of SLICE_BYTES or so, one after the other, and each slice's rows are stored before the next is sent; with more than one slice the codes are
stored once for all.  No bucket has a cap.

Vectors that are null, zero, hold null or non-finite components, or differ in length from the most common length of the
sample take no part.  Rows that repeat a query's id count as the query's own row; of repeated queries the smallest vector is asked; repeated
rows are candidates of their own; ties go to the smaller id.  An empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, stored

SAMPLE_ROWS = 4096
ROTATION_BITS = 64
ROTATIONS = 24
BITS = ROTATIONS * ROTATION_BITS
SUBSTRINGS = BITS // 16
#: Bits in which a probed value may differ from the query's part, and the radius within which every code is retrieved.
REACH = 2
RADIUS = SUBSTRINGS * (REACH + 1) - 1
BLOCK_ROWS = 16_384
#: Rows that a query retrieves of a block, at least, for each neighbour asked for.
TARGET = 40
QUERIES_AT_ONCE = 256
SLICE_BYTES = 32 << 20
_MASKS = np.array([v for v in range(1 << 16) if v.bit_count() <= REACH], dtype=np.uint16)


def learn_rotation(vectors: np.ndarray, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Columns of a projection whose signs are ROTATION_BITS code bits, for unit vectors of a sample."""
    dim = vectors.shape[1]
    rng = np.random.default_rng(seed)
    axes = np.linalg.svd(vectors.T @ vectors)[0]
    if dim < ROTATION_BITS:  # more bits than axes: random mixtures of them
        axes = np.concatenate([axes, axes @ rng.normal(size=(dim, ROTATION_BITS - dim)) / np.sqrt(dim)], axis=1)
    axes = axes[:, :ROTATION_BITS]
    projected = vectors @ axes
    turn = np.linalg.qr(rng.normal(size=(ROTATION_BITS, ROTATION_BITS)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
        turn = (u @ v).T
    return axes @ turn


def learn_code(vectors: np.ndarray, seed: int = 7) -> np.ndarray:
    return np.concatenate([learn_rotation(vectors, seed=seed + k) for k in range(ROTATIONS)], axis=1)


def encode(vectors: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The parts of each vector's code, 16 bits each."""
    return np.packbits(vectors @ code > 0, axis=1).view(">u2").astype(np.uint16)


class MultiIndex:
    """Per part of the codes, an index from its value to rows."""

    def __init__(self, codes: np.ndarray):
        self.n, self.codes = len(codes), codes
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(codes.shape[1])]
        self.at = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << 16))]).astype(np.int32) for j in range(codes.shape[1])]

    def retrieve(self, codes: np.ndarray, target: int = 0) -> np.ndarray:
        """[query, row]: whether probing retrieves the row; it goes on until target rows are retrieved, or all."""
        found = np.zeros((len(codes), self.n), dtype=bool)
        flat = found.reshape(-1)
        for j, (order, at) in enumerate(zip(self.order, self.at, strict=True)):
            probes = (codes[:, j, None] ^ _MASKS).astype(np.int32)
            low = at[probes].reshape(-1)
            count = at[probes + 1].reshape(-1) - low
            some = np.flatnonzero(count)
            low, count = low[some], count[some]
            rows = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
            flat[np.repeat(some // len(_MASKS), count) * self.n + rows] = True
        target = min(target, self.n)
        short = np.flatnonzero(found.sum(axis=1) < target)
        for reach in range(REACH + 1, 17):
            for j in range(self.codes.shape[1]):
                if not len(short):
                    return found
                found[short] |= np.bitwise_count(self.codes[:, j] ^ codes[short, j, None]) == reach
                short = short[found[short].sum(axis=1) < target]
        return found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


class _Best:
    """The k best rows of each query so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(self.rows, (query, ids, score), strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        begin = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=bool)
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(begin, np.arange(len(query)), 0))
        keep = place < self.k
        self.rows = query[keep], ids[order][keep], score[order][keep]


def search_block(index: MultiIndex, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, q: np.ndarray, best: _Best, verified: np.ndarray) -> None:
    """Adds a block's best rows for all queries, and to verified how many rows each was compared with."""
    norms, q_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    for i in range(0, len(q), QUERIES_AT_ONCE):
        own = query_ids[i : i + QUERIES_AT_ONCE, None] == ids
        found = index.retrieve(codes[i : i + QUERIES_AT_ONCE], TARGET * best.k + int(own.sum(axis=1).max()))
        found &= ~own
        verified[i : i + QUERIES_AT_ONCE] += found.sum(axis=1)
        a, rows = np.nonzero(found)
        a += i
        score = np.concatenate([np.einsum("ij,ij->i", x[rows[p : p + 65536]], q[a[p : p + 65536]]) for p in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
        best.add(a, ids[rows], score / (norms[rows] * q_norms[a]))


def _coded(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(_matrix(batch.column(1), dim), shared.value)
            yield batch.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))

    return run


def _search(shared, k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, query_ids, q = shared.value
        codes, best, verified, held, n = encode(q, code), _Best(k), np.zeros(len(q), dtype=np.int64), [], 0

        def settle() -> None:
            block = pa.Table.from_batches(held).combine_chunks()
            x = _matrix(block.column(1).combine_chunks(), dim)
            own = np.frombuffer(b"".join(block.column(2).to_pylist()), dtype=np.uint16).reshape(len(x), -1) if block.num_columns > 2 else encode(x, code)
            search_block(MultiIndex(own), block.column(0).to_numpy(), x, codes, query_ids, q, best, verified)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                settle()
                held, n = [], 0
        if n:
            settle()
        a, ids, score = best.rows
        first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[a]), pa.array(ids), pa.array(score), pa.array(np.where(first, verified[a], 0))], names=["query_id", "vec_id", "score", "verified"])

    return run


def usable(df: DataFrame) -> DataFrame:
    """Rows whose vector can take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).where(finite & F.exists(e, lambda x: x != 0))


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """vectors (vec_id, embedding, ...) to (query_id, rank, vec_id, score, verified): the k nearest found of each query row, and the rows it was compared with."""
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    none = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("verified")).limit(0)
    if not sample:
        return none
    lengths = np.bincount([len(r.embedding) for r in sample])
    dim = int(lengths.argmax())
    x = np.array([r.embedding for r in sample if len(r.embedding) == dim], dtype=np.float64)
    code = learn_code(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    rows = rows.where(F.size("embedding") == dim)
    queries = stored(rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    slices = max(1, -(-queries.count() * dim * 8 // SLICE_BYTES))
    if slices > 1:
        kind = rows.schema["embedding"].dataType.simpleString()
        rows = stored(rows.mapInArrow(_coded(spark.sparkContext.broadcast(code), dim), f"vec_id long, embedding {kind}, code binary"), "codes")
    found = None
    for s in range(slices):
        some = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(slices)) == s).orderBy("vec_id").toArrow()
        if some.num_rows:
            shared = spark.sparkContext.broadcast((code, some.column(0).to_numpy(), _matrix(some.column(1).combine_chunks(), dim)))
            new = stored(rows.mapInArrow(_search(shared, k, dim), "query_id long, vec_id long, score double, verified long"), "found")
            shared.destroy()
            found = new if found is None else found.union(new)
    if found is None:
        return none
    query = Window.partitionBy("query_id")
    found = found.withColumns({"rank": F.row_number().over(query.orderBy(F.col("score").desc(), "vec_id")), "verified": F.sum("verified").over(query)})
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), lambda v: v % 50 == 0)
