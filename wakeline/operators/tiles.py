"""Exact vector search of each owner's questions over the owner's rows, in tiles: a block of questions against a block of rows in one task.

No pair leaves a task: a tile keeps the best of each question only.  An owner with many rows or questions is split into blocks by a hash, so a tile's
size is bounded; inside a tile the rows are taken in strips of neighbours, and a strip whose centre and radius rule out a better score is skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import BROADCAST_ROWS, written

#: Rows, or questions, of a tile; and rows of a strip.
BLOCK, STRIP = 16_384, 1_024
QUESTIONS_AT_ONCE = 1_024
_FOUND = "query_id long, key long, score double"
#: Beyond rounding of products of unit vectors.
SLACK = 1e-5


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _long(column: pa.ChunkedArray, missing: int) -> np.ndarray:
    return column.fill_null(missing).to_numpy().astype(np.int64)


_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class _Kept:
    """The best of each question of a tile so far: by score and then key, or by key alone."""

    def __init__(self, n: int, most: int, by_key: bool):
        self.most, self.by_key = most, by_key
        self.rows = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.floor = np.full(n, -np.inf)  # the least score that could still be kept
        self.held = 0

    def add(self, i: np.ndarray, keys: np.ndarray, score: np.ndarray) -> None:
        i, keys, score = (np.concatenate(x) for x in zip(self.rows, (i, keys, score), strict=True))
        order = np.lexsort((keys, i) if self.by_key else (keys, -score, i))
        i, keys, score = i[order], keys[order], score[order]
        first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, dtype=bool)
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
        kept = place < self.most
        self.rows = i[kept], keys[kept], score[kept]
        if not self.by_key:
            last = kept & (place == self.most - 1)
            self.floor[i[last]] = score[last]


def search_tile(questions: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], below: np.ndarray | None, keys: np.ndarray, times: np.ndarray, rows: np.ndarray, most: int, least: float | None, by_key: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(question, key, score) of the kept pairs of a tile, and how many products were made."""
    kept, products = _Kept(len(questions), most, by_key), 0
    order = np.argsort(rows @ rows[0], kind="stable")  # neighbours of a pivot lie together
    norms = np.sqrt((questions**2).sum(axis=1))
    for a in range(0, len(order), STRIP):
        at = order[a : a + STRIP]
        strip = rows[at]
        centre = strip.mean(axis=0)
        radius = np.sqrt(((strip - centre) ** 2).sum(axis=1).max())
        bound = questions @ centre + norms * radius + SLACK
        open_ = np.flatnonzero(bound >= np.maximum(kept.floor, -np.inf if least is None else least))
        for b in range(0, len(open_), QUESTIONS_AT_ONCE):
            some = open_[b : b + QUESTIONS_AT_ONCE]
            score = np.round(questions[some] @ strip.T, 6)
            products += score.size
            inside = np.zeros(score.shape, dtype=bool)
            for low, high in spans:
                inside |= (times[at] >= low[some, None]) & (times[at] <= high[some, None])
            if below is not None:
                inside &= keys[at] < below[some, None]
            if least is not None:
                inside &= score >= least
            if not by_key:
                floor = kept.floor[some]
                if score.shape[1] > most:
                    score = np.where(inside, score, -np.inf)
                    floor = np.maximum(floor, np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most])
                inside &= score >= floor[:, None]
            i, j = np.nonzero(inside)
            kept.add(some[i], keys[at[j]], score[i, j])
    return *kept.rows, products


def _run(n_spans: int, earlier: bool, most: int, least: float | None, by_key: bool):
    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "key", "score"])
        if not left.num_rows or not right.num_rows:
            return empty
        dim = left.column("dim")[0].as_py()
        ids = left.column("query_id").to_numpy()
        spans = [(_long(left.column(f"low{k}"), _LOW), _long(left.column(f"high{k}"), _HIGH)) for k in range(n_spans)]
        i, keys, score, _ = search_tile(_matrix(left.column("v"), dim), spans, ids if earlier else None, right.column("key").to_numpy(), _long(right.column("t"), 0), _matrix(right.column("v"), dim), most, least, by_key)
        return pa.table([pa.array(ids[i]), pa.array(keys), pa.array(score)], names=["query_id", "key", "score"])

    return tile


def _blocks(df: DataFrame, key: str, own: str, other: str, large: DataFrame | None) -> DataFrame:
    """df with its own block and a copy for each block of the other side."""
    if large is None:
        return df.withColumns({own: F.lit(0), other: F.lit(0)})
    df = df.join(large, ["owner", "dim"], "left")
    n, m = F.coalesce(f"n_{own}", F.lit(1)), F.coalesce(f"n_{other}", F.lit(1))
    return df.withColumn(own, F.pmod(F.xxhash64(key), n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), (m - 1).cast("int")))).drop(f"n_{own}", f"n_{other}")


def vector_search(questions: DataFrame, rows: DataFrame, most: int, *, spans: list[tuple[Column | None, Column | None]] | None = None, least: float | None = None, earlier: bool = False, by_key: bool = False) -> DataFrame:
    """questions (query_id, owner, v, ...) over rows (key, owner, t, v): (query_id, key, score), most of each question.

    Score is the inner product in double precision, rounded to six places.  Kept are the highest scores (ties: the smaller key), or, with by_key, the smallest keys.
    A row counts if its t (seconds) lies in one of a question's spans (from, to: columns of questions in seconds, None or null for no end), its score is at least
    ``least`` and, with ``earlier``, its key is smaller than query_id.  Null vectors and vectors of another length take no part.
    """
    spans = spans or [(None, None)]
    none = F.lit(None).cast("long")
    ends = {f"{name}{k}": (none if c is None else c.cast("long")) for k, pair in enumerate(spans) for name, c in zip(("low", "high"), pair, strict=True)}
    q = questions.where("v IS NOT NULL AND size(v) > 0").select("query_id", "owner", F.size("v").alias("dim"), *(c.alias(n) for n, c in ends.items()), "v")
    r = rows.where("v IS NOT NULL AND size(v) > 0").select("key", "owner", F.size("v").alias("dim"), "t", "v")
    count = lambda df, name: df.groupBy("owner", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    large = written(count(q, "n_qb").join(count(r, "n_cb").hint("merge"), ["owner", "dim"]).where("n_qb > 1 OR n_cb > 1"), "large")
    some = large.limit(BROADCAST_ROWS + 1).count()
    large = None if not some else large.hint("broadcast" if some <= BROADCAST_ROWS else "merge")
    keys = ["owner", "dim", "qb", "cb"]
    q, r = _blocks(q, "query_id", "qb", "cb", large), _blocks(r, "key", "cb", "qb", large)
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_run(len(spans), earlier, most, least, by_key), _FOUND)
    if large is None:
        return found
    # what the tiles of a question kept, once more
    every = F.struct(F.col("key"), F.col("score")) if by_key else F.struct((-F.col("score")).alias("less"), F.col("key"), F.col("score"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(every)), 1, most).alias("a"))
    return best.select("query_id", F.explode("a").alias("x")).select("query_id", "x.key", "x.score")
