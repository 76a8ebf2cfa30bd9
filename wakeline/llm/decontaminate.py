"""Operator 5, benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

Every run of as many words as a benchmark item has is a window (a shorter text is one window by itself).  A window and an item
are each a bag of 5-word shingles.  A 64-bit SimHash of the bag is cut into BLOCKS parts; two hashes within RADIUS differ by
at most RADIUS // BLOCKS bits in some part, so looking up all part values that near in each part's postings finds every item within
the radius.  Candidates are verified by the exact weighted similarity of the bags: the sum of the smaller multiplicities over the sum
of the larger, SIMILARITY or more.

Items that share no shingle with a document have similarity 0 with all of its windows, and so do windows without a shingle of any item:
neither is looked up, which loses nothing, so a document meets the few items that it shares words with and not the benchmark.

The items are broadcast, at most ITEMS_AT_ONCE rows and about BYTES_AT_ONCE bytes at a time; a long benchmark takes several passes, one after
the other, each stored before the next begins.  Null or empty texts and items without words match nothing, nor does a benchmark without any
item; repeated documents are judged alike; of items with one id and one text, one counts; an empty table gives an empty result; of equal
windows the first is told.  Other columns of either table may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import SHINGLE_WORDS, shingle_hashes, slices, utf8, word_hashes
from .shared import read_table, stored

_U = np.uint64
SIMILARITY = 0.75
BLOCKS = 8
RADIUS = 23
ITEMS_AT_ONCE = 20_000
BYTES_AT_ONCE = 64 << 20
#: Windows that are looked up at a time.
WINDOWS_AT_ONCE = 4096


def simhash(bags: list[np.ndarray]) -> np.ndarray:
    """64-bit SimHashes of bags of shingle hashes."""
    shifts = np.arange(64, dtype=_U)
    out = np.zeros(len(bags), dtype=_U)
    for i, bag in enumerate(bags):
        votes = (((bag[:, None] >> shifts) & _U(1)).astype(np.int64) * 2 - 1).sum(axis=0)
        out[i] = ((votes > 0).astype(_U) << shifts).sum(dtype=_U)
    return out


_VALUES = np.arange(256, dtype=np.uint8)
#: For each value of a part the values that are near enough.
_NEAR = [np.flatnonzero(np.bitwise_count(_VALUES ^ np.uint8(v)) <= RADIUS // BLOCKS) for v in range(256)]


def within_radius(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (window, item) pairs of SimHashes within RADIUS, by postings of the items' parts."""
    out = []
    for b in range(BLOCKS):
        shift, byte = _U(8 * b), _U(255)
        own = (items >> shift & byte).astype(np.int64)
        order = np.argsort(own, kind="stable")
        at = np.searchsorted(own[order], np.arange(257))
        values, which = np.unique((windows >> shift & byte).astype(np.int64), return_inverse=True)
        by_value = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which, minlength=len(values)))[:-1])
        for v, rows in zip(values.tolist(), by_value, strict=True):
            near = np.concatenate([order[at[u] : at[u + 1]] for u in _NEAR[v].tolist()])
            if len(near):
                w, i = np.repeat(rows, len(near)), np.tile(near, len(rows))
                ok = np.bitwise_count(windows[w] ^ items[i]) <= RADIUS
                out.append(w[ok] * len(items) + i[ok])
    pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)
    return pairs // max(1, len(items)), pairs % max(1, len(items))


class ItemIndex:
    """Benchmark items: their bags, SimHashes and numbers of words, and for each shingle the items that hold it."""

    def __init__(self, items: list[tuple[int, str]]):
        buf, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        words, _, _, first = word_hashes(buf, offsets)
        grams, starts = shingle_hashes(words, first)
        some = [k for k in range(len(items)) if first[k + 1] > first[k]]
        self.ids = [items[k][0] for k in some]
        self.length = np.array([first[k + 1] - first[k] for k in some], dtype=np.int64)
        self.bags = [np.sort(grams[starts[k] : starts[k + 1]]) for k in some]
        self.codes = simhash(self.bags)
        flat = np.concatenate(self.bags) if some else np.zeros(0, dtype=_U)
        holder = np.repeat(np.arange(len(some)), [len(b) for b in self.bags]) if some else np.zeros(0, dtype=np.int64)
        order = np.lexsort((holder, flat))
        self.vocabulary, at = np.unique(flat[order], return_index=True)
        self.holders, self.at = holder[order], np.append(at, len(flat))
        self.short = sorted(set(self.length[self.length < SHINGLE_WORDS].tolist()))

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles an item holds, and the items that hold any of them."""
        if not len(self.vocabulary):
            return np.zeros(len(grams), dtype=bool), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == grams
        found = np.unique(at[hit]).tolist()
        return hit, np.unique(np.concatenate([self.holders[self.at[v] : self.at[v + 1]] for v in found])) if found else np.zeros(0, dtype=np.int64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger multiplicities of two sorted bags."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(vb, va), len(vb) - 1)
    both = int(np.where(vb[at] == va, np.minimum(ca, cb[at]), 0).sum())
    return both / (len(a) + len(b) - both)


def match_document(words: np.ndarray, grams: np.ndarray, index: ItemIndex) -> dict[int, tuple[float, int, int]]:
    """Per item that a document holds: (similarity, first word, words) of its best and then first window."""
    best: dict[int, tuple[float, int, int]] = {}
    n_words = len(words)
    hit, items = index.shared(grams)
    hits = np.flatnonzero(hit)
    bits = None

    def settle(items: np.ndarray, starts: np.ndarray, codes: np.ndarray, size: int, bag_of) -> None:
        for k in range(0, len(starts), WINDOWS_AT_ONCE):
            for w, i in zip(*(x.tolist() for x in within_radius(codes[k : k + WINDOWS_AT_ONCE], index.codes[items])), strict=True):
                start, item = int(starts[k + w]), int(items[i])
                similarity = weighted_similarity(np.sort(bag_of(start)), index.bags[item])
                own = index.ids[item]
                if similarity >= SIMILARITY and (own not in best or similarity > best[own][0] or (similarity == best[own][0] and start < best[own][1])):
                    best[own] = (similarity, start, size)

    for n in index.short:
        if n < n_words:  # windows below a shingle: their words are the shingle
            pieces = np.concatenate([words[s : s + n] for s in range(n_words - n + 1)])
            shingles, _ = shingle_hashes(pieces, np.arange(0, len(pieces) + 1, n))
            held, holders = index.shared(shingles)
            holders, starts = holders[index.length[holders] == n], np.flatnonzero(held)
            if len(holders):
                settle(holders, starts, simhash([shingles[s : s + 1] for s in starts]), n, lambda s, g=shingles: g[s : s + 1])
    for n in np.unique(index.length[items]).tolist():
        size = min(n, n_words)
        if size < SHINGLE_WORDS and size < n_words:
            continue
        width = max(1, size - SHINGLE_WORDS + 1)
        covered = np.zeros(len(grams) + 1, dtype=np.int32)
        np.add.at(covered, np.maximum(hits - width + 1, 0), 1)
        np.add.at(covered, hits + 1, -1)
        starts = np.flatnonzero(np.cumsum(covered)[: len(grams) - width + 1] > 0)
        if bits is None:  # votes of the shingles around the hits, added up
            reach = max(1, min(int(index.length[items].max()), n_words))
            near = np.zeros(len(grams) + 1, dtype=np.int32)
            np.add.at(near, np.maximum(hits - reach, 0), 1)
            np.add.at(near, np.minimum(hits + reach, len(grams)), -1)
            near = np.flatnonzero(np.cumsum(near)[: len(grams)] > 0)
            place = np.full(len(grams) + 1, -1)
            place[near] = np.arange(len(near))
            votes = ((grams[near][:, None] >> np.arange(64, dtype=_U)) & _U(1)).astype(np.int32) * 2 - 1
            bits = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(votes, axis=0)])
        total = bits[place[starts + width - 1] + 1] - bits[place[starts]]
        codes = ((total > 0).astype(_U) << np.arange(64, dtype=_U)).sum(axis=1, dtype=_U)
        settle(items[index.length[items] == n], starts, codes, size, lambda s, g=grams, w=width: g[s : s + w])
    return best


def _match(items_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items_of.value)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            buf, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                at = offsets[i : j + 1]
                words, _, _, first = word_hashes(buf[at[0] : at[-1]], at - at[0])
                grams, starts = shingle_hashes(words, first)
                for k in range(j - i):
                    if first[k + 1] > first[k]:
                        for item, (sim, start, n) in match_document(words[first[k] : first[k + 1]], grams[starts[k] : starts[k + 1]], index).items():
                            rows.append((ids[i + k], item, sim, start, n))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of the best window for each document and item that match."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size.n // ITEMS_AT_ONCE), -(-size.bytes // BYTES_AT_ONCE))
    out = None
    for k in range(passes):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        if not some and (k or passes > 1):
            continue
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in some])
        found = docs.mapInArrow(_match(shared), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        if passes > 1:  # so that the driver holds the items of one pass at a time
            found = stored(found, "matches")
            shared.destroy()
        out = found if out is None else out.union(found)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
