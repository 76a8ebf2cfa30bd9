"""Operator 6, n-gram Jaccard join: multiple-global-order prefix filtering with exact verification.

Two texts link when 100 * |A and B| >= 75 * |A or B| for their sets of 5-word shingles.  For any global order of
shingles, two linking sets of sizes a and b share a shingle among the first a - ceil(.75 a) + 1 of the one and the
first b - ceil(.75 b) + 1 of the other.  A candidate must pass that filter under three orders.  All orders put
frequent shingles last (by a sketch of counts over the whole corpus) and break ties by three different seeds.

1.  One scan turns each text into its shingle set's fingerprint; equal sets are one node from here on.
2.  A scan emits each node's prefix under the first order.  Rows are dealt by shingle and sorted; shingles of one
    node only go.  If this is the first shingle that two nodes share, their positions bound the intersection, so a
    short posting yields its possible pairs at once, and the rows of a long posting are kept.
3.  Long postings: star rounds pair the members with one pivot only, so a group of n copies yields n rows.
    Candidates are intersected with the filters of the other two orders and verified on whole sets.
4.  Afterwards a posting whose members are all in one component is settled.  Members of others meet the members of
    other components in blocks of bounded size, under the same bounds and filters: no link between components is lost.

The sketch tells before anything is dealt which shingles may be in more than HEAVY_ROWS sets; rows of those are spread over SALTS tasks and
are long postings as they are.  Long postings stream through a task without being held.

A cap on partners or postings does not exist.  Nulls and texts without words have the empty set, link with nothing and are
their own component; rows with a null id take the component of rows with the same set, or null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import distinct_shingles, mix64, set_signatures, shingle_sets
from .shared import keep_ids, read_table, small, stored

_U = np.uint64
SKETCH_BITS = 21
SKETCH_PARTS = 64
#: Seeds of the tie-breaks of the three global orders.
ORDER_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
STAR_ROUNDS = 2
#: Postings of up to so many members yield their possible pairs at once.
SHORT_POSTING = 16
BLOCK_ROWS = 4096
HEAVY_ROWS = 50_000
SALTS = 64


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, node, part, cells): a row for each text, and at the end the task's sketch in parts."""
    cells = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    shift = _U(64 - SKETCH_BITS)
    for batch in batches:
        n, node = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for flat, starts in distinct_shingles(batch.column(1)):
            cells += np.bincount((flat >> shift).astype(np.int64), minlength=len(cells))
            n.append(np.diff(starts))
            node.append(set_signatures(flat, starts))
        n, node = np.concatenate(n), np.concatenate(node)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(node, mask=n == 0), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "node", "part", "cells"])
    parts = [_pack(p) for p in cells.reshape(SKETCH_PARTS, -1)]
    yield pa.RecordBatch.from_arrays([pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.int32()), pa.nulls(SKETCH_PARTS, pa.int64()), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "n", "node", "part", "cells"])


def _pack(cells: np.ndarray) -> bytes:
    """Counts of a part of a sketch; most are small, so they deflate to a fraction."""
    return zlib.compress(np.minimum(cells, 0xFFFFFFFF).astype("<u4").tobytes(), 1)


def _unpack_cells(part: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(part), dtype="<u4")


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = _unpack_cells(cells).astype(np.int64)
            total[part] = total[part] + new if part in total else new
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_pack(v) for v in total.values()], pa.binary())], names=["part", "cells"])


def _bands(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How frequent the shingles of each sketch cell are, in half octaves above the mean, and which cells may hold a heavy one.

    The driver gets a sketch of fixed size.
    """
    once = sketches.repartition(32).mapInArrow(_add_sketches, "part int, cells binary")
    rows = once.repartition(16, "part").mapInArrow(_add_sketches, "part int, cells binary").collect()
    cells = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS))
    for row in rows:
        cells[row.part] = _unpack_cells(row.cells)
    flat = cells.reshape(-1)
    return np.floor(2 * np.log2(np.maximum(flat / max(8.0, flat.mean()), 1))).astype(np.uint8), np.packbits(flat > HEAVY_ROWS)


def _order_key(shingles: np.ndarray, bands: np.ndarray, seed: int) -> np.ndarray:
    band = bands[(shingles >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(_U)
    return (band << _U(56)) | (mix64(shingles ^ _U(seed)) >> _U(8))


def _prefixes(flat: np.ndarray, starts: np.ndarray, bands: np.ndarray, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each set the indices of its prefix under an order, in that order; and how long each is."""
    key = _order_key(flat, bands, seed)
    out = []
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        n = j - i
        p = n - (3 * n + 3) // 4 + 1 if n else 0
        own = key[i:j]
        some = np.argpartition(own, p - 1)[:p] if p < n else np.arange(n)
        out.append(some[np.argsort(own[some])] + i)
    return out, np.array([len(x) for x in out], dtype=np.int64)


def _emit_prefixes(bands, heavy):
    """(text) to (t, salt, node, n, pos): the first order's prefix of each text; a set that comes again in a task is passed over.

    salt is -1, but for shingles that may be heavy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        is_heavy = np.unpackbits(heavy.value).astype(bool)
        for batch in batches:
            for flat, starts in distinct_shingles(batch.column(0)):
                sigs, sizes = set_signatures(flat, starts), np.diff(starts)
                own, size = _prefixes(flat, starts, bands.value, ORDER_SEEDS[0])
                new = [k for k, s in enumerate(sigs.tolist()) if sizes[k] and not (s in seen or seen.add(s))]
                if len(seen) > 1_000_000:
                    seen.clear()
                if new:
                    at = np.concatenate([own[k] for k in new])
                    pos = np.concatenate([np.arange(size[k], dtype=np.int32) for k in new])
                    nodes = np.repeat(sigs[new], size[new])
                    salt = np.where(is_heavy[(flat[at] >> _U(64 - SKETCH_BITS)).astype(np.int64)], nodes % SALTS, -1).astype(np.int32)
                    cols = [flat[at].view(np.int64), salt, nodes, np.repeat(sizes[new].astype(np.int32), size[new]), pos]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["t", "salt", "node", "n", "pos"])

    return run


def _possible(n1, p1, n2, p2):
    """Whether sets of these sizes whose first common shingle stands at these positions can link (numpy or columns)."""
    low = np.minimum if isinstance(n1, np.ndarray) else F.least
    high = np.maximum if isinstance(n1, np.ndarray) else F.greatest
    most = low(n1 - p1, n2 - p2)
    return (most * 7 >= (n1 + n2) * 3) & (low(n1, n2) * 4 >= high(n1, n2) * 3)


def _pairs_of_runs(ends: np.ndarray, n: np.ndarray, pos: np.ndarray, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j, j before ends[i]) that can link, some millions at a time."""
    partners = ends - np.arange(len(ends)) - 1
    done = np.concatenate([[0], np.cumsum(partners)])
    i0 = 0
    while i0 < len(ends):
        i1 = max(i0 + 1, int(np.searchsorted(done, done[i0] + 2_000_000, side="right")) - 1)
        count = partners[i0:i1]
        i = np.repeat(np.arange(i0, i1), count)
        j = np.arange(len(i)) - np.repeat(done[i0:i1] - done[i0], count) + i + 1
        ok = _possible(n[i], pos[i], n[j], pos[j])
        if skip is not None:
            ok &= ~skip(i, j)
        if ok.any():
            yield i[ok], j[ok]
        i0 = i1


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut where the first so many columns change: each has whole runs of equal keys."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(held[0]) < 2:
            continue
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:keys]], axis=0))
        if len(change):
            cut = int(change[-1]) + 1
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _run_ends(cols: list[np.ndarray], keys: int) -> np.ndarray:
    """For each row the end of its run."""
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)) + 1
    bounds = np.concatenate([[0], cuts, [len(cols[0])]])
    return np.repeat(bounds[1:], np.diff(bounds))


_CANDIDATE = "a long, b long, t long, node long, n int, pos int"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, salt, node, n, pos) sorted by (t, salt, node): possible pairs (a, b) of short postings, and the rows of long ones.

    Repeated rows of a node count once.  Rows of a posting that is known to be long are sent on at once.
    """
    names = ["a", "b", "t", "node", "n", "pos"]

    def long_rows(cols: list[np.ndarray]) -> pa.RecordBatch:
        none = pa.nulls(len(cols[0]), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *(pa.array(cols[k]) for k in (0, 2, 3, 4))], names=names)

    def short_pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, _, node, n, pos = cols
        for i, j in _pairs_of_runs(_run_ends([t], 1), n, pos):
            pair = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0)
            none = pa.nulls(len(pair), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, none, none.cast(pa.int32()), none.cast(pa.int32())], names=names)

    held: list[np.ndarray] | None = None
    last, streamed = None, None  # the last row told, and the posting whose rows are sent on as they come
    for batch in _and_end(batches):
        if batch is not None:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            key = np.stack([cols[0], cols[2]])
            fresh = np.concatenate([[last is None or (key[:, 0] != last).any()], (key[:, 1:] != key[:, :-1]).any(axis=0)])
            last = key[:, -1]
            cols = [c[fresh] for c in cols]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if held is None or not len(held[0]):
            continue
        cols = held
        ends = _run_ends([cols[0]], 1)
        size = np.bincount(ends, minlength=len(ends) + 1)[ends]
        long = (size > SHORT_POSTING) | (cols[1] >= 0) | (cols[0] == streamed if streamed is not None else False)
        still = np.zeros(len(ends), dtype=bool) if batch is None else (ends == len(ends)) & ~long  # a short posting that may go on
        short = ~long & ~still & (size > 1)
        if short.any():
            yield from short_pairs([c[short] for c in cols])
        if long.any():
            yield long_rows([c[long] for c in cols])
            streamed = cols[0][-1] if long[-1] else None
        elif not still.all():
            streamed = None
        held = [c[still] for c in cols]


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _texts_of(bands):
    """(text) to (node, n, p2, p3, text): the prefixes under the second and third order, 32 bits a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in batches:
            node, n, filters = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], ([], [])
            for flat, starts in distinct_shingles(batch.column(0)):
                node.append(set_signatures(flat, starts))
                n.append(np.diff(starts))
                for out, seed in zip(filters, ORDER_SEEDS[1:], strict=True):
                    out += [flat[at].astype(np.uint32).view(np.int32) for at in _prefixes(flat, starts, bands.value, seed)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(n).astype(np.int32)), *(pa.array(f, lists) for f in filters), batch.column(0)], names=["node", "n", "p2", "p3", "text"])

    return run


def _enough_shared(order: str) -> F.Column:
    """Whether the prefixes under an order share enough for a link.

    Where the prefix that ends first ends, everything shared so far is in both prefixes, so the intersection is at most
    that and the rest of that set.  Shingles of one prefix that agree in 32 bits are added back.
    """
    a, b, pa_, pb_ = F.col("an"), F.col("bn"), F.col("a" + order), F.col("b" + order)
    shared = F.size(F.array_intersect(pa_, pb_)) + F.size(pa_) - F.size(F.array_distinct(pa_))
    rest = F.greatest(a - F.size(pa_), b - F.size(pb_))
    return (shared > 0) & ((shared + rest) * 7 >= (a + b) * 3)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ta, tb) to (a, b, linked) by the exact intersection of the shingles of both whole texts."""
    for batch in batches:
        linked = []
        for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True):
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common >= 75 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _cross_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, lo, hi, side, node, comp, n, pos) sorted by (t, lo, hi) to (a, others): partners in other components, as packed ids.

    A run holds two blocks of a posting, about 2 * BLOCK_ROWS rows.
    """
    for cols in _runs(batches, 3):
        _, lo, hi, side, node, comp, n, pos = cols
        ends = _run_ends(cols, 3)
        for i, j in _pairs_of_runs(ends, n, pos, lambda i, j: (comp[i] == comp[j]) | ((lo[i] != hi[i]) & (side[i] == side[j]))):
            at = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            offsets = np.append(at, len(i)).astype(np.int64) * 8
            others = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(node[j].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(node[i[at]]), others.cast(pa.binary())], names=["a", "others"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, others) sorted by a to distinct pairs (a, b)."""
    held: tuple[int, np.ndarray] | None = None
    for batch in batches:
        a_out, b_out = [], []
        for a, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = np.frombuffer(others, dtype=np.int64)
            if held and held[0] == a:
                held = (a, np.union1d(held[1], new))
                continue
            if held:
                a_out.append(np.full(len(held[1]), held[0]))
                b_out.append(held[1])
            held = (a, np.unique(new))
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held[1]), held[0])), pa.array(held[1])], names=["a", "b"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_shingles, component_id), a row for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = stored(docs.mapInArrow(_profile, "doc_id long, n int, node long, part int, cells binary"), "profile")
    bands, heavy = map(spark.sparkContext.broadcast, _bands(profile.where("part IS NOT NULL").select("part", "cells")))
    rows = profile.where("part IS NULL").select("doc_id", "n", "node")
    nodes = stored(rows.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")

    prefixes = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_emit_prefixes(bands, heavy), "t long, salt int, node long, n int, pos int")
    found = stored(prefixes.repartition("t", "salt").sortWithinPartitions("t", "salt", "node").mapInArrow(_candidates, _CANDIDATE), "candidates")
    postings = found.where("a IS NULL").select("t", "node", "n", "pos")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct()

    def verified(pairs: DataFrame, done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The links among pairs (a, b) that pass the filters of all orders, and all pairs tested so far."""
        if done is not None:
            pairs = pairs.join(done.hint("merge"), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        ids = stored(ends(pairs).join(nodes, "node").select("doc_id").distinct(), "wanted")
        texts = stored(keep_ids(docs, ids, "doc_id").select("text").mapInArrow(_texts_of(bands), "node long, n int, p2 array<int>, p3 array<int>, text string"), "texts")

        def beside(near: DataFrame, *cols: str) -> DataFrame:
            """near with columns of both ends' texts; only ends that are left are dealt out."""
            left = keep_ids(texts.select("node", *cols), stored(ends(near), "ends"), "node")
            side = lambda x: left.select(F.col("node").alias(x), *(F.col(c).alias(x + c) for c in cols)).hint("merge")
            return near.join(side("b"), "b").join(side("a"), "a")

        near = pairs
        for order in ("p2", "p3"):
            near = stored(beside(near, "n", order).where(_enough_shared(order)).select("a", "b").distinct(), "near")
        near = beside(near, "text").select("a", "b", "atext", "btext")
        links = stored(near.mapInArrow(_verify, "a long, b long, linked boolean").where("linked").select("a", "b"), "links")
        return links, pairs if done is None else done.union(pairs)

    links, done, open_rows, comps = None, None, postings.withColumn("comp", F.col("node")), None
    for turn in range(STAR_ROUNDS):
        pivot = open_rows.groupBy("t").agg(F.min_by(F.struct("node", "n", "pos", "comp"), F.struct(F.col("pos") * (1 - turn), F.xxhash64("node", F.lit(turn)))).alias("p"))
        pivot = _beside_rows(stored(pivot.select("t", "p.*"), "pivots"))
        star = open_rows.alias("y").join(pivot.alias("x"), "t").where("x.comp <> y.comp")
        star = star.where(_possible(*(F.col(c) for c in ("x.n", "x.pos", "y.n", "y.pos"))))
        pairs = star.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        if not turn:
            pairs = pairs.union(found.where("a IS NOT NULL").select("a", "b"))
        new, done = verified(pairs.distinct(), done)
        links = new if links is None else links.union(new)
        comps = _components(nodes, links)
        open_rows = stored(_unsettled(open_rows.drop("comp", "size"), comps), "open")

    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    grid = open_rows.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    grid = grid.select("t", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "comp", "n", "pos")
    grid = grid.repartition("t", "lo", "hi").sortWithinPartitions("t", "lo", "hi")
    cross = grid.mapInArrow(_cross_blocks, "a long, others binary").repartition("a").sortWithinPartitions("a").mapInArrow(_unpack, "a long, b long")
    new, _ = verified(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), done)
    comps = _components(nodes, links.union(new))

    least = comps.join(nodes, "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    final = comps.join(least, "comp").select("node", "component_id")
    return (
        rows.join(final, "node", "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("component_id"))
    )


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges)
    return stored(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "comps")


def _unsettled(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """The postings whose members are in more than one component, with comp, and size: members of the posting."""
    known = stored(postings.join(comps.hint("merge"), "node"), "known")
    open_ = known.groupBy("t").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("t", "size")
    return known.join(_beside_rows(stored(open_, "unsettled")), "t").select("t", "node", "n", "pos", "comp", "size")


def _beside_rows(postings: DataFrame) -> DataFrame:
    """One row a posting, to be joined to the rows of postings: broadcast behind a count, so that a large posting stays where it is; merged beyond it, where
    Spark splits skewed postings."""
    return F.broadcast(postings) if small(postings) else postings.hint("merge")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM w),
t AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = s.doc_id
"""
