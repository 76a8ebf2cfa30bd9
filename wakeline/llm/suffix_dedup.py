"""Operator 8, suffix-array dedup: bytes covered by a WINDOW-byte string that starts anywhere else as well are removed.

1.  Anchors.  Among the hashes of the ANCHOR-byte strings inside a window, the smallest (the first of equal ones) is the window's
    anchor.  Equal windows have their anchors at the same place, so only windows whose anchor string recurs can recur.
    Anchors (one for each 130 bytes or so) are counted by hash; those that occur once go.
2.  Contexts.  A recurring anchor's context is the bytes to its left and right that windows around it can reach.  Of equal contexts one is
    kept; the windows of the others are settled with it.
3.  Suffixes.  The suffixes that begin at the anchors are put in order deep-shallow: a multikey quicksort on characters of eight
    bytes to a shallow depth, then a blind trie for each group that is still equal.  The reversed left sides are ordered
    alike.  A window that begins l bytes before an anchor recurs if another member has the same l bytes on the left
    and the same WINDOW - l on the right: both are classes of neighbours in the two orders.
4.  All windows of an anchor hold it, so the bytes they cover run from the first to the last; documents merge these runs.

A group that more than GROUP_ROWS different contexts share is not sorted in one task.  It is split by the bytes that come next: its windows
are cut into ranges of l (WIDTHS wide, finer from level to level), and members meet in a range only if all bytes that every window of the
range holds are equal.  Members that agree in all bytes of all windows of a range are one again.  What is left of at most GROUP_ROWS is sorted
as above; the finest ranges are single windows, where members that meet are equal and nothing is left to sort.

Equal texts are one node (a 64-bit hash of the text); a text of WINDOW bytes or more that occurs twice is removed whole.
A null text is empty; texts below WINDOW bytes keep all; repeated rows are copies of each other; ids may be null.  An empty table gives
an empty result.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import mix64, powers, prefix_hash, slices, utf8
from .shared import keep_ids, read_table, small, stored

_U = np.uint64
WINDOW = 400
ANCHOR = 128
#: Bytes to the left of an anchor that a window around it can hold.
REACH = WINDOW - ANCHOR
#: Depth in bytes, after the anchor itself, to which suffixes are ordered by quicksort; deeper ties go to blind tries.
SHALLOW = 16
#: A group of more members is split by its next bytes instead of sorted in one task (about 700 bytes a member).
GROUP_ROWS = 1_024
#: How many windows a range holds, level by level; at first all that an anchor can have.
WIDTHS = (REACH + 1, 32, 4, 1)
CHUNK = 4 << 20


def anchors_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all texts in a slice of bytes, and the hashes of their strings."""
    n = len(buf)
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    if n < WINDOW:
        return none
    if n > CHUNK + WINDOW and len(offsets) == 2:  # one very long text: chunks that overlap by a window
        found = [(p + i, h) for i in range(0, n - WINDOW + 1, CHUNK) for p, h in [anchors_of(buf[i : i + CHUNK + WINDOW - 1], np.array([0, min(CHUNK + WINDOW - 1, n - i)]))]]
        at, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
        return at, np.concatenate([h for _, h in found])[first]
    c = prefix_hash(buf)
    _, inverse = powers(n)
    h = mix64((c[ANCHOR:] - c[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    key = (h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=_U)
    # sliding minimum over w keys: block-wise minima from the left and from the right
    w = REACH + 1
    m = -(-len(key) // w) * w
    padded = np.full(m, ~_U(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - WINDOW + 1
    low = np.minimum(right[:starts], left[w - 1 : w - 1 + starts])
    inside = np.zeros(n + 1, dtype=np.int32)  # windows that end inside their own text
    sizes = np.diff(offsets)
    whole = sizes >= WINDOW
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - WINDOW + 1, -1)
    at = (low & _U(0xFFFFFF)).astype(np.int64)[np.cumsum(inside)[:starts] > 0]
    if not len(at):
        return none
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (h, node, pos)."""
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        buf, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            off = offsets[i : j + 1] - offsets[i]
            at, h = anchors_of(buf[offsets[i] : offsets[j]], off)
            doc = np.searchsorted(off, at, side="right") - 1
            fresh = np.array([not (s in seen or seen.add(s)) for s in nodes[i:j].tolist()])
            if len(seen) > 1_000_000:
                seen.clear()
            ok = fresh[doc]
            if ok.any():
                at, h, doc = at[ok], h[ok], doc[ok]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(nodes[i:j][doc]), pa.array((at - off[doc]).astype(np.int32))], names=["h", "node", "pos"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[dict]]]:
    """(node, text, anchors) sorted by node, each node once."""
    last = None
    for batch in batches:
        for node, text, anchors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if node != last:
                yield node, text.as_buffer().to_pybytes(), anchors
            last = node


_CONTEXT = "k1 long, k2 long, node long, pos int, lft binary, rgt binary"


def _batches(rows: Iterator[tuple], kinds: tuple, names: list[str], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text, anchors of (pos, k1, k2, low, high)) to contexts: the bytes that windows of l from low to high hold on either side."""

    def rows() -> Iterator[tuple]:
        for node, raw, anchors in _once(batches):
            for a in anchors:
                p = a["pos"]
                yield a["k1"], a["k2"], node, p, raw[max(0, p - a["high"]) : p], raw[p : p + WINDOW - a["low"]]

    yield from _batches(rows(), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), ["k1", "k2", "node", "pos", "lft", "rgt"])


_RANGE = "c1 long, c2 long, o1 long, o2 long, node long, pos int, low int, high int"


def _ranges(width: int):
    """(node, text, anchors of (pos, low, high)) to the ranges of width windows in them: hashes of the bytes that all windows of a range hold (c1, c2), and of all bytes that any holds (o1, o2)."""

    def pair(*parts: bytes) -> tuple[int, int]:
        return struct.unpack("<qq", hashlib.blake2b(b"".join(parts), digest_size=16).digest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for node, raw, anchors in _once(batches):
                for a in anchors:
                    p = a["pos"]
                    for first in range(a["low"] // width * width, a["high"] + 1, width):
                        last = min(first + width - 1, REACH)
                        low, high = max(first, p + WINDOW - len(raw)), min(last, p)
                        if low <= high:
                            core = pair(struct.pack("<hh", first, last), raw[p - first : p + WINDOW - last])
                            yield *core, *pair(struct.pack("<hh", low, high), raw[p - high : p + WINDOW - low]), node, p, low, high

        kinds = (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int32())
        yield from _batches(rows(), kinds, ["c1", "c2", "o1", "o2", "node", "pos", "low", "high"])

    return run


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes hold only a depth and first bytes; an insertion compares with one leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: object = [0]
        for i in range(1, len(strings)):
            self._insert(i)

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (x.bit_length() + 7) // 8

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        node = self.root
        while isinstance(node, tuple):  # (depth, {byte or -1: subtree})
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[0]]
        common = self._common(s, other)
        if common == len(s) == len(other):
            node.append(i)
            return
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < common:
            parent, key = node, s[node[0]]
            node = node[1][key]
        byte = s[common] if common < len(s) else -1
        if isinstance(node, tuple) and node[0] == common:
            node[1][byte] = [i]
            return
        split = (common, {byte: [i], (other[common] if common < len(other) else -1): node})
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def multikey_quicksort(group: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of rows of chars within equal values of group, and the runs of rows that are equal in all characters.

    All segments are partitioned side by side, each round once, into less than, equal to and greater than a pivot of their own (the median of
    three) in their own column; the equal part goes on to the next column.
    """
    n, depth = chars.shape
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(group[order[1:]] != group[order[:-1]]) + 1
    start, end = np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [n]]).astype(np.int64)
    column, equal = np.zeros(len(start), dtype=np.int64), []
    while True:
        big = end - start > 1
        done = big & (column == depth)
        equal += zip(start[done].tolist(), end[done].tolist(), strict=True)
        start, end, column = (x[big & ~done] for x in (start, end, column))
        if not len(start):
            return order, equal
        size = end - start
        seg = np.repeat(np.arange(len(start)), size)
        base = np.cumsum(size) - size
        place = np.arange(len(seg)) - base[seg] + start[seg]
        rows = order[place]
        value = chars[rows, column[seg]]
        three = np.sort(np.stack([chars[order[at], column] for at in (start, (start + end) // 2, end - 1)]), axis=0)[1][seg]
        less, more = value < three, value > three
        same = ~(less | more)
        rank = lambda mark: np.cumsum(mark) - np.concatenate([[0], np.cumsum(mark)])[base][seg] - 1
        n_less, n_same = np.bincount(seg[less], minlength=len(start)), np.bincount(seg[same], minlength=len(start))
        to = start[seg] + np.where(less, rank(less), np.where(same, n_less[seg] + rank(same), (n_less + n_same)[seg] + rank(more)))
        order[to] = rows
        one, two = start + n_less, start + n_less + n_same
        start, end, column = np.concatenate([start, one, two]), np.concatenate([one, two, end]), np.concatenate([column, column + 1, column])


def deep_shallow_order(group: np.ndarray, strings: list[bytes], skip: int) -> np.ndarray:
    """An order of strings within equal values of group: multikey quicksort on eight-byte characters from skip on, then blind tries."""
    chars = np.frombuffer(b"".join(s[skip : skip + SHALLOW].ljust(SHALLOW, b"\0") for s in strings), dtype=">u8").reshape(len(strings), -1).astype(_U)
    order, equal = multikey_quicksort(group, chars)
    for i, j in equal:
        members = order[i:j]
        order[i:j] = members[BlindTrie([strings[m] for m in members.tolist()]).ordered()]
    return order


def _neighbour_common(group: np.ndarray, strings: list[bytes], order: np.ndarray) -> np.ndarray:
    """Common prefix of each string with the one before it in an order; -1 where the group begins."""
    out = np.full(len(order), -1, dtype=np.int32)
    o = order.tolist()
    for k in range(1, len(o)):
        if group[o[k]] == group[o[k - 1]]:
            out[k] = BlindTrie._common(strings[o[k]], strings[o[k - 1]])
    return out


def recurring_reach(group: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each member of an anchor group: the most and the fewest bytes before the anchor at which a recurring window begins (-1: none)."""
    n = len(group)
    most, fewest = np.full(n, -1), np.full(n, -1)
    turned = [x[::-1] for x in lefts]
    orders = [deep_shallow_order(group, rights, ANCHOR), deep_shallow_order(group, turned, 0)]
    commons = [_neighbour_common(group, x, o) for x, o in zip((rights, turned), orders, strict=True)]
    best = []
    for o, c in zip(orders, commons, strict=True):
        reach = np.zeros(n, dtype=np.int32)
        reach[o] = np.maximum(c, np.append(c[1:], -1))
        best.append(reach)
    able = np.flatnonzero(best[0] + best[1] >= WINDOW)
    if not len(able):
        return most, fewest
    n_left, n_right = np.array([len(x) for x in lefts])[able], np.array([len(x) for x in rights])[able]
    right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for l in range(REACH + 1):  # noqa: E741
        ok = (n_left >= l) & (n_right >= WINDOW - l) & (best[0][able] >= WINDOW - l) & (best[1][able] >= l)
        some = able[ok]
        if len(some) < 2:
            continue
        right_class[orders[0]] = np.cumsum(commons[0] < WINDOW - l)
        left_class[orders[1]] = np.cumsum(commons[1] < l)
        key = right_class[some] * (n + 1) + left_class[some]
        by = np.argsort(key, kind="stable")
        twin = np.concatenate([[False], key[by[1:]] == key[by[:-1]]])
        twin[:-1] |= twin[1:]
        rows = some[by[twin]]
        most[rows] = l
        fewest[rows[fewest[rows] < 0]] = l
    return most, fewest


_SPAN = "node long, first int, last int"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by (k1, k2) to the removed runs (node, first, last) of each member, last excluded."""
    held: list[tuple] = []

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        k1, k2, node, pos = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        group = np.concatenate([[0], np.cumsum((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))])
        most, fewest = recurring_reach(group, [r[4] for r in rows], [r[5] for r in rows])
        ok = most >= 0
        if not ok.any():
            return None
        first, last = (pos - most)[ok], (pos - fewest)[ok] + WINDOW
        return pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["node", "first", "last"])

    for batch in batches:
        held += list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        while len(held) > 20_000 and held[0][:2] != held[-1][:2]:
            cut = len(held) - 1
            while held[cut - 1][:2] == held[cut][:2]:
                cut -= 1
            if (out := settle(held[:cut])) is not None:
                yield out
            held = held[cut:]
    if held and (out := settle(held)) is not None:
        yield out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to (doc_id, n_bytes, n_removed, n_spans, kept): the remaining bytes after the merged runs."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        kept, sizes, runs = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            own = merge_spans([(s["first"], s["last"]) for s in spans])
            ends = [0, *(x for run in own for x in run), len(raw)]
            kept.append(b"".join(raw[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)))
            sizes.append(len(raw))
            runs.append(len(own))
        cols = [pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()), pa.array(runs, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(kept, pa.binary())], names=names)


def _as_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([t.decode(errors="ignore") for t in texts.to_pylist()], pa.string())


def _one_a_node(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes: the row with the node's smallest id; of rows that repeat id and text, one."""
    firsts = stored(nodes.join(wanted.hint("merge"), "node", "left_semi").select("node", "id", "again"), "firsts")
    some = keep_ids(docs, firsts.where("NOT again").select("node", "id"), ["node", "id"]).select("node", "text")
    again = firsts.where("again").select("node", "id")
    return some if again.isEmpty() else some.union(keep_ids(docs, again, ["node", "id"]).select("node", "text").dropDuplicates(["node"]))


def recurring_spans(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """docs (node, id, text) to (node, spans): for each node with any, the array of (first, last) of its recurring bytes."""
    found = stored(docs.select("node", "text").mapInArrow(_emit_anchors, "h long, node long, pos int"), "anchors")
    place = F.xxhash64("node", "pos")
    groups = found.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h")
    groups = stored(groups, "groups")  # so that a merge with it can split a hot anchor
    open_ = stored(found.join(groups.hint("merge"), "h", "left_semi").select("node", "pos", F.lit(0).alias("low"), F.lit(REACH).alias("high")), "recurring")
    texts = stored(_one_a_node(docs, nodes, open_.select("node").distinct()), "texts")

    def with_text(rows: DataFrame, *cols: str) -> DataFrame:
        own = rows.groupBy("node").agg(F.collect_set(F.struct("pos", "low", "high", *cols)).alias("anchors"))
        return texts.join(own.hint("merge"), "node").select("node", "text", "anchors").sortWithinPartitions("node")

    def by_sorting(rows: DataFrame) -> DataFrame:
        contexts = with_text(rows, "k1", "k2").mapInArrow(_contexts, _CONTEXT)
        return stored(contexts.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_spans, _SPAN), "sorted")

    spans = None
    for width in WIDTHS:
        ranges = stored(with_text(open_).mapInArrow(_ranges(width), _RANGE), "ranges")
        alike = stored(ranges.groupBy("o1", "o2").agg(F.count("*").alias("n"), F.min(place).alias("stands")), "classes")
        ranges = stored(ranges.join(alike.hint("merge"), ["o1", "o2"]).select("c1", "c2", "node", "pos", "low", "high", (F.col("n") > 1).alias("twin"), (F.col("stands") == place).alias("stands")), "alike")
        settled = ranges.where("twin").select("node", (F.col("pos") - F.col("high")).alias("first"), (F.col("pos") - F.col("low") + WINDOW).alias("last"))
        spans = settled if spans is None else spans.union(settled)
        if width == 1:
            break
        rest = ranges.where("stands").select("c1", "c2", "node", "pos", "low", "high")
        core = rest.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), (F.col("n") > GROUP_ROWS).alias("large"))
        core = stored(core, "cores")
        rest = rest.withColumnRenamed("c1", "k1").withColumnRenamed("c2", "k2").join(core.hint("merge"), ["k1", "k2"])
        rest = stored(rest.select("node", "pos", "k1", "k2", "low", "high", "large"), "open")
        spans, open_ = spans.union(by_sorting(rest.where("NOT large"))), rest.where("large")
        if open_.isEmpty():
            break
    return stored(spans.groupBy("node").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated, kept_text), a row for each row of docs.

    kept_text is the remaining bytes as text; a character of which only some bytes remain is left out there (not in the digest).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("node", F.xxhash64("text")).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    nodes = docs.groupBy("node", "id").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size"))
    nodes = nodes.groupBy("node").agg(F.min("id").alias("id"), (F.max("n") > 1).alias("again"), F.sum("n").alias("copies"), F.max("size").alias("size"))
    nodes = stored(nodes, "nodes")
    whole = stored(nodes.where((F.col("copies") > 1) & (F.col("size") >= WINDOW)).select("node"), "whole")
    spans = recurring_spans(docs, nodes)
    cut = stored(spans.join(whole.hint("merge"), "node", "left_anti"), "cut")
    other = stored(whole.union(cut.select("node")), "other")
    size = F.octet_length("text").cast("long")
    none, no_text = F.lit(0).cast("long"), F.lit("")
    left = docs.join(F.broadcast(other) if small(other) else other.hint("merge"), "node", "left_anti")
    left = left.select("doc_id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(False).alias("repeated"), F.col("text").alias("kept_text"))
    gone = keep_ids(docs, whole, "node").select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(no_text, 256).alias("kept_sha256"), F.lit(True).alias("repeated"), no_text.alias("kept_text"))
    part = keep_ids(docs, cut.select("node"), "node").join(cut.hint("merge"), "node").select("doc_id", "text", "spans")
    part = part.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    part = part.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.lit(True).alias("repeated"), F.arrow_udf(_as_text, "string")("kept").alias("kept_text"))
    return left.union(gone).union(part)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))
