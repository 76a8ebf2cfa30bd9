"""Operator 11, Merkle dataset manifest by bitmap-rank indexing.

A leaf's place is the rank of its doc_id among its source's, found without sorting leaves:

1. Each task packs the ids that it reads into compressed bitmaps, one for each source and run of 2**16 ids (an array of the low bits, or a plain
   bitmap where that is smaller); bitmaps of the same source and run are merged.  Ids that occur more than once are listed beside them.
2. Popcount directories hold how many rows lie before each bitmap, in levels of FAN: a bitmap's count within its 4,096 neighbours, theirs
   within 4,096 groups, and so on, so no window is larger than that.
3. A bitmap's words (64 ids) go out with the number of rows before them.  A leaf looks up its word; its rank is that number plus the popcount of
   the bits below its own.

Then keyed slot arrays reduce levels: the rows of a node's ARITY slots are gathered into an array by slot, and hashed.  A level has a
sixteenth of the rows of the one below.  Paths (what lies left and right of a node in its run) go down from the root, a level at a time, and only
whole runs are joined, so a leaf's path is never shuffled by itself.  A source with a third of all rows is spread over as many keys as it has runs.

Repeated ids in a source are ordered by leaf; rows that agree in all fields share a leaf, so it doesn't matter which of them comes first.  Null ids
come before all others, and null sources before all sources.  A null field is told from an empty one.  A source of one row has its leaf as
subroot, and a table of one source its subroot as root.  An empty table gives an empty manifest.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, read_table, small, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
#: Nodes of a popcount directory that one of the next level covers, as a power of two, and the levels that cover all 64-bit ids.
FAN_BITS = 12
LEVELS = 5
#: Ids of a bitmap, as a power of two, and the number of the run that null ids make, before all others.
RUN_BITS = 16
_NULL_RUN = -(1 << (63 - RUN_BITS)) - 1
#: Repeated rows are numbered in blocks of so many.
BLOCK = 10_000

_PACKED = "g string, run long, bits binary, again array<struct<low: int, n: long>>, n long"


def digest(*parts: Column) -> Column:
    """H: the lowercase hex SHA-256 of texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field's unambiguous text: '-' for null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**values: Column) -> Column:
    """The digest of FIELDS, or of other values given for some of them."""
    return digest(*(field(values.get(name, F.col(name))) for name in FIELDS))


# bitmaps -----------------------------------------------------------------------------------------------------------------------------------


def pack(lows: np.ndarray) -> bytes:
    """Sorted distinct low bits as an array, or as a bitmap where that is smaller."""
    if len(lows) * 2 < (1 << RUN_BITS) // 8:
        return lows.astype("<u2").tobytes()
    bits = np.zeros(1 << RUN_BITS, dtype=np.uint8)
    bits[lows] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if len(packed) < (1 << RUN_BITS) // 8:
        return np.frombuffer(packed, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little"))


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    """rows of (g, run, lows, counts)."""
    again = [[{"low": int(low), "n": int(n)} for low, n in zip(lows[counts > 1], counts[counts > 1], strict=True)] for _, _, lows, counts in rows]
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([pack(r[2]) for r in rows], pa.binary())]
    columns += [pa.array(again, pa.list_(pa.struct([("low", pa.int32()), ("n", pa.int64())]))), pa.array([int(r[3].sum()) for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["g", "run", "bits", "again", "n"])


def _pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, run, low) to a bitmap for each source and run of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).dictionary_encode()
        code, run, low = g.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        order = np.lexsort((low, run, code))
        code, run, low = code[order], run[order], low[order]
        fresh = np.ones(len(low) + 1, dtype=bool)
        fresh[1:-1] = (code[1:] != code[:-1]) | (run[1:] != run[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(fresh)
        counts, code, run, low = np.diff(at), code[at[:-1]], run[at[:-1]], low[at[:-1]]
        begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (run[1:] != run[:-1])]))
        names = g.dictionary.to_pylist()
        yield _packed_rows([(names[code[a]], run[a], low[a:b], counts[a:b]) for a, b in zip(begin, [*begin[1:], len(low)], strict=True)])


def _merge_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps in the order of (g, run) to one for each; no more than one is open."""
    key, counts, done = None, np.zeros(1 << RUN_BITS, dtype=np.int64), []

    def close() -> None:
        lows = np.flatnonzero(counts)
        done.append((*key, lows, counts[lows]))

    for batch in batches:
        for g, run, bits, again in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != (g, run):
                if key is not None:
                    close()
                key = (g, run)
                counts[:] = 0
            counts[unpack(bits)] += 1
            for x in again:
                counts[x["low"]] += x["n"] - 1
            if len(done) >= 256:
                yield _packed_rows(done)
                done.clear()
    if key is not None:
        close()
    if done:
        yield _packed_rows(done)


_WORDS = "g string, word long, bits long, before long, again array<struct<bit: int, n: long>>, total long"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, run, bits, again, before, total) to the words of each bitmap, with the rows before each."""
    kind = pa.list_(pa.struct([("bit", pa.int32()), ("n", pa.int64())]))
    for batch in batches:
        for g, run, bits, again, before, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lows = unpack(bits)
            counts = np.ones(len(lows), dtype=np.int64)
            more: dict[int, list] = {}
            for x in again:
                counts[np.searchsorted(lows, x["low"])] = x["n"]
                more.setdefault(x["low"] >> 6, []).append({"bit": x["low"] & 63, "n": x["n"] - 1})
            words, at = np.unique(lows >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (lows & 63).astype(np.uint64), at).view(np.int64)
            n = len(words)
            below = before + np.concatenate([[0], np.cumsum(counts)])[at]
            extra = pa.array([more.get(int(w), []) for w in words] if more else [[]] * n, kind)
            yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.string()), pa.array((run << (RUN_BITS - 6)) + words), pa.array(value), pa.array(below), extra, pa.array([total] * n, pa.int64())], names=["g", "word", "bits", "before", "again", "total"])


def _run_of(key: Column) -> Column:
    return F.coalesce(F.shiftright(key, RUN_BITS), F.lit(_NULL_RUN))


def directory(bitmaps: DataFrame) -> DataFrame:
    """(g, run, n) to (g, run, before, total): the rows of the same g in smaller runs, and in all."""
    levels = [bitmaps.select("g", F.col("run").alias("at"), "n")]
    steps = []
    for _ in range(LEVELS):
        up = F.shiftright("at", FAN_BITS)
        within = Window.partitionBy("g", "up").orderBy("at")
        part = levels[-1].withColumn("up", up).withColumn("in", F.sum("n").over(within) - F.col("n"))
        steps.append(stored(part.select("g", "at", "up", "in", "n"), "directory"))
        levels.append(steps[-1].groupBy("g", F.col("up").alias("at")).agg(F.sum("n").alias("n")))
    # the last level has at most two nodes for each g: those of negative and other ids
    top = levels[-1].withColumn("total", F.sum("n").over(Window.partitionBy("g"))).withColumn("before", F.sum("n").over(Window.partitionBy("g").orderBy("at")) - F.col("n"))
    for step in reversed(steps):
        above = top.select("g", F.col("at").alias("up"), "before", "total")
        top = step.join(above.hint("merge"), ["g", "up"]).select("g", "at", "n", (F.col("before") + F.col("in")).alias("before"), "total")
    return top.select("g", F.col("at").alias("run"), "before", "total")


def ranked(rows: DataFrame, key: str, *, group: str = "g", carry: tuple[str, ...] = ()) -> DataFrame:
    """rows with their rank among those of the same group by a long key (from 0; nulls first), the group's total and, for a key that occurs more than once, ``copies``.

    The rank is the same for rows with equal keys: that of the first of them.
    """
    run, low = _run_of(F.col(key)), F.coalesce(F.col(key).bitwiseAND((1 << RUN_BITS) - 1), F.lit(0))
    packed = rows.select(F.col(group).alias("g"), run.alias("run"), low.alias("low")).mapInArrow(_pack_ids, _PACKED)
    bitmaps = stored(packed.repartition("g", "run").sortWithinPartitions("g", "run").mapInArrow(_merge_bitmaps, _PACKED), "bitmaps")
    rows_before = directory(bitmaps.select("g", "run", "n"))
    words = bitmaps.drop("n").join(rows_before.hint("merge"), ["g", "run"]).select("g", "run", "bits", "again", "before", "total").mapInArrow(_words, _WORDS)
    word = F.coalesce(F.shiftright(key, 6), F.lit(_NULL_RUN << (RUN_BITS - 6)))
    bit = F.coalesce(F.col(key).bitwiseAND(63), F.lit(0)).cast("int")
    at = rows.select(F.col(group).alias("g"), key, *carry, word.alias("word"), bit.alias("bit")).join(words.hint("merge"), ["g", "word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit")))))
    lower = F.aggregate("again", F.lit(0).cast("long"), lambda s, x: s + F.when(x["bit"] < F.col("bit"), x["n"]).otherwise(0))
    same = F.aggregate("again", F.lit(1).cast("long"), lambda s, x: s + F.when(x["bit"] == F.col("bit"), x["n"]).otherwise(0))
    return at.select("g", key, *carry, (F.col("before") + below + lower).alias("rank"), "total", same.alias("copies"))


def sorted_before(rows: DataFrame, order: list[str], n: str) -> DataFrame:
    """rows with ``before``: the sum of n over all rows that come first in an order, by range partitions and their sums."""
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            each = batch.column(n).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(each)
            yield batch.append_column("before", pa.array(sums - each, pa.int64()))
            total = int(sums[-1]) if len(sums) else total

    named = cut.withColumn("_part", F.spark_partition_id())
    kept = stored(named.mapInArrow(running, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in named.schema)}, before long"), "sorted")
    # a row for each partition
    sizes = kept.groupBy("_part").agg(F.sum(n).alias("_n"))
    offsets = stored(sizes.withColumn("_offset", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_offset"), "offsets")
    return kept.join(F.broadcast(offsets), "_part").withColumn("before", F.col("before") + F.col("_offset")).drop("_part", "_offset")


def coordinates(leaves: DataFrame) -> DataFrame:
    """leaves (g, doc_id, leaf, ...) with ``idx``, the place in the source, and ``n``, the source's leaves; repeated ids are ordered by leaf."""
    carry = tuple(c for c in leaves.columns if c not in ("g", "doc_id"))
    placed = stored(ranked(leaves, "doc_id", carry=carry), "ranked")
    once = placed.where("copies = 1").select("g", "doc_id", *carry, F.col("rank").alias("idx"), F.col("total").alias("n"))
    again = placed.where("copies > 1")
    if again.isEmpty():
        return once
    # equal rows are one with a count, so that a row that makes up much of the table is no hot key
    key = ["g", "doc_id", *carry]
    kinds = again.groupBy(*key, "rank", "total").agg(F.count("*").alias("_count"))
    kinds = stored(sorted_before(kinds, ["g", "doc_id", "leaf", *(c for c in carry if c != "leaf")], "_count"), "kinds")
    first = kinds.groupBy("g", "doc_id").agg(F.min("before").alias("_first")).select(F.col("g").alias("_g"), F.col("doc_id").alias("_id"), "_first")
    kinds = kinds.join(first.hint("merge"), F.col("g").eqNullSafe(F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    start = F.col("rank") + F.col("before") - F.col("_first")
    blocks = kinds.select(*key, start.alias("_start"), "_count", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(BLOCK).cast("long"))).alias("_block"))
    spread = stored(blocks, "blocks").repartition("_start", "_block")
    last = F.least(F.col("_block") + BLOCK, F.col("_count")) - 1
    rows = spread.select(*key, "_start", "total", F.explode(F.sequence("_block", last)).alias("_i"))
    return once.unionByName(rows.select(*key, (F.col("_start") + F.col("_i")).alias("idx"), F.col("total").alias("n")))


# trees -------------------------------------------------------------------------------------------------------------------------------------


def _slots(kids: Column) -> Column:
    """A node's slot array from (slot, ...) entries: each goes to the place that its slot names."""
    by_slot = F.map_from_entries(F.collect_list(F.struct(F.col("slot"), kids)))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(ARITY - 1)), lambda i: F.try_element_at(by_slot, i)), lambda x: x.isNotNull())


def height(n: Column, most: int) -> Column:
    """Levels of a tree of n leaves, 1 at least (a lone leaf has a level that leaves it as it is)."""
    out = F.lit(1)
    for k in range(1, most):
        out = F.when(n > ARITY**k, F.lit(k + 1)).otherwise(out)
    return out


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes (g, idx, n, kid struct with a digest) to the stored levels (g, n, idx, kids, digest) from the lowest up, and the roots (g, n, digest)."""
    out, rows = [], nodes
    while True:
        parent = rows.select("g", "n", F.floor(F.col("idx") / ARITY).alias("idx"), (F.col("idx") % ARITY).cast("int").alias("slot"), "kid")
        level = parent.groupBy("g", "n", "idx").agg(_slots(F.col("kid")).alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
        level = stored(level.withColumn("digest", F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(joined)), "level")
        out.append(level)
        most = ARITY ** len(out)
        rows = level.where(F.col("n") > most).select("g", "n", "idx", F.struct("digest").alias("kid"))
        if rows.isEmpty():
            break
    roots = None
    for k, level in enumerate(out, 1):
        top = level.where((F.col("n") <= ARITY**k) & (F.col("n") > (ARITY ** (k - 1) if k > 1 else 0))).select("g", "n", "digest")
        roots = top if roots is None else roots.unionByName(top)
    return out, roots


def _step(kids: Column, at: Column) -> Column:
    """What lies left and right of the kid at a place of its run."""
    names = F.transform(kids, lambda k: k["digest"])
    return F.struct(F.array_join(F.slice(names, F.lit(1), at), "").alias("left"), F.array_join(F.slice(names, at + 2, F.lit(ARITY)), "").alias("right"))


def with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's kids, each with its path to the root: (g, kid, path).  tops (g, n, path): what follows a group's own root."""
    tops = tops.withColumn("k", height(F.col("n"), len(levels)))
    above = None
    for k in range(len(levels), 0, -1):
        here = tops.where(F.col("k") == k).select("g", F.lit(0).cast("long").alias("idx"), "path")
        above = here if above is None else above.unionByName(here)
        met = levels[k - 1].join(above.hint("merge"), ["g", "idx"]).select("g", "n", "idx", "kids", "path", F.posexplode("kids").alias("at", "kid"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(_step(F.col("kids"), F.col("at"))), F.col("path")))
        above = met.select("g", (F.col("idx") * ARITY + F.col("at")).alias("idx"), "kid", path.alias("path"))
        if k > 1:
            above = stored(above.drop("kid"), "paths")
    return above.select("g", "kid", "path")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings on a path, from the leaf's run up, from left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


_PATH = "array<struct<left: string, right: string>>"


def manifest(docs: DataFrame, **extra: Column) -> DataFrame:
    """docs (FIELDS, ...) to (source, doc_id, leaf, subroot, root, path) and further digests of a row's own that are given by name.

    path holds the siblings of each level as ``left`` and ``right``, from the leaf's run to the root.
    """
    # sources in order of a text that is never null: a null source has the empty one
    g = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), *(c.alias(name) for name, c in extra.items()))
    leaves = stored(leaves, "leaves")
    kid = F.struct(F.col("leaf").alias("digest"), "doc_id", *extra)
    lower, subroots = build(coordinates(leaves).select("g", "idx", "n", kid.alias("kid")))
    discard(leaves)
    # a row for each source
    sources = stored(sorted_before(stored(subroots, "subroots").withColumn("one", F.lit(1).cast("long")), ["g"], "one"), "sources")
    size = F.lit(sources.count()).cast("long")
    kid = F.struct("digest", F.col("g").alias("of"), F.col("n").alias("leaves"))
    upper, roots = build(sources.select(F.lit("").alias("g"), F.col("before").alias("idx"), size.alias("n"), kid.alias("kid")))
    root = roots.first()
    root = root.digest if root else None
    top = with_paths(upper, roots.select("g", "n", F.array().cast(_PATH).alias("path")))
    top = stored(top.select(F.col("kid.of").alias("g"), F.col("kid.leaves").alias("n"), F.col("kid.digest").alias("subroot"), "path"), "tops")
    out = with_paths(lower, top.select("g", "n", "path")).select("g", "kid.*", "path")
    named = top.select("g", "subroot")
    out = out.join(F.broadcast(named) if small(named) else named.hint("merge"), "g")
    source = F.when(F.col("g") != "", F.substring("g", 2, 2_147_483_647))
    return out.select(source.alias("source"), "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path", *extra)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(text=F.translate("text", _UPPER, _LOWER)))
    rows = manifest(docs, now=tampered)
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, levels: int) -> list[str]:
    """Levels of a tree over table name0 (g, idx, n, digest), up to nameN, and what lies beside each node of a level (nameN_s)."""
    parts = []
    for t in range(levels):
        many, at = f"n > {ARITY**t}", f"PARTITION BY g, idx // {ARITY} ORDER BY idx ROWS BETWEEN"
        parts.append(f"{name}{t + 1} AS MATERIALIZED (SELECT g, n, idx // {ARITY} AS idx, CASE WHEN {many} THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest FROM {name}{t} GROUP BY g, n, idx // {ARITY})")
        parts.append(f"{name}{t}_s AS MATERIALIZED (SELECT g, idx, {many} AS many, coalesce(string_agg(digest, '') OVER ({at} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER ({at} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{t})")
    return parts


def _climb_sql(name: str, levels: int, rows: str, g: str, idx: str) -> list[str]:
    """Joins rows (h: a digest, siblings) to each level in turn, folding h and gathering siblings."""
    parts = []
    for t in range(levels):
        parts.append(f"{name}{t}_c AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN s.many THEN sha256(s.l || x.h || s.r) ELSE x.h END AS h, x.siblings || CASE WHEN s.many THEN s.l || s.r ELSE '' END AS siblings) FROM {rows} x JOIN {name}{t}_s s ON s.g = x.{g} AND s.idx = x.{idx} // {ARITY**t})")
        rows = f"{name}{t}_c"
    return parts


def _op11_sql(levels: int = 7, source_levels: int = 4) -> str:
    value = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(value(text if f == "text" else f) for f in FIELDS) + ")"
    parts = [
        "tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))",
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf_of("text")} AS leaf, {leaf_of(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered,
            xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0 AS hit FROM documents, tab)""",
        "a0 AS MATERIALIZED (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, leaf AS digest, CASE WHEN hit THEN lowered ELSE leaf END AS now FROM d)",
        *_tree_sql("a", levels),
        f"b0 AS MATERIALIZED (SELECT '' AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, digest FROM a{levels})",
        *_tree_sql("b", source_levels),
        f"rows0 AS (SELECT a0.*, '' AS top, b0.idx AS source_idx, b0.digest AS subroot, a0.now AS h, '' AS siblings FROM a0 JOIN b0 ON b0.source = a0.g)",
        *_climb_sql("a", levels, "rows0", "g", "idx"),
        *_climb_sql("b", source_levels, f"a{levels - 1}_c", "top", "source_idx"),
    ]
    return f"WITH {', '.join(parts)} SELECT x.doc_id, x.digest AS leaf, x.subroot, r.digest AS root, sha256(x.siblings) AS proof_sha256, x.h AS folded_root, x.h = r.digest AS verified FROM b{source_levels - 1}_c x CROSS JOIN b{source_levels} r"


OP11_SQL = _op11_sql()
