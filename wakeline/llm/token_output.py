"""Operator 9, token-ID output: seekable shards of independent zstandard frames.

Layout of a shard: one zstandard frame (with its own content checksum) for each FRAME_IDS or so token ids, then a seek table in a
skippable frame.  The table holds an entry for each document (id, frame, first id in that frame, number of ids) and for each
frame its offset, its compressed size, the ids in it and a crc32 of its bytes; the last 16 bytes of the table name its
parts.  A reader needs the table and the frames of the documents it wants, nothing else.  Shards are written by Spark's own
writer, one row a file, with an empty skippable frame as the line end, so any store that Spark knows will do, with Spark's
commit of task output.

Documents are in ascending order of (doc_id, hash and bytes of the text), null ids first.  Ids are little-endian unsigned 32-bit
integers; every document ends with END_ID.  A null or empty text is that id alone.  Repeated rows are written repeatedly.
Texts are split as the tokenizer's own pattern does and each distinct piece of a task goes through the tokenizers library's model once;
a text that holds one of its special tokens goes through the library whole.  An empty table gives no shard.
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import mix64, powers, slices
from .shared import new_folder, read_table, stored

END_ID = 2
#: A frame closes after the document with which it has so many ids; a shard likewise.
FRAME_IDS = 1 << 16
SHARD_IDS = 1 << 21
#: Pieces whose ids a task remembers (about 40 bytes each); beyond that it begins anew.
PIECES = 1_000_000
#: Characters that are split into pieces at a time; a longer text is taken by itself.
SLICE_CHARS = 1 << 19
_SKIP = 0x184D2A50
#: An empty skippable frame, "P*M\x18" and a size of zero: the line end of Spark's text writer is itself valid zstandard.
LINE_END = "P*M\x18\x00\x00\x00\x00"
_MAGIC = b"wkl1"
NULL_ID = -(1 << 63)


#: The white space of Unicode: the only characters that the tokenizer's pattern treats as such.
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _byte_alphabet() -> dict[str, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters are themselves, the rest follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): chr(b) for b in visible} | {chr(b): chr(256 + k) for k, b in enumerate(rest)}


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point whether it is a letter, a number, white space or anything else."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
    out[list(_WHITE)] = _SPACE
    return out


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pattern begin in texts that lie end to end (code points; offsets: where texts begin, and the end).

    A run of letters, of numbers or of other signs is a piece, with one blank before it; of white space before such a run the last
    character stands alone (the blank goes with the run); ``'s 't 'm 'd 're 've 'll`` are pieces where the apostrophe begins a run.
    """
    n = len(points)
    kind = _kinds()[points]
    space, blank = kind == _SPACE, points == 32
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    first = first[:n]
    before = np.empty(n, dtype=np.uint8)
    before[1:] = kind[:-1]
    before[:1] = _OTHER
    fresh = first | (kind != before)  # a run of one kind begins
    solid_after = np.zeros(n, dtype=bool)  # white space with a run right behind it
    solid_after[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1] & ~first[1:]
    start = np.where(space, fresh | solid_after, fresh & ~after_blank)
    marks = np.flatnonzero((points == 39) & start)  # an apostrophe that begins a piece of its own
    if len(marks):
        ends = offsets[np.searchsorted(offsets, marks, side="right")]
        at = lambda k: np.where(marks + k < ends, points[np.minimum(marks + k, n - 1)], 0)
        one, two = at(1), at(2)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 3, size)
        for m, k, end in zip(marks[size > 0].tolist(), size[size > 0].tolist(), ends[size > 0].tolist(), strict=True):
            start[m + 1 : m + k] = False
            if m + k < end:
                start[m + k] = start[m + k] or not space[m + k]
    return np.flatnonzero(start)


class PieceEncoder:
    """Token ids of whole texts: pieces are told apart for many texts at once, and the library's model encodes each distinct piece of a task once.

    Pieces are known by 64-bit hashes (a task with a million of them mistakes one for another with a probability of 3e-8); a piece of more
    than LONG characters is not remembered.
    """

    LONG = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = str.maketrans(_byte_alphabet())
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")

    def _tokenize(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has."""
        flat, sizes = [], []
        tokenize, alphabet = self.model.tokenize, self.alphabet
        for piece in pieces:
            tokens = tokenize(piece.encode().decode("latin-1").translate(alphabet))
            sizes.append(len(tokens))
            flat += [t.id for t in tokens]
        return np.array(flat, dtype="<u4"), np.array(sizes, dtype=np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, sizes = self._tokenize(pieces)
        at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        hashes, sizes = np.concatenate([self.hashes, hashes]), np.concatenate([self.size, sizes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.size, self.ids = hashes[order], at[order], sizes[order], np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of all texts end to end and how many each text has."""
        whole = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4") for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if whole:
            ids, sizes = self.encode(["" if i in whole else t for i, t in enumerate(texts)])
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            parts = [whole.get(i, part) for i, part in enumerate(parts)]
            return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(points):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        begin = piece_starts(points, offsets)
        end = np.append(begin[1:], len(points))
        p, inverse = powers(len(points))
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * p[: len(points)], out=sums[1:])
        hashes = mix64((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        if len(self.hashes) > PIECES:
            self._forget()
        long = end - begin > self.LONG
        hashes[long] = np.uint64(0)
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != distinct[inside]
        if new.any():
            self._learn(distinct[new], [joined[b:e] if e - b <= self.LONG else "" for b, e in zip(begin[where[new]].tolist(), end[where[new]].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, distinct)
        size, at, ids = self.size[place][which], self.at[place][which], self.ids
        if long.any():
            more, sizes = self._tokenize([joined[b:e] for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
            size[long], at[long] = sizes, len(ids) + np.cumsum(sizes) - sizes
            ids = np.concatenate([ids, more])
        done = np.concatenate([[0], np.cumsum(size)])
        out = ids[np.repeat(at - done[:-1], size) + np.arange(done[-1])]
        return out, np.diff(done[np.searchsorted(begin, offsets)])


def _shard(docs: list[tuple[int, bytes]]) -> bytes:
    """The bytes of a shard of (doc_id, ids of the document)."""
    zip_ = zstandard.ZstdCompressor(level=3, write_checksum=True)
    frames, entries, out, offset, held, n = [], [], [], 0, [], 0
    for k, (doc_id, ids) in enumerate(docs):
        entries.append((doc_id, len(frames), n, len(ids) // 4))
        held.append(ids)
        n += len(ids) // 4
        if n >= FRAME_IDS or k == len(docs) - 1:
            raw = b"".join(held)
            packed = zip_.compress(raw)
            frames.append((offset, len(packed), n, zlib.crc32(raw)))
            out.append(packed)
            offset, held, n = offset + len(packed), [], 0
    table = b"".join(struct.pack("<qIII", *e) for e in entries) + b"".join(struct.pack("<QIII", *f) for f in frames)
    table += struct.pack("<II", len(entries), len(frames)) + struct.pack("<I", zlib.crc32(table)) + _MAGIC
    return b"".join(out) + struct.pack("<II", _SKIP + 1, len(table)) + table


def shard_table(shard: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document entries and the frame entries of a shard, after a check of the table's sum."""
    end = len(shard) - len(LINE_END) if shard.endswith(LINE_END.encode()) else len(shard)
    n_docs, n_frames, crc, magic = struct.unpack("<III4s", shard[end - 16 : end])
    size = 20 * (n_docs + n_frames)
    table = shard[end - 16 - size : end - 16]
    if magic != _MAGIC or zlib.crc32(table) != crc:
        raise ValueError("not a shard, or its seek table is damaged")
    docs = np.frombuffer(table[: 20 * n_docs], dtype=[("doc_id", "<i8"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])
    frames = np.frombuffer(table[20 * n_docs :], dtype=[("offset", "<u8"), ("size", "<u4"), ("ids", "<u4"), ("crc", "<u4")])
    return docs, frames


def read_frame(shard: bytes, frame: np.void) -> np.ndarray:
    """The ids of one frame, after a check of its sum."""
    raw = zstandard.ZstdDecompressor().decompress(shard[int(frame["offset"]) : int(frame["offset"]) + int(frame["size"])], max_output_size=4 * int(frame["ids"]))
    if zlib.crc32(raw) != int(frame["crc"]):
        raise ValueError("a frame is damaged")
    return np.frombuffer(raw, dtype="<u4")


def read_documents(shard: bytes, doc_ids: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of the wanted documents of a shard in its order; only their frames are decompressed."""
    docs, frames = shard_table(shard)
    at, ids = -1, None
    for d in docs:
        if doc_ids is None or int(d["doc_id"]) in doc_ids:
            if d["frame"] != at:
                at = d["frame"]
                ids = read_frame(shard, frames[at])
            yield int(d["doc_id"]), ids[int(d["first"]) : int(d["first"]) + int(d["n"])]


def _write_shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        held, n = [], 0
        for batch in batches:
            doc_ids, texts = batch.column(0).fill_null(NULL_ID).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for i, j in slices(offsets, SLICE_CHARS):
                ids, sizes = encoder.encode(texts[i:j])
                raw, at = ids.tobytes(), 0
                for doc_id, size in zip(doc_ids[i:j], sizes.tolist(), strict=True):
                    held.append((doc_id, raw[4 * at : 4 * (at + size)] + end))
                    at += size
                    n += size + 1
                    if n >= SHARD_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array([_shard(held)], pa.binary())], names=["shard"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_shard(held)], pa.binary())], names=["shard"])

    return run


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, partitions: int) -> None:
    """docs (doc_id, text, ...) to shards in a folder, in ascending doc_id order over all files by name."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    shards = dealt.mapInArrow(_write_shards(tokenizer_path), "shard binary")
    shards.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", LINE_END).text(folder)


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "number", "doc_id", "before", "n_tokens", "ids_crc32"]
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, before = [], 0
            for k, (doc_id, ids) in enumerate(read_documents(content.as_py())):
                rows.append((name.as_py(), k, None if doc_id == NULL_ID else doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                before += len(ids)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a folder of shards.

    Part and file numbers sort as the documents do; a window over one row a shard gives what lies before it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    rows = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("shard"), "content").mapInArrow(_read_shards, "shard string, number long, doc_id long, before long, n_tokens long, ids_crc32 long")
    rows = stored(rows, "token-rows")
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size")).withColumn("part", F.regexp_extract("shard", r"^part-(\d+)", 1).cast("long"))
    number = F.regexp_extract("shard", r"^.*-c(\d+)", 1).cast("long")  # the last of its kind: the job's UUID may hold such a group too
    inside = F.sum("size").over(Window.partitionBy("part").orderBy(number)) - F.col("size")
    parts = sizes.groupBy("part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("part", (F.sum("part_size").over(Window.orderBy("part")) - F.col("part_size")).alias("part_start"))
    starts = sizes.withColumn("inside", inside).join(parts.hint("merge"), "part").select("shard", (F.col("part_start") + F.col("inside")).alias("shard_start"))
    return rows.join(starts.hint("merge"), "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the shards of docs and returns what reading them back gives."""
    import public_tokenizers

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_token_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), partitions)
    return read_token_shards(spark, folder)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read_table(spark, sf_dir, "documents"))
