"""Operator 4, language ID: a bidirectional gated recurrent network over bytes.

Two gated recurrent units, one from either side, read a text's bytes in segments of SEGMENT; a linear layer on both states
labels every position, and a document's probabilities are the means over all positions of its whole text.  The network is
trained in numpy by backpropagation through time on windows of a bounded sample of labelled rows (SAMPLE_ROWS windows of
WINDOW characters at hashed places); prediction sees nothing but the text.

A null text, or one without any letter, is ``und`` with score 0.  Without a labelled row to learn from, all are ``und``.
Repeated rows get the same answer; empty tables stay empty; other columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import slices, utf8
from .shared import read_table

HIDDEN = 8
SEGMENT = 128
SAMPLE_ROWS = 4000
WINDOW = 64
STEPS = 220
BATCH = 128
#: Segments that run at a time.
RUN = 4096
UND = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(seq: np.ndarray, p: dict, keep: bool = False):
    """Hidden states [T, B, H] of one unit over bytes [T, B]; with keep, what the backward pass needs."""
    t_len, b = seq.shape
    h_dim = p["u"].shape[0]
    h = np.zeros((b, h_dim), dtype=np.float32)
    out = np.empty((t_len, b, h_dim), dtype=np.float32)
    kept = []
    for t in range(t_len):
        x = p["e"][seq[t]]
        g = x[:, : 2 * h_dim] + h @ p["u"][:, : 2 * h_dim]
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        z, r = g[:, :h_dim], g[:, h_dim:]
        hu = h @ p["u"][:, 2 * h_dim :]
        n = np.tanh(x[:, 2 * h_dim :] + r * hu)
        if keep:
            kept.append((h, z, r, n, hu))
        h = n + z * (h - n)
        out[t] = h
    return (out, kept) if keep else out


def backward(seq: np.ndarray, p: dict, kept: list, d_out: np.ndarray) -> dict:
    """Gradients of one unit by backpropagation through time."""
    h_dim = p["u"].shape[0]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    dh = np.zeros_like(d_out[0])
    for t in range(len(seq) - 1, -1, -1):
        h, z, r, n, hu = kept[t]
        dh = dh + d_out[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * hu * r * (1 - r)
        dhu = dn * r
        dg = np.concatenate([dz, dr], axis=1)
        np.add.at(grad["e"], seq[t], np.concatenate([dg, dn], axis=1))
        grad["u"][:, : 2 * h_dim] += h.T @ dg
        grad["u"][:, 2 * h_dim :] += h.T @ dhu
        dh = dh * z + dg @ p["u"][:, : 2 * h_dim].T + dhu @ p["u"][:, 2 * h_dim :].T
    return grad


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 5) -> dict:
    """A network from labelled windows of bytes; deterministic."""
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    scale = lambda *s: rng.normal(scale=0.3, size=s).astype(np.float32)
    f, b = ({"e": scale(256, 3 * HIDDEN), "u": scale(HIDDEN, 3 * HIDDEN)} for _ in range(2))
    o = {"w": scale(2 * HIDDEN, len(classes)), "c": np.zeros(len(classes), dtype=np.float32)}
    params = [(d, k) for d in (f, b, o) for k in d]
    moments = [(np.zeros_like(d[k]), np.zeros_like(d[k])) for d, k in params]
    by_class = [np.array([i for i, y in enumerate(labels) if y == c]) for c in classes]
    for step in range(1, steps + 1):
        y = rng.integers(len(classes), size=BATCH)
        rows = [texts[by_class[c][rng.integers(len(by_class[c]))]] for c in y]
        width = WINDOW
        seq = np.array([list((r * (width // max(1, len(r)) + 1))[:width]) for r in rows], dtype=np.uint8).T
        hf, kf = forward(seq, f, keep=True)
        hb, kb = forward(seq[::-1], b, keep=True)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        logits = h @ o["w"] + o["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        d = prob
        d[:, np.arange(BATCH), y] -= 1
        d /= d.shape[0] * BATCH
        dh = d @ o["w"].T
        grads = [backward(seq, f, kf, dh[:, :, :HIDDEN]), backward(seq[::-1], b, kb, dh[::-1, :, HIDDEN:])]
        grads.append({"w": np.einsum("tbi,tbj->ij", h, d), "c": d.sum(axis=(0, 1))})
        flat = [g[k] for g, dct in zip(grads, (f, b, o), strict=True) for k in dct]
        for (dct, k), (m, v), g in zip(params, moments, flat, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            dct[k] -= 0.03 * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"classes": classes, "f": f, "b": b, "o": o}


def position_probabilities(seq: np.ndarray, model: dict) -> np.ndarray:
    """[T, B, classes] for bytes [T, B]."""
    hf, hb = forward(seq, model["f"]), forward(seq[::-1], model["b"])[::-1]
    w = model["o"]["w"]
    logits = hf @ w[:HIDDEN] + hb @ w[HIDDEN:] + model["o"]["c"]
    np.exp(logits - logits.max(axis=2, keepdims=True), out=logits)
    return logits / logits.sum(axis=2, keepdims=True)


def document_probabilities(buf: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    """Mean over all positions of each text's bytes (zeros for an empty text)."""
    sizes = np.diff(offsets)
    total = np.zeros((len(sizes), len(model["classes"])))
    n_seg = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), n_seg)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    begin = offsets[doc] + within * SEGMENT
    length = np.minimum(SEGMENT, offsets[doc + 1] - begin)
    by_length = np.argsort(-length, kind="stable")
    padded = np.concatenate([buf, np.zeros(SEGMENT, dtype=np.uint8)])
    for i in range(0, len(doc), RUN):
        rows = by_length[i : i + RUN]
        t_len = int(length[rows].max())
        steps = np.arange(t_len)[:, None]
        seq = padded[begin[rows][None, :] + steps]
        # the backward unit starts at a segment's own end: each is turned round by itself
        at = np.where(steps < length[rows], length[rows] - 1 - steps, steps)
        turned = padded[begin[rows][None, :] + at]
        hf = forward(seq, model["f"])
        hb = np.take_along_axis(forward(turned, model["b"]), at[:, :, None], axis=0)
        w = model["o"]["w"]
        logits = hf @ w[:HIDDEN] + hb @ w[HIDDEN:] + model["o"]["c"]
        np.exp(logits - logits.max(axis=2, keepdims=True), out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        logits *= (steps < length[rows])[:, :, None]
        np.add.at(total, doc[rows], logits.sum(axis=0))
    return total / np.maximum(sizes, 1)[:, None]


def _predict(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        classes = np.array([*model["classes"], UND], dtype=object)
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, len(classes) - 1), np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                if model["classes"]:
                    at = offsets[i : j + 1]
                    prob = document_probabilities(buf[at[0] : at[-1]], at - at[0], model)
                    best[i:j], score[i:j] = prob.argmax(axis=1), prob.max(axis=1)
            best[~lettered], score[~lettered] = len(classes) - 1, 0
            score = np.clip(np.round(score, 6), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def is_held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> dict:
    """A model from the labelled rows that are not held out: a window of each of SAMPLE_ROWS of them, as many of each language, in hashed order."""
    key = F.xxhash64("doc_id", F.lit(11))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang", key.alias("_key"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not counts:
        return {"classes": []}
    most = max(1, SAMPLE_ROWS // len(counts))
    # a hashed share of about four samples first, so that no task sends a whole sample's worth at scale
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // (4 * most)))))
    at = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - WINDOW, F.lit(1)).cast("long"))
    rows = labelled.where(F.pmod("_key", shares[F.col("lang")]) == 0).select("_key", "doc_id", F.substring("text", at.cast("int"), F.lit(WINDOW)).alias("text"), "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_key", "doc_id", "text"))
    sample = rows.withColumn("_rank", rank).where(F.col("_rank") <= most).orderBy("lang", "_rank").collect()
    return train([r.text.encode() for r in sample], [r.lang for r in sample])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of docs (doc_id, text, ...)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
