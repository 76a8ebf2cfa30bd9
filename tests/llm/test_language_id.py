"""The network against finite differences and against a naive run of one document at a time; odd rows."""

import numpy as np

from wakeline.llm import language_id as L


def test_backward_is_the_gradient():
    rng = np.random.default_rng(0)
    p = {"e": rng.normal(scale=0.4, size=(256, 12)), "u": rng.normal(scale=0.4, size=(4, 12))}
    seq, weight = rng.integers(0, 6, size=(7, 3)).astype(np.uint8), rng.normal(size=(7, 3, 4))
    p = {k: v.astype(np.float32) for k, v in p.items()}

    def loss(q):  # in double precision, written out by hand
        h, total = np.zeros((3, 4)), 0.0
        for t in range(7):
            x = q["e"][seq[t]].astype(np.float64)
            g = 1 / (1 + np.exp(-(x[:, :8] + h @ q["u"][:, :8])))
            n = np.tanh(x[:, 8:] + g[:, 4:] * (h @ q["u"][:, 8:]))
            h = n + g[:, :4] * (h - n)
            total += (h * weight[t]).sum()
        return total

    _, kept = L.forward(seq, p, keep=True)
    grad = L.backward(seq, p, kept, weight)
    for key, at in [("u", (i, j)) for i in range(4) for j in range(0, 12, 3)] + [("e", (b, j)) for b in range(6) for j in range(0, 12, 4)]:
        up, down = ({k: v.astype(np.float64) for k, v in p.items()} for _ in range(2))
        up[key][at] += 1e-5
        down[key][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - grad[key][at]) < 2e-3


def naive(text, model):
    total = np.zeros(len(model["classes"]))
    for i in range(0, len(text), L.SEGMENT):
        seq = np.frombuffer(text[i : i + L.SEGMENT], dtype=np.uint8)[:, None]
        total += L.position_probabilities(seq, model)[:, 0].sum(axis=0)
    return total / max(1, len(text))


def test_batches_of_segments_equal_one_document_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    model = L.train([b"one two three four", b"eins zwei drei vier"], ["en", "de"], steps=5)
    texts = [bytes(rng.integers(32, 120, size=n).astype(np.uint8)) for n in (0, 1, 5, 127, 128, 129, 700, 3000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    monkeypatch.setattr(L, "RUN", 5)
    got = L.document_probabilities(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, model)
    assert np.allclose(got, [naive(t, model) for t in texts], atol=1e-5)


def test_odd_rows(spark):
    docs = "doc_id long, text string, lang string, score string, lang_pred string"
    rows = [(i, "the end of the day " * 4 if i % 2 else "das ende der tage " * 4, "en" if i % 2 else "de", "a", "b") for i in range(60)]
    model = L.learn(spark.createDataFrame(rows, docs))
    assert model["classes"] == ["de", "en"]
    long = "the end of the day " * 9000
    odd = [(1, long, None, "a", "b"), (1, long, None, "a", "b"), (None, "ende der tage das", "xx", "a", "b"), (2, None, None, None, None), (3, "7 !", None, None, None)]
    got = sorted(map(tuple, L.predict(spark.createDataFrame(odd, docs), model).collect()), key=str)
    assert got[0] == got[1] and got[0][1] == "en" and got[2] == (2, "und", 0.0) and got[3] == (3, "und", 0.0) and got[4][:2] == (None, "de")
    assert L.predict(spark.createDataFrame([], docs), model).collect() == []
    assert L.learn(spark.createDataFrame(odd[3:], docs)) == {"classes": []}
    assert {r.lang_pred for r in L.predict(spark.createDataFrame(odd, docs), {"classes": []}).collect()} == {"und"}


def test_each_language_has_its_share_of_the_sample(spark, monkeypatch):
    rows = [(i, "rare words " * 5 if i % 300 == 0 else "frequent words " * 5, "rare" if i % 300 == 0 else "frequent") for i in range(3000)]
    seen = {}
    monkeypatch.setattr(L, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(L, "train", lambda texts, labels: seen.update(n={y: labels.count(y) for y in labels}) or {"classes": sorted(set(labels))})
    assert L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["classes"] == ["frequent", "rare"]
    assert seen["n"]["frequent"] == 30 and seen["n"]["rare"] >= 4
