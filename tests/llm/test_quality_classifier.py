import math
import pickle
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import quality_classifier as K


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(["the", "of", "and", "river", "stone", "light"]) for _ in range(rng.randrange(20, 200))]
        rows.append((d, " ".join(w + "$$$" if bad and rng.random() < 0.5 else w for w in words)))
        labels.append((d, 0 if bad else 1))
    return rows, labels


def test_learns_and_scores_held_out_documents(spark, documents):
    rows, labels = corpus()
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    out = K.assess(documents(*rows), told).join(told, "doc_id").where("held_out").collect()
    assert len(out) > 40
    right = sum(r["predicted"] == r["quality"] for r in out) / len(out)
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_held_out_labels_are_never_used(spark, documents):
    rows, labels = corpus(120)
    fold = lambda d: __import__("zlib").crc32(str(d).encode()) % 5
    flipped = [(d, 1 - q if fold(d) == 0 else q) for d, q in labels]
    learn = K.remainder(F.col("doc_id"), 5) != 0
    one, two = (K.train(documents(*rows), spark.createDataFrame(x, "doc_id long, quality int"), learn=learn) for x in (labels, flipped))
    assert one == two


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in (3, 700, 300)]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    target = np.array([1, 0, 1], np.float32)
    net = K.Network(3)
    for name in ("table", "bias", "weight", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        symbols, first = K.padded(buf, offsets)
        z = net.logits(net.features(net.activations(symbols).max(axis=1), first)[0])
        return float(np.mean(np.log1p(np.exp(-z)) + (1 - target) * z))

    grads = net.gradients(buf, offsets, target)
    for p, g, places in zip((net.table, net.bias, net.weight, net.offset), grads, [[(0, 98, 3), (2, 100, 5), (4, 97, 0)], [(2,), (7,)], [(1,), (K.FILTERS + 4,)], [(0,)]], strict=True):
        for place in places:
            keep = p[place]
            p[place] = keep + 1e-5
            up = loss()
            p[place] = keep - 1e-5
            down = loss()
            p[place] = keep
            assert abs((up - down) / 2e-5 - g[place]) < 1e-4


def test_chunks_cover_the_whole_document():
    net = K.Network(0)
    plain = b"a" * 5000
    one = lambda t: net.features(net.activations(K.padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]).max(axis=1), K.padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1])[0][0]
    for at in (0, 255, 256, 2500, 4990):
        changed = bytearray(plain)
        changed[at : at + 5] = b"#$%&!"
        assert not np.array_equal(one(plain), one(bytes(changed)))


def test_batches_score_alike():
    net = K.Network(0)
    texts = [b"", b"abc", b"x" * 1000, "é ü".encode()]
    together = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone)


def test_nulls_repeats_and_missing_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b")]
    out = K.assess(documents(*rows), none).collect()
    assert len(out) == 5 and {r["score"] for r in out} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in K.assess(documents(*rows), odd).collect()} <= {0.5, 1.0}
    assert K.assess(documents(), none).count() == 0
    assert pickle.loads(K.train(documents(*rows), none)) == 0.5


def plain_score(network, text):
    """The network by loops: every filter at every place, largest of two neighbouring blocks, mean and maximum, one unit."""
    padding = [K.PAD] * (K.WIDTH - 1)
    blocks = max(1, -(-(len(text) + K.WIDTH - 1) // K.BLOCK))
    symbols = padding + list(text) + [K.PAD] * (blocks * K.BLOCK - len(text))
    largest = []
    for b in range(blocks):
        values = [[sum(float(network.table[j, symbols[p + j], f]) for j in range(K.WIDTH)) for f in range(K.FILTERS)] for p in range(b * K.BLOCK, (b + 1) * K.BLOCK)]
        largest.append([max(v[f] for v in values) for f in range(K.FILTERS)])
    pairs = [(largest[0], largest[0])] if blocks == 1 else list(zip(largest, largest[1:]))
    chunks = [[max(0.0, max(a[f], b[f]) + float(network.bias[f])) for f in range(K.FILTERS)] for a, b in pairs]
    features = [sum(c[f] for c in chunks) / len(chunks) for f in range(K.FILTERS)] + [max(c[f] for c in chunks) for f in range(K.FILTERS)]
    return 1 / (1 + math.exp(-(sum(float(w) * x for w, x in zip(network.weight, features)) + float(network.offset[0]))))


@pytest.mark.parametrize("length", [0, 3, 251, 252, 253, 600, 1300])
def test_a_score_is_that_of_a_plain_convolution(monkeypatch, length):
    rng = np.random.default_rng(length)
    network = K.Network(3)
    network.bias += rng.normal(0, 0.1, K.FILTERS).astype(np.float32)
    text = rng.integers(0, 256, length).astype(np.uint8)
    wanted = plain_score(network, text.tolist())
    assert abs(network.score(text, np.array([0, length]))[0] - wanted) < 1e-5
    monkeypatch.setattr(K, "PIECE", 256)
    assert abs(network.score(text, np.array([0, length]))[0] - wanted) < 1e-5


def test_a_long_text_is_scored_in_little_memory():
    network, text = K.Network(), np.random.default_rng(0).integers(32, 127, 12_000_000).astype(np.uint8)
    tracemalloc.start()
    whole = network.score(text, np.array([0, len(text)]))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    middle = len(text) // 2 // K.BLOCK * K.BLOCK
    changed = text.copy()
    changed[middle : middle + 2000] = 0
    assert 0 < whole < 1 and network.score(changed, np.array([0, len(text)]))[0] != whole


def test_training_is_bounded_in_bytes(spark, documents, monkeypatch):
    rows = [(d, ("good words " if d % 2 else "bad stuff! ") * (5 + d)) for d in range(60)] + [(99, "x" * 5000)]
    labels = spark.createDataFrame([(d, d % 2) for d in [*range(60), 99]], "doc_id long, quality int")
    monkeypatch.setattr(K, "TRAIN_TEXT", 2000)
    monkeypatch.setattr(K, "TRAIN_BYTES", 12_000)
    monkeypatch.setattr(K, "BATCH_BYTES", 900)
    out = {r["doc_id"]: r["score"] for r in K.assess(documents(*rows), labels).collect()}
    assert len(out) == 61 and np.mean([out[d] > out[d - 1] for d in range(1, 60, 2)]) > 0.8
    assert [len(b) for b in K._batches(np.arange(70), np.full(70, 30))] == [30, 30, 10]
