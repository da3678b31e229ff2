import random

import numpy as np
from tests.llm.fixtures import EDGE_TEXTS, documents, prose

from spectrel.llm import quality


def corpus(n):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        t, good = prose(i, r.randint(20, 120)), r.random() < 0.8
        texts.append(t if good else " ".join(w.upper() + "!!" if i % 2 else w + " |" for w in t.split()))
        labels.append(int(good))
    return texts, labels


def test_learns_and_scores_whole_texts(spark):
    texts, labels = corpus(500)
    docs = documents(spark, texts)
    table = spark.createDataFrame([(i, q, 0, "x") for i, q in enumerate(labels)] + [(3, labels[3], 1, "x"), (None, 1, 0, "x"), (4, None, 0, "x"), (9999, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    net = quality.fit(docs, table.select("doc_id", "quality"))
    got = {r["doc_id"]: r for r in quality.classify(docs, net).select("doc_id", "score", quality.held_out().alias("held_out")).collect()}
    held = [i for i in range(500) if got[i]["held_out"]]
    assert 100 < len(held) < 240
    assert np.mean([(got[i]["score"] >= 0.5) == labels[i] for i in held]) > 0.97
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["score"] >= 0.5}
    # slices and groups do not show, and the last byte counts
    odd = [(t or "").encode() for t in EDGE_TEXTS] + [t.encode() for t in texts[:20]]
    alone = np.array([quality.probabilities(net, [t])[0] for t in odd])
    assert np.allclose(alone, quality.probabilities(net, odd), atol=1e-6)
    one = quality.features(net, net.pairs(), quality.layout([b"a" * 1000 + b"Q!! Z"]))
    assert not np.allclose(one, quality.features(net, net.pairs(), quality.layout([b"a" * 1000])))


def test_chunk_features_by_definition():
    r = np.random.default_rng(0)
    net = quality.Network(r.normal(size=(4, 256, quality.FILTERS)), r.normal(size=quality.FILTERS), r.normal(size=2 * quality.FILTERS), 0.1)
    text = bytes(r.integers(1, 256, 700, dtype=np.uint8))
    blocks = -(-(len(text) + 3) // quality.BLOCK)
    b = (bytes(3) + text).ljust(blocks * quality.BLOCK, b"\0") + bytes(4)
    answers = np.array([sum(net.taps[j, b[i + j]] for j in range(4)) for i in range(blocks * quality.BLOCK)])
    chunks = np.array([answers[k * quality.BLOCK : (k + 2) * quality.BLOCK].max(axis=0) for k in range(blocks - 1)])
    h = np.maximum(chunks + net.bias, 0)
    assert np.allclose(quality.features(net, net.pairs(), quality.layout([text]))[0], np.hstack([h.mean(axis=0), h.max(axis=0)]), atol=1e-4)


def test_no_labels_and_one_class(spark):
    docs, none = documents(spark, ["a b", None, ""]), spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, quality.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in quality.classify(docs, quality.fit(docs, ones)).collect())
    assert quality.classify(documents(spark, []), quality.fit(documents(spark, []), none)).count() == 0
