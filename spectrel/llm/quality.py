"""Quality classifier: a byte-level convolutional network in numpy.

WIDTH-byte filters slide over the whole text. A filter's answer is its maximum over each chunk of CHUNK bytes; chunks start every
CHUNK / 2 bytes, so they overlap and cover the text to its last byte. Behind a ReLU, the mean and the maximum over all chunks
are combined into one probability. Filters and weights are learned by Adam on labelled documents: at most `TRAIN_DOCS` of each
class (by a hash of doc_id), of at most `TRAIN_BYTES` bytes each; the classes keep their shares by weights.

Null and empty texts have one chunk of padding, and a score like any other. Without labels of both classes the score is the
share of label 1 (0.5 without labels) everywhere. Repeated rows each give a row; a doc_id with several labels counts once, as 1
if they are 1 on average or more often than not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm import common

TRAIN_DOCS, TRAIN_BYTES = 3000, 20_000
#: Steps of training, and how often a document may be seen at most.
STEPS, EPOCHS = 1500, 40
WIDTH, FILTERS, CHUNK = 4, 16, 256
BLOCK = CHUNK // 2
#: Positions that are convolved at once.
SLICE = 1 << 16


@dataclass
class Network:
    taps: np.ndarray  # (WIDTH, 256, FILTERS): what each byte at each place of a filter adds
    bias: np.ndarray
    weights: np.ndarray  # of the means, then of the maxima
    offset: float

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The taps of two bytes at once, by 256 * first + second."""
        t = self.taps.astype(np.float32)
        return tuple((t[k][:, None] + t[k + 1][None]).reshape(65536, -1) for k in (0, 2))


@dataclass
class Layout:
    """Texts as one byte array of whole blocks, and the blocks of each chunk and chunks of each text."""

    octets: np.ndarray
    first: np.ndarray
    second: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def layout(texts: list[bytes]) -> Layout:
    blocks = np.array([-(-(len(t) + WIDTH - 1) // BLOCK) for t in texts], dtype=np.int64)
    lead = bytes(WIDTH - 1)  # no filter sees two texts at once
    joined = b"".join([(lead + t).ljust(b * BLOCK, b"\0") for t, b in zip(texts, blocks.tolist(), strict=True)]) + bytes(WIDTH)
    counts = np.maximum(1, blocks - 1)
    starts = np.cumsum(counts) - counts
    at = np.cumsum(blocks) - blocks
    first = np.arange(counts.sum()) - np.repeat(starts - at, counts)
    return Layout(np.frombuffer(joined, dtype=np.uint8), first, np.minimum(first + 1, np.repeat(at + blocks - 1, counts)), starts, counts)


def features(net: Network, tables: tuple[np.ndarray, np.ndarray], x: Layout) -> np.ndarray:
    """Mean and maximum over chunks of each text's filter answers."""
    n = len(x.octets) - WIDTH
    top = np.empty((n // BLOCK, FILTERS), dtype=np.float32)
    for at in range(0, n, SLICE):
        b = x.octets[at : min(n, at + SLICE) + WIDTH].astype(np.int64)
        two = b[:-1] * 256 + b[1:]
        size = len(b) - WIDTH
        a = tables[0].take(two[:size], axis=0)
        a += tables[1].take(two[2 : size + 2], axis=0)
        top[at // BLOCK : at // BLOCK + size // BLOCK] = a.reshape(-1, BLOCK, FILTERS).max(axis=1)
    h = np.maximum(np.maximum(top[x.first], top[x.second]) + net.bias.astype(np.float32), 0)
    return np.hstack([np.add.reduceat(h, x.starts) / x.counts[:, None], np.maximum.reduceat(h, x.starts)])


def probabilities(net: Network, texts: list[bytes], tables=None) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    z = features(net, tables or net.pairs(), layout(texts)).astype(np.float64) @ net.weights + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS, batch: int = 32, rate: float = 0.02, seed: int = 1) -> Network:
    """Weighted logistic loss, Adam; the gradient goes to the bytes that gave each chunk's maximum."""
    r = np.random.default_rng(seed)
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels) or share != share:
        return Network(np.zeros((WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0 if not len(labels) else float(np.clip(40 * (2 * share - 1), -40, 40)))
    p = {"taps": r.normal(0, 0.3, (WIDTH, 256, FILTERS)), "bias": np.zeros(FILTERS), "weights": r.normal(0, 0.3, 2 * FILTERS), "offset": np.array([np.log(share / (1 - share))])}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, epochs = 0, min(EPOCHS, -(-steps * batch // len(texts)))
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x, y, w = layout([texts[i] for i in chosen]), labels[chosen], weights[chosen]
            n = len(x.octets) - WIDTH
            a = p["taps"][0].astype(np.float32).take(x.octets[:n], axis=0)
            for j in range(1, WIDTH):
                a += p["taps"][j].astype(np.float32).take(x.octets[j : n + j], axis=0)
            a = a.reshape(-1, BLOCK, FILTERS)
            best = a.argmax(axis=1)
            top = np.take_along_axis(a, best[:, None], axis=1)[:, 0]
            later = top[x.second] > top[x.first]
            block = np.where(later, x.second[:, None], x.first[:, None])
            h = np.maximum(np.maximum(top[x.first], top[x.second]) + p["bias"], 0)
            mean, most = np.add.reduceat(h, x.starts) / x.counts[:, None], np.maximum.reduceat(h, x.starts)
            z = np.hstack([mean, most]) @ p["weights"] + p["offset"][0]
            d = w * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / w.sum()
            of = np.repeat(np.arange(len(y)), x.counts)
            dh = (d / x.counts)[of][:, None] * p["weights"][:FILTERS] + d[of][:, None] * p["weights"][FILTERS:] * (h == most[of])
            dh *= h > 0
            g = {"bias": dh.sum(axis=0), "weights": np.hstack([mean, most]).T @ d + 1e-4 * p["weights"], "offset": np.array([d.sum()])}
            chunk, f = np.nonzero(dh)
            place = block[chunk, f] * BLOCK + best[block[chunk, f], f]
            g["taps"] = np.stack([np.bincount(x.octets[place + j].astype(np.int64) * FILTERS + f, dh[chunk, f], 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)]) + 1e-5 * p["taps"]
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= rate * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Network(p["taps"], p["bias"], p["weights"], float(p["offset"][0]))


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Network:
    """Learn from labels(doc_id, quality) of documents(doc_id, text), without the rows held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.join(documents.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    octets = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    start = F.when(F.octet_length(octets) <= train_bytes, 1).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.octet_length(octets) - train_bytes).cast("int"))
    rows = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.substring(octets, start, F.lit(train_bytes)).alias("octets")).groupBy("doc_id", "label").agg(F.min("octets").alias("octets")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    return train([bytes(r["octets"]) for r in rows], y, np.array([totals.get(int(k), 1) / taken[int(k)] for k in y]))


def classify(documents: DataFrame, net: Network) -> DataFrame:
    """Per document: doc_id, score."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    shape = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        tables = shared.value.pairs()
        for part in common.parts(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(probabilities(shared.value, part.column(1).to_pylist(), tables))], schema=shape)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.octets("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(documents: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, that score `least` or more."""
    shared, at = documents.sparkSession.sparkContext.broadcast(net), documents.columns.index("text")

    def run(batches):
        tables = shared.value.pairs()
        for part in common.parts(batches, at):
            found = probabilities(shared.value, [(t or "").encode() for t in part.column(at).to_pylist()], tables)
            yield part.filter(pa.array(found >= least))

    return documents.mapInArrow(run, documents.schema)
