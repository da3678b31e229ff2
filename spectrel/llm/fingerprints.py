"""Document fingerprints from closed syncmers.

A k-mer (K code points) is a closed syncmer if the smallest of its S-mers, by hash, stands first or last in it. Whether it is one
depends on its own characters alone, so an edit changes the anchors that it touches and no others. A fingerprint holds the
distinct syncmers whose hash is below the fixed fraction `SHARE` of all hashes, and at least the `ANCHORS` of smallest hash, with the
place of their first occurrence, 16 hex digits each; so it grows with the text. The likeness of two fingerprints is taken over the
range of hashes that both hold in full: the share of their union there that both have and that stands in the same order in both (the
longest chain that rises in both texts).

Texts of fewer than K code points have one anchor, the whole text; empty or null texts have none and an empty fingerprint. Two
empty fingerprints are alike (1), an empty one is like no other (0). Equal texts have equal fingerprints.

The edited text of a document needs the next document by descending doc_id: documents are dealt by ranges of doc_id, sorted, and
read in order; the first document of each range is also sent to the range before it. Equal doc_ids are ordered by text, null
doc_ids come last, and after the last document comes the first. A single document is its own next one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm import common

K, S, ANCHORS = 16, 6, 64
#: Hashes (of 32 bits) below this are always kept: an eighth of them.
SHARE = 1 << 29
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes)
    if n < K:
        h = np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), dtype=np.uint64)
        return (h, np.zeros(1, dtype=np.int64)) if n else (h[:0], np.zeros(0, dtype=np.int64))
    smer = codes[: n - S + 1] + np.uint64(1)
    for j in range(1, S):
        smer = smer * _C1
        smer += codes[j : n - S + 1 + j]
    smer *= _C2
    smer ^= smer >> np.uint64(29)
    smer *= _C1
    smer ^= smer >> np.uint64(32)
    w = K - S + 1  # S-mers in a K-mer
    low, width = smer, 1
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    count = n - K + 1
    low = np.minimum(low[:count], low[w - width : w - width + count])
    at = np.flatnonzero((smer[:count] == low) | (smer[w - 1 : w - 1 + count] == low))
    h = smer[at]
    for j in sorted({*range(S, K - S, S), K - S}):
        h = common.mix(h * _C2 + smer[at + j])
    return h, at


def fingerprint(text: str, anchors: int = ANCHORS) -> str:
    h, at = syncmers(text)
    h = h >> np.uint64(32)
    if len(h) > 4 * anchors:  # only the smallest can stay; repeats may make it fewer than wanted, so look again then
        keep = h <= max(np.partition(h, 3 * anchors)[3 * anchors], SHARE - 1)
        if len(np.unique(h[keep])) >= anchors:
            h, at = h[keep], at[keep]
    h, first = np.unique(h, return_index=True)
    n = max(anchors, int(np.searchsorted(h, np.uint64(SHARE))))
    h, at = h[:n], at[first[:n]]
    return ((h << np.uint64(32)) | (at.astype(np.uint64) & np.uint64(0xFFFFFFFF))).astype(">u8").tobytes().hex()


def likeness(a: str, b: str, anchors: int = ANCHORS) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = ({a[i : i + 8]: a[i + 8 : i + 16] for i in range(0, len(a), 16)} for a in (a, b))
    # fewer than anchors are all of a text; else all up to the largest kept, or below SHARE, are there
    limit = min(max(max(z), f"{SHARE - 1:08x}") for z in (x, y) if len(z) >= anchors) if max(len(x), len(y)) >= anchors else "ffffffff"
    union = [h for h in x.keys() | y.keys() if h <= limit]
    both = sorted((x[h], y[h]) for h in union if h in x and h in y)
    chain: list[str] = []
    for _, place in both:
        k = bisect_left(chain, place)
        chain[k : k + 1] = [place]
    return len(chain) / len(union)


def ordered(documents: DataFrame, parts: int) -> DataFrame:
    """part, halo, doc_id, text; each part sorted by descending doc_id and followed by the document that comes next (halo)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("double").alias("doc_id")).where("doc_id IS NOT NULL")
    bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts))}) if parts > 1 else []
    part = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(part))
    heads = sorted((r["part"], r["head"]) for r in docs.groupBy("part").agg(F.max("doc_id").alias("head")).collect())  # parts rows
    # the head of each part follows the last document of the next higher part; the highest part's, that of the lowest
    follow = [(head, heads[k + 1][0] if k + 1 < len(heads) else heads[0][0]) for k, (_, head) in enumerate(heads)]
    after = docs.sparkSession.createDataFrame(follow, "head long, before int")
    joined = docs.join(F.broadcast(after), docs["doc_id"].eqNullSafe(after["head"]), "left")
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(False).alias("halo")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(True).alias("halo")))))
    return joined.select("doc_id", "text", F.explode(places).alias("place")).select("place.part", "place.halo", "doc_id", "text").repartitionByRange(2 * len(heads) + 2, "part").sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), "text")


def with_next(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: doc_id, text, edited (its second half replaced from the next document), fingerprint, edited_fingerprint,
    near_edited, near_next. parts: how many ranges of doc_id are dealt out, spark.sql.shuffle.partitions by default."""
    parts = parts or max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shape = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        last = None  # (part, halo, doc_id, text, fingerprint)
        for batch in common.parts(batches, 3):
            rows = []
            for part, halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = fingerprint(text) if not (halo and last and last[1] and last[0] == part) else ""
                if last and last[0] == part and not last[1]:
                    _, _, i, t, m = last
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half]
                    e = m if edited == t else fingerprint(edited)
                    rows.append((i, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), m, e, likeness(m, e), likeness(m, mark)))
                last = (part, halo, doc_id, text, mark)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return ordered(documents, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
