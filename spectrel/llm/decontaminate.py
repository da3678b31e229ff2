"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Items give patterns: every run of `window` consecutive words, or all words of a shorter item. Patterns of one length m are searched
together. The search position is the last word of a possible occurrence. The block of the two words that end there (one word, if m
is 1) looks up a shift: how far the position may move on with no occurrence missed. At a shift of 0, the bucket of patterns that end
in that block and begin with the same two words as the text does there is looked up, and comparing word by word, at last the text's
own bytes, confirms an occurrence.

The tables are sorted arrays of 64-bit hashes of words and blocks, built by Spark tasks from blocks of the benchmark, written to the
shared folder and mapped by the workers: about ten times the benchmark's bytes in files, whose pages all workers of a machine share,
and nothing on the driver. The documents are read once, however many blocks there are. The position moves in many places at once:
each stretch of `STRETCH` words of a batch has a position of its own.

Nulls and texts without words: no words, no hits. Items with equal passages all count. Repeated documents each give a row. Null
item_ids count as the item "None".
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm import arrays, common

#: Bytes of benchmark text whose tables one task builds, and words of an item that stay together (a longer item is cut, overlapping).
BLOCK_BYTES, PIECE_WORDS = 16_000_000, 50_000
#: Words whose occurrence ends one search position looks for.
STRETCH = 256


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """The key of the block of two words that ends at each word; the first has none."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    out[1:] = common.mix(common.mix(hashes[:-1]) + hashes[1:])
    return out


def _bucket_keys(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    return common.mix(last + common.mix(first))


def _write_tables(folder: str, block: int, ids: list[str], texts: list[bytes], window: int) -> None:
    """The arrays of one block of pieces of items (words joined by blanks)."""
    joined, starts, sizes, hashes, counts = common.byte_words(texts, common.ALNUM)
    ends = np.cumsum(counts)
    place = np.arange(len(hashes)) - np.repeat(ends - counts, counts)  # of a word in its piece
    total = np.repeat(counts, counts)
    pairs = _pairs(hashes)
    names = json.dumps(ids).encode()
    for name, array in (("text", np.frombuffer(joined, dtype=np.uint8)), ("starts", starts.astype(np.int64)), ("sizes", sizes.astype(np.int64)), ("hashes", hashes), ("ends", ends.astype(np.int64)), ("ids", np.frombuffer(names, dtype=np.uint8))):
        arrays.save(folder, f"{name}-{block}", array)
    lengths = np.minimum(counts, window)
    arrays.save(folder, f"lengths-{block}", np.unique(lengths[lengths > 0]).astype(np.int64))
    for m in np.unique(lengths[lengths > 0]).tolist():
        mine = np.minimum(total, window) == m
        keys = pairs if m > 1 else hashes
        # a block that ends at a piece's word `place` ends a pattern there if enough words stand before it, else one further on
        at = np.flatnonzero(mine & (place >= min(m - 1, 1)))
        order = np.lexsort((np.maximum(0, m - 1 - place[at]), keys[at]))
        block_keys, shifts = keys[at][order], np.maximum(0, m - 1 - place[at])[order]
        first = np.concatenate([[True], block_keys[1:] != block_keys[:-1]])
        last = np.flatnonzero(mine & (place >= m - 1))
        bucket = _bucket_keys(keys[last], keys[last - max(0, m - 2)])
        by = np.argsort(bucket, kind="stable")
        for name, array in (("shift_keys", block_keys[first]), ("shifts", shifts[first].astype(np.uint8)), ("bucket_keys", bucket[by]), ("patterns", (last - m + 1)[by].astype(np.int64))):
            arrays.save(folder, f"{name}-{m}-{block}", array)


def _written(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[str, list[int]]:
    """The folder of the tables and the numbers of its blocks."""
    if not 1 <= window <= 255:
        raise ValueError("window is 1 to 255 words")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total // block_bytes)
    folder = common.new_folder(benchmark.sparkSession, "benchmark")

    def pieces(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = common.alnum_words(text)
                step = PIECE_WORDS - window + 1
                rows += [(i, k, b" ".join(words[a : a + PIECE_WORDS])) for k, a in enumerate(range(0, max(1, len(words) - window + 1), step))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["id", "k", "text"])

    def build(table):
        block = table["block"][0].as_py()
        rows = sorted(zip(table["id"].to_pylist(), table["k"].to_pylist(), table["text"].to_pylist(), strict=True))
        _write_tables(folder, block, [r[0] for r in rows], [r[2] for r in rows], window)
        return pa.table({"block": pa.array([block], pa.int64())})

    cut = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("id"), common.octets("text")).mapInArrow(pieces, "id string, k long, text binary")
    blocks = cut.where(F.octet_length("text") > 0).withColumn("block", F.pmod(F.xxhash64("id", "k"), F.lit(n)).cast("long")).groupBy("block").applyInArrow(build, "block long")
    return folder, sorted(r["block"] for r in blocks.collect())  # a row for each block


class WordSearch:
    """Wu-Manber tables of a benchmark, mapped from the shared folder."""

    def __init__(self, folder: str, blocks: list[int]):
        self.blocks = []
        for b in blocks:
            load = lambda name, kind, b=b: arrays.load(folder, f"{name}-{b}", kind)
            held = {name: load(name, np.int64) for name in ("starts", "sizes", "ends", "lengths")} | {"hashes": load("hashes", np.uint64), "text": load("text", np.uint8)}
            held["ids"] = json.loads(bytes(load("ids", np.uint8)))
            held["tables"] = {}
            for m in held["lengths"].tolist():
                held["tables"][m] = tuple(load(f"{name}-{m}", kind) for name, kind in (("shift_keys", np.uint64), ("shifts", np.uint8), ("bucket_keys", np.uint64), ("patterns", np.int64)))
            self.blocks.append(held)

    def occurrences(self, texts: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, int, list[str]]]]:
        """The number of words of each text, and (first words of occurrences, counted over all texts, m, their items' ids)."""
        joined, starts, sizes, hashes, counts = common.byte_words(texts, common.ALNUM)
        begin = np.repeat(np.cumsum(counts) - counts, counts)  # the first word of a word's text

        def found():
            pairs = _pairs(hashes)
            for held in self.blocks:
                for m, table in held["tables"].items():
                    keys = pairs if m > 1 else hashes
                    ends = _ends(keys, begin, m, table[0], table[1])
                    which, at = _candidates(keys, ends, m, table[2], table[3])
                    for k in range(m):  # word by word
                        same = hashes[at - m + 1 + k] == held["hashes"][which + k]
                        which, at = which[same], at[same]
                    first = at - m + 1
                    if len(at):
                        same = [_bytes(joined, starts, sizes, a, m) == _bytes(held["text"], held["starts"], held["sizes"], p, m) for a, p in zip(first.tolist(), which.tolist(), strict=True)]
                        which, first = which[same], first[same]
                        yield first, m, [held["ids"][i] for i in np.searchsorted(held["ends"], which, side="right").tolist()]

        return counts, found()


def _bytes(text, starts, sizes, first: int, m: int) -> bytes:
    """The words from one on; whatever stands between two words is one blank."""
    return b" ".join(bytes(text[a : a + n]) for a, n in zip(starts[first : first + m].tolist(), sizes[first : first + m].tolist(), strict=True))


def _ends(keys: np.ndarray, begin: np.ndarray, m: int, shift_keys: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The words at which a shift of 0 leaves an occurrence possible."""
    n, far = len(keys), m - min(2, m) + 1
    out = [np.zeros(0, dtype=np.int64)]
    at = np.arange(0, n, STRETCH)
    stop = np.minimum(at + STRETCH, n)
    while True:
        at = np.maximum(at, begin[at] + m - 1) if len(at) else at  # enough words of the text before it
        live = at < stop
        at, stop = at[live], stop[live]
        if not len(at):
            return np.concatenate(out)
        # moving on may have led into a later text of the stretch
        fits = at - begin[at] >= m - 1
        place = np.minimum(np.searchsorted(shift_keys, keys[at]), len(shift_keys) - 1)
        step = np.where(shift_keys[place] == keys[at], shifts[place], far).astype(np.int64)
        out.append(at[fits & (step == 0)])
        at = at + np.where(fits, np.maximum(step, 1), 0)
        live = at < stop
        at, stop = at[live], stop[live]


def _candidates(keys: np.ndarray, ends: np.ndarray, m: int, bucket_keys: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words of patterns, last words of texts) of the buckets that are met."""
    wanted = _bucket_keys(keys[ends], keys[ends - max(0, m - 2)]) if len(ends) else np.zeros(0, dtype=np.uint64)
    low, high = np.searchsorted(bucket_keys, wanted, side="left"), np.searchsorted(bucket_keys, wanted, side="right")
    size = high - low
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.asarray(patterns[np.repeat(low, size) + within]), np.repeat(ends, size)


def find(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hits (array of [start, end) word ranges, merged and in order), items (sorted ids as strings).

    benchmark: item_id, text; window at most 255; the tables of block_bytes of its text are built in one task."""
    shape = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>"
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    tables = _written(benchmark, window, block_bytes)

    def run(batches):
        search = WordSearch(*tables)
        for batch in common.parts(batches, 1):
            counts, found = search.occurrences([t or b"" for t in batch.column(1).to_pylist()])
            spans, items = [[] for _ in counts], [set() for _ in counts]
            before = np.cumsum(counts) - counts
            for first, m, ids in found:
                for a, k, i in zip(first.tolist(), (np.searchsorted(before + counts, first, side="right")).tolist(), ids, strict=True):
                    spans[k].append((a - int(before[k]), a - int(before[k]) + m))
                    items[k].add(i)
            hits = [_merged(x) for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, ranges), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["doc_id", "n_words", "hits", "items"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.octets("text")).mapInArrow(run, shape)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(set(spans)):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from find()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns as they are, without those that hold a window of a benchmark item. One pass over them."""
    at, columns = documents.columns.index("text"), documents.schema
    tables = _written(benchmark, window, block_bytes)

    def clean(batches):
        search = WordSearch(*tables)
        for batch in common.parts(batches, at):
            counts, found = search.occurrences([(t or "").encode() for t in batch.column(at).to_pylist()])
            keep, ends = np.ones(len(counts), dtype=bool), np.cumsum(counts)
            for first, _, _ in found:
                keep[np.searchsorted(ends, first, side="right")] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(clean, columns)
