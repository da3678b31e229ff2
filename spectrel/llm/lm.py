"""Interpolated modified Kneser-Ney word model of order 2 or 3 (the default), counted in Spark.

1. Words of the training documents are hashed to 64 bits and counted. Counts meet in shards by hash range, each written as sorted
   hash and count arrays; a word's place in all shards together is its id.
2. At order 3, triples (t, u, w) of ids are counted. A triple goes to a bucket by its place on the line of all training tokens: by
   its first word, within that by a hash of its second, and, over a stretch as long as the rarer of the two is frequent, by a hash
   of its third; so buckets hold like many tokens however frequent a word or a pair is. Each bucket is written as sorted arrays in
   levels: first words, the second words of each, the third words of each pair, and their counts. What a bucket then gives on
   is, for each pair (u, w), how many t stand before it (at the start of a text: how often it stands there).
3. Pairs (u, w) of ids with these counts (at order 2: how often they stand) go to the buckets where their triples begin. Their counts
   are written beside the bucket's pairs, and pairs without triples there as sorted keys and counts. From distinct pairs come, for
   each word before, how many words follow once, twice, or more often, and for each word, how many words stand before it; they are
   added up by shard and written beside its hashes.
4. Workers map these arrays into memory and score documents in runs: words to ids, triples and pairs to counts, counts to
   probabilities.

    P(w | t, u) = max(c(t, u, w) - D"(c), 0) / c(t, u) + gamma(t, u) * P(w | u)
    P(w | u) = max(a(u, w) - D(a), 0) / a(u) + gamma(u) * P(w)      P(w) = max(k(w) - D'(k), 0) / K + gamma' / (V + 1)

with a(u, w) the counts of step 3, k the number of words before w, a(u) and K their sums, D three discounts for 1, 2 and more from
counts of counts, and V the number of distinct training words; all other words share the last term's 1 / (V + 1). The first word of
a text has no pair before it and takes P(w | start).

Null texts are empty: their one token is the end. Repeated rows count, and are scored, each. With nothing to learn from, N and V are
0 and each token has probability 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm import arrays, common

END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Bytes of text that a worker takes at once (a longer text alone).
RUN_BYTES = 6_000_000


def runs(batches, *keep: int):
    """(columns `keep` as arrays, texts) of about RUN_BYTES together; text is the last column."""
    kept, texts, size = [[] for _ in keep], [], 0
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keep]
        for row, t in enumerate(batch.column(batch.num_columns - 1)):
            for k, c in zip(kept, columns, strict=True):
                k.append(c[row])
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= RUN_BYTES:
                yield kept, texts
                kept, texts, size = [[] for _ in keep], [], 0
    if texts:
        yield kept, texts


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, and END after each text) and the number of tokens of each text."""
    hashes, counts = common.byte_word_hashes(texts, common.BLANKS)
    return np.insert(hashes, np.cumsum(counts), END), counts + 1


def grouped(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands (or the sum of its counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers, small: byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def steps_of(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


BLOB = "part int, n long, keys binary, counts binary"
BLOB_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def blobs(parts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each part; parts ascend, and so do the keys of each."""
    first = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(parts)) if len(first) else first
    rows = [(int(parts[a]), int(b - a), packed(steps_of(keys[a:b])), packed(counts[a:b])) for a, b in zip(first, last, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * 4, BLOB_ARROW, strict=True)], schema=BLOB_ARROW)


#: Arrays beside a bucket's triples and pairs, of the smallest type that holds their values.
TRIPLE_ARRAYS = ["triple-times", "third-first"]
#: Where a pair's third words begin is stored from every so many-th pair on; sums over more words than that are stored too.
STEP = 64


def triple_blobs(parts: np.ndarray, pairs: np.ndarray, counts: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """blobs() with the third words beside the pairs."""
    first = changes(parts)
    third = [packed(words[a:b]) for a, b in zip(first, np.append(first[1:], len(parts)), strict=True)]
    return blobs(parts, pairs, counts).append_column("words", pa.array(third, pa.binary()))


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a part's blobs and the sums of their counts."""
    rows = list(zip(table["n"].to_pylist(), table["keys"], table["counts"], strict=True))
    keys = [np.cumsum(unpacked(k.as_py(), n), dtype=np.uint64) for n, k, _ in rows]
    return grouped(np.concatenate(keys), np.concatenate([unpacked(c.as_py(), n) for n, _, c in rows]))


def smallest(values: np.ndarray) -> np.ndarray:
    """Values in the smallest unsigned type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all of them share."""

    folder: str
    sizes: list[int]  # words of each shard
    sums: list[int]  # tokens of each shard
    types: dict[str, str]  # of the arrays whose type varies
    buckets: int
    documents: int
    words: tuple = ()  # discounts D', K, gamma'
    pairs: tuple = ()  # discounts D
    triples: tuple = ()  # discounts D"
    order: int = 3

    @property
    def v(self) -> int:
        return sum(self.sizes)

    @property
    def n(self) -> int:
        return sum(self.sums)


class Vocabulary:
    """The shards, mapped."""

    def __init__(self, model: Model):
        self.model = model
        self.offsets = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        self.bases = np.concatenate([[0], np.cumsum(model.sums)]).astype(np.int64)
        self.maps: dict[str, np.ndarray] = {}

    def array(self, name: str, dtype=None) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = arrays.load(self.model.folder, name, dtype or self.model.types[name])
        return self.maps[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        shards = shard_of(hashes, len(self.model.sizes))
        edges = np.searchsorted(shards, np.arange(len(self.model.sizes) + 1))
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b and self.model.sizes[s]:
                known = self.array(f"hash-{s}", np.uint64)
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + self.offsets[s], -1)
        return out

    def of(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array that runs over all shards, for ascending ids (-1: 0)."""
        out = np.zeros(len(ids), dtype=np.int64)
        edges = np.searchsorted(ids, self.offsets)
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                out[a:b] = self.array(f"{name}-{s}")[ids[a:b] - self.offsets[s]]
        return out

    def places(self, ids: np.ndarray) -> np.ndarray:
        """How many training tokens have smaller ids, for ascending ids."""
        out = np.zeros(len(ids), dtype=np.int64)
        edges = np.searchsorted(ids, self.offsets)
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                out[a:b] = self.bases[s] + self.array(f"before-{s}", np.int64)[ids[a:b] - self.offsets[s]]
        return out


def pairs_of(counts: np.ndarray, ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, word) ids of the tokens of texts; `start` stands before the first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(counts) - counts] = start
    return before, ids


class Levels:
    """The pairs of a bucket in two levels: first words, and the second words of each."""

    def __init__(self, folder: str, bucket: int):
        self.first, self.begin, self.second = (arrays.load(folder, f"{name}-{bucket}", np.uint32) for name in ("first", "second-first", "second"))

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each pair, -1 where it is not in the bucket."""
        head = within(self.first, np.zeros(len(first), dtype=np.int64), np.full(len(first), len(self.first)), first)
        out = np.full(len(first), -1, dtype=np.int64)
        at = np.flatnonzero(head >= 0)
        out[at] = within(self.second, self.begin[head[at]].astype(np.int64), self.begin[head[at] + 1].astype(np.int64), second[at])
        return out


def share_of(word: np.ndarray) -> np.ndarray:
    """A hash of ids as numbers from 0 to below 1."""
    return (common.mix(word.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def bucket_at(place: np.ndarray, model: Model) -> np.ndarray:
    return np.minimum((place * model.buckets / max(1, model.n + model.documents)).astype(np.int64), model.buckets - 1)


def stretch_of(place: np.ndarray, count: np.ndarray, second: np.ndarray, second_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the triples of a pair lie on the line of tokens: from there, so long. A pair is no more frequent than either word."""
    long = np.minimum(count, second_count)
    return place + (count - long) * share_of(second), long


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in the ascending values[low:high], -1 where it is not there."""
    if not len(values) or not len(low):
        return np.full(len(low), -1, dtype=np.int64)
    end, wanted = high, wanted.astype(values.dtype)
    for _ in range(int((high - low).max()).bit_length()):
        middle = (low + high) >> 1
        less = (low < high) & (values[np.minimum(middle, len(values) - 1)] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    return np.where((low < end) & (values[np.minimum(low, len(values) - 1)] == wanted), low, -1)


def triples_of(counts: np.ndarray, before: np.ndarray, start: int) -> np.ndarray:
    """The ids two places before the tokens of texts."""
    earlier = np.empty_like(before)
    earlier[1:] = before[:-1]
    earlier[np.cumsum(counts) - counts] = start
    return earlier


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of sorted columns begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def counts_of_counts(values: np.ndarray) -> np.ndarray:
    return np.array([(values == c).sum() for c in (1, 2, 3, 4)], dtype=np.int64)


def followers(counts: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each run of counts: how many are 1, 2, and more."""
    return [np.add.reduceat((counts == c) if c < 3 else (counts >= 3), first, dtype=np.int64) for c in (1, 2, 3)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many things were counted once, twice, three and four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3))


def lessened(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.where(c >= 3, d[2], np.where(c == 2, d[1], d[0])), 0)


def train(documents: DataFrame, folder: str, shards: int | None = None, order: int = 3) -> Model:
    """Learn from all rows of documents(text); the arrays are written to a new folder of the shared store."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = documents.sparkSession
    texts = documents.select(common.octets("text"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())

    def count_words(batches):
        for _, part in runs(batches):
            words, counts = grouped(tokens(part)[0])
            yield blobs(shard_of(words, shards), words, counts)
            yield blobs(np.array([shards]), np.array([0], dtype=np.uint64), np.array([len(part)]))

    def store_words(table):
        s, (keys, counts) = table["part"][0].as_py(), gathered(table)
        if s < shards:
            arrays.save(folder, f"hash-{s}", keys)
            arrays.save(folder, f"before-{s}", np.cumsum(counts).astype(np.int64) - counts.astype(np.int64))
            counts = smallest(counts)
            arrays.save(folder, f"count-{s}", counts)
        return pa.table({"shard": [s], "n": [len(keys)], "total": [int(counts.sum(dtype=np.int64))], "type": [str(counts.dtype)]})

    found = texts.mapInArrow(count_words, BLOB).groupBy("part").applyInArrow(store_words, "shard long, n long, total long, type string").collect()  # a row for each shard
    by = {r["shard"]: r for r in found}
    model = Model(
        folder, [by[s]["n"] if s in by else 0 for s in range(shards)], [by[s]["total"] if s in by else 0 for s in range(shards)],
        {f"count-{s}": by[s]["type"] for s in range(shards) if s in by}, shards, by[shards]["total"] if shards in by else 0, order=order,
    )
    if model.v >= 1 << 32:
        raise ValueError("ids of pairs of words have 32 bits each")
    start = model.v

    def count_pairs(batches):
        vocabulary = Vocabulary(model)
        for _, part in runs(batches):
            hashes, counts = tokens(part)
            words, inverse = np.unique(hashes, return_inverse=True)
            ids = vocabulary.ids(words)
            before, word = pairs_of(counts, ids[inverse], start)
            keys, times = grouped((before.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))
            u, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            place, count = np.append(vocabulary.places(ids), model.n), np.append(vocabulary.of("count", ids), model.documents)
            at = np.searchsorted(ids, u)  # ids ascend with the hashes; `start` comes after all
            bucket = bucket_at(stretch_of(place[at], count[at], w, count[np.searchsorted(ids, w)])[0], model)
            sort = np.argsort(bucket, kind="stable")
            yield blobs(bucket[sort], keys[sort], times[sort])

    def count_triples(batches):
        vocabulary = Vocabulary(model)
        for _, part in runs(batches):
            hashes, counts = tokens(part)
            words, inverse = np.unique(hashes, return_inverse=True)
            ids = vocabulary.ids(words)
            place, count, ids = np.append(vocabulary.places(ids), model.n), np.append(vocabulary.of("count", ids), model.documents), np.append(ids, start)
            second, third = pairs_of(counts, inverse, len(ids) - 1)  # as places in ids, which ascend
            pair = triples_of(counts, second, len(ids) - 1) * len(ids) + second
            sort = np.lexsort((third, pair))
            pair, third = pair[sort], third[sort]
            at = changes(pair, third)
            times = np.diff(np.append(at, len(pair)))
            first, second, third = pair[at] // len(ids), pair[at] % len(ids), third[at]
            begin, long = stretch_of(place[first], count[first], ids[second], count[second])
            bucket = bucket_at(begin + long * share_of(ids[third]), model)
            sort = np.argsort(bucket, kind="stable")
            pair = (ids[first].astype(np.uint64) << np.uint64(32)) | ids[second].astype(np.uint64)
            yield triple_blobs(bucket[sort], pair[sort], times[sort], ids[third][sort])

    def store_triples(table):
        b, rows = table["part"][0].as_py(), list(zip(*(table[c].to_pylist() for c in ("n", "keys", "counts", "words")), strict=True))
        pair = np.concatenate([np.cumsum(unpacked(k, n), dtype=np.uint64) for n, k, _, _ in rows])
        times, word = (np.concatenate([unpacked(r[c], r[0]) for r in rows]).astype(np.int64) for c in (2, 3))
        sort = np.lexsort((word, pair))
        pair, times, word = pair[sort], times[sort], word[sort]
        at = changes(pair, word)
        pair, times, word = pair[at], np.add.reduceat(times, at), word[at]
        second = (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inner = second != start
        own_times = times[inner]
        first = changes(pair[inner])
        pairs = pair[inner][first]
        heads = changes(pairs >> np.uint64(32))
        begin = np.append(first, len(own_times))
        many = np.flatnonzero(np.diff(begin) > STEP)
        sums = np.stack([*followers(own_times, first), np.add.reduceat(own_times, first)], axis=1)[many] if len(first) else np.zeros((0, 4), dtype=np.int64)
        stored = {f"triple-times-{b}": smallest(own_times), f"third-first-{b}": smallest(begin - np.repeat(begin[::STEP], STEP)[: len(begin)])}
        levels = {f"first-{b}": pairs[heads] >> np.uint64(32), f"second-first-{b}": np.append(heads, len(pairs)), f"second-{b}": pairs & np.uint64(0xFFFFFFFF), f"third-{b}": word[inner], f"many-{b}": many}
        for name, values in ({k: v.astype(np.uint32) for k, v in levels.items()} | stored | {f"third-step-{b}": begin[::STEP], f"many-sums-{b}": sums}).items():
            arrays.save(folder, name, values)
        given, sums = grouped((second.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), np.where(inner, 1, times))
        u, w = (given >> np.uint64(32)).astype(np.int64), (given & np.uint64(0xFFFFFFFF)).astype(np.int64)
        vocabulary, known = Vocabulary(model), u[: np.searchsorted(u, start)]  # `start` comes after all
        pad = np.ones(len(u) - len(known), dtype=np.int64)
        place, count = np.append(vocabulary.places(known), pad * model.n), np.append(vocabulary.of("count", known), pad * model.documents)
        words, at = np.unique(w, return_inverse=True)
        bucket = bucket_at(stretch_of(place, count, w, vocabulary.of("count", words)[at])[0], model)
        sort = np.argsort(bucket, kind="stable")
        note = pa.table({"part": [-1], "n": [b], "keys": [",".join(str(v.dtype) for v in stored.values()).encode()], "counts": [counts_of_counts(own_times).tobytes()]}, schema=BLOB_ARROW)
        return pa.concat_tables([pa.Table.from_batches([blobs(bucket[sort], given[sort], sums[sort])]), note])

    offsets = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)

    def store_pairs(table):
        b = table["part"][0].as_py()
        if b < 0:  # notes of the buckets of triples
            return table.append_column("kind", pa.array([-1] * table.num_rows, pa.int32()))
        keys, counts = gathered(table)
        small = smallest(counts)
        u, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = Levels(folder, b).pairs(u, w) if order == 3 and arrays.exists(folder, f"second-{b}") else np.full(len(u), -1)
        if (at >= 0).any():
            beside = np.zeros(len(arrays.load(folder, f"second-{b}", np.uint32)), dtype=small.dtype)
            beside[at[at >= 0]] = small[at >= 0]
            arrays.save(folder, f"times-{b}", beside)
        arrays.save(folder, f"pair-{b}", keys[at < 0])
        arrays.save(folder, f"pair-times-{b}", small[at < 0])
        first = changes(u)
        out = []
        kinds = [*((u[first], n) for n in followers(counts, first)), grouped(w)]
        if order == 3:
            kinds.append((u[first], np.add.reduceat(counts.astype(np.int64), first)))
        for kind, (ids, n) in enumerate(kinds, start=1):
            keep = n > 0
            ids, n = ids[keep], n[keep]
            shard = np.searchsorted(offsets, ids, side="right") - 1
            out.append((kind, blobs(shard, ids.astype(np.uint64), n)))
        tables = [pa.Table.from_batches([t]).append_column("kind", pa.array([k] * t.num_rows, pa.int32())) for k, t in out]
        note = pa.table({"part": [-1], "n": [b], "keys": [f"{small.dtype},{(at >= 0).any():d}".encode()], "counts": [counts_of_counts(counts).tobytes()], "kind": [0]}, schema=tables[0].schema)
        return pa.concat_tables([*tables, note])

    def store_statistics(table):
        s = table["part"][0].as_py()
        if s < 0:  # notes of the buckets, a few numbers each
            return pa.table({"shard": table["n"], "kind": table["kind"], "type": pa.array([k.as_py().decode() for k in table["keys"]]), "counts": table["counts"]}, schema=notes)
        size = model.sizes[s] if s < shards else 1
        rows = []
        for kind in range(1, order + 3):
            part = table.filter(pa.compute.equal(table["kind"], kind))
            values = np.zeros(size, dtype=np.int64)
            if part.num_rows:
                keys, counts = gathered(part)
                values[keys.astype(np.int64) - offsets[s]] = counts
            small = smallest(values)
            arrays.save(folder, f"s{kind}-{s}", small)
            rows.append((s, kind, str(small.dtype), np.array([*counts_of_counts(values), (values > 2).sum(), values.sum()], dtype=np.int64).tobytes()))
        return pa.table(dict(zip(notes.names, map(list, zip(*rows, strict=True)), strict=True)), schema=notes)

    notes = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("type", pa.string()), ("counts", pa.binary())])
    pairs = texts.mapInArrow(count_pairs, BLOB) if order == 2 else texts.mapInArrow(count_triples, BLOB + ", words binary").groupBy("part").applyInArrow(store_triples, BLOB)
    statistics = pairs.groupBy("part").applyInArrow(store_pairs, BLOB + ", kind int")
    told = statistics.groupBy("part").applyInArrow(store_statistics, "shard long, kind int, type string, counts binary").collect()  # a few rows for each shard
    triple_n, pair_n, word_n = np.zeros(4, dtype=np.int64), np.zeros(4, dtype=np.int64), np.zeros(6, dtype=np.int64)
    for r in told:
        numbers = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
        if r["kind"] < 0:
            model.types |= dict(zip((f"{name}-{r['shard']}" for name in TRIPLE_ARRAYS), r["type"].split(","), strict=True))
            triple_n += numbers
        elif r["kind"] == 0:
            kind, beside = r["type"].split(",")
            model.types |= {f"{name}-{r['shard']}": kind for name in (["pair-times", "times"] if beside == "1" else ["pair-times"])}
            pair_n += numbers
        else:
            model.types[f"s{r['kind']}-{r['shard']}"] = r["type"]
            if r["kind"] == 4 and r["shard"] < shards:
                word_n += numbers
    model.pairs, model.triples = discounts(pair_n.tolist()), discounts(triple_n.tolist())
    d = discounts(word_n[:4].tolist())
    k = int(word_n[5])
    model.words = (d, k, (d[0] * word_n[0] + d[1] * word_n[1] + d[2] * word_n[4]) / k if k else 1.0)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.vocabulary, self.held = model, Vocabulary(model), {}

    def by_bucket(self, buckets: np.ndarray):
        """(bucket, places of its rows), for buckets that have any."""
        sort = np.argsort(buckets, kind="stable")
        edges = np.searchsorted(buckets[sort], np.arange(self.model.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            yield b, sort[edges[b] : edges[b + 1]]

    def levels(self, b: int) -> Levels:
        if b not in self.held:
            self.held[b] = Levels(self.model.folder, b)
        return self.held[b]

    def pair_times(self, buckets: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The counts of pairs of ids, 0 for unknown ones."""
        out, array = np.zeros(len(first), dtype=np.int64), self.vocabulary.array
        for b, rows in self.by_bucket(buckets):
            if f"times-{b}" in self.model.types:
                place = self.levels(b).pairs(first[rows], second[rows])
                out[rows[place >= 0]] = array(f"times-{b}")[place[place >= 0]]
                rows = rows[place < 0]
            if f"pair-times-{b}" in self.model.types and len(known := array(f"pair-{b}", np.uint64)):
                keys = (first[rows].astype(np.uint64) << np.uint64(32)) | second[rows].astype(np.uint64)
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[place] == keys
                out[rows[same]] = array(f"pair-times-{b}")[place[same]]
        return out

    def stretches(self, buckets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs in buckets: where their third words begin and end, and how many of these stand once, twice, more often, and the sum."""
        low, high, sums = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64), np.zeros((len(first), 4), dtype=np.int64)
        array = self.vocabulary.array
        for b, rows in self.by_bucket(buckets):
            if f"triple-times-{b}" not in self.model.types:
                continue
            place = self.levels(b).pairs(first[rows], second[rows])
            rows, place = rows[place >= 0], place[place >= 0]
            steps, inner, times = array(f"third-step-{b}", np.int64), array(f"third-first-{b}"), array(f"triple-times-{b}")
            a, z = (steps[k // STEP] + inner[k] for k in (place, place + 1))
            low[rows], high[rows] = a, z
            few = z - a <= STEP
            n = (z - a)[few]
            if len(n):
                begin = np.cumsum(n) - n
                sums[rows[few]] = np.stack([*followers(values := times[np.repeat(a[few] - begin, n) + np.arange(n.sum())].astype(np.int64), begin), np.add.reduceat(values, begin)], axis=1)
            if not few.all():
                known = array(f"many-{b}", np.uint32)
                sums[rows[~few]] = array(f"many-sums-{b}", np.int64).reshape(-1, 4)[np.searchsorted(known, place[~few].astype(np.uint32))]
        return low, high, sums

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known tokens, base score and log10 probability."""
        m, vocabulary = self.model, self.vocabulary
        hashes, counts = tokens(texts)
        words, inverse = np.unique(hashes, return_inverse=True)
        ids = vocabulary.ids(words)
        order = np.argsort(ids, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        ids, inverse = ids[order], back[inverse]  # ids ascend, unknown ones first
        count = vocabulary.of("count", ids)
        once, twice, more, kinds = (vocabulary.of(f"s{k}", ids) for k in (1, 2, 3, 4))
        d, total, gamma = m.words
        word_p = lessened(kinds, d) / max(1, total) + gamma / (m.v + 1)
        base = np.log10((count + 0.1) / (m.n + 0.1 * (m.v + 1)))
        # the start of a text stands after all words
        own = [arrays.load(m.folder, f"s{k}-{len(m.sizes)}", m.types[f"s{k}-{len(m.sizes)}"])[0] if m.documents else 0 for k in (1, 2, 3)]
        size = np.append(count, m.documents)
        context = size if m.order == 2 else np.append(vocabulary.of("s5", ids), m.documents)
        spare = np.append(m.pairs[0] * once + m.pairs[1] * twice + m.pairs[2] * more, sum(x * y for x, y in zip(m.pairs, own, strict=True)))
        place, all_ids = np.append(vocabulary.places(ids), m.n), np.append(ids, m.v)
        before, word = pairs_of(counts, inverse, len(ids))
        times = np.zeros(len(word), dtype=np.int64)
        at = np.flatnonzero((all_ids[before] >= 0) & (ids[word] >= 0) & (context[before] > 0))
        u, w = before[at], word[at]
        times[at] = self.pair_times(bucket_at(stretch_of(place[u], size[u], ids[w], size[w])[0], m), all_ids[u], ids[w])
        c = context[before]
        p = np.where(c > 0, (lessened(times, m.pairs) + spare[before] * word_p[word]) / np.maximum(c, 1), word_p[word])
        if m.order == 3:
            self.with_triples(p, triples_of(counts, before, len(ids)), before, word, all_ids, place, size)
        first = np.cumsum(counts) - counts
        return counts, np.add.reduceat((count > 0)[inverse].astype(np.int64), first), np.add.reduceat(base[inverse], first), np.add.reduceat(np.log10(p), first)

    def with_triples(self, p: np.ndarray, earlier: np.ndarray, before: np.ndarray, word: np.ndarray, ids: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        """Takes each P(w | u) in p on to P(w | t, u) where the pair (t, u) was seen before a word."""
        m = self.model
        at = np.flatnonzero((ids[earlier] >= 0) & (ids[before] >= 0) & (ids[before] != m.v))
        pair, which = np.unique(earlier[at] * len(ids) + before[at], return_inverse=True)
        t, u = pair // len(ids), pair % len(ids)
        begin, long = stretch_of(place[t], size[t], ids[u], size[u])
        # a pair of frequent words may lie in several buckets, each with a part of the words that follow
        low, high = bucket_at(begin, m), bucket_at(begin + long, m)
        offset = np.cumsum(high - low + 1) - (high - low + 1)
        rows = np.repeat(np.arange(len(pair)), high - low + 1)
        bucket = low[rows] + np.arange(len(rows)) - offset[rows]
        first, last, parts = self.stretches(bucket, ids[t][rows], ids[u][rows])
        once, twice, more, total = (np.bincount(rows, weights=x, minlength=len(pair)) for x in parts.T)
        spare = m.triples[0] * once + m.triples[1] * twice + m.triples[2] * more
        seen = total[which] > 0
        at, which = at[seen], which[seen]
        times, known = np.zeros(len(at), dtype=np.int64), np.flatnonzero(ids[word[at]] >= 0)
        k, w = which[known], ids[word[at[known]]]
        own = bucket_at(begin[k] + long[k] * share_of(w), m)
        row = offset[k] + own - low[k]
        for b, found in self.by_bucket(own):
            if f"triple-times-{b}" in m.types:
                place = within(self.vocabulary.array(f"third-{b}", np.uint32), first[row[found]], last[row[found]], w[found])
                times[known[found[place >= 0]]] = self.vocabulary.array(f"triple-times-{b}")[place[place >= 0]]
        p[at] = (lessened(times, m.triples) + spare[which] * p[at]) / total[which]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability), perplexity."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    shape = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def run(batches):
        scorer = Scorer(shared.value)
        for (ids,), texts in runs(batches, 0):
            n, known, base, p = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(known), pa.array(np.full(len(n), shared.value.n)), pa.array(base), pa.array(p), pa.array(10 ** np.minimum(-p / n, 300))], schema=shape)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.octets("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
