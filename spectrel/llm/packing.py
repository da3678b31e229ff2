"""Sequence packing: shortest-pack-first over the length histogram.

1. Every document becomes token ids, closed by `end_id`, and is cut at each multiple of `size`: full pieces and one remainder.
2. Pieces of each length are counted. The histogram has at most `size` rows, so it may go to the driver.
3. Lengths are placed longest first, all pieces of a length at once: into the pack with most room, as many copies of it as there
   are, or into as many new packs as this length and the shorter pieces need. The outcome is a list of patterns (which lengths in which order) with counts.
4. Each pattern slot of a length takes a run of ranks among the pieces of that length, so that a piece's rank within its length
   leads back to its pattern, copy and offset. Ranks come from sums over (length, salt) groups, not from one window per length.

Null text is empty: one piece with the end id alone. Repeated documents are packed as often as they come; pieces tell them apart
by nothing but their sequence. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectrel.llm import common

#: Rows that one (length, salt) group holds on average, at most.
GROUP_ROWS = 50_000
#: Words whose ids a worker keeps between runs: those met last.
CACHE_WORDS = 400_000
#: A character of its own ids; words are encoded in groups with it between them.
MARK = "\ue000"
#: Words end at blanks and line ends. Case does not count, but in the names of special tokens, which stand in these marks.
ENDS, SPECIAL = bytes(32 if c in b" \n" else c for c in range(256)), b"<|"
LOWER = ENDS.lower()
#: Letters, single digits and other signs of ASCII are tokens apart; not so next to a sign that a contraction or special token has.
LETTER = 1
_KINDS = np.array([0 if c == 32 else common.STICKY if c > 126 or c < 32 or chr(c) in "'<|>" else LETTER if chr(c).isalpha() else common.SINGLE if chr(c).isdigit() else 3 for c in range(256)], dtype=np.uint8)


def kinds(b: np.ndarray) -> np.ndarray:
    """Kinds of the bytes of texts. The two bytes of U+00C0 to U+023F are letters too, but for the two signs there and U+0130, whose
    lower case is a letter and a mark; what no such rule covers is sticky."""
    kind = _KINDS[b]
    lead = np.flatnonzero((b >= 0xC3) & (b <= 0xC8))
    two = b[lead].astype(np.uint16) << 8 | b[lead + 1]
    lead = lead[(two & 0xC0 == 0x80) & (two != 0xC397) & (two != 0xC3B7) & (two != 0xC4B0)]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


class Encoder:
    """Token ids of texts. Tokens cross neither blanks nor, in ASCII, from letters to digits or signs, so a text's ids are those of the
    words between these. Each word is encoded once and then known by 64 bits; a run of texts is put together from known words by their places in one array of ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        letters = Tokenizer.from_file(path)  # for words of letters alone, which need no rules but lower case
        letters.normalizer = normalizers.Lowercase()
        letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters, suffix = letters, self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids that end a word
        self.closes[[i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True
        self.mark = np.array(self.tokenizer.encode(MARK, add_special_tokens=False).ids, dtype="<u4")
        self.hashes = np.zeros(0, dtype=np.uint64)  # ascending; with each the place and number of its ids, and the run that met it last
        self.start = self.size = self.met = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")
        self.run = 0

    def split(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n words without the MARKs between them, and how many each word has. MARK's ids in a row are nothing else's: no other
        character has its bytes."""
        if n == 1:
            return ids, np.array([len(ids)])
        m = len(self.mark)
        marks = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - m + 1 + k] == self.mark[k] for k in range(m)]))
        keep = np.ones(len(ids), dtype=bool)
        keep[(marks[:, None] + np.arange(m)).ravel()] = False
        return ids[keep], np.append(marks, len(ids)) - np.concatenate([[0], marks + m])

    def new(self, words: list[bytes], lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has. lettered: which words are letters alone."""
        order, ids, sizes = [], [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        simple = np.flatnonzero(lettered).tolist()
        for e in self.letters.encode_batch_fast([b" ".join([words[k] for k in simple[at : at + 256]]).decode() for at in range(0, len(simple), 256)], add_special_tokens=False):
            ids.append(np.array(e.ids, dtype="<u4"))
            sizes.append(np.diff(np.flatnonzero(self.closes[ids[-1]]), prepend=-1))
        order += simple
        rest = np.flatnonzero(~lettered).tolist()
        texts = {k: words[k].decode("utf-8", "replace") for k in rest}
        groups, plain = [[k] for k in rest if MARK in texts[k]], [k for k in rest if MARK not in texts[k]]
        groups += [plain[at : at + 256] for at in range(0, len(plain), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([f" {MARK} ".join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            part, n = self.split(np.array(e.ids, dtype="<u4"), len(group))
            ids.append(part)
            sizes.append(n)
            order += group
        size, start = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        found = np.concatenate(sizes)
        size[order], start[order] = found, np.cumsum(found) - found
        return taken(np.concatenate(ids), start, size), size

    def learn(self, hashes: np.ndarray, words: list[bytes], lettered: np.ndarray) -> None:
        """Encodes words whose hashes ascend, none of them known; forgets those met longest ago if there are too many."""
        ids, sizes = self.new(words, lettered)
        if len(self.hashes) > CACHE_WORDS:
            keep = self.met >= np.partition(self.met, len(self.met) - CACHE_WORDS // 2)[len(self.met) - CACHE_WORDS // 2]
            self.ids = taken(self.ids, self.start[keep], self.size[keep])
            self.hashes, self.size, self.met = self.hashes[keep], self.size[keep], self.met[keep]
            self.start = np.cumsum(self.size) - self.size
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.start = np.insert(self.start, at, np.cumsum(sizes) - sizes + len(self.ids))
        self.size, self.met = np.insert(self.size, at, sizes), np.insert(self.met, at, self.run)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, end_id after each, and how many each text has, that one included."""
        self.run += 1
        joined, starts, sizes, hashes, counts = common.byte_words(texts, ENDS if any(SPECIAL in t for t in texts) else LOWER, kinds)
        words, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, words)
        known = np.zeros(len(words), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == words[inside]
        self.met[at[known]] = self.run
        if not known.all():
            lacking = first[~known]
            begin, n = starts[lacking], sizes[lacking]
            inner = kinds(np.frombuffer(joined, dtype=np.uint8)) != LETTER
            others = np.concatenate([[0], np.cumsum(inner)])
            self.learn(words[~known], [joined[a : a + k] for a, k in zip(begin.tolist(), n.tolist(), strict=True)], others[begin + n] == others[begin])
            at = np.searchsorted(self.hashes, words)
        ends = np.cumsum(counts)
        start = np.insert(self.start[at][inverse], ends, len(self.ids))
        size = np.insert(self.size[at][inverse], ends, 1)
        first = np.cumsum(counts + 1) - counts - 1
        return taken(np.append(self.ids, np.uint32(end_id)), start, size), np.add.reduceat(size, first) if len(texts) else counts


def taken(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    return values[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]


_ENCODERS: OrderedDict[str, Encoder] = OrderedDict()


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(documents: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit)."""
    shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for part in common.parts(batches, 1, 2_000_000):
            ids, n = encoder(tokenizer_path).encode(part.column(1).to_pylist(), end_id)
            count = -(-n // size)  # pieces of each text
            row = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
            length = np.minimum(size, n[row] - start)
            offsets = np.concatenate([[0], np.cumsum(length)])
            for a in range(0, len(row), 1000):  # short batches: a binary column's offsets have 32 bits
                b = min(len(row), a + 1000)
                held = pa.py_buffer(np.ascontiguousarray(ids[offsets[a] : offsets[b]]))
                binary = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * (offsets[a : b + 1] - offsets[a])).astype(np.int32)), held])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[a:b])), pa.array(start[a:b]), pa.array(length[a:b]), pa.array(n[row[a:b]]), binary], schema=shape)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.octets("text")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, count) of packs that hold all pieces: shortest-pack-first, longest pieces first."""
    open_packs: list[tuple[int, int, tuple[int, ...], int]] = []  # (-room, number, lengths, count)
    number = free = 0
    shorter = sum(k * n for k, n in histogram.items())  # tokens in pieces still to come
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        shorter -= length * left
        while left:
            if not open_packs or -open_packs[0][0] < length:
                # as many new packs as the rest of this length and what shorter pieces leave over need, each with like many copies
                packs = min(left, max(-(-left // (size // length)), -(-(left * length + max(0, shorter - free)) // size)))
                free += packs * size - left * length
                for copies, count in ((left // packs + 1, left % packs), (left // packs, packs - left % packs)):
                    if count:
                        number += 1
                        heapq.heappush(open_packs, (length * copies - size, number, (length,) * copies, count))
                left = 0
                continue
            room, _, lengths, count = heapq.heappop(open_packs)
            room = -room
            # the same pack stays the shortest until its room falls below the next one's
            after = -open_packs[0][0] if open_packs else 0
            times = max(1, min(room // length, (room - max(after, length)) // length + 1, left // count))
            used = min(count, left // times)
            left -= used * times
            free -= used * times * length
            number += 1
            heapq.heappush(open_packs, (length * times - room, number, lengths + (length,) * times, used))
            if count > used:
                number += 1
                heapq.heappush(open_packs, (-room, number, lengths, count - used))
    return [(lengths, count) for _, _, lengths, count in open_packs]


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Of each pattern slot: its length, the first rank it takes, its first sequence and its offset; ordered by length and rank."""
    out: dict[str, list[int]] = {"length": [], "rank": [], "sequence": [], "offset": []}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, count in found:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            for k, v in zip(out, (length, rank, sequence, offset), strict=True):
                out[k].append(v)
            taken[length] = rank + count
            offset += length
        sequence += count
    arrays = {k: np.array(v, dtype=np.int64) for k, v in out.items()}
    order = np.lexsort((arrays["rank"], arrays["length"]))
    return {k: v[order] for k, v in arrays.items()}


def ranked(rows: DataFrame, largest: int) -> DataFrame:
    """Adds rank, from 0 within each length. largest: rows of the most frequent length, which sets how many salts there are."""
    salts = max(1 + largest // GROUP_ROWS, isqrt(largest))  # as many groups of a length as rows in a group, or more
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_key"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_key")
    return salted.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within")).drop("salt", "within", "before")


def pack(cut_pieces: DataFrame, size: int = 4096) -> DataFrame:
    """cut_pieces: doc_id, start, length, ids_key (anything that tells pieces apart) and other columns, written somewhere to be
    read more than once. Adds sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    shared = cut_pieces.sparkSession.sparkContext.broadcast(slots(patterns(histogram, size)))
    rows = ranked(cut_pieces, max(histogram.values(), default=0))
    columns = [c for c in rows.columns if c != "rank"]
    out = rows.select(*columns, "rank")

    def run(batches):
        s = shared.value
        keys = (s["length"] << 44) + s["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence = s["sequence"][at] + rank - s["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(s["offset"][at])], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1])
    return out.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their ids and places: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    cut_up = common.cut(pieces(documents, tokenizer_path, size, end_id).withColumn("ids_key", F.xxhash64("ids")))
    return pack(cut_up, size).drop("ids_key")


def pack_digests(documents: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """As pack_documents(), with the checksum ids_crc32 of each piece in place of its ids, which are never shuffled."""
    found = pieces(documents, tokenizer_path, size, end_id).select("doc_id", "start", "length", F.crc32("ids").alias("ids_key"), "doc_tokens")
    return pack(common.cut(found), size).withColumnRenamed("ids_key", "ids_crc32")
