"""Collocations of a corpus by a weighted de Bruijn graph of its words.

Texts are lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words `[^\\x20\\x09]+`. The nodes of a language's
graph are word runs one shorter than the longest phrase, its edges are the longest phrases, weighted by their occurrences. Paths
through nodes with one edge in, one edge out and nothing that starts or ends there are compacted into one row. Counts of shorter
phrases follow from the graph: a phrase occurs as often as its extensions by one word, plus the pieces that end with it.

A phrase that occurs `least` times has only parts that do so too. So words, then pairs, then longer phrases are counted first, each
over what the shorter ones leave, and where a phrase cannot be extended by one of the frequent ones, that counts as an end of its
piece: no count of a frequent phrase changes. Tasks pass these counts on by 40-bit hashes, sorted and as differences, about four bytes
each. Which phrases are frequent is kept in Bloom filters by hashes; two that share a hash or its bits only make the graph larger.

Words and phrases of the graph are told apart by 64-bit hashes. Tasks pass on their counts by these, each with the least checksum of a
text that has the phrase. Only that text then says what the phrase is: it is spelled once, not once for each task that counts it.

Null text is empty; null lang is `und`. Repeated rows count as often as they stand there. Texts without words, and empty tables,
give no phrase. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectrel.llm import arrays, common

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z, makes a tab a blank and a break the byte 1, which no word has: Words writes a text's own bytes of 1 otherwise.
_TABLE = bytes(1 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of a map: 32 for each frequent key, from 2**20 to 2**33 (1 GB, mapped from a file); one file has 2**27. A key sets PROBES of them,
#: so that about one in 5000 others passes.
LEAST_BITS, MOST_BITS, FILE_BITS, PROBES = 20, 33, 27, 4
#: Distinct keys that a task holds before it passes their counts on.
HELD = 1 << 21
#: Bits of a key that are counted, and how many of them name the part that is counted together.
KEY_BITS, PART_BITS = 40, 12
#: Files of the phrases that texts are to spell, by the texts' checksums.
OWN_FILES = 256


def _is_break(b: np.ndarray) -> np.ndarray:
    return (b == 1).astype(np.uint8) * common.SINGLE


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode("utf-8", "surrogatepass")).digest()[:8], "little")


def _checksum(lang: str | None, text: bytes) -> int:
    return zlib.crc32(text, _seed(lang if lang is not None else "und") & 0xFFFFFFFF)


class Words:
    """The words of a batch of texts: their bytes, a 64-bit key (of language and word) and whether the word before is of the same piece."""

    def __init__(self, langs: list[str | None], texts: list[bytes]):
        self.langs, self.texts = [x if x is not None else "und" for x in langs], texts
        # a text's own bytes of 1 must not look like breaks; byte 2 with a mark behind it does not occur otherwise
        texts = [t.replace(b"\x02", b"\x02\x03").replace(b"\x01", b"\x02\x04") if b"\x01" in t or b"\x02" in t else t for t in texts]
        self.joined, starts, sizes, hashes, counts = common.byte_words(texts, _TABLE, _is_break)
        b = np.frombuffer(self.joined, dtype=np.uint8)
        stop = b[starts] == 1 if len(starts) else np.zeros(0, dtype=bool)
        text = np.repeat(np.arange(len(texts)), counts)
        piece = np.cumsum(stop)[~stop]
        self.text, self.starts, self.sizes = text[~stop], starts[~stop], sizes[~stop]
        self.seeds = np.array([_seed(x) for x in self.langs], dtype=np.uint64)
        self.key = common.mix(hashes[~stop] + self.seeds[self.text]) if len(self.text) else np.zeros(0, dtype=np.uint64)
        self.follows = np.zeros(len(self.key), dtype=bool)
        self.follows[1:] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])

    def levels(self, known: dict, longest: int):
        """For k from 1: k, the places at which phrases of k words may be frequent, and the keys of all places' k words. A phrase may be if
        both its parts of a word less may, and the map of its length in `known` (if there is one) says so."""
        gram, reach = self.key, np.ones(len(self.key), dtype=bool)
        for k in range(1, longest + 1):
            if k > 1:
                n = len(self.key) - k + 1
                if n <= 0:
                    return
                gram = common.mix(common.mix(gram[:n]) + self.key[k - 1 :])
                reach = reach[:n] & reach[1 : n + 1]
                if k == 2:
                    reach &= self.follows[1:]
            at = np.flatnonzero(reach)
            if k in known:
                at = at[known[k].has(common.mix(gram[at] + np.uint64(k)))]
                reach = np.zeros(len(reach), dtype=bool)
                reach[at] = True
            yield k, at, gram

    def checksums(self) -> np.ndarray:
        return np.array([_checksum(g, t) for g, t in zip(self.langs, self.texts, strict=True)], dtype=np.int64)

    def phrase(self, i: int, k: int) -> str:
        found = b" ".join(self.joined[a : a + n] for a, n in zip(self.starts[i : i + k].tolist(), self.sizes[i : i + k].tolist(), strict=True))
        return (found.replace(b"\x02\x04", b"\x01").replace(b"\x02\x03", b"\x02") if b"\x02" in found else found).decode("utf-8", "replace")


def _batches(batches):
    for batch in common.parts(batches, 1):
        yield Words(batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()])


class _Tally:
    """Counts of the highest KEY_BITS of 64-bit keys, passed on when there are many: a row for each part, with its counts packed."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray):
        keys, counts = np.unique(keys >> np.uint64(64 - KEY_BITS), return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 2 * HELD:
            self._fold()
            if self.size > HELD:
                yield from self.rows()

    def _fold(self):
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts, self.size = [keys], [np.bincount(at, np.concatenate(self.counts)).astype(np.int64)], len(keys)

    def rows(self):
        if self.size:
            self._fold()
            low = KEY_BITS - PART_BITS
            part = (self.keys[0] >> np.uint64(low)).astype(np.int32)
            parts, first = np.unique(part, return_index=True)
            bounds = [*first.tolist(), len(part)]
            within = (self.keys[0] & np.uint64((1 << low) - 1)).astype(np.uint32)
            packed = [_packed(within[a:b], self.counts[0][a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])
        self.keys, self.counts, self.size = [], [], 0


def _packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, then columns, each by first, second, third and fourth bytes: most of these are alike, so they compress."""
    every = np.stack([np.diff(keys, prepend=np.uint32(0)), *(c.astype(np.uint32) for c in columns)])
    return every.astype("<u4").view(np.uint8).reshape(len(every), len(keys), 4).transpose(0, 2, 1).tobytes()


def _unpacked(packed: bytes, columns: int = 1) -> np.ndarray:
    every = np.frombuffer(packed, dtype=np.uint8).reshape(1 + columns, 4, -1).transpose(0, 2, 1).copy().view("<u4")[:, :, 0]
    every[0] = np.cumsum(every[0], dtype=np.uint32)
    return every


def _merged(counted: DataFrame, columns: int, found, schema: str) -> DataFrame:
    """found(part, arrays) of each part, in one go: a 4096th of what the tasks pass on."""

    def merge(batches):
        at, held = None, []
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != at:
                    if held:
                        yield found(at, np.concatenate(held, axis=1))
                    at, held = part, []
                held.append(_unpacked(packed.as_py(), columns))
        if held:
            yield found(at, np.concatenate(held, axis=1))

    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema)


def _often(counted: DataFrame, least: int) -> DataFrame:
    """key, n: those counted at least `least` times."""

    def found(part, arrays):
        every, place = np.unique(arrays[0], return_inverse=True)
        n = np.bincount(place, arrays[1])
        often = every[n >= least].astype(np.uint64) | np.uint64(part << (KEY_BITS - PART_BITS))
        return pa.RecordBatch.from_arrays([pa.array((often << np.uint64(64 - KEY_BITS)).view(np.int64)), pa.array(n[n >= least].astype(np.int64))], names=["key", "n"])

    return _merged(counted, 1, found, "key long, n long")


def _summed(keys: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts and the least of its owners."""
    if not len(keys):
        return keys, counts, owners
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(owners[order], first)


class _Totals:
    """Counts of whole 64-bit keys and the least checksum of a text that has them, passed on as in _Tally."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.held.append(_summed(keys, counts, owners))
        self.size += len(self.held[-1][0])
        if self.size > 2 * HELD:
            self._fold()
            if self.size > HELD:
                yield from self.rows()

    def _fold(self):
        self.held = [_summed(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
        self.size = len(self.held[0][0])

    def rows(self):
        if self.size:
            self._fold()
            keys, counts, owners = self.held[0]
            high, low = keys >> np.uint64(64 - KEY_BITS), keys & np.uint64((1 << (64 - KEY_BITS)) - 1)
            parts, first = np.unique((keys >> np.uint64(64 - PART_BITS)).astype(np.int32), return_index=True)
            bounds = [*first.tolist(), len(keys)]
            within = (high & np.uint64((1 << (KEY_BITS - PART_BITS)) - 1)).astype(np.uint32)
            columns = [low, counts & 0xFFFFFFFF, counts >> 32, owners]
            packed = [_packed(within[a:b], *(c[a:b] for c in columns)) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])
        self.held, self.size = [], 0


def _totals(counted: DataFrame) -> DataFrame:
    """key, n, owner: whole keys with their counts and the least checksum of a text that has them."""

    def found(part, arrays):
        within, low, few, many, owners = arrays.astype(np.uint64)
        keys = np.uint64(part << (64 - PART_BITS)) | (within << np.uint64(64 - KEY_BITS)) | low
        keys, n, owners = _summed(keys, (few | (many << np.uint64(32))).astype(np.int64), owners.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(owners)], names=["key", "n", "owner"])

    return _merged(counted, 4, found, "key long, n long, owner long")


class Bits:
    """A Bloom filter of keys' KEY_BITS highest bits, in files of a shared folder by the highest of them."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.files = folder, bits, {}

    def __contains__(self, key) -> bool:
        return bool(self.has(np.array([key], dtype=np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        out, several = np.zeros(len(keys), dtype=bool), self.bits > FILE_BITS
        part = (keys >> np.uint64(64 - self.bits + FILE_BITS)).astype(np.int64) if several else np.zeros(min(1, len(keys)), dtype=np.int64)
        for p in np.unique(part).tolist():
            if p not in self.files:
                self.files[p] = arrays.load(self.folder, f"bits-{p}", np.uint8) if arrays.exists(self.folder, f"bits-{p}") else None
            if self.files[p] is not None:
                own = np.flatnonzero(part == p) if several else np.arange(len(keys))
                first, step = _places(keys[own])
                for i in range(PROBES):
                    at = _probe(first, step, i, 1 << min(self.bits, FILE_BITS))
                    held = ((self.files[p][at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                    own, first, step = own[held], first[held], step[held]
                out[own] = True
        return out


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = common.mix(keys >> np.uint64(64 - KEY_BITS))
    return mixed >> np.uint64(32), mixed | np.uint64(1)


def _probe(first: np.ndarray, step: np.ndarray, i: int, width: int) -> np.ndarray:
    """The i-th of a key's bits in its file of `width` bits."""
    return ((first + np.uint64(i) * step) & np.uint64(width - 1)).astype(np.int64)


def _opened(maps: dict) -> dict:
    return {k: Bits(*m) for k, m in maps.items()}


def _frequent(counted: DataFrame, least: int, name: str) -> tuple[str, int]:
    """The folder and the bits of a map of the keys counted at least `least` times."""
    spark = counted.sparkSession
    keys = common.cut(counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
    bits = int(np.clip(np.ceil(np.log2(32 * max(1, keys.count()))), LEAST_BITS, MOST_BITS))
    folder = common.new_folder(spark, f"collocations-{name}")
    width = 1 << min(bits, FILE_BITS)

    def save(table):
        first, step = _places(table["key"].to_numpy().view(np.uint64))
        part = table["part"][0].as_py()
        out = np.zeros(width, dtype=bool)
        for i in range(PROBES):
            out[_probe(first, step, i, width)] = True
        arrays.save(folder, f"bits-{part}", np.packbits(out, bitorder="little"))
        return pa.table({"part": [part]})

    part = F.shiftrightunsigned(F.col("key"), max(64 - bits + FILE_BITS, 64 - bits)) if bits > FILE_BITS else F.lit(0)
    keys.withColumn("part", part).groupBy("part").applyInArrow(save, "part long").collect()  # a row for each file, 64 at most
    return folder, bits


def graph(documents: DataFrame, least: int = 100, longest: int = 5) -> DataFrame:
    """lang, k, phrase, n: the edges (k = longest) of each language's graph with their weights; for smaller k the ends of pieces, as
    phrases of k words; for k = 0 all words. Only what phrases with `least` occurrences need."""
    docs = documents.select("lang", common.octets())

    maps: dict[int, tuple[str, int]] = {}

    def tally(levels):
        def count(batches):
            held, known = _Tally(), _opened(maps)
            for found in _batches(batches):
                for k, at, gram in found.levels(known, max(levels)):
                    if k in levels:
                        yield from held.add(common.mix(gram[at] + np.uint64(k)))
            yield from held.rows()

        return docs.mapInArrow(count, "part int, counts binary")

    for levels in ([1], [2], list(range(3, longest)), [longest] * (longest > 2)):
        if levels and max(levels) <= longest:
            maps |= dict.fromkeys(levels, _frequent(_often(tally(levels), least), least, str(levels[0])))

    def grams(batches):
        held, known = _Totals(), _opened(maps)
        for found in _batches(batches):
            owners, words = found.checksums(), np.bincount(found.text, minlength=len(found.langs))
            yield from held.add(found.seeds, words, owners)
            levels = list(found.levels(known, longest))
            for (k, at, gram), longer in zip(levels, [x[1] for x in levels[1:]] + [None], strict=True):
                # an edge wherever it is; a shorter phrase only where it isn't the start of the next longer
                at = np.setdiff1d(at, longer, assume_unique=True) if longer is not None else at
                yield from held.add(common.mix(gram[at] + np.uint64(k)), np.ones(len(at), dtype=np.int64), owners[found.text[at]])
        yield from held.rows()

    totals = common.cut(_totals(docs.mapInArrow(grams, "part int, counts binary")))
    return totals.join(spelled(docs, totals, longest).dropDuplicates(["key"]), "key").select("lang", "k", "phrase", "n")


def spelled(docs: DataFrame, totals: DataFrame, longest: int = 5) -> DataFrame:
    """key, lang, k, phrase of all keys of `totals` (key, owner), each from the text with the owner's checksum: once, or once from each
    task that has a copy of that text. Other texts are only passed by."""
    folder = common.new_folder(docs.sparkSession, "collocations-own")

    def save(table):
        owner, key = (table[c].to_numpy().view(np.uint64) for c in ("owner", "key"))
        order = np.argsort(owner, kind="stable")
        arrays.save(folder, f"own-{table['part'][0].as_py()}", np.stack([owner[order], key[order]]))
        return pa.table({"part": [table["part"][0].as_py()]})

    part = F.pmod(F.col("owner"), F.lit(OWN_FILES))
    totals.select("key", "owner", part.alias("part")).groupBy("part").applyInArrow(save, "part long").collect()  # a row for each file, 256 at most

    def spell(batches):
        files, done = {}, set()

        def own(checksum):
            p = checksum % OWN_FILES
            if p not in files:
                files[p] = arrays.load(folder, f"own-{p}", np.uint64).reshape(2, -1) if arrays.exists(folder, f"own-{p}") else np.zeros((2, 0), dtype=np.uint64)
            a, b = np.searchsorted(files[p][0], np.array([checksum, checksum + 1], dtype=np.uint64)).tolist()
            return [x for x in files[p][1, a:b].tolist() if x not in done]

        for batch in common.parts(batches, 1):
            langs, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            checksums = [_checksum(g, t) for g, t in zip(langs, texts, strict=True)]
            wanted = {c: keys for c in set(checksums) if (keys := own(c))}
            if not wanted:
                continue
            at = [i for i, c in enumerate(checksums) if c in wanted]
            found = Words([langs[i] for i in at], [texts[i] for i in at])
            keys = np.unique(np.array([x for each in wanted.values() for x in each], dtype=np.uint64))
            out = []
            for i in np.flatnonzero(np.isin(found.seeds, keys)).tolist():
                out.append((int(found.seeds[i]), found.langs[i], 0, ""))
            for k, at, gram in found.levels({}, longest):
                every, first = np.unique(common.mix(gram[at] + np.uint64(k)), return_index=True)
                held = np.isin(every, keys, assume_unique=True)
                out += [(x, found.langs[found.text[i]], k, found.phrase(i, k)) for x, i in zip(every[held].tolist(), at[first[held]].tolist(), strict=True)]
            out = list({x[0]: x for x in out}.values())
            done.update(x[0] for x in out)
            if out:
                key, lang, length, phrase = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(key, dtype=np.uint64).view(np.int64)), pa.array(lang, pa.string()), pa.array(length, pa.int32()), pa.array(phrase, pa.string())], names=["key", "lang", "k", "phrase"])

    return docs.mapInArrow(spell, "key long, lang string, k int, phrase string")


def compacted(found: DataFrame, longest: int = 5) -> DataFrame:
    """lang, words, edges, n: the graph's unary paths as one row each, `edges` phrases of `longest` words that overlap in all words but one.

    A node is passed by a path if one edge comes in, one goes out, and as many occurrences come as go, none of them at a piece's start
    or end. Each edge then learns the path's first edge and its distance from it by doubling. A path lies whole in one piece of a
    document, so its row is no longer than the longest piece.
    """
    first, last = F.substring_index("phrase", " ", longest - 1), F.substring_index("phrase", " ", 1 - longest)
    edges = found.where(F.col("k") == longest).select("lang", F.col("phrase").alias("edge"), "n", first.alias("source"), last.alias("target"))
    comes = edges.groupBy("lang", F.col("target").alias("node")).agg(F.count("*").alias("n_in"), F.sum("n").alias("flow_in"), F.max("edge").alias("before"))
    goes = edges.groupBy("lang", F.col("source").alias("node")).agg(F.count("*").alias("n_out"), F.sum("n").alias("flow_out"))
    ends = found.where(F.col("k") == longest - 1).select("lang", F.col("phrase").alias("node"))
    unary = comes.join(goes, ["lang", "node"]).where("n_in = 1 AND n_out = 1 AND flow_in = flow_out").join(ends, ["lang", "node"], "left_anti")
    held = edges.join(unary.select("lang", F.col("node").alias("source"), "before"), ["lang", "source"], "left")
    held = common.cut(held.select("lang", "edge", "n", F.coalesce("before", "edge").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("place")))
    while True:
        heads = held.select("lang", F.col("edge").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        open_heads = heads.where("more > 0")
        if held.join(open_heads, ["lang", "head"], "left_semi").limit(1).count() == 0:
            break
        held = held.join(open_heads, ["lang", "head"], "left")
        held = common.cut(held.select("lang", "edge", "n", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
    word = F.substring_index("edge", " ", -1)
    path = F.array_sort(F.collect_list(F.struct("place", word.alias("word"))))
    rows = held.groupBy("lang", "head").agg(F.max("n").alias("n"), path.alias("path"))
    start = F.split(F.substring_index("head", " ", longest - 1), " ", -1)
    return rows.select("lang", F.concat(start, F.col("path.word")).alias("words"), F.size("path").alias("edges"), "n")


def counts(found: DataFrame, paths: DataFrame, longest: int = 5) -> DataFrame:
    """lang, k, phrase, n: the occurrences of all phrases of 1 to `longest` words that the graph holds, each length from the next longer."""
    at = F.explode(F.expr("sequence(1, edges)"))
    level = paths.select("lang", "words", "n", at.alias("i")).select("lang", F.array_join(F.slice("words", F.col("i"), F.lit(longest)), " ").alias("phrase"), "n")
    levels = [level.select("lang", F.lit(longest).alias("k"), "phrase", "n")]
    for k in range(longest - 1, 0, -1):
        flow = levels[-1].select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "n")
        ends = found.where(F.col("k") == k).select("lang", "phrase", "n")
        level = flow.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        levels.append(common.cut(level.select("lang", F.lit(k).alias("k"), "phrase", "n")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def scored(known: DataFrame, totals: DataFrame, least: int = 100, percent: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates in counts `known` (lang, k, phrase, n); totals: lang, n.

    score = floor(1000 a n / (l r)) of the worst cut, exact in 38 digits. A candidate inside a longer one that occurs at least
    percent / 100 times as often is dropped; then one that is a single word longer is such a one too, so only those are looked at.
    """
    often = common.cut(known.where(F.col("n") >= least))
    candidates = often.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    shorter = F.explode(F.expr("array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))"))
    longer = candidates.where("k > 2").select("lang", shorter.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right"))
    lefts = often.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = often.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    wide = [f"CAST({c} AS decimal(19,0))" for c in "anlr"]
    score = F.expr("(CAST(1000 * {} AS decimal(19,0)) * {}) div ({} * {})".format(*wide))
    rows = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(F.broadcast(totals), "lang")
    worst = rows.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "cut", "l", "r").alias("cut"))
    worst = worst.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("cut").alias("cut"))
    return worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, top: int = 2000, parts: int = 64) -> DataFrame:
    """Adds rank: each lang's first `top` rows by score, a (both descending) and phrase; first in parts of a lang, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.hash("phrase"), F.lit(parts))
    first = found.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(documents: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best collocations of 2 to `longest` words (2 or more; least 1 or more)."""
    found = common.cut(graph(documents, least, longest))
    known = counts(found, compacted(found, longest), longest)
    totals = found.where("k = 0").select("lang", "n")
    return ranked(scored(known, totals, least, percent), top)
