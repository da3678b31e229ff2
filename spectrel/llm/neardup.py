"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Each document's set of shingles (runs of `words` words) gives a 128-bit digest and a signature of COORDINATES minima. Documents
   with equal sets are one class from here on, however many they are.
2. Classes are posted under each (coordinate, value) pair. Two classes that agree in at least T coordinates must share one of
   their COORDINATES - T + 1 least frequent postings (all pairs ordered alike), so only this prefix is kept; postings of one
   class alone count as the rarest. Lists with the same members are merged once.
3. Within each list agreements are counted. A list longer than a block is cut into blocks, and each block meets a few members of the
   list, its hubs; what that leaves apart from the list's largest component meets all of the list, block by block. So a list of
   like texts costs no pairs of blocks. A task passes on a forest of the pairs that agree in T or more coordinates, never all
   pairs. T is set so that a pair at the threshold falls below it with a probability under MISS.
4. Components of that forest hold every true link. Their members' full sets meet in the same way, in blocks sized by bytes, and
   intersections are counted exactly: one member at a time against all others, until those left belong together. The forest of
   confirmed links gives the final components.

Texts without words have no shingles and are linked with nothing; with fewer than `words` words, the whole sequence is the one
shingle. Repeated rows fall in one class. Documents without an id join their component but never name it. Classes are known
by 64 bits of their digest as nodes of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm import common, components

COORDINATES, MISS = 32, 1e-9
#: Rows of a block, and bytes of full sets in one; members of a list that meet all its blocks.
BLOCK, SET_BYTES, HUBS = 4096, 4_000_000, 8
_SEEDS = common.mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEEDS[:COORDINATES] | np.uint64(1), _SEEDS[COORDINATES:]
_C = np.uint64(0x9FB21C651E98DF25)


def least_matches(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest T with P(fewer than T of the coordinates agree) <= miss for a pair at the threshold."""
    below, t = 0.0, 0
    while t < coordinates and below + (p := comb(coordinates, t) * threshold**t * (1 - threshold) ** (coordinates - t)) <= miss:
        below += p
        t += 1
    return max(1, t)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    hashes, counts = common.byte_word_hashes(texts, common.BLANKS)
    whole = hashes.copy()
    for j in range(1, words):
        whole = whole[:-1] if j < len(hashes) else whole[:0]
        whole = common.mix(whole * _C) + hashes[j : j + len(whole)]
    whole = common.mix(whole)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(whole[at : at + n - words + 1]))
        elif n:
            short = hashes[at]
            with np.errstate(over="ignore"):
                for h in hashes[at + 1 : at + n]:
                    short = common.mix(np.array([short * _C]))[0] + h
                out.append(common.mix(np.array([short + np.uint64(n)])))
        else:
            out.append(hashes[:0])
        at += n
    return out


def digests(sets: list[np.ndarray], signed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, first and second half of the digest, signatures (texts, COORDINATES), if signed); zeros for empty sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    k1, k2 = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
    sig = np.zeros((len(sets), COORDINATES), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        h = np.concatenate([sets[k] for k in full])
        first = np.cumsum(sizes[full]) - sizes[full]
        k1[full], k2[full] = common.mix(np.add.reduceat(common.mix(h * _C), first)), np.add.reduceat(common.mix(h + _C), first)
        for j in range(COORDINATES if signed else 0):
            sig[full, j] = np.minimum.reduceat(h * _A[j] + _B[j], first)
    return sizes, k1, k2, sig


def sketches(documents: DataFrame, words: int) -> DataFrame:
    """Per document: doc_id, n_shingles, k1, k2, signature (array of COORDINATES longs), short (the signature in 16 bits each)."""
    shape = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("signature", pa.list_(pa.int64())), ("short", pa.binary())])

    def run(batches):
        for part in common.parts(batches, 1):
            n, k1, k2, sig = digests(shingle_sets(part.column(1).to_pylist(), words))
            offsets = np.arange(part.num_rows + 1, dtype=np.int32) * COORDINATES
            short = [row.tobytes() for row in (sig >> np.uint64(48)).astype("<u2")]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists, pa.array(short, pa.binary())], schema=shape)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.octets("text")).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, signature array<long>, short binary")


def in_groups(batches, keys: int) -> Iterator[pa.Table]:
    """Runs of rows whose first `keys` columns are equal, from a stream sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for k in range(keys):
            x = table.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def met(rows: DataFrame, key: str, payload: str, forest_of) -> DataFrame:
    """Edges that connect, within each key, all nodes whose payloads forest_of() links.

    rows: key, blocks (into how many the key's rows are cut), size (how many they are), node, root (null), payload. forest_of() maps rows dealt to (key, first,
    second), sorted by these, to edges; nodes of equal root need no edge. First each block meets the key's hubs. Of keys with
    several blocks, the nodes outside the key's largest component then meet all nodes: every link that is still open has
    such an end.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("size") / HUBS)) == 0

    def dealt(part: DataFrame, first, second) -> DataFrame:
        return part.select(key, first.alias("first"), second, "node", "root", payload).repartition(key, "first", "second").sortWithinPartitions(key, "first", "second", "node")

    once = forest_of(dealt(rows, F.explode(F.when(hub, every).otherwise(F.array(own))), F.lit(0).alias("second")))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return once
    once = common.cut(once)
    roots = components.connected(once).select("node", F.col("root").alias("known"))
    large = common.cut(large.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("known", "node")).drop("known"))
    parts = large.groupBy(key, "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy(key).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("all")).where("n < all")
    rest = large.join(main.select(key, "main", ((F.col("all") - F.col("n")) / F.col("all")).alias("share")), key)
    rest = rest.withColumn("lefts", F.ceil(F.col("share") * F.col("blocks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda k: F.struct(k.alias("first"), own.alias("second")))
    left = F.transform(every, lambda k: F.struct(F.pmod(F.xxhash64("node"), F.col("lefts")).cast("int").alias("first"), k.alias("second")))
    both = F.when(F.col("root") == F.col("main"), sides).otherwise(F.array_distinct(F.concat(sides, left)))
    dealt_rest = rest.withColumn("pair", F.explode(both))
    return once.unionByName(forest_of(dealt(dealt_rest, F.col("pair.first"), F.col("pair.second"))))


def agreeing(t: int):
    """Links of nodes whose short signatures agree in t coordinates, as met() takes it."""

    def run(batches):
        held = components.Contraction()
        for group in in_groups(batches, 3):
            node = group.column("node").to_numpy()
            short = np.frombuffer(b"".join(group.column("short").to_pylist()), dtype="<u2").reshape(-1, COORDINATES)
            if len(node) == 2:
                if (short[0] == short[1]).sum() >= t:
                    yield from held.add(node[:1], node[1:])
                continue
            root = pc.fill_null(group.column("root"), -1).to_numpy()
            known = group.column("root").is_valid().to_numpy()
            rows = np.arange(len(node))
            if known.any():  # the largest component's own nodes are together already
                roots, n = np.unique(root, return_counts=True)
                rows = rows[root != roots[n.argmax()]]
            u, v = [node[:0]], [node[:0]]
            step = max(1, 2_000_000 // (len(node) * COORDINATES))
            for a in range(0, len(rows), step):
                mine = rows[a : a + step]
                x, y = np.nonzero((short[mine, None] == short[None]).sum(axis=2, dtype=np.uint8) >= t)
                x, y = mine[x], y
                keep = (x != y) & (~known[x] | (root[x] != root[y]))
                a_, b_ = components.forest(x[keep], y[keep])
                u.append(node[a_])
                v.append(node[b_])
            yield from held.add(np.concatenate(u), np.concatenate(v))
        yield from held.rest()

    return lambda rows: rows.select("key", "first", "second", "node", "root", "short").mapInArrow(run, "u long, v long")


def confirmed(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the links between sets: 100 * intersection >= percent * union. label: which sets are known to belong together.

    One set at a time is compared with all by counting along its shingles' lists. Sets that were compared need it no more; it is
    done when all others are in one component.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(m), sizes)
    order = np.argsort(ids, kind="stable")
    members, begin = of[order], np.cumsum(df) - df
    starts = np.cumsum(sizes) - sizes
    label, waiting = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1], np.ones(m, dtype=bool)
    out = []
    while True:
        left = np.flatnonzero(waiting)
        count = np.bincount(label[left], minlength=m)
        if len(left) < 2 or np.count_nonzero(count) < 2:
            return out
        largest = count.argmax()
        pivot = left[np.flatnonzero(label[left] != largest)[0]]
        mine = ids[starts[pivot] : starts[pivot] + sizes[pivot]]
        mine = mine[df[mine] > 1]
        n = df[mine]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[mine], n)
        shared = np.bincount(members[at], minlength=m) if len(at) else np.zeros(m, dtype=np.int64)
        linked = np.flatnonzero((100 * shared >= percent * (sizes + sizes[pivot] - shared)) & (label != label[pivot]))
        for other in linked.tolist():
            if label[other] != label[pivot]:
                out.append((int(pivot), other))
                label[label == label[other]] = label[pivot]
        waiting[pivot] = False


def linked(percent: int):
    """Confirmed links of nodes by their octets (sorted 64-bit hashes), as met() takes it."""

    def run(batches):
        held = components.Contraction()
        for group in in_groups(batches, 3):
            node, at = np.unique(group.column("node").to_numpy(), return_index=True)  # repeated rows of one class
            if len(node) > 1:
                octets, root = group.column("octets"), group.column("root")
                known = None if root.null_count else root.to_numpy()[at]
                links = confirmed([np.frombuffer(octets[int(k)].as_buffer(), dtype="<u8") for k in at], percent, known)
                if links:
                    x, y = np.array(links).T
                    yield from held.add(node[x], node[y])
        yield from held.rest()

    return lambda rows: rows.select("cluster", "first", "second", "node", "root", "octets").mapInArrow(run, "u long, v long")


def sets_of(needed: DataFrame, words: int) -> DataFrame:
    """needed: cluster, blocks, size, node, text. The texts' shingle sets as bytes; rows whose set is not the node's are left out."""
    shape = pa.schema([("cluster", pa.int64()), ("blocks", pa.int32()), ("size", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("octets", pa.binary())])

    def run(batches):
        for part in common.parts(batches, 4):
            sets = shingle_sets(part.column(4).to_pylist(), words)
            keep = digests(sets, signed=False)[1].view(np.int64) == part.column(3).to_numpy()
            columns = [*(part.column(k) for k in range(4)), pa.nulls(part.num_rows, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=shape).filter(pa.array(keep))

    return needed.select("cluster", "blocks", "size", "node", "text").mapInArrow(run, "cluster long, blocks int, size long, node long, root long, octets binary")


def candidates(classes: DataFrame, t: int) -> DataFrame:
    """classes: node, signature, short. Edges u, v that connect all classes that agree in t or more coordinates."""
    prefix = COORDINATES - t + 1
    postings = classes.select("node", F.posexplode("signature").alias("coordinate", "value")).select("node", F.xxhash64("coordinate", "value").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entry = F.struct("n", "key")
    lists = postings.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("shared"))
    # a class's own postings are its rarest; they take up the prefix first
    room = F.lit(prefix) - (F.lit(COORDINATES) - F.size("shared"))
    kept = lists.where(room > 0).select("node", F.explode(F.slice("shared", F.lit(1), room)).alias("p")).select("node", "p.key")
    kept = common.cut(kept.join(classes.select("node", "short"), "node"))
    members = kept.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("who")).where("size > 1")
    once = members.groupBy("size", "who").agg(F.min("key").alias("key")).select("key", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = kept.join(once, "key").withColumn("root", F.lit(None).cast("long"))
    return met(rows, "key", "short", agreeing(t))


def grouped(documents: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, k1, k2 of each document; k1, k2, rep and grp of each class: its smallest doc_id and its component)."""
    docs = common.cut(sketches(documents, words))
    full = docs.where("n_shingles > 0")
    classes = common.cut(full.groupBy(F.col("k1").alias("node"), "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("short").alias("short")))
    rough = components.connected(candidates(classes, least_matches(percent / 100)))
    rough = rough.withColumnRenamed("root", "cluster").join(classes.select("node", "rep", "n_shingles"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") * 8 / SET_BYTES)).cast("int")
    needed = rough.join(rough.groupBy("cluster").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("size")), "cluster").select("cluster", "blocks", "size", "node", "rep")
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), common.octets("text"))
    wanted = texts.join(needed, "rep").select("cluster", "blocks", "size", "node", "text")
    nameless = common.cut(needed.where("rep IS NULL"))
    if not nameless.isEmpty():  # classes without an id are found by their digest
        one = keyed(documents.where("doc_id IS NULL").select("text"), words, ("node", "k2")).groupBy("node").agg(F.first("text").alias("text"))
        wanted = wanted.unionByName(one.select("node", common.octets("text")).join(nameless.drop("rep"), "node"))
    sets = common.cut(sets_of(wanted, words))
    found = components.connected(met(sets, "cluster", "octets", linked(percent)))
    of_class = classes.select("node", "k2", "rep").join(found, "node", "left")
    return docs.select("doc_id", "n_shingles", "k1", "k2"), of_class.select(F.col("node").alias("k1"), "k2", "rep", F.coalesce("root", "node").alias("grp"))


def components_of(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, k1, k2 (its set's digest), component_id (the smallest doc_id it is linked with)."""
    docs, of_class = grouped(documents, words, percent)
    least = of_class.groupBy("grp").agg(F.min("rep").alias("least"))
    out = docs.join(of_class.join(least, "grp").select("k1", "k2", "least"), ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", "k1", "k2", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keyed(documents: DataFrame, words: int, names: tuple[str, str]) -> DataFrame:
    """The rows with their set's digest in two more columns."""
    schema = documents.schema
    at = documents.columns.index("text")

    def run(batches):
        for part in common.parts(batches, at):
            _, k1, k2, _ = digests(shingle_sets([(t or "").encode() for t in part.column(at).to_pylist()], words), signed=False)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], names=[*part.schema.names, *names])

    return documents.mapInArrow(run, T.StructType([*schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, one row of each component: that of the smallest doc_id (rows without an id come last).

    A component is made of texts, not of ids: of rows that share an id, each goes with its own text. Of rows alike in id and set,
    the one of smallest hash stays, even if other columns differ. All rows without words stay.
    """
    docs, of_class = grouped(documents.select("doc_id", "text"), words, percent)
    best = of_class.groupBy("grp").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "k1", "k2")).alias("b")).select("b.rep", "b.k1", "b.k2")
    alike = docs.where("n_shingles > 0").groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    kept = best.join(alike, best["rep"].eqNullSafe(alike["doc_id"]) & (best["k1"] == alike["k1"]) & (best["k2"] == alike["k2"])).select("rep", best["k1"], best["k2"], "copies")
    free = [f"kept_{k}_" + "_" * max(map(len, documents.columns)) for k in ("rep", "k1", "k2")]  # longer than any column's name
    kept = common.cut(kept).select(*[F.col(c).alias(n) for c, n in zip(("rep", "k1", "k2"), free, strict=True)], "copies")
    own = [n + "own" for n in free]
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = keyed(documents.where(has_words), words, (own[1], own[2])).withColumn(own[0], F.col("doc_id").cast("long"))
    chosen = rows.join(kept, rows[own[0]].eqNullSafe(kept[free[0]]) & (rows[own[1]] == kept[free[1]]) & (rows[own[2]] == kept[free[2]]), "left_semi")
    if not kept.where("copies > 1").isEmpty():
        order = F.xxhash64(*[f.name for f in documents.schema.fields if "map" not in f.dataType.simpleString()])
        chosen = chosen.groupBy(*own).agg(F.min_by(F.struct(*documents.columns), order).alias(free[0])).select(f"{free[0]}.*")
    return chosen.select(*documents.columns).unionByName(documents.where(~has_words))
