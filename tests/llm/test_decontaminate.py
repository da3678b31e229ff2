import hashlib
import random
import re

import pytest
from tests.llm.fixtures import EDGE_TEXTS, documents, prose

from spectrel.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = {}
    for k, text in docs:
        w, hit, found = words(text), set(), set()
        for i, passage in items:
            p = words(passage)
            m = min(window, len(p))
            if not m:
                continue
            for a in range(len(p) - m + 1):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == p[a : a + m]:
                        hit |= set(range(b, b + m))
                        found.add(str(i))
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [10**9, 300])
def test_equals_brute_force(spark, block_bytes):
    r = random.Random(5)
    items = [(i, prose(100 + i, r.choice([3, 9, 10, 11, 25]), 12)) for i in range(12)] + [(50, None), (51, ""), (52, "one"), (53, "the The THE the the the the the the the the"), (3, prose(103, 30, 12))]
    texts = EDGE_TEXTS[:7] + [prose(7, 400, 12), "the " * 30, prose(9, 30) + " " + items[4][1].upper() + ". " + prose(8, 20), items[2][1], items[2][1], "one two"]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.find(docs, bench, block_bytes=block_bytes)).collect()}
    assert got == brute(list(enumerate(texts)), items)
    clean = decontaminate.remove(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {k for k, v in got.items() if not v[-1]}


def test_empty_tables_and_repeated_rows(spark):
    docs, none = documents(spark, ["a b c", "a b c"]), documents(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.digest(decontaminate.find(docs, bench)).collect()] == [(3, 0, 0)] * 2
    assert decontaminate.find(none, bench).count() == 0
    same = docs.union(docs)
    bench = spark.createDataFrame([(i, f"{w} b c") for i, w in enumerate("az")], "item_id long, text string")
    for size in (10**9, 1):
        assert sorted((r["doc_id"], r["hits"][0]["end"]) for r in decontaminate.find(same, bench, block_bytes=size).collect()) == [(0, 3), (0, 3), (1, 3), (1, 3)]


def test_long_items_and_stretches_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 14)
    monkeypatch.setattr(decontaminate, "STRETCH", 7)
    items = [(i, prose(i, n, 9)) for i, n in enumerate((60, 14, 15, 5, 4, 1, 2))] + [(9, "a b")]
    texts = [prose(40 + i, 90, 9) + " " + prose(i % 3, 60, 9)[30 * i : 30 * i + 90] for i in range(8)] + ["a", "b a b", "", prose(0, 60, 9)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    for window in (10, 3, 1):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.find(docs, bench, window, block_bytes=400)).collect()}
        assert got == brute(list(enumerate(texts)), items, window)


def test_shifts_skip_and_lose_nothing():
    import numpy as np

    r = np.random.default_rng(2)
    hashes = r.integers(0, 30, 4000).astype(np.uint64)
    begin = np.repeat(np.arange(0, 4000, 400), 400)
    keys = decontaminate._pairs(hashes)
    patterns = [hashes[s : s + 6] for s in r.integers(0, 390, 5)]
    table: dict = {}
    for p in patterns:
        k = decontaminate._pairs(p)
        for end in range(1, 6):
            table[int(k[end])] = min(table.get(int(k[end]), 6), 5 - end)
    names = np.array(sorted(table), dtype=np.uint64)
    ends = decontaminate._ends(keys, begin, 6, names, np.array([table[int(k)] for k in names], dtype=np.uint8))
    true = [e for e in range(4000) if e - begin[e] >= 5 and any((hashes[e - 5 : e + 1] == p).all() for p in patterns)]
    assert set(true) <= set(ends.tolist()) and len(ends) < 400 and len(true) >= 5
