import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from spectrel.llm import queries_runs, runs
from tests.llm.fixtures import EDGE_TEXTS, documents, prose


def brute(words, least=6, times=4):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                part = words[i : j + q]
                if all(any(part[x] != part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def periodic(seed):
    r = random.Random(seed)
    out = []
    while len(out) < r.randint(1, 260):
        unit = [r.choice("abc") for _ in range(r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31]))]
        n = int(len(unit) * r.uniform(0.5, 6.5))
        out += [unit[i % len(unit)] for i in range(n)]
        if r.random() < 0.3:
            out.append(r.choice("xyz"))
    return out


def test_runs_of_batches_equal_brute_force():
    for seed in range(60):
        r = random.Random(seed)
        texts = [periodic(1000 * seed + i) for i in range(r.randint(1, 6))] + [[]] * r.randint(0, 2)
        r.shuffle(texts)
        letters = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
        start, length, period = runs.runs_of(letters, np.array([len(t) for t in texts]))
        got = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        want, at = [], 0
        for t in texts:
            want += [(at + s, n, q) for s, n, q in brute(t)]
            at += len(t)
        assert got == want


def test_higher_exponents_and_longer_runs():
    for seed in range(20):
        t = periodic(seed)
        start, length, period = runs.runs_of(np.array([ord(w) for w in t]), np.array([len(t)]), least=9, times=5)
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == brute(t, 9, 5)
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(9, dtype=np.int64), np.array([9]), times=3)


def test_wavelet_tree():
    r = np.random.default_rng(3)
    values = r.permutation(500)[:300].astype(np.int64)
    tree = runs.WaveletTree(values, 9)
    lo = r.integers(0, 299, 400)
    hi = lo + 1 + r.integers(0, 300, 400) % (300 - lo)
    x = r.integers(0, 512, 400)
    assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x, strict=True)]
    k = r.integers(0, 300, 400) % (hi - lo)
    assert tree.smallest(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k, strict=True)]


def test_suffix_array():
    letters = np.random.default_rng(1).integers(0, 2, 200)
    *levels, (_, places, _) = [(k, None if a is None else a.copy(), b) for k, a, b in runs.suffix_blocks(letters.astype(np.int64), 200)]
    assert places.tolist() == sorted(range(200), key=lambda i: letters[i:].tolist())
    for k, rank, _ in levels:
        for i in (0, 50, 120):
            same = [j for j in range(200) if letters[j : j + 2**k].tolist() == letters[i : i + 2**k].tolist()]
            assert sum(rank == rank[i]) == len(same)


def test_query_columns_equal_brute_force(spark, tmp_path):
    texts = EDGE_TEXTS[:7] + EDGE_TEXTS[9:] + [prose(s, 40 + 9 * s, 30) for s in range(60)] + [" ".join(periodic(s)) for s in range(20)] + ["A a a a a a a a", "x x\x0bx\x0cx x x\rx x", "a " * 5, "a " * 6]
    table = documents(spark, texts)
    table = table.union(table.limit(3)).union(documents(spark, [("a b a b a b a b", None)]))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries_runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    rows = table.select("doc_id", "text").collect()
    want, rewritten = [], 0
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            rewritten += 1
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(found), *shown, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(kept(words, found)))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert rewritten >= 5 and sum(w[1] > 0 for w in want) > 15


def test_long_text_and_empty_table(spark):
    words = [f"w{i % 7001}" for i in range(40_000)] + prose(1, 20_000).split()
    row = runs.find(documents(spark, [" ".join(words)])).first()
    assert row["n_words"] == 60_000 and (0, 40_000, 7001) in [tuple(r) for r in row["runs"]]
    assert row["collapsed"].split()[:7001] == words[:7001]
    assert runs.find(documents(spark, [])).count() == 0
