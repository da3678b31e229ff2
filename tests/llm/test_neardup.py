import random
import re

import numpy as np
import pytest
from tests.llm.fixtures import EDGE_TEXTS, documents, prose

from spectrel.llm import components, neardup


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def edited(text, r, share):
    w = text.split()
    for k in range(len(w)):
        if r.random() < share:
            w[k] = "new" + str(r.randint(0, 99))
    return " ".join(w)


def rows_of(seed):
    r = random.Random(seed)
    common = prose(999, 40)
    rows = list(EDGE_TEXTS) + ["one", "ONE", "one two", "two one", "one two three"]
    for g in range(12):
        base = prose(50 + g, r.randint(30, 150), 400)
        rows += [edited(base, r, r.choice([0, 0.01, 0.02, 0.04])) for _ in range(r.choice([1, 2, 9, 25]))]
    rows += [common + " " + prose(700 + k, 60, 400) for k in range(40)] + [prose(3, 90)] * 30
    r.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 85, 512), (5, 80, 7)])
def test_equals_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SET_BYTES", block * 1000)
    rows = rows_of(n)
    rows += [(rows[0][0], rows[0][1]), (None, prose(3, 90)), (None, prose(4444, 30))]
    docs = spark.createDataFrame([(t, i, "en", "s", 0, "x", 7) for i, t in rows], "text string, doc_id long, lang string, source string, n_chars long, node string, key int").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.components_of(docs, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)
    kept = neardup.keep_one(docs, n, percent)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted({c for i, _, c in got if c is not None and i == c})


def test_one_row_of_each_component_stays(spark):
    shape = "doc_id long, text string, kept_id long, lang string, node long, rep int"
    base, near, other, lone = prose(1, 90), prose(1, 90) + " end", prose(2, 90), prose(3, 90)

    def kept(*rows):
        docs = spark.createDataFrame([(i, t, 1, lang, 2, 3) for i, t, lang in rows], shape)
        out = neardup.keep_one(docs, 5, 80)
        assert out.columns == docs.columns
        return sorted(((r["doc_id"], r["text"], r["lang"]) for r in out.collect()), key=str)

    # rows without an id: of copies of a document with one, none; of those among themselves, one
    assert kept((1, base, "a"), (None, near, "b"), (None, base, "c"), (None, other, "d"), (None, other, "d"), (None, lone, "e")) == sorted([(1, base, "a"), (None, other, "d"), (None, lone, "e")], key=str)
    # one id, two texts: each row goes with its text
    assert kept((5, base, "a"), (7, near, "b"), (7, other, "c")) == [(5, base, "a"), (7, other, "c")]
    # alike in id and text, different elsewhere: one of them; rows without words all stay
    got = kept((5, base, "a"), (5, base, "b"), (6, " ", "a"), (6, " ", "b"), (6, None, "c"), (None, "", "d"))
    assert len(got) == 5 and sum(t == base for _, t, _ in got) == 1


def test_a_large_group_costs_no_pairs_of_blocks(spark, monkeypatch):
    """Near copies beyond one block, a chain of edits, and strangers in the same list."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "SET_BYTES", 16_000)
    r = random.Random(8)
    base = prose(5, 120, 400)
    rows = [edited(base, r, 0.01) for _ in range(90)]
    for _ in range(40):
        rows.append(edited(rows[-1], r, 0.015))
    rows += [base + " " + prose(300 + k, 25, 400) for k in range(40)]
    rows = list(enumerate(rows))
    docs = documents(spark, [t for _, t in rows]).repartition(4)
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.components_of(docs, 3, 85).collect()), key=str)
    assert got == brute(rows, 3, 85)


def test_empty_table(spark):
    assert neardup.components_of(documents(spark, []), 3, 85).count() == 0
    assert neardup.keep_one(documents(spark, []), 3, 85).count() == 0


def test_matches_needed():
    for s in (0.8, 0.85):
        t = neardup.least_matches(s)
        assert 8 <= t < 32 * s
        assert (np.random.default_rng(1).binomial(32, s, 10**6) >= t).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(600, 900)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(250)] + [(5, 5)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {x["node"]: x["root"] for x in components.connected(df).collect()}
    assert got == {k: find(k) for k in root if k in got} and all(k in got for u, v in edges for k in (u, v) if u != v)
