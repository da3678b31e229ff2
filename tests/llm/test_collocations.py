import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spectrel.llm import collocations
from tests.llm.fixtures import EDGE_TEXTS, prose

SCHEMA = "text string, lang string, k int, phrase string, n long, score string, node string"


def table(spark, rows):
    return spark.createDataFrame([(t, g, 7, "x", 7, "x", "x") for t, g in rows], SCHEMA)


def brute(rows, least, longest=5, percent=100, top=2000):
    counts, words = defaultdict(Counter), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i:j] for p, b in c.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and p[i:j] in c and 100 * b >= percent * c[p[i:j]]}
        scored = []
        for p in c.keys() - covered:
            score, cut = min((1000 * c[p] * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -c[p], " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


PASSAGE = "one two three four five six seven eight nine ten one two three eleven"
ROWS = (
    [(t, "en") for t in EDGE_TEXTS]
    + [(prose(s, 120, 12), lang) for s in range(12) for lang in ("en", "fr", None)]
    + [(f"{prose(s, 5, 12)} {PASSAGE} {prose(s, 5, 12)}", "de") for s in range(9)]
    + [(PASSAGE.upper(), "de"), (PASSAGE, "de"), ("x\x01y \x02\x03 \x02 x\x01y \x02\x03, A\tB. a b; a b! a b? A b\n" * 3, ""), ("é ß É ß é ß" * 4, "und")]
)


@pytest.mark.parametrize("least,longest,percent,top", [(5, 5, 100, 2000), (3, 5, 70, 9), (2, 3, 100, 2000), (4, 2, 100, 50)])
def test_equals_brute_force(spark, least, longest, percent, top):
    got = collocations.mine(table(spark, ROWS), least, longest, percent, top).collect()
    assert sorted(tuple(r) for r in got) == brute(ROWS, least, longest, percent, top)


def test_paths_hold_all_edges_once(spark):
    found = collocations.graph(table(spark, ROWS), 5)
    edges = {(r["lang"], r["phrase"]): r["n"] for r in found.where("k = 5").collect()}
    paths = collocations.compacted(found).collect()
    spelled = [((r["lang"], " ".join(r["words"][i : i + 5])), r["n"]) for r in paths for i in range(r["edges"])]
    assert len(spelled) == len(edges) and dict(spelled) == edges
    longest = max((r for r in paths if r["lang"] == "de"), key=lambda r: r["edges"])
    assert longest["edges"] >= 8 and "five six seven eight nine" in " ".join(longest["words"])


def test_bits_over_several_files(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILE_BITS", 17)
    keys = np.random.default_rng(5).integers(0, 1 << 64, 4000, dtype=np.uint64)
    counted = spark.createDataFrame([(int(k), 9) for k in keys.view(np.int64)], "key long, n long")
    bits = collocations.Bits(*collocations._frequent(counted, 9, "test"))
    assert bits.has(keys).all() and int(keys[7]) in bits
    other = np.random.default_rng(6).integers(0, 1 << 64, 4000, dtype=np.uint64)
    assert bits.has(other).mean() < 0.1


def test_rank_in_parts_and_wide_products(spark):
    rows = [("en", f"p{i:03} q", 100 + i % 7, 10**9, 10**9, 10**15, (i * 37) % 11) for i in range(300)]
    got = collocations.ranked(spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long"), top=40, parts=5).orderBy("rank").collect()
    assert [r["phrase"] for r in got] == [r[1] for r in sorted(rows, key=lambda r: (-r[6], -r[2], r[1]))[:40]]
    known = spark.createDataFrame([("en", 1, "a", 4 * 10**14), ("en", 1, "b", 5 * 10**14), ("en", 2, "a b", 3 * 10**14)], "lang string, k int, phrase string, n long")
    one = collocations.scored(known, spark.createDataFrame([("en", 9 * 10**17)], "lang string, n long")).first()
    assert one["score"] == 1000 * 3 * 10**14 * 9 * 10**17 // (4 * 10**14 * 5 * 10**14)


def test_empty_table(spark):
    assert collocations.mine(table(spark, [])).count() == 0
    assert collocations.mine(table(spark, [(None, None), ("", "en"), ("..", "fr")]), 1).count() == 0


def test_tallies_are_passed_on_packed(spark):
    r = np.random.default_rng(4)
    keys = r.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2)
    common_ones = keys[:300]
    rows = []
    for part in (keys, common_ones, np.concatenate([common_ones, common_ones[:50]])):
        held = collocations._Tally()
        assert not list(held.add(part))
        rows += [(p, bytes(c)) for b in held.rows() for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    k, n = collocations._unpacked(collocations._packed(np.array([0, 7, 2**28 - 1], dtype=np.uint32), np.array([1, 300, 70_000])))
    assert k.tolist() == [0, 7, 2**28 - 1] and n.tolist() == [1, 300, 70_000]
    counted = spark.createDataFrame(rows, "part int, counts binary")
    for least, want in ((3, common_ones), (4, common_ones[:50])):
        got = {x["key"] for x in collocations._often(counted, least).collect()}
        assert got == {int(x) for x in (want >> np.uint64(24) << np.uint64(24)).view(np.int64)}


def test_the_graph_holds_frequent_edges_alone(spark):
    texts = ["a b c d e"] * 3 + [f"a b c d x{k}" for k in range(50)]
    found = {(x["k"], x["phrase"]): x["n"] for x in collocations.graph(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), 3).collect()}
    assert found[5, "a b c d e"] == 3 and found[4, "a b c d"] == 50
    assert not [p for k, p in found if k == 5 and p != "a b c d e"]


def test_maps_let_few_other_keys_pass(spark):
    keys = np.random.default_rng(7).integers(0, 1 << 64, 1 << 16, dtype=np.uint64)
    frame = spark.createDataFrame([(int(k), 9) for k in keys.view(np.int64)], "key long, n long")
    bits = collocations.Bits(*collocations._frequent(frame, 9, "test"))
    assert bits.has(keys).all()
    assert bits.has(np.random.default_rng(8).integers(0, 1 << 64, 400_000, dtype=np.uint64)).mean() < 0.002
    assert bits.has(keys[:0]).tolist() == []


def test_phrases_are_spelled_once_not_by_each_task(spark, monkeypatch):
    made, whole = [], collocations.spelled

    def watched(docs, totals, longest=5):
        out = whole(docs, totals, longest)
        made.append(out.count())
        return out

    monkeypatch.setattr(collocations, "spelled", watched)
    texts = [f"{PASSAGE} {prose(s, 30, 12)}" for s in range(60)]
    found = collocations.graph(table(spark, [(t, "en") for t in texts] + [("", "en"), (None, None)]).repartition(12), 5)
    assert made == [found.count()] and found.where("k > 0").count() > 50


def test_totals_hold_large_counts_and_the_least_owner(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 1000)
    r = np.random.default_rng(9)
    keys = r.integers(0, 1 << 64, 700, dtype=np.uint64)
    keys[1] = keys[0] ^ np.uint64(1)
    rows, want = [], {}
    for _ in range(3):
        held = collocations._Totals()
        for _ in range(4):
            some = keys[r.integers(0, 700, 900)]
            counts, owners = r.integers(1, 1 << 40, 900), r.integers(0, 1 << 32, 900)
            for k, n, o in zip(some.view(np.int64).tolist(), counts.tolist(), owners.tolist(), strict=True):
                was = want.get(k, (0, o))
                want[k] = (was[0] + n, min(was[1], o))
            rows += list(held.add(some, counts, owners))
        rows += list(held.rows())
    rows = [(p, bytes(c)) for b in rows for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    got = collocations._totals(spark.createDataFrame(rows, "part int, counts binary")).collect()
    assert {x["key"]: (x["n"], x["owner"]) for x in got} == want and len(got) == len(want)
