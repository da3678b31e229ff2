import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tests.llm.fixtures import EDGE_TEXTS, documents, prose

from spectrel.llm import common, lm


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def brute(train, texts, order):
    """The model by its definition, with dictionaries."""
    pairs, triples, count = Counter(), Counter(), Counter()
    for t in train:
        seq = ["<s>", *words(t), "</s> "]
        pairs.update(zip(seq, seq[1:]))
        triples.update(zip(seq, seq[1:], seq[2:]))
        count.update(seq[1:])
    if order == 3:
        pairs = Counter({p: c for p, c in pairs.items() if p[0] == "<s>"}) + Counter((u, w) for _, u, w in triples)
    before = Counter(w for _, w in pairs)
    follow, context = defaultdict(list), Counter()
    for (u, _), c in pairs.items():
        follow[u].append(c)
        context[u] += c
    coc = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    d, e = lm.discounts(coc(pairs.values())), lm.discounts(coc(before.values()))
    of = lambda c, d: d[min(c, 3) - 1] if c else 0
    k, v, n = sum(before.values()), len(count), sum(count.values())
    gamma = sum(of(c, e) for c in before.values()) / k if k else 1.0

    def word(w):
        return max(before[w] - of(before[w], e), 0) / max(k, 1) + gamma / (v + 1)

    after = defaultdict(list)
    for (s, u, _), c in triples.items():
        after[s, u].append(c)
    f = lm.discounts(coc(triples.values()))

    def triple(s, u, w):
        if s is None or order == 2 or not after[s, u]:
            return pair(u, w)
        c = triples[s, u, w]
        return (max(c - of(c, f), 0) + sum(of(x, f) for x in after[s, u]) * pair(u, w)) / sum(after[s, u])

    def pair(u, w):
        if not context[u]:
            return word(w)
        c = pairs[u, w]
        return (max(c - of(c, d), 0) + sum(of(x, d) for x in follow[u]) * word(w)) / context[u]

    out = []
    for t in texts:
        seq = ["<s>", *words(t), "</s> "]
        out.append((len(seq) - 1, sum(count[w] > 0 for w in seq[1:]), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq[1:]), sum(math.log10(triple(s, u, w)) for s, u, w in zip([None, *seq], seq, seq[1:]))))
    if k:
        known = [*count, "never seen"]
        for u in ["<s>", *list(count)[:5], "never seen"]:
            assert math.isclose(sum(pair(u, w) for w in known), 1, rel_tol=1e-9)
        for s, u in list(after)[:5]:
            assert math.isclose(sum(triple(s, u, w) for w in known), 1, rel_tol=1e-9)
    return out


@pytest.mark.parametrize("shards, order", [(1, 3), (5, 3), (40, 3), (5, 2)])
def test_equals_brute_force(spark, monkeypatch, shards, order):
    monkeypatch.setattr(lm, "RUN_BYTES", 3000)
    texts = EDGE_TEXTS + [prose(i, 7 * i, 60) for i in range(40)] + ["the " * 500, "\x1c\x85  x \x0b y"] * 2
    docs = documents(spark, texts)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    from spectrel.llm.queries_lm import held_out

    model = lm.train(docs.where(~held_out()), common.new_folder(spark, "lm-test"), shards, order)
    got = {r["doc_id"]: tuple(r)[1:6] for r in lm.score(docs, model).collect()}
    for i, want in enumerate(brute(train, texts, order)):
        assert got[i][:3] == want[:3]
        assert math.isclose(got[i][3], want[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[i][4], want[4], rel_tol=1e-9, abs_tol=1e-9), (i, got[i], want)
    assert sum(g[4] for g in got.values()) > sum(g[3] for g in got.values())


def test_nothing_to_learn_from(spark):
    model = lm.train(documents(spark, []), common.new_folder(spark, "lm-test"), 3)
    got = [tuple(r) for r in lm.score(documents(spark, ["a b", None]), model).collect()]
    assert [(r[1], r[2], r[3]) for r in got] == [(3, 0, 0), (1, 0, 0)] and all(abs(r[4]) < 1e-9 and abs(r[5]) < 1e-9 for r in got)


def test_word_hashes(spark):
    texts = [b"", b"A b", b"  b a\x0bb", b"x" * 200_000, "é É".encode(), b"ab", b"a b"]
    hashes, counts = common.byte_word_hashes(texts, common.BLANKS)
    flat = [w for t in texts for w in common.blank_words(t)]
    assert counts.tolist() == [len(common.blank_words(t)) for t in texts] and len(flat) == len(hashes)
    seen = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_blobs_of_nothing():
    import numpy as np

    none = np.zeros(0, dtype=np.int64)
    assert lm.blobs(none, none.astype(np.uint64), none).num_rows == 0
