import hashlib

from tests.llm.fixtures import DOC_SCHEMA, EDGE_TEXTS, documents, prose

from spectrel.llm import fingerprints


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (fingerprints.fingerprint(x) for x in (text, edited, following))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    texts = EDGE_TEXTS + [prose(i, 40 + i) for i in range(50)]
    rows = [(3 * i % 97, t) for i, t in enumerate(texts)] + [(5, "twin a" * 9), (5, "twin b" * 9), (None, prose(77, 60)), (None, prose(78, 60)), (-4, prose(70, 90))]
    docs = spark.createDataFrame([(t, i, "en", "s", 0, "x", 7) for i, t in rows], DOC_SCHEMA).repartition(3)
    for parts in (1, 5, 40):
        assert sorted(map(tuple, fingerprints.with_next(docs, parts).collect()), key=str) == brute(rows)
    one = documents(spark, ["alone " * 20])
    assert list(map(tuple, fingerprints.with_next(one, 4).collect())) == brute([(0, "alone " * 20)])
    assert fingerprints.with_next(documents(spark, []), 4).count() == 0


def test_syncmers_by_definition_and_likeness():
    text = prose(3, 80)
    _, at = fingerprints.syncmers(text)
    k, s = fingerprints.K, fingerprints.S
    smers = {}
    for i in range(len(text) - s + 1):
        smers.setdefault(text[i : i + s], len(smers))
    # context-free: the same k-mer is chosen wherever it stands
    chosen = {text[i : i + k] for i in at}
    moved = "zzz " + text + prose(9, 5)
    assert chosen <= {moved[i : i + k] for i in fingerprints.syncmers(moved)[1]} | set()
    assert 0.05 < len(at) / len(text) < 0.5
    long = prose(5, 3000, 2000)
    f = fingerprints.fingerprint(long)
    assert fingerprints.likeness(f, fingerprints.fingerprint(long + " end")) > 0.9
    assert fingerprints.likeness(f, fingerprints.fingerprint(prose(6, 3000, 2000))) < 0.2
    assert fingerprints.likeness("", "") == 1 and fingerprints.likeness(f, "") == 0


def test_anchors_grow_with_the_text():
    import numpy as np

    r = np.random.default_rng(4)
    text, other, passage = ("".join(map(chr, r.integers(97, 123, n))) for n in (300_000, 300_000, 3000))
    f = fingerprints.fingerprint(text)
    h, at = fingerprints.syncmers(text)
    small = {int(x) >> 32 for x in h if int(x) >> 32 < fingerprints.SHARE}
    assert {int(f[i : i + 8], 16) for i in range(0, len(f), 16)} == small and len(small) > 5000
    for a in (0, 90_000, 200_000, 297_000):  # a rewritten passage is seen wherever it stands
        changed = fingerprints.fingerprint(text[:a] + passage + text[a + 3000 :])
        assert changed != f and 0.97 < fingerprints.likeness(f, changed) < 1
    shared = other[:50_000] + text[70_000:73_000] + other[53_000:]
    assert 0 < fingerprints.likeness(f, fingerprints.fingerprint(shared)) < 0.02
    # a short text is compared over the range of hashes that both hold in full
    short = fingerprints.fingerprint(text[:200])
    assert len(short) < 16 * fingerprints.ANCHORS and 0 <= fingerprints.likeness(short, f) < 0.01
