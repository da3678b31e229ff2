import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import EDGE_TEXTS, documents, prose

from spectrel.llm import pii


def brute(text):
    """The contract's patterns, as they are."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("0123456789.-+ ()@ab%_é", max_size=60), st.text("@.ab-", max_size=20), st.text("0123456789- ", max_size=50)))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_planted_texts():
    r = np.random.default_rng(2)
    for k in range(300):
        parts = [pii.made(r, pii.KINDS[r.integers(5)]) if r.random() < 0.5 else pii.look_alike(r) for _ in range(6)]
        text = [" ", ", ", ""][k % 3].join(parts)
        assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("9" * 20_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


@pytest.fixture(scope="module")
def model():
    return pii.train([prose(i, 200) for i in range(60)], steps=320)


def test_held_out_accuracy(model):
    x, y = pii.windows(np.random.default_rng(77), [prose(900 + i, 200) for i in range(60)], 600)
    tags = pii.viterbi(pii.emissions(model, x), pii.transitions(model))
    assert (tags == y).all(axis=0).mean() > 0.85


def test_bound_best_and_windows(model):
    r = np.random.default_rng(5)
    x = r.integers(0, pii.CLASSES, (60, 200))
    e, trans = pii.emissions(model, x) * 0.3, pii.transitions(model)
    tags = pii.viterbi(e, trans).astype(int)
    rows = np.arange(200)

    def score(path):
        before = np.vstack([np.zeros((1, 200), dtype=int), path[:-1]])
        return sum(e[s, path[s], rows] + trans[before[s], path[s]] for s in range(60))

    top, none = score(tags), score(np.zeros_like(tags))
    best = np.where(np.arange(pii.TAGS) == 0, 0.0, -1e4)[None].repeat(200, axis=0)  # by all transitions
    for s in range(60):
        best = (best[:, :, None] + trans[None]).max(axis=1) + e[s].T
    assert np.allclose(top, best.max(axis=1), atol=1e-2)
    assert (top - none <= np.maximum(pii.bound(e, trans), 0) + 1e-2).all()
    # a long text gives the spans of its parts, wherever the windows meet
    for shift in (0, 40, 150, 250, 290):
        text = prose(3, 400)[: 200 + shift] + " token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" " + prose(5, 300)
        spans = [text[s:e] for _, all_spans in pii.find([text], model) for s, e, k in all_spans if k == "secret"]
        assert spans == ['token = "0641917ea4e9feb9cda83477b57ac2654884f485"'], shift


def test_decoding_of_a_text_is_that_of_the_whole(model, monkeypatch):
    """Spans of stitched windows, with the bounds, are those of one Viterbi over all emissions of the text; batches change nothing."""
    r = np.random.default_rng(9)
    texts = [" ".join(prose(int(r.integers(99)), int(r.integers(1, 40))) + " " + (pii.made(r, pii.KINDS[r.integers(5)]) if r.random() < 0.4 else pii.look_alike(r)) for _ in range(int(r.integers(1, 30)))) for _ in range(40)]
    texts += ["token=" + "a1b2c3d4e5" * 120 + " end", "", "x"]
    for scale in (1.0, 0.3):  # the weaker, the more is open
        weak = pii.Model(model.inputs, model.recur, model.emit * scale, model.emit_bias * scale, model.trans, model.allowed, np.zeros(5))
        trans = pii.transitions(weak)
        got = pii.network_spans(weak, texts)
        for k, text in enumerate(texts):
            codes, whole = pii.classes(text), []
            for start, end, low, high in pii.windows_of(len(codes)) if text else []:
                whole.append(pii.emissions(weak, codes[start:end, None].astype(np.intp))[low - start : high - start])
            e = np.concatenate(whole) if whole else np.zeros((0, pii.TAGS, 1), dtype=np.float32)
            e = np.concatenate([e, np.where(np.arange(pii.TAGS) == 0, 0, -1e4).astype(np.float32)[None, :, None]])  # an O behind the text
            best = weighed(e, trans, pii.spans_of(pii.viterbi(e - e[:, :1], trans - trans[0, 0])[:, 0]))
            for found in (got[k], pii.network_spans(weak, [text])[0]):
                assert abs(weighed(e, trans, found) - best) < 1e-2  # of paths that score alike, any


def weighed(e, trans, spans):
    """The score of the tag sequence of these spans."""
    path = np.zeros(len(e) + 1, dtype=int)
    for a, b, kind in spans:
        path[a + 1 : b + 1] = 2 + 2 * pii.KINDS.index(kind)
        path[a + 1] -= 1
    return float(e[np.arange(len(e)), path[1:], 0].astype(np.float64).sum() + trans[path[:-1], path[1:]].astype(np.float64).sum())


def test_bounds_hold_for_every_kind_of_span():
    r = np.random.default_rng(4)
    b, i = r.normal(-1, 1, (12, 50)), r.normal(-0.3, 1, (12, 50))
    low, high = r.integers(0, 4, 50), r.integers(6, 13, 50)
    inner, tail, head, through = pii.bounds(b, i, low, high)
    for k in range(50):
        lo, hi = low[k], high[k]
        assert np.isclose(inner[k], max(b[s, k] + i[s + 1 : e, k].sum() for s in range(lo, hi) for e in range(s + 1, hi + 1)))
        assert np.isclose(tail[k], max(b[s, k] + i[s + 1 : hi, k].sum() for s in range(lo, hi)))
        assert np.isclose(head[k], max(i[lo:e, k].sum() for e in range(lo + 1, hi + 1)))
        assert np.isclose(through[k], i[lo:hi, k].sum())


def test_scan_and_redact(spark, model):
    secret = "password=f48865c76c86ee5394"
    texts = EDGE_TEXTS + [prose(7, 60) + " jo.do@mail.example.com, " + prose(8, 60) + " 10.0.0.1 " + secret + " +1 (663) 555-6869 4316522678525456", "é😀 jo@x.org"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in pii.scan(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = [tuple(s) for s in got[i]["base"]]
        assert base == brute(t or "")
        assert set(base) <= {tuple(s) for s in got[i]["spans"]}
        assert all(not (a < e and s < b) for s, e, _ in set(map(tuple, got[i]["spans"])) - set(base) for a, b, _ in base)
    clean = {r["doc_id"]: r for r in pii.redact(docs, model).collect()}
    last = len(texts) - 2
    assert clean[0]["text"] is None and clean[5]["text"] == "The" and clean[last + 1]["text"] == "é😀 <EMAIL>" and clean[last + 1]["n_chars"] == len("é😀 <EMAIL>")
    for part in ("jo.do", "10.0.0.1", "f48865c", "555-6869", "431652"):
        assert part not in clean[last]["text"]
    assert clean[last]["text"].startswith(prose(7, 60)) and pii.redact(docs, model).columns == docs.columns
    assert pii.scan(documents(spark, []), pii.fit(documents(spark, []))).count() == 0


def test_query_columns(spark, tmp_path):
    import hashlib

    from spectrel.llm.queries_pii import op1_pii

    text = "é +1 (663) 555-6869 a@b.co 10.0.0.1"
    documents(spark, [text, None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op1_pii(spark, str(tmp_path)).collect()}
    joined = ",".join(f"{k}:{s}:{e}" for s, e, k in brute(text))
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"], got[0]["n_phone"]) == (1, 1, 0, 1)
    assert got[0]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[0]["spans"] == joined
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def other_phones(n):
    """Made phones in spellings without a base pattern."""
    r = np.random.default_rng(31)
    made = (pii.made(r, "phone") for _ in range(10 * n))
    return [p for p in made if not pii.base_spans(p)][:n]


def test_phones_of_any_length_are_kept():
    phones = other_phones(1000)
    r = np.random.default_rng(32)
    for n in (11, 12, 13, 14, 15):
        digits = ["".join(map(str, r.integers(0, 10, n))) for _ in range(300)]
        phones += [f"({d[:3]}) {d[3:6]}-{d[6:]}" for d in digits]
    assert all(pii.plausible(p, "phone") for p in phones)
    card = "4316.5226.7852.5456"
    assert pii.plausible(card, "card") and not pii.plausible(card, "phone")


def test_made_phones_are_redacted(spark, model):
    phones = other_phones(400)
    texts = [f"{prose(2 * k, 30)} {p}, {prose(2 * k + 1, 30)}" for k, p in enumerate(phones)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts), model).collect()}
    assert sum(p not in clean[k] for k, p in enumerate(phones)) > 0.96 * len(phones)


def test_parts_outside_base_spans_are_kept(monkeypatch):
    def spans(text, *parts):
        found = [(text.index(p), text.index(p) + len(p), kind) for p, kind in parts]
        monkeypatch.setattr(pii, "network_spans", lambda model, texts: [found])
        base, whole = pii.find([text], None)[0]
        assert set(base) <= set(whole)
        return pii.masked(text, whole)

    assert spans("x token=Qx-4316522678525456-zzKd9 y", ("token=Qx-4316522678525456-zzKd9", "secret")) == "x <SECRET><CARD><SECRET> y"
    # not a secret as a whole, one part is
    assert spans("x jo@x.org token=Qx7zzKd9w y", ("jo@x.org token=Qx7zzKd9w", "secret")) == "x <EMAIL> <SECRET> y"
    assert spans("x jo@x.org and more y", ("jo@x.org and more", "secret")) == "x <EMAIL> and more y"
    assert spans("x jo@x.org, y", ("jo@x.org,", "email")) == "x <EMAIL>, y"
    # a card that the network takes for a phone
    assert spans("x 4316.522678.52545 y", ("4316.522678.52545", "phone")) in ("x <CARD> y", "x <PHONE> y")
