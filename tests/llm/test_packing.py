import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import EDGE_TEXTS, documents, prose
from tokenizers import Tokenizer

from spectrel.llm import packing
from spectrel.llm.queries_packing import tokenizer_path

ENCODER = packing.Encoder(tokenizer_path())


def test_pieces_and_places(spark):
    texts = EDGE_TEXTS + [prose(i, 5 * i) for i in range(60)] + ["<|endoftext|> it's a\u00a0b\u2003c\u0301 ΣΑΣ Σ\r\nx", "a \ue000 b\ue000 \ue001 \uf8ff \u3000 c", " \ue000", "  "]
    docs = documents(spark, texts)
    rows = packing.pack_digests(docs.union(docs.limit(9)), tokenizer_path(), size=256).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    seen = Counter()
    sequences = defaultdict(list)
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = Counter(r["doc_id"] for r in docs.union(docs.limit(9)).collect())
    assert seen == {i: len(v) * copies[i] for i, v in ids.items()}
    filled = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        filled += at
    assert filled >= 0.9 * 256 * (len(sequences) - 1)


def test_ids_are_kept_by_the_general_form(spark):
    row = packing.pack_documents(documents(spark, ["hello world"]), tokenizer_path()).first()
    assert np.frombuffer(bytes(row["ids"]), dtype="<u4")[-1] == 2 and row["offset"] == 0
    assert packing.pack_documents(documents(spark, []), tokenizer_path()).count() == 0


def test_patterns_hold_every_piece_and_fill_well():
    r = random.Random(3)
    for size, histogram in ((64, {1: 1_000_000}), (4096, Counter(min(4096, int(r.expovariate(1 / 900)) + 1) for _ in range(50_000))), (10, {7: 3, 3: 5, 10: 2})):
        found = packing.patterns(histogram, size)
        placed = Counter()
        for lengths, count in found:
            assert sum(lengths) <= size
            for n in lengths:
                placed[n] += count
        assert placed == Counter(histogram)
        total = sum(k * v for k, v in histogram.items())
        assert total >= 0.7 * size * sum(c for _, c in found)


def test_ranks_of_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    rows = spark.range(300).selectExpr("id AS doc_id", "0L AS start", "id % 3 AS length", "1L AS ids_key")
    got = defaultdict(list)
    for r in packing.ranked(rows, 100).collect():
        got[r["length"]].append(r["rank"])
    assert all(sorted(v) == list(range(100)) for v in got.values()) and len(got) == 3


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAbS's'tT12 $%éÉ\u00d7\u0130\u0131\u023f\u0250<|>.\n\té\u0301\u0338=\u212bΣς\u00a0\ue000"), st.characters(codec="utf-8")), max_size=30), max_size=4), st.sampled_from(["", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>'s1"]))
def test_ids_equal_the_tokenizers(texts, special):
    texts = [t + special + t[::-1] for t in texts]
    ids, n = ENCODER.encode([t.encode() for t in texts], 2)
    want = [[*ENCODER.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_met_long_ago_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    encoder = packing.Encoder(tokenizer_path())
    for k in range(30):
        text = prose(k, 60, 400) + " always"
        ids, _ = encoder.encode([text.encode()], 2)
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert len(encoder.hashes) < 150
