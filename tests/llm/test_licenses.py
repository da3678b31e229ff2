import random
import re

from tests.llm.fixtures import EDGE_TEXTS, documents, prose
from tests.llm.test_decontaminate import words

from spectrel.llm import licenses


def test_base_equals_brute_force_and_labels_add(spark):
    notice = ["Licensed under the Apache License, Version 2.0.", "MIT License.", "licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    texts = EDGE_TEXTS + notice + [prose(4, 60) + " " + n + " " + prose(5, 60) for n in notice] + ["gnu general public license " * 3, "the license of mit, not apache", "cc by cc by", prose(6, 9) + " version 2.0 of the license"]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        starts, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r["n_words"], sorted(r["starts"]), r["base_labels"]) == (len(w), sorted(starts), sorted(labels)), text
        assert labels <= set(r["labels"]) and 0 <= r["score"] <= 1
    at = len(EDGE_TEXTS)
    for k, label in enumerate(("apache-2.0", "mit", "gpl-3.0", "cc-by-nc-4.0")):
        assert label in got[at + 4 + k]["labels"]
    assert got[len(texts) - 1]["labels"] == [] and got[len(texts) - 3]["labels"] == []
    assert licenses.scan(documents(spark, [])).count() == 0


def test_key_phrases_are_runs_of_their_notices():
    for _, key, text in licenses.TEMPLATES:
        assert re.search(rf"(^| ){key}( |$)", text)


NOTICES = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3.0",
    "Apache License\nVersion 2.0, January 2004": "apache-2.0",
    "Creative Commons Attribution 4.0 International Public License": "cc-by-4.0",
    "Released under the two-clause BSD license.": "bsd",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "This work is licensed, as a whole, under a Creative Commons Attribution 4.0 International licence": "cc-by-4.0",
}


def test_notices_with_gaps_and_changes(spark):
    texts = [prose(2 * k, 80) + " " + notice + " " + prose(2 * k + 1, 80) for k, notice in enumerate(NOTICES)]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    for k, label in enumerate(NOTICES.values()):
        assert label in got[k]["labels"] and got[k]["score"] >= licenses.LEAST, texts[k]


def test_rare_tokens_miss_no_alignment():
    """Every template with words replaced at random: what all words as starting points find, the rare ones find."""
    r = random.Random(5)
    df = {w: r.choice([0, 3, 50, 900]) for _, _, text in licenses.TEMPLATES for w in text.split()}
    index, whole = (licenses.Index(df=df, documents=1000, least=least) for least in (licenses.LEAST, -1.0))
    assert all((t, q) in whole.rare for t, (_, _, text) in enumerate(whole.templates) for q in range(len(text)))
    found = 0
    for n in range(300):
        _, _, text = index.templates[n % len(index.templates)]
        words = [b"before"] * 9 + [w if r.random() > 0.25 else b"other" for w in text] + [b"after"] * 9
        a, b = index.scan(words), whole.scan(words)
        assert a[3] == b[3] and a[4] == b[4]
        found += bool(a[3])
    assert found > 50


def brute_labels(index, words, least):
    """Labels and score from a longest common subsequence over every window."""
    labels, best = set(), 0.0
    for t, (label, key, text) in enumerate(index.templates):
        size = len(text) + max(licenses.LEAST_STRAY, int(licenses.STRAY * len(text)))
        for s in range(max(1, len(words) - size + 1)):
            w = words[s : s + size]
            if not any(w[k : k + len(key)] == key for k in range(len(w) - len(key) + 1)):
                continue
            row = [0.0] * (len(text) + 1)
            for x in w:
                new = row[:]
                for j, y in enumerate(text):
                    new[j + 1] = max(new[j], row[j + 1], row[j] + index.weight[y] if x == y else 0.0)
                row = new
            share = row[-1] / index.total[t]
            if share >= least - 1e-12:
                labels.add(label)
                best = max(best, share)
    return labels, best


def changed(text, r):
    """A notice without its head or tail, with words put in, taken out or replaced."""
    words = list(text)
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(words))
        kind = r.randrange(4)
        if kind == 0:
            words[k:k] = [b"other"] * r.randint(1, 12)
        elif kind == 1:
            del words[k : k + r.randint(1, 6)]
        elif kind == 2:
            n = r.randint(1, 8)
            words[k : k + n] = [b"some"] * n
        else:
            words = words[r.randint(0, 6) :]
        words = words or [b"none"]
    return words


def test_labels_and_score_equal_brute_force():
    r = random.Random(9)
    df = {w: r.choice([0, 3, 50, 400]) for _, _, text in licenses.TEMPLATES for w in text.split()}
    index = licenses.Index(df=df, documents=1000)
    common_words = [w for w in index.weight if df[w.decode()] >= 50]
    labelled = 0
    for n in range(120):
        text = index.templates[n % len(index.templates)][2]
        words = [r.choice(common_words) for _ in range(r.randint(0, 30))] + changed(text, r) + [r.choice(common_words) for _ in range(r.randint(0, 30))]
        if n % 5 == 0:
            words += changed(index.templates[(n * 7) % len(index.templates)][2], r)
        got, want = index.scan(words), brute_labels(index, words, licenses.LEAST)
        assert got[3] == want[0] and abs(got[4] - want[1]) < 1e-9, words
        labelled += bool(want[0])
    assert labelled > 50


def test_heads_may_lack_and_words_may_stand_between():
    index = licenses.Index()
    gpl = index.templates[19][2]
    for words in (gpl[4:], gpl[8:], gpl[:12] + [b"x"] * 4 + gpl[12:], gpl[:10] + [b"y"] * 8 + gpl[18:], gpl[:20] + [b"z"] * 15 + gpl[20:]):
        assert "gpl-3.0" in index.scan(words)[3]
    assert index.scan(gpl[:20])[3].isdisjoint({"gpl-3.0"})
