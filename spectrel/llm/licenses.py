"""License scan by a positional index of rare tokens.

The templates below are indexed by word: each word's (template, position) postings. Words weigh log((documents + 2) / (df + 1)),
df counted over all documents. Of a scanned text, the licence words of highest weight (rare tokens) are looked up first. Which
words are rare is not a fixed number: of each template they hold more weight than a score of `least` may lack, so nothing that
reaches `least` is without one of them. Around each rare token of a template with m words, every window of m words and STRAY more
that holds the template's mandatory key phrase, word by word, is intersected with all postings of the template: the heaviest chain of
words that stand in both, in the same order, whatever lies between them. Its weight over the template's whole weight is the score. A
label stands if the score of some window reaches `least`.

The base phrases are looked for by a plain comparison at each occurrence of their first word. Null text is empty: no words, no
labels, score 0. Repeated rows each give a row.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm import common

#: Fixed by the contract: phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label, mandatory key phrase, text of the notice; all as words in lower case. The key phrase is a run of the notice.
TEMPLATES = (
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    ("agpl-3.0", "gnu affero general public license", "licensed under the gnu affero general public license version 3"),
    ("mit", "the mit license", "released under the mit license"),
    ("mit", "mit license", "this work is available under the terms of the mit license"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("cc-by-4.0", "creative commons attribution 4 0 international", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-4.0", "creative commons attribution 4 0 international", "creative commons attribution 4 0 international public license"),
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0 january 2004"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3.0", "either version 3 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "either version 2 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's weight that must stand in the text.
LEAST = 0.6
#: Words besides the template's own that its stretch of a text may hold, as a share of its words, and at least.
STRAY, LEAST_STRAY = 0.5, 8


class Index:
    """Postings and weights of the templates' words."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, df: dict[str, int] | None = None, documents: int = 0, least: float = LEAST):
        self.templates = [(label, key.encode().split(), text.encode().split()) for label, key, text in templates]
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        vocabulary = {w for _, _, text in self.templates for w in text}
        df = df or {}
        self.weight = {w: math.log((documents + 2) / (df.get(w.decode(), 0) + 1)) for w in vocabulary}
        self.total = [sum(self.weight[w] for w in text) for _, _, text in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rare: set[tuple[int, int]] = set()
        for t, (_, _, text) in enumerate(self.templates):
            for q, w in enumerate(text):
                self.postings[w].append((t, q))
            held = 0.0
            for q in sorted(range(len(text)), key=lambda q: (-self.weight[text[q]], q)):
                self.rare.add((t, q))
                held += self.weight[text[q]]
                if held > (1 - least) * self.total[t] * (1 + 1e-9):
                    break
        self.places: list[dict[bytes, list[int]]] = [defaultdict(list) for _ in self.templates]
        for t, (_, _, text) in enumerate(self.templates):
            for q in range(len(text) - 1, -1, -1):
                self.places[t][text[q]].append(q)
        self.first = defaultdict(list)
        for p, label in self.phrases:
            self.first[p[0]].append((p, label))
        #: Words that can begin a match: the rare tokens and the first words of the phrases.
        self.keys = {self.templates[t][2][q] for t, q in self.rare} | set(self.first)

    def stray(self, t: int) -> int:
        return max(LEAST_STRAY, int(STRAY * len(self.templates[t][2])))

    def chain(self, words: list[bytes], t: int) -> float:
        """The share of the template's weight in the heaviest chain of words that stand in the template in the same order."""
        heaviest = [0.0] * (len(self.templates[t][2]) + 1)  # a tree of best chains by the place in the template where they end
        best = 0.0
        for w in words:
            for q in self.places[t].get(w, ()):  # from the last, so that a word takes one place only
                found, k = 0.0, q
                while k > 0:
                    found = max(found, heaviest[k])
                    k -= k & -k
                found, k = found + self.weight[w], q + 1
                best = max(best, found)
                while k < len(heaviest):
                    heaviest[k] = max(heaviest[k], found)
                    k += k & -k
        return best / self.total[t] if self.total[t] > 0 else 0.0

    def _reached(self, words: list[bytes], stretches: list[list[int]], t: int, least: float):
        """The largest windows of m words and the strays, m the template's length, in which the template's words have weight enough and its
        key phrase stands."""
        key, size = self.templates[t][1], len(self.templates[t][2]) + self.stray(t)
        merged: list[list[int]] = []
        for low, high in stretches:
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        places, often = self.places[t], {w: len(q) for w, q in self.places[t].items()}
        for low, high in merged:
            here = [p for p in range(low, high) if words[p] in places]
            keys = [k for k in here if words[k] == key[0] and words[k : k + len(key)] == key]
            held: dict[bytes, int] = defaultdict(int)
            weight, a, last = 0.0, 0, -1
            for b, p in enumerate(here):
                held[words[p]] += 1
                if held[words[p]] <= often[words[p]]:
                    weight += self.weight[words[p]]
                while here[a] <= p - size:
                    held[words[here[a]]] -= 1
                    if held[words[here[a]]] < often[words[here[a]]]:
                        weight -= self.weight[words[here[a]]]
                    a += 1
                # a window is looked at when the next word would push its first out, or none is left
                full = b + 1 == len(here) or here[a] <= here[b + 1] - size
                if full and a > last and weight >= least * self.total[t] * (1 - 1e-9) and any(here[a] <= k and k + len(key) - 1 <= p for k in keys):
                    last = a
                    yield here[a], p + 1

    def scan(self, words: list[bytes], least: float = LEAST) -> tuple[int, list[int], set[str], set[str], float]:
        """(number of words, starts of base phrases, base labels, labels of templates, best score)."""
        found = [i for i, w in enumerate(words) if w in self.keys] if not self.keys.isdisjoint(words) else []
        starts, base, labels, best = [], set(), set(), 0.0
        near: dict[int, list[list[int]]] = defaultdict(list)
        for i in found:
            w = words[i]
            for p, label in self.first.get(w, ()):
                if words[i : i + len(p)] == p:
                    starts.append(i)
                    base.add(label)
            for t in {t for t, q in self.postings.get(w, ()) if (t, q) in self.rare}:
                room = len(self.templates[t][2]) + self.stray(t)
                near[t].append([max(0, i - room + 1), min(len(words), i + room)])
        for t, stretches in sorted(near.items()):
            for low, high in self._reached(words, stretches, t, least):
                if (score := self.chain(words[low:high], t)) >= least:
                    labels.add(self.templates[t][0])
                    best = max(best, score)
        return len(words), starts, base, labels, 1.0 if best > 0.999999 else best


def frequencies(documents: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many of all documents each template word stands (a row for each such word, a few dozen), and the number of documents."""
    vocabulary = {w.encode() for _, _, text in templates for w in text.split()}
    shape = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts: dict[bytes, int] = defaultdict(int)
        rows = 0
        for batch in batches:
            for t in batch.column(0):
                rows += 1
                for w in vocabulary.intersection(common.alnum_words(t.as_py())):
                    counts[w] += 1
        names = [w.decode() for w in counts]
        yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array([*counts.values(), rows], pa.int64())], schema=shape)

    found = {r["word"]: r["n"] for r in documents.select(common.octets("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: n for w, n in found.items() if w is not None}, found.get(None, 0)


def scan(documents: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: float = LEAST) -> DataFrame:
    """Per document: doc_id, n_words, starts (word positions of base phrases), base_labels and labels (sorted arrays), score."""
    df, n = frequencies(documents, templates)
    shape = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])

    def run(batches):
        index = Index(templates, phrases, df, n, least)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words, starts, base, labels, score = index.scan(common.alnum_words(t.as_py()), least)
                rows.append((words, starts, sorted(base), sorted(base | labels), score))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(shape)[1:], strict=True))], schema=shape)

    out = "doc_id long, n_words long, starts array<long>, base_labels array<string>, labels array<string>, score double"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.octets("text")).mapInArrow(run, out)
