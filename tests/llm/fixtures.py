import random

DOC_SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, sequence_id string, part int"


def documents(spark, texts, start=0):
    """A documents table with columns that clash with names the operators use."""
    rows = [(t, start + i if not isinstance(t, tuple) else t[1], "en", "s", len(t) if t else 0, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def prose(seed, words, vocabulary=200):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ß"]
    names = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(words))


EDGE_TEXTS = [None, "", " ", "\n\t", "a", "The", "é ß \u4e2d\u6587 😀", "x" * 70_000, prose(1, 30_000), prose(2, 50), prose(2, 50), "same same same " * 40]
