import zlib

import corpus_pipeline
import numpy as np
from tests.llm.fixtures import prose
from tests.llm.test_decontaminate import words
from tests.llm.test_neardup import brute, edited
from tokenizers import Tokenizer

from spectrel.llm.queries_packing import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    import random

    r = random.Random(8)
    items = [prose(5000 + k, 30) for k in range(5)]
    rows, labels = [], []
    for i in range(400):
        t, good = prose(i, r.randint(30, 150), 300), r.random() < 0.8
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif i % 23 == 0:
            t = t + " " + items[i % 5] + " " + t[:40]
        elif i % 17 == 0:
            t += " write to jo.do@mail.example.com now"
        elif i % 11 == 0 and rows:
            t = edited(rows[r.randrange(len(rows))][1], r, 0.01)
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int("!!" not in t), 0))
    rows += [(400, None, "en", "s", None), (401, "", None, None, 0), (402, rows[5][1], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect()
        assert k == 4 or docs.columns == before.columns
    good = {i: r["text"] for i, r in kept["quality"].items()}
    wrong = [i for i, t, *_ in rows if t and ("!!" in t) == (i in good)]
    assert len(wrong) <= 6
    first = {i for i, _, c in brute([(i, t) for i, t in good.items()], 5, 80) if i == c}
    assert set(kept["near_duplicates"]) == first
    passages = {tuple(p[a : a + 10]) for p in map(words, items) for a in range(len(p) - 9)}
    hit = {i for i in first if any(tuple(words(good[i])[a : a + 10]) in passages for a in range(len(words(good[i]))))}
    assert len(hit) > 5 and set(kept["decontamination"]) == first - hit
    masked = kept["personal_data"]
    assert set(masked) == first - hit
    assert all((masked[i]["text"] or "") == (good[i] or "").replace("jo.do@mail.example.com", "<EMAIL>") for i in masked)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    total, at = {i: 0 for i in masked}, {}
    for r in kept["packing"]:
        ids = np.array([*tokenizer.encode(masked[r["doc_id"]]["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        total[r["doc_id"]] += r["length"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(total[i] == len(tokenizer.encode(masked[i]["text"] or "", add_special_tokens=False).ids) + 1 for i in masked)
    for parts in at.values():
        assert sum(n for _, n in parts) <= 4096 and all(a == sum(n for _, n in sorted(parts)[:k]) for k, (a, _) in enumerate(sorted(parts)))
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(kept["packing"])
