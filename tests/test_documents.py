import math
import random
import re

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from spectrel.operators import chunking
from spectrel.operators import documents as d
from spectrel.operators import events as e
from spectrel.operators import tabular as t


def one(spark, text, f, **more):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_tokens_and_language(spark):
    assert one(spark, "近红外 NIR-2 model v1.2!", d.estimated_tokens) == 3 + 1 + 1 + 1 + 1
    assert [one(spark, x, d.language) for x in ("近a", "近", "a", "12", "")] == ["zh-en", "zh", "en", "und", "und"]
    assert one(spark, "abcdefgh近红", d.character_tokens) == 3


def test_dois(spark):
    for raw, want in (("https://doi.org/10.1234/AbC).", "10.1234/abc"), ("doi: 10.1/x", "10.1/x"), ("", None), (None, None)):
        assert spark.createDataFrame([(raw,)], "t string").select(d.normal_doi(F.col("t"))).first()[0] == want
    assert one(spark, "doi: 10.1/x", d.valid_doi) is False and one(spark, "10.12345/a.b", d.valid_doi) is True
    assert one(spark, "see 10.1/x or <10.5555/Y-1>, ok", d.first_doi) == "10.5555/y-1"
    row = spark.createDataFrame([("c", None, "A  Title", ["Li", " "], 2020), ("c", None, "a title ", ["li"], 2020), ("c", "10.5555/z", "x", ["y"], 1), ("c", None, None, None, None)], "c string, doi string, t string, a array<string>, y int")
    ids = [r[0] for r in row.select(d.document_id(F.col("c"), F.col("doi"), F.col("t"), F.col("a"), F.col("y"))).collect()]
    assert ids[0] == ids[1] and ids[0].startswith("bib:") and ids[2] == "doi:10.5555/z" and ids[3].startswith("sha256:")


def naive(text, most, overlap=0):
    """Chunks with every count taken anew from the pieces themselves."""

    def packed(parts, glue):
        out, run = [], []
        for p in parts:
            if run and sum(map(chunking.tokens, run)) + chunking.tokens(p) > most:
                out.append(glue.join(run).strip())
                run = run[-max(1, len(run) * overlap // 100) :] if overlap and glue else []
            run.append(p)
        return out + ([glue.join(run).strip()] if run else [])

    parts = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        if chunking.tokens(paragraph) <= most:
            parts.append(paragraph)
            continue
        pieces = []
        for sentence in filter(None, (x.strip() for x in re.split(chunking.SENTENCE_END, paragraph))):
            at = [m.start() for m in re.finditer(chunking.TOKEN, sentence)]
            pieces += [sentence[x:y].strip() for x, y in zip([0, *at[most::most]], [*at[most::most], len(sentence)], strict=True)] if len(at) > most else [sentence]
        parts += packed(pieces, "")
    return packed(parts, "\n\n")


def test_chunks(spark):
    text = "# A\n\n" + "one two three.\n\n" * 5 + "## B\n\n" + "近红外" * 30 + "。尾 end\n\n" + "x " * 40
    odd = "a 3.14 b. c.d/e.f-g h! " * 9 + "\n \n" + "v1.2.3.4.5.6.7.8.9 " * 7 + "\n\n\n" + "w.x.y" * 30 + "  \n\n tail . . . 。。 x"
    for t in (text, odd, "", " \n\n ", "one"):
        for most, overlap in ((1, 0), (3, 0), (10, 0), (10, 50), (12, 20), (512, 0)):
            assert chunking.chunk_text(t, most, overlap) == naive(t, most, overlap)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    rows = chunking.chunks(df, "id", "t", 20, by_section=True).orderBy("id", "chunk_index").collect()
    assert {r["id"] for r in rows} == {1} and rows[0]["section_path"] == ["A"] and rows[-1]["section_path"] == ["A", "B"]
    assert rows[0]["content"].startswith("# A") and rows[0]["chunk_id"] == f"1#{chunking.VERSION}-0000" and all(r["tokens"] == chunking.tokens(r["content"]) for r in rows)
    assert rows[0]["previous_id"] is None and rows[0]["next_id"] == rows[1]["chunk_id"] and rows[1]["previous_id"] == rows[0]["chunk_id"] and rows[-1]["next_id"] is None
    assert [tuple(r) for r in d.outline(df, "id", "t").collect()] == [(1, 1, 1, "A"), (1, 13, 2, "B")]
    with pytest.raises(ValueError):
        chunking.chunks(df, "id", "t", strategy="lines")


def test_headings_take_the_place_of_their_level():
    assert [p for p, _ in chunking.sections("x\n### a\n## b\ny\n# c\n#### d\n## e")] == [[], ["a"], ["a", "b"], ["c"], ["c", "d"], ["c", "e"]]


def test_questions_and_pages(spark):
    english = "Q: What is SNV?\nA: Standard Normal Variate scatter correction.\n\nQ: What is PLS?\nA: Partial Least Squares regression."
    chinese = "问：什么是 SNV？\n答：标准正态变量散射校正。\n\n问：什么是 PLS？\n答：偏最小二乘回归。"
    paged = chunking.joined_pages(spark.createDataFrame([(9, 2, "two " * 8), (9, 5, None), (9, 7, "three"), (8, 1, "x")], "d int, p int, t string"), "d", "p", "t")
    texts = {r["d"]: r["t"] for r in paged.collect()}
    assert texts[8] == "<!-- page: 1 -->\n\nx" and texts[9].count("<!-- page: ") == 3
    df = spark.createDataFrame([(1, english), (2, chinese), (3, "Just a paragraph."), (4, texts[9]), (5, "<!-- Page:  7 -->")], "id int, t string")
    got = chunking.chunks(df, "id", "t", 40, strategy="questions").orderBy("id", "chunk_index").collect()
    assert [(r["id"], r["content"]) for r in got if r["id"] < 4] == [
        (1, "Q: What is SNV?\nA: Standard Normal Variate scatter correction."), (1, "Q: What is PLS?\nA: Partial Least Squares regression."),
        (2, "Q: 什么是 SNV？\nA: 标准正态变量散射校正。"), (2, "Q: 什么是 PLS？\nA: 偏最小二乘回归。"), (3, "Just a paragraph."),
    ]
    pages = [(r["page_start"], r["page_end"]) for r in got if r["id"] == 4]
    assert pages[0][0] == 1 and pages[-1][1] == 3 and not any("<!--" in r["content"] for r in got) and 5 not in {r["id"] for r in got}
    text = spark.createDataFrame([("ＳＮＶ２ 近 红\u3000外 x 近 y",), (None,)], "t string")
    assert [r["t"] for r in chunking.normalized(text, "t").collect()] == ["SNV2 近红外 x 近 y", None]


def test_html(spark):
    html = "<html><head><title> T &amp; x</title><style>p{}</style></head><body><p>a<b>b</b></p><script>no()</script><p>c &lt;d&gt;</p></body>"
    assert one(spark, html, d.html_text) == "ab\nc <d>" and one(spark, html, d.html_title) == "T &amp; x"


def test_answerability(spark):
    rows = [("a", "d1", 0.7), ("b", "d1", 0.5), ("c", "d1", 0.61), ("c", "d1", 0.605), ("d", "d1", 0.62), ("d", "d2", 0.59), ("e", "d1", 0.61), ("e", "d2", 0.6)]
    got = {r["q"]: (r["reason"], r["abstained"]) for r in d.answerability(spark.createDataFrame(rows, "q string, d string, s double"), "q", "d", "s").collect()}
    assert got == {"a": ("strong_score", False), "b": ("below_weak_score", True), "c": ("single_document_support", False), "d": ("document_margin", False), "e": ("ambiguous_across_documents", True)}


def test_typed_match(spark):
    values = {"t": '{"k": true}', "1": '{"k": 1}', "1.0": '{"k": 1.5}', "s": '{"k": "1"}', "n": '{"k": null}', "m": "{}", "bad": "{", None: None}
    df = spark.createDataFrame([(k, v) for k, v in values.items()], "n string, j string")
    for value, want in ((True, ["t"]), (1, ["1"]), (1.5, ["1.0"]), ("1", ["s"]), (None, ["n"])):
        assert [r["n"] for r in df.where(t.typed_match(F.col("j"), "k", value)).collect()] == want, value


def test_truncation_and_chain(spark):
    df = spark.createDataFrame([("aéé😀z", "trace"), ("aéé😀z", "message"), ("ab", "trace")], "c string, k string")
    for most, want in ((1, "a"), (2, "a"), (3, "aé"), (5, "aéé"), (8, "aéé"), (9, "aéé😀"), (99, "aéé😀z")):
        assert [r[0] for r in df.select(e.truncated(F.col("c"), F.col("k"), most)).collect()] == [want, "aéé😀z", "ab"[:most]]
    import hashlib

    rows, before = [], None
    for k in range(5):
        own = hashlib.sha256(f"{before or ''}|{k}".encode()).hexdigest()
        rows.append(("c", k, str(k), before, own))
        before = own
    rows[3] = ("c", 3, "changed", rows[3][3], rows[3][4])
    got = e.verify_chain(spark.createDataFrame(rows, "c string, n int, v string, previous_hash string, event_hash string"), "c", ["n"], ["v"]).orderBy("n").collect()
    assert [r["intact"] for r in got] == [True, True, True, False, True] and all(r["linked"] for r in got)


def test_names_and_calls(spark):
    assert t.rewrite_names("SELECT * FROM sales data JOIN sales ON 1", {"sales": "v1", "sales data": "v2"}) == "SELECT * FROM `v2` JOIN `v1` ON 1"
    calls, results = spark.createDataFrame([("a",), ("b",)], "call_id string"), spark.createDataFrame([("a", "done")], "call_id string, status string")
    assert {r["call_id"]: r["status"] for r in e.matched_calls(calls, results).collect()} == {"a": "done", "b": "pending"}


def test_built_chain_is_verified(spark):
    import hashlib

    events = spark.createDataFrame([(c, n, None if n == 4 else f"v{n}") for c in ("a", "b", None) for n in range(9)], "c string, n long, v string").repartition(5)
    rows = {(r["c"], r["n"]): r for r in e.build_chain(events, "c", ["n"], ["n", "v"]).collect()}
    for c in ("a", "b", None):
        before = None
        for n in range(9):
            assert rows[c, n]["previous_hash"] == before
            before = hashlib.sha256(f"{before or ''}|{n}|{'' if n == 4 else f'v{n}'}".encode()).hexdigest()
            assert rows[c, n]["event_hash"] == before

    def broken(change):
        kept = [r for k, r in rows.items() if not (k == ("a", 2) and change == "gone")]
        df = spark.createDataFrame([(r["c"], r["n"], "other" if change == "value" and (r["c"], r["n"]) == ("a", 2) else r["v"], r["previous_hash"], r["event_hash"]) for r in kept], "c string, n long, v string, previous_hash string, event_hash string")
        got = e.verify_chain(df, "c", ["n"], ["n", "v"]).collect()
        return [[(r["c"], r["n"]) for r in got if not r[what]] for what in ("linked", "intact")]

    assert broken(None) == [[], []] and broken("value") == [[], [("a", 2)]] and broken("gone") == [[("a", 3)], []]


def test_hash_chain_counts_its_own_checks(spark, monkeypatch):
    from spectrel.plans import knowledge

    build = e.build_chain
    change = F.when(F.col("event_id") % 10 == 3, "changed").otherwise(F.col("event_type"))
    monkeypatch.setattr(e, "build_chain", lambda *a: build(*a).withColumn("event_type", change))
    r = knowledge.hash_chain(spark, "/root/testdata/sf0.001").first()
    assert (r["n"], r["linked"], r["intact"]) == (1000, 1000, 900)
    monkeypatch.setattr(e, "build_chain", lambda *a: build(*a).where("event_id % 10 != 3"))
    r = knowledge.hash_chain(spark, "/root/testdata/sf0.001").first()
    assert r["n"] == 900 and r["linked"] < 900 and r["intact"] == 900


def test_holders_of_any_part_of_a_passage(spark):
    words = [f"w{k}" for k in range(30)]
    items = [(1, " ".join(words)), (2, "Only Three, words"), (3, None), (4, ""), (5, "...")]
    docs = [(1, " ".join(words)), (2, "x " + ", ".join(words[20:]).upper() + " y"), (3, " ".join(words[21:])), (4, "a only three words b"), (5, "only three"), (6, None), (7, ""), (8, " ".join(words[5:14] + ["x"] + words[14:23]))]
    got = d.holders(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "q long, t string"), "q", "t")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (2, 4)]
    none = spark.createDataFrame(items[2:], "q long, t string")
    assert d.holders(spark.createDataFrame(docs, "d long, t string"), "d", "t", none, "q", "t").count() == 0


def test_chunks_of_few_texts_at_once(spark):
    texts = ["a" * 300_000] * 10 + [None, "", "b" * (chunking.PART_BYTES + 5), "c"]
    batch = pa.RecordBatch.from_pydict({"d": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    parts = list(chunking._parts([batch, batch.slice(0, 0)], 1))
    assert [r for p in parts for r in p.column(1).to_pylist()] == texts
    assert len(parts) == 6 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= chunking.PART_BYTES for p in parts)
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string").repartition(1)
    assert {r["d"] for r in chunking.chunks(df, "d", "t", 64).select("d").collect()} == set(range(len(texts))) - {10, 11}


def test_verbatim_holders(spark):
    words = [f"W{k}é" for k in range(12)]
    items = [(1, "«" + ", ".join(words) + "!"), (2, "Only Three, words."), (3, None), (4, "")]
    docs = [(1, "x (" + ", ".join(words[1:11]) + ") y"), (2, ", ".join(words).lower()), (3, " ".join(words)), (4, "a Only Three, words b"), (5, "only three, words"), (6, None)]
    got = d.holders(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "q long, t string"), "q", "t", verbatim=True)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 4)]


def test_retrieval_report_sees_later_parts(spark, tmp_path):
    from spectrel.plans import knowledge

    words = [f"w{k}" for k in range(30)]
    spark.createDataFrame([(1, " ".join(words[15:])), (2, "none of it")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    report = knowledge.retrieval_report(spark, str(tmp_path))
    assert [tuple(r) for r in report.collect()] == [(1, 1.0, 1.0, 1.0)]
    assert "NestedLoopJoin" not in d.holders(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") if t in ("documents", "benchmark") else t for t in ("documents", "doc_id", "text", "benchmark", "item_id", "text")))._jdf.queryExecution().toString()


def test_token_estimate_of_every_language(spark, tmp_path):
    import re

    from spectrel.plans import knowledge

    texts = [("en", "NIR-2 v1.2, ok!"), ("zh", "近红外 spectra 与 PLS。"), ("ja", "近くの スペクトル"), ("ru", "Привет, мир"), ("ar", "مرحبا x"), (None, "no lang é1"), ("fr", "déjà vu 😀"), ("de", None), ("it", "")]
    spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["tokens"] for r in knowledge.token_estimate_all(spark, str(tmp_path)).collect()}
    assert got == {k: len(re.findall(r"[\u3400-\u9fff]|[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[^\s]", t or "")) for k, (_, t) in enumerate(texts)}


def test_bm25_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(1, 40))) for _ in range(60)] + [None, "", "w1 w1 w1", "W1 w1 w1", "zzz"]
    asked = ["w1 w2 w1", "w3", "nothing", None, "", "w1 w4 w5 w6", "zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "q long, text string")
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in enumerate(texts)}
    n, mean = len(texts), sum(map(len, words.values())) / (len(texts) - 1)  # a null text has no length
    want = {}
    for q, t in enumerate(asked):
        scores = {}
        for term in set((t or "").split()):
            df = sum(term in w for w in words.values())
            for i, w in words.items():
                if tf := w.count(term):
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        for rank, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:6], start=1):
            want[q, i] = (rank, scores[i])
    for block in (1000, 2):
        got = {(x["q"], x["id"]): (x["rank"], x["score"]) for x in d.bm25(docs.repartition(3), "id", "text", queries, "q", "text", block=block).collect()}
        assert got.keys() == want.keys()
        assert all(got[key][0] == want[key][0] and math.isclose(got[key][1], want[key][1]) for key in want)
    assert d.bm25(docs.limit(0), "id", "text", queries, "q", "text").count() == d.bm25(docs, "id", "text", queries.limit(0), "q", "text").count() == 0
