"""Document jobs: token estimates, chunking, identity, language, keyword and vector retrieval, answerability."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.operators.chunking import TOKEN

#: Scores above which an answer is strong or weak, the margin between documents, and results of one document.
STRONG, WEAK, MARGIN, PER_DOCUMENT = 0.63, 0.60, 0.02, 2


def estimated_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def character_tokens(text: Column) -> Column:
    """A quarter of the other characters and half of the CJK ones."""
    cjk = F.regexp_count(text, F.lit(r"[㐀-鿿]"))
    return F.floor((F.length(text) - cjk) / 4 + cjk / 2).cast("int")


def language(text: Column) -> Column:
    cjk, latin = text.rlike(r"[㐀-鿿]"), text.rlike("[A-Za-z]")
    return F.when(cjk & latin, "zh-en").when(cjk, "zh").when(latin, "en").otherwise("und")


def normal_doi(doi: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    out = F.lower(F.regexp_replace(bare, r"[.,;)\]}]+$", ""))
    return F.when(out != "", out)


def valid_doi(doi: Column) -> Column:
    return F.coalesce(normal_doi(doi).rlike(r"^10\.\d{4,9}/\S+$"), F.lit(False))


def first_doi(text: Column) -> Column:
    """The first valid DOI in a text."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(10\.\d{4,9}/[^\s<>\"']+)"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(found, normal_doi), lambda d: d.rlike(r"^10\.\d{4,9}/\S+$")), F.lit(1))


def document_id(content: Column, doi: Column, title: Column, authors: Column, year: Column) -> Column:
    """doi:..., else bib:... of title, authors and year, else sha256:... of the content."""
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    people = F.transform(F.filter(authors, lambda a: F.trim(a) != ""), plain)
    bibliography = F.to_json(F.struct(plain(title).alias("t"), people.alias("a"), year.cast("int").alias("y")))
    complete = (F.coalesce(plain(title), F.lit("")) != "") & (F.coalesce(F.size(people), F.lit(0)) > 0) & year.isNotNull()
    return F.when(valid_doi(doi), F.concat(F.lit("doi:"), normal_doi(doi))).when(complete, F.concat(F.lit("bib:"), F.sha2(bibliography, 256))).otherwise(F.concat(F.lit("sha256:"), F.sha2(content, 256)))


def html_text(html: Column) -> Column:
    """Readable text: scripts, styles and comments go, blocks end lines, tags go, the common entities are read, blanks are squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|nav|footer|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|blockquote)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def outline(documents: DataFrame, id_: str, text: str) -> DataFrame:
    """Markdown headings: id, line (from 1), level, title."""
    lines = documents.select(id_, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    return lines.where(F.col("content").rlike(r"^#{1,6}\s+\S")).select(id_, (F.col("line") + 1).alias("line"), F.length(F.regexp_extract("content", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("content", r"^#+\s+(.*?)\s*#*$", 1)).alias("title"))


def grep(documents: DataFrame, id_: str, text: str, pattern: str, literal: bool = False, case_sensitive: bool = True) -> DataFrame:
    """Lines that match: id, line (from 1), content."""
    regex = (("" if case_sensitive else "(?i)") + (f"\\Q{pattern}\\E" if literal else pattern))
    return documents.select(id_, F.posexplode(F.split(text, "\n")).alias("line", "content")).where(F.col("content").rlike(regex)).withColumn("line", F.col("line") + 1)


# --- retrieval --------------------------------------------------------------------------------------------------------------------


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+|[À-ɏ]+)"), F.lit(1))


def bm25(documents: DataFrame, id_: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int = 6, k1: float = 1.5, b: float = 0.75, block: int = 1000, block_terms: int = 2_000_000) -> DataFrame:
    """Top k documents of each query: query_id, id, score, rank. Documents without a term of the query are no results.

    A first pass counts in how many documents each asked term stands. Queries then go to the tasks in blocks of at most about `block`
    queries and `block_terms` terms; each task scores its documents where they are read and keeps its own best k of each query."""
    asked = queries.select(query_id, F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term"))
    words = documents.select(id_, terms(F.col(text)).alias("words"))
    n, mean_length = words.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    held = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(held, "term").select(query_id, "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).cache()
    many, most = weighted.agg(F.count_distinct(query_id), F.count(F.lit(1))).first()
    blocks = max(1, -(-many // block), -(-most // block_terms))
    item_kind, query_kind = documents.schema[id_].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    out = None
    for part in range(blocks):
        rows = (weighted if blocks == 1 else weighted.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == part)).collect()
        found = words.mapInArrow(_scored(documents.sparkSession.sparkContext.broadcast(_postings(rows)), mean_length or 1.0, k, k1, b), f"q {query_kind}, i {item_kind}, score double")
        out = found if out is None else out.unionByName(found)
    weighted.unpersist()
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "i"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("i").alias(id_), "score", "rank")


def _postings(rows: list) -> tuple:
    """Queries; the place of each term; where a term's queries begin, and these as places; weights of terms."""
    names = list(dict.fromkeys(r[0] for r in rows))
    place, at = {q: k for k, q in enumerate(names)}, {}
    weights = {r["term"]: r["idf"] for r in rows}
    for term in weights:
        at[term] = len(at)
    order = sorted((at[r["term"]], place[r[0]]) for r in rows)
    own = np.array([q for _, q in order], dtype=np.int64)
    return names, at, np.searchsorted([t for t, _ in order], np.arange(len(at) + 1)), own, np.array(list(weights.values()))


def _scored(shared, mean_length: float, k: int, k1: float, b: float):
    """Arrow batches of (id, words) to the k best of each query in the task: q, i, score."""

    def score(words: pa.ListArray) -> np.ndarray:
        names, at, begin, own, idf = shared.value
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        coded = words.flatten().dictionary_encode()
        known = np.array([at.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        term = known[coded.indices.to_numpy()] if len(known) else known
        row = np.repeat(np.arange(len(words)), lengths)
        pairs, tf = np.unique((row * max(1, len(at)) + term)[term >= 0], return_counts=True)
        row, term = pairs // max(1, len(at)), pairs % max(1, len(at))
        s = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / mean_length))
        n = begin[term + 1] - begin[term]
        each = np.repeat(begin[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(np.repeat(row, n) * len(names) + own[each], weights=np.repeat(s, n), minlength=len(words) * len(names)).reshape(len(words), len(names))

    def run(batches):
        names = shared.value[0]
        best: list[list] = [[] for _ in names]
        least = np.zeros(len(names))
        for batch in batches if names else ():
            for a in range(0, batch.num_rows, 1000):
                ids, s = batch.column(0).slice(a, 1000).to_pylist(), score(batch.column(1).slice(a, 1000))
                rounded = np.round(s, 9)
                floor = np.maximum(least, np.partition(rounded, -k, axis=0)[-k]) if len(ids) >= k else least
                row, column = np.nonzero((s > 0) & (rounded >= floor))
                for j, r in zip(column.tolist(), row.tolist(), strict=True):
                    best[j].append((-rounded[r, j], ids[r] is not None, ids[r], s[r, j]))
                for j in np.unique(column).tolist():
                    best[j] = sorted(best[j], key=lambda x: x[:3])[:k]
                    least[j] = -best[j][-1][0] if len(best[j]) == k else 0
        rows = [(names[j], i, float(s)) for j, found in enumerate(best) for _, _, i, s in found]
        if rows:
            q, i, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["q", "i", "score"])

    return run


def nearest(items: DataFrame, id_: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int = 20, block: int = 1000) -> DataFrame:
    """The k items of largest cosine for each query: query_id, id, score, rank. Queries come in blocks of a checked size; each task keeps
    its own best k, so that k rows for each query and task meet."""
    total = queries.count()
    item_kind, query_kind = items.schema[id_].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    source = items.select(id_, F.col(vector).cast("array<double>").alias("v"))
    out = None
    for n in range(max(1, -(-total // block))):
        part = queries.select(query_id, F.col(query_vector).cast("array<double>").alias("v"))
        if total > block:
            part = part.where(F.pmod(F.xxhash64(query_id), F.lit(-(-total // block))) == n)
        rows = part.collect()
        q = np.array([r["v"] for r in rows], dtype=np.float64)
        shared = items.sparkSession.sparkContext.broadcast(([r[query_id] for r in rows], q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(rows) else q))

        def run(batches, shared=shared):
            names, q = shared.value
            best: list[tuple[np.ndarray, list]] = []
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                s = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 9)
                ids = np.array(batch.column(0).to_pylist())
                for j in range(len(names)):
                    top = np.lexsort((ids, -s[j]))[:k]
                    if len(best) <= j:
                        best.append((s[j][top], ids[top].tolist()))
                    else:
                        both, named = np.concatenate([best[j][0], s[j][top]]), best[j][1] + ids[top].tolist()
                        keep = sorted(range(len(both)), key=lambda i: (-both[i], named[i]))[:k]
                        best[j] = (both[keep], [named[i] for i in keep])
            rows = [(names[j], i, float(s)) for j, (ss, ids) in enumerate(best) for s, i in zip(ss, ids, strict=True)]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["q", "i", "score"])

        found = source.mapInArrow(run, f"q {query_kind}, i {item_kind}, score double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "i"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("i").alias(id_), "score", "rank")


def answerability(candidates: DataFrame, query: str, document: str, score: str, strong: float = STRONG, weak: float = WEAK, margin: float = MARGIN) -> DataFrame:
    """Per query: top_score, runner_up (best score of another document), reason, abstained."""
    best = candidates.groupBy(query, document).agg(F.max(score).alias("s"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("s"), document)))
    top = placed.groupBy(query).agg(F.max(F.when(F.col("place") == 1, F.col("s"))).alias("top_score"), F.max(F.when(F.col("place") == 2, F.col("s"))).alias("runner_up"))
    reason = (
        F.when(F.col("top_score") >= strong, "strong_score").when(F.col("top_score") < weak, "below_weak_score").when(F.col("runner_up").isNull(), "single_document_support")
        .when(F.col("top_score") - F.col("runner_up") >= margin, "document_margin").otherwise("ambiguous_across_documents")
    )
    return top.withColumn("reason", reason).withColumn("abstained", F.col("reason").isin("below_weak_score", "ambiguous_across_documents"))


def diversified(candidates: DataFrame, query: str, document: str, score: str, tie: str, k: int = 5, per_document: int = PER_DOCUMENT) -> DataFrame:
    """At most per_document candidates of each document, then the top k."""
    order = [F.desc(score), tie]
    capped = candidates.withColumn("__n", F.row_number().over(Window.partitionBy(query, document).orderBy(*order))).where(F.col("__n") <= per_document).drop("__n")
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def holders(documents: DataFrame, id_: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = 10, verbatim: bool = False) -> DataFrame:
    """item, id of the documents that hold `window` consecutive words of an item (all words of a shorter one), whatever the case and what
    stands between words; verbatim: with the same case and the same between them. Windows meet by the MD5 of their words in an equality
    join. Items without words have no holders."""
    word = r"[\p{L}\p{N}]+"

    def cut(df, key, column, lengths):
        """key and the digests of the runs of words of each of the lengths."""
        source = F.col(column) if verbatim else F.lower(column)
        words = df.select(F.col(key), F.regexp_extract_all(source, F.lit(word), F.lit(0)).alias("w"), F.regexp_extract_all(source, F.lit(word + r"[^\p{L}\p{N}]*"), F.lit(0)).alias("v"))
        joined = (lambda i, m: F.concat(F.array_join(F.slice("v", i, m - 1), ""), F.get("w", i + m - 2))) if verbatim else lambda i, m: F.array_join(F.slice("w", i, m), " ")
        for_each = lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.unhex(F.md5(joined(i, m))))
        runs = [F.when(F.size("w") >= m, for_each(m)).otherwise(F.array().cast("array<binary>")) for m in lengths]
        return words, runs

    words, _ = cut(items, item_id, item_text, [])
    size = F.least(F.size("w"), F.lit(window))
    lengths = sorted(r[0] for r in words.where("size(w) > 0").select(size).distinct().collect())  # at most `window` of them
    if not lengths:
        return items.select(F.col(item_id)).limit(0).crossJoin(documents.select(id_).limit(0))
    _, runs = cut(items, item_id, item_text, lengths)
    own = F.array().cast("array<binary>")
    for m, run in zip(lengths, runs, strict=True):
        own = F.when(size == m, run).otherwise(own)
    asked = words.where("size(w) > 0").select(item_id, F.explode(own).alias("run")).distinct()
    words, runs = cut(documents, id_, text, lengths)
    held = words.select(id_, F.explode(F.concat(*runs)).alias("run"))
    return held.join(asked, "run").select(item_id, id_).distinct()


def retrieval_scores(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int = 5) -> DataFrame:
    """Per query with relevant items: recall, reciprocal_rank, ndcg. ranked: query, item, rank."""
    wanted = relevant.select(query, item).distinct()
    hits = ranked.where(F.col("rank") <= k).join(wanted.withColumn("hit", F.lit(1)), [query, item], "left")
    by = hits.groupBy(query).agg(F.count_distinct(F.when(F.col("hit") == 1, F.col(item))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.count(F.lit(1)).alias("shown"))
    n = wanted.groupBy(query).agg(F.count(F.lit(1)).alias("wanted")).join(by, query, "left").na.fill(0, ["found", "shown"])
    ideal = F.when(F.least("wanted", "shown") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("wanted", "shown"), F.lit(1))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))).otherwise(0.0)
    return n.select(query, (F.col("found") / F.col("wanted")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.try_divide("dcg", ideal), F.lit(0.0)).alias("ndcg"))
