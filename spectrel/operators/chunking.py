"""Documents in chunks of at most so many tokens, by paragraphs, by Markdown sections or by questions and answers.

Each text is read for tokens once; what a span holds is then a difference of two places in the list of token starts. Neighbouring
chunks' ids come from the same loop over a document, so nothing is shuffled. A document is one row, whatever its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as one token, where a sentence ends, page marks, questions with their answers, and the version in chunk ids.
TOKEN = r"[㐀-鿿]|[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[^\s]"
SENTENCE_END = r"(?<=[。！？!?；;.])\s*"
PAGE_MARKER = r"(?i)<!--\s*page:\s*(\d+)\s*-->"
QUESTION_ANSWER = r"(?:^|\n)\s*(?:Q[:：]|问[:：])\s*(.+?)\s*\n\s*(?:A[:：]|答[:：])\s*(.+?)(?=\n\s*(?:Q[:：]|问[:：])|$)"
VERSION = "cjk-section-v2"

_TOKEN, _PAGE = re.compile(TOKEN), re.compile(PAGE_MARKER)
_PAIR = re.compile(QUESTION_ANSWER, re.DOTALL)


def tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


class _Body:
    """A text with its token places."""

    def __init__(self, text: str):
        self.text = text
        places = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in places], [b for _, b in places]

    def count(self, a: int, b: int) -> int:
        """Tokens of text[a:b] on its own; a cut through a token makes pieces that count as they stand."""
        first, last = bisect_left(self.starts, a), bisect_right(self.ends, b)
        if last < first:  # all inside one token
            return tokens(self.text[a:b])
        n = last - first
        if first and self.ends[first - 1] > a:
            n += tokens(self.text[a : self.ends[first - 1]])
        if last < len(self.starts) and self.starts[last] < b:
            n += tokens(self.text[self.starts[last] : b])
        return n

    def stripped(self, a: int, b: int) -> tuple[int, int]:
        while a < b and self.text[a].isspace():
            a += 1
        while b > a and self.text[b - 1].isspace():
            b -= 1
        return a, b

    def split(self, pattern: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The spans between the matches in a to b, without white space around them, empty ones left out."""
        at = a
        for m in re.compile(pattern).finditer(self.text, a, b):
            if m.start() > a:  # nothing stands before the first place
                span = self.stripped(at, m.start())
                if span[0] < span[1]:
                    yield span
            at = m.end()
        span = self.stripped(at, b)
        if span[0] < span[1]:
            yield span

    def pieces(self, a: int, b: int, most: int) -> Iterator[tuple[str, int]]:
        """A span in pieces of `most` tokens, with their counts."""
        if (n := self.count(a, b)) <= most:
            yield self.text[a:b], n
            return
        first, last = bisect_left(self.starts, a), bisect_right(self.ends, b)
        whole = (not first or self.ends[first - 1] <= a) and (last == len(self.starts) or self.starts[last] >= b)
        at = self.starts[first:last] if whole else [a + m.start() for m in _TOKEN.finditer(self.text[a:b])]
        cuts = [a, *at[most::most], b]
        for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if piece := self.text[low:high].strip():
                yield piece, min(most, n - i * most)


def _runs(parts, most: int, overlap: int = 0) -> Iterator[list[str]]:
    """Parts (text, tokens) in runs of at most `most` tokens; a run begins with the last `overlap` percent of the run before."""
    run: list[tuple[str, int]] = []
    size = 0
    for part in parts:
        if run and size + part[1] > most:
            yield [t for t, _ in run]
            run = run[-max(1, len(run) * overlap // 100) :] if overlap else []
            size = sum(n for _, n in run)
        run.append(part)
        size += part[1]
    if run:
        yield [t for t, _ in run]


def chunk_text(text: str, most: int = 512, overlap: int = 0) -> list[str]:
    """Paragraphs packed to `most` tokens; a longer paragraph goes by sentences, a longer sentence by tokens."""
    if most < 1:
        raise ValueError("a chunk holds one token at least")
    body = _Body(text)

    def parts():
        for a, b in body.split(r"\n\s*\n", 0, len(text)):
            if (n := body.count(a, b)) <= most:
                yield text[a:b], n
            else:
                for run in _runs((p for s in body.split(SENTENCE_END, a, b) for p in body.pieces(*s, most)), most):
                    whole = "".join(run).strip()
                    yield whole, tokens(whole)

    return ["\n\n".join(run) for run in _runs(parts(), most, max(0, min(overlap, 50)))]


def sections(text: str) -> list[tuple[list[str], str]]:
    """(heading path, section with its heading line) of a Markdown text. A heading takes the place of its level in the path; levels that
    were left out are not filled."""
    out: list[tuple[list[str], list[str]]] = [([], [])]
    path: list[str] = []
    for line in text.splitlines():
        if m := re.match(r"(#{1,6})\s+(.+?)\s*$", line):
            path = [*path[: len(m[1]) - 1], m[2].strip()]
            out.append((path, []))
        out[-1][1].append(line)
    return [(p, s) for p, lines in out if (s := "\n".join(lines).strip())]


def pairs(text: str) -> list[str]:
    """Each question with its answer; none where there are no such."""
    return [f"Q: {q.strip()}\nA: {a.strip()}" for q, a in _PAIR.findall(text)]


STRATEGIES = ("paragraphs", "sections", "questions")
#: Bytes of text whose chunks a task holds at once, about; one longer text alone.
PART_BYTES = 1 << 20


def chunked(text: str, most: int = 512, overlap: int = 0, strategy: str = "paragraphs") -> list[dict]:
    """section_path, content (without page marks), page_start, page_end (of the marks in it, else None) and tokens of each chunk."""
    if strategy == "sections":
        parts = [(path, c) for path, body in sections(text) for c in chunk_text(body, most)]
    elif strategy == "questions" and (found := pairs(text)):
        parts = [([], c) for pair in found for c in chunk_text(pair, most)]
    else:
        parts = [([], c) for c in chunk_text(text, most, overlap if strategy == "paragraphs" else 0)]
    out = []
    for path, raw in parts:
        pages = [int(p) for p in _PAGE.findall(raw)] if "<!--" in raw else []
        content = _PAGE.sub("", raw).strip() if pages else raw.strip()
        if content:
            out.append({"section_path": path, "content": content, "page_start": min(pages, default=None), "page_end": max(pages, default=None), "tokens": tokens(content)})
    return out


def _parts(batches, at: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows whose texts (column `at`) have PART_BYTES together, or one longer text."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(at)), 0), pa.int64())).to_pylist()
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, bisect_right(ends, (ends[a - 1] if a else 0) + PART_BYTES))
            yield batch.slice(a, b - a)
            a = b


def chunks(documents: DataFrame, id_: str, text: str, most: int = 512, overlap: int = 0, by_section: bool = False, strategy: str | None = None, version: str = VERSION) -> DataFrame:
    """Per chunk: id, chunk_index, section_path, content, tokens, page_start, page_end, chunk_id (id#version-index), previous_id, next_id.

    strategy: paragraphs (with `overlap` percent of a chunk's parts once more in the next), sections or questions (paragraphs where a text
    has none). Null and blank texts have no chunks; rows that share an id are chunked each on its own."""
    strategy = strategy or ("sections" if by_section else "paragraphs")
    if strategy not in STRATEGIES or most < 1:
        raise ValueError(f"strategy is one of {STRATEGIES}, most 1 or more")
    kind = documents.schema[id_].dataType
    own = [("chunk_index", pa.int32()), ("section_path", pa.list_(pa.string())), ("content", pa.string()), ("tokens", pa.int32()), ("page_start", pa.int64()), ("page_end", pa.int64()), ("chunk_id", pa.string()), ("previous_id", pa.string()), ("next_id", pa.string())]

    def run(batches):
        for batch in _parts(batches, 2):
            at, rows = [], {name: [] for name, _ in own}
            names = pc.fill_null(pc.cast(batch.column(1), pa.string()), "").to_pylist()
            for k, t in enumerate(batch.column(2).to_pylist()):
                found = chunked(t or "", most, overlap, strategy)
                ids = [f"{names[k]}#{version}-{i:04d}" for i in range(len(found))]
                at += [k] * len(found)
                rows["chunk_index"] += range(len(found))
                for name in ("section_path", "content", "tokens", "page_start", "page_end"):
                    rows[name] += [c[name] for c in found]
                rows["chunk_id"] += ids
                rows["previous_id"] += [None, *ids[:-1]] if ids else []
                rows["next_id"] += [*ids[1:], None] if ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(rows[name], t) for name, t in own)], names=[id_, *rows])

    shape = T.StructType([T.StructField(id_, kind), T.StructField("chunk_index", T.IntegerType()), T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("content", T.StringType()), T.StructField("tokens", T.IntegerType()), T.StructField("page_start", T.LongType()), T.StructField("page_end", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("chunk_id", "previous_id", "next_id"))])
    return documents.select(F.col(id_), F.col(id_).cast("string").alias("__name"), F.col(text)).mapInArrow(run, shape)


# --- pages of extracted text ------------------------------------------------------------------------------------------------------


def normalized(documents: DataFrame, text: str) -> DataFrame:
    """The text in compatibility form (full-width letters and digits as plain ones), without white space between two CJK characters."""
    at, schema = documents.columns.index(text), documents.schema

    def run(batches):
        for batch in batches:
            columns = batch.columns
            columns[at] = pc.utf8_normalize(columns[at], form="NFKC")
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    cjk = r"[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]"
    return documents.mapInArrow(run, schema).withColumn(text, F.regexp_replace(text, rf"(?U)(?<={cjk})\s+(?={cjk})", ""))


def joined_pages(pages: DataFrame, id_: str, page: str, text: str) -> DataFrame:
    """One text for each document, its pages in order behind page marks that count from 1. A document's text is one value."""
    marked: Column = F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x, i: F.concat(F.lit("<!-- page: "), (i + 1).cast("string"), F.lit(" -->\n\n"), x["t"]))
    return pages.groupBy(id_).agg(F.array_join(marked, "\n\n").alias(text))
