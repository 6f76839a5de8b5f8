"""Excerpts of texts around a query's words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms_of, tokenize


def _wordish(b: int) -> bool:
    return b >= 0x80 or chr(b).isalnum()


def snippet(text: str, terms: list[str], size: int = 200, marks: tuple[str, str] = ("[", "]")) -> str:
    """The window of at most ``size`` bytes with the most distinct terms, then the most words that match, then the earliest. Words that
    match are marked without their outer punctuation; where none does, the text's beginning. Its first word always fits."""
    raw = text.encode("utf-8", "surrogatepass")
    place = {t: i for i, t in reversed(list(enumerate(terms)))}
    words = []  # begin, end, index of the lowest matching term or None
    for _, at, token in tokenize(text):
        hits = [place[t] for _, t in terms_of(token) if t in place]
        words.append((at, at + len(token.encode("utf-8", "surrogatepass")), min(hits) if hits else None))
    if not words:
        return ""
    counts: dict[int, int] = {}
    best, window, j, total = (0, 0), (0, 0), 0, 0
    for i, (begin, end, hit) in enumerate(words):
        if j < i:
            j = i
        while j < len(words) and words[j][1] - begin <= size:
            if words[j][2] is not None:
                counts[words[j][2]] = counts.get(words[j][2], 0) + 1
                total += 1
            j += 1
        if (len(counts), total) > best:
            best, window = (len(counts), total), (i, max(i, j - 1))
        if j > i and hit is not None:
            total -= 1
            counts[hit] -= 1
            if not counts[hit]:
                del counts[hit]
    if best == (0, 0):
        last = 0
        while last + 1 < len(words) and words[last + 1][1] - words[0][0] <= size:
            last += 1
        window = (0, last)
    out, at = (b"..." if words[window[0]][0] > 0 else b""), words[window[0]][0]
    for begin, end, hit in words[window[0] : window[1] + 1]:
        out += raw[at:begin]
        a, b = begin, end
        while a < b and not _wordish(raw[a]):
            a += 1
        while b > a and not _wordish(raw[b - 1]):
            b -= 1
        if hit is not None and a < b:
            out += raw[begin:a] + marks[0].encode() + raw[a:b] + marks[1].encode() + raw[b:end]
        else:
            out += raw[begin:end]
        at = end
    if at < len(raw):
        out += b"..."
    return out.decode("utf-8", "replace")


def with_snippets(results: DataFrame, corpus: DataFrame, terms: list[str], size: int = 160) -> DataFrame:
    """Results with the excerpt of each document's title and body, null where the corpus lacks it. Only the results' texts are read
    through the join, and each excerpt is made where its row is."""
    texts = corpus.select("doc_id", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("_text"))
    joined = results.join(texts, "doc_id", "left")
    keep = results.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if t is None else snippet(t, terms, size) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(done, pa.string())], names=[*keep, "snippet"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema)
    return joined.select(*keep, "_text").mapInArrow(run, f"{fields}, snippet string")
