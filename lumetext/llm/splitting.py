"""Problem 10: texts over a size limit cut into pieces under it, at natural boundaries, neighbours overlapping.

Method: dynamic programming over boundary positions. A cut costs by its boundary (paragraph, line, sentence, clause, word, inside a
word) and by how far the piece is from an even size; the cheapest sequence of cuts that keeps every piece under the limit is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from .tokens import TOKENIZERS, library_encoding

#: Penalties of a cut by the kind of boundary, and the weight of an uneven size.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD_GAP, INSIDE = 0.0, 0.3, 1.0, 4.0, 10.0, 60.0
UNEVEN = 4.0

#: Rows of targets in piece_limits at most: the bound of what is broadcast.
MOST_SOURCES = 100_000

# All boundaries lie where a word of the tokenizer begins and none that ends could go on, so a piece's tokens are exactly those of its
# part of the text: before white space that follows something else, or between a closing mark of a script without blanks and a letter.
_BLANK = " \\t\\n\\r\\f\\v\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NATURAL = re.compile(rf"""[.!?…]["'»”’)\]]*(?=[{_BLANK}])|\n[{_BLANK}]*|[。！？｡](?=[^\W_])""")
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_BLANK}]", c))
_GAP = re.compile(rf"(?<=[^{_BLANK}])(?=[{_BLANK}])|(?<=[。！？｡、，；：])(?=[^\W_])")
_CLAUSE = ",;:、，；：)]–—"

#: Words whose token counts a worker keeps.
KEPT_WORDS = 300_000


class Splitter:
    def __init__(self, path: str) -> None:
        self.encode = library_encoding(path).encode_ordinary
        self.sizes: dict[str, int] = {}

    def size(self, word: str) -> int:
        n = self.sizes.get(word)
        if n is None:
            n = len(self.encode(word))
            if len(word) <= 40:
                if len(self.sizes) > KEPT_WORDS:
                    self.sizes.clear()
                self.sizes[word] = n
        return n

    def boundaries(self, text: str, most: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets from 0 to the text's length, tokens before each, penalty of a cut at each. Sentence ends and better are always
        there; a stretch of over half a piece between two of them has the gaps between words too, and a word that is so long cuts
        inside it. Nothing for a text of ``most`` tokens at most."""
        at, cost = [0], [0.0]
        for m in _NATURAL.finditer(text):
            i, j = m.span()
            if text[i] == "\n":
                kind = PARAGRAPH if text.count("\n", i, j) > 1 else LINE
                while i and text[i - 1] in _BLANKS:
                    i -= 1
                if i == at[-1]:
                    cost[-1] = kind
                elif i > at[-1]:
                    at.append(i)
                    cost.append(kind)
            else:
                at.append(j)
                cost.append(SENTENCE)
        if at[-1] != len(text):
            at.append(len(text))
            cost.append(0.0)
        size = [len(self.encode(text[i:j])) for i, j in zip(at, at[1:])]
        if sum(size) <= most:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        if max(size) * 2 > room:
            fine_at, fine_cost, fine_size = [0], [0.0], []
            for k, n in enumerate(size):
                if n * 2 > room:
                    for i, c, m in self.gaps(text, at[k], at[k + 1], room):
                        fine_at.append(i)
                        fine_cost.append(c)
                        fine_size.append(m)
                    fine_cost[-1] = cost[k + 1]
                else:
                    fine_at.append(at[k + 1])
                    fine_cost.append(cost[k + 1])
                    fine_size.append(n)
            at, cost, size = fine_at, fine_cost, fine_size
        return np.array(at), np.concatenate(([0], np.cumsum(size))), np.array(cost)

    def gaps(self, text: str, start: int, end: int, room: int) -> Iterator[tuple[int, float, int]]:
        """(end, penalty, tokens) of the words of a stretch; of one over half a piece its parts, of so few characters that none can
        have more tokens than a quarter of a piece (a character has four bytes at most, and a token a byte at least), or of more while
        they stay within a sixteenth, as a run of one mark has many characters for a token."""
        points = [m.start() for m in _GAP.finditer(text, start, end) if m.start() > start]
        for i, j in zip([start, *points], [*points, end]):
            n = self.size(text[i:j])
            if n * 2 <= room:
                yield j, CLAUSE if text[j - 1] in _CLAUSE else WORD_GAP, n
            else:
                while i < j:
                    step = max(1, room // 16)
                    while i + step < j and self.size(text[i : i + 2 * step]) * 16 <= room:
                        step *= 2
                    k = min(i + step, j)
                    yield k, INSIDE if k < j else WORD_GAP, self.size(text[i:k])
                    i = k

    @staticmethod
    def cuts(before: np.ndarray, cost: np.ndarray, most: int, overlap: int) -> list[int]:
        """The boundaries at which the pieces end, by dynamic programming; nothing if no sequence keeps within the limit."""
        last = len(before) - 1
        begin = np.maximum(before - overlap, 0)  # ascends, as before does
        pieces = max(1, -(-(int(before[last]) - overlap) // max(1, most - overlap)))
        even = (int(before[last]) + (pieces - 1) * overlap) / pieces
        best = np.full(last + 1, np.inf)
        back = np.full(last + 1, -1)
        best[0] = 0
        lo = np.maximum(np.searchsorted(begin, before - most), 0)
        scale = UNEVEN / most**2
        penalty = cost + 0.01
        penalty[last] = 0.0
        for j in range(1, last + 1):
            a = lo[j]
            if a < j:
                off = (before[j] - even) - begin[a:j]
                here = best[a:j] + scale * off * off
                i = int(here.argmin())
                best[j] = here[i] + penalty[j]
                back[j] = a + i
        if not np.isfinite(best[last]):
            return []
        out, j = [], last
        while j > 0:
            out.append(j)
            j = int(back[j])
        return out[::-1]

    def overlapped(self, text: str, end: int, floor: int, overlap: int) -> tuple[int, int]:
        """Where a piece after a cut at ``end`` begins, and the tokens from there to the cut: the first gap between words after ``floor`` with at most ``overlap`` tokens up to
        the cut. Where the next word before it has over ``overlap`` tokens alone, or no gap is there, a place inside (then -1 tokens, not counted)."""
        if overlap <= 0:
            return end, 0
        wide = overlap * 12
        while True:
            lo = max(floor, end - wide)
            start, n = end, 0
            for i in reversed([m.start() for m in _GAP.finditer(text, lo, end) if lo < m.start() < end]):
                more = self.size(text[i:start])
                if n + more > overlap:
                    break
                start, n = i, n + more
            else:
                more = self.size(text[lo:start])
                if more <= overlap and lo > floor:  # the word goes on before
                    wide *= 2
                    continue
            return (start, n) if start < end and more <= overlap else (self.inside(text, end, floor, overlap), -1)

    def inside(self, text: str, end: int, floor: int, overlap: int) -> int:
        """The place after ``floor`` from which ``overlap`` tokens lead to ``end``, or as few less as can be: by bisection, then among
        the characters around, as a character more need not be a token more."""

        def count(k: int) -> int:
            return len(self.encode(text[k:end]))

        near, far, step = end, floor, overlap
        while near - step > floor:
            if count(near - step) > overlap:
                far = near - step
                break
            near -= step
            step *= 2
        while near - far > 1:
            k = (near + far) // 2
            near, far = (k, far) if count(k) <= overlap else (near, k)
        if far > floor and count(near) < overlap:
            near = max((k for k in range(max(floor + 1, near - 8), min(near + 8, end) + 1) if count(k) <= overlap), key=lambda k: (count(k), -k))
        return near

    def split(self, text: str, most: int, overlap: int) -> list[tuple[int, int, int]]:
        """(start, end, tokens) in characters of each piece of a text that has over ``most`` tokens; nothing for another."""
        if most < 1:
            return []
        overlap = max(0, min(overlap, most - 1))
        limit = most
        while True:
            at, before, cost = self.boundaries(text, most, max(1, limit - overlap))
            if not len(at):
                return []
            ends = self.cuts(before, cost, limit, overlap)
            counted, start, shared, done = [], 0, 0, 0
            whole = not (cost == INSIDE).any()  # then the tokens of the parts add up
            for j in ends:
                end = int(at[j])
                n = shared + int(before[j] - before[done]) if whole and shared >= 0 else len(self.encode(text[start:end]))
                counted.append((start, end, n))
                start, shared = self.overlapped(text, end, start, overlap)
                done = j
            if counted and all(n <= most for _, _, n in counted):
                return counted
            # Only parts of a cut word can count differently alone: again with a smaller limit, at last character by character.
            if limit <= 4:
                return [(i, i + 1, len(self.encode(text[i]))) for i in range(len(text))]
            limit, overlap = max(4, limit * 9 // 10), min(overlap, max(4, limit * 9 // 10) - 1)


_SPLITTERS: dict[str, Splitter] = {}


def _split(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _SPLITTERS:
            _SPLITTERS[path] = Splitter(path)
        splitter = _SPLITTERS[path]
        for batch in batches:
            out: list[tuple] = []
            where: list[int] = []
            for i, (text, most, overlap) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for no, (a, b, n) in enumerate(splitter.split(text, most, overlap or 0)):
                    out.append((no + 1, a, b, n, text[a:b]))
                    where.append(i)
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["_k", "piece_no", "start", "end", "n_tokens", "piece"])

    return run


def split_oversized(docs: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(key, piece_no from 1, start, end, n_tokens, piece) of every text that has more tokens than its source's max_tokens.

    start and end are characters of the text; every piece encoded alone has at most max_tokens tokens, the pieces cover the text,
    and each begins up to overlap_tokens tokens before the end of the one before it, as near to that as a boundary allows, or inside a
    word that has more than overlap_tokens itself, then as near as a character allows. A text
    within its limit, a null or empty one, and one whose source is null or has no limit give no row; so does an empty table. A
    null overlap means 0, a null or non-positive max_tokens no limit. A single character with more tokens than the limit stays
    whole, the only piece that may be over it. Of repeated limits of one source the smallest counts.

    Each text is cut alone: nothing is shuffled but a table too small to occupy all cores (see spread). The limits are broadcast, after a check that they are at most MOST_SOURCES rows.
    """
    from pyspark.sql import Window

    kind = docs.schema[key].dataType.simpleString()
    own = limits.filter(F.col("source").isNotNull() & (F.col("max_tokens") > 0)).groupBy("source").agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("l"))
    checked = own.limit(MOST_SOURCES + 1).withColumn("ok", F.assert_true(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) <= MOST_SOURCES)).filter(F.col("ok").isNull())
    bound = F.broadcast(checked.select(F.col("source").alias("_s"), F.col("l.max_tokens").alias("_most"), F.col("l.overlap_tokens").alias("_overlap")))
    rows = spread(docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(text).alias("_t")))
    long = rows.join(bound, "_s").filter(F.octet_length("_t") > F.col("_most"))  # a token has a byte at least
    cut = long.select("_k", "_t", "_most", "_overlap").mapInArrow(_split(f"{folder}/{vocabulary}"), f"_k {kind}, piece_no int, start long, end long, n_tokens int, piece string")
    return cut.withColumnRenamed("_k", key)
