"""The dictionary: near terms, corrections, completions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, terms_of
from ..plans.language import QueryError, Token, lex, respell
from ..storage import cut
from .index import Index
from .matching import matches


def byte_view(text: Column) -> Column:
    """One character for each byte, so that lengths and distances are those of bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def edit_distance_column(a: Column, b: Column, limit: int | None = None) -> Column:
    """Levenshtein distance in bytes; limit + 1 where it is over a limit. Plain ASCII takes the short way."""
    ascii_ = (F.octet_length(a) == F.length(a)) & (F.octet_length(b) == F.length(b))
    if limit is None:
        return F.when(ascii_, F.levenshtein(a, b)).otherwise(F.levenshtein(byte_view(a), byte_view(b)))
    d = F.when(ascii_, F.levenshtein(a, b, limit)).otherwise(F.levenshtein(byte_view(a), byte_view(b), limit))
    return F.when(d < 0, limit + 1).otherwise(d)


def edit_distance(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def near_terms(terms: DataFrame, word: str, most: int = 2) -> DataFrame:
    """(term, distance, df) within a distance of a term. Lengths that differ by more are skipped before the distance is computed."""
    size = len(word.encode())
    close = terms.filter(F.octet_length("term").between(size - most, size + most))
    return close.withColumn("distance", edit_distance_column(F.col("term"), F.lit(word), most)).filter(F.col("distance") <= most).select("term", "distance", "df")


def suggest(index: Index, word: str, most: int = 2, limit: int = 5) -> DataFrame:
    """The nearest terms of a word's term: distance, then df descending, then term."""
    found = terms_of(word)
    if len(found) != 1:
        raise ValueError(f"'{word}' is not one term")
    return near_terms(index.terms, found[0][1], most).orderBy("distance", F.desc("df"), "term").limit(limit)


def _correct_word(index: Index, word: str) -> tuple[str, bool] | None:
    """A better term for a word, and whether the word was indexed: of the ten nearest the first other one that has 100 times its
    documents and is its own analysis. Indexed terms of under four bytes stay."""
    found = terms_of(word)
    if len(found) != 1:
        return None
    term = found[0][1]
    size = len(term.encode())
    near = suggest(index, word, 1 if size <= 4 else 2, 10).collect()
    own = sum(r.df for r in index.terms.filter(F.col("term") == term).collect())  # one row
    if own and size < 4:
        return None
    for r in near:
        if r.distance and r.df >= 100 * own and [t for _, t in terms_of(r.term)] == [r.term]:
            return r.term, own > 0
    return None


def correct_query(index: Index, query: str) -> str | None:
    """The query with better words, or None. Unknown words are always corrected, known rare ones only where the query finds fewer
    than five documents; phrases stay."""
    try:
        tokens = lex(query)
    except QueryError:
        return None
    few: bool | None = None
    out, changed = [], False
    for t in tokens:
        better = _correct_word(index, t.text) if t.kind == "term" else None
        if better and better[1] and few is None:
            try:
                few = matches(index, query).limit(5).count() < 5
            except QueryError:
                few = True
        if better and (not better[1] or few):
            t, changed = Token("term", better[0]), True
        out.append(t)
    return respell(out) if changed else None


def _shorter(text: Column, most: int) -> Column:
    """Distinct strings that are left of a text without up to ``most`` of its characters (one or two)."""
    once = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    one = F.when(F.length(text) > 0, once(text)).otherwise(F.array().cast("array<string>"))
    out = F.concat(F.array(text), one)
    if most > 1:
        out = F.concat(out, F.flatten(F.transform(F.filter(one, lambda t: F.length(t) > 0), once)))
    return F.array_distinct(out)


#: Bytes up to which terms meet by deletions, of which a term has half the square of its length; longer ones meet by their parts.
SHORT_TERM = 40


def _own_parts(text: str) -> str:
    """SQL: the three parts of a long term, with its length and their numbers."""
    n = f"length({text})"
    return f"transform(sequence(0, 2), k -> concat_ws('|', {n}, k, substring({text}, (k * {n}) div 3 + 1, ((k + 1) * {n}) div 3 - (k * {n}) div 3)))"


def _near_parts(text: str) -> str:
    """SQL: what the parts of a term within two edits of a long term can be: one of its three parts is left whole, moved by two at most."""
    n = f"(length({text}) + d)"
    part = f"substring({text}, (k * {n}) div 3 + m + 1, ((k + 1) * {n}) div 3 - (k * {n}) div 3)"
    return f"array_compact(flatten(transform(sequence(-2, 2), d -> flatten(transform(sequence(0, 2), k -> transform(sequence(-2, 2), m -> if((k * {n}) div 3 + m >= 0, concat_ws('|', {n}, k, {part}), NULL)))))))"


def _terms_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, term) of words that are one term; the term is null for others."""
    for batch in batches:
        found = [terms_of(w) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0][1] if len(f) == 1 else None for f in found], pa.string())], names=["word", "term"])


def correct_words(index: Index, words: DataFrame) -> DataFrame:
    """(word, better, known): the better term of each distinct word of (word) that has one, by the rule of a single word, and whether the
    word is in the dictionary.

    Two terms lie within a distance only if they share what is left of both after as many characters are deleted, so words and dictionary
    meet by those strings, each an equal key of few terms; long ones meet by the one of three parts that two edits leave whole. The distance
    is computed for such pairs alone, never for all.
    """
    asked = words.select("word").filter(F.col("word").isNotNull()).distinct().mapInArrow(_terms_of_words, "word string, term string").filter(F.col("term").isNotNull())
    own = asked.join(index.terms, "term", "left").select("word", F.col("term").alias("own"), F.coalesce("df", F.lit(0)).alias("own_df"))
    size = F.octet_length("own")
    open_ = cut(own.filter((F.col("own_df") == 0) | (size >= 4)).withColumn("most", F.when(size <= 4, 1).otherwise(2)))
    left = open_.select("own", "most", byte_view(F.col("own")).alias("_v")).distinct()
    held = index.terms.withColumn("_v", byte_view(F.col("term")))
    long, short = F.length("_v") > SHORT_TERM, F.length("_v") <= SHORT_TERM
    keys = left.filter(short).withColumn("_key", F.explode(F.when(F.col("most") == 1, _shorter(F.col("_v"), 1)).otherwise(_shorter(F.col("_v"), 2))))
    keys = keys.unionByName(left.filter(long).withColumn("_key", F.explode(F.expr(_own_parts("_v")))))
    others = held.filter(F.length("_v") <= SHORT_TERM + 2).withColumn("_key", F.explode(_shorter(F.col("_v"), 2)))
    others = others.unionByName(held.filter(F.length("_v") > SHORT_TERM - 2).withColumn("_key", F.explode(F.expr(_near_parts("_v")))))
    pairs = keys.drop("_v").join(others.drop("_v"), "_key").select("own", "most", "term", "df").distinct()
    near = pairs.withColumn("distance", edit_distance_column(F.col("own"), F.col("term"), 2)).filter(F.col("distance") <= F.col("most"))
    first = Window.partitionBy("own").orderBy("distance", F.desc("df"), "term")
    ten = near.withColumn("nth", F.row_number().over(first)).filter("nth <= 10")
    good = ten.join(open_.select("word", "own", "own_df"), "own").filter((F.col("distance") > 0) & (F.col("df") >= 100 * F.col("own_df")))
    same = good.select(F.col("term").alias("word")).distinct().mapInArrow(_terms_of_words, "word string, term string").filter(F.col("word") == F.col("term")).select("term")
    best = good.join(same, "term", "left_semi").groupBy("word").agg(F.min(F.struct("nth", "term", (F.col("own_df") > 0).alias("known"))).alias("b"))
    return best.select("word", F.col("b.term").alias("better"), F.col("b.known").alias("known"))


def complete(index: Index, prefix: str, limit: int = 10) -> DataFrame:
    """Terms that begin with a prefix (normalized, not stemmed), df descending, then term. The filter reaches the scan of the stored
    dictionary, which is sorted."""
    start = normalize(prefix)
    rows = index.terms.filter(F.col("term").startswith(start)) if start else index.terms
    return rows.orderBy(F.desc("df"), "term").limit(limit)
