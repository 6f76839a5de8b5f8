"""Boolean and phrase queries over an index, and set operations on document lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms, terms_of
from ..plans.language import Leaf, Plan, constrained, parse
from .index import Index


def _slots(plan: Plan) -> dict[str, str]:
    """A column name for each distinct term of a plan."""
    terms = dict.fromkeys(t for leaf in plan.leaves() for t in leaf.terms)
    return {t: f"_p{i}" for i, t in enumerate(terms)}


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _leaf(leaf: Leaf, slots: dict[str, str]) -> Column:
    """Whether a document's position arrays hold the leaf: every term, and some start from which all stand at their distance."""
    cols = [F.col(slots[t]) for t in leaf.terms]
    present = reduce(lambda a, b: a & b, (F.col(slots[t]).isNotNull() for t in dict.fromkeys(leaf.terms)))
    if len(cols) == 1:
        return present
    starts = cols[0]
    for c, off in zip(cols[1:], leaf.offsets[1:], strict=True):
        starts = F.array_intersect(starts, _moved(c, off))
    return F.coalesce(present & (F.size(starts) > 0), F.lit(False))


def _condition(plan: Plan, slots: dict[str, str]) -> Column:
    if plan.leaf:
        return _leaf(plan.leaf, slots)
    parts = [_condition(c, slots) for c in plan.children]
    if plan.kind == "not":
        return ~parts[0]
    return reduce((lambda a, b: a & b) if plan.kind == "and" else (lambda a, b: a | b), parts)


def decided(index: Index, plan: Plan, rows: DataFrame, *extra: Column) -> DataFrame:
    """(doc_id, the extra aggregates) of the documents that a plan holds for; ``rows`` are the postings of its terms. An aggregate is
    null for a document with none of them."""
    slots = _slots(plan)
    phrased = {t for leaf in plan.leaves() if len(leaf.terms) > 1 for t in leaf.terms}
    held = [F.max(F.when(F.col("term") == t, F.col("positions") if t in phrased else F.array(F.lit(0)))).alias(c) for t, c in slots.items()]
    found = rows.groupBy("doc_id").agg(*held, *extra)
    if plan.holds(lambda leaf: False):  # a NOT can hold for documents without any of the terms
        found = index.docs.select("doc_id").join(found, "doc_id", "left")
    return found.filter(_condition(plan, slots)).drop(*slots.values())


def plan_terms(plan: Plan) -> list[str]:
    return list(_slots(plan))


def matches(index: Index, query: str) -> DataFrame:
    """(doc_id) of the documents that a query holds for, in no order.

    One scan of the postings of the query's terms and one shuffle by document, whatever the tree; positions are read only for
    terms of phrases. A query that constrains nothing matches nothing.
    """
    plan = constrained(parse(query))
    if plan is None:
        return index.docs.select("doc_id").limit(0)
    return decided(index, plan, index.postings.filter(F.col("term").isin(*plan_terms(plan))))


def match(index: Index, query: str) -> DataFrame:
    return matches(index, query).orderBy("doc_id")


def phrase(index: Index, text: str) -> DataFrame:
    if '"' in text:
        raise ValueError('a phrase cannot contain "')
    return match(index, f'"{text}"')


def documents_with(index: Index, word: str) -> DataFrame:
    """(doc_id) of a word's documents. Unlike in a query, a stopword has an empty list here."""
    found = terms_of(word)
    if len(found) > 1:
        raise ValueError(f"'{word}' is more than one term")
    return index.postings.filter(F.col("term") == found[0][1]).select("doc_id") if found else index.docs.select("doc_id").limit(0)


def _fold(index: Index, words: list[str], step) -> DataFrame:
    if len(words) < 2:
        raise ValueError("at least two words")
    return reduce(step, (documents_with(index, w) for w in words)).orderBy("doc_id")


def intersect(index: Index, words: list[str]) -> DataFrame:
    return _fold(index, words, lambda a, b: a.intersect(b))


def unite(index: Index, words: list[str]) -> DataFrame:
    return _fold(index, words, lambda a, b: a.union(b).distinct())


def subtract(index: Index, first: str, second: str) -> DataFrame:
    return _fold(index, [first, second], lambda a, b: a.join(b, "doc_id", "left_anti"))


def all_documents(index: Index) -> DataFrame:
    return index.docs.select("doc_id").orderBy("doc_id")


def terms_for(words: list[str]) -> list[str]:
    return query_terms(words)
