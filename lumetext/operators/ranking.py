"""Scores, top-k and whole queries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..plans.language import Plan, QueryError, constrained, parse, scoring_terms, word_count
from ..storage import cut, stored
from . import blocks
from .blocks import cover  # noqa: F401
from .index import Index, dense_ranks
from .matching import decided

#: Constants of the scorers (fixed values).
K1, B, TITLE_WEIGHT = 1.2, 0.75, 2.0

SCORERS = ("bm25", "bm25f", "tfidf")


def idf(n: Column | float, df: Column) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def weight(scorer: str, index: Index, tf: Column, df: Column, length: Column, title_terms: Column, title_tf: Column) -> Column:
    """A term's contribution to a document's score."""
    s = index.stats
    if scorer == "tfidf":
        return (1 + F.log(tf)) * F.log(F.lit(float(s.n_docs)) / df)
    if scorer == "bm25":
        ratio = length / s.average if s.average else F.lit(1.0)
        return idf(s.n_docs, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))
    if scorer != "bm25f":
        raise ValueError(f"unknown scorer '{scorer}'")
    body_average = s.average - s.average_title
    in_title = title_terms / s.average_title if s.average_title else F.lit(1.0)
    in_body = (length - title_terms) / body_average if body_average else F.lit(1.0)
    titled = F.when(title_tf > 0, TITLE_WEIGHT * title_tf / (1 - B + B * in_title)).otherwise(0.0)
    rest = F.when(tf > title_tf, (tf - title_tf) / (1 - B + B * in_body)).otherwise(0.0)
    w = titled + rest
    return idf(s.n_docs, df) * w / (K1 + w)


def _weight(index: Index, scorer: str) -> Column:
    """weight of joined rows of postings and dictionary."""
    return weight(scorer, index, F.col("tf"), F.col("df"), F.col("length"), F.col("title_terms"), F.col("title_tf"))


def _parts(index: Index, terms: list[str], scorer: str) -> DataFrame:
    """Postings of the terms with ``parts``: the (place in the list, contribution) of each time that the term is in it. The dictionary
    answers the terms' numbers of documents; no document is looked up."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer '{scorer}'")
    times = {t: [i for i, x in enumerate(terms) if x == t] for t in dict.fromkeys(terms)}
    found = index.terms.filter(F.col("term").isin(*times))  # one row for each query term: bounded by the query
    rows = index.postings.filter(F.col("term").isin(*times)).join(F.broadcast(found), "term")
    places = F.create_map(*(x for t, i in times.items() for x in (F.lit(t), F.array(*map(F.lit, i)))))
    w = _weight(index, scorer)
    return rows.withColumn("_w", w).withColumn("parts", F.transform(places[F.col("term")], lambda i: F.struct(i.alias("i"), F.col("_w").alias("w"))))


def _sum() -> Column:
    """The parts of a document, in the order of the query's terms."""
    return F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts")


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x.w)


def scored(index: Index, terms: list[str], scorer: str = "bm25") -> DataFrame:
    """(doc_id, score) of every document with at least one of the terms. A term that comes twice counts twice.

    A document's contributions are added in the order of the terms, so its score has the same bits in every run and on any number
    of executors. Only the terms' postings are read, without positions, and they move once, by document.
    """
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer '{scorer}'")
    if not terms:
        return index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    rows = _parts(index, terms, scorer).groupBy("doc_id").agg(_sum())
    return rows.select("doc_id", _total(F.col("parts")).alias("score"))


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The k best by score, then document order."""
    return rows.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


def rank_words(index: Index, words: list[str], scorer: str = "bm25", k: int | None = None) -> DataFrame:
    rows = scored(index, query_terms(words), scorer)
    return rows.orderBy(F.desc("score"), F.asc("doc_id")) if k is None else top_k(rows, k)


@dataclass
class Prior:
    """Scores of pages by name: ``rows`` (doc_id, score) and how many there are, those of unknown pages too."""

    rows: DataFrame
    count: int = field(default=-1)

    def __post_init__(self) -> None:
        if self.count < 0:
            self.count = self.rows.count()

    def boost(self, score: Column, own: Column, strength: float) -> Column:
        return score * (1 + strength * F.log1p(self.count * F.coalesce(own, F.lit(0.0))))


def run_query(index: Index, query: str, limit: int | None = 10, scorer: str = "bm25", prior: Prior | None = None, strength: float = 0.0, max_words: int = 0) -> DataFrame:
    """(doc_id, score) of a query's best documents, or with no limit of all that match, in no order: the tree decides which match, the
    scorer orders them. A match without a scored term has score 0. The prior applies if its strength is positive and the query has at most max_words words (0: any).

    Both the decision and the score come out of one aggregation of the terms' postings by document."""
    plan = constrained(parse(query))
    if plan is None:
        found = index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        return found if limit is None else top_k(found, limit)
    found = decided(index, plan, _parts(index, scoring_terms(query), scorer), _sum())
    score = F.coalesce(_total(F.col("parts")), F.lit(0.0))
    if prior is not None and strength > 0 and (not max_words or word_count(query) <= max_words):
        found = found.join(prior.rows.select("doc_id", F.col("score").alias("_prior")), "doc_id", "left")
        score = prior.boost(score, F.col("_prior"), strength)
    rows = found.select("doc_id", score.alias("score"))
    return rows if limit is None else top_k(rows, limit)


def parsed_queries(queries: DataFrame) -> DataFrame:
    """(query_id, plan, terms, open, shape, need, error) of (query_id, text): parsed on the executors. ``open`` is a query that holds for
    documents with none of its terms; ``shape`` is any or all of ``need`` distinct words, a phrase of ``need`` words, words whose
    presence a truth table decides, or tree for everything else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(p):
            return {"t": p.leaf.terms, "o": p.leaf.offsets} if p.leaf else {"k": p.kind, "c": [tree(c) for c in p.children]}

        def shape(p: Plan) -> tuple[str, int]:
            if p.leaf and len(p.leaf.terms) > 1:
                return "phrase", len(p.leaf.terms)
            parts = [p] if p.leaf else p.children
            words = {x.leaf.terms[0] for x in parts if x.leaf and len(x.leaf.terms) == 1}
            plain = p.kind in ("leaf", "and", "or") and all(x.leaf and len(x.leaf.terms) == 1 for x in parts)
            if plain:
                return ("any", 1) if p.kind == "or" else ("all", len(words))
            return ("tree" if truth_table(p) is None else "table"), len(words)

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    plan = constrained(parse(text or ""))
                    out.append((json.dumps(tree(plan)) if plan else None, scoring_terms(text), bool(plan and plan.holds(lambda leaf: False)), *(shape(plan) if plan else (None, None)), None))
                except QueryError as e:
                    out.append((None, [], False, None, None, str(e)))
            cols = zip(*out, strict=True) if out else ((),) * 6
            kinds = (pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["query_id", "plan", "terms", "open", "shape", "need", "error"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "text").mapInArrow(run, f"query_id {kind}, plan string, terms array<string>, open boolean, shape string, need int, error string")


def truth_table(plan: Plan) -> int | None:
    """Bit i says whether the plan holds for a document whose terms are those of i's bits, in the order of ``words``; None for a plan
    with a phrase, or with more words than the bits of a long can decide."""
    terms = words(plan)
    if len(terms) > 6 or any(len(leaf.terms) > 1 for leaf in plan.leaves()):
        return None
    return sum(plan.holds(lambda leaf, i=i: i >> terms.index(leaf.terms[0]) & 1) << i for i in range(1 << len(terms)))


def words(plan: Plan) -> list[str]:
    """The distinct terms of a plan, in order."""
    return list(dict.fromkeys(t for leaf in plan.leaves() for t in leaf.terms))


#: Terms of a log's distinct queries up to which they are broadcast to the postings, in rows; beyond it both meet by term.
BROADCAST_ROWS = 1_000_000


def _numbered(queries: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct queries by ``columns``, with a number ``n``, and (query_id, n). A text that a log holds a thousand times is run once."""
    distinct = cut(queries.select(*columns).distinct().withColumn("n", F.monotonically_increasing_id()))
    other = distinct.select("n", *(F.col(c).alias(f"_{c}") for c in columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return distinct, queries.select("query_id", *columns).join(other, same).select("query_id", "n")


def _first_try(k: int, blocks: int) -> int:
    """How many of a query's k best a block gives at first: its share, and so many more that it hardly ever has others of them."""
    share = k / blocks
    return min(k, int(share + 5 * share**0.5) + 5)


def _best(index: Index, asked: DataFrame, k: int, scorer: str, digits: int | None, whole: bool) -> DataFrame:
    """(n, doc_id, score, rank): the k best of each query (n, plan, terms), by score and document; ``whole`` if queries can hold for
    documents with none of their terms. The log's terms and their numbers of documents are all that the driver's choice of blocks hangs
    on. A query of which a block may have more than it gave at first is answered again."""
    used = cut(blocks.used_terms(asked).join(index.terms, "term"))
    size = used.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
    count = blocks.block_count(size.postings, asked.sparkSession.sparkContext.defaultParallelism)
    plain = used.filter("phrased").isEmpty()
    rows = index.postings.join(F.broadcast(used) if size.rows <= BROADCAST_ROWS else used, "term")
    positions = [] if plain else [F.when(F.col("phrased"), F.col("positions")).alias("positions")]
    rows = rows.select("term", "doc_id", F.round(_weight(index, scorer) / blocks.UNIT).cast("long").alias("w"), *positions)

    def answers(some: DataFrame, most: int) -> DataFrame:
        return _ranked(blocks.answered(rows, index.docs if whole else None, some, count, most, digits), k)

    first = _first_try(k, count)
    if first == k:
        return answers(asked, k).drop("more")
    found, _ = stored(answers(asked, first))
    again = found.filter(F.col("more") & (F.col("rank") < k)).select("n").distinct()
    if again.isEmpty():
        return found.drop("more")
    again = cut(again)
    rest = answers(asked.join(again, "n", "left_semi"), k)
    return found.join(again, "n", "left_anti").unionByName(rest).drop("more")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """Rows (n, doc_id, score, ...) with the ``rank`` of the k best of each n."""
    window = Window.partitionBy("n").orderBy(F.desc("score"), F.asc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def batch_top_k(index: Index, queries: DataFrame, k: int = 10, scorer: str = "bm25", digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best of each query of (query_id, terms), taken as a bag of its terms; with ``digits``
    scores are rounded before they are ranked. Queries of the same terms are scored once."""
    bags = queries.select("query_id", F.sort_array("terms").alias("terms")).filter(F.size("terms") > 0)
    distinct, asked = _numbered(bags, ["terms"])
    distinct = distinct.withColumn("plan", F.lit(None).cast("string"))
    return asked.join(_best(index, distinct, k, scorer, digits, False), "n").drop("n")


def _first_without(index: Index, asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(n, doc_id): for each query of ``asked`` (n) its first k documents in document order that are not among its ``held``
    (n, doc_id). They are cut from the gaps between the held ones, so nothing is made of queries times documents."""
    placed = dense_ranks(index.docs.select("doc_id"), "doc_id", "nth")
    window = Window.partitionBy("n").orderBy("nth")
    total = index.docs.agg(F.count(F.lit(1)).alias("nth"))  # one row
    ends = held.join(placed, "doc_id").select("n", "nth").unionByName(asked.crossJoin(total).select("n", "nth"))
    gaps = ends.select("n", "nth", (F.lag("nth", 1, -1).over(window) + 1).alias("start"), (F.row_number().over(window) - 1).alias("taken"))
    gaps = gaps.withColumn("left", F.lit(k) - (F.col("start") - F.col("taken"))).filter((F.col("left") > 0) & (F.col("start") < F.col("nth")))
    free = gaps.select("n", F.explode(F.sequence("start", F.least(F.col("nth"), F.col("start") + F.col("left")) - 1)).alias("nth"))
    return free.join(placed, "nth").select("n", "doc_id")


def batch_search(index: Index, queries: DataFrame, k: int = 10, scorer: str = "bm25") -> DataFrame:
    """(query_id, doc_id, score, rank): run_query for a whole log of (query_id, text), but for broken queries and such as constrain
    nothing. Queries that hold for documents with none of their terms are answered too: those documents have score 0, so only the first
    k in document order can be among a query's best.

    Each distinct query is decided and scored once in each block of documents (see ``blocks``), its tree over the documents that can be
    among the best: words by their lists, phrases by intersecting shifted positions.
    """
    parsed = cut(parsed_queries(queries).filter(F.col("plan").isNotNull()))
    asked, whose = _numbered(parsed.withColumn("terms", F.sort_array("terms")), ["plan", "terms", "open"])
    whole = not asked.filter("open").isEmpty()
    return whose.join(_best(index, asked, k, scorer, None, whole), "n").drop("n")
