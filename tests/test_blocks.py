"""Logs answered by blocks of documents: the same as scoring everything, with less of it done."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumetext.operators import blocks, evaluation, ranking
from lumetext.operators.index import build_index
from lumetext.plans import language as lang

TERMS = {"hot": 12_000, "warm": 9_000, "mild": 3_000, "rare": 40}


def _block(rng: random.Random, docs: int = 20_000) -> tuple[blocks._Block, dict]:
    held = {t: {d: (rng.randrange(1, 9) << 37, sorted(rng.sample(range(30), rng.randrange(1, 4)))) for d in rng.sample(range(docs), n)} for t, n in TERMS.items()}
    rows = [(t, d * 3, w, p) for t, x in held.items() for d, (w, p) in x.items()]
    rng.shuffle(rows)
    block = blocks._Block()
    for part in (rows[:10_000], rows[10_000:]):
        cols = zip(*part, strict=True)
        table = pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["term", "doc_id", "w", "positions"])
        for i, name in ((0, "term"), (2, "w")):
            table = table.set_column(i, name, table.column(name).combine_chunks().dictionary_encode())
        block.add(blocks._POSTINGS, blocks._bytes_of(table))
    block.add(blocks._DOCUMENTS, blocks._bytes_of(pa.table({"doc_id": pa.array([d * 3 for d in range(docs)], pa.int64())})))
    block.build()
    return block, held


def _all(held: dict, plan, terms: list[str], docs: int = 20_000) -> list[tuple[int, float]]:
    """Every match of a query with its score, best first."""

    def has(leaf, d):
        if any(d not in held.get(t, {}) for t in leaf.terms):
            return False
        return any(all(s + o in held[t][d][1] for t, o in zip(leaf.terms, leaf.offsets, strict=True)) for s in held[leaf.terms[0]][d][1])

    times = Counter(terms)
    out = []
    for d in range(docs):
        if any(d in held.get(t, {}) for t in times) if plan is None else plan.holds(lambda leaf, d=d: has(leaf, d)):
            out.append((d * 3, sum(held[t][d][0] * n for t, n in times.items() if d in held.get(t, {})) * blocks.UNIT))
    return sorted(out, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("direct", [0, 2048])
def test_a_block_answers_as_if_it_scored_everything(direct, monkeypatch):
    monkeypatch.setattr(blocks, "DIRECT", direct)
    block, held = _block(random.Random(7))
    bags = ["hot", "hot warm", "warm mild rare", "hot hot mild", "rare", "none", "none warm"]
    trees = ["hot AND warm", "hot AND rare", "hot AND NOT warm", "mild AND (warm OR rare)", '"hot warm"', '"hot warm" OR rare', "NOT hot", "hot OR NOT warm", "NOT (NOT hot OR NOT mild)", "none", "NOT none"]
    for text, bag in [*((t, True) for t in bags), *((t, False) for t in trees)]:
        plan = None if bag else lang.constrained(lang.parse(text))
        terms = text.split() if bag else lang.scoring_terms(text)
        for k, digits in ((3, None), (10, 6), (100, None)):
            at, score = blocks._Query(block, plan, terms, k, digits).best()
            assert list(zip(block.ids.take(pa.array(at)).to_pylist(), score.tolist(), strict=True)) == _all(held, plan, terms)[:k], (text, k)


def test_few_documents_are_scored_for_common_words(monkeypatch):
    rng = random.Random(3)
    block, _ = _block(rng)
    for t in ("hot", "warm"):
        block.lists[t] = (block.lists[t][0], np.array([rng.randrange(1 << 40) for _ in range(TERMS[t])]))
    seen = []
    scored = blocks._Query.scored
    monkeypatch.setattr(blocks._Query, "scored", lambda self, at: seen.append(len(at)) or scored(self, at))
    at, _ = blocks._Query(block, None, ["hot", "warm"], 10, None).best()
    assert len(at) == 10 and sum(seen) < len(block.joined(["hot", "warm"])) / 4


WORDS = "red boat hill harbour lamp stone river light".split()


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(WORDS), " ".join(rng.choices(WORDS, k=rng.randrange(3, 30)))) for i in range(300)]
    return build_index(spark.createDataFrame(rows, "doc_id int, title string, body string"))


@pytest.mark.parametrize("first", [1, 100])
def test_blocks_that_have_more_are_asked_again(spark, small, monkeypatch, first):
    monkeypatch.setattr(blocks, "block_count", lambda postings, cores: 3)
    monkeypatch.setattr(ranking, "_first_try", lambda k, n: min(k, first))
    log = ["red boat", "boat OR hill", '"red boat"', "hill AND NOT red", "NOT lamp", "stone stone light", 'river OR NOT "red boat"']
    queries = spark.createDataFrame(list(enumerate(log)), "query_id int, text string")
    rows = ranking.batch_search(small, queries, 10).collect()
    for i, text in enumerate(log):
        single = ranking.run_query(small, text, 10).collect()
        got = sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)
        assert [r.doc_id for r in got] == [r.doc_id for r in single], text
        assert [r.score for r in got] == pytest.approx([r.score for r in single], abs=1e-9), text
    bags = ranking.batch_top_k(small, evaluation.bags(queries.filter("query_id IN (0, 5)")), 10).collect()
    for i, words in ((0, ["red", "boat"]), (5, ["stone", "stone", "light"])):
        assert [r.doc_id for r in sorted((r for r in bags if r.query_id == i), key=lambda r: r.rank)] == [r.doc_id for r in ranking.rank_words(small, words, k=10).collect()]


def test_only_judged_queries_are_ranked(spark, small, monkeypatch):
    asked = []
    top = evaluation.batch_top_k
    monkeypatch.setattr(evaluation, "batch_top_k", lambda index, bags, *a: asked.extend(r.query_id for r in bags.collect()) or top(index, bags, *a))
    queries = spark.createDataFrame([("a", "red boat"), ("b", "hill"), ("c", "lamp")], "query_id string, text string")
    qrels = spark.createDataFrame([("a", 1, 2), ("b", 2, 0), ("x", 3, 1)], "query_id string, doc_id int, grade int")
    row = evaluation.evaluate(small, queries, qrels).first()
    assert (row.judged, row.unjudged) == (1, 2) and asked == ["a"]
