import math
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lumetext import catalog
from lumetext.operators import evaluation, lexicon, links, matching, ranking, snippets
from lumetext.operators.index import Index, build_index, dense_ranks, index_sizes, load_index, merge_indexes, store_index, update_index, violations
from lumetext.plans import language as lang

DOCS = [
    ("a", "Harbour", "A red boat and a blue boat lie in the harbour."),
    ("b", "Boats", "The boat of the harbour master is red. Red sails!"),
    ("c", "Hills", "Green hills, far from any harbour."),
    ("d", "", ""),
    ("e", "Red", "hill"),
]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(DOCS, "doc_id string, title string, body string"))


def ids(df):
    return [r.doc_id for r in df.collect()]


# The query language


@pytest.mark.parametrize(
    "query, tree",
    [
        ("cat AND (dog OR NOT bird)", "(and (term cat) (or (term dog) (not (term bird))))"),
        ("a b OR c", "(or (and (term a) (term b)) (term c))"),
        ('"big cat" dog', "(and (phrase big cat) (term dog))"),
        ("NOT NOT x", "(not (not (term x)))"),
        ("and or", "(and (term and) (term or))"),
        ("((a))", "(term a)"),
    ],
)
def test_parse(query, tree):
    assert str(lang.parse(query)) == tree


@pytest.mark.parametrize(
    "query, error",
    [
        ("", "empty query"), ('"x', "unterminated quote"), ("(a", "missing closing parenthesis"), (")", "unexpected closing parenthesis"), ("a AND", "unexpected end of query"),
        ("OR a", "unexpected operator"), ("a )", "unexpected token after end of query"), ("(" * 300 + "a", "query nested too deeply"), ("NOT " * 300 + "a", "query nested too deeply"),
    ],
)
def test_parse_errors(query, error):
    with pytest.raises(lang.QueryError, match=error):
        lang.parse(query)


def test_scoring_terms_and_words():
    assert lang.scoring_terms('red NOT "blue boats" red') == ["red", "blue", "boat", "red"]
    assert lang.word_count('red NOT "blue  boats"') == 3
    assert lang.bag_of_words('What "is" (NOT) it') == "what OR is OR not OR it"


# Matching


@pytest.mark.parametrize(
    "query, found",
    [
        ("red AND harbour", "ab"), ("boat OR hill", "abce"), ("NOT harbour", "de"), ("the boat", "ab"), ("boat AND NOT the", "ab"), ("the of", ""), ("NOT the", ""), ('"red boat"', "a"), ('"boat red"', ""),
        ('"harbour master"', "b"), ('"boat of the harbour"', "b"), ('"boat harbour"', ""), ("red-boat", "a"), ("hill AND (green OR NOT red)", "c"), ("zebra", ""), ("NOT zebra", "abcde"), ('"harbour red"', ""), ('"Harbour a red"', "a"),
    ],
)
def test_match(index, query, found):
    assert ids(matching.match(index, query)) == list(found)


def test_set_operations_agree_with_queries(index):
    assert ids(matching.intersect(index, ["red", "harbour"])) == ids(matching.match(index, "red AND harbour"))
    assert ids(matching.unite(index, ["boat", "hill"])) == ids(matching.match(index, "boat OR hill"))
    assert ids(matching.subtract(index, "red", "boat")) == ids(matching.match(index, "red AND NOT boat"))
    assert ids(matching.intersect(index, ["red", "the"])) == []  # a stopword is an empty list here
    with pytest.raises(ValueError):
        matching.intersect(index, ["red"])
    with pytest.raises(ValueError):
        matching.intersect(index, ["red", "blue-boat"])
    with pytest.raises(ValueError):
        matching.phrase(index, 'a "b"')
    assert ids(matching.all_documents(index)) == list("abcde")


# The index


def test_counts_positions_and_streams(spark, index):
    c = index.counts().first()
    assert c.documents == 5 and c.terms == index.terms.count() and c.postings == index.postings.count()
    assert [(r.doc_id, r.positions) for r in index.postings_of("boats").collect()] == [("a", [3, 7]), ("b", [0, 2])]
    assert index.postings_of("the").count() == 0
    with pytest.raises(ValueError):
        index.postings_of("red boat")
    assert [r.term for r in index.document_terms("e").collect()] == ["red", "hill"]
    assert index.averages().first().average_length == pytest.approx(sum(r.length for r in index.lengths().collect()) / 5)


def test_stored_index_equals_built(spark, index, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, title string, body string")
    stored = store_index(docs, str(tmp_path / "i"))
    for name in ("docs", "postings", "terms"):
        a, b = getattr(index, name), getattr(stored, name)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    again = index.save(str(tmp_path / "j"))
    assert again.postings.count() == index.postings.count() and load_index(spark, str(tmp_path / "j")).corpus is not None
    plan = stored.postings.filter(F.col("term") == "boat").select("tf")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,boat)]" in plan and "positions" not in plan.split("ReadSchema")[-1]


def test_update_equals_full_build(spark, index):
    new = [DOCS[0], ("b", "Boats", "Changed text of a boat."), DOCS[3], DOCS[4], ("f", "New", "A new harbour")]
    df = spark.createDataFrame(new, "doc_id string, title string, body string")
    updated, tally = update_index(index, df)
    assert tuple(tally.first()) == (1, 1, 1, 3)
    full = build_index(df)
    key = lambda ix: sorted(map(str, ix.postings.select("term", "doc_id", "tf", "positions").collect()))
    assert key(updated) == key(full)
    assert sorted(map(str, updated.docs.select(*full.docs.columns).collect())) == sorted(map(str, full.docs.collect()))


def test_merge_equals_full_build(spark, index):
    df = spark.createDataFrame(DOCS, "doc_id string, title string, body string")
    merged = merge_indexes(build_index(df.filter("doc_id < 'c'")), build_index(df.filter("doc_id >= 'c'")))
    key = lambda ix: sorted(map(str, ix.postings.select("term", "doc_id", "tf", "positions").collect()))
    assert key(merged) == key(index) and merged.corpus.count() == 5
    with pytest.raises(ValueError):
        merge_indexes(index, index)


def test_violations(spark, index):
    assert violations(index).count() == 0
    bad = spark.createDataFrame([("boat", "a", 3, 0, 9, 9, [3, 2]), ("x", "zz", 1, 0, 1, 0, [0]), ("x", "zz", 1, 0, 1, 0, [-1])], index.postings.schema)
    assert {r.rule for r in violations(Index(index.docs, index.postings.unionByName(bad), None, index.terms)).collect()} == {"frequency", "ascent", "repeated", "unknown", "length", "numbers", "dictionary"}


def test_sizes_and_ranks(spark, index):
    rows = {(r.encoding, r.section): r.bytes for r in index_sizes(index).collect()}
    n, terms = index.postings.count(), [r.term for r in index.terms.collect()]
    assert rows["plain", "postings"] == 24 * n and rows["varbyte", "postings"] == 3 * n  # every number here fits one byte
    assert rows["plain", "documents"] == 8 + 5 * 33 and rows["plain", "header"] == 73
    assert rows["varbyte", "dictionary"] == sum(len(t) + 2 for t in terms) == rows["plain", "dictionary"] - 14 * len(terms)


@pytest.mark.parametrize("adaptive, most", [("true", "64m"), ("true", "256k"), ("false", "64m")])
def test_dense_ranks_of_wide_rows(spark, adaptive, most):
    """Each row once, with its own rank, however adaptive execution cuts the partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, (adaptive, most, "16")):
            spark.conf.set(k, v)
        wide = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 12).alias("text"))
        rows = dense_ranks(wide, "k", "nth").select("k", "nth", F.length("text").alias("n")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.k for r in rows) == list(range(20_000)) and all(r.k == r.nth and r.n == 768 for r in rows)


def test_gaps_go_on_over_ranges(spark, index, monkeypatch):
    from lumetext.operators import index as module

    key = lambda: sorted(map(tuple, index_sizes(index).collect()))
    want = key()
    monkeypatch.setattr(module, "GAP_RANGE", 2)
    assert key() == want


def test_empty_corpus(spark):
    ix = build_index(spark.createDataFrame([], "doc_id string, title string, body string"))
    assert tuple(ix.counts().first()) == (0, 0, 0)
    assert ix.averages().first().average_length == 0
    assert ranking.run_query(ix, "x OR y").count() == 0


# Scores


def test_bm25_by_hand(index):
    got = {r.doc_id: r.score for r in ranking.rank_words(index, ["boat"]).collect()}
    lengths = {r.doc_id: r.length for r in index.docs.collect()}
    avg = sum(lengths.values()) / 5
    idf = math.log(1 + (5 - 2 + 0.5) / 2.5)
    want = {d: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / avg)) for d, tf in (("a", 2), ("b", 2))}
    assert got == pytest.approx(want)


def test_scorers(index):
    twice = {r.doc_id: r.score for r in ranking.rank_words(index, ["boat", "boat"]).collect()}
    once = {r.doc_id: r.score for r in ranking.rank_words(index, ["boat"]).collect()}
    assert twice == pytest.approx({d: 2 * s for d, s in once.items()})
    tfidf = {r.doc_id: r.score for r in ranking.rank_words(index, ["boat"], "tfidf").collect()}
    assert tfidf["a"] == pytest.approx((1 + math.log(2)) * math.log(5 / 2))
    bm25f = ranking.rank_words(index, ["hill"], "bm25f").collect()
    assert [r.doc_id for r in bm25f][0] == "c"  # in the title too
    with pytest.raises(ValueError):
        ranking.rank_words(index, ["boat"], "bm26")
    assert ranking.rank_words(index, ["the"]).count() == 0


def test_run_query_orders_and_keeps_unscored_matches(index):
    rows = ranking.run_query(index, "NOT harbour").collect()
    assert [(r.doc_id, r.score) for r in rows] == [("d", 0.0), ("e", 0.0)]
    assert ranking.run_query(index, "boat", limit=1).count() == 1
    assert [r.doc_id for r in ranking.run_query(index, "red", limit=0).collect()] == []


def test_prior(spark, index):
    ranks = spark.createDataFrame([("a", 0.25), ("x", 0.75)], "page string, score double")
    prior = links.as_prior(ranks)
    plain = {r.doc_id: r.score for r in ranking.run_query(index, "boat").collect()}
    lifted = {r.doc_id: r.score for r in ranking.run_query(index, "boat", prior=prior, strength=2.0).collect()}
    assert lifted["a"] == pytest.approx(plain["a"] * (1 + 2 * math.log(1 + 2 * 0.25))) and lifted["b"] == plain["b"]
    assert {r.doc_id: r.score for r in ranking.run_query(index, "boat red", prior=prior, strength=2.0, max_words=1).collect()} == {r.doc_id: r.score for r in ranking.run_query(index, "boat red").collect()}


def test_queries_of_all_matches_have_no_cap(spark, index, monkeypatch):
    rows = ranking.run_query(index, "red OR NOT harbour", None).collect()
    assert {(r.doc_id, r.score) for r in rows} == {(r.doc_id, r.score) for r in ranking.run_query(index, "red OR NOT harbour", 100).collect()}
    pages = spark.createDataFrame([("p1", 0.5)], "page string, score double")
    monkeypatch.setattr(catalog, "index_of", lambda spark, d: index)
    for name in ("_edges", "_urls"):
        monkeypatch.setattr(catalog, name, lambda spark, d: None)
    for name in ("pagerank", "home_page_ranking"):
        monkeypatch.setattr(catalog.links, name, lambda *a: pages)
    for name in ("query_boolean_ranked", "query_with_prior", "query_prior_short_only"):
        assert "Limit" not in catalog.QUERIES[name](spark, "")._jdf.queryExecution().optimizedPlan().toString(), name


def test_batches_equal_single_queries(spark, index):
    log = ["red boat", "boat OR hill", '"red boat"', "hill AND NOT red", "the", "(", "harbour boat boat"]
    queries = spark.createDataFrame(list(enumerate(log)), "query_id int, text string")
    rows = ranking.batch_search(index, queries, 3).collect()
    for i, text in enumerate(log):
        try:
            single = ranking.run_query(index, text, 3).collect()
        except lang.QueryError:
            single = []
        got = sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)
        assert [r.doc_id for r in got] == [r.doc_id for r in single], text
        assert [r.score for r in got] == pytest.approx([r.score for r in single], abs=1e-9), text
    parsed = {r.query_id: r for r in ranking.parsed_queries(queries).collect()}
    assert parsed[5].error == "unexpected end of query" and parsed[4].plan is None


def test_batches_answer_open_queries(spark, index):
    log = ["NOT boat", "hill OR NOT red", "NOT zebra", "NOT NOT boat", "NOT (NOT boat OR NOT red)", 'NOT "red boat"', "NOT boat AND NOT hill", "boat OR NOT boat", "hill OR NOT the"]
    queries = spark.createDataFrame(list(enumerate(log)), "query_id int, text string")
    for k in (2, 100):
        rows = ranking.batch_search(index, queries, k).collect()
        for i, text in enumerate(log):
            single = ranking.run_query(index, text, k).collect()
            got = sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)
            assert single and [r.doc_id for r in got] == [r.doc_id for r in single], text
            assert [r.score for r in got] == pytest.approx([r.score for r in single], abs=1e-9), text


def test_first_documents_without(spark):
    rng = random.Random(4)
    docs = spark.range(200).selectExpr("id * 3 AS doc_id")
    held = {q: set(rng.sample(range(0, 600, 3), n)) for q, n in enumerate((0, 1, 50, 195, 199, 200))} | {6: set(range(0, 300, 3))}
    rows = spark.createDataFrame([(q, d) for q, x in held.items() for d in x], "n int, doc_id long")
    found = ranking._first_without(SimpleNamespace(docs=docs), spark.createDataFrame([(q,) for q in held], "n int"), rows, 7).collect()
    for q, x in held.items():
        assert sorted(r.doc_id for r in found if r.n == q) == [d for d in range(0, 600, 3) if d not in x][:7]


def test_covers():
    df = {"boat": 5, "hill": 2, "red": 9, "mill": 1}
    cover = lambda q: ranking.cover(lang.constrained(lang.parse(q)), df)
    assert cover("boat hill") == ["hill"] and cover("boat OR hill") == ["boat", "hill"]
    assert cover("red AND (boat OR hill)") == ["boat", "hill"] and cover("red AND (boat OR red)") == ["red"]
    assert cover('"red mill boat"') == ["mill"] and cover("NOT red") is None and cover("hill OR NOT red") is None
    assert cover("hill AND NOT red") == ["hill"] and cover("zebra boat") == ["zebra"]


# Links


def test_pagerank(spark):
    star = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "a"), ("b", "a"), ("a", "b")], "src string, dst string")
    for rounds in (0, 1, 30):
        got = {r.page: r.score for r in links.pagerank(star, rounds).collect()}
        pages, edges = "abcd", {("b", "a"), ("c", "a"), ("d", "a"), ("a", "b")}
        want = dict.fromkeys(pages, 0.25)
        for _ in range(rounds):
            want = {p: 0.15 / 4 + 0.85 * sum(want[s] for s, t in edges if t == p) for p in pages}
        assert got == pytest.approx(want)
    dangling = {r.page: r.score for r in links.pagerank(spark.createDataFrame([("a", "b")], "src string, dst string"), 30).collect()}
    assert dangling == pytest.approx({"a": 0.350877, "b": 0.649123}, abs=1e-6)
    loop = {r.page: r.score for r in links.pagerank(spark.createDataFrame([("a", "a"), ("a", "b")], "src string, dst string"), 1).collect()}
    assert loop["a"] == pytest.approx(0.075 + 0.85 * (0.25 + 0.25))
    assert links.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0
    with pytest.raises(ValueError):
        links.pagerank(star, damping=1.5)


def test_sites_and_homes(spark):
    urls = spark.createDataFrame([("p1", "http://A.test/", 0), ("p2", "http://a.test/x", 1), ("p3", "https://b.test:8443/", 2), ("p4", "ftp://c.test/", 3), ("p5", "https://a.test/", 4)], "doc_id string, url string, ord long")
    edges = spark.createDataFrame([("p2", "p3"), ("p1", "p2"), ("p2", "zz"), ("p5", "p3")], "src string, dst string")
    assert sorted(r.doc_id for r in links.page_hosts(urls).filter("home").collect()) == ["p1", "p3"]
    assert [tuple(r) for r in links.host_links(edges, urls).collect()] == [("a.test", "b.test")]
    site = {r.page: r.score for r in links.site_pagerank(edges, urls).collect()}
    assert site == pytest.approx({"p1": 0.350877, "p3": 0.649123}, abs=1e-6)
    assert {r.page: r.score for r in links.home_page_ranking(urls).collect()} == {"p1": 0.5, "p3": 0.5}


# The dictionary


def test_dictionary(spark, index):
    near = [(r.term, r.distance) for r in lexicon.suggest(index, "boot", 1).collect()]
    assert near == [("boat", 1)]
    assert lexicon.edit_distance("é", "e") == 2 and lexicon.edit_distance("kitten", "sitting") == 3
    pairs = spark.createDataFrame([("é", "e"), ("kitten", "sitting"), ("", "ab")], "a string, b string")
    assert [r.d for r in pairs.select(lexicon.edit_distance_column(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 3, 2]
    assert [r.d for r in pairs.select(lexicon.edit_distance_column(F.col("a"), F.col("b"), 1).alias("d")).collect()] == [2, 2, 2]
    assert [r.term for r in lexicon.complete(index, "HA").collect()] == ["harbour"]
    assert lexicon.complete(index, "", 3).count() == 3
    assert lexicon.correct_query(index, "harbuor AND (NOT boat)") == "harbour AND (NOT boat)"
    assert lexicon.correct_query(index, "harbour") is None and lexicon.correct_query(index, '"harbuor"') is None
    with pytest.raises(ValueError):
        lexicon.suggest(index, "red boat")


def test_words_are_corrected_alone_and_together(spark, index):
    words = ["harbuor", "bot", "boats", "hlil", "zebra", "the", "rde", "blue-boat", "masterr", "", "é", "sial", "a", "gren"]
    frame = spark.createDataFrame([(w,) for w in [*words, "harbuor", None]], "word string")
    got = {r.word: (r.better, r.known) for r in lexicon.correct_words(index, frame).collect()}
    assert got == {w: found for w in words if (found := lexicon._correct_word(index, w))} and got["harbuor"] == ("harbour", False)


def test_long_words_are_corrected(spark):
    """Terms over SHORT_TERM bytes meet by their parts, whatever the edits and wherever they are."""
    rng = random.Random(21)
    long = ["".join(rng.choices("bcdfghjklmnp", k=n)) for n in (39, 40, 41, 42, 43, 60, 600)]
    ix = build_index(spark.createDataFrame([(str(i), "", w) for i, w in enumerate(long)], "doc_id string, title string, body string"))
    typed = set()
    for w in long:
        for _ in range(6):
            t = list(w)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(t))
                rng.choice([lambda: t.pop(i), lambda: t.insert(i, "z"), lambda: t.__setitem__(i, "z")])()
            typed.add("".join(t))
    got = {r.word: r.better for r in lexicon.correct_words(ix, spark.createDataFrame([(w,) for w in typed], "word string")).collect()}
    want = {w: min(near)[1] for w in typed if (near := [(d, x) for x in long if (d := lexicon.edit_distance(w, x)) <= 2 and abs(len(w) - len(x)) <= 2])}
    assert got == want and len(want) == len(typed)


# Snippets


def test_snippets(spark, index):
    text = "One two three. Four (red) boats, five six seven eight."
    assert snippets.snippet(text, ["red", "boat"], 26) == "...three. Four ([red]) [boats],..."
    assert snippets.snippet(text, ["zebra"], 12) == "One two..."
    assert snippets.snippet("", ["x"]) == "" and snippets.snippet("word", ["word"], 2) == "[word]" and snippets.snippet("word", ["word"], 9) == "[word]"
    assert snippets.snippet("café crème", ["creme"], 99) == "café [crème]"
    rows = snippets.with_snippets(ranking.run_query(index, "boat"), index.corpus, ["boat"], 40).collect()
    assert all("[" in r.snippet for r in rows)


# Evaluation


def test_metrics(spark, index):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "z", 11)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "y", 1), ("q", "z", 2), ("q", "x", 0), ("r", "x", 1)], "query_id string, doc_id string, grade int")
    rows = {r.query_id: r for r in evaluation.metrics(ranked, qrels).collect()}
    assert rows["q"].ndcg_10 == pytest.approx((1 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert rows["q"].precision_10 == 0.1 and rows["q"].recall_100 == 1.0 and rows["r"].ndcg_10 == 0
    queries = spark.createDataFrame([("q1", "Red boats?"), ("q2", "nothing known")], "query_id string, text string")
    judged = spark.createDataFrame([("q1", "a", 1)], "query_id string, doc_id string, grade int")
    r = evaluation.evaluate(index, queries, judged).first()
    assert r.judged == 1 and r.unjudged == 1 and r.recall_100 == 1.0
    times = evaluation.latencies(spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "ms double")).first()
    assert times.p50 == 2.0 and times.p95 == pytest.approx(9.2)
    assert evaluation.pool_sum(spark, 11).first().total == 385
