"""The queries of the engine over the driver's tables, and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from .functions import text as tx
from .functions.web import canonical_column, collapse_column, host_column, parsed_html
from .operators import crawl, evaluation, lexicon, links, matching, ranking, snippets
from .operators.index import Index, index_sizes, store_index, update_index, violations
from .plans.language import scoring_terms
from .sources.corpus import json_field, result_lines
from .storage import shared_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_INDEXES: dict[tuple[str, str], Index] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "title", F.col("text").alias("body"))


def index_of(spark: SparkSession, d: str) -> Index:
    """The stored index of a folder's documents: built by the session's first query that needs it, read by the others."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = store_index(corpus(spark, d), f"{shared_folder(spark)}/index-{sha1(d.encode()).hexdigest()[:12]}", texts=False)
    return _INDEXES[key]


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _words(spark: SparkSession, d: str) -> DataFrame:
    both = spread(corpus(spark, d)).select(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("x"))
    return both.select(F.explode(tx.pieces_column(F.col("x"))).alias("piece")).distinct()


# Text analysis


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\r\t\x0B\f]+'), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS position, unnest(l) AS token FROM t""")
def tokenize_terms(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(tx.tokens_column(F.col("text"))).alias("position", "token"))
    return rows


@query(f"WITH {O.CORPUS}, {O.PIECES} SELECT piece, term FROM normal")
def normalize_terms(spark, d):
    return _words(spark, d).select("piece", tx.normalize_column(F.col("piece")).alias("term"))


@query(f"WITH {O.CORPUS}, {O.PIECES} SELECT DISTINCT term, term IN ({O.STOP_LIST}) AS stopword FROM normal WHERE term <> ''")
def stopword_filter(spark, d):
    terms = _words(spark, d).select(tx.normalize_column(F.col("piece")).alias("term")).filter(F.col("term") != "").distinct()
    return terms.select("term", tx.stopword_column(F.col("term")).alias("stopword"))


@query(f"WITH {O.CORPUS}, {O.PIECES}, {O.STEMS} SELECT term, stem FROM stems")
def stem_vocabulary(spark, d):
    terms = _words(spark, d).select(tx.normalize_column(F.col("piece")).alias("term")).filter(F.col("term") != "").distinct()
    return terms.select("term", tx.stem_column(F.col("term")).alias("stem"))


@query(f"{O.INDEX} SELECT doc_id, position::INTEGER AS position, term FROM tokens")
def analyze_positions(spark, d):
    rows = tx.analyzed(corpus(spark, d)).select("doc_id", F.explode("terms").alias("t"))
    return rows.select("doc_id", F.explode("t.positions").alias("position"), "t.term")


# Index


@query(f"{O.INDEX} SELECT (SELECT count(*) FROM docs_) AS documents, (SELECT count(*) FROM df_) AS terms, (SELECT count(*) FROM postings_) AS postings")
def index_stats(spark, d):
    return index_of(spark, d).counts()


@query(f"{O.INDEX} SELECT term, df FROM df_")
def index_terms_df(spark, d):
    return index_of(spark, d).terms


@query(f"{O.INDEX} SELECT doc_id, tf::INTEGER AS tf FROM postings_ WHERE term = 'river'")
def postings_tf(spark, d):
    return index_of(spark, d).postings_of("Rivers").select("doc_id", "tf")


@query(f"{O.INDEX} SELECT doc_id, unnest(positions)::INTEGER AS position FROM postings_ WHERE term = 'lantern'")
def positions_of_term(spark, d):
    return index_of(spark, d).postings_of("lantern").select("doc_id", F.explode("positions").alias("position"))


@query(f"{O.INDEX} SELECT doc_id, length FROM docs_")
def document_lengths(spark, d):
    return index_of(spark, d).docs.select("doc_id", "length")


@query(f"{O.INDEX} SELECT round(av, 6) AS average_length, round(avt, 6) AS average_title FROM stats_")
def corpus_averages(spark, d):
    return index_of(spark, d).averages().select(F.round("average_length", 6).alias("average_length"), F.round("average_title", 6).alias("average_title"))


@query(f"{O.INDEX} SELECT doc_id, title_span::INTEGER AS title_span, title_terms FROM docs_")
def title_fields(spark, d):
    return index_of(spark, d).docs.select("doc_id", "title_span", "title_terms")


@query(f"{O.INDEX} SELECT position::INTEGER AS position, term FROM tokens WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def document_term_stream(spark, d):
    last = table(spark, d, "documents").agg(F.max("doc_id").alias("m")).scalar()
    return index_of(spark, d).document_terms(last)


def _bytes(x: str) -> str:
    return f"greatest(1, ceil(length(bin({x})) / 7))::BIGINT"


@query(f"""{O.INDEX},
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM docs_),
    gaps AS (SELECT tf, ord - coalesce(lag(ord) OVER (PARTITION BY term ORDER BY ord), 0) AS g FROM postings_ JOIN ranked USING (doc_id)),
    steps AS (SELECT position - coalesce(lag(position) OVER (PARTITION BY doc_id, term ORDER BY position), 0) AS s FROM tokens),
    a AS (SELECT count(*) * 24 AS p, sum(tf) * 8 AS pp, sum({_bytes("g")} + 2 * {_bytes("tf")}) AS c FROM gaps),
    b AS (SELECT sum({_bytes("s")}) AS cp FROM steps),
    w AS (SELECT sum(strlen(term) + 16) AS w, sum(strlen(term) + {_bytes("strlen(term)")} + {_bytes("df")}) AS cw FROM df_),
    d AS (SELECT sum(strlen(doc_id::VARCHAR) + 32) + 8 AS d FROM docs_),
    x AS (SELECT unnest([['plain', 'header', '73'], ['plain', 'documents', d::VARCHAR], ['plain', 'dictionary', w::VARCHAR], ['plain', 'postings', p::VARCHAR], ['plain', 'positions', pp::VARCHAR],
        ['delta', 'header', '73'], ['delta', 'documents', d::VARCHAR], ['delta', 'dictionary', w::VARCHAR], ['delta', 'postings', p::VARCHAR], ['delta', 'positions', pp::VARCHAR],
        ['varbyte', 'header', '73'], ['varbyte', 'documents', d::VARCHAR], ['varbyte', 'dictionary', cw::VARCHAR], ['varbyte', 'postings', c::VARCHAR], ['varbyte', 'positions', cp::VARCHAR]]) AS r FROM a, b, w, d)
    SELECT r[1] AS encoding, r[2] AS section, r[3]::BIGINT AS bytes FROM x""")
def index_size_model(spark, d):
    return index_sizes(index_of(spark, d))


@query("""WITH a AS (SELECT doc_id, coalesce(title, '') AS t, CASE WHEN source = 'forum' THEN '' ELSE coalesce(text, '') END AS b FROM documents WHERE published_at < TIMESTAMP '2023-01-01'),
    b AS (SELECT doc_id, coalesce(title, '') AS t, coalesce(text, '') AS b FROM documents WHERE coalesce(source, '') <> 'glossary')
    SELECT count(*) FILTER (a.doc_id IS NULL) AS added, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND (a.t <> b.t OR a.b <> b.b)) AS updated,
           count(*) FILTER (b.doc_id IS NULL) AS removed, count(*) FILTER (a.t = b.t AND a.b = b.b) AS unchanged FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def incremental_diff(spark, d):
    from .operators.index import build_index

    rows = table(spark, d, "documents")
    before = rows.filter("published_at < TIMESTAMP '2023-01-01'").select("doc_id", "title", F.when(F.col("source") == "forum", "").otherwise(F.col("text")).alias("body"))
    after = rows.filter("coalesce(source, '') <> 'glossary'").select("doc_id", "title", F.col("text").alias("body"))
    return update_index(build_index(before), after)[1]


@query(f"{O.INDEX} SELECT term, df FROM df_")
def index_merge(spark, d):
    from .operators.index import build_index, merge_indexes

    rows = table(spark, d, "documents").withColumnRenamed("text", "body")
    encyclopedia = F.coalesce(F.col("source"), F.lit("")) == "wiki_dump"
    return merge_indexes(build_index(rows.filter(encyclopedia)), build_index(rows.filter(~encyclopedia))).terms


@query("SELECT NULL::VARCHAR AS rule, NULL::BIGINT AS rows WHERE false")
def index_violations(spark, d):
    return violations(index_of(spark, d))


# Boolean and phrase queries


def _docs_with(*terms: str) -> str:
    return ", ".join(f"t{i} AS (SELECT doc_id FROM postings_ WHERE term = '{t}')" for i, t in enumerate(terms))


def _matching(name: str, text: str, sql: str) -> None:
    def run(spark, d):
        return matching.matches(index_of(spark, d), text)

    run.__name__ = name
    query(f"{O.INDEX}, {sql}")(run)


_matching("match_and", "river AND lantern", _docs_with("river", "lantern") + " SELECT * FROM t0 INTERSECT SELECT * FROM t1")
_matching("match_or", "glacier OR violin", _docs_with("glacier", "violin") + " SELECT * FROM t0 UNION SELECT * FROM t1")
_matching("match_not", "NOT index", _docs_with("index") + " SELECT doc_id FROM docs_ EXCEPT SELECT * FROM t0")
_matching("match_nested", "river AND (bridge OR NOT temple)", _docs_with("river", "bridg", "templ") + " SELECT * FROM t0 INTERSECT (SELECT * FROM t1 UNION (SELECT doc_id FROM docs_ EXCEPT SELECT * FROM t2))")
_matching("match_stopword", "the river", _docs_with("river") + " SELECT * FROM t0")
_matching("match_phrase", '"older sources disagree"', "x AS (SELECT a.doc_id FROM tokens a JOIN tokens b ON b.doc_id = a.doc_id AND b.position = a.position + 1 JOIN tokens c ON c.doc_id = a.doc_id AND c.position = a.position + 2 WHERE a.term = 'older' AND b.term = 'sourc' AND c.term = 'disagre') SELECT DISTINCT doc_id FROM x")
_matching("match_phrase_gap", '"one names the river"', "x AS (SELECT a.doc_id FROM tokens a JOIN tokens b ON b.doc_id = a.doc_id AND b.position = a.position + 1 JOIN tokens c ON c.doc_id = a.doc_id AND c.position = a.position + 3 WHERE a.term = 'on' AND b.term = 'name' AND c.term = 'river') SELECT DISTINCT doc_id FROM x")
_matching("match_compound_word", "sources-disagree/one", "x AS (SELECT a.doc_id FROM tokens a JOIN tokens b ON b.doc_id = a.doc_id AND b.position = a.position + 1 JOIN tokens c ON c.doc_id = a.doc_id AND c.position = a.position + 2 WHERE a.term = 'sourc' AND b.term = 'disagre' AND c.term = 'on') SELECT DISTINCT doc_id FROM x")


@query(f"{O.INDEX}, {_docs_with('river', 'index', 'crawler')} SELECT * FROM t0 INTERSECT SELECT * FROM t1 INTERSECT SELECT * FROM t2")
def set_and(spark, d):
    return matching.intersect(index_of(spark, d), ["river", "index", "crawler"])


@query(f"{O.INDEX}, {_docs_with('glacier', 'violin')} SELECT * FROM t0 UNION SELECT * FROM t1")
def set_or(spark, d):
    return matching.unite(index_of(spark, d), ["glacier", "violin"])


@query(f"{O.INDEX}, {_docs_with('river', 'index')} SELECT * FROM t0 EXCEPT SELECT * FROM t1")
def set_andnot(spark, d):
    return matching.subtract(index_of(spark, d), "river", "index")


# Ranking


def _ranking(name: str, words: list[str], scorer: str, sql: str) -> None:
    def run(spark, d):
        return ranking.scored(index_of(spark, d), ranking.query_terms(words), scorer).select("doc_id", F.round("score", 4).alias("score"))

    run.__name__ = name
    query(f"{O.INDEX} SELECT doc_id, round(sum(w), 4) AS score FROM ({sql}) GROUP BY doc_id")(run)


_ranking("rank_tfidf", ["river", "lantern"], "tfidf", O.tfidf("p.term IN ('river', 'lantern')"))
_ranking("rank_bm25", ["river", "lantern"], "bm25", O.bm25("p.term IN ('river', 'lantern')"))
_ranking("rank_bm25f", ["river", "lantern"], "bm25f", O.bm25f("p.term IN ('river', 'lantern')"))
_ranking("rank_bm25_repeated_term", ["river", "river"], "bm25", f"SELECT * FROM ({O.bm25(chr(39) + 'river' + chr(39) + ' = p.term')}), (VALUES (1), (2))")

_BEST = "SELECT doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS nth FROM ({})) WHERE nth <= {}"


@query(f"{O.INDEX} " + _BEST.format(f"SELECT doc_id, sum(w) AS score FROM ({O.bm25('p.term IN (' + chr(39) + 'glacier' + chr(39) + ', ' + chr(39) + 'violin' + chr(39) + ')')}) GROUP BY doc_id", 10))
def topk_bm25(spark, d):
    rows = ranking.scored(index_of(spark, d), ["glacier", "violin"]).withColumn("score", F.round("score", 9))
    return ranking.top_k(rows, 10).select("doc_id", F.round("score", 4).alias("score"))


@query(f"{O.INDEX} SELECT doc_id || chr(9) || format('{{:.4f}}', score) AS line FROM (SELECT doc_id, sum(w) AS score FROM ({O.tfidf('p.term = ' + chr(39) + 'violin' + chr(39))}) GROUP BY doc_id)")
def result_lines_tsv(spark, d):
    return result_lines(ranking.scored(index_of(spark, d), ["violin"], "tfidf"), tsv=True)


@query(f"""{O.INDEX}, {_docs_with('river', 'bridg', 'templ')}, m AS (SELECT * FROM t0 INTERSECT (SELECT * FROM t1 UNION (SELECT doc_id FROM docs_ EXCEPT SELECT * FROM t2))),
    s AS (SELECT doc_id, sum(w) AS score FROM ({O.bm25("p.term IN ('river', 'bridg', 'templ')")}) GROUP BY doc_id)
    SELECT m.doc_id, round(coalesce(score, 0), 4) AS score FROM m LEFT JOIN s ON s.doc_id = m.doc_id""")
def query_boolean_ranked(spark, d):
    rows = ranking.run_query(index_of(spark, d), "river AND (bridge OR NOT temple)", limit=None)
    return rows.select("doc_id", F.round("score", 4).alias("score"))


_QUERY_WORDS = rf"""q_ AS (SELECT DISTINCT query_id, text FROM judged_queries WHERE text IS NOT NULL),
    qp_ AS (SELECT query_id, list_filter(regexp_split_to_array(translate(regexp_replace(text, '["()]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {O._SPLIT}), lambda x: x <> '') AS p FROM q_),
    qw_ AS (SELECT query_id, unnest(p) AS piece FROM qp_),
    qn_ AS (SELECT query_id, {O._normal("piece")} AS term FROM qw_)"""


def _query_stems(words: str = "qn_", name: str = "qs_") -> str:
    chain = f"SELECT term, CASE WHEN left(term, 1) = 'y' THEN 'Y' || substr(term, 2) ELSE term END AS w FROM (SELECT DISTINCT term FROM {words} WHERE term <> '')"
    for step in O._STEPS:
        chain = f"SELECT term, {step} AS w FROM ({chain})"
    return f"{name} AS (SELECT term, CASE WHEN strlen(term) <= 2 THEN term WHEN left(w, 1) = 'Y' THEN 'y' || substr(w, 2) ELSE w END AS stem FROM ({chain}))"


@query(f"""{O.INDEX}, {_QUERY_WORDS}, {_query_stems()},
    qt_ AS (SELECT query_id, stem AS term FROM qn_ JOIN qs_ USING (term) WHERE term NOT IN ({O.STOP_LIST})),
    w_ AS ({O.bm25("p.term IN (SELECT term FROM qt_)")}),
    s_ AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM qt_ JOIN w_ USING (term) GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, round(score, 3) AS score, nth::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nth FROM s_) WHERE nth <= 10""")
def batch_topk_bm25(spark, d):
    log = table(spark, d, "judged_queries").filter("text IS NOT NULL").dropDuplicates(["query_id", "text"])
    return ranking.batch_top_k(index_of(spark, d), evaluation.bags(log), 10, digits=6).withColumn("score", F.round("score", 3))


# The forms of the judged queries, each taken apart on its own: a phrase, word AND (word OR word), word AND NOT word, NOT word, words.
# need are the words that must all be there, any those of which one must, not those that must not.
_FORMS = rf"""b_ AS (SELECT row_number() OVER () AS id, query_id, text, regexp_full_match(text, '\s*"[^"]*"\s*') AS phrased FROM (SELECT DISTINCT query_id, text FROM judged_queries WHERE text IS NOT NULL)),
    bp_ AS (SELECT id, CASE WHEN phrased THEN 'phrase' ELSE 'need' END AS part, list_filter(regexp_split_to_array(CASE WHEN phrased THEN replace(text, '"', '') ELSE regexp_replace(text, '(AND NOT \S+|AND \([^)]*\)|^NOT \S+)\s*$', '') END, {O._SPLIT}), lambda x: x NOT IN ('', 'AND')) AS p FROM b_
        UNION ALL SELECT id, 'any', string_split(regexp_extract(text, 'AND \(([^)]*)\)', 1), ' OR ') FROM b_ WHERE regexp_matches(text, 'AND \(') UNION ALL SELECT id, 'not', [regexp_extract(text, 'NOT (\S+)\s*$', 1)] FROM b_ WHERE regexp_matches(text, 'NOT \S+\s*$')),
    bw_ AS (SELECT id, part, unnest(p) AS piece, generate_subscripts(p, 1) AS place FROM bp_),
    bn_ AS (SELECT id, part, place, {O._normal("piece")} AS term FROM bw_),
    {_query_stems("bn_", "bs_")},
    bt_ AS (SELECT id, part, place, stem AS term FROM bn_ JOIN bs_ USING (term) WHERE term NOT IN ({O.STOP_LIST})),
    bk_ AS (SELECT id, count(DISTINCT term) FILTER (part = 'need') AS need, count(*) FILTER (part = 'phrase') AS phrase, count(*) FILTER (part = 'any') AS one FROM bt_ GROUP BY id),
    bm_ AS (SELECT t.id, doc_id, count(DISTINCT t.term) FILTER (part = 'need') AS need, count(*) FILTER (part = 'any') AS one, count(*) FILTER (part = 'not') AS no FROM bt_ t JOIN postings_ p ON p.term = t.term WHERE part <> 'phrase' GROUP BY ALL),
    bh_ AS (SELECT DISTINCT id, doc_id FROM (SELECT t.id, doc_id, position - place AS start, count(*) AS n FROM bt_ t JOIN tokens k ON k.term = t.term WHERE part = 'phrase' GROUP BY ALL) x JOIN bk_ USING (id) WHERE n = phrase),
    bf_ AS (SELECT id, doc_id FROM bm_ JOIN bk_ k USING (id) WHERE bm_.need = k.need AND (k.one = 0 OR bm_.one > 0) AND no = 0 UNION SELECT id, doc_id FROM bh_
        UNION SELECT id, doc_id FROM (SELECT id FROM bk_ WHERE need = 0 AND phrase = 0 AND one = 0) k, docs_ WHERE NOT EXISTS (SELECT 1 FROM bm_ WHERE bm_.id = k.id AND bm_.doc_id = docs_.doc_id))"""


@query(f"""{O.INDEX}, {_FORMS}, w_ AS ({O.bm25("p.term IN (SELECT term FROM bt_)")}),
    s_ AS (SELECT t.id, w_.doc_id, sum(w) AS score FROM bt_ t JOIN w_ USING (term) GROUP BY ALL),
    r_ AS (SELECT f.id, f.doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY f.id ORDER BY round(coalesce(score, 0), 9) DESC, f.doc_id) AS nth FROM bf_ f LEFT JOIN s_ ON s_.id = f.id AND s_.doc_id = f.doc_id)
    SELECT query_id, doc_id, round(score, 3) AS score, nth::INTEGER AS rank FROM r_ JOIN b_ USING (id) WHERE nth <= 10""")
def batch_boolean_search(spark, d):
    log = table(spark, d, "judged_queries").dropDuplicates(["query_id", "text"])
    return ranking.batch_search(index_of(spark, d), log).select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


@query(f"""WITH {_FORMS.split(", bk_ AS")[0] if ", bk_ AS" in _FORMS else _FORMS.split("bk_ AS")[0].rstrip().rstrip(",")},
    n_ AS (SELECT b_.id, any_value(query_id) AS query_id, any_value(text) AS text, count(DISTINCT term) FILTER (part = 'need') AS need, count(term) FILTER (part = 'phrase') AS phrase, count(term) FILTER (part = 'any') AS one, count(term) FILTER (part = 'not') AS no,
        string_agg(term, ' ' ORDER BY CASE part WHEN 'need' THEN 0 WHEN 'phrase' THEN 0 ELSE 1 END, place) AS terms FROM b_ LEFT JOIN bt_ USING (id) GROUP BY b_.id)
    SELECT query_id, coalesce(terms, '') AS terms, no > 0 AND need + phrase + one = 0 AS open,
        CASE WHEN need + phrase + one + no = 0 THEN NULL WHEN phrase > 1 THEN 'phrase' WHEN no > 0 OR one > 1 AND need > 0 THEN 'table' WHEN one > 1 THEN 'any' ELSE 'all' END AS shape,
        CASE WHEN regexp_full_match(text, '\\s*') THEN 'empty query' END AS error FROM n_ UNION ALL SELECT DISTINCT query_id, '', false, NULL, 'empty query' FROM judged_queries WHERE text IS NULL""")
def parse_query_log(spark, d):
    rows = ranking.parsed_queries(table(spark, d, "judged_queries").dropDuplicates(["query_id", "text"]))
    return rows.select("query_id", F.array_join("terms", " ").alias("terms"), "open", "shape", "error")


# Links: a graph of keys, as in the oracle


def _edges(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


_EDGES = "SELECT 'p' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"


def _urls(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    url = F.concat(F.lit("http://h"), (k % 10).cast("string"), F.lit(".test/"), F.when(k >= 10, k.cast("string")).otherwise(""))
    return table(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("doc_id"), url.alias("url"), k.alias("ord"))


_HOSTS = "h_ AS (SELECT 'p' || p_partkey AS doc_id, 'h' || (p_partkey % 10) || '.test' AS host, p_partkey < 10 AS home FROM part)"
_ROUNDS = 30


@query(f"WITH {O.pagerank(_EDGES, _ROUNDS)} SELECT page, round(score, 9) AS score FROM r{_ROUNDS}_")
def pagerank_page(spark, d):
    return links.pagerank(_edges(spark, d), _ROUNDS).select("page", F.round("score", 9).alias("score"))


_SITE = f"""{_HOSTS}, se_ AS (SELECT DISTINCT a.host AS src, b.host AS dst FROM ({_EDGES}) e JOIN h_ a ON a.doc_id = e.src JOIN h_ b ON b.doc_id = e.dst WHERE a.host <> b.host),
    {O.pagerank("SELECT * FROM se_", _ROUNDS)}"""


@query(f"WITH {_SITE} SELECT doc_id AS page, round(score, 9) AS score FROM r{_ROUNDS}_ JOIN h_ ON host = page WHERE home")
def site_pagerank(spark, d):
    return links.site_pagerank(_edges(spark, d), _urls(spark, d), _ROUNDS).select("page", F.round("score", 9).alias("score"))


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM ({_EDGES})), l0 AS (SELECT 'p1' AS url), l1 AS (SELECT DISTINCT dst AS url FROM e JOIN l0 ON src = url WHERE dst NOT IN (SELECT url FROM l0)),
    l2 AS (SELECT DISTINCT dst AS url FROM e JOIN l1 ON src = url WHERE dst NOT IN (SELECT url FROM l0 UNION SELECT url FROM l1))
    SELECT url, 0 AS depth FROM l0 UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2""")
def crawl_levels(spark, d):
    return crawl.frontier_levels(spark.createDataFrame([("p1",)], "url string"), _edges(spark, d), 2)


@query(f"""WITH {_HOSTS} SELECT page_id, host FROM (SELECT 'p' || p_partkey AS page_id, 'h' || (p_partkey % 10) || '.test' AS host, CASE WHEN p_partkey < 10 THEN '/' ELSE '/' || p_partkey END AS path FROM part)
    WHERE NOT (host = 'h3.test' AND path LIKE '/1%') AND NOT (host = 'h4.test' AND path <> '/')""")
def robots_allowed(spark, d):
    rules = [("h3.test", "User-agent: *\nDisallow: /1\nCrawl-delay: 2"), ("h4.test", "User-agent: *\nDisallow: /\n\nUser-agent: lume\nDisallow: /*\nAllow: /$\nAllow: /$"), ("h5.test", "User-agent: other\nDisallow: /")]
    pages = _urls(spark, d).select(F.col("doc_id").alias("page_id"), "url")
    kept = crawl.allowed_pages(pages, spark.createDataFrame(rules, "host string, text string"), "lumetext")
    return kept.select("page_id", host_column(F.col("url")).alias("host"))


@query(f"WITH {_HOSTS} SELECT doc_id AS page, round(1.0 / (SELECT count(*) FROM h_ WHERE home), 9) AS score FROM h_ WHERE home")
def home_page_prior(spark, d):
    return links.home_page_ranking(_urls(spark, d)).select("page", F.round("score", 9).alias("score"))


def _numbers(ranks: DataFrame) -> DataFrame:
    """Page names as the documents' ids."""
    return ranks.select(F.expr("try_cast(substring(page, 2) AS BIGINT)").alias("doc_id"), "score")


_PRIOR = f"pr_ AS (SELECT substr(page, 2)::BIGINT AS doc_id, score FROM r{_ROUNDS}_), np_ AS (SELECT count(*) AS np FROM pr_)"


@query(f"""{O.INDEX}, {O.pagerank(_EDGES, _ROUNDS)}, {_PRIOR}, s_ AS (SELECT doc_id, sum(w) AS score FROM ({O.bm25("p.term = 'river'")}) GROUP BY doc_id)
    SELECT s_.doc_id, round(s_.score * (1 + 0.5 * ln(1 + np * coalesce(pr_.score, 0))), 4) AS score FROM s_ LEFT JOIN pr_ ON pr_.doc_id = s_.doc_id, np_""")
def query_with_prior(spark, d):
    prior = ranking.Prior(_numbers(links.pagerank(_edges(spark, d), _ROUNDS)))
    return ranking.run_query(index_of(spark, d), "river", None, prior=prior, strength=0.5).select("doc_id", F.round("score", 4).alias("score"))


@query(f"""{O.INDEX}, {_docs_with('river', 'index', 'crawler')}, m AS (SELECT * FROM t0 INTERSECT SELECT * FROM t1 INTERSECT SELECT * FROM t2),
    s_ AS (SELECT doc_id, sum(w) AS score FROM ({O.bm25("p.term IN ('river', 'index', 'crawler')")}) GROUP BY doc_id)
    SELECT doc_id, round(score, 4) AS score FROM s_ WHERE doc_id IN (SELECT doc_id FROM m)""")
def query_prior_short_only(spark, d):
    prior = ranking.Prior(_numbers(links.home_page_ranking(_urls(spark, d))))
    return ranking.run_query(index_of(spark, d), "river index crawler", None, prior=prior, strength=1.0, max_words=2).select("doc_id", F.round("score", 4).alias("score"))


# Dictionary


@query(f"{O.INDEX} SELECT term, levenshtein(term, 'lanten')::INTEGER AS distance, df FROM df_ WHERE levenshtein(term, 'lanten') <= 2")
def suggest_terms(spark, d):
    return lexicon.near_terms(index_of(spark, d).terms, "lanten", 2)


@query(f"{O.INDEX} SELECT term, df FROM df_ WHERE starts_with(term, 'la') ORDER BY df DESC, term LIMIT 10")
def complete_prefix(spark, d):
    return lexicon.complete(index_of(spark, d), "LÀ", 10)


@query("SELECT p_partkey, levenshtein(coalesce(p_name, ''), coalesce(p_brand, ''))::INTEGER AS distance FROM part")
def edit_distance_pairs(spark, d):
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return table(spark, d, "part").select("p_partkey", lexicon.edit_distance_column(c("p_name"), c("p_brand")).alias("distance"))


@query(f"""{O.INDEX}, {_QUERY_WORDS}, {_query_stems()},
    typed_ AS (SELECT DISTINCT substr(piece, 1, 2) || substr(piece, 4) AS piece FROM qw_ UNION SELECT DISTINCT piece FROM qw_), tn_ AS (SELECT piece AS word, {O._normal("piece")} AS term FROM typed_), {_query_stems("tn_", "ts_")},
    own_ AS (SELECT word, stem AS own, coalesce(df, 0) AS own_df FROM tn_ JOIN ts_ USING (term) LEFT JOIN df_ ON df_.term = stem WHERE tn_.term NOT IN ({O.STOP_LIST})),
    dn_ AS (SELECT term AS raw, {O._normal("term")} AS term FROM df_), {_query_stems("dn_", "ds_")}, fix_ AS (SELECT raw FROM dn_ JOIN ds_ USING (term) WHERE stem = raw AND dn_.term NOT IN ({O.STOP_LIST})),
    near_ AS (SELECT own, df_.term, df, levenshtein(own, df_.term) AS distance FROM (SELECT DISTINCT own FROM own_) o JOIN df_ ON abs(strlen(own) - strlen(df_.term)) <= 2 WHERE levenshtein(own, df_.term) <= CASE WHEN strlen(own) <= 4 THEN 1 ELSE 2 END),
    ten_ AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY distance, df DESC, term) AS nth FROM near_ QUALIFY nth <= 10)
    SELECT word, arg_min(term, nth) AS better, own_df > 0 AS known FROM own_ JOIN ten_ USING (own) WHERE (own_df = 0 OR strlen(own) >= 4) AND distance > 0 AND df >= 100 * own_df AND term IN (SELECT raw FROM fix_) GROUP BY word, own_df""")
def correct_queries(spark, d):
    """Every word of the query log, as it is and without its third letter."""
    clean = F.regexp_replace(F.lower("text"), '["()]', "")
    typed = table(spark, d, "judged_queries").filter("text IS NOT NULL").select(F.explode(tx.pieces_column(clean)).alias("word")).distinct()
    return lexicon.correct_words(index_of(spark, d), typed.unionByName(typed.select(F.expr("concat(substring(word, 1, 2), substring(word, 4))").alias("word"))))


_WORDISH = "0-9A-Za-z\\x{80}-\\x{10FFFF}"

# The excerpt of each match: its words with their places in bytes, every window of 160 bytes, the best of them, and its words with marks.
_EXCERPTS = rf"""x_ AS (SELECT doc_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(text, '') AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM m_)),
    a_ AS (SELECT doc_id, x, regexp_extract_all(x, '[^ \n\r\t\x0B\f]+') AS t, regexp_extract_all(x, '[ \n\r\t\x0B\f]+') AS w, regexp_matches(x, '^[ \n\r\t\x0B\f]') AS led FROM x_),
    k_ AS (SELECT doc_id, x, i, t[i] AS token, coalesce(CASE WHEN led THEN w[i] WHEN i > 1 THEN w[i - 1] END, '') AS gap FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM a_)),
    o_ AS (SELECT *, sum(strlen(gap) + strlen(token)) OVER (PARTITION BY doc_id ORDER BY i) AS till FROM k_),
    hw_ AS (SELECT token, unnest(list_filter(regexp_split_to_array(token, {O._SPLIT}), lambda p: p <> '')) AS piece FROM (SELECT DISTINCT token FROM k_)),
    hit_ AS (SELECT token, min(CASE stem WHEN 'river' THEN 0 ELSE 1 END) AS hit FROM (SELECT token, {O._normal("piece")} AS term FROM hw_) JOIN stems USING (term) WHERE term NOT IN ({O.STOP_LIST}) AND stem IN ('river', 'lantern') GROUP BY token),
    e_ AS (SELECT o_.*, till - strlen(token) AS start, hit FROM o_ LEFT JOIN hit_ USING (token)),
    v_ AS (SELECT a.doc_id, a.i, a.start, max(b.i) AS j, max(b.till) AS till, count(DISTINCT b.hit) FILTER (b.till - a.start <= 160) AS kinds, count(b.hit) FILTER (b.till - a.start <= 160) AS hits
        FROM e_ a JOIN e_ b ON b.doc_id = a.doc_id AND b.i >= a.i AND (b.till - a.start <= 160 OR b.i = a.i) GROUP BY ALL),
    best_ AS (SELECT * FROM v_ QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kinds DESC, hits DESC, i) = 1),
    cut_ AS (SELECT b.doc_id, CASE WHEN any_value(b.start) > 0 THEN '...' ELSE '' END
        || string_agg(CASE WHEN e.i = b.i THEN '' ELSE gap END || CASE WHEN hit IS NOT NULL AND regexp_matches(token, '[{_WORDISH}]') THEN regexp_replace(token, '^([^{_WORDISH}]*)(.*?)([^{_WORDISH}]*)$', '\1[\2]\3', 's') ELSE token END, '' ORDER BY e.i)
        || CASE WHEN any_value(b.till) < any_value(strlen(x)) THEN '...' ELSE '' END AS snippet FROM best_ b JOIN e_ e ON e.doc_id = b.doc_id AND e.i BETWEEN b.i AND b.j GROUP BY b.doc_id)"""


@query(f"""{O.INDEX}, {_docs_with('river', 'lantern')}, m_ AS (SELECT * FROM t0 INTERSECT SELECT * FROM t1), {_EXCERPTS},
    s_ AS (SELECT doc_id, sum(w) AS score FROM ({O.bm25("p.term IN ('river', 'lantern')")}) GROUP BY doc_id) SELECT cut_.doc_id, round(score, 4) AS score, snippet FROM cut_ JOIN s_ USING (doc_id)""")
def query_with_snippets(spark, d):
    ix = index_of(spark, d)
    return snippets.with_snippets(ranking.run_query(ix, "river lantern", None), ix.corpus, scoring_terms("river lantern")).withColumn("score", F.round("score", 4))


# Web


def _collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\x0b\f]+', ' ', 'g'), ' ')"


@query(f"""WITH p AS (SELECT DISTINCT page_id, coalesce(title, '') AS t, coalesce(text, '') AS x FROM html_pages)
    SELECT page_id, {_collapsed("t")} AS title, {_collapsed("t || ' ' || x")} AS text FROM p""")
def html_title_text(spark, d):
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = table(spark, d, "html_pages").select("page_id", "title", "text").distinct()
    html = F.concat(F.lit("<html><head><TITLE>"), esc(F.col("title")), F.lit("</TITLE><script>if (a<b) {}</script></head><body><!-- x > y --><p>"), esc(F.col("text")), F.lit("</p></body></html>"))
    return parsed_html(rows.select("page_id", html.alias("html"))).select("page_id", "title", "text")


_CANON = r"""c_ AS (
    SELECT page_id, url, lower(regexp_extract(url, '^([^:]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]*://([^/?#:]+)', 1)) AS host,
           regexp_extract(url, '^[^:]*://[^/?#:]+:([0-9]+)', 1) AS port, regexp_extract(url, '^[^:]*://[^/?#:]+(?::[0-9]+)?(/[^?#]*)', 1) AS path, regexp_extract(url, '^[^#?]*\?([^#]*)', 1) AS query
    FROM (SELECT DISTINCT page_id, url FROM crawled_pages WHERE url IS NOT NULL)),
    n_ AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')) AS parts FROM c_ WHERE scheme IN ('http', 'https') AND host <> '')"""


@query(f"""WITH {_CANON} SELECT page_id, scheme || '://' || host || CASE WHEN port = '' OR port = CASE scheme WHEN 'http' THEN '80' ELSE '443' END THEN '' ELSE ':' || port END
    || '/' || array_to_string(parts, '/') || CASE WHEN len(parts) > 0 AND suffix(path, '/') THEN '/' ELSE '' END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM n_""")
def url_normalize(spark, d):
    rows = table(spark, d, "crawled_pages").select("page_id", "url").distinct()
    return rows.select("page_id", canonical_column(F.col("url")).alias("canonical")).filter("canonical IS NOT NULL")


@query(f"WITH {_CANON} SELECT host, count(*) AS pages FROM n_ GROUP BY host")
def host_of_url(spark, d):
    rows = table(spark, d, "crawled_pages").select("page_id", host_column(F.col("url")).alias("host")).distinct()
    return rows.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


@query("""WITH p AS (SELECT DISTINCT page_id, text FROM crawled_pages), f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY page_id) AS nth FROM p)
    SELECT page_id FROM f WHERE nth = 1 OR text IS NULL""")
def content_dedup(spark, d):
    return crawl.first_bodies(table(spark, d, "crawled_pages").select("page_id", "text").distinct()).select("page_id")


@query(r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x08]+', ' ', 'g'), ' ') AS text FROM documents")
def collapse_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", collapse_column(F.coalesce("text", F.lit(""))).alias("text"))


@query("SELECT event_id, event_type AS title, NULL::VARCHAR AS k FROM events")
def json_string_field(spark, d):
    line = F.expr("""concat(left(props, length(props) - 1), ', "title": "', event_type, '", "deep": {"title": "no"}}')""")
    rows = table(spark, d, "events").select("event_id", line.alias("line"))
    return rows.select("event_id", json_field(F.col("line"), "title").alias("title"), json_field(F.col("line"), "k").alias("k"))


# Evaluation

#: CTEs h (query_id, dcg, top, found) and i (query_id, best, relevant) of a ranking k and judgements j.
_JUDGED_METRICS = """h AS (SELECT query_id, sum(grade / log2(rank + 1)) FILTER (rank <= 10) AS dcg, count(*) FILTER (rank <= 10) AS top, count(*) FILTER (rank <= 100) AS found FROM k JOIN j USING (query_id, doc_id) GROUP BY query_id),
    i AS (SELECT query_id, sum(grade / log2(n + 1)) FILTER (n <= 10) AS best, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM j) GROUP BY query_id)"""

_JUDGED = f"""r AS (SELECT query_id, document_id AS doc_id, max(score) AS score FROM query_results WHERE query_id IS NOT NULL AND document_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r),
    j AS (SELECT query_id, document_id AS doc_id, max(shard % 4) AS grade FROM query_results WHERE query_id IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL HAVING max(shard % 4) > 0),
    {_JUDGED_METRICS}"""


@query(f"WITH {_JUDGED} SELECT query_id, round(coalesce(dcg / best, 0), 6) AS ndcg_10, round(coalesce(top / 10.0, 0), 6) AS precision_10, round(coalesce(found / relevant, 0), 6) AS recall_100 FROM i LEFT JOIN h USING (query_id)")
def eval_metrics(spark, d):
    rows = table(spark, d, "query_results").filter("query_id IS NOT NULL AND document_id IS NOT NULL")
    sane = rows.filter("score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('infinity')")
    best = sane.groupBy("query_id", F.col("document_id").alias("doc_id")).agg(F.max("score").alias("score"))
    # No measure looks below rank 100, so each task keeps so many rows of a query before they meet.
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id")))).filter("rank <= 100")
    qrels = rows.groupBy("query_id", F.col("document_id").alias("doc_id")).agg(F.max(F.col("shard") % 4).alias("grade"))
    return evaluation.metrics(ranked, qrels).select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg_10", "precision_10", "recall_100")))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, count(value) AS n FROM events")
def latency_percentiles(spark, d):
    return evaluation.latencies(table(spark, d, "events"), "value").select(*(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean")), "n")


@query("""WITH b AS (SELECT query_id, max(CASE WHEN isnan(score) OR isinf(score) THEN NULL ELSE score END) AS best FROM query_results GROUP BY query_id)
    SELECT CASE WHEN best IS NULL THEN 'none' WHEN best < 1 THEN '0-1' WHEN best < 2 THEN '1-2' WHEN best < 5 THEN '2-5' WHEN best < 10 THEN '5-10' WHEN best < 20 THEN '10-20' ELSE '>=20' END AS bucket, count(*) AS queries FROM b GROUP BY 1""")
def query_set_report(spark, d):
    clean = F.when(F.isnan("score") | (F.abs("score") == float("inf")), None).otherwise(F.col("score"))
    return evaluation.query_set_report(table(spark, d, "query_results").select("query_id", clean.alias("score")))


@query("SELECT sum(i * i)::BIGINT AS total FROM range(100000) t(i)")
def pool_sum(spark, d):
    return evaluation.pool_sum(spark, 100_000)
