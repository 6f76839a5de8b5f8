"""The queries of the readers and writers: each writes one of the driver's tables to files of a kind and reads them back."""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .catalog import _EDGES, _JUDGED_METRICS, _edges, _query_stems, _urls, corpus, index_of, query, table
from .functions.web import parsed_html, resolved_links
from .operators import evaluation, matching
from .operators.index import build_index, update_index
from .sources import corpus as sources
from .storage import is_folder, shared_folder, write_text


def _place(spark: SparkSession, d: str, name: str) -> str:
    return f"{shared_folder(spark)}/sources-{sha1(d.encode()).hexdigest()[:12]}/{name}"


def _lines(df: DataFrame, path: str) -> str:
    """Writes rows of one text column in their order; a reader in order of files finds them in it."""
    df.write.mode("overwrite").text(path)
    return path


def _collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f\x08]+', ' ', 'g'), ' ')"


# Collections


@query("SELECT 'n' || n_nationkey AS doc_id, n_name AS title, 'In region ' || n_regionkey || '.' AS body FROM nation")
def source_directory(spark, d):
    folder = _place(spark, d, "directory")
    for r in table(spark, d, "nation").collect():  # 25 rows: a fixed table
        write_text(spark, f"{folder}/n{r.n_nationkey}.txt", f"title:  {r.n_name} \r\n\r\n\r\nIn region {r.n_regionkey}.\n\n")
    write_text(spark, f"{folder}/notes.md", "title: none\n\nno document")
    return sources.open_corpus(spark, folder)


_BLANK_ENDS = r"regexp_replace(regexp_replace({}, '^(?:[ \t\r\n\x0B\f]*\n)+', ''), '(?:\n[ \t\r\n\x0B\f]*)+$', '')"
_PACKED_BODY = _BLANK_ENDS.format(r"regexp_replace(replace(chr(10) || coalesce(text, '') || chr(10), chr(13) || chr(10), chr(10)), '[\r\n]$', '')")


@query(rf"""SELECT doc_id::VARCHAR AS doc_id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS title,
    CASE WHEN regexp_full_match({_PACKED_BODY}, '[ \t\r\n\x0B\f]*') THEN '' ELSE {_PACKED_BODY} END AS body FROM documents""")
def source_packed(spark, d):
    path = _place(spark, d, "all.corpus").removeprefix("file:")  # one file for exchange, which the executors open by its path
    if not is_folder(spark, path.rsplit("/", 1)[0]):
        write_text(spark, path, "")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    sources.write_packed(corpus(spark, d).withColumn("title", title), path)
    return sources.open_corpus(spark, path)


@query("SELECT doc_id, title, text AS body FROM documents")
def source_table(spark, d):
    return sources.read_parquet(spark, f"{d}/documents.parquet", body="text")


@query(f"SELECT 'doc_' || lpad((row_number() OVER (ORDER BY doc_id))::VARCHAR, 8, '0') AS doc_id, {_collapsed('title')} AS title, {_collapsed('text')} AS body FROM documents WHERE title IS NOT NULL AND {_collapsed('coalesce(text, chr(32))')} <> ''")
def source_wikipedia(spark, d):
    rows = table(spark, d, "documents").orderBy("doc_id").select(F.array(F.to_json(F.struct(F.struct(F.col("doc_id").cast("string").alias("_id")).alias("index"))), F.to_json(F.struct("title", "text", "lang"))).alias("two"))
    return sources.read_wikipedia(spark, _lines(rows.select(F.explode("two")), _place(spark, d, "dump")))


@query(f"SELECT doc_id, {_collapsed('title')} AS title, {_collapsed('body')} AS body FROM (SELECT DISTINCT doc_id, coalesce(title, '') AS title, coalesce(body, '') AS body FROM docs WHERE doc_id <> '') WHERE {_collapsed('title || body')} <> ''")
def source_beir(spark, d):
    rows = table(spark, d, "docs").select("doc_id", "title", "body").distinct()
    return sources.read_beir(spark, _lines(rows.select(F.to_json(F.struct(F.col("doc_id").alias("_id"), "title", F.col("body").alias("text")))), _place(spark, d, "beir")))


@query("SELECT DISTINCT query_id, text FROM judged_queries WHERE query_id IS NOT NULL")
def source_beir_queries(spark, d):
    rows = table(spark, d, "judged_queries").distinct().select(F.to_json(F.struct(F.col("query_id").alias("_id"), "text", F.struct(F.lit(1).alias("a")).alias("metadata"))))
    return sources.read_beir_queries(spark, _lines(rows, _place(spark, d, "beir-queries")))


@query("""SELECT query_id, document_id AS doc_id, max(shard)::INTEGER AS grade FROM query_results WHERE query_id IS NOT NULL AND document_id IS NOT NULL AND shard > 0 GROUP BY ALL""")
def source_qrels(spark, d):
    rows = table(spark, d, "query_results").filter("query_id IS NOT NULL AND document_id IS NOT NULL")
    best = rows.groupBy("query_id", "document_id").agg(F.max("shard").alias("g"))
    lines = best.select(F.concat_ws("\t", "query_id", "document_id", F.col("g").cast("string")))
    head = spark.createDataFrame([("query-id\tcorpus-id\tscore",), ("q0\td0\tnone",), ("q0\td0\t-1",), ("q0 d0 1",)], "value string")
    return sources.read_qrels(spark, _lines(head.union(lines), _place(spark, d, "qrels")))


@query(r"SELECT trim(text, chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)) AS query, count(*) AS n FROM judged_queries WHERE regexp_matches(text, '[^ \t\r\n\x0B\f]') GROUP BY 1")
def source_query_log(spark, d):
    lines = table(spark, d, "judged_queries").select(F.concat(F.lit("  "), F.coalesce("text", F.lit("")), F.lit(" \t")))
    return sources.read_queries(spark, _lines(lines, _place(spark, d, "log"))).groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT src, dst, count(*) AS n FROM ({_EDGES}) GROUP BY ALL")
def source_links(spark, d):
    lines = _edges(spark, d).select(F.concat_ws("\t", "src", "dst"))
    return sources.read_links(spark, _lines(lines.union(spark.createDataFrame([("no tab",)], "v string")), _place(spark, d, "links"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'p' || p_partkey AS doc_id, 'http://h' || (p_partkey % 10) || '.test/' || CASE WHEN p_partkey >= 10 THEN p_partkey::VARCHAR ELSE '' END AS url FROM part")
def source_urls(spark, d):
    return sources.read_urls(spark, _lines(_urls(spark, d).select(F.concat_ws("\t", "doc_id", "url")), _place(spark, d, "urls"))).select("doc_id", "url")


@query("SELECT 'p' || p_partkey AS page, p_retailprice / 7 AS score FROM part")
def source_ranks(spark, d):
    path = _place(spark, d, "ranks")
    sources.write_ranks(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("page"), (F.col("p_retailprice") / 7).alias("score")), path)
    return sources.read_ranks(spark, path)


@query("SELECT DISTINCT 'crawl_' || page_id AS doc_id, title FROM crawled_pages UNION ALL SELECT DISTINCT 'html_' || page_id, title FROM html_pages")
def merged_crawls(spark, d):
    parts = {name: table(spark, d, f"{name_}_pages").select(F.col("page_id").cast("string").alias("doc_id"), "title").distinct() for name, name_ in (("crawl", "crawled"), ("html", "html"))}
    return sources.merge_crawls(parts)


@query(f"""{O.INDEX} SELECT '{{"doc_id":' || doc_id || ',"length":' || length || '}}' AS json FROM docs_""")
def json_results(spark, d):
    return sources.json_response(index_of(spark, d).docs.select("doc_id", "length"))


@query("SELECT doc_id FROM documents")
def all_documents(spark, d):
    return matching.all_documents(index_of(spark, d))


@query(f"{O.INDEX} SELECT term, doc_id, tf::INTEGER AS tf, title_tf::INTEGER AS title_tf, array_to_string(positions, ' ') AS positions FROM postings_ JOIN documents USING (doc_id) WHERE coalesce(source, '') <> 'glossary'")
def incremental_postings(spark, d):
    """The postings of an updated index: some documents new, some changed, some gone."""
    rows = table(spark, d, "documents")
    before = rows.filter("published_at < TIMESTAMP '2023-01-01'").select("doc_id", "title", F.when(F.col("source") == "forum", "").otherwise(F.col("text")).alias("body"))
    after = rows.filter("coalesce(source, '') <> 'glossary'").select("doc_id", "title", F.col("text").alias("body"))
    new = update_index(build_index(before), after)[0]
    return new.postings.select("term", "doc_id", "tf", "title_tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


# Pages


_PAGES = r"""p_ AS (SELECT page_id, any_value(url) AS url, any_value(title) AS title, any_value(links) AS links FROM html_pages GROUP BY page_id),
    u_ AS (SELECT *, lower(regexp_extract(url, '^([^:]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]*://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[^:]*://[^/?#:]+:([0-9]+)', 1) AS port,
        regexp_extract(url, '^[^:]*://[^/?#:]+(?::[0-9]+)?(/[^?#]*)', 1) AS path, regexp_extract(url, '^[^#?]*\?([^#]*)', 1) AS query FROM p_ WHERE url IS NOT NULL),
    d_ AS (SELECT *, scheme || '://' || host || CASE WHEN port = '' OR port = CASE scheme WHEN 'http' THEN '80' ELSE '443' END THEN '' ELSE ':' || port END AS root, list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')) AS parts FROM u_),
    f_ AS (SELECT *, CASE WHEN suffix(path, '/') THEN parts ELSE parts[1:len(parts) - 1] END AS dir,
        root || '/' || array_to_string(parts, '/') || CASE WHEN len(parts) > 0 AND suffix(path, '/') THEN '/' ELSE '' END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS src FROM d_),
    l_ AS (SELECT src, root, dir, unnest(links) AS ref FROM f_),
    t_ AS (SELECT src, root || CASE WHEN starts_with(ref, '/') THEN ref WHEN starts_with(ref, '?') THEN '/' || array_to_string(dir, '/') || CASE WHEN len(dir) > 0 THEN '/' ELSE '' END || ref
        ELSE '/' || array_to_string(list_append(dir[1:len(dir) - 1], 'index.html'), '/') END AS dst FROM l_ WHERE starts_with(ref, '/') OR starts_with(ref, '?') OR ref = '../index.html')"""


def _markup(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, html) of the parsed pages, as markup again: links as href attributes in all their quotings, the title's first letter as a number."""
    rows = table(spark, d, "html_pages").dropDuplicates(["page_id"])
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    title = F.coalesce("title", F.lit(""))
    head = F.when(title == "", "").otherwise(F.concat(F.lit("&#x"), F.hex(F.ascii(title)), F.lit(";"), esc(F.expr("substring(coalesce(title, ''), 2)"))))
    quoted = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit('<a class="k" href="'), esc(x), F.lit('">go</a>'))).when(i % 3 == 1, F.concat(F.lit("<A HREF = '"), esc(x), F.lit("'>go</A>"))).otherwise(F.concat(F.lit("<a data-n=1 href="), F.when(x == "", "''").otherwise(esc(x)), F.lit(" >go</a>")))
    anchors = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x, i: F.coalesce(quoted(x, i), F.lit(""))), "<br>")
    html = F.concat(F.lit("<title>"), head, F.lit("</title><!-- <a href='/none'>no</a> --><script>'<a href=/none>'</script><p>"), anchors, F.lit("<a name=x>none</a></p>"))
    return rows.select("page_id", "url", html.alias("html"))


@query(f"WITH {_PAGES} SELECT src, dst, count(*) AS n FROM t_ GROUP BY ALL")
def html_link_graph(spark, d):
    return resolved_links(parsed_html(_markup(spark, d))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(any_value(coalesce(title, '')), '[ \t\n\r\x0b\f]+', ' ', 'g'), ' ') AS title, count(x) FILTER (x <> '') AS links
    FROM (SELECT page_id, any_value(title) AS title, any_value(links) AS links FROM html_pages GROUP BY page_id) LEFT JOIN LATERAL (SELECT unnest(links) AS x) ON true GROUP BY page_id""")
def html_entities_hrefs(spark, d):
    return parsed_html(_markup(spark, d)).select("page_id", "title", F.size("links").cast("long").alias("links"))


# Evaluation from files to means


_RELEVANT = """SELECT query_id, ((n * 13 + j * 29) % (SELECT max(doc_id) + 1 FROM documents))::VARCHAR AS doc_id, max(1 + j % 3) AS grade
    FROM (SELECT DISTINCT query_id, try_cast(regexp_extract(query_id, '([0-9]+)', 1) AS BIGINT) AS n FROM judged_queries WHERE query_id IS NOT NULL AND text IS NOT NULL), range(40) t(j) WHERE n IS NOT NULL AND n % 3 > 0 GROUP BY ALL"""


@query(rf"""{O.INDEX}, q_ AS (SELECT query_id, min(text) AS text FROM judged_queries WHERE text IS NOT NULL AND query_id IS NOT NULL GROUP BY 1),
    qp_ AS (SELECT query_id, list_filter(regexp_split_to_array(translate(regexp_replace(text, '["()]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {O._SPLIT}), lambda x: x <> '') AS p FROM q_),
    qw_ AS (SELECT query_id, unnest(p) AS piece FROM qp_), qn_ AS (SELECT query_id, {O._normal("piece")} AS term FROM qw_), {_query_stems()},
    qt_ AS (SELECT query_id, stem AS term FROM qn_ JOIN qs_ USING (term) WHERE term NOT IN ({O.STOP_LIST})), w_ AS ({O.bm25("p.term IN (SELECT term FROM qt_)")}),
    r AS (SELECT query_id, doc_id::VARCHAR AS doc_id, doc_id AS id, round(sum(w), 9) AS score FROM qt_ JOIN w_ USING (term) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r), j AS ({_RELEVANT}), {_JUDGED_METRICS}
    SELECT round(avg(coalesce(dcg / best, 0)), 6) AS ndcg_10, round(avg(coalesce(top / 10.0, 0)), 6) AS precision_10, round(avg(coalesce(found / relevant, 0)), 6) AS recall_100, count(*) AS judged, (SELECT count(*) FROM q_ WHERE query_id NOT IN (SELECT query_id FROM j)) AS unjudged
    FROM i LEFT JOIN h USING (query_id)""")
def evaluate_index(spark, d):
    """A judged collection's files, read and evaluated on the stored index."""
    known = table(spark, d, "judged_queries").filter("text IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id").agg(F.min("text").alias("text"))
    n = F.expr("try_cast(regexp_extract(query_id, '([0-9]+)', 1) AS BIGINT)")
    most = table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("m")).scalar()
    pairs = known.select("query_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j")).filter("n % 3 > 0")
    lines = pairs.select(F.concat_ws("\t", "query_id", ((F.col("n") * 13 + F.col("j") * 29) % most).cast("string"), (1 + F.col("j") % 3).cast("string")).alias("v"), (1 + F.col("j") % 3).alias("g")).orderBy("g").select("v")
    queries = sources.read_beir_queries(spark, _lines(known.select(F.to_json(F.struct(F.col("query_id").alias("_id"), "text"))), _place(spark, d, "eval-queries")))
    qrels = sources.read_qrels(spark, _lines(lines, _place(spark, d, "eval-qrels")))
    means = evaluation.evaluate(index_of(spark, d), queries, qrels.withColumn("doc_id", F.col("doc_id").cast("long")))
    return means.select(*(F.round(c, 6).alias(c) for c in ("ndcg_10", "precision_10", "recall_100")), "judged", "unjudged")


@query("SELECT DISTINCT query_id FROM judged_queries WHERE query_id IS NOT NULL AND query_id NOT IN (SELECT query_id FROM query_results WHERE query_id IS NOT NULL)")
def zero_result_queries(spark, d):
    return evaluation.without_results(table(spark, d, "judged_queries"), table(spark, d, "query_results"))


@query("""WITH c AS (SELECT count(r.query_id) AS n FROM (SELECT DISTINCT query_id FROM judged_queries WHERE query_id IS NOT NULL) q LEFT JOIN query_results r USING (query_id) GROUP BY q.query_id),
    k AS (SELECT n, row_number() OVER (ORDER BY n) AS nth, count(*) OVER () AS total FROM c)
    SELECT p::INTEGER AS percent, min(n) AS results FROM k, (VALUES (50), (90), (95), (99), (100)) t(p) WHERE nth >= ceil(p * total / 100.0) GROUP BY p""")
def result_count_percentiles(spark, d):
    return evaluation.result_percentiles(table(spark, d, "judged_queries"), table(spark, d, "query_results"), (50, 90, 95, 99, 100))
