"""Queries of this package and, where SQL can state the same over whole tables, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .distinctive import top_term
from .lookalikes import lookalike_pairs
from .mixing import mixture
from .site_lines import repeated_lines, without_repeated_lines
from .splitting import split_oversized
from .term_counts import refreshed_completions, term_bands
from .tokens import token_ids
from .top_items import judged_top
from .wrappers import body_lines, residue_pages


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_bands(table(spark, d, "docs")).filter(F.col("band") != "useful").select("term", "band")


def p1_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return refreshed_completions(table(spark, d, "completions"), table(spark, d, "docs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return judged_top(table(spark, d, "query_results"), table(spark, d, "judged_queries")).select("query_id", "document_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return top_term(table(spark, d, "docs")).select("doc_id", "term")


def p3_parsimonious(spark: SparkSession, d: str) -> DataFrame:
    return top_term(table(spark, d, "docs"), by="probability").select("doc_id", "term", F.round("probability", 6).alias("probability"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "docs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_pages(table(spark, d, "crawled_pages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return body_lines([table(spark, d, "crawled_pages"), table(spark, d, "html_pages")])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "crawled_pages")).select("page_id", "line_no")


def p7_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated_lines(table(spark, d, "crawled_pages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"), table(spark, d, "piece_limits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_dictionary, p2_found, p3_found, p3_parsimonious, p4_found, p5_found, p6_found, p7_found, p7_rebuilt, p8_ids, p9_mixture, p9_shares, p10_pieces)}

_TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"

#: CTEs k (page_id, host, line_no, letters) of the lines and c (host, letters) of those that come back.
_LINES = r"""WITH p AS (
            SELECT page_id, any_value(text) AS text,
                   any_value(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//', ''), '^[^/?#\\]*'), '^.*@', ''), ':\d*\s*$', ''))) AS host
            FROM crawled_pages WHERE page_id IS NOT NULL AND url IS NOT NULL AND text IS NOT NULL GROUP BY page_id),
        s AS (SELECT page_id, host, string_split(text, chr(10)) AS lines FROM p),
        l AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM s),
        k AS (SELECT page_id, host, line_no, regexp_replace(lower(line), '\P{L}+', '', 'g') AS letters FROM l WHERE trim(host) <> ''),
        c AS (SELECT host, letters FROM k WHERE letters <> '' GROUP BY host, letters HAVING count(DISTINCT page_id) >= 8)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
        WITH d AS (SELECT doc_id, any_value(body) AS body FROM docs WHERE doc_id IS NOT NULL AND body IS NOT NULL GROUP BY doc_id),
        t AS (SELECT DISTINCT doc_id, unnest({_TERMS.format("body")}) AS term FROM d),
        n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
        c AS (SELECT term, count(*) AS df FROM t GROUP BY term)
        SELECT term, CASE WHEN df < 3 THEN 'rare' ELSE 'common' END AS band FROM c, n WHERE df < 3 OR df * 100 > 15 * n""",
    "p1_dictionary": f"""
        WITH d AS (SELECT doc_id, any_value(body) AS body FROM docs WHERE doc_id IS NOT NULL AND body IS NOT NULL GROUP BY doc_id),
        t AS (SELECT DISTINCT doc_id, unnest({_TERMS.format("body")}) AS term FROM d),
        c AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        k AS (SELECT term, shard, document_frequency, row_number() OVER (PARTITION BY term, shard ORDER BY built_at DESC NULLS LAST, document_frequency DESC NULLS LAST) AS nth FROM completions WHERE term IS NOT NULL)
        SELECT k.term, shard, document_frequency AS stored_frequency, coalesce(df, 0) AS counted_frequency FROM k LEFT JOIN c ON c.term = k.term WHERE nth = 1""",
    "p2_found": """
        WITH r AS (
            SELECT query_id, document_id, max(score) AS score FROM query_results
            WHERE document_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) AND query_id IN (SELECT query_id FROM judged_queries WHERE query_id IS NOT NULL)
            GROUP BY query_id, document_id)
        SELECT query_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS nth FROM r) WHERE nth <= 10""",
    "p3_found": f"""
        WITH d AS (SELECT doc_id, any_value(coalesce(title, '') || chr(10) || coalesce(body, '')) AS x FROM docs WHERE doc_id IS NOT NULL GROUP BY doc_id),
        t AS (SELECT doc_id, unnest({_TERMS.format("x")}) AS term FROM d),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
        c AS (SELECT term, count(*) AS df FROM f GROUP BY term),
        n AS (SELECT count(DISTINCT doc_id) AS n FROM f),
        w AS (SELECT doc_id, f.term, (1 + ln(tf)) * ln(n / df) AS weight FROM f JOIN c ON c.term = f.term, n)
        SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS nth FROM w) WHERE nth = 1""",
    "p7_found": f"""{_LINES}
        SELECT page_id, line_no::INTEGER AS line_no FROM k SEMI JOIN c ON c.host = k.host AND c.letters = k.letters""",
    "p7_rebuilt": f"""{_LINES},
        m AS (SELECT page_id, list(line_no) AS gone FROM k SEMI JOIN c ON c.host = k.host AND c.letters = k.letters GROUP BY page_id),
        w AS (SELECT page_id, any_value(text) AS text FROM crawled_pages WHERE page_id IS NOT NULL GROUP BY page_id)
        SELECT page_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text, coalesce(len(gone), 0)::INTEGER AS dropped
        FROM w LEFT JOIN m USING (page_id)""",
}
