"""Oracles in SQL. They restate the analysis and the formulas as common table expressions of their own, so that they check the
DataFrame code and do not repeat it; only lists of fixed values are shared."""

from __future__ import annotations

from .functions.text import _STOP, FOLD, STEP_2, STEP_3, STEP_4

_SINGLE = {c: v for c, v in FOLD.items() if len(v) == 1}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FROM = _UPPER + "".join(_SINGLE) + "".join(c for c, v in FOLD.items() if not v)
_TO = _UPPER.lower() + "".join(_SINGLE.values())
_MARK = ""


def _multi(x: str) -> str:
    for c, v in FOLD.items():
        if len(v) > 1:
            x = f"replace({x}, '{c}', '{v}')"
    return x


def _normal(x: str) -> str:
    dotted = f"regexp_replace(regexp_replace({x}, '([0-9])\\.([0-9])', '\\1{_MARK}\\2', 'g'), '([0-9])\\.([0-9])', '\\1{_MARK}\\2', 'g')"
    kept = f"replace(regexp_replace({dotted}, '[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g'), '{_MARK}', '.')"
    return _multi(f"translate({kept}, '{_FROM}', '{_TO}')")


_CONS, _VOW = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1, _M2 = f"'^(?:{_CONS})?{_VOW}{_CONS}'", f"'^(?:{_CONS})?{_VOW}{_CONS}(?:{_VOW})?$'", f"'^(?:{_CONS})?{_VOW}{_CONS}{_VOW}{_CONS}'"
_HAS, _CVC = f"'^(?:{_CONS})?[aeiouy]'", f"'^{_CONS}[aeiouy][^aeiouwxy\\x{{80}}-\\x{{10FFFF}}]$'"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {pattern})"


def _table(rules, measure: str) -> str:
    return "CASE " + " ".join(f"WHEN suffix(w, '{s}') THEN CASE WHEN {_is(_cut(len(s)), measure)} THEN {_cut(len(s))} || '{r}' ELSE w END" for s, r in rules) + " ELSE w END"


_STEPS = [
    f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_cut(2)} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {_cut(1)} ELSE w END",
    # step 1b keeps the cut word apart, as it is repaired afterwards
    f"""CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_is(_cut(3), _M0)} THEN {_cut(1)} ELSE w END
             WHEN suffix(w, 'ed') AND {_is(_cut(2), _HAS)} THEN '{_MARK}' || {_cut(2)}
             WHEN suffix(w, 'ing') AND {_is(_cut(3), _HAS)} THEN '{_MARK}' || {_cut(3)} ELSE w END""",
    f"""CASE WHEN left(w, 1) <> '{_MARK}' THEN w
             WHEN suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz') THEN substr(w, 2) || 'e'
             WHEN length(w) > 2 AND right(w, 1) = left(right(w, 2), 1) AND regexp_matches(right(w, 1), '[b-df-hj-np-tv-z0-9]') THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN substr(w, 2) ELSE substr(w, 2, length(w) - 2) END
             WHEN {_is("substr(w, 2)", _CVC)} THEN substr(w, 2) || 'e' ELSE substr(w, 2) END""",
    f"CASE WHEN (suffix(w, 'y') OR suffix(w, 'Y')) AND {_is(_cut(1), _HAS)} THEN {_cut(1)} || 'i' ELSE w END",
    _table(STEP_2, _M0),
    _table(STEP_3, _M0),
    f"CASE WHEN suffix(w, 'ion') THEN CASE WHEN {_is(_cut(3), chr(39) + '[st]$' + chr(39))} AND {_is(_cut(3), _M2)} THEN {_cut(3)} ELSE w END ELSE " + _table([(s, "") for s in STEP_4], _M2) + " END",
    f"CASE WHEN suffix(w, 'e') AND ({_is(_cut(1), _M2)} OR ({_is(_cut(1), _M1)} AND NOT {_is(_cut(1), _CVC)})) THEN {_cut(1)} ELSE w END",
    f"CASE WHEN suffix(w, 'll') AND {_is('w', _M2)} THEN {_cut(1)} ELSE w END",
]

CORPUS = "corpus AS (SELECT doc_id, coalesce(title, '') AS title, coalesce(text, '') AS body FROM documents)"

_SPLIT = r"'[ \n\r\t\x0B\f\-/\x{2010}-\x{2015}]+'"

PIECES = f"""
    pieces AS (SELECT doc_id, list_filter(regexp_split_to_array(title || chr(10) || chr(10) || body, {_SPLIT}), lambda x: x <> '') AS p FROM corpus),
    words AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS position FROM pieces),
    normal AS (SELECT piece, {_normal("piece")} AS term FROM (SELECT DISTINCT piece FROM words))"""

STOP_LIST = ", ".join(f"'{w}'" for w in sorted(_STOP))

_CHAIN = "SELECT term, CASE WHEN left(term, 1) = 'y' THEN 'Y' || substr(term, 2) ELSE term END AS w FROM (SELECT DISTINCT term FROM normal WHERE term <> '')"
for _step in _STEPS:
    _CHAIN = f"SELECT term, {_step} AS w FROM ({_CHAIN})"

STEMS = f"stems AS (SELECT term, CASE WHEN strlen(term) <= 2 THEN term WHEN left(w, 1) = 'Y' THEN 'y' || substr(w, 2) ELSE w END AS stem FROM ({_CHAIN}))"

#: tokens (doc_id, position, term) of documents, docs_ (doc_id, length, title_span, title_terms), postings_, stats_.
INDEX = f"""WITH {CORPUS}, {PIECES}, {STEMS},
    tokens AS (
        SELECT doc_id, position, stem AS term FROM words JOIN normal USING (piece) JOIN stems USING (term) WHERE term NOT IN ({STOP_LIST})),
    spans AS (SELECT doc_id, len(list_filter(regexp_split_to_array(title, {_SPLIT}), lambda x: x <> '')) AS span FROM corpus),
    docs_ AS (
        SELECT c.doc_id, coalesce(n, 0) AS length, span AS title_span, coalesce(t, 0) AS title_terms
        FROM corpus c JOIN spans s USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (position < span) AS t FROM tokens JOIN spans USING (doc_id) GROUP BY doc_id) USING (doc_id)),
    postings_ AS (SELECT term, doc_id, count(*) AS tf, list(position ORDER BY position) AS positions, count(*) FILTER (position < span) AS title_tf FROM tokens JOIN spans USING (doc_id) GROUP BY term, doc_id),
    df_ AS (SELECT term, count(*) AS df FROM postings_ GROUP BY term),
    stats_ AS (SELECT count(*) AS n, avg(length) AS av, avg(title_terms) AS avt FROM docs_)"""


def bm25(where: str) -> str:
    """Contributions w of the postings that a condition on p.term selects."""
    return f"""SELECT p.term, p.doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / av)) AS w
        FROM postings_ p JOIN df_ d ON d.term = p.term JOIN docs_ x ON x.doc_id = p.doc_id, stats_ WHERE {where}"""


def bm25f(where: str) -> str:
    return f"""SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * w / (1.2 + w) AS w FROM (
        SELECT p.term, p.doc_id, n, df,
               CASE WHEN title_tf > 0 THEN 2.0 * title_tf / (0.25 + 0.75 * title_terms / avt) ELSE 0 END
             + CASE WHEN tf > title_tf THEN (tf - title_tf) / (0.25 + 0.75 * (length - title_terms) / (av - avt)) ELSE 0 END AS w
        FROM postings_ p JOIN df_ d ON d.term = p.term JOIN docs_ x ON x.doc_id = p.doc_id, stats_ WHERE {where})"""


def tfidf(where: str) -> str:
    return f"SELECT p.term, p.doc_id, (1 + ln(tf)) * ln(n / df) AS w FROM postings_ p JOIN df_ d ON d.term = p.term, stats_ WHERE {where}"


def pagerank(edges: str, rounds: int, damping: float = 0.85) -> str:
    """CTEs e_ (src, dst), v_ (page), r0_ .. rN_ (page, score)."""
    out = f"""e_ AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({edges}) WHERE src IS NOT NULL AND dst IS NOT NULL),
    v_ AS MATERIALIZED (SELECT src AS page FROM e_ UNION SELECT dst FROM e_),
    o_ AS (SELECT src, count(*) AS deg FROM e_ GROUP BY src),
    r0_ AS (SELECT page, 1.0::DOUBLE / (SELECT count(*) FROM v_) AS score FROM v_)"""
    for i in range(rounds):
        out += f""",
    i{i}_ AS (SELECT coalesce(sum(score), 0) AS idle FROM r{i}_ WHERE page NOT IN (SELECT src FROM o_)),
    g{i}_ AS (SELECT e.dst AS page, sum(r.score / o.deg) AS got FROM e_ e JOIN o_ o ON o.src = e.src JOIN r{i}_ r ON r.page = e.src GROUP BY e.dst),
    r{i + 1}_ AS MATERIALIZED (SELECT v.page, (1 - {damping})::DOUBLE / (SELECT count(*) FROM v_) + {damping}::DOUBLE * (coalesce(got, 0) + idle / (SELECT count(*) FROM v_)) AS score FROM v_ v LEFT JOIN g{i}_ g ON g.page = v.page, i{i}_)"""
    return out
