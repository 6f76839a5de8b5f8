"""Text analysis: split, normalize, drop stopwords, stem.

Two forms of the same analysis. ``analyzed`` is the hot path: one Arrow batch function that looks every distinct word up in a
dictionary, so a word is normalized and stemmed once for each task and not once for each occurrence. The Column functions are the
same steps as native expressions, for single columns and for the vocabulary; tests hold both against each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between tokens (fixed values).
SPACE = r" \n\r\t\x0B\f"

#: Marks that part a token into pieces: hyphen, slash and U+2010 to U+2015.
COMPOUND = r"\-/‐-―"

#: Words without weight in a search (fixed values).
STOPWORDS = tuple(
    "a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can couldn couldn't d did didn "
    "didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven haven't having he her here hers herself "
    "him himself his how i if in into is isn isn't it it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off "
    "on once only or other our ours ourselves out over own re s same shan shan't she she's should should've shouldn shouldn't so some such t than that that'll the their "
    "theirs them themselves then there these they this those through to too under until up ve very was wasn wasn't we were weren weren't what when where which while who whom "
    "why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself yourselves".split()
)

#: Letters of Latin-1 and Latin Extended-A whose plain form is not the base letter of their decomposition (fixed values).
FOLD_EXCEPTIONS = {
    "Æ": "ae", "æ": "ae", "Ð": "d", "ð": "d", "×": "", "÷": "", "Ø": "o", "ø": "o", "Þ": "th", "þ": "th", "ß": "ss", "Đ": "d", "đ": "d", "Ħ": "h", "ħ": "h", "ı": "i",
    "Ĳ": "ij", "ĳ": "ij", "ĸ": "k", "Ŀ": "l", "ŀ": "l", "Ł": "l", "ł": "l", "ŉ": "n", "Ŋ": "n", "ŋ": "n", "Œ": "oe", "œ": "oe", "Ŧ": "t", "ŧ": "t", "ſ": "s",
}


def _folded(c: str) -> str:
    return FOLD_EXCEPTIONS[c] if c in FOLD_EXCEPTIONS else unicodedata.normalize("NFD", c)[0].lower()


#: What each letter from U+00C0 to U+017F becomes.
FOLD = {c: _folded(c) for c in map(chr, range(0xC0, 0x180))}

_PIECES = re.compile(f"[{SPACE}{COMPOUND}]+")
_TOKENS = re.compile(f"[^{SPACE}]+")
_KEPT = r"0-9A-Za-z\x80-\U0010ffff"
# Marks are judged by their neighbours in the token as it came, so one pass takes them all.
_DROPPED = re.compile(rf"(?<![0-9])\.|\.(?![0-9])|(?<![{_KEPT}])-|-(?![{_KEPT}])|[^{_KEPT}.\-]")
_LOWER = {c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)} | {ord(c): v for c, v in FOLD.items()}


def tokenize(text: str) -> list[tuple[int, int, str]]:
    """(position, byte offset, token) of every run without white space."""
    out, at, chars = [], 0, 0
    for i, m in enumerate(_TOKENS.finditer(text)):
        at += len(text[chars : m.start()].encode("utf-8", "surrogatepass"))
        chars = m.start()
        out.append((i, at, m[0]))
    return out


def split_compounds(text: str) -> list[tuple[int, int, str]]:
    """(position, byte offset, piece): tokens parted at hyphens, slashes and dashes. Empty pieces take no position."""
    out, at, chars = [], 0, 0
    for m in re.finditer(f"[^{SPACE}{COMPOUND}]+", text):
        at += len(text[chars : m.start()].encode("utf-8", "surrogatepass"))
        chars = m.start()
        out.append((len(out), at, m[0]))
    return out


def normalize(token: str) -> str:
    """Lower case for ASCII and Latin letters, without accents, apostrophes and marks; a dot stays between digits and a hyphen
    between word characters. Everything from U+0180 on stays as it is."""
    return _DROPPED.sub("", token).translate(_LOWER)


_STOP = frozenset(normalize(w) for w in STOPWORDS)


def is_stopword(term: str) -> bool:
    return term in _STOP


# The Porter stemmer. A y is a vowel after a consonant, so a leading one is written Y while the rules run; then c is any character but
# aeiou, and with C a run of consonants and V of vowels the conditions on the measure are patterns. Words are seen byte by byte.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_OVER_0, M_IS_1, M_OVER_1 = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL, SHORT = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

#: Suffixes of steps 2, 3 and 4 in the order in which they are tried; the first that the word has ends the step (fixed values).
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_m0, _m1, _m2, _vowel, _short = (re.compile(p) for p in (M_OVER_0, M_IS_1, M_OVER_1, HAS_VOWEL, SHORT))


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _tense(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _m0.search(w[:-3]) else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _vowel.search(w[: -len(suffix)]):
            w = w[: -len(suffix)]
            break
    else:
        return w
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and _consonant_end(w):
        return w if w[-1] in "lsz" else w[:-1]
    return w + "e" if _short.search(w) else w


def _consonant_end(w: str) -> bool:
    """Whether the last letter is a consonant: a y is one unless a consonant comes before it."""
    if w[-1] != "y":
        return w[-1] not in "aeiou"
    run = len(w) - len(w.rstrip("y"))
    after_consonant = len(w) > run and w[-run - 1] not in "aeiou"
    return (run % 2 == 0) if after_consonant else (run % 2 == 1)


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith(("y", "Y")) and _vowel.search(w[:-1]) else w


def _longest(w: str, rules: tuple[tuple[str, str], ...]) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            return w[: -len(suffix)] + new if _m0.search(w[: -len(suffix)]) else w
    return w


def _residual(w: str) -> str:
    if w.endswith("ion"):
        return w[:-3] if w[:-3].endswith(("s", "t")) and _m2.search(w[:-3]) else w
    for suffix in STEP_4:
        if w.endswith(suffix):
            return w[: -len(suffix)] if _m2.search(w[: -len(suffix)]) else w
    return w


def _final_e(w: str) -> str:
    if not w.endswith("e"):
        return w
    stem = w[:-1]
    return stem if _m2.search(stem) or _m1.search(stem) and not _short.search(stem) else w


def _double_l(w: str) -> str:
    return w[:-1] if w.endswith("ll") and _m2.search(w) else w


STEPS = {"1a": _plural, "1b": _tense, "1c": _final_y, "2": lambda w: _longest(w, STEP_2), "3": lambda w: _longest(w, STEP_3), "4": _residual, "5a": _final_e, "5b": _double_l}


def _as_bytes(word: str) -> str:
    return word.encode("utf-8", "surrogatepass").decode("latin-1")


def _as_text(view: str, before: str) -> str:
    try:
        return view.encode("latin-1").decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:  # a rule took half a character: the whole one stays
        return before


def stem_step(step: str, word: str) -> str:
    view = _as_bytes(word)
    marked = "Y" + view[1:] if view[:1] == "y" else view
    out = STEPS[step](marked)
    return _as_text("y" + out[1:] if marked[:1] == "Y" and out[:1] == "Y" else out, word)


def stem(word: str) -> str:
    """All steps in order; a word of two bytes at most stays."""
    if len(word.encode("utf-8", "surrogatepass")) <= 2:
        return word
    for step in STEPS:
        word = stem_step(step, word)
    return word


def consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(_as_bytes(word)):
        out.append(c not in "aeiou" if c != "y" else i == 0 or not out[-1])
    return out


def stem_info(word: str) -> dict[str, object]:
    """What the stemmer's conditions say of a word."""
    kinds = consonants(word)
    view = _as_bytes(word)
    measure = sum(a is False and b for a, b in zip(kinds, kinds[1:]))
    return {
        "measure": measure,
        "vowel": not all(kinds),
        "double": len(view) > 1 and view[-1] == view[-2] and kinds[-1],
        "cvc": len(view) > 2 and kinds[-3:] == [True, False, True] and view[-1] not in "wxy",
    }


@lru_cache(maxsize=300_000)
def term_of(piece: str) -> str:
    """The indexed term of a piece, '' for none."""
    term = normalize(piece)
    return "" if not term or term in _STOP else stem(term)


def analyze(text: str) -> list[tuple[int, int, str]]:
    """(position, byte offset, term): pieces without stopwords. Dropped pieces leave gaps in the positions."""
    return [(p, o, t) for p, o, x in split_compounds(text) if (t := term_of(x))]


def terms_of(text: str) -> list[tuple[int, str]]:
    """analyze without offsets."""
    return [(i, t) for i, x in enumerate(filter(None, _PIECES.split(text))) if (t := term_of(x))]


def query_terms(words: list[str]) -> list[str]:
    return [t for w in words for _, t in terms_of(w)]


def title_span(title: str) -> int:
    """Pieces of a title, counted before normalization."""
    return sum(1 for x in _PIECES.split(title) if x)


POSTINGS = "array<struct<term:string,positions:array<int>>>"


def analyzed(docs: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the kept columns, length, title_span, title_terms, terms): each document's terms with their positions, in one row.

    A document is a row, so grouping its terms needs no shuffle. A null title or body counts as empty.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, spans, in_title, names, counts, flat, ends = [], [], [], [], [], [], [0]
            for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                span = title_span(t or "")
                held: dict[str, list[int]] = {}
                n = of_title = 0
                for p, term in terms_of(f"{t or ''}\n\n{b or ''}"):
                    held.setdefault(term, []).append(p)
                    n += 1
                    of_title += p < span
                lengths.append(n)
                spans.append(span)
                in_title.append(of_title)
                names.extend(held)
                for positions in held.values():
                    flat.extend(positions)
                    counts.append(len(flat))
                ends.append(len(names))
            positions = pa.ListArray.from_arrays(pa.array([0, *counts], pa.int32()), pa.array(flat, pa.int32()))
            items = pa.StructArray.from_arrays([pa.array(names, pa.string()), positions], names=["term", "positions"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items).cast(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(lengths, pa.int64()), pa.array(spans, pa.int32()), pa.array(in_title, pa.int64()), lists], names=["doc_id", *keep, "length", "title_span", "title_terms", "terms"])

    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(F.col(key).alias("doc_id"), title, body, *keep).mapInArrow(run, f"doc_id {kind}, {kept}length long, title_span int, title_terms long, terms {POSTINGS}")


# The same as native expressions.


def pieces_column(text: Column) -> Column:
    """Array of pieces; an index in it is a position."""
    return F.filter(F.split(text, f"[{SPACE}{COMPOUND}]+"), lambda x: x != "")


def tokens_column(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def normalize_column(token: Column) -> Column:
    kept = r"0-9A-Za-z\x{80}-\x{10FFFF}"
    out = F.regexp_replace(token, rf"(?<![0-9])\.|\.(?![0-9])|(?<![{kept}])-|-(?![{kept}])|[^{kept}.\-]", "")
    single = sorted((c, v) for c, v in FOLD.items() if len(v) == 1)
    gone = "".join(c for c, v in FOLD.items() if not v)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = F.translate(out, upper + "".join(c for c, _ in single) + gone, upper.lower() + "".join(v for _, v in single))
    for c, v in FOLD.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(c), F.lit(v))
    return out


def stopword_column(term: Column) -> Column:
    return term.isin(*sorted(_STOP))


def _bound(value: Column, step) -> Column:
    """step(value) with the value computed once: without it, nested steps repeat their input in every branch."""
    return F.transform(F.array(value), step)[0]


def _strip(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def stem_column(word: Column) -> Column:
    """stem as one expression, for the words of a vocabulary. Words are seen byte by byte through an ISO-8859-1 view."""
    e = F.endswith

    def ends(w: Column, suffix: str) -> Column:
        return e(w, F.lit(suffix))

    def plural(w: Column) -> Column:
        return F.when(ends(w, "sses") | ends(w, "ies"), _strip(w, 2)).when(ends(w, "s") & ~ends(w, "ss"), _strip(w, 1)).otherwise(w)

    def repaired(w: Column) -> Column:
        last, second = F.right(w, F.lit(1)), F.substring(w, F.length(w) - 1, F.lit(1))
        double = (F.length(w) > 1) & (last == second) & w.rlike(r"(?:[^aeiouy]|(?:^|[aeiou])(?:yy)*y|[^aeiouy](?:yy)+)$")
        return (
            F.when(ends(w, "at") | ends(w, "bl") | ends(w, "iz"), F.concat(w, F.lit("e")))
            .when(double, F.when(last.isin("l", "s", "z"), w).otherwise(_strip(w, 1)))
            .when(w.rlike(SHORT), F.concat(w, F.lit("e")))
            .otherwise(w)
        )

    def tense(w: Column) -> Column:
        return (
            F.when(ends(w, "eed"), F.when(_strip(w, 3).rlike(M_OVER_0), _strip(w, 1)).otherwise(w))
            .when(ends(w, "ed") & _strip(w, 2).rlike(HAS_VOWEL), _bound(_strip(w, 2), repaired))
            .when(ends(w, "ing") & _strip(w, 3).rlike(HAS_VOWEL), _bound(_strip(w, 3), repaired))
            .otherwise(w)
        )

    def final_y(w: Column) -> Column:
        return F.when((ends(w, "y") | ends(w, "Y")) & _strip(w, 1).rlike(HAS_VOWEL), F.concat(_strip(w, 1), F.lit("i"))).otherwise(w)

    def by_table(rules: tuple[tuple[str, str], ...], measure: str):
        def step(w: Column) -> Column:
            out = None
            for suffix, new in rules:
                stem_ = _strip(w, len(suffix))
                value = F.when(stem_.rlike(measure), F.concat(stem_, F.lit(new))).otherwise(w)
                out = F.when(ends(w, suffix), value) if out is None else out.when(ends(w, suffix), value)
            return out.otherwise(w)

        return step

    def residual(w: Column) -> Column:
        ion = F.when(_strip(w, 3).rlike("[st]$") & _strip(w, 3).rlike(M_OVER_1), _strip(w, 3)).otherwise(w)
        return F.when(ends(w, "ion"), ion).otherwise(by_table(tuple((s, "") for s in STEP_4), M_OVER_1)(w))

    def final_e(w: Column) -> Column:
        s = _strip(w, 1)
        return F.when(ends(w, "e") & (s.rlike(M_OVER_1) | (s.rlike(M_IS_1) & ~s.rlike(SHORT))), s).otherwise(w)

    def double_l(w: Column) -> Column:
        return F.when(ends(w, "ll") & w.rlike(M_OVER_1), _strip(w, 1)).otherwise(w)

    out = F.regexp_replace(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "^y", "Y")
    for step in (plural, tense, final_y, by_table(STEP_2, M_OVER_0), by_table(STEP_3, M_OVER_0), residual, final_e, double_l):
        out = _bound(out, step)
    back = F.decode(F.encode(F.regexp_replace(out, "^Y", "y"), "ISO-8859-1"), "UTF-8")
    return F.when(F.octet_length(word) <= 2, word).otherwise(back)
