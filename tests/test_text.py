import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumetext.functions import text as tx


def test_tokens_have_byte_offsets():
    assert tx.tokenize("café au lait") == [(0, 0, "café"), (1, 6, "au"), (2, 9, "lait")]
    assert tx.tokenize(" \t\n") == []


@pytest.mark.parametrize(
    "token, term",
    [("Œuvre", "oeuvre"), ("Straße", "strasse"), ("Đorđević", "dordevic"), ("U.S.A.", "usa"), ("3.14", "3.14"), ("don't", "dont"), ("-cat-", "cat"), ("well-known", "well-known"), ("1.2.3.", "1.2.3"), ("×÷", ""), ("ЖУК", "ЖУК"), ("Ĳs", "ijs")],
)
def test_normalize(token, term):
    assert tx.normalize(token) == term


def test_fold_covers_both_blocks():
    assert len(tx.FOLD) == 192
    assert all(v.isascii() and v == v.lower() for v in tx.FOLD.values())


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"),
        ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"),
        ("adoption", "adopt"), ("revival", "reviv"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("yying", "yy"), ("is", "is"),
    ],
)
def test_stem(word, stem):
    assert tx.stem(word) == stem


def _measure(word):
    kinds = "".join("c" if c else "v" for c in tx.consonants(word))
    return sum(a + b == "vc" for a, b in zip(kinds, kinds[1:]))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aeiouybtswlx", max_size=9))
def test_measure_patterns_equal_the_definition(word):
    marked = "Y" + word[1:] if word.startswith("y") else word
    m = _measure(word)
    assert bool(tx._m0.search(marked)) == (m > 0)
    assert bool(tx._m1.search(marked)) == (m == 1)
    assert bool(tx._m2.search(marked)) == (m > 1)
    assert bool(tx._vowel.search(marked)) == (not all(tx.consonants(word)))
    if word:
        assert tx._consonant_end(marked) == tx.consonants(word)[-1] or marked[-1] == "Y"


def test_stem_info():
    assert tx.stem_info("troubles") == {"measure": 2, "vowel": True, "double": False, "cvc": True}
    assert tx.stem_info("hop")["cvc"] and not tx.stem_info("snow")["cvc"] and tx.stem_info("fall")["double"]


def test_analysis_leaves_gaps_and_splits_compounds():
    assert tx.analyze("The cat, ... sat!") == [(1, 4, "cat"), (3, 13, "sat")]
    assert [t for _, _, t in tx.analyze("covid-19 and/or")] == ["covid", "19"]
    assert tx.title_span("Well-known: -/- facts") == 3
    assert tx.query_terms(["the Cats", "running/dogs"]) == ["cat", "run", "dog"]


def test_stopwords():
    assert len(set(map(tx.normalize, tx.STOPWORDS))) == 178
    assert tx.is_stopword("dont") and not tx.is_stopword("don't") and not tx.is_stopword("cat")


def test_native_columns_equal_python(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioubtswlxyyYÉßжに.'-19/ ") for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    words += [a + b for a in ("relat", "hopp", "yell", "tomж", "agr", "жs") for b, _ in (*tx.STEP_2, *tx.STEP_3)] + ["yed", "yying", "eedd", "sses", "oyyed", "ayyed", "xyyed"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", tx.pieces_column(F.col("w")).alias("p"), tx.normalize_column(F.col("w")).alias("n")).collect()
    for r in rows:
        assert r.p == [x for _, _, x in tx.split_compounds(r.w)]
        assert r.n == tx.normalize(r.w)
    terms = sorted({tx.normalize(w) for w in words} - {""})
    got = spark.createDataFrame([(t,) for t in terms], "t string").select("t", tx.stem_column(F.col("t")).alias("s"), tx.stopword_column(F.col("t")).alias("stop")).collect()
    for r in got:
        assert r.s == tx.stem(r.t), r.t
        assert r.stop == tx.is_stopword(r.t)


def test_analyzed_rows(spark):
    docs = spark.createDataFrame([(1, "Big Cats", "Cats eat. The cat sat"), (2, None, None), (3, "", "the of")], "doc_id long, title string, body string")
    rows = {r.doc_id: r for r in tx.analyzed(docs).collect()}
    assert rows[1].length == 6 and rows[1].title_span == 2 and rows[1].title_terms == 2
    assert {t.term: t.positions for t in rows[1].terms} == {"big": [0], "cat": [1, 2, 5], "eat": [3], "sat": [6]}
    assert rows[2].length == rows[3].length == 0 and rows[2].terms == []
