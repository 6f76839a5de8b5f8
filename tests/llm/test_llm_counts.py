import datetime
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetext.llm import common, distinctive, mixing, site_lines, term_counts, top_items

AT = datetime.datetime(2024, 1, 1)
DOCS = "doc_id string, title string, body string, imported_at timestamp, term string, _k string, _t int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, AT, "clash", "clash", 1) for r in rows], DOCS)


ROWS = [("d1", "A", "Red red blue_x 12"), ("d2", "B", "red"), ("d1", "A", "Red red blue_x 12"), ("d3", None, None), ("d4", "T", ""), ("d5", "", "é É x²"), (None, "N", "never"), ("d6", "W", "word " * 50_000)]


def test_term_counts_equal_brute_force(spark):
    got = {r.term: (r.occurrences, r.documents) for r in term_counts.term_counts(docs_frame(spark, ROWS)).collect()}
    assert got == {"red": (3, 2), "blue": (1, 1), "x": (1, 1), "12": (1, 1), "é": (2, 1), "x²": (1, 1), "word": (50_000, 1)}


def test_radix_splits_give_the_same(spark):
    rng = random.Random(1)
    rows = [(f"d{i}", "", " ".join(f"w{int(rng.paretovariate(0.6)) % 20_000}" for _ in range(300))) for i in range(300)]
    df = docs_frame(spark, rows)
    want = {tuple(r) for r in term_counts.term_counts(df).collect()}
    tiny = {tuple(r) for r in term_counts.term_counts(df, part_bytes=4_000).collect()}
    occurrences, inside = Counter(), Counter()
    for _, _, body in rows:
        occurrences.update(body.split())
        inside.update(set(body.split()))
    assert want == tiny == {(t, n, inside[t]) for t, n in occurrences.items()}


def test_production_parts_are_split(spark, monkeypatch):
    """With the production parameter a task of some hundred thousand terms splits its part on disk."""
    calls = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([hash(("t", i % 20_000)) & (1 << 62) - 1 for i in range(40_000)]), pa.array([f"t{i % 20_000}" for i in range(40_000)]), pa.array([2] * 40_000), pa.array([1] * 40_000)], schema=term_counts._COUNTS)
    made = term_counts.pq.ParquetWriter
    monkeypatch.setattr(term_counts.pq, "ParquetWriter", lambda *a: calls.append(a) or made(*a))
    out = list(term_counts._reduce(term_counts.PART_BYTES)(iter([batch.slice(i, 5_000) for i in range(0, 40_000, 5_000)])))
    rows = sorted(x for b in out for x in zip(*(c.to_pylist() for c in b.columns)))
    assert rows == sorted((f"t{i}", 4, 2) for i in range(20_000)) and len(calls) >= term_counts.FAN


def test_bands(spark):
    rows = [(f"d{i}", "", "all " + ("some " if i < 3 else "") + f"own{i}" + (" edge" if i < 6 else "")) for i in range(40)] + [("x", "", "..."), ("y", "", None)]
    bands = {r.term: r.band for r in term_counts.term_bands(docs_frame(spark, rows)).collect()}
    assert bands["all"] == "common" and bands["own5"] == "rare" and bands["some"] == "useful"
    assert bands["edge"] == "useful"  # 6 of 40 are 15 of every 100, no more
    assert term_counts.term_bands(docs_frame(spark, [])).count() == 0


def test_dictionary_is_set_anew(spark):
    old = spark.createDataFrame([("red", 9, 0, AT), ("red", 9, 0, AT), ("red", 1, 0, AT - datetime.timedelta(1)), ("gone", None, 1, None), (None, 1, 1, AT)], "term string, document_frequency long, shard int, built_at timestamp")
    got = sorted(map(tuple, term_counts.refreshed_completions(old, docs_frame(spark, ROWS)).collect()))
    assert got == [("gone", 1, None, 0), ("red", 0, 9, 2)]


# Problem 2


def results_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "query_id string, document_id string, score double, rank string, _g int")


def best_by_hand(rows, n):
    best = defaultdict(dict)
    for q, d, s in rows:
        if q is not None and d is not None and s is not None and math.isfinite(s):
            best[q][d] = max(s, best[q].get(d, -math.inf))
    return {(q, d) for q, items in best.items() for d, _ in sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:n]}


@pytest.mark.parametrize("heavy", [1, 3, 100, 10**6])
def test_top_items_equal_brute_force(spark, heavy):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + [f"q{i}" for i in range(20)]), f"d{rng.randint(0, 90)}" if rng.random() > 0.02 else None, rng.choice([1.0, 2.0, 2.5, -0.0, 0.0, None, float("nan"), float("inf"), -float("inf"), rng.random()])) for _ in range(3000)]
    rows += [("warm", f"d{i}", 1.0) for i in range(60)] + [(None, "d1", 1.0), ("é", "Z", 1.0), ("é", "a", 1.0), ("é", "ä", 1.0)]
    got = top_items.top_items(results_frame(spark, rows), "query_id", "document_id", "score", 10, heavy).collect()
    assert {(r.query_id, r.document_id) for r in got} == best_by_hand(rows, 10) and len(got) == len({(r.query_id, r.document_id) for r in got})
    ranks = defaultdict(list)
    for r in got:
        ranks[r.query_id].append(r.rank)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in ranks.values())


def test_heavy_groups_take_the_salted_path(spark):
    """Production parameters: a group with a tenth of the rows is range-sorted in salted parts, and the plan has both ways."""
    rows = [("q1", f"d{i}", float(i % 97)) for i in range(400)] + [(f"q{i % 300}", f"e{i}", float(i)) for i in range(3600)]
    top = top_items.top_items(results_frame(spark, rows), "query_id", "document_id", "score")
    assert {(r.query_id, r.document_id) for r in top.collect()} == best_by_hand(rows, 10)
    plan = top._jdf.queryExecution().toString()
    ranged = [line for line in plan.split("== Physical Plan ==")[-1].split("\n") if "Exchange rangepartitioning(_g" in line and "_salt" in line]
    assert ranged and "Union" in plan and "LeftAnti" in plan
    loose = results_frame(spark, rows).filter("query_id = 'q1'")
    assert loose.count() * top_items.HEAVY >= len(rows)


def test_judged_top_and_empty(spark):
    judged = spark.createDataFrame([("q1", "a"), ("q1", "a"), (None, "b"), ("q9", None)], "query_id string, text string")
    rows = [("q1", "d1", 1.0), ("q2", "d1", 1.0), ("q1", "d1", 3.0)]
    assert [(r.query_id, r.document_id, r.score) for r in top_items.judged_top(results_frame(spark, rows), judged).collect()] == [("q1", "d1", 3.0)]
    assert top_items.judged_top(results_frame(spark, []), judged).count() == 0


# Problem 3


def em_by_hand(tf, background, mix=0.1, rounds=100, tol=1e-5):
    p = {t: n / sum(tf.values()) for t, n in tf.items()}
    for _ in range(rounds):
        e = {t: tf[t] * mix * p[t] / (mix * p[t] + (1 - mix) * background[t]) for t in tf}
        new = {t: x / sum(e.values()) for t, x in e.items()}
        moved = max(abs(new[t] - p[t]) for t in tf)
        p = new
        if moved < tol:
            break
    return p


def test_weights_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"d{i}", rng.choice([None, "", "Title words"]), " ".join(rng.choice(["the", "of", f"n{rng.randint(0, 30)}", f"r{i}"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [rows[5], rows[5], ("empty", None, None), (None, "x", "y"), ("tie", "", "zz aa")]
    distinct = {k: (t or "") + "\n" + (b or "") for k, t, b in rows if k}
    tfs = {k: Counter(common.TERM.findall(x.lower())) for k, x in distinct.items()}
    tfs = {k: c for k, c in tfs.items() if c}
    df, cf = Counter(t for c in tfs.values() for t in c), sum(tfs.values(), Counter())
    mass = sum(cf.values())
    got = distinctive.term_weights(docs_frame(spark, rows)).collect()
    assert {(r.doc_id, r.term): (r.tf, r.documents) for r in got} == {(k, t): (n, df[t]) for k, c in tfs.items() for t, n in c.items()}
    for k in ("d1", "d7", "tie"):
        want = em_by_hand(tfs[k], {t: cf[t] / mass for t in cf}) if k in tfs else {}
        assert {r.term: r.probability for r in got if r.doc_id == k} == pytest.approx(want, abs=1e-9)
    best = {k: min(c, key=lambda t: (-(1 + math.log(c[t])) * math.log(len(tfs) / df[t]), t.encode())) for k, c in tfs.items()}
    top = {r.doc_id: r.term for r in distinctive.top_term(docs_frame(spark, rows)).collect()}
    assert top == best and top["tie"] == "aa"
    assert distinctive.top_term(docs_frame(spark, [])).count() == 0
    assert distinctive.top_term(docs_frame(spark, [("d", None, "..")]), by="probability").count() == 0


def test_records_are_made_whole():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i:j]), "v": pa.array(range(i, j))}) for i, j in ((0, 1), (1, 1), (1, 4), (4, 6), (6, 7), (7, 9), (9, 10), (10, 11))]
    out = list(distinctive.whole_records(iter(batches)))
    assert [k for b in out for k in b.column(0).to_pylist()] == keys and [v for b in out for v in b.column(1).to_pylist()] == list(range(11))
    assert all(set(a.column(0).to_pylist()).isdisjoint(b.column(0).to_pylist()) for i, a in enumerate(out) for b in out[:i])
    assert list(distinctive.whole_records(iter([]))) == []


def test_own_terms_beat_common_ones():
    p = distinctive.parsimonious(np.array([10.0, 2.0, 5.0]), np.array([0.2, 0.0001, 0.3]), np.array([0, 0, 1]))
    assert p[1] / p[0] > 4 * 2 / 10 and p[2] == pytest.approx(1.0)


# Problem 7


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, text string, host string, line_no string")


def test_repeated_lines(spark):
    rows = [(i, f"http{'s' * (i % 2)}://{'WWW' if i % 3 else 'www'}.A.test:80{i}/p{i}", f"SHARE this!\r\nown text {'abcdefghijkl'[i]}\n\n*** 12\nSHARE THIS") for i in range(8)]
    rows += [(8, "http://b.test/", "share this"), (9, None, "share this"), (10, "http://www.a.test", None), (None, "http://www.a.test", "share this"), (0, *rows[0][1:])]
    got = sorted((r.page_id, r.line_no) for r in site_lines.repeated_lines(pages_frame(spark, rows)).collect())
    assert got == sorted((i, n) for i in range(8) for n in (1, 5))
    assert site_lines.repeated_lines(pages_frame(spark, rows), least=9).count() == 0
    whole = {r.page_id: r for r in site_lines.without_repeated_lines(pages_frame(spark, rows)).collect()}
    assert whole[2].text == "own text c\n\n*** 12" and whole[2].dropped == 2 and whole[9].text == "share this" and whole[10].text is None
    assert site_lines.repeated_lines(pages_frame(spark, [])).count() == 0


@pytest.mark.parametrize("url", ["http://User:pw@Host.Test:80/x?y", "//host.test/a", "host.test/a", "HTTPS://HOST.test", " http://host.test#f"])
def test_hosts(spark, url):
    assert common.host_text(url) == "host.test"
    assert spark.createDataFrame([(url,)], "u string").select(common.host_of(F.col("u")).alias("h")).first().h == "host.test"


def test_skew_safe_join_equals_join(spark):
    rows = spark.range(5000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    rows = rows.unionByName(spark.range(3000).select((F.col("id") + 100).alias("k"), "id"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    got = common.skew_safe_join(rows, counts, ["k"], "n", total)
    assert sorted(map(tuple, got.select("k", "id", "n").collect())) == sorted(map(tuple, rows.join(counts, "k").select("k", "id", "n").collect()))


# Problem 9


def test_water_filling():
    assert mixing.water_fill([0.5, 0.5], [100, 100], 100) == [50, 50]
    assert mixing.water_fill([0.5, 0.3, 0.2], [10, 100, 100], 100) == pytest.approx([10, 54, 36])
    assert mixing.water_fill([0.5, 0.5], [10, 20], 100) == [10, 20]
    assert mixing.water_fill([0.6, 0.4], [0, 50], 40) == [0, 40]
    assert mixing.water_fill([], [], 5) == []
    share, cap = [0.4, 0.3, 0.2, 0.1], [5, 40, 200, 3]
    got = mixing.water_fill(share, cap, 100)
    assert sum(got) == pytest.approx(100) and all(g <= c + 1e-9 for g, c in zip(got, cap))
    free = [g / s for g, s, c in zip(got, share, cap) if g < c - 1e-9]
    assert free == pytest.approx([free[0]] * len(free))


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("word" for _ in range(rng.randint(1, 60))), s) for i, s in enumerate(["big"] * 900 + ["small"] * 60 + ["tiny"] * 10 + ["other"] * 20)]
    rows += [(5000, None, "big"), (5001, "", "small"), (5002, "x y", None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.1, 2), ("none", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mixture(docs, targets)
    out = mixed.collect()
    tokens = Counter()
    copies = Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
        copies[r.doc_id] += 1
    got = {r.source: r for r in shares.collect()}
    assert {s: r.mixture_tokens for s, r in got.items() if r.mixture_tokens} == dict(tokens)
    assert set(tokens) == {"big", "small", "tiny"} and got["none"].mixture_tokens == 0
    assert max(copies[i] for i in range(900)) == 1 and max(copies[i] for i in range(900, 960)) <= 4 and {copies[i] for i in range(960, 970)} == {2}
    assert abs(sum(r.reached_share for r in got.values()) - 1) < 1e-9
    for r in got.values():
        assert abs(r.mixture_tokens - r.planned_tokens) <= 60  # half of the last record, of 60 words at most, which have 2 tokens at most
        assert r.planned_share == pytest.approx(r.planned_tokens / sum(x.available_tokens for x in got.values()))
    again = mixing.mixture(docs.repartition(7), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out))
    other = mixing.mixture(docs, targets, seed=7)[0]
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, out))
    # By brute force: whole repetitions, then the records in seeded order while one brings the tokens nearer to the plan.
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(42), F.col("doc_id"), F.col("text")).alias("h")).collect()}
    unsigned = lambda i: (hashes[i] % (1 << 64) >> 48, hashes[i], i)
    sizes = {r.doc_id: (r.source, r.n_tokens) for r in out}
    for s, r in got.items():
        own = sorted((i for i in sizes if sizes[i][0] == s), key=unsigned)
        if not own or r.planned_tokens >= r.max_repeats * r.available_tokens:
            continue
        counts = [copies[i] for i in own]
        least = int(r.planned_tokens // r.available_tokens)
        assert set(counts) <= {least, least + 1}
    empty, none = mixing.mixture(docs.limit(0), targets)
    assert empty.count() == 0 and none.filter("mixture_tokens > 0").count() == 0


@pytest.mark.parametrize("ranges", [0, 1])
def test_broken_repetitions_equal_brute_force(spark, ranges):
    """One range and many, a source of few long texts, equal hashes, targets of nothing and of all."""
    rng = random.Random(14)
    for left in (0, 1, 40, 333, 10**9):
        rows = [(i, s, rng.choice([0, 1, 7, -3]) * (1 if ranges == 0 else 1 << 55) + rng.randint(0, 5), rng.choice([1, 5, 90])) for s in "ab" for i in range(60)]
        frame = spark.createDataFrame([(i if s == "a" else 100 + i, s, h, n) for i, s, h, n in rows], "_k long, _s string, _h long, n_tokens long")
        plan = spark.createDataFrame([("a", float(left), 1.0, 10**8), ("b", 20.0, 0.5, 10**8), ("c", 9.0, 0.5, 10**8)], "source string, planned_tokens double, epochs double, available_tokens long").withColumn("epochs", F.lit(0.0))
        got = {(r._s, r._k) for r in mixing.broken_repetition(frame, plan).collect()}
        want = set()
        for s, target in (("a", left), ("b", 20)):
            line = sorted((h % (1 << 64) >> 48, h, k, n) for k, t, h, n in map(tuple, frame.collect()) if t == s)
            if sum(x[3] for x in line) < target or target <= 0:
                continue
            total = 0
            for _, _, k, n in line:
                total += n
                if total - n / 2 <= target:
                    want.add((s, k))
        assert got == want, left


@pytest.mark.parametrize("keys", [0, 1, 100])
def test_one_row_for_each_key(spark, keys):
    at = [AT + datetime.timedelta(i) for i in range(3)]
    rows = [("a", "x", at[0]), ("a", "y", at[1]), ("a", "z", at[0]), ("b", None, None), ("c", "p", at[2]), ("c", "q", at[2]), (None, "n", at[0]), ("d", "r", at[0]), ("d", "r", at[1])]
    df = spark.createDataFrame(rows, "k string, v string, t timestamp")
    assert sorted(map(tuple, common.one_per(df, "k", "t", keys).select("k", "v").collect())) == [("a", "y"), ("b", None), ("c", "q"), ("d", "r")]
    assert common.one_per(df.limit(0), "k").count() == 0
    assert common.one_per(df.filter("k IN ('b', 'c') AND v IS NOT NULL"), "k", "t", keys).count() == 1
