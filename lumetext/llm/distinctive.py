"""Problem 3: how characteristic a term is of its record.

Method: parsimonious language model. Expectation-maximisation parts each record's term mass into what the background model (the
term's share of all records) explains and what is the record's own; the converged probabilities rank its terms. The background
probabilities of the few hundred hottest terms, which most rows belong to, are broadcast; those of all others are joined.

The model's order is not that of the weight (1 + ln tf) * ln(N / df), which is a fixed result of its own: ``top_term`` by weight leaves
the expectation-maximisation out and chooses by the formula over the same stored records and background counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from .common import HOT, TERM, cut, one_per


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k, terms, tfs) of each record that has a term."""
    for batch in batches:
        where, terms, tfs, ends = [], [], [], [0]
        for i, (title, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            counts = Counter(TERM.findall(f"{title or ''}\n{body or ''}".lower()))
            if counts:
                where.append(i)
                terms.extend(counts)
                tfs.extend(counts.values())
                ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *lists], names=["_k", "terms", "tfs"])


def _pairs(hot: dict[str, int]):
    """(join, _k, tf, hot): a row for each record and term, but the record's hot terms together in one, whose join key is none: each
    as its number among the hot terms and its tf, in the halves of a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            join, where, tfs, packed, ends = [], [], [], [], [0]
            for i, (terms, counts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                before = len(packed)
                for term, n in zip(terms, counts, strict=True):
                    if term in hot:
                        packed.append(hot[term] << 32 | n)
                    else:
                        join.append(term)
                        where.append(i)
                        tfs.append(n)
                        ends.append(before)
                if len(packed) > before:
                    join.append(f" {i} {len(packed)}")  # spread like terms; no term holds a blank
                    where.append(i)
                    tfs.append(0)
                    ends.append(len(packed))
            # the hot terms of a record lie behind its other rows, whose lists are empty
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(packed, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(join, pa.string()), batch.column(0).take(pa.array(where, pa.int64())), pa.array(tfs, pa.int32()), lists], names=["join", "_k", "tf", "hot"])

    return run


def parsimonious(tf: np.ndarray, background: np.ndarray, record: np.ndarray, mix: float = 0.1, rounds: int = 100, tol: float = 1e-5) -> np.ndarray:
    """Converged P(term | record) of the flat arrays' (record, term) pairs.

    E: e = tf * mix * p / (mix * p + (1 - mix) * background); M: p = e / sum of e in the record. The start is tf / length. A record
    ends when no term of it moves by ``tol`` any more, so what it gets does not hang on the records that lie beside it.
    """
    if not len(tf):
        return np.empty(0)
    order = np.argsort(record, kind="stable")
    r, t, q = record[order], tf[order], background[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))  # where each record's terms begin
    size = np.diff(np.append(first, len(r)))
    p = t / np.repeat(np.add.reduceat(t, first), size)
    place, end = np.arange(len(r)), p.copy()
    for _ in range(rounds):
        own = mix * p
        e = t * own / (own + (1 - mix) * q)
        new = e / np.repeat(np.add.reduceat(e, first), size)
        moved = np.maximum.reduceat(np.abs(new - p), first) >= tol
        p = new
        if not moved.all():
            end[place] = p
            live = np.repeat(moved, size)
            t, q, p, place = t[live], q[live], p[live], place[live]
            size = size[moved]
            if not len(size):
                break
            first = np.cumsum(size) - size
    end[place] = p
    out = np.empty(len(record))
    out[order] = end
    return out


def starts_of(keys: pa.Array) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(keys):
        return np.empty(0, int)
    other = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(other) + 1))


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew so that no record is in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        last = int(starts_of(batch.column(0))[-1])
        if last or held and held[-1].column(0)[-1] != batch.column(0)[0]:
            done = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
            yield from (b for b in done if len(b))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _rank(mix: float, top: bool, n: int, mass: int, hot: list[tuple[str, int, int]]):
    names = pa.array([t for t, _, _ in hot], pa.string())
    hot_df, hot_cf = (np.array([h[i] for h in hot], float) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_records(batches):
            keys, term, tf, df, cf, common = batch.columns
            first = starts_of(keys)
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            key = keys.take(pa.array(first))
            tf, df, cf = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(float) for x in (tf, df, cf))
            single = tf > 0  # the others carry a record's hot terms
            hot_row = np.repeat(row, common.value_lengths().to_numpy(zero_copy_only=False))
            packed = common.flatten().to_numpy(zero_copy_only=False)
            which = packed >> 32
            term = pa.concat_arrays([term.filter(pa.array(single)), names.take(pa.array(which))])
            record = np.concatenate([row[single], hot_row])
            tf = np.concatenate([tf[single], (packed & 0xFFFFFFFF).astype(float)])
            df = np.concatenate([df[single], hot_df[which]])
            cf = np.concatenate([cf[single], hot_cf[which]])
            p = parsimonious(tf, cf / mass, record, mix)
            weight = (1 + np.log(tf)) * np.log(n / df)
            out = {"_k": key.take(pa.array(record)), "term": term, "tf": pa.array(tf.astype("int32")), "documents": pa.array(df.astype("int64")), "probability": pa.array(p), "weight": pa.array(weight)}
            if top:
                most = np.full(len(key), -np.inf)
                np.maximum.at(most, record, p)
                best: dict[int, tuple[bytes, int]] = {}
                for i in np.flatnonzero(p == most[record]):
                    mine = (term[int(i)].as_py().encode("utf-8", "surrogatepass"), int(i))
                    r = int(record[i])
                    if r not in best or mine < best[r]:
                        best[r] = mine
                chosen = pa.array([i for _, i in best.values()], pa.int64())
                out = {k: v.take(chosen) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


class _Collection:
    """The records' terms, tokenized once and stored, and the background counted over all of them."""

    def __init__(self, docs: DataFrame, key: str, title: str, body: str, latest: str | None) -> None:
        rows = docs.select(F.col(key).alias("_k"), F.col(title).alias("_title"), F.col(body).alias("_body"), *([F.col(latest).alias("_at")] if latest else []))
        texts = one_per(spread(rows), "_k", "_at" if latest else None).select("_k", "_title", "_body")
        self.kind = rows.schema["_k"].dataType.simpleString()
        self.records = cut(texts.mapInArrow(_tokenize, f"_k {self.kind}, terms array<string>, tfs array<int>"))
        self.pairs = self.records.select("_k", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("term", "tf"))
        self.background = cut(self.pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
        sums = self.background.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("cf"), F.lit(0)).alias("mass")).first()
        self.n, self.mass = self.records.count(), sums.mass
        # A term in a HOT-th of all pairs: HOT of them at most.
        self.hot = self.background.filter(F.col("df") * HOT >= sums.pairs)


def _modelled(c: _Collection, mix: float, top: bool) -> DataFrame:
    hot = sorted((r.term, r.df, r.cf) for r in c.hot.collect())
    loose = c.records.mapInArrow(_pairs({term: i for i, (term, _, _) in enumerate(hot)}), f"join string, _k {c.kind}, tf int, hot array<long>")
    joined = loose.join(c.background.withColumnRenamed("term", "join"), "join", "left")
    sorted_pairs = joined.select("_k", F.col("join").alias("term"), "tf", "df", "cf", "hot").repartition("_k").sortWithinPartitions("_k")
    return sorted_pairs.mapInArrow(_rank(mix, top, c.n, c.mass, hot), f"_k {c.kind}, term string, tf int, documents long, probability double, weight double")


def term_weights(docs: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body", latest: str | None = "imported_at", mix: float = 0.1) -> DataFrame:
    """(key, term, tf, documents, probability, weight) for every term of every record's title and body.

    ``probability`` is the term's converged share of the record's own term mass (``mix`` of a record's text is taken to be its
    own): near 0 for what the whole collection says, large for what this record says. ``weight`` is (1 + ln tf) * ln(N / df) on
    the same joined rows, N the number of records with any term. A null title or body counts as empty, rows of one key count
    once (of different ones the latest), a null key and a record without a term give no row, nor does an empty table.
    """
    return _modelled(_Collection(docs, key, title, body, latest), mix, False).withColumnRenamed("_k", key)


def top_term(docs: DataFrame, by: str = "weight", key: str = "doc_id", title: str = "title", body: str = "body", latest: str | None = "imported_at", mix: float = 0.1) -> DataFrame:
    """(key, term, ``by``): the one term of highest ``by`` (weight or probability) of each record, ties to the smallest term by bytes.

    By probability the model's ranked terms of a record lie together, so the choice costs no shuffle. By weight a record's hot terms are
    weighed where it lies and only the best of them moves; its other terms meet their background by term, and the best of each task
    moves on to the record.
    """
    c = _Collection(docs, key, title, body, latest)
    if by == "probability":
        return _modelled(c, mix, True).select(F.col("_k").alias(key), "term", by)
    first = F.min(F.struct((-(1 + F.log("tf")) * F.log(F.lit(float(c.n)) / F.col("df"))).alias("minus"), "term")).alias("best")
    hot = F.broadcast(c.hot.select("term", "df"))
    common = c.pairs.join(hot, "term").groupBy("_k").agg(first)
    rest = c.pairs.join(hot, "term", "left_anti").join(c.background.select("term", "df"), "term").groupBy("_k").agg(first)
    best = common.unionByName(rest).groupBy("_k").agg(F.min("best").alias("best"))
    return best.select(F.col("_k").alias(key), F.col("best.term").alias("term"), (-F.col("best.minus")).alias(by))
