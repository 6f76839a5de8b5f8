"""Whole query logs over blocks of documents.

The postings of a log's terms move once, packed and compressed, into blocks of documents; every block gets the whole log and answers it
alone, so no pair of a query and a document ever leaves the task that made it, and most are never made: a block's lists are also kept by
weight, and once a few heads of the lists have given a query k scores, only documents that can reach the least of them are looked at.
The results are those of scoring everything.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.language import Leaf, Plan

#: Contributions are whole multiples of this, so that their sum has the same bits in any order.
UNIT = 2.0**-40

#: Postings of a block: what a task holds of the index.
BLOCK_POSTINGS = 4_000_000

#: Postings that are worth a block of their own while there are idle cores.
LEAST_POSTINGS = 50_000

#: Rows of postings that a task packs together, or so many for each block.
PACKED_ROWS, PACKED_ROWS_OF_BLOCK = 200_000, 2_000

#: Documents up to which a query's candidates are scored without looking for bounds.
DIRECT = 2_048

#: Length from which a list is looked up in an array of all documents, and how many cells of such arrays are kept.
DENSE_LENGTH, DENSE_CELLS = 512, 8_000_000

_POSTINGS, _DOCUMENTS, _QUERIES = range(3)


def plan_of(x: dict) -> Plan:
    return Plan("leaf", Leaf(tuple(x["t"]), tuple(x["o"]))) if "t" in x else Plan(x["k"], children=[plan_of(c) for c in x["c"]])


def cover(plan: Plan, df: dict[str, int]) -> list[str] | None:
    """The fewest postings' terms of which every match has one at least, or None if there are none: a leaf's rarest term, an AND's
    cheapest part, all parts of an OR."""
    if plan.leaf:
        return [min(plan.leaf.terms, key=lambda t: (df.get(t, 0), t))]
    if plan.kind == "not":
        return None
    parts = [cover(c, df) for c in plan.children]
    if plan.kind == "or":
        return None if any(p is None for p in parts) else sorted({t for p in parts for t in p})
    held = [p for p in parts if p is not None]
    return min(held, key=lambda p: (sum(df.get(t, 0) for t in p), p)) if held else None


def used_terms(asked: DataFrame) -> DataFrame:
    """(term, phrased): the distinct terms of queries (plan, terms), and whether one is part of a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, bool] = {}
            for plan, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found |= {t: found.get(t, False) for t in terms}
                for leaf in plan_of(json.loads(plan)).leaves() if plan else ():
                    found |= {t: found.get(t, False) or len(leaf.terms) > 1 for t in leaf.terms}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.bool_())], names=["term", "phrased"])

    return asked.select("plan", "terms").mapInArrow(run, "term string, phrased boolean").groupBy("term").agg(F.max("phrased").alias("phrased"))


def block_count(postings: int, cores: int) -> int:
    return max(1, -(-postings // BLOCK_POSTINGS), min(cores, -(-postings // LEAST_POSTINGS)))


def _bytes_of(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _packed(rows: DataFrame, kind: int, blocks: int, everywhere: bool = False) -> DataFrame:
    """Rows as (block, kind, payload): those with a column ``block`` in their blocks, or all in every block. Weights and terms repeat
    often within a list and are stored as dictionaries."""
    most = max(PACKED_ROWS, PACKED_ROWS_OF_BLOCK * blocks)

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        for name in ("term", "w"):
            if name in table.column_names:
                at = table.column_names.index(name)
                table = table.set_column(at, name, table.column(name).combine_chunks().dictionary_encode())
        if everywhere:
            one = _bytes_of(table)
            out = [(b, one) for b in range(blocks)]
        else:
            block = table.column("block").to_numpy()
            table = table.drop_columns(["block"]).take(pa.array(np.argsort(block, kind="stable")))
            ends = np.cumsum(np.bincount(block, minlength=blocks))
            out = [(b, _bytes_of(_own(table.slice(start, end - start)))) for b, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if end > start]
        cols = (pa.array([b for b, _ in out], pa.int32()), pa.array([kind] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary()))
        return pa.RecordBatch.from_arrays([*cols], names=["block", "kind", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(run, "block int, kind int, payload binary")


def _own(table: pa.Table) -> pa.Table:
    """A slice with the dictionaries of its own values alone."""
    for i, name in enumerate(table.column_names):
        if pa.types.is_dictionary(table.schema.field(i).type):
            column = table.column(i).combine_chunks()
            table = table.set_column(i, name, column.dictionary_decode().dictionary_encode())
    return table


class _Block:
    """Documents and postings of a block. Documents are numbered in their order; a list has its documents in order, with weights."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.queries: list[bytes] = []
        self._ids: list[pa.Array] = []
        self._parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray | None, np.ndarray | None]] = []

    def add(self, kind: int, payload: bytes) -> None:
        if kind == _QUERIES:
            self.queries.append(payload)
            return
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        if kind == _DOCUMENTS:
            self._ids.append(ids)
            return
        term, w = table.column("term").combine_chunks(), table.column("w").combine_chunks()
        slot = np.array([self.slots.setdefault(t, len(self.slots)) for t in term.dictionary.to_pylist()], np.int32)[term.indices.to_numpy()]
        weights = w.dictionary.to_numpy()[w.indices.to_numpy()]
        lengths = flat = None
        if "positions" in table.column_names:
            positions = table.column("positions").combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(positions), 0).to_numpy().astype(np.int32)
            flat = positions.flatten().to_numpy().astype(np.int32)
        self._parts.append((slot, ids, weights, lengths, flat))

    def build(self) -> None:
        parts, self._parts = self._parts, []
        known = pa.chunked_array([*self._ids, *(p[1] for p in parts)]) if self._ids or parts else pa.chunked_array([pa.array([], pa.int64())])
        ids = pc.unique(known)
        self.ids = ids.take(pc.sort_indices(ids))
        self._ids = []
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.places: dict[str, np.ndarray] = {}
        self._heads: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._dense: dict[str, np.ndarray] = {}
        if not parts:
            return
        slot = np.concatenate([p[0] for p in parts])
        docs = np.concatenate([pc.index_in(p[1], value_set=self.ids).to_numpy() for p in parts]).astype(np.int64)
        order = np.argsort(slot.astype(np.int64) << 32 | docs, kind="stable")
        weights = np.concatenate([p[2] for p in parts])[order]
        ends = np.cumsum(np.bincount(slot, minlength=len(self.slots)))
        docs = docs[order]
        bounds = {t: (int(ends[i - 1]) if i else 0, int(ends[i])) for t, i in self.slots.items()}
        if parts[0][3] is not None:
            lengths = np.concatenate([p[3] for p in parts])
            flat = np.concatenate([p[4] for p in parts])
            starts = (np.cumsum(lengths, dtype=np.int64) - lengths)[order]
            lengths = lengths[order].astype(np.int64)
            till = np.cumsum(lengths)
            places = np.repeat(starts - (till - lengths), lengths) + np.arange(len(flat))
            keys = np.repeat(docs, lengths) << 32 | flat[places]
            before = np.concatenate([[0], till])
            self.places = {t: keys[before[a] : before[b]] for t, (a, b) in bounds.items() if before[b] > before[a]}
        docs = docs.astype(np.int32)
        self.lists = {t: (docs[a:b], weights[a:b]) for t, (a, b) in bounds.items()}

    def head(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        """A list's documents and its negative weights, by weight from the top."""
        if term not in self._heads:
            docs, weights = self.lists[term]
            order = np.argsort(-weights, kind="stable")
            self._heads[term] = docs[order], -weights[order]
        return self._heads[term]

    def weights(self, term: str, at: np.ndarray) -> np.ndarray:
        """The term's weight in each of the documents, -1 where it is not."""
        if term not in self.lists:
            return np.full(len(at), -1, np.int64)
        docs, weights = self.lists[term]
        if len(docs) < DENSE_LENGTH:
            i = np.minimum(docs.searchsorted(at), len(docs) - 1)
            return np.where(docs[i] == at, weights[i], -1)
        cells = self._dense.get(term)
        if cells is None:
            if (len(self._dense) + 1) * len(self.ids) > DENSE_CELLS:
                self._dense.clear()
            cells = self._dense[term] = np.full(len(self.ids), -1, np.int64)
            cells[docs] = weights
        return cells[at]

    def phrase(self, leaf: Leaf) -> np.ndarray:
        """The documents that hold a phrase, in order."""
        if any(t not in self.places for t in leaf.terms):
            return np.empty(0, np.int32)
        parts = sorted(zip(leaf.terms, leaf.offsets, strict=True), key=lambda p: len(self.places[p[0]]))
        starts = self.places[parts[0][0]] - parts[0][1]
        for t, o in parts[1:]:
            keys, wanted = self.places[t], starts + o
            starts = starts[keys[np.minimum(keys.searchsorted(wanted), len(keys) - 1)] == wanted]
        docs = (starts >> 32).astype(np.int32)
        return docs[np.concatenate([[True], docs[1:] != docs[:-1]])] if len(docs) else docs

    def joined(self, terms: list[str]) -> np.ndarray:
        """The documents with one of the terms, in order."""
        return _union([self.lists[t][0] for t in terms if t in self.lists])


def _union(lists: list[np.ndarray]) -> np.ndarray:
    if len(lists) == 1:
        return np.sort(lists[0])
    return np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int32)


class _Query:
    """A query in a block: a plan, or a bag of terms where any will do."""

    def __init__(self, block: _Block, plan: Plan | None, terms: list[str], k: int, digits: int | None) -> None:
        self.block, self.plan, self.k, self.digits = block, plan, k, digits
        self.times = Counter(terms)
        self._phrases: dict[Leaf, np.ndarray] = {}

    def _held(self, plan: Plan, at: np.ndarray, found: dict[str, np.ndarray]) -> np.ndarray:
        if plan.leaf and len(plan.leaf.terms) == 1:
            term = plan.leaf.terms[0]
            if term not in found:
                found[term] = self.block.weights(term, at)
            return found[term] >= 0
        if plan.leaf:
            if plan.leaf not in self._phrases:
                self._phrases[plan.leaf] = self.block.phrase(plan.leaf)
            docs = self._phrases[plan.leaf]
            return docs[np.minimum(docs.searchsorted(at), len(docs) - 1)] == at if len(docs) else np.zeros(len(at), bool)
        parts = (self._held(c, at, found) for c in plan.children)
        if plan.kind == "not":
            return ~next(parts)
        out = next(parts)
        for p in parts:
            out = out & p if plan.kind == "and" else out | p
        return out

    def scored(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches among documents in order, and their scores in UNITs."""
        found = {t: self.block.weights(t, at) for t in self.times}
        sums = np.zeros(len(at), np.int64)
        for t, n in self.times.items():
            sums += np.maximum(found[t], 0) * n
        if self.plan is None:
            return at, sums
        keep = self._held(self.plan, at, found)
        return at[keep], sums[keep]

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents and their scores, by score and then document."""
        at, sums = self._candidates()
        value = sums * UNIT
        if self.digits is not None:
            value = np.floor(value * 10.0**self.digits + 0.5) / 10.0**self.digits
        if len(at) > self.k:
            least = np.partition(value, len(at) - self.k)[len(at) - self.k]
            keep = value >= least
            at, value = at[keep], value[keep]
        order = np.lexsort((at, -value))[: self.k]
        return at[order], value[order]

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        block, plan = self.block, self.plan
        own = list(self.times) if plan is None else list(dict.fromkeys(t for leaf in plan.leaves() for t in leaf.terms))
        if plan is not None and plan.holds(lambda leaf: False):  # documents without any of the terms match too, with score 0
            at = block.joined(own)
            free = np.ones(len(block.ids), bool)
            free[at] = False
            return self.scored(np.sort(np.concatenate([at, np.flatnonzero(free)[: self.k].astype(np.int32)])))
        if plan is not None and plan.leaf and len(plan.leaf.terms) > 1:
            self._phrases[plan.leaf] = block.phrase(plan.leaf)
            return self.scored(self._phrases[plan.leaf])
        size = {t: len(block.lists[t][0]) if t in block.lists else 0 for t in {*own, *self.times}}
        needed = own if plan is None else cover(plan, size) or own
        most = sum(size[t] for t in needed)
        if most > max(DIRECT, 8 * self.k):
            at = self._bounded(most, size)
            if at is not None:
                return self.scored(at)
        return self.scored(block.joined(needed))

    def _bounded(self, most: int, size: dict[str, int]) -> np.ndarray | None:
        """Documents that can be among the k best, if they are fewer than ``most``.

        The heads of the lists give k scores, the least of which is a bound. Of a document that reaches it, the terms that could not
        reach it together (the first of them in order of length) must give what the others can't, so one of those gives its share or more."""
        block = self.block
        never = {c.children[0].leaf.terms[0] for c in (self.plan.children if self.plan and self.plan.kind == "and" else ()) if c.kind == "not" and c.children[0].leaf and len(c.children[0].leaf.terms) == 1}
        terms = sorted((t for t in self.times if size[t] and t not in never), key=lambda t: size[t])
        tops = {t: -int(block.head(t)[1][0]) * self.times[t] for t in terms}
        depth = max(256, 4 * self.k)
        while terms:
            heads = _union([block.head(t)[0][:depth] for t in terms])
            at, sums = self.scored(heads)
            ends = None
            if len(at) >= self.k:
                bound = int(np.partition(sums, len(at) - self.k)[len(at) - self.k])
                if self.digits is not None:
                    bound -= int(10.0**-self.digits / UNIT) + 1  # what rounding makes equal
                least = most
                for e in range(1, len(terms) + 1):
                    share, whole = bound - sum(tops[t] for t in terms[e:]), sum(tops[t] for t in terms[:e])
                    if share > 0:
                        cuts = {t: int(block.head(t)[1].searchsorted(-(share * tops[t] // whole // self.times[t]), "right")) for t in terms[:e]}
                        if sum(cuts.values()) < least:
                            least, ends = sum(cuts.values()), cuts
            if ends is not None and least <= 4 * len(heads):
                return _union([block.head(t)[0][:n] for t, n in ends.items()])
            if depth * len(terms) * 8 >= most:
                return None if ends is None else _union([block.head(t)[0][:n] for t, n in ends.items()])
            depth *= 8
        return None


def _answered(k: int, digits: int | None):
    def rows(block: _Block) -> Iterator[pa.RecordBatch]:
        block.build()
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            counts = [len(at) for _, at, _ in out]
            n = np.repeat(np.array([n for n, _, _ in out], np.int64), counts)
            last = np.zeros(len(n), bool)
            ends = np.cumsum(counts)
            last[ends[np.array(counts) == k] - 1] = True
            ids = block.ids.take(pa.array(np.concatenate([at for _, at, _ in out])))
            return pa.RecordBatch.from_arrays([pa.array(n), ids, pa.array(np.concatenate([v for _, _, v in out])), pa.array(last)], names=["n", "doc_id", "score", "more"])

        for payload in block.queries:
            table = pa.ipc.open_stream(payload).read_all()
            for n, plan, terms in zip(*(table.column(c).to_pylist() for c in ("n", "plan", "terms")), strict=True):
                at, value = _Query(block, plan_of(json.loads(plan)) if plan else None, terms, k, digits).best()
                if len(at):
                    out.append((n, at, value))
                    size += len(at)
                if size >= 50_000:
                    yield batch()
                    out.clear()
                    size = 0
        if out:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        for batch in batches:
            for b, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks.setdefault(b, _Block()).add(kind, payload)
        for b in list(blocks):
            yield from rows(blocks.pop(b))

    return run


def answered(postings: DataFrame, docs: DataFrame | None, asked: DataFrame, blocks: int, k: int, digits: int | None = None) -> DataFrame:
    """(n, doc_id, score, more): the k best documents of each block for every query (n, plan, terms) of ``asked``; more marks the last
    of k, after which the block may have others. ``postings`` (term, doc_id, w, perhaps positions) are those of the log's terms with
    their contributions in UNITs; ``docs`` (doc_id) are given where queries can hold for documents with none of their terms."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    rows = _packed(postings.select("*", block), _POSTINGS, blocks).unionByName(_packed(asked.select("n", "plan", "terms"), _QUERIES, blocks, everywhere=True))
    if docs is not None:
        rows = rows.unionByName(_packed(docs.select("doc_id", block), _DOCUMENTS, blocks))
    kind = postings.schema["doc_id"].dataType.simpleString()
    return rows.repartitionById(blocks, F.col("block")).mapInArrow(_answered(k, digits), f"n long, doc_id {kind}, score double, more boolean")
