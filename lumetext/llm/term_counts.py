"""Problem 1: how often every term occurs and in how many records.

Method: recursive radix spilling. Records are tokenized where they lie and counted there; the counts are partitioned by the upper
hash bits of their terms (Spark's shuffle files on disk). A task splits its part by further bits on disk, again and again where a
part is still over a memory budget, and DuckDB adds up each part out of core.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TERM, cut, one_per, scratch

#: Terms that a task counts in memory before it hands its counts on.
HELD_TERMS = 200_000

#: Bytes of counts that one DuckDB aggregation takes, about what a core's own cache holds; larger parts are split by further hash bits.
PART_BYTES = 256 << 10

#: Parts of one split, and splits at most: below the last, DuckDB itself spills.
FAN, DEPTH = 16, 4

#: The term under which the records with any term are counted; no text holds it.
RECORDS = ""

_COUNTS = pa.schema([("radix", pa.int64()), ("term", pa.string()), ("occurrences", pa.int64()), ("documents", pa.int64())])


def _tokenizer():
    """Counts of one task's records, handed on whenever many terms are held: partial counts that the reducers add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        often: Counter = Counter()
        inside: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            terms = list(often)
            radix = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array(radix, pa.int64()), pa.array(terms, pa.string()), pa.array(list(often.values()), pa.int64()), pa.array([inside[t] for t in terms], pa.int64())], schema=_COUNTS)
            often.clear()
            inside.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and (words := TERM.findall(text.lower())):
                    often.update(words)
                    inside.update(set(words))
                    often[RECORDS] += 1
                    inside[RECORDS] += 1
                    if len(often) >= HELD_TERMS:
                        yield from out()
        if often:
            yield from out()

    return run


def _reduce(part_bytes: int):
    """Adds up one partition's counts, by recursive splits on disk where it is large."""

    def split(batches: Iterator[pa.RecordBatch], folder: Path, level: int) -> list[Path]:
        writers: dict[int, pq.ParquetWriter] = {}
        for batch in batches:
            bits = pc.bit_wise_and(pc.shift_right(batch.column("radix"), 4 * level), FAN - 1)
            for k in pc.unique(bits).to_pylist():
                if k not in writers:
                    writers[k] = pq.ParquetWriter(folder / f"{level}-{k}.parquet", _COUNTS)
                writers[k].write_batch(batch.filter(pc.equal(bits, k)))
        for w in writers.values():
            w.close()
        return [folder / f"{level}-{k}.parquet" for k in sorted(writers)]

    def add(source: str, con) -> Iterator[pa.RecordBatch]:
        reader = con.sql(f"SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(documents)::BIGINT AS documents FROM {source} GROUP BY term").to_arrow_reader(50_000)
        yield from reader

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        held, size, spilled = [], 0, False
        batches = iter(batches)
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > part_bytes:
                spilled = True
                break
        if not held:
            return
        with scratch("radix-") as tmp:
            con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": f"{tmp}/duckdb"})
            if not spilled:
                counts = pa.Table.from_batches(held)
                con.register("counts", counts)
                yield from add("counts", con)
                return

            def chained() -> Iterator[pa.RecordBatch]:
                while held:
                    yield held.pop()
                yield from batches

            def down(paths: list[Path], level: int) -> Iterator[pa.RecordBatch]:
                for p in paths:
                    meta = pq.ParquetFile(p)
                    raw = sum(meta.metadata.row_group(i).total_byte_size for i in range(meta.num_row_groups))
                    if raw > part_bytes and level < DEPTH and meta.metadata.num_rows > 1:
                        below = p.with_suffix("")
                        below.mkdir()
                        yield from down(split(meta.iter_batches(50_000), below, level), level + 1)
                    else:
                        yield from add(f"'{p}'", con)
                    meta.close()
                    p.unlink()

            yield from down(split(chained(), Path(tmp), 0), 1)

    return run


def _counted(docs: DataFrame, key: str, text: str, latest: str | None, part_bytes: int) -> DataFrame:
    """term_counts with the row of RECORDS."""
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), *([F.col(latest).alias("_at")] if latest else []))
    texts = one_per(rows.filter(F.col("_t").isNotNull()), "_k", "_at" if latest else None).select("_t")
    partial = texts.mapInArrow(_tokenizer(), "radix long, term string, occurrences long, documents long")
    # Spark's partitioner hashes the radix again, so the bits below it stay free for the splits on disk.
    return partial.repartition("radix").mapInArrow(_reduce(part_bytes), "term string, occurrences long, documents long")


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "body", latest: str | None = "imported_at", part_bytes: int = PART_BYTES) -> DataFrame:
    """(term, occurrences, documents) for every term of the text of all distinct records.

    A term is a longest run of letters and numbers in the lower-cased text. Records of one key count once (of different texts the
    latest one that isn't null); a null key, a null text and one without a term count nothing. An empty table gives no row.

    No key is hot: a term that every record holds arrives once from each task.
    """
    return _counted(docs, key, text, latest, part_bytes).filter(F.col("term") != RECORDS)


def term_bands(docs: DataFrame, rare_below: int = 3, common_percent: int = 15, key: str = "doc_id", text: str = "body", latest: str | None = "imported_at", part_bytes: int = PART_BYTES) -> DataFrame:
    """term_counts with ``band``: ``rare`` for fewer than ``rare_below`` records, ``common`` for more than ``common_percent`` of
    every 100 records that hold any term, else ``useful``. Rare wins where a small table makes both true. The counts are stored, as
    their total is one of them: the texts are read once."""
    counts = cut(_counted(docs, key, text, latest, part_bytes))
    n = counts.filter(F.col("term") == RECORDS).agg(F.coalesce(F.max("documents"), F.lit(0)).alias("n")).scalar()
    band = F.when(F.col("documents") < rare_below, "rare").when(F.col("documents") * 100 > F.lit(common_percent) * n, "common").otherwise("useful")
    return counts.filter(F.col("term") != RECORDS).withColumn("band", band)


def refreshed_completions(completions: DataFrame, docs: DataFrame) -> DataFrame:
    """Every (term, shard) of the dictionary once, its latest build first, with the stored and the counted document frequency; a
    term that no document holds gets 0. The counts are those of all docs, as a shard's share of the docs is not recorded."""
    known = completions.filter(F.col("term").isNotNull()).groupBy("term", "shard").agg(F.max(F.struct("built_at", "document_frequency")).alias("_last"))
    counted = term_counts(docs).select("term", F.col("documents").alias("counted_frequency"))
    return known.select("term", "shard", F.col("_last.document_frequency").alias("stored_frequency")).join(counted, "term", "left").fillna(0, ["counted_frequency"])
