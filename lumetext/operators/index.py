"""The positional inverted index as tables.

``postings`` (term, doc_id, tf, title_tf, length, title_terms, positions), ``terms`` (term, df), ``docs`` (doc_id, length, title_span,
title_terms, fingerprint) and the texts they were made of. A posting carries all that a score needs of its document, and the stored
dictionary its term's number of documents, so ranking joins neither. Documents are ordered by their id, bytewise for strings, so a dense
ordinal is never needed: where a ranking breaks ties by document order it orders by id, and no global numbering has to pass through one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import analyzed, terms_of
from ..storage import exists, remove, spread, stored


@dataclass
class Stats:
    """Totals of a collection, one row."""

    n_docs: int
    total_length: int
    total_title_terms: int

    @property
    def average(self) -> float:
        return self.total_length / self.n_docs if self.n_docs else 0.0

    @property
    def average_title(self) -> float:
        return self.total_title_terms / self.n_docs if self.n_docs else 0.0


@dataclass
class Index:
    """Tables of one index, lazily read or computed."""

    docs: DataFrame
    postings: DataFrame
    corpus: DataFrame | None = None
    dictionary_table: DataFrame | None = None

    @cached_property
    def stats(self) -> Stats:
        """The collection's totals; scoring needs them as numbers, so they are read once."""
        row = self.docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l"), F.coalesce(F.sum("title_terms"), F.lit(0)).alias("t")).first()
        return Stats(row.n, row.l, row.t)

    @property
    def terms(self) -> DataFrame:
        """(term, df): the dictionary, stored where the index is."""
        if self.dictionary_table is not None:
            return self.dictionary_table
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def counts(self) -> DataFrame:
        """Documents, distinct terms and postings, one row."""
        words = self.terms.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        return self.docs.agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(words), how="left")

    def dictionary(self) -> DataFrame:
        return self.terms.orderBy("term")

    def postings_of(self, word: str) -> DataFrame:
        """(doc_id, tf, positions) of a word's term; none for a stopword, an error for more than one term."""
        found = terms_of(word)
        if len(found) > 1:
            raise ValueError(f"'{word}' is more than one term")
        wanted = self.postings.filter(F.col("term") == found[0][1]) if found else self.postings.limit(0)
        return wanted.select("doc_id", "tf", "positions").orderBy("doc_id")

    def document_terms(self, doc_id) -> DataFrame:
        """(position, term): a document's term stream, rebuilt from the postings."""
        return self.postings.filter(F.col("doc_id") == doc_id).select(F.explode("positions").alias("position"), "term").orderBy("position")

    def lengths(self) -> DataFrame:
        return self.docs.select("doc_id", "length").orderBy("doc_id")

    def averages(self) -> DataFrame:
        return self.docs.agg(F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_length"), F.coalesce(F.avg("title_terms"), F.lit(0.0)).alias("average_title"))

    def save(self, path: str) -> Index:
        """Writes the tables and reads them back."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        _place(self.postings, path)
        if self.corpus is not None:
            self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        return load_index(self.docs.sparkSession, path)


def _place(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Postings as ranges of terms, sorted inside each file: a term's rows lie in few row groups, which the footer statistics find, and
    their column encodings are what delta and varbyte coding would be. A hot term's range goes on over its documents. The dictionary is
    counted over the stored terms, a column of short runs, and sorted too."""
    placed = postings.repartitionByRange(*([partitions] if partitions else []), "term", "doc_id").sortWithinPartitions("term", "doc_id")
    placed.write.mode("overwrite").parquet(f"{path}/postings")
    terms = postings.sparkSession.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms.orderBy("term").write.mode("overwrite").parquet(f"{path}/terms")


def load_index(spark: SparkSession, path: str, corpus: DataFrame | None = None) -> Index:
    """A stored index; its texts are the stored ones if not given."""
    own = lambda name: spark.read.parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else None
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), own("corpus") if corpus is None else corpus, own("terms"))


def fingerprint(title: Column, body: Column) -> Column:
    """A hash of a document's text, never 0, as 0 means unknown. Only equality is ever used."""
    h = F.xxhash64(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    return F.when(h == 0, F.lit(1)).otherwise(h)


def build_index(corpus: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body") -> Index:
    """The index of a corpus with one row for each document. Nothing is shuffled: a document's postings are made in its row."""
    own = corpus.select(F.col(key).alias("doc_id"), F.col(title).alias("title"), F.col(body).alias("body"))
    rows = analyzed(spread(own).withColumn("fingerprint", fingerprint(F.col("title"), F.col("body"))), keep=("fingerprint",))
    return Index(rows.drop("terms"), postings_in(rows), own)


def postings_in(rows: DataFrame) -> DataFrame:
    """Postings of analyzed rows."""
    flat = rows.select("doc_id", "length", "title_terms", "title_span", F.explode("terms").alias("t"))
    in_title = F.size(F.filter("t.positions", lambda p: p < F.col("title_span")))
    return flat.select("t.term", "doc_id", F.size("t.positions").alias("tf"), in_title.alias("title_tf"), "length", "title_terms", "t.positions")


def store_index(corpus: DataFrame, path: str, key: str = "doc_id", title: str = "title", body: str = "body", partitions: int | None = None, texts: bool = True) -> Index:
    """build_index written to ``path`` with one analysis of the texts: the analyzed rows are stored, docs and postings are made of them,
    and they are removed. ``texts`` off leaves the texts where they are, which spares a copy of a corpus that stays readable."""
    own = corpus.select(F.col(key).alias("doc_id"), F.col(title).alias("title"), F.col(body).alias("body"))
    spark = corpus.sparkSession
    if texts:
        own.write.mode("overwrite").parquet(f"{path}/corpus")
        own = spark.read.parquet(f"{path}/corpus")
    marked = spread(own).withColumn("fingerprint", fingerprint(F.col("title"), F.col("body")))
    analyzed(marked, keep=("fingerprint",)).write.mode("overwrite").parquet(f"{path}/analyzed")
    rows = spark.read.parquet(f"{path}/analyzed")
    rows.drop("terms").write.mode("overwrite").parquet(f"{path}/docs")
    _place(postings_in(rows), path, partitions)
    remove(spark, f"{path}/analyzed")
    return load_index(spark, path, own)


def update_index(old: Index, corpus: DataFrame) -> tuple[Index, DataFrame]:
    """The index of ``corpus``, with the postings of unchanged documents taken from ``old``, and a row (added, updated, removed,
    unchanged). A document is unchanged if its id and fingerprint are; one whose old fingerprint is 0 is always analyzed again.
    Ids join ids, so nothing is skewed, and only changed texts are analyzed."""
    new = corpus.select("doc_id", "title", "body", fingerprint(F.col("title"), F.col("body")).alias("fingerprint"))
    before = old.docs.select("doc_id", F.col("fingerprint").alias("_before"))
    both = new.select("doc_id", "fingerprint").join(before, "doc_id", "full")
    kind = (
        F.when(F.col("fingerprint").isNull(), "removed").when(F.col("_before").isNull(), "added").when((F.col("_before") == F.col("fingerprint")) & (F.col("_before") != 0), "unchanged").otherwise("updated")
    )
    change = both.select("doc_id", kind.alias("change"))
    tally = change.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "removed", "unchanged")))
    same = change.filter(F.col("change") == "unchanged").select("doc_id")
    fresh = build_index(new.join(same, "doc_id", "left_anti"))
    docs = old.docs.join(same, "doc_id", "left_semi").unionByName(fresh.docs)
    postings = old.postings.join(same, "doc_id", "left_semi").unionByName(fresh.postings)
    return Index(docs, postings, new.drop("fingerprint")), tally


def merge_indexes(a: Index, b: Index) -> Index:
    """One index of two with different documents: rows side by side, nothing is analyzed or shuffled. An id in both is an error."""
    both = a.docs.select("doc_id").join(b.docs.select("doc_id"), "doc_id", "left_semi")
    if not both.isEmpty():
        raise ValueError("a document is in both indexes")
    corpus = None if a.corpus is None or b.corpus is None else a.corpus.unionByName(b.corpus)
    terms = None
    if a.dictionary_table is not None and b.dictionary_table is not None:
        terms = a.terms.unionByName(b.terms).groupBy("term").agg(F.sum("df").alias("df"))
    return Index(a.docs.unionByName(b.docs), a.postings.unionByName(b.postings), corpus, terms)


def violations(index: Index) -> DataFrame:
    """(rule, rows) of what no index may have: postings that don't agree with their positions, positions that don't ascend, repeated
    postings, postings of unknown documents, lengths that aren't those of the postings, postings with another document's numbers, a
    dictionary that counts otherwise. A sound index gives no row."""
    p = index.postings
    falling = F.exists(F.sequence(F.lit(1), F.greatest(F.size("positions") - 1, F.lit(1))), lambda i: F.coalesce(F.get("positions", i) <= F.get("positions", i - 1), F.lit(False)))
    lengths = p.groupBy("doc_id").agg(F.sum("tf").alias("_sum"), F.sum("title_tf").alias("_title"), F.min(F.struct("length", "title_terms")).alias("_lo"), F.max(F.struct("length", "title_terms")).alias("_hi"))
    held = index.docs.join(lengths, "doc_id", "left")
    counted = p.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).join(index.terms, "term", "full")
    rules = {
        "frequency": p.filter((F.size("positions") != F.col("tf")) | (F.col("tf") < 1)),
        "ascent": p.filter(falling | (F.get("positions", F.lit(0)) < 0)),
        "repeated": p.groupBy("term", "doc_id").count().filter("count > 1"),
        "unknown": p.join(index.docs, "doc_id", "left_anti"),
        "length": held.filter(F.coalesce("_sum", F.lit(0)) != F.col("length")),
        "numbers": held.filter((F.col("_lo") != F.struct("length", "title_terms")) | (F.col("_hi") != F.struct("length", "title_terms")) | (F.col("_title") != F.col("title_terms"))),
        "dictionary": counted.filter(~F.col("_df").eqNullSafe(F.col("df"))),
    }
    out = None
    for rule, rows in rules.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "rows").filter("rows > 0")
        out = one if out is None else out.unionByName(one)
    return out


def varbyte(n: Column) -> Column:
    """Bytes of a number at seven bits each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("long")


#: Bytes of a stored index beside its rows: the header, and each document's four numbers (fixed values of the format).
HEADER_BYTES, DOCUMENT_BYTES = 73, 32

#: Documents of a range in which the gaps of a term are taken.
GAP_RANGE = 1 << 20


def index_sizes(index: Index) -> DataFrame:
    """(encoding, section, bytes): what a stored index takes with plain 8-byte numbers, with deltas of the same width, and with
    variable-byte deltas. A posting is a document gap, a frequency and a number of positions; document numbers are ranks of the ids.

    A term's gaps are taken inside ranges of the document numbers, each a window of GAP_RANGE postings at most; the first of a range
    follows the last of the term's range before it, which an aggregation of one row for each range hands on."""
    ranked = dense_ranks(index.docs.select("doc_id"), "doc_id", "ord")
    rows = index.postings.select("term", "doc_id", "tf", "positions").join(ranked, "doc_id").withColumn("_range", F.floor(F.col("ord") / GAP_RANGE))
    inside = Window.partitionBy("term", "_range").orderBy("ord")
    step = F.col("ord") - F.lag("ord").over(inside)  # null for the first of a range
    gaps = F.transform(F.sequence(F.lit(1), F.size("positions")), lambda i: F.col("positions")[i - 1] - F.when(i > 1, F.col("positions")[F.greatest(i - 2, F.lit(0))]).otherwise(0))
    sized = rows.select("tf", step.alias("d"), F.aggregate(F.transform(gaps, lambda g: varbyte(g.cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x).alias("p"))
    lists = sized.agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"), F.sum(F.when(F.col("d").isNull(), 0).otherwise(varbyte(F.col("d"))) + 2 * varbyte(F.col("tf").cast("long"))).alias("coded"), F.sum("p").alias("coded_positions"))
    ends = rows.groupBy("term", "_range").agg(F.min("ord").alias("_lo"), F.max("ord").alias("_hi"))
    first = ends.select((F.col("_lo") - F.coalesce(F.lag("_hi").over(Window.partitionBy("term").orderBy("_range")), F.lit(0))).alias("d"))
    heads = first.agg(F.sum(varbyte(F.col("d"))).alias("heads"))
    length = F.octet_length("term").cast("long")
    words = index.terms.agg(F.sum(length + 16).alias("words"), F.sum(length + varbyte(length) + varbyte(F.col("df"))).alias("coded_words"))
    docs = index.docs.agg(F.sum(F.octet_length(F.col("doc_id").cast("string")) + DOCUMENT_BYTES).alias("docs"))
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    plain = {"header": F.lit(HEADER_BYTES), "documents": zero(F.col("docs")) + 8, "dictionary": F.col("words"), "postings": F.col("n") * 24, "positions": F.col("tf") * 8}
    coded = plain | {"dictionary": F.col("coded_words"), "postings": zero(F.col("coded")) + zero(F.col("heads")), "positions": F.col("coded_positions")}
    cells = [F.struct(F.lit(e).alias("encoding"), F.lit(name).alias("section"), zero(c).alias("bytes")) for e, parts in (("plain", plain), ("delta", plain), ("varbyte", coded)) for name, c in parts.items()]
    one = lists.join(F.broadcast(words), how="left").join(F.broadcast(docs), how="left").join(F.broadcast(heads), how="left")  # one row each
    return one.select(F.inline(F.array(*cells)))


def dense_ranks(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the rank from 0 of its unique key, by ranges. The ranged rows are stored once, each with its partition and its place
    in it; sizes and offsets of the partitions are taken from that one table, so they belong to its rows whatever adaptive execution
    made of the partitions. The driver sees no row, and the only window runs over one row for each partition."""
    placed = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    rows, _ = stored(placed)
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + nth).alias(name))
