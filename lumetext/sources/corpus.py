"""Readers and writers of document collections and their side files. All readers give (doc_id, title, body)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.web import collapse_column
from ..storage import exists, is_folder, names_in

BLANKS = " \t\r\n\x0b\f"


def parsed_documents(raw: DataFrame, key: str = "doc_id", text: str = "raw") -> DataFrame:
    """Documents of raw texts whose first line is ``title: X``; others are left out. The body loses its blank lines at both ends, not
    those inside, and returns before line feeds."""
    body = F.regexp_replace(F.regexp_replace(F.col("_rest"), rf"^(?:[{BLANKS}]*\n)+", ""), rf"(?:\n[{BLANKS}]*)+$", "")
    whole = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n", "\n"), r"[\r\n]$", "")
    first = F.substring_index(F.col("_all"), "\n", 1)
    rows = raw.filter(~F.col(text).rlike(rf"^[{BLANKS}]*$")).withColumn("_all", whole)
    rows = rows.withColumn("_head", first).withColumn("_rest", F.expr("substring(_all, length(_head) + 2)"))
    named = rows.filter(F.col("_head").contains(":") & (F.trim(F.substring_index("_head", ":", 1), F.lit(BLANKS)) == "title"))
    title = F.trim(F.expr("substring(_head, instr(_head, ':') + 1)"), F.lit(BLANKS))
    only_blank = F.col("_rest").rlike(rf"^[{BLANKS}]*$")
    return named.select(F.col(key).alias("doc_id"), title.alias("title"), F.when(only_blank, "").otherwise(body).alias("body"))


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """The ``*.txt`` files right inside a folder; ids are their names without the extension."""
    files = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").text(folder, wholetext=True)
    return parsed_documents(files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("doc_id"), F.col("value").alias("raw")))


# The packed form: magic, version, number of documents and place of the table, then the texts and (id, offset, length) of each, all
# little-endian (fixed values of the format).
MAGIC, VERSION = b"SCPS", 1
_HEADER = struct.Struct("<4sIQQ")


class CorpusError(ValueError):
    pass


def packed_table(path: str) -> list[tuple[str, int, int]]:
    """(id, offset, length) of each document of a packed file, with all bounds checked."""
    size = Path(path).stat().st_size
    with open(path, "rb") as f:
        head = f.read(_HEADER.size)
        if len(head) < _HEADER.size or head[:4] != MAGIC:
            raise CorpusError(f"{path} is no packed corpus")
        _, version, count, at = _HEADER.unpack(head)
        if version != VERSION:
            raise CorpusError(f"{path} has version {version}")
        if not _HEADER.size <= at <= size:
            raise CorpusError(f"{path} is cut off")
        f.seek(at)
        table = f.read()
    out, p = [], 0
    for _ in range(count):
        if p + 4 > len(table):
            raise CorpusError(f"{path} is cut off")
        (n,) = struct.unpack_from("<I", table, p)
        if p + 4 + n + 16 > len(table):
            raise CorpusError(f"{path} is cut off")
        name = table[p + 4 : p + 4 + n].decode("utf-8", "replace")
        offset, length = struct.unpack_from("<QQ", table, p + 4 + n)
        if offset < _HEADER.size or offset + length > at:
            raise CorpusError(f"{path} has a document outside its texts")
        out.append((name, offset, length))
        p += 4 + n + 16
    if p != len(table):
        raise CorpusError(f"{path} has bytes after its table")
    return out


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a packed file that the executors can open under the same path: the table of places is spread, the texts are read
    where they are needed."""
    places = spark.createDataFrame(packed_table(path), "doc_id string, offset long, length long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                texts = []
                for offset, length in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    f.seek(offset)
                    texts.append(f.read(length).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "raw"])

    return parsed_documents(places.mapInArrow(run, "doc_id string, raw string"))


def write_packed(docs: DataFrame, path: str) -> int:
    """One packed file, for exchange; the documents stream through the driver one partition at a time. At scale write Parquet."""
    places, at = [], _HEADER.size
    with open(path, "wb") as f:
        f.write(bytes(_HEADER.size))
        for r in docs.select("doc_id", "title", "body").orderBy("doc_id").toLocalIterator():
            raw = f"title: {r.title or ''}\n\n{r.body or ''}\n".encode("utf-8", "surrogatepass")
            f.write(raw)
            places.append((str(r.doc_id).encode(), at, len(raw)))
            at += len(raw)
        for name, offset, length in places:
            f.write(struct.pack("<I", len(name)) + name + struct.pack("<QQ", offset, length))
        f.seek(0)
        f.write(_HEADER.pack(MAGIC, VERSION, len(places), at))
    return len(places)


def read_parquet(spark: SparkSession, path: str, key: str = "doc_id", title: str | None = "title", body: str = "body") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(F.col(key).alias("doc_id"), (F.col(title) if title else F.lit("")).alias("title"), F.col(body).alias("body"))


def open_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of any kind: a stored index, a Parquet table, a folder of texts, a packed file."""
    if not exists(spark, path):
        raise CorpusError(f"no corpus at {path}")
    if is_folder(spark, path):
        inside = names_in(spark, path)
        if "corpus" in inside and is_folder(spark, f"{path}/corpus"):
            return spark.read.parquet(f"{path}/corpus")
        table = path.endswith(".parquet") or any(n.endswith(".parquet") for n in inside)
        return read_parquet(spark, path) if table else read_directory(spark, path)
    return read_parquet(spark, path) if path.endswith(".parquet") else read_packed(spark, path)


def json_field(line: Column, key: str) -> Column:
    """A string field of a JSON object's top level; null where it is missing or no string."""
    raw = F.get_json_object(line, f"$.{key}")
    typed = F.try_parse_json(line)
    return F.when(F.schema_of_variant(F.try_variant_get(typed, f"$.{key}", "variant")) == "STRING", raw)


def ordered_ids(rows: DataFrame, order: list[str], name: str, width: int) -> DataFrame:
    """Ids ``doc_%0nd`` from 1 in the order of the given unique columns."""
    from ..operators.index import dense_ranks

    ranked = dense_ranks(rows.withColumn("_key", F.struct(*order)), "_key", "_nth")
    return ranked.drop("_key").withColumn(name, F.concat(F.lit("doc_"), F.lpad((F.col("_nth") + 1).cast("string"), width, "0"))).drop("_nth")


def read_wikipedia(spark: SparkSession, path: str, abstracts: bool = False, limit: int = 0) -> DataFrame:
    """Articles of a JSON-lines dump of alternating action and document lines. A line counts if it has a string title; one whose text is
    empty is left out; ids number the kept ones in the order of the file. ``limit`` keeps the first so many."""
    field = "opening_text" if abstracts else "text"
    # A line's place: its file, the block of it that a task reads, and its number in there. Tasks come in no order of the file.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("_line"))
    parsed = lines.select("_line", F.from_json("value", f"title string, `{field}` string").alias("j"))
    kept = parsed.filter(F.col("j.title").isNotNull()).select("_line", collapse_column(F.col("j.title")).alias("title"), collapse_column(F.coalesce(F.col(f"j.{field}"), F.lit(""))).alias("body")).filter(F.col("body") != "")
    if limit:
        kept = kept.orderBy("_line").limit(limit)
    return ordered_ids(kept, ["_line"], "doc_id", 8).select("doc_id", "title", "body")


def read_beir(spark: SparkSession, path: str) -> DataFrame:
    """Documents of ``_id, title, text`` JSON lines; those without an id, or without title and text, are left out."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    kept = rows.filter(F.coalesce("_id", F.lit("")) != "").select(F.col("_id").alias("doc_id"), collapse_column(F.coalesce("title", F.lit(""))).alias("title"), collapse_column(F.coalesce("text", F.lit(""))).alias("body"))
    return kept.filter((F.col("title") != "") | (F.col("body") != ""))


def read_beir_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("_id string, text string").json(path)
    return rows.filter(F.col("_id").isNotNull()).select(F.col("_id").alias("query_id"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of a tab-separated file: its header and bad or non-positive grades are left out, and of repeated pairs
    the last stays."""
    lines = spark.read.text(path).select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f"), F.monotonically_increasing_id().alias("_line"), "value")
    rows = lines.filter((F.size("f") >= 3) & ~F.col("value").startswith("query-id")).select(F.col("f")[0].alias("query_id"), F.col("f")[1].alias("doc_id"), F.expr("try_cast(f[2] AS INT)").alias("grade"), "_line")
    good = rows.filter(F.col("grade") > 0)
    return good.groupBy("query_id", "doc_id").agg(F.max_by("grade", "_line").alias("grade"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_ord, query) of a file of one query a line, trimmed, without blank lines."""
    lines = spark.read.text(path).select(F.trim("value", F.lit(BLANKS)).alias("query"), F.monotonically_increasing_id().alias("query_ord"))
    return lines.filter(F.col("query") != "").select("query_ord", "query")


def read_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """Two columns parted at the first tab; lines without one are left out."""
    line = F.regexp_replace("value", r"\r$", "")
    rows = spark.read.text(path).select(line.alias("v")).filter(F.col("v").contains("\t"))
    return rows.select(F.substring_index("v", "\t", 1).alias(names[0]), F.expr("substring(v, instr(v, '\t') + 1)").alias(names[1]))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url, ord); ord is the order of the file."""
    line = F.regexp_replace("value", r"\r$", "")
    rows = spark.read.text(path).select(line.alias("v"), F.monotonically_increasing_id().alias("ord")).filter(F.col("v").contains("\t"))
    return rows.select(F.substring_index("v", "\t", 1).alias("doc_id"), F.expr("substring(v, instr(v, '\t') + 1)").alias("url"), "ord")


def write_ranks(ranks: DataFrame, path: str) -> None:
    """``page<TAB>score`` lines, scores with all their digits, in order of score and page."""
    ranks.orderBy(F.desc("score"), F.asc("page")).select(F.concat_ws("\t", "page", F.col("score").cast("string"))).write.mode("overwrite").text(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(page, score), parted at the last tab; a score that is none, negative or not finite is an error."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("v")).filter(F.col("v") != "")
    score = F.expr("try_cast(substring_index(v, '\t', -1) AS DOUBLE)")
    good = F.col("v").contains("\t") & score.isNotNull() & (score >= 0) & (score < float("inf"))
    checked = rows.select(F.when(good, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("bad rank line: "), F.col("v")))).alias("v"))
    return checked.select(F.regexp_replace("v", r"\t[^\t]*$", "").alias("page"), score.alias("score"))


def merge_crawls(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Collections under one roof: each part's ids get its name before them."""
    out = None
    for name, df in parts.items():
        named = df.select(*(F.concat(F.lit(f"{name}_"), F.col(c)).alias(c) if c in keys else F.col(c) for c in df.columns))
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise CorpusError("no crawl to merge")
    return out


def result_lines(results: DataFrame, tsv: bool = False) -> DataFrame:
    """(line): results as text, scores with four decimals, excerpts on one line."""
    score = F.format_string("%.4f", F.col("score"))
    cells = [F.col("doc_id").cast("string"), score]
    if "snippet" in results.columns:
        cells.append(F.coalesce(F.regexp_replace("snippet", r"\s+", " "), F.lit("")))
    return results.select(F.concat_ws("\t" if tsv else "  ", *cells).alias("line"))


def json_response(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))


DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])
