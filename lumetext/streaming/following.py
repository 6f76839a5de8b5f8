"""An index that follows a stream of documents: each micro-batch is one incremental update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import Index, build_index, load_index, update_index
from ..storage import read_text, write_text


def apply_changes(index: Index, changes: DataFrame) -> tuple[Index, DataFrame]:
    """The index after changes (doc_id, title, body[, removed][, seq]): the last of a document's changes counts, a removed one goes,
    documents without a change stay as they are."""
    if "removed" not in changes.columns:
        changes = changes.withColumn("removed", F.lit(False))
    if "seq" in changes.columns:
        last = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
        changes = changes.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") == 1)
    touched = changes.select("doc_id").distinct()
    corpus = index.corpus.join(touched, "doc_id", "left_anti").unionByName(changes.filter(~F.coalesce("removed", F.lit(False))).select("doc_id", "title", "body"))
    return update_index(index, corpus)


def current(root: str) -> str | None:
    """The newest complete version under a root."""
    found = read_text(SparkSession.active(), f"{root}/CURRENT")
    return found.strip() if found else None


def follow(changes: DataFrame, root: str, checkpoint: str):
    """Starts a query that writes version after version of an index under ``root``; CURRENT names the last whole one, so readers never
    see a half-written index, and a batch that is run again after a failure writes the same version again. Returns the query."""
    spark = changes.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        before = current(root)
        target = f"{root}/v{number:08d}"
        if before and before.endswith(f"v{number:08d}"):
            return
        if before:
            index, _ = apply_changes(load_index(spark, before), batch)
        else:
            if "removed" in batch.columns:
                batch = batch.filter(~F.coalesce("removed", F.lit(False)))
            index = build_index(batch.select("doc_id", "title", "body").dropDuplicates(["doc_id"]))
        index.save(target)
        write_text(spark, f"{root}/CURRENT", target)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, folder: str, schema: str = "doc_id string, title string, body string, removed boolean, seq long") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def term_trends(events: DataFrame, text: str, at: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, term, n) of a stream of texts: how often each term comes in each window, rows later than ``late`` left out. Splitting is
    native, so the whole stream stays in the JVM."""
    from ..functions.text import normalize_column, pieces_column

    words = events.withWatermark(at, late).select(F.window(at, every).alias("window"), F.explode(pieces_column(F.col(text))).alias("piece"))
    return words.select("window", normalize_column(F.col("piece")).alias("term")).filter(F.col("term") != "").groupBy("window", "term").agg(F.count(F.lit(1)).alias("n"))
