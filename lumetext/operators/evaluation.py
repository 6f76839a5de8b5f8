"""Relevance against judged queries, and measurements."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.language import bag_of_words, scoring_terms
from .index import Index
from .ranking import batch_top_k


def metrics(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, ndcg_10, precision_10, recall_100) of each judged query; ``ranked`` is (query_id, doc_id, rank from 1), ``qrels``
    (query_id, doc_id, grade). Gains are the grades, discounts 1 / log2(rank + 1). Grades of 0 or less are no judgement."""
    judged = qrels.filter(F.col("grade") > 0)
    ranked = ranked.filter(F.col("rank") <= 100)
    gain = lambda nth: F.col("grade") / F.log2(nth + 1.0)
    hits = ranked.join(judged, ["query_id", "doc_id"])
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, gain(F.col("rank")))).alias("dcg"), F.count_if(F.col("rank") <= 10).alias("top"), F.count_if(F.col("rank") <= 100).alias("found")
    )
    # The ideal gain needs a query's ten best grades, which each task keeps before they meet; the number of judgements is only counted.
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    first = judged.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 10).groupBy("query_id").agg(F.sum(gain(F.col("n"))).alias("best"))
    ideal = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")).join(first, "query_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "query_id", "left").select(
        "query_id", zero(F.col("dcg") / F.col("best")).alias("ndcg_10"), zero(F.col("top") / 10.0).alias("precision_10"), zero(F.col("found") / F.col("relevant")).alias("recall_100")
    )


def bags(queries: DataFrame) -> DataFrame:
    """(query_id, terms) of (query_id, text): each query as the terms of its words joined by OR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [scoring_terms(b) if (b := bag_of_words(t or "")) else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["query_id", "terms"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "text").mapInArrow(run, f"query_id {kind}, terms array<string>")


def evaluate(index: Index, queries: DataFrame, qrels: DataFrame, scorer: str = "bm25") -> DataFrame:
    """(ndcg_10, precision_10, recall_100, judged, unjudged): means over the queries that have a judgement. These run in one job; the
    others count without being ranked."""
    judged = queries.join(qrels.filter(F.col("grade") > 0).select("query_id").distinct(), "query_id", "left_semi")
    own = metrics(batch_top_k(index, bags(judged), 100, scorer), qrels)
    known = queries.select("query_id").distinct()
    means = own.join(known, "query_id", "left_semi").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("ndcg_10", "precision_10", "recall_100")), F.count(F.lit(1)).alias("judged"))
    rest = known.join(qrels.filter(F.col("grade") > 0), "query_id", "left_anti").agg(F.count(F.lit(1)).alias("unjudged"))
    return means.join(F.broadcast(rest), how="left")


def latencies(times: DataFrame, column: str = "ms") -> DataFrame:
    """p50, p95, p99 by linear interpolation, the mean and the number of measurements."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return times.agg(p.alias("p"), F.avg(column).alias("mean"), F.count(column).alias("n")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "mean", "n")


def timed(make) -> tuple[object, float]:
    """A result and the milliseconds it took."""
    began = time.perf_counter()
    return make(), (time.perf_counter() - began) * 1000


def query_set_report(results: DataFrame, bounds: tuple[float, ...] = (0, 1, 2, 5, 10, 20)) -> DataFrame:
    """(bucket, queries) of (query_id, score): a histogram of each query's best score; queries without a result have bucket 'none'."""
    best = results.groupBy("query_id").agg(F.max("score").alias("best"))
    bucket = F.lit(f">={bounds[-1]:g}")
    for lo, hi in reversed(list(zip(bounds, bounds[1:]))):
        bucket = F.when(F.col("best") < hi, f"{lo:g}-{hi:g}").otherwise(bucket)
    return best.select(F.when(F.col("best").isNull(), "none").otherwise(bucket).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("queries"))


def without_results(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id) of the queries that no result names."""
    return queries.select("query_id").filter(F.col("query_id").isNotNull()).distinct().join(results.select("query_id"), "query_id", "left_anti")


def result_percentiles(queries: DataFrame, results: DataFrame, percents: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """(percent, results): nearest-rank percentiles of the number of results of each query, those without one too. The numbers are
    counted first, so the ranks are taken over one row for each distinct number of results."""
    counts = results.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    known = queries.select("query_id").filter(F.col("query_id").isNotNull()).distinct().join(counts, "query_id", "left")
    sizes = known.groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("of"))
    upto = sizes.select("n", F.sum("of").over(Window.orderBy("n")).alias("upto"), F.sum("of").over(Window.partitionBy(F.lit(0))).alias("total"))
    asked = upto.select("n", "upto", "total", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    return asked.filter(F.col("upto") >= F.ceil(F.col("percent") * F.col("total") / 100)).groupBy("percent").agg(F.min("n").alias("results"))


def pool_sum(spark, n: int, parts: int = 8) -> DataFrame:
    """The sum of the squares below n, by as many tasks as asked for."""
    return spark.range(0, n, 1, parts).agg(F.coalesce(F.sum(F.col("id") * F.col("id")), F.lit(0)).alias("total"))
