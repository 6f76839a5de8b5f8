"""Problem 2: the N best items within every group, however large a group is.

Method: hot-cold split. Exact row counts of the groups part them; heavy groups are salted and sorted by range, so that a group of any
size lies spread over many tasks of which each keeps its first N, and the light ones go through an ordinary window; the union is the
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group is heavy if it has a HEAVY-th of all counted rows: HEAVY groups at most can be, whatever the input, which bounds what is
#: broadcast. A heavy group is salted into parts of about half as many rows.
HEAVY = 100


def top_items(rows: DataFrame, group: str, item: str, score: str, n: int = 10, heavy: int = HEAVY) -> DataFrame:
    """The first ``n`` items of each group by score descending, then item ascending by bytes: (group, item, score, rank).

    Rows with a null group or item, or a score that is null, NaN or infinite, do not count. An item that comes several times
    counts once, with its highest score. A group with fewer items gives all of them; an empty table gives no row. -0.0 and 0.0
    are equal. Further columns are left out, whatever their names.

    A group is heavy from a ``heavy``-th of all counted rows on: a share, so the same groups are heavy at every size of one input. It
    decides how a group is computed, never what it gives.
    """
    # Null and the three special values fail this comparison (NaN is the greatest double in Spark).
    sane = F.col(score).cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308)
    own = rows.select(F.col(group).alias("_g"), F.col(item).alias("_i"), (F.col(score).cast("double") + 0.0).alias("_s"), sane.alias("_ok"))
    own = own.filter(F.col("_ok") & F.col("_g").isNotNull() & F.col("_i").isNotNull()).drop("_ok")
    order = [F.desc("_s"), F.asc("_i")]

    counts = own.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).scalar()
    salts = F.ceil(2 * heavy * F.col("_n") / total).cast("int")
    hot_groups = F.broadcast(counts.filter(F.col("_n") * heavy >= total).select("_g", salts.alias("_salts")))

    def first(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)

    def best(df: DataFrame, *more: str) -> DataFrame:
        return df.groupBy("_g", *more, "_i").agg(F.max("_s").alias("_s"))  # spread by group and item: no task holds a whole group

    # An item's copies share its salt. The range partitions, sorted by score inside each salted part, each give their first n; the last
    # window sees n rows of each part, and the parts of a group are 2 * heavy at most.
    salted = own.join(hot_groups, "_g").withColumn("_salt", F.pmod(F.xxhash64("_i"), F.col("_salts")).cast("int"))
    parts = best(salted, "_salt").repartitionByRange("_g", "_salt").sortWithinPartitions("_g", "_salt", *order)
    hot = first(first(parts, "_g", "_salt").drop("rank"), "_g").drop("_salt")
    cold = first(best(own.join(hot_groups, "_g", "left_anti")), "_g")
    top = hot.unionByName(cold)
    return top.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), "rank")


def judged_top(results: DataFrame, judged: DataFrame, n: int = 10, heavy: int = HEAVY) -> DataFrame:
    """top_items of the query results whose query is judged. The join follows the selection: then no query has over n rows."""
    top = top_items(results, "query_id", "document_id", "score", n, heavy)
    return top.join(judged.select("query_id").filter(F.col("query_id").isNotNull()), "query_id", "left_semi")
