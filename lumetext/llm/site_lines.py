"""Problem 7: lines that come back on many pages of one site.

Method: hash normalized lines, count the distinct documents of each source and hash, keep those above a threshold, join them back
to the lines and rebuild each document without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, host_of, one_per, skew_safe_join


def line_hashes(text: Column) -> Column:
    """For each line its hash by letters alone, ignoring case; null for a line without a letter."""

    def one(line: Column) -> Column:
        letters = F.regexp_replace(F.lower(line), r"\P{L}+", "")
        return F.when(letters != "", F.xxhash64(letters))

    return F.transform(F.split(text, "\n"), one)


def repeated_lines(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "text", least: int = 8) -> DataFrame:
    """Lines that occur on at least ``least`` distinct pages of one host: (key, line_no from 1, host, pages of the host with it).

    Lines are the same if they have the same letters in the same order, ignoring case; one without a letter never counts, nor
    does a page whose key, url or text is null or whose address has no host. Rows of one key count once.

    Texts do not move, but for those of repeated pages: a page is stored and shuffled as one 64-bit hash for each line. A line that a third of all pages hold is a hot
    key of the last join, see skew_safe_join.
    """
    held = pages.select(F.col(key).alias("_k"), F.col(url).alias("_url"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull() & F.col("_url").isNotNull())
    shaped = one_per(held, "_k").select("_k", host_of(F.col("_url")).alias("_host"), line_hashes(F.col("_text")).alias("_h"))
    shaped = cut(shaped.filter(F.trim("_host") != ""))
    once = shaped.select("_host", F.explode(F.array_compact(F.array_distinct("_h"))).alias("_line"))
    counts = once.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("n_pages"))
    often = cut(counts.filter(F.col("n_pages") >= least))
    lines = shaped.select("_k", "_host", F.posexplode("_h").alias("_no", "_line")).filter(F.col("_line").isNotNull())
    total = often.agg(F.coalesce(F.sum("n_pages"), F.lit(0)).alias("t")).scalar()
    found = skew_safe_join(lines, often, ["_host", "_line"], "n_pages", total)
    return found.select(F.col("_k").alias(key), (F.col("_no") + 1).cast("int").alias("line_no"), F.col("_host").alias("host"), "n_pages")


def without_repeated_lines(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "text", least: int = 8) -> DataFrame:
    """Each page once with its text rebuilt without the repeated lines: (key, text, dropped lines). A null text stays null, and a
    page without a url keeps its text as it is."""
    marks = repeated_lines(pages, key, url, text, least).groupBy(F.col(key).alias("_k")).agg(F.collect_set(F.col("line_no") - 1).alias("_drop"))
    whole = one_per(pages.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k").join(marks, "_k", "left")
    kept = F.filter(F.split("_t", "\n"), lambda line, i: ~F.array_contains("_drop", i))
    rebuilt = F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(F.array_join(kept, "\n"))
    return whole.select(F.col("_k").alias(key), rebuilt.alias(text), F.coalesce(F.size("_drop"), F.lit(0)).alias("dropped"))
