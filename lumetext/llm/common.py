"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut  # noqa: F401  (its modules take it from here)

#: A term is a longest run of letters and numbers. The class equals the categories L and N of Python's Unicode tables.
TERM = re.compile(r"[^\W_]+")

#: Share of the total weight from which a key counts as hot: at most HOT keys can reach it, whatever the input.
HOT = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without scheme, user and port; null for a null address, '' where there is none."""
    rest = F.regexp_replace(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    return F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#\\]*)", 1), r"^.*@|:\d*\s*$", ""))


def host_text(url: str | None) -> str | None:
    """host_of for Python workers."""
    if url is None:
        return None
    rest = re.sub(r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "", url)
    return re.sub(r"^.*@|:\d*\s*$", "", re.match(r"[^/?#\\]*", rest)[0]).lower()


#: Repeated keys up to which one_per broadcasts them.
REPEATED_KEYS = 200_000


def one_per(df: DataFrame, key: str, latest: str | None = None, broadcast_keys: int = REPEATED_KEYS) -> DataFrame:
    """One row for each non-null key; of rows that differ, the one that sorts last by ``latest`` and then by all columns.

    Keys that come once, which is nearly all, stay where they are: only the keys are shuffled to find the repeated ones, and only the
    rows of those meet. Where more than ``broadcast_keys`` keys are repeated, all rows meet by their key. A key is that of one record,
    so none is hot.
    """
    rest = [c for c in df.columns if c != key]
    order = [*([latest] if latest else []), *(c for c in rest if c != latest)]
    rows = df.filter(F.col(key).isNotNull())

    def last(some: DataFrame) -> DataFrame:
        best = some.groupBy(key).agg(F.max(F.struct(*order)).alias("_row"))
        return best.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))

    # Found once and stored: the number decides the way, the keys are what is broadcast.
    repeated = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(key))
    found = repeated.count()
    if not found:
        return rows.select(key, *rest)
    if found > broadcast_keys:
        return last(rows)
    keys = F.broadcast(repeated)
    return rows.join(keys, key, "left_anti").select(key, *rest).unionByName(last(rows.join(keys, key, "left_semi")))


def skew_safe_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``lookup`` on keys that may hold any share of the rows.

    ``weight`` is a column of the lookup, the number of rows of its key at most, and ``total`` the sum of all rows.
    At most HOT keys can have a HOT-th of the total, so the part of the lookup that is broadcast has a proven bound;
    every other key holds less than a HOT-th of the rows, and an ordinary shuffle join spreads those evenly.
    ``how`` is inner or left_semi. The keys must not be null in the lookup.
    """
    hot = F.col(weight) * HOT >= total
    heads = lookup.filter(hot)
    tails = lookup.filter(~hot)
    names = heads.select(*keys)
    first = rows.join(F.broadcast(heads), keys, how)
    rest = rows.join(F.broadcast(names), keys, "left_anti").join(tails.hint("shuffle_merge"), keys, how)
    return first.unionByName(rest)


def scratch(prefix: str) -> tempfile.TemporaryDirectory:
    """Private spill folder of one task, gone when the task ends. It lies where Spark keeps its own shuffle spill and nothing else
    ever reads it: a task that is run again elsewhere fills a new one."""
    local = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(",")[0]
    return tempfile.TemporaryDirectory(prefix=prefix, dir=local if local and os.path.isdir(local) else None, ignore_cleanup_errors=True)
