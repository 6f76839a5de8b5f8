"""Problem 9: a mixture in which each source has its target share of the tokens, as nearly as its repetitions allow.

Method: capped water-filling. Sources that can't reach their share at their most repetitions are clamped there, their excess weight
goes to the others in proportion, until no further source is clamped; whole repetitions and a last, broken one in seeded order make up
each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import TOKENIZERS, token_counts

#: Sources of a mixture at most: the bound of what is broadcast. More targets than this are an error.
MOST_SOURCES = 100_000

#: Ranges of the seeded order of a source's records: its broken repetition ends in one of them, whose records alone are lined up.
RANGES = 1 << 16


def water_fill(share: list[float], cap: list[float], total: float) -> list[float]:
    """Amounts of at most ``cap`` whose sum is ``total`` (or all caps, if they fall short), as proportional to ``share`` as can be."""
    got = [0.0] * len(share)
    free = {i for i in range(len(share)) if share[i] > 0 and cap[i] > 0}
    left = total
    while free and left > 0:
        level = left / sum(share[i] for i in free)
        full = {i for i in free if cap[i] <= share[i] * level}
        if not full:
            for i in free:
                got[i] = share[i] * level
            break
        for i in full:
            got[i] = cap[i]
            left -= cap[i]
        free -= full
    return got


def _plan(total_tokens: int | None):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(parts), ignore_index=True)
        if t.empty:
            return
        t = t.sort_values("source", ignore_index=True)  # so that sums round alike every time
        have = t["tokens"].fillna(0).astype("int64")
        most = t["max_repeats"].fillna(1).clip(lower=0)
        target = t["target_share"].where(t["target_share"] > 0, 0.0).fillna(0.0)
        total = float(have[target > 0].sum() if total_tokens is None else total_tokens)
        amount = water_fill(target.tolist(), (have * most).astype(float).tolist(), total)
        t = t.assign(available_tokens=have, planned_tokens=amount, max_repeats=most.astype("int32"))
        t["epochs"] = [a / h if h else 0.0 for a, h in zip(amount, have, strict=True)]
        t["planned_share"] = t["planned_tokens"] / total if total else 0.0
        yield t[["source", "target_share", "max_repeats", "available_tokens", "planned_tokens", "planned_share", "epochs"]]

    return run


def mixing_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, planned_tokens, planned_share, epochs) for each target.

    ``sizes`` has (source, n_tokens). A source without tokens gets 0 and its weight goes to the others; a null max_repeats means
    1, a null or non-positive share 0, a null source in the targets is left out, and of repeated targets the largest counts. The
    total is that of all listed sources once over, if not given.
    """
    tokens = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    own = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    bounded = own.limit(MOST_SOURCES + 1).select("source", F.assert_true(F.count(F.lit(1)).over(_all()) <= MOST_SOURCES).alias("ok"), "t.*")
    sides = bounded.filter(F.col("ok").isNull()).drop("ok").join(tokens, "source", "left")
    return sides.coalesce(1).mapInPandas(_plan(total_tokens), "source string, target_share double, max_repeats int, available_tokens long, planned_tokens double, planned_share double, epochs double")


def _all():
    return Window.partitionBy(F.lit(0))


def broken_repetition(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(_k, _s, n_tokens) of the records in the last, broken repetition of each source: those that come first in seeded order, as long as
    a record brings the source's tokens nearer to what the plan leaves after the whole repetitions.

    The tokens of each of RANGES ranges of the order are summed, the range in which the target falls is found from the sums, ranges
    before it are taken whole, and the records of that one range are lined up: a RANGES-th of a source in one task.
    """
    placed = rows.withColumn("_range", F.shiftrightunsigned("_h", 48).cast("int"))
    sums = placed.groupBy("_s", "_range").agg(F.sum("n_tokens").alias("_t"))
    upto = sums.withColumn("_upto", F.sum("_t").over(Window.partitionBy("_s").orderBy("_range")))
    left = plan.select(F.col("source").alias("_s"), (F.col("planned_tokens") - F.floor("epochs") * F.col("available_tokens")).alias("_left"))
    # The first range that reaches the target, and the tokens before it; none where all ranges stay below.
    reached = upto.join(F.broadcast(left), "_s").filter((F.col("_left") > 0) & (F.col("_upto") >= F.col("_left")))
    ends = reached.groupBy("_s").agg(F.min(F.struct("_range", (F.col("_upto") - F.col("_t")).alias("_before"), "_left")).alias("_end"))
    bounded = placed.join(F.broadcast(ends), "_s")
    whole = bounded.filter(F.col("_range") < F.col("_end._range")).select("_k", "_s", "n_tokens")
    line = Window.partitionBy("_s").orderBy("_h", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = bounded.filter(F.col("_range") == F.col("_end._range")).withColumn("_upto", F.col("_end._before") + F.sum("n_tokens").over(line))
    near = last.filter(F.col("_upto") - F.col("n_tokens") / 2 <= F.col("_end._left")).select("_k", "_s", "n_tokens")
    return whole.unionByName(near)


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 42, total_tokens: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, n_tokens, copy from 1) and its shares (source, target_share, max_repeats, available_tokens,
    planned_tokens, planned_share, mixture_tokens, reached_share).

    A source that is taken e times gives every record floor(e) times, and the records that come first in seeded order once more, up to
    its planned tokens: it misses them by half of its last record at most. No record comes over max_repeats times, as the plan does
    not. Records without a source, of one not listed, or without a token are not mixed in. A record's place in the order hangs on the
    seed, its key and its text, so neither the rows' order nor partitions matter.

    Texts are read and counted once: the counts are stored (cut), and only they are used afterwards. The plan is broadcast; its
    rows are the targets' sources, of which more than MOST_SOURCES are an error. No row moves but for the sums of ranges and the one
    range in which a source ends, so no source is hot.
    """
    own = docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_h"), F.col(text).alias("_t"))
    sizes = cut(token_counts(own.filter(F.col("_s").isNotNull()), ["_k", "_s", "_h"], "_t", folder=folder))
    plan = cut(mixing_plan(sizes.select(F.col("_s").alias("source"), "n_tokens"), targets, total_tokens))
    rows = sizes.filter(F.col("n_tokens") > 0)
    times = rows.join(F.broadcast(plan.select(F.col("source").alias("_s"), F.floor("epochs").cast("int").alias("_n"))), "_s").filter(F.col("_n") > 0)
    whole = times.select("_k", "_s", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    epochs = F.broadcast(plan.select(F.col("source").alias("_s"), (F.floor("epochs") + 1).cast("int").alias("copy")))
    mixed = cut(whole.unionByName(broken_repetition(rows, plan).join(epochs, "_s").select("_k", "_s", "n_tokens", "copy")))
    got = mixed.groupBy(F.col("_s").alias("source")).agg(F.sum("n_tokens").alias("mixture_tokens"))
    full = plan.join(got, "source", "left").fillna(0, ["mixture_tokens"])
    share = F.col("mixture_tokens") / F.sum("mixture_tokens").over(_all())
    shares = full.select("source", "target_share", "max_repeats", "available_tokens", "planned_tokens", "planned_share", "mixture_tokens", F.coalesce(share, F.lit(0.0)).alias("reached_share"))
    return mixed.select(F.col("_k").alias(key), F.col("_s").alias(source), "n_tokens", "copy"), shares
