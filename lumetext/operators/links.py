"""Link graphs: PageRank of pages, sites and home pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.web import canonical_column, host_column
from ..storage import cut, drop_cut
from .ranking import Prior


def pagerank(links: DataFrame, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """(page, score) of every name on either end of (src, dst).

    A link counts once, self-links stay, and the mass of pages without links is spread over all. Rows with a null end are left out.
    Each round is one join of the ranks with the edges and one sum; its result is stored, so the plan stays one round long, and a
    lost executor costs one round. A page that many link to is pre-aggregated by the sum; one that links to many is split by AQE.
    """
    if iterations < 0 or not 0 <= damping <= 1:
        raise ValueError("iterations must not be negative, and damping must lie in 0..1")
    spark = links.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = links.select("src", "dst").dropna().distinct()
    degrees = edges.groupBy("src").agg((1.0 / F.count(F.lit(1))).alias("share"))
    # Both stay where their join needs them: the stored tables keep their partitioning, so a round moves only the summed shares.
    edges = cut(edges.join(degrees, "src").repartition(parts, "src"))
    ends = edges.select(F.col("src").alias("page"), F.lit(True).alias("linking")).union(edges.select("dst", F.lit(False)))
    nodes = cut(ends.groupBy("page").agg(F.max(F.when(F.col("linking"), True)).alias("linking")).repartition(parts, "page"))
    n = nodes.count()
    ranks = nodes.withColumn("score", F.lit(1.0 / n if n else 0.0))
    for i in range(iterations if n else 0):
        idle = ranks.filter(F.col("linking").isNull()).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).scalar()
        given = ranks.join(edges, F.col("page") == F.col("src")).groupBy(F.col("dst").alias("page")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + idle / n)
        before, ranks = ranks, cut(nodes.join(given, "page", "left").select("page", "linking", score.alias("score")))
        if i:
            drop_cut(before)
    return ranks.select("page", "score")


def ordered(ranks: DataFrame) -> DataFrame:
    return ranks.orderBy(F.desc("score"), F.asc("page"))


def page_hosts(urls: DataFrame) -> DataFrame:
    """(doc_id, host, home) of (doc_id, url[, ord]): home is whether the page is its host's home page, the first in order with path / and no
    query. Ports and schemes do not part hosts; rows whose address is none are left out."""
    order = F.col("ord") if "ord" in urls.columns else F.col("doc_id")
    canon = urls.select("doc_id", order.alias("_o"), canonical_column(F.col("url")).alias("_c")).filter(F.col("_c").isNotNull())
    own = canon.select("doc_id", "_o", host_column(F.col("_c")).alias("host"), F.col("_c").rlike(r"^https?://[^/]+/$").alias("_root"))
    first = own.filter("_root").groupBy("host").agg(F.min(F.struct("_o", "doc_id")).alias("_first"))
    return own.join(first.select("host", F.col("_first.doc_id").alias("_home")), "host", "left").select("doc_id", "host", F.coalesce(F.col("doc_id") == F.col("_home"), F.lit(False)).alias("home"))


def host_links(links: DataFrame, urls: DataFrame) -> DataFrame:
    """(src, dst) between different hosts, once for each pair; links with an unknown end are left out."""
    hosts = page_hosts(urls).select("doc_id", "host")
    a = hosts.select(F.col("doc_id").alias("src"), F.col("host").alias("_a"))
    b = hosts.select(F.col("doc_id").alias("dst"), F.col("host").alias("_b"))
    return links.join(a, "src").join(b, "dst").filter(F.col("_a") != F.col("_b")).select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()


def site_pagerank(links: DataFrame, urls: DataFrame, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """(page, score): PageRank of the hosts, credited to their home pages. Hosts without a home page get their share but no row."""
    homes = page_hosts(urls).filter("home").select(F.col("host").alias("_h"), F.col("doc_id").alias("_d"))
    ranks = pagerank(host_links(links, urls), iterations, damping)
    return ranks.join(homes, F.col("page") == F.col("_h")).select(F.col("_d").alias("page"), "score")


def home_page_ranking(urls: DataFrame) -> DataFrame:
    """(page, score): every home page alike; needs no links."""
    homes = page_hosts(urls).filter("home").select(F.col("doc_id").alias("page"))
    n = homes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return homes.withColumn("score", 1.0 / n)


def as_prior(ranks: DataFrame) -> Prior:
    return Prior(ranks.select(F.col("page").alias("doc_id"), "score"))


def crawl_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst) document ids of links (src, dst as addresses) both of whose ends were kept as (doc_id, url); as often as they come."""
    a = pages.select(F.col("doc_id").alias("_from"), F.col("url").alias("src"))
    b = pages.select(F.col("doc_id").alias("_to"), F.col("url").alias("dst"))
    return links.join(a, "src").join(b, "dst").select(F.col("_from").alias("src"), F.col("_to").alias("dst"))
