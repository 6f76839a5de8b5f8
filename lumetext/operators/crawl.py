"""Crawls: the frontier on the driver, as its budget and its order are sequential; parsing and link graphs as DataFrames."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from hashlib import sha1
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.web import Robots, Url, canonical_column, host_column, parse_html, parse_robots, parse_url, resolve_url


@dataclass
class Fetched:
    status: int
    content_type: str = ""
    body: str = ""


def mirror_fetcher(root: str) -> Callable[[Url], Fetched]:
    """Pages of a folder that mirrors sites as host/path; folders and addresses with a last slash mean index.html."""

    def get(url: Url) -> Fetched:
        path = Path(root, url.host, url.path.lstrip("/")) if url.path != "/" else Path(root, url.host)
        if path.is_dir() or url.path.endswith("/"):
            path = path / "index.html"
        if not path.is_file():
            return Fetched(404)
        kind = {".html": "text/html", ".htm": "text/html", ".txt": "text/plain"}.get(path.suffix, "application/octet-stream")
        return Fetched(200, kind, path.read_bytes().decode("utf-8", "replace"))

    return get


class Frontier:
    """First in, first out; an address once, none deeper than max_depth, and max_pages addresses ever seen."""

    def __init__(self, max_depth: int, max_pages: int) -> None:
        self.max_depth, self.max_pages = max_depth, max_pages
        self.queue: deque[tuple[Url, int]] = deque()
        self.seen: set[str] = set()
        self.issued = 0

    def push(self, url: Url, depth: int) -> bool:
        name = str(url)
        if depth > self.max_depth or name in self.seen or len(self.seen) >= self.max_pages:
            return False
        self.seen.add(name)
        self.queue.append((url, depth))
        return True

    def pop(self) -> tuple[Url, int] | None:
        if not self.queue or self.issued >= self.max_pages:
            return None
        self.issued += 1
        return self.queue.popleft()


@dataclass
class Crawl:
    pages: list[tuple] = field(default_factory=list)  # doc_id, url, status, title, text, depth
    links: list[tuple[str, str]] = field(default_factory=list)


def crawl(
    seed: Url,
    get: Callable[[Url], Fetched],
    agent: str = "lumetext",
    max_pages: int = 100,
    max_depth: int = 3,
    same_host: bool = True,
    prefix: str = "/",
    max_per_host: int = 0,
    concurrency: int = 1,
    pause: Callable[[str, Robots], None] | None = None,
) -> Crawl:
    """Breadth first from a seed, under the robots rules of each host. A body that was seen is skipped; numbers count every page that
    came back, but only those of status 200 keep a document and links.

    Up to ``concurrency`` pages, each of another host, are fetched at the same time and then taken in, in the order of the frontier, so
    the result is that of one at a time. ``pause`` is called before each fetch with the host and its rules, and may wait. Of bodies only
    digests are kept.
    """
    frontier, out = Frontier(max_depth, max_pages), Crawl()
    robots: dict[str, Robots] = {}
    queued = {seed.host: 1}
    bodies: set[bytes] = set()
    frontier.push(seed, 0)
    number = 0

    def rules_of(url: Url) -> Robots:
        page = get(Url(url.scheme, url.host, url.port, "/robots.txt"))
        return parse_robots(page.body, agent) if page.status == 200 else Robots()

    def fetch(url: Url) -> Fetched | None:
        if url.host not in robots:
            robots[url.host] = rules_of(url)
        if not robots[url.host].allows(url.path):
            return None
        if pause:
            pause(url.host, robots[url.host])
        return get(url)

    held: tuple[Url, int] | None = None
    with ThreadPoolExecutor(max(1, concurrency)) as pool:
        while True:
            batch: list[tuple[Url, int]] = []
            while len(batch) < max(1, concurrency) and (entry := held or frontier.pop()):
                held = None
                if any(entry[0].host == url.host for url, _ in batch):
                    held = entry  # waits for its host
                    break
                batch.append(entry)
            if not batch:
                return out
            for (url, depth), page in zip(batch, pool.map(fetch, [url for url, _ in batch]), strict=True):
                if page is None:
                    continue
                if page.status == 200:
                    digest = sha1(page.body.encode("utf-8", "surrogatepass")).digest()
                    if digest in bodies:
                        continue
                    bodies.add(digest)
                title = text = ""
                targets = []
                if page.status == 200 and page.content_type.startswith("text/html"):
                    parsed = parse_html(page.body)
                    title, text = parsed.title, parsed.text
                    for ref in parsed.links:
                        target = resolve_url(url, ref)
                        if target is None or same_host and target.host != seed.host or not target.path.startswith(prefix):
                            continue
                        targets.append(str(target))
                        if max_per_host and queued.get(target.host, 0) >= max_per_host:
                            continue
                        if frontier.push(target, depth + 1):
                            queued[target.host] = queued.get(target.host, 0) + 1
                number += 1
                name = f"doc_{number:04d}" if page.status == 200 else None
                out.pages.append((name, str(url), page.status, title, text, depth))
                if name:
                    out.links += [(str(url), t) for t in targets]


def crawl_tables(spark: SparkSession, result: Crawl) -> tuple[DataFrame, DataFrame]:
    """(doc_id, url, status, title, text, depth) and the links (src, dst) between kept documents."""
    from .links import crawl_links

    pages = spark.createDataFrame(result.pages, "doc_id string, url string, status int, title string, text string, depth int")
    links = spark.createDataFrame(result.links, "src string, dst string")
    return pages, crawl_links(pages.filter(F.col("doc_id").isNotNull()).select("doc_id", "url"), links)


def crawl_corpus(pages: DataFrame) -> DataFrame:
    """Documents of a crawl: status 200, the address where there is no title."""
    return pages.filter(F.col("doc_id").isNotNull()).select("doc_id", F.when(F.coalesce("title", F.lit("")) == "", F.col("url")).otherwise(F.col("title")).alias("title"), F.col("text").alias("body"))


def allowed_pages(pages: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """The pages that their host's rules allow an agent to fetch; ``robots`` is (host, text). Pages of hosts without rules stay, those
    whose address is none go. A host's rules are parsed once for each batch that holds its pages."""
    kept = pages.columns
    hosts = robots.select(F.col("host").alias("_host"), F.col("text").alias("_rules"))
    joined = pages.withColumn("_url", canonical_column(F.col(url))).filter(F.col("_url").isNotNull()).withColumn("_host", host_column(F.col("_url"))).join(hosts, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, Robots] = {}
            keep = []
            for address, text in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
                if text is not None and text not in known:
                    known[text] = parse_robots(text, agent)
                keep.append(text is None or known[text].allows(parse_url(address).path))
            yield batch.select(kept).filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return joined.select(*kept, "_url", "_rules").mapInArrow(run, schema)


def first_bodies(pages: DataFrame, body: str = "text", order: str = "page_id") -> DataFrame:
    """Pages whose body no page before them had, by a hash and the length; nulls stay apart. One body may be a third of all rows, so
    the first of each is found by an aggregation, not in a window over the group."""
    mark = pages.select("*", F.xxhash64(F.col(body)).alias("_h"), F.length(body).alias("_n"))
    first = mark.filter(F.col(body).isNotNull()).groupBy("_h", "_n").agg(F.min(order).alias(order)).select(order)
    return pages.join(first, order, "left_semi").unionByName(pages.filter(F.col(body).isNull()))


def frontier_levels(seeds: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): the addresses that each round of a breadth-first crawl reaches over a stored link graph (src, dst): what is to be
    fetched of a graph too large for one driver, without budgets."""
    from ..storage import cut

    seen = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for depth in range(1, max_depth + 1):
        following = level.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        level = cut(following.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def per_host(pages: DataFrame, limit: int, order: str = "page_id") -> DataFrame:
    """The first pages of each host."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy(order))).filter(F.col("_n") <= limit).drop("_n")
