"""The command line: ``python -m lumetext.cli <command> ...``. Wrong usage ends with 2, a failure with 1."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import web
from .operators import crawl as crawling
from .operators import evaluation, lexicon, links, matching, ranking
from .operators.index import index_sizes, store_index, update_index
from .operators.snippets import snippet
from .plans import language as lang
from .searcher import Prompt, Searcher, Service, Settings, lines_of, open_index, rendered
from .sources import corpus as sources
from .storage import replace_folder

COMMANDS: dict[str, tuple[Callable, Callable[[argparse.ArgumentParser], None]]] = {}


class Failure(Exception):
    pass


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lumetext").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def command(name: str, *positional: str, **options):
    """Registers a command. A positional with ``...`` takes one value or more, one with ``?`` may be missing; options give their default, a type as default takes a
    value, False is a switch."""

    def fill(p: argparse.ArgumentParser) -> None:
        for x in positional:
            p.add_argument(x.rstrip(".?"), nargs="+" if x.endswith("...") else "?" if x.endswith("?") else None)
        for k, default in options.items():
            flag = "--" + k.replace("_", "-")
            if default is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=None if isinstance(default, type) else default, type=default if isinstance(default, type) else type(default))

    def add(f):
        COMMANDS[name] = (f, fill)
        return f

    return add


def _rows(df: DataFrame, *columns: str) -> list[str]:
    return [" ".join(str(r[c]) for c in columns) for r in df.collect()]


# Documents


@command("docs", "corpus")
def docs(a):
    return _rows(sources.open_corpus(session(), a.corpus).select("doc_id").orderBy("doc_id"), "doc_id")


def _document(spark: SparkSession, corpus: str, doc_id: str):
    found = sources.open_corpus(spark, corpus).filter(F.col("doc_id").cast("string") == doc_id).first()
    if found is None:
        raise Failure(f"no document {doc_id}")
    return found


@command("show", "corpus", "doc_id")
def show(a):
    d = _document(session(), a.corpus, a.doc_id)
    return [f"id: {d.doc_id}", f"title: {d.title}", "", d.body]


@command("corpus-write", "corpus", "file")
def corpus_write(a):
    return [f"{sources.write_packed(sources.open_corpus(session(), a.corpus), a.file)} documents"]


def _stored(docs_: DataFrame, file: str) -> list[str]:
    docs_.write.mode("overwrite").parquet(file)
    return [f"{docs_.sparkSession.read.parquet(file).count()} documents"]


@command("wiki-import", "dump", "file", limit=0, abstracts=False)
def wiki_import(a):
    return _stored(sources.read_wikipedia(session(), a.dump, a.abstracts, a.limit), a.file)


@command("beir-import", "dump", "file")
def beir_import(a):
    return _stored(sources.read_beir(session(), a.dump), a.file)


# Text


@command("tokenize", "text")
def tokenize(a):
    return [f"{p} {o} {t}" for p, o, t in tx.tokenize(a.text)]


@command("normalize", "token")
def normalize(a):
    return [tx.normalize(a.token)]


@command("terms", "text", drop_stopwords=False)
def terms(a):
    rows = [(p, o, tx.normalize(t)) for p, o, t in tx.tokenize(a.text)]
    return [f"{p} {o} {t}" for p, o, t in rows if t and not (a.drop_stopwords and tx.is_stopword(t))]


@command("stopword", "word")
def stopword(a):
    return ["yes" if tx.is_stopword(tx.normalize(a.word)) else "no"]


@command("stem-info", "word")
def stem_info(a):
    info = tx.stem_info(a.word)
    pattern = "".join("c" if c else "v" for c in tx.consonants(a.word))
    return [f"pattern {pattern}", *(f"{k} {str(v).lower()}" for k, v in info.items())]


@command("stem-step", "step", "word")
def stem_step(a):
    if a.step not in tx.STEPS:
        raise Failure(f"no step {a.step}")
    return [tx.stem_step(a.step, a.word)]


@command("stem", "word")
def stem(a):
    return [tx.stem(a.word)]


@command("analyze", "text")
def analyze(a):
    return [f"{p} {o} {t}" for p, o, t in tx.analyze(a.text)]


@command("analyze-doc", "corpus", "doc_id")
def analyze_doc(a):
    d = _document(session(), a.corpus, a.doc_id)
    return [f"{p} {o} {t}" for p, o, t in tx.analyze(f"{d.title or ''}\n\n{d.body or ''}")]


# The index


@command("index-stats", "source")
def index_stats(a):
    c = open_index(session(), a.source).counts().first()
    return [f"documents {c.documents}", f"terms {c.terms}", f"postings {c.postings}"]


@command("index-terms", "source")
def index_terms(a):
    return _rows(open_index(session(), a.source).dictionary(), "term", "df")


@command("postings", "source", "word")
def postings(a):
    return _rows(open_index(session(), a.source).postings_of(a.word), "doc_id")


@command("tf", "source", "word")
def tf(a):
    return _rows(open_index(session(), a.source).postings_of(a.word), "doc_id", "tf")


@command("positions", "source", "word")
def positions(a):
    return [" ".join(map(str, (r.doc_id, *r.positions))) for r in open_index(session(), a.source).postings_of(a.word).collect()]


@command("lengths", "source")
def lengths(a):
    index = open_index(session(), a.source)
    return [*_rows(index.lengths(), "doc_id", "length"), f"average {index.averages().first().average_length:.2f}"]


@command("index-write", "source", "file", encoding="varbyte", threads=0)
def index_write(a):
    spark = session()
    searcher = Searcher(spark, a.source)
    searcher.index.save(a.file)
    searcher.save_sidecars(a.file)
    return index_stats(argparse.Namespace(source=a.file))


@command("index-build", "source", "file", block=0, threads=0)
def index_build(a):
    spark = session()
    store_index(sources.open_corpus(spark, a.source), a.file)
    Searcher(spark, a.source).save_sidecars(a.file) if Path(a.source, "urls.tsv").exists() else None
    return index_stats(argparse.Namespace(source=a.file))


@command("index-update", "corpus", "file", encoding="varbyte")
def index_update(a):
    spark = session()
    new, tally = update_index(open_index(spark, a.file), sources.open_corpus(spark, a.corpus))
    t = tally.first()
    # The old tables are read while the new ones are written; the new version takes their place by renames at the end.
    new.save(f"{a.file}.new")
    replace_folder(spark, f"{a.file}.new", a.file, ("docs", "postings", "terms", "corpus"))
    return [f"added {t.added}", f"updated {t.updated}", f"removed {t.removed}", f"unchanged {t.unchanged}"]


@command("index-size", "source")
def index_size(a):
    by: dict[str, dict[str, int]] = {}
    for r in index_sizes(open_index(session(), a.source)).collect():
        by.setdefault(r.encoding, {})[r.section] = r.bytes
    out = [f"{e} {sum(parts.values())} " + " ".join(f"{k} {v}" for k, v in parts.items()) for e, parts in by.items()]
    return [*out, f"ratio {sum(by['plain'].values()) / sum(by['varbyte'].values()):.2f}"]


# Queries


@command("lex", "query")
def lex(a):
    return [f"{t.kind} {t.text}".rstrip() for t in lang.lex(a.query)]


@command("parse", "query")
def parse(a):
    return [str(lang.parse(a.query))]


@command("and", "source", "words...")
def and_(a):
    return _rows(matching.intersect(open_index(session(), a.source), a.words), "doc_id")


@command("or", "source", "words...")
def or_(a):
    return _rows(matching.unite(open_index(session(), a.source), a.words), "doc_id")


@command("andnot", "source", "first", "second")
def andnot(a):
    return _rows(matching.subtract(open_index(session(), a.source), a.first, a.second), "doc_id")


@command("phrase", "source", "text")
def phrase(a):
    return _rows(matching.phrase(open_index(session(), a.source), a.text), "doc_id")


@command("match", "source", "query")
def match(a):
    return _rows(matching.match(open_index(session(), a.source), a.query), "doc_id")


def _ranked(rows: DataFrame) -> list[str]:
    return [f"{r.doc_id} {r.score:.4f}" for r in rows.collect()]


@command("tfidf", "source", "words...", threads=0)
def tfidf(a):
    return _ranked(ranking.rank_words(open_index(session(), a.source), a.words, "tfidf"))


@command("bm25", "source", "words...", threads=0)
def bm25(a):
    return _ranked(ranking.rank_words(open_index(session(), a.source), a.words, "bm25"))


@command("top", "source", "k", "words...", bm25=False, threads=0)
def top(a):
    return _ranked(ranking.rank_words(open_index(session(), a.source), a.words, "bm25" if a.bm25 else "tfidf", int(a.k)))


OPTIONS = {"limit": 10, "scorer": "bm25", "snippet": False, "corpus": str, "max_chars": 160, "tsv": False, "pagerank": 0.0, "pagerank_graph": "page", "pagerank_max_words": 0}


def _searcher(a) -> Searcher:
    if a.scorer not in ranking.SCORERS:
        raise Failure("scorer must be bm25, bm25f or tfidf")
    return Searcher(session(), a.source, a.corpus, Settings(a.limit, a.scorer, a.snippet, a.max_chars, a.pagerank, a.pagerank_graph, a.pagerank_max_words))


@command("query", "source", "query", **OPTIONS)
def query(a):
    return lines_of(_searcher(a).search(a.query), a.tsv)


@command("repl", "source", **OPTIONS)
def repl(a):
    prompt = Prompt(_searcher(a), a.tsv)
    for line in sys.stdin:
        for out in prompt.answer(line):
            print(out, flush=True)
        if prompt.done:
            break
    return []


@command("serve", "source", stdin=False, port=8080, **OPTIONS)
def serve(a):
    service = Service(_searcher(a))
    if a.stdin:
        method, target, _ = (sys.stdin.readline().split() + ["", "", ""])[:3]
        return [rendered(*service.respond(method, target))]
    print(f"http://127.0.0.1:{a.port}/", flush=True)
    service.serve(a.port)
    return []


@command("snippet", "corpus", "doc_id", "words...", max_chars=200)
def snippet_(a):
    d = _document(session(), a.corpus, a.doc_id)
    return [snippet(f"{d.title or ''}\n\n{d.body or ''}", tx.query_terms(a.words), a.max_chars)]


@command("suggest", "source", "word", max_distance=2, limit=5)
def suggest(a):
    return _rows(lexicon.suggest(open_index(session(), a.source), a.word, a.max_distance, a.limit), "term", "distance", "df")


@command("complete", "source", "prefix", limit=10)
def complete(a):
    return _rows(lexicon.complete(open_index(session(), a.source), a.prefix, a.limit), "term", "df")


@command("edit-distance", "a", "b")
def edit_distance(a):
    return [str(lexicon.edit_distance(a.a, a.b))]


@command("evaluate", "source", "queries", "qrels", scorer="bm25", limit=100, pagerank=0.0)
def evaluate(a):
    spark = session()
    r = evaluation.evaluate(open_index(spark, a.source), sources.read_beir_queries(spark, a.queries), sources.read_qrels(spark, a.qrels), a.scorer).first()
    return [f"queries {r.judged}", f"unjudged {r.unjudged}", f"ndcg@10 {r.ndcg_10:.4f}", f"precision@10 {r.precision_10:.4f}", f"recall@100 {r.recall_100:.4f}"]


# Links and the web


@command("pagerank", "links", iterations=30, damping=0.85, out=str, sites=str)
def pagerank(a):
    spark = session()
    edges = sources.read_links(spark, a.links)
    ranks = links.site_pagerank(edges, sources.read_urls(spark, a.sites), a.iterations, a.damping) if a.sites else links.pagerank(edges, a.iterations, a.damping)
    if a.out:
        sources.write_ranks(ranks, a.out)
    return [f"{r.page} {r.score:.6f}" for r in links.ordered(ranks).collect()]


def _url(text: str) -> web.Url:
    found = web.parse_url(text)
    if found is None:
        raise Failure(f"no address: {text}")
    return found


@command("url", "url")
def url(a):
    return [str(_url(a.url))]


@command("url-resolve", "base", "ref")
def url_resolve(a):
    found = web.resolve_url(_url(a.base), a.ref)
    if found is None:
        raise Failure(f"no address: {a.ref}")
    return [str(found)]


def _text(path: str) -> str:
    return Path(path).read_bytes().decode("utf-8", "replace")


@command("robots", "file", "agent", "path")
def robots(a):
    return ["allow" if web.parse_robots(_text(a.file), a.agent).allows(a.path) else "disallow"]


@command("crawl-delay", "file", "agent", "floor_ms")
def crawl_delay(a):
    return [str(web.parse_robots(_text(a.file), a.agent).wait(int(a.floor_ms)))]


@command("html-text", "file")
def html_text(a):
    page = web.parse_html(_text(a.file))
    return [page.title, page.text]


@command("html-links", "base", "file")
def html_links(a):
    base = _url(a.base)
    return [str(u) for ref in web.parse_html(_text(a.file)).links if (u := web.resolve_url(base, ref))]


#: Redirects that are followed for one page.
REDIRECTS = 5


def _online(agent: str) -> Callable[[web.Url], crawling.Fetched]:
    import urllib.error
    import urllib.request

    class Redirects(urllib.request.HTTPRedirectHandler):
        max_redirections = REDIRECTS

    opener = urllib.request.build_opener(Redirects)

    def get(u: web.Url) -> crawling.Fetched:
        try:
            with opener.open(urllib.request.Request(str(u), headers={"User-Agent": agent}), timeout=10) as r:
                return crawling.Fetched(r.status, r.headers.get_content_type(), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"))
        except urllib.error.HTTPError as e:
            return crawling.Fetched(e.code)
        except OSError:
            return crawling.Fetched(0)

    return get


def _pauses(delay_ms: int) -> Callable[[str, web.Robots], None]:
    """Waits until a host's last fetch is as long ago as the delay or the host's own rule asks, whichever is longer."""
    last: dict[str, float] = {}

    def pause(host: str, rules: web.Robots) -> None:
        time.sleep(max(0.0, last.get(host, -1e9) + rules.wait(delay_ms) / 1000 - time.monotonic()))
        last[host] = time.monotonic()

    return pause


@command("crawl", "seed", delay=1000, mirror=str, out=str, max_pages=100, max_depth=3, user_agent="lumetext", all_hosts=False, prefix="/", max_per_host=0, concurrency=1)
def crawl(a):
    get, pause = (crawling.mirror_fetcher(a.mirror), None) if a.mirror else (_online(a.user_agent), _pauses(a.delay))
    found = crawling.crawl(_url(a.seed), get, a.user_agent, a.max_pages, a.max_depth, not a.all_hosts, a.prefix, a.max_per_host, a.concurrency, pause)
    if a.out:
        folder = Path(a.out)
        folder.mkdir(parents=True, exist_ok=True)
        ids = {u: name for name, u, *_ in found.pages if name}
        for name, u, _, title, text, _ in found.pages:
            if name:
                (folder / f"{name}.txt").write_text(f"title: {title or u}\n\n{text}\n")
        (folder / "urls.tsv").write_text("".join(f"{name}\t{u}\n" for u, name in ids.items()))
        (folder / "links.tsv").write_text("".join(f"{ids[s]}\t{ids[t]}\n" for s, t in found.links if s in ids and t in ids))
    return [f"{status} {depth} {u}" for _, u, status, _, _, depth in found.pages]


# Measurements


@command("pool-sum", "threads", "n")
def pool_sum(a):
    return [str(evaluation.pool_sum(session(), int(a.n), max(1, int(a.threads))).first().total)]


@command("bench", "what", "source", "queries?", stable=False, threads=0, limit=10, repeats=5, snippet=False, corpus=str)
def bench(a):
    spark = session()
    if a.what not in ("build", "query"):
        raise Failure("bench build or bench query")
    if a.what == "build":
        index, ms = evaluation.timed(lambda: open_index(spark, a.source))
        c = index.counts().first()
        stable = [f"documents {c.documents}", f"terms {c.terms}", f"postings {c.postings}"]
        return stable if a.stable else [*stable, f"build_ms {ms:.0f}", f"docs_per_sec {c.documents / max(ms, 1) * 1000:.0f}"]
    if not a.queries:
        raise Failure("a file of queries is needed")
    searcher = Searcher(spark, a.source, a.corpus, Settings(limit=a.limit, snippets=a.snippet))
    times, rejected, found = [], 0, 0
    log = [r.query for r in sources.read_queries(spark, a.queries).orderBy("query_ord").collect()]
    for q in log:
        for _ in range(a.repeats):
            try:
                rows, ms = evaluation.timed(lambda q=q: searcher.search(q))
            except lang.QueryError:
                rejected += 1
                break
            times.append((ms,))
        else:
            found += len(rows)
    stable = [f"queries {len(log)}", f"rejected {rejected}", f"results {found}"]
    if a.stable or not times:
        return stable
    t = evaluation.latencies(spark.createDataFrame(times, "ms double")).first()
    return [*stable, f"p50_ms {t.p50:.2f}", f"p95_ms {t.p95:.2f}", f"p99_ms {t.p99:.2f}", f"mean_ms {t['mean']:.2f}", f"queries_per_sec {1000 / t['mean']:.0f}"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumetext")
    subs = parser.add_subparsers(dest="command", required=True)
    for name, (_, fill) in COMMANDS.items():
        fill(subs.add_parser(name))
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        for line in COMMANDS[args.command][0](args):
            print(line)
    except (Failure, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
