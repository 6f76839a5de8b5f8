"""One opened source with its settings: what the prompt, the command line and the web page share."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.web import html_escape, url_decode
from .operators import lexicon, links, ranking, snippets
from .operators.index import Index, build_index, load_index
from .plans.language import QueryError, scoring_terms
from .sources import corpus as sources
from .storage import cut, exists

GRAPHS = ("page", "site", "home")


@dataclass(frozen=True)
class Settings:
    limit: int = 10
    scorer: str = "bm25"
    snippets: bool = False
    size: int = 160
    pagerank: float = 0.0
    graph: str = "page"
    max_words: int = 0


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index, or one built of a corpus of any kind."""
    if exists(spark, f"{path}/postings"):
        return load_index(spark, path)
    built = build_index(sources.open_corpus(spark, path))
    return Index(cut(built.docs), cut(built.postings), built.corpus)


class Searcher:
    def __init__(self, spark: SparkSession, source: str, corpus: str | None = None, settings: Settings | None = None) -> None:
        self.spark, self.source = spark, source
        self.index = open_index(spark, source)
        if corpus:
            self.index.corpus = sources.open_corpus(spark, corpus)
        self.settings = settings or Settings()
        self._priors: dict[str, ranking.Prior | None] = {}

    def prior(self, graph: str) -> ranking.Prior | None:
        """The source's link ranking: stored ones, or of its links and addresses; None where it has neither."""
        if graph not in self._priors:
            self._priors[graph] = self._find(graph)
        return self._priors[graph]

    def _find(self, graph: str) -> ranking.Prior | None:
        here = lambda name: exists(self.spark, f"{self.source}/{name}")
        if here(f"priors/{graph}"):
            return ranking.Prior(self.spark.read.parquet(f"{self.source}/priors/{graph}"))
        if graph == "page" and here("links.tsv"):
            return links.as_prior(links.pagerank(sources.read_links(self.spark, f"{self.source}/links.tsv")))
        if not here("urls.tsv"):
            return None
        urls = sources.read_urls(self.spark, f"{self.source}/urls.tsv")
        if graph == "home":
            return links.as_prior(links.home_page_ranking(urls))
        return links.as_prior(links.site_pagerank(sources.read_links(self.spark, f"{self.source}/links.tsv"), urls)) if here("links.tsv") else None

    def urls(self) -> DataFrame | None:
        if exists(self.spark, f"{self.source}/urls"):
            return self.spark.read.parquet(f"{self.source}/urls")
        return sources.read_urls(self.spark, f"{self.source}/urls.tsv").select("doc_id", "url") if exists(self.spark, f"{self.source}/urls.tsv") else None

    def search(self, query: str, settings: Settings | None = None) -> list:
        s = settings or self.settings
        prior = None
        if s.pagerank > 0:
            prior = self.prior(s.graph)
            if prior is None:
                raise QueryError(f"no {s.graph} ranking for this source")
        found = ranking.run_query(self.index, query, s.limit, s.scorer, prior, s.pagerank, s.max_words)
        if s.snippets and self.index.corpus is not None:
            found = snippets.with_snippets(found, self.index.corpus, scoring_terms(query), s.size)
        return sorted(found.collect(), key=lambda r: (-r.score, r.doc_id))

    def save_sidecars(self, path: str) -> None:
        """The source's link rankings and addresses beside a stored index."""
        for graph in GRAPHS:
            if (p := self.prior(graph)) is not None:
                p.rows.write.mode("overwrite").parquet(f"{path}/priors/{graph}")
        if (u := self.urls()) is not None:
            u.write.mode("overwrite").parquet(f"{path}/urls")


def lines_of(rows: list, tsv: bool = False) -> list[str]:
    out = []
    for i, r in enumerate(rows, 1):
        out.append(f"{r.doc_id}\t{r.score:.4f}" if tsv else f"{i}. {r.doc_id}  {r.score:.4f}")
        if not tsv and "snippet" in r and r.snippet is not None:
            out.append("   " + " ".join(r.snippet.split()))
    return out


def _whole(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() else None


def _weight(text: str) -> float | None:
    try:
        w = float(text)
    except ValueError:
        return None
    return w if math.isfinite(w) and w >= 0 else None


#: The prompt's commands: the value that each takes, and what it does.
PROMPT = {
    ":limit": ("<n>", "show at most n results"),
    ":scorer": ("<name>", "rank by " + ", ".join(ranking.SCORERS)),
    ":snippet": ("<on|off>", "show or hide excerpts"),
    ":pagerank": ("<w>", "let link authority count with weight w (0: not at all)"),
    ":pagerank-graph": ("<g>", "take the authority of " + ", ".join(GRAPHS)),
    ":pagerank-max-words": ("<n>", "use authority only in queries of at most n words (0: in all)"),
    ":complete": ("<p>", "list terms that start with p"),
    ":settings": ("", "list what is set"),
    ":help": ("", "list these commands"),
    ":quit": ("", "leave"),
}


def help_lines() -> list[str]:
    heads = {k: f"{k} {v}".rstrip() for k, (v, _) in PROMPT.items()}
    width = max(map(len, heads.values())) + 2
    return [*(f"{heads[k]:{width}}{what}" for k, (_, what) in PROMPT.items()), 'Anything else is a query: words, "phrases", AND, OR, NOT, parentheses.']


@dataclass
class Prompt:
    """The interactive prompt: lines in, lines out."""

    searcher: Searcher
    tsv: bool = False
    done: bool = field(default=False)

    def answer(self, line: str) -> list[str]:
        line = line.strip()
        if not line:
            return []
        if line.startswith(":"):
            name, _, value = line.partition(" ")
            return self.command(name, value.strip())
        try:
            rows = self.searcher.search(line)
        except QueryError as e:
            return [f"error: {e}"]
        better = None if self.tsv else lexicon.correct_query(self.searcher.index, line)
        return [*([f"did you mean: {better}"] if better else []), *lines_of(rows, self.tsv)]

    def command(self, name: str, value: str) -> list[str]:
        s = self.searcher
        change = None
        if name in (":quit", ":q"):
            self.done = True
        elif name == ":help":
            return help_lines()
        elif name == ":settings":
            x = s.settings
            return [f"limit {x.limit}", f"scorer {x.scorer}", f"snippet {'on' if x.snippets else 'off'}", f"pagerank {x.pagerank:g}", f"pagerank-graph {x.graph}", f"pagerank-max-words {x.max_words}"]
        elif name == ":complete":
            return [f"{r.term} {r.df}" for r in lexicon.complete(s.index, value).collect()]
        elif name in (":limit", ":pagerank-max-words"):
            n = _whole(value)
            if n is None:
                return [f"{name[1:]} must be a non-negative integer"]
            change = {"limit" if name == ":limit" else "max_words": n}
        elif name == ":scorer":
            if value not in ranking.SCORERS:
                return ["scorer must be bm25, bm25f or tfidf"]
            change = {"scorer": value}
        elif name == ":snippet":
            if value not in ("on", "off"):
                return ["snippet must be on or off"]
            change = {"snippets": value == "on"}
        elif name == ":pagerank":
            w = _weight(value)
            if w is None:
                return ["pagerank must be a non-negative number"]
            change = {"pagerank": w}
        elif name == ":pagerank-graph":
            if value not in GRAPHS:
                return ["pagerank-graph must be page, site or home"]
            if s.prior(value) is None:
                return [f"no {value} ranking for this source"]
            change = {"graph": value}
        else:
            return [f"unknown command: {name}"]
        if change:
            s.settings = replace(s.settings, **change)
        return []


class BadRequest(ValueError):
    pass


class Service:
    """The web front end without its socket: ``respond`` maps a request to (status, content type, body)."""

    def __init__(self, searcher: Searcher) -> None:
        self.searcher = searcher
        self.defaults = replace(searcher.settings, snippets=searcher.index.corpus is not None)

    def respond(self, method: str, target: str) -> tuple[int, str, str]:
        path, _, raw = target.partition("?")
        fields = {url_decode(k): url_decode(v) for k, _, v in (p.partition("=") for p in raw.split("&") if p)}
        if method != "GET":
            return 405, "text/plain; charset=utf-8", "only GET is answered\n"
        api = path.startswith("/api/")
        try:
            if path == "/api/complete":
                return 200, "application/json", self.completions(fields)
            if path == "/api/search":
                return 200, "application/json", self.json(fields)
            if path in ("/", "/search"):
                return 200, "text/html; charset=utf-8", self.html(fields)
        except (BadRequest, QueryError) as e:
            return (400, "application/json", json.dumps({"error": str(e)}) + "\n") if api else (400, "text/html; charset=utf-8", self.page(fields.get("q", ""), f"<p>{html_escape(str(e))}</p>"))
        return 404, "text/plain; charset=utf-8", "not found\n"

    @staticmethod
    def _limit(fields: dict, default: int) -> int:
        n = _whole(fields["limit"]) if "limit" in fields else default
        if n is None or "limit" in fields and not 1 <= n <= 100:
            raise BadRequest("limit must be a whole number from 1 to 100")
        return n

    def completions(self, fields: dict) -> str:
        from .functions.text import normalize

        limit, prefix = self._limit(fields, 8), normalize(fields.get("q", ""))
        rows = lexicon.complete(self.searcher.index, prefix, limit).collect() if prefix else []
        return json.dumps({"prefix": prefix, "completions": [{"term": r.term, "documents": r.df} for r in rows]}, ensure_ascii=False, separators=(",", ":")) + "\n"

    def answer(self, fields: dict) -> tuple[str, list[dict], str | None]:
        s = replace(self.defaults, limit=self._limit(fields, self.defaults.limit))
        if "pagerank" in fields:
            w = _weight(fields["pagerank"])
            if w is None:
                raise BadRequest("pagerank must be a non-negative number")
            s = replace(s, pagerank=w)
        if "graph" in fields:
            if fields["graph"] not in GRAPHS:
                raise BadRequest("graph must be page, site or home")
            s = replace(s, graph=fields["graph"])
        if "max_words" in fields:
            n = _whole(fields["max_words"])
            if n is None or n >= 10_000:
                raise BadRequest("max_words must be a whole number below 10000")
            s = replace(s, max_words=n)
        query = fields.get("q", "")
        if not query.strip(" \t"):
            return query, [], None
        ix = self.searcher.index
        rows = self.searcher.search(query, s)
        ids = [r.doc_id for r in rows]
        titles = {r.doc_id: r.title for r in ix.corpus.filter(F.col("doc_id").isin(ids)).select("doc_id", "title").collect()} if ids and ix.corpus is not None else {}
        urls = self.searcher.urls()
        places = {r.doc_id: r.url for r in urls.filter(F.col("doc_id").isin(ids)).collect()} if ids and urls is not None else {}
        out = [{"id": str(r.doc_id), "score": round(r.score, 4), "title": titles.get(r.doc_id) or str(r.doc_id), "url": places.get(r.doc_id, ""), "snippet": " ".join((r.snippet or "").split()) if "snippet" in r else ""} for r in rows]
        return query, out, lexicon.correct_query(ix, query)

    def json(self, fields: dict) -> str:
        query, results, better = self.answer(fields)
        return json.dumps({"query": query, "suggestion": better, "results": results}, ensure_ascii=False, separators=(",", ":")) + "\n"

    def html(self, fields: dict) -> str:
        query, results, better = self.answer(fields)
        parts = [f"<p>Did you mean <b>{html_escape(better)}</b>?</p>"] if better else []
        for r in results:
            title = html_escape(r["title"])
            head = f'<a href="{html_escape(r["url"])}">{title}</a>' if r["url"].startswith(("http://", "https://")) else title
            parts.append(f"<li>{head} <small>{r['score']:.4f}</small><p>{html_escape(r['snippet'])}</p></li>")
        if query.strip() and not results:
            parts.append("<p>No document matches.</p>")
        return self.page(query, "\n".join(parts))

    @staticmethod
    def page(query: str, content: str) -> str:
        return f'<!doctype html><meta charset="utf-8"><title>Search</title><form action="/search"><input name="q" value="{html_escape(query)}"><button>Search</button></form><ol>{content}</ol>\n'

    def serve(self, port: int = 8080) -> None:
        """Answers on the loopback address, one request at a time, until it is stopped."""
        from http.server import BaseHTTPRequestHandler, HTTPServer

        service = self

        class Handler(BaseHTTPRequestHandler):
            timeout = 5

            def _answer(self) -> None:
                status, kind, body = service.respond(self.command, self.path)
                raw = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(raw)))
                self.send_header("Connection", "close")
                self.end_headers()
                self.wfile.write(raw)

            do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = _answer

            def log_message(self, *args) -> None:
                pass

        HTTPServer(("127.0.0.1", port), Handler).serve_forever()


def rendered(status: int, kind: str, body: str) -> str:
    """A response as text."""
    reason = {200: "OK", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed"}[status]
    return f"HTTP/1.1 {status} {reason}\r\nContent-Type: {kind}\r\nContent-Length: {len(body.encode())}\r\nConnection: close\r\n\r\n{body}"
