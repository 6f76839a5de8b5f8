"""Addresses, HTML and robots rules: plain Python for the crawl and for Arrow batches, native columns where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PORTS = {"http": 80, "https": 443}


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str
    port: int
    path: str
    query: str = ""

    def __str__(self) -> str:
        port = "" if self.port == PORTS[self.scheme] else f":{self.port}"
        return f"{self.scheme}://{self.host}{port}{self.path}" + (f"?{self.query}" if self.query else "")


def _ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def clean_path(path: str) -> str:
    """Without empty and dot segments; a last slash stays."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    return "/" + "/".join(kept) + ("/" if kept and path.endswith("/") else "")


_URL = re.compile(r"(?s)(.*?)://([^/?#:]+)(?::([0-9]+))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?")


def parse_url(text: str) -> Url | None:
    """The parts of an http or https address, lower-cased, without fragment and default port; None for anything else."""
    m = _URL.fullmatch(text)
    if not m:
        return None
    scheme = _ascii_lower(m[1])
    port = int(m[3] or PORTS.get(scheme, 0))
    if scheme not in PORTS or port > 65535:
        return None
    return Url(scheme, _ascii_lower(m[2]), port, clean_path(m[4] or ""), m[5] or "")


def resolve_url(base: Url, reference: str) -> Url | None:
    """The address that a link of a page means. A reference with :// anywhere is taken as absolute, and one that is only a query
    belongs to the page's directory; other schemes and fragments give None."""
    ref = reference.strip(" \t\r\n")
    if not ref or ref.startswith("#"):
        return None
    if "://" in ref:
        return parse_url(ref)
    if ref.startswith("//"):
        return parse_url(f"{base.scheme}:{ref}")
    if ":" in ref.split("/", 1)[0]:
        return None
    root = str(replace(base, path="", query=""))
    return parse_url(root + ref if ref.startswith("/") else root + base.path[: base.path.rfind("/") + 1] + ref)


def canonical_column(url: Column) -> Column:
    """canonical text of an address as a native expression; null where parse_url gives None."""
    pattern = r"(?s)^(.*?)://([^/?#:]+)(?::([0-9]+))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    scheme = F.lower(part(1))
    port = F.when(part(3) == "", "").otherwise(F.regexp_replace(part(3), "^0+(?=[0-9])", ""))
    known = F.when((scheme == "http") & (port == "80") | (scheme == "https") & (port == "443"), "").otherwise(port)
    segments = F.filter(F.split(part(4), "/"), lambda s: ~s.isin("", "."))
    cleaned = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    path = F.transform(F.array(cleaned), lambda a: F.concat(F.lit("/"), F.array_join(a, "/"), F.when((F.size(a) > 0) & F.endswith(part(4), F.lit("/")), "/").otherwise("")))[0]
    whole = F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when(known == "", "").otherwise(F.concat(F.lit(":"), known)), path, F.when(part(5) == "", "").otherwise(F.concat(F.lit("?"), part(5))))
    valid = url.rlike(pattern) & scheme.isin("http", "https") & ((port == "") | (F.length(port) <= 5) & (F.try_to_number(port, F.lit("99999")) <= 65535))
    return F.when(valid, whole)


def host_column(url: Column) -> Column:
    """Host of a valid address in lower case, without port."""
    return F.regexp_extract(canonical_column(url), r"^https?://([^/:]+)", 1)


# HTML

_BLOCKS = frozenset("p div br li ul ol tr td th h1 h2 h3 h4 h5 h6 section article header footer nav aside table blockquote pre hr body title".split())
_MARKUP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style).*?(?:</\1[^>]*(?:>|\Z)|\Z)|<(/?)([a-z0-9]*)([^>]*)>|<(?=[^>]*\Z)")
_HREF = re.compile(r"""(?is)(?<![a-z0-9])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*))""")
_ENTITY = re.compile(r"&([^;&]{0,11});")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _entity(m: re.Match) -> str:
    name = m[1]
    if name in _NAMED:
        return _NAMED[name]
    number = re.fullmatch(r"#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))", name)
    if not number:
        return m[0]
    code = int(number[1], 16) if number[1] else int(number[2])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def decode_entities(text: str) -> str:
    """The five named entities, the hard space and numbers; anything else stays."""
    return _ENTITY.sub(_entity, text)


def collapse(text: str) -> str:
    return " ".join(re.split(r"[ \t\n\r\x0b\f]+", text)).strip(" ")


@dataclass
class Page:
    title: str
    text: str
    links: list[str]


def parse_html(html: str) -> Page:
    """Title, text (with the title's) and link targets in order. Comments, scripts and styles are left out; block tags part words."""
    text: list[str] = []
    title: list[str] = []
    links: list[str] = []
    inside = False
    at = 0
    for m in _MARKUP.finditer(html):
        run = html[at : m.start()]
        text.append(run)
        if inside:
            title.append(run)
        at = m.end()
        if m[1]:
            text.append(" ")
        elif m[3] is not None:
            name = m[3].lower()
            if name == "title":
                inside = not m[2]
            elif name == "a" and not m[2]:
                href = _HREF.search(m[4])
                target = decode_entities(next(x for x in href.groups() if x is not None)) if href else ""
                if target:
                    links.append(target)
            if name in _BLOCKS:
                text.append("\n")
        elif m[0] == "<":  # a tag that never ends hides the rest
            at = len(html)
            break
    text.append(html[at:])
    if inside:
        title.append(html[at:])
    return Page(collapse(decode_entities("".join(title))), collapse(decode_entities("".join(text))), links)


def parsed_html(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with title, text and links of each page; a null page gives nulls."""
    keep = [c for c in pages.columns if c != html] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if h is None else parse_html(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array([p and p.title for p in done], pa.string()), pa.array([p and p.text for p in done], pa.string()), pa.array([p and p.links for p in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], "title", "text", "links"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema)
    return pages.select(*keep, html).mapInArrow(run, f"{fields}title string, text string, links array<string>")


def resolved_links(pages: DataFrame, url: str = "url", links: str = "links") -> DataFrame:
    """(src, dst): canonical addresses of each page and of what it links to, duplicates and self-links included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for u, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = parse_url(u) if u else None
                for ref in (found or ()) if base else ():
                    target = resolve_url(base, ref) if ref else None
                    if target:
                        src.append(str(base))
                        dst.append(str(target))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], names=["src", "dst"])

    return pages.select(url, links).mapInArrow(run, "src string, dst string")


# Strings of the front ends


def url_decode(text: str) -> str:
    """+ is a blank, %XX a byte; a broken escape stays."""
    raw = re.sub(rb"\+|%([0-9A-Fa-f]{2})", lambda m: b" " if m[0] == b"+" else bytes([int(m[1], 16)]), text.encode())
    return raw.decode("utf-8", "replace")


def url_encode(text: str) -> str:
    return "".join(chr(b) if chr(b).isalnum() and b < 128 or b in b"-_.~" else "+" if b == 32 else f"%{b:02X}" for b in text.encode())


def url_decode_column(text: Column) -> Column:
    return F.try_url_decode(text)


def html_escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def collapse_column(text: Column) -> Column:
    """Runs of blank, tab, line feed, return, form feed and backspace become one blank, outer ones go."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x08]+", " "))


# Robots rules


@dataclass(frozen=True)
class Robots:
    rules: tuple[tuple[str, bool], ...] = ()
    delay_ms: int | None = None

    def allows(self, path: str) -> bool:
        """The longest matching pattern decides, allow before disallow; without one everything is allowed."""
        found = [(len(p), allow) for p, allow in self.rules if p and _pattern(p).match(path)]
        return max(found)[1] if found else True

    def wait(self, floor_ms: int) -> int:
        return floor_ms if self.delay_ms is None else max(self.delay_ms, floor_ms)


@lru_cache(maxsize=10_000)
def _pattern(pattern: str) -> re.Pattern:
    end = pattern.endswith("$")
    parts = (pattern[:-1] if end else pattern).split("*")
    return re.compile("(?s)" + ".*".join(map(re.escape, parts)) + (r"\Z" if end else ""))


def parse_robots(text: str, agent: str) -> Robots:
    """The rules of the groups whose agent begins the given one's name, else those for *. Groups of one agent add up."""
    name = _ascii_lower(agent)
    rules: dict[bool, list[tuple[str, bool]]] = {True: [], False: []}
    delays: dict[bool, int | None] = {True: None, False: None}
    agents: list[str] = []
    group: list[tuple[str, bool]] = []
    delay: int | None = None
    ruled = False

    def close() -> None:
        nonlocal delay
        for a in agents:
            kind = False if a == "*" else True if name.startswith(a) else None
            if kind is not None:
                rules[kind] += group
                delays[kind] = delays[kind] if delay is None else delay
        delay = None

    for line in text.split("\n"):
        field, colon, value = line.split("#", 1)[0].strip(" \t\r\x0b\f").partition(":")
        field, value = _ascii_lower(field.strip()), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if ruled:
                close()
                agents, group, ruled = [], [], False
            agents.append(_ascii_lower(value))
        elif field == "crawl-delay":
            ruled = True
            number = re.match(r"[+]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", value)
            delay = int(float(number[0]) * 1000) if number else delay
        elif field in ("allow", "disallow"):
            ruled = True
            if value or field == "allow":
                group.append((value, field == "allow"))
    close()
    named = bool(rules[True]) or delays[True] is not None
    return Robots(tuple(rules[named]), delays[named])
