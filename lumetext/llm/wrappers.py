"""Problem 6: the lines of a page's own body, without what the site puts around and into it.

Method: union-free regular-expression inference. A host's wrapper is a sequence of line patterns. The lines of each page are aligned
with it in order: an equal line stays literal, unequal tokens of a matching line become text slots, lines between two matches that only
some pages have are put in there as optional groups, and a line that comes again or elsewhere makes its pattern a repeated group.
Wrappers of some pages are aligned with each other in the same way, so no task sees a whole host. A line is the site's if the wrapper
has it at its place in the page, or anywhere if the group is repeated; wrappers that many hosts share also explain lines of hosts with
too few pages of their own. Problem 5's verdict on a page uses the same labels.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from operator import eq

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, cut, host_of, skew_safe_join
from .residue import HINTS, LOW_WORDS, PLACEHOLDER, informative, marked_text, placeholder_line, residue_line, verdict

#: A text slot, the page's own name and the site's name in a pattern.
SLOT, OWN, SITE = "\x00", "\x01", "\x02"

#: A text slot that has held the page's own name.
MIXED = "\x03"
_OPEN = frozenset((SLOT, MIXED))
_NAMES = frozenset((OWN, SITE))

#: Pages that are aligned into one wrapper before it is aligned with the others of its host, and the part of its pages that a pattern
#: takes to stay in it. A line of the final wrapper is on a larger part of the host's pages (SHARE), so it stays in one at least; where
#: a literal line does not stay it is counted by its hash, and its pages are added again.
ALIGNED_PAGES, KEPT_SHARE = 64, 1 / 16

#: Lost lines in one row.
LOST_ROWS = 20_000

#: Pages of a part of a hot host at least.
PART_PAGES = 512

#: Characters from which a line is only compared whole, without slots other than names and numbers.
LONG = 160

#: Tokens of a line that may have slots at most.
SLOTTED = 16

#: Share of a host's pages that a line of its wrapper is on at least, and the pages it takes.
SHARE, PAGES = 0.12, 3

#: Pages that a sentence takes: a paragraph may well stand on some pages of a host, a notice stands on many.
SENTENCE_PAGES = 8

#: The same for lines with the page's own name in them: headings have it too.
OWN_SHARE = 0.3

#: A line is shared furniture if it belongs to the wrappers of so many hosts, and of so large a part of the hosts that are large
#: enough to have one. A host's wrapper has MOST_LINES lines at most by its share, so the shared ones are at most MOST_LINES / HOST_SHARE.
HOSTS, HOST_SHARE, LARGE_HOST = 2, 0.003, 8

_TOKEN = re.compile(r"\d+(?:[.,:/'-]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[^\w\s]|_")
_DIGIT = re.compile(r"\d")
_NUMBERS = re.compile(r"\d+(?:[.,:/'-]\d+)*")
_BULLETS = " •*·-–—¿¡"
_SPLITS = frozenset("|·•/>›»")
_GAPS = re.compile(r"\s{2,}|\s+[|·•/>›»]\s+")
_END = ".?!。？！…"

#: What no wrapper has to show: notices, bylines, dates, advertisements and prompts by their words, for hosts with few pages. Only lines
#: without the page's own name are looked at.
_FURNITURE = re.compile(
    r"\bcookies?\b(?=.{0,400}\b(?:accept|agree|consent|continu|polic|settings|akzept|zustimm|einverstanden|verwend|nutz|accepte|utilis|politique|acept|utiliza|usa|política|experience|visit)|.{0,100}$)|©|\(c\) ?\d{4}|\b(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|privacy policy|datenschutz|mentions légales|aviso legal)\b|"
    r"^\W*(?:(?:written |posted )?by|ein beitrag von|von|un article de|par|un texto de|por)(?: [^\W\d_]+){2}(?:,? (?:staff writer|redaktion|pour|para|for)\b.*)?\W*$|"
    r"^\W*(?:published|posted|(?:last )?updated|veröffentlicht|stand|aktualisiert|publié|mis à jour|publicado|actualizado)\b[^.!?]{0,20}\d[^.!?]*(?:\d\W*|ago.*|read|días|jours|tagen)$|"
    r"^\W*(?:ad|advertisement|sponsored(?: content| links?)?|anzeige|werbung|publicité|publicidad|contenu sponsorisé|contenido patrocinado)\W*$|"
    r"^\W*(?:share (?:this|on)\b|diesen beitrag teilen|teilen per|partager\b|compartir\b|subscribe\b|sign up for\b|newsletter\b|abonnez|suscríbase\b|log in to\b|\d+ (?:comments?|kommentare?|commentaires?|comentarios?|shares|partages)\W*$)|"
    r"^\W*(?:tags|schlagwörter|mots-clés|etiquetas|related|read also|see also|lesen sie auch|à lire aussi|lea también)\s*[:：]|^\W*(?:skip to content|back to top|zum inhalt springen|nach oben|aller au contenu|haut de page|saltar al contenido|volver arriba)\W*$",
    re.I,
)
#: Words with which such a line begins, or of which it has one.
_FIRST = frozenset(
    "written posted by ein von un par por published last updated veröffentlicht stand aktualisiert publié mis publicado actualizado ad advertisement sponsored anzeige werbung publicité publicidad "
    "contenu contenido share diesen teilen partager compartir subscribe sign newsletter abonnez suscríbase log 0 tags schlagwörter mots etiquetas related read see lesen à lea skip back zum nach "
    "aller haut saltar volver".split()
)
_ANY = frozenset("cookie cookies © (c) rights rechte droits derechos privacy datenschutz légales legal".split())
_BLANKS = ".,;:!?()[]\"'«»„“”‘’…。、"
#: Of ASCII alone: letters in lower case, such marks as blanks, digits as 0.
_ASCII = bytes(ord(" " if chr(b) in _BLANKS else "0" if chr(b).isdigit() else chr(b).lower()) if b < 128 else b for b in range(256))
_NUMBER = re.compile("[0-9]+")
_MARKS = frozenset(":>›»/|：→")


def own_terms(url: str | None, title: str | None, site: frozenset[str]) -> frozenset[str]:
    """The terms that name a page: the last segment of its address and its title without the site's name."""
    own: set[str] = set()
    if url:
        slug = _path(url).rsplit("/", 1)[-1]
        base, dot, kind = slug.rpartition(".")
        if dot and kind.isalnum() and len(kind) <= 5:
            slug = base
        own.update((slug.lower(),) if slug.isalpha() else [w.lower() for w in _LETTERS.findall(slug)])
    if title and not (marked_text(title) and PLACEHOLDER.search(title)):
        words = [w.lower() for w in _LETTERS.findall(_PARTS.split(title, 1)[0])]
        if len(words) <= 3:
            own.update(words)
    return frozenset(w for w in own - site - HINTS if len(w) >= 5)  # a title may be an error's


_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r" [-|–—·»:] ")


def _path(url: str) -> str:
    """An address without scheme, host, query, fragment and last slashes."""
    at = url.find("//")
    at = url.find("/", at + 2 if at >= 0 else 0)
    return "" if at < 0 else url[at:].split("?", 1)[0].split("#", 1)[0].rstrip("/")


def page_name(url: str | None, text: str | None) -> str | int:
    """What is the same for a page that was fetched twice: its path, or its text where it has none."""
    return _path(url or "") or hash(text)


def site_terms(host: str | None) -> frozenset[str]:
    return frozenset(w for w in re.findall(r"[^\W\d_]+", host or "") if len(w) >= 4 and w not in ("example", "test", "invalid", "blog", "docs", "www", "com", "org", "net"))


def tokens_of(line: str) -> tuple[str, ...]:
    """A line's tokens in lower case, without the marks around it; every number is 0. A line of a sentence's length that ends with a
    sentence's mark has a dot at its end, whatever the mark."""
    if len(line) > LONG:  # parted at white space and edges alone: long lines are only compared whole
        if line.isascii():
            text = line.encode().translate(_ASCII).decode()
            while "00" in text:
                text = text.replace("00", "0")
        else:  # then a table is slower than looking for each mark
            text = line.lower()
            for mark in _BLANKS:
                if mark in text:
                    text = text.replace(mark, " ")
            if _DIGIT.search(text):
                text = _NUMBER.sub("0", text)
        return (*text.split(), ".")
    low = line.lower().lstrip(_BULLETS)
    numbers = _DIGIT.search(low)
    text = _NUMBERS.sub(" 0 ", low) if numbers else low
    rest = text.replace(" ", "").replace(",", "").replace(".", "").replace(":", "")
    if (rest.replace("0", "") if numbers else rest).isalpha():  # only words, numbers and these marks
        found = text.replace(",", " , ").replace(".", " . ").replace(":", " : ").split()
    else:
        found = _TOKEN.findall(low)
        if numbers:
            found = ["0" if t[0].isdigit() else t for t in found]
    a, b = 0, len(found)
    while a < b and not found[a][0].isalnum():
        a += 1
    while b > a and not found[b - 1][0].isalnum():
        b -= 1
    ended = b - a >= 5 and b < len(found) and found[b] in _END
    return (*found[a:b], ".") if ended else tuple(found[a:b])


def masked(tokens: tuple[str, ...], own: frozenset[str], site: frozenset[str], both: frozenset[str] | None = None) -> tuple[str, ...]:
    """Tokens with marks in place of the page's own terms and the site's; ``both`` are all of them, if the caller has them."""
    if own.isdisjoint(tokens) and site.isdisjoint(tokens) if both is None else both.isdisjoint(tokens):
        return tokens
    return tuple([OWN if t in own else SITE if t in site else t for t in tokens])


def sentence(tokens: tuple[str, ...]) -> bool:
    """Whether a line reads as a sentence: then only an exact repetition is furniture, never a pattern with slots."""
    return len(tokens) > 24 or len(tokens) >= 6 and tokens[-1] == "." and sum(t.isalpha() or t in (OWN, SITE) for t in tokens) >= 5


def bare(tokens: tuple[str, ...]) -> tuple[str, ...]:
    """Without the dot of a sentence: furniture has one or not."""
    return tokens[:-1] if tokens[-1] == "." else tokens


def in_order(places: list[float]) -> list[bool]:
    """For each of a sequence whether it is in a longest ascending part of it."""
    if all(a < b for a, b in zip(places, places[1:])):
        return [True] * len(places)
    tails: list[float] = []
    last: list[int] = []
    back: list[int] = []
    for k, p in enumerate(places):
        j = bisect_left(tails, p)
        tails[j:j + 1] = [p]
        last[j:j + 1] = [k]
        back.append(last[j - 1] if j else -1)
    out = [False] * len(places)
    k = last[-1]
    while k >= 0:
        out[k] = True
        k = back[k]
    return out


def pattern_hash(pattern: tuple[str, ...]) -> int:
    h = xxhash.xxh64_intdigest(_PATTERN.join(pattern).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Wrapper:
    """A sequence of line patterns: the number of pages that have each, its place between 0 and 1, and whether it is a repeated group,
    which comes again on a page or out of order."""

    def __init__(self) -> None:
        self.patterns: list[tuple[str, ...]] = []
        self.pages: list[int] = []
        self.place: list[float] = []
        self.free: list[bool] = []
        self.exact: dict[tuple[str, ...], int] = {}
        self.near: dict[tuple, dict[tuple, list[int]]] = {}
        self.lines: dict[str, tuple[tuple[str, ...], int]] = {}  # tokens and item of the lines that align_page has met without a page's own name
        self.total = 0

    @cached_property
    def heads(self) -> set[tuple[str, ...]]:
        """Of all patterns, as any can be a long line's; of a wrapper that is complete."""
        return {bare(p)[:4] for p in self.patterns}

    def find(self, tokens: tuple[str, ...], fresh: bool = True) -> int | None:
        """The item that a line matches; with ``fresh``, unequal tokens of the item become slots. A sentence makes no slots, but may
        fill those that other lines made."""
        key = bare(tokens)
        i = self.exact.get(key)
        if i is not None or len(tokens) > SLOTTED or fresh and sentence(tokens):
            return i
        return self.resembling(key, fresh)

    def resembling(self, tokens: tuple[str, ...], fresh: bool) -> int | None:
        """The item that a line without its dot, which is equal to none, matches by slots."""
        n = len(tokens)
        held = [x for x in (self.near.get((n, 0, tokens[0])), self.near.get((n, 1, tokens[-1]))) if x is not None]
        if not held:
            return None
        kinds = _marks(tokens)
        words = None
        for items in held:
            for i in items.get(kinds, ()):
                if words is None:
                    marks = n - kinds.count("")
                    least = max(n - 4, (n + marks - 1) // 2, marks + 1)  # equal tokens that unify asks for at least
                    words = {t for t in tokens if t[0].isalpha() or t == SITE}  # one of them must be equal where anything differs
                pattern = self.patterns[i]
                if words.isdisjoint(pattern) and pattern != tokens:
                    continue
                merged = unify(pattern, tokens) if sum(map(eq, pattern, tokens)) >= least else None
                if merged is not None:
                    if fresh and merged != pattern:
                        self.patterns[i] = merged
                        self._index(i)
                    if fresh:
                        self.exact[tokens] = i
                    return i
        return None

    def _index(self, i: int) -> None:
        """Finds the item by its first or its last token and its marks."""
        pattern = self.patterns[i]
        kinds = _marks(pattern)
        for end in ((len(pattern), 0, pattern[0]), (len(pattern), 1, pattern[-1])):
            held = self.near.setdefault(end, {}).setdefault(kinds, [])
            if i not in held:
                held.append(i)

    def add(self, tokens: tuple[str, ...], place: float = 0.0, pages: int = 0, free: bool = False) -> int:
        i = len(self.patterns)
        key, read = bare(tokens), sentence(tokens)
        self.patterns.append(tokens if read else key)
        self.pages.append(pages)
        self.place.append(place)
        self.free.append(free)
        self.exact[key] = i
        if not read and len(key) <= SLOTTED:
            self._index(i)
        return i

    def align(self, lines: list[tuple[str, ...]], pages: list[int] | None = None, free: list[bool] | None = None, total: int = 1) -> None:
        """Takes in one page, or the patterns of another wrapper with their numbers of pages.

        Items that were there before are matched in order along a longest ascending chain; what matches outside it, or again, is a
        repeated group. What matches nothing is put in between its neighbours in the chain.
        """
        old = len(self.patterns)
        found = []
        for tokens in lines:
            i = self.find(tokens)
            found.append(self.add(tokens) if i is None else i)
        self._take(found, old, pages, free, total)

    def align_page(self, lines: list[str], tokens: Tokens, own: frozenset[str], site: frozenset[str]) -> None:
        """align for the lines of a page of one host, whose site's terms are always the same. A line that comes again without the page's
        own name has the item that it had before, as an equal line always stays with its item."""
        old = len(self.patterns)
        found = []
        for line in lines:
            if not line:
                continue
            met = self.lines.get(line)
            if met is not None and own.isdisjoint(met[0]):
                found.append(met[1])
                continue
            t = tokens(line)
            if t:
                named = masked(t, own, site)
                i = self.find(named)
                if i is None:
                    i = self.add(named)
                found.append(i)
                if met is None and own.isdisjoint(t):
                    self.lines[line] = (t, i)
        self._take(found, old, None, None, 1)

    def _take(self, found: list[int], old: int, pages: list[int] | None, free: list[bool] | None, total: int) -> None:
        """Counts and places the items of lines in order; those from ``old`` on are new."""
        self.total += total
        known = [k for k, i in enumerate(found) if i < old]
        chain = [k for k, yes in zip(known, in_order([self.place[found[k]] for k in known]), strict=True) if yes]
        linked = set(chain)
        seen: set[int] = set()
        aside = len(linked) < len(known)
        for k, i in enumerate(found):
            again = i in seen
            if again or aside and i < old and k not in linked or free is not None and free[k]:
                self.free[i] = True
            if pages is not None:
                self.pages[i] += pages[k]
            elif not again:
                self.pages[i] += 1
            seen.add(i)
        if len(self.patterns) > old:
            before, at = 0.0, 0
            for k in [*chain, len(found)]:
                after = self.place[found[k]] if k < len(found) else 1.0
                new = [i for i in dict.fromkeys(found[at:k]) if i >= old and not self.place[i]]
                for n, i in enumerate(new, 1):
                    self.place[i] = before + (after - before) * n / (len(new) + 1)
                before, at = after, k + 1

    def merge(self, other: Wrapper) -> None:
        order = sorted(range(len(other.patterns)), key=other.place.__getitem__)
        self.align([other.patterns[i] for i in order], [other.pages[i] for i in order], [other.free[i] for i in order], other.total)
        self.pages = [min(n, self.total) for n in self.pages]  # two patterns of the other may have become one

    def kept(self, counted: bool = True) -> tuple[Wrapper, list[int]]:
        """The wrapper of the patterns that enough of its pages have, or that have slots, and if they are to be counted the hash of each
        other one, as often as it has pages."""
        out, lost = Wrapper(), []
        out.total = self.total
        for p, at, n, f in zip(self.patterns, self.place, self.pages, self.free, strict=True):
            if n >= self.total * KEPT_SHARE or n > 1 and not _OPEN.isdisjoint(p):
                out.add(p, at, n, f)
            elif counted:
                lost += [pattern_hash(p)] * n
        return out, lost


def _marks(tokens: tuple[str, ...]) -> tuple[str, ...]:
    """What is no word, at its place: lines that could be unified agree in it, and in the first or the last token."""
    if "".join(tokens).isalpha():
        return ("",) * len(tokens)
    return tuple([t if not t[0].isalpha() and t not in _OPEN and t not in _NAMES else "" for t in tokens])


def unify(pattern: tuple[str, ...], tokens: tuple[str, ...]) -> tuple[str, ...] | None:
    """The pattern with slots where the tokens differ, or None if they have too little in common.

    Half the words that stay literal must be there, and one at least; the own name is no literal. Punctuation must agree.
    """
    same = slots = marks = 0
    new = False  # whether a slot is to be made or marked
    for a, b in zip(pattern, tokens, strict=True):
        if a == b:
            if a[0].isalpha() or a == SITE:
                same += 1
            elif a not in _OPEN and a != OWN and not a[0].isalnum():
                marks += 1
        elif (b[0].isalpha() or b in _NAMES or b in _OPEN) and (a[0].isalpha() or a in _OPEN or a in _NAMES):
            slots += 1
            new = new or a not in _OPEN or b == OWN or b == MIXED
        else:
            return None
    if not slots:
        return pattern
    if same == 0 or slots > same + (2 if marks else 1) or slots > 4:
        return None
    return pattern if not new else tuple([a if a == b else MIXED if OWN in (a, b) or MIXED in (a, b) else SLOT for a, b in zip(pattern, tokens, strict=True)])


def page_lines(text: str) -> list[str]:
    """Lines from 1 on, without their carriage returns and outer white space."""
    return [line.strip() for line in text.split("\n")]


class Tokens:
    """tokens_of, and whether the detectors find a line, with a memory for short lines: most of a site's lines come again, and many of
    other sites'."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}
        self.found: dict[str, bool] = {}

    def __call__(self, line: str) -> tuple[str, ...]:
        t = self.known.get(line)
        if t is None:
            t = tokens_of(line)
            if len(line) <= LONG:
                if len(self.known) > 50_000:
                    self.known.clear()
                    self.found.clear()
                self.known[line] = t
        return t

    def residue(self, line: str) -> bool:
        found = self.found.get(line)
        if found is None:
            found = residue_line(line, self(line))
            if len(line) <= LONG:
                self.found[line] = found
        return found


def menu_line(line: str) -> bool:
    """Whether a line is four items or more of one or two words without a number, parted by marks or wide gaps."""
    if line.isprintable() and "  " not in line and _SPLITS.isdisjoint(line):  # then its only white space is single blanks
        return False
    items = _GAPS.split(line.strip())
    return len(items) >= 4 and all(0 < len(x.split()) <= 2 and x[0].isalpha() and not any(c.isdigit() for c in x) for x in items)


_LINKED = frozenset(("body", "site"))

#: Lines of a page from which a rule of thumb takes short ones on end for a list of links.
LINKS = 3


class Labels:
    """The labels of one host's lines, from its wrapper and the shared one."""

    def __init__(self, own: Wrapper, shared: Wrapper, tokens: Tokens) -> None:
        self.own, self.shared, self.tokens = own, shared, tokens
        self.known: dict[str, tuple[str, int | None]] = {}

    def plain(self, line: str, names: frozenset[str], site: frozenset[str]) -> tuple[str, int | None]:
        """A line's label, wherever it stands, and the item of the host's wrapper that it matches."""
        t = self.tokens(line)
        if len(line) > LONG:
            head = masked(t[:4] if len(t) > 4 else bare(t), names, site)
            if head not in self.own.heads and head not in self.shared.heads:
                # No pattern begins like it, so none is equal; it is judged by its words alone.
                return ("residue" if residue_line(line, t) else "site" if self.notice(line, t, names) else "body"), None
            return self.label(line, masked(t, names, site))
        if names.isdisjoint(t):
            found = self.known.get(line)
            if found is None:
                found = self.known[line] = self.label(line, masked(t, frozenset(), site, site))
            return found
        return self.label(line, masked(t, names, site))

    @staticmethod
    def notice(line: str, tokens: tuple[str, ...], names: frozenset[str] = frozenset()) -> bool:
        """Whether a line is a notice, byline or prompt by its words; for hosts whose wrapper does not show it."""
        if tokens[0] not in _FIRST and _ANY.isdisjoint(tokens) or OWN in tokens or not names.isdisjoint(tokens):
            return False
        return bool(_FURNITURE.search(line))

    def label(self, line: str, tokens: tuple[str, ...]) -> tuple[str, int | None]:
        """site for a line of the wrapper, residue for what the detectors find, notice for what is both, else body. A message that
        many of a host's pages have in place of a body is in its wrapper too."""
        if len(tokens) <= 8 and not (tokens and (tokens[0][0].isalnum() or tokens[0] == SITE)):  # else the first is a word, not the own name
            words = [t for t in tokens if t[0].isalnum() or t == OWN or t == SITE]
            if not words:
                return "site", None
            if words.count(OWN) == len(words):
                return "body", None  # a heading that is only the name
        key = bare(tokens)
        mine = self.own.exact.get(key)
        exact = mine is not None or key in self.shared.exact
        if self.tokens.residue(line):
            return ("notice", mine) if exact else ("residue", None)
        if exact:
            return "site", mine
        if len(tokens) <= SLOTTED:
            mine = self.own.resembling(key, False)
            if mine is not None or self.shared.resembling(key, False) is not None:
                return "site", mine
        return ("site" if self.worded(line, tokens) else "body"), None

    def worded(self, line: str, tokens: tuple[str, ...]) -> bool:
        """Whether a line that no wrapper has is furniture by its words."""
        return len(tokens) <= 24 and (self.menu(tokens) or OWN not in tokens and menu_line(line)) or self.notice(line, tokens)

    def menu(self, tokens: tuple[str, ...]) -> bool:
        """Whether a line is only words that are lines of menus and side lists alone (and the own name behind them)."""
        words = 0
        for t in tokens:
            if t[0].isalnum() or t == SITE:
                if (t,) not in self.own.exact and (t,) not in self.shared.exact:
                    return False
                words += 1
        return words > 1

    def placed(self, lines: list[str], found: list[tuple[str, int | None]], names: frozenset[str], site: frozenset[str]) -> list[str]:
        """The labels of a page's lines, after its lines are aligned with the wrapper: a line that has an item's words but stands where
        the item never does, or comes again where the item never did, is not the site's on that account."""
        labels = [x for x, _ in found]
        own = [k for k, (x, i) in enumerate(found) if i is not None and not self.own.free[i]]
        for k, yes in zip(own, in_order([self.own.place[found[k][1]] for k in own]), strict=True):
            if not yes:
                tokens = masked(self.tokens(lines[k]), names, site)
                if self.shared.find(tokens, False) is None and not self.worded(lines[k], tokens):
                    labels[k] = "residue" if labels[k] == "notice" else "body"
        return labels

    def listed(self, run: list[int], lines: list[str], site: frozenset[str]) -> bool:
        """Whether short lines on end are a list of links: wrappers have one of them, or they come behind a line that leads to links."""
        known = (self.own.exact, self.shared.exact)
        return any(bare(masked(self.tokens(lines[k]), frozenset(), site)) in w for k in run for w in known)

    def residue(self, lines: list[str], names: frozenset[str], site: frozenset[str]) -> tuple[bool, int | None, int]:
        """The first part of ``page``. A long line of the body is a body, so such lines are looked at first."""
        for line in lines:
            if len(line) > LONG and self.plain(line, names, site)[0] == "body" and informative(line, names):
                return False, None, 0
        bad, _, mark, seen = self.page(lines, names, site)
        return bad, mark, seen

    def page(self, lines: list[str], names: frozenset[str], site: frozenset[str]) -> tuple[bool, list[int], int | None, int]:
        """Whether the page is residue, the numbers of its body lines, and for a page that says little, and nothing of what its address
        and title name, a hash of what it says and the pages of the host that say it in the wrapper (0 if it is not there)."""
        found = [self.plain(line, names, site) if line else ("", None) for line in lines]
        labels = self.placed(lines, found, names, site)
        # Three short lines or more on end, none of them with the own name, are a list of links; headings stand alone.
        run: list[int] = []
        for i, line in enumerate([*lines, "." * 99]):
            if not line:
                continue
            if len(line) <= 32 and labels[i] in _LINKED and line.count(" ") < 2 and line[-1] not in _END and line[0].isalpha() and names.isdisjoint(self.tokens(line)):
                run.append(i)
            elif run:
                if len(run) >= LINKS and self.listed(run, lines, site):
                    for k in run:
                        labels[k] = "site"
                run = []
        residue = [line for line, x in zip(lines, labels, strict=True) if x in ("residue", "notice")]
        rest = [line for line, x in zip(lines, labels, strict=True) if x == "body"]
        if verdict(residue, rest, names):
            return True, [], None, 0
        mark, seen = self.message(lines, found, rest, residue, names, site)
        return False, [i + 1 for i, x in enumerate(labels) if x == "body" or x == "residue" and not placeholder_line(lines[i])], mark, seen

    def message(self, lines: list[str], found: list[tuple[str, int | None]], rest: list[str], residue: list[str], names: frozenset[str], site: frozenset[str]) -> tuple[int | None, int]:
        """The last two of ``page``: of a page with a rest the rest, of one without the line of the wrapper that the fewest pages have."""
        if not names:
            return None, 0
        if rest or residue:
            if sum(line.count(" ") for line in rest) > 2 * LOW_WORDS or informative(" ".join(rest), names):
                return None, 0
            return pattern_hash(tuple(t for line in [*rest, *residue] for t in (*self.tokens(line), "\n"))), 0
        long = lambda p: sum(len(t) * (2 if t[0] >= "\u3040" else 1) for t in p if t.isalpha()) >= 16  # noqa: E731  (more than a menu's word)
        said = [i for line, (x, i) in zip(lines, found, strict=True) if x == "site" and i is not None and long(self.own.patterns[i])]
        if not said:
            return None, 0
        i = min(said, key=lambda i: (self.own.pages[i], self.own.place[i]))
        return pattern_hash(self.own.patterns[i]), self.own.pages[i]


_PATTERN = "\x1f"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, one after the other."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_PARTIAL = "host string, salt int, total long, patterns array<string>, pages array<long>, places array<double>, free array<boolean>, lost array<long>"


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each (host, salt) of pages that come sorted by both and by key, and the lines that did not stay in one, which
    need counting wherever a host's pages are in more than one wrapper."""
    tokens = Tokens()
    block, whole, group, last, site = Wrapper(), Wrapper(), None, None, frozenset()
    names: set = set()
    lost: list[int] = []
    out: list[tuple] = []

    def rows_of(w: Wrapper) -> tuple:
        return [_PATTERN.join(p) for p in w.patterns], w.pages, w.place, w.free

    def close(end: bool) -> None:
        """Aligns the block with the wrapper of its group."""
        nonlocal block, whole
        if block.total:
            kept, gone = block.kept(not end or whole.total > 0 or group[2])  # else all pages of the host are in this one wrapper
            whole.merge(kept)
            lost.extend(gone)
        block = Wrapper()
        if end and group is not None:
            if whole.total:
                out.append((group[0], group[1], whole.total, *rows_of(whole), None))
            if whole.total <= ALIGNED_PAGES and not group[2]:
                lost.clear()
            whole = Wrapper()
        while len(lost) >= LOST_ROWS or end and lost:
            out.append((group[0], group[1], None, None, None, None, None, lost[:LOST_ROWS]))
            del lost[:LOST_ROWS]

    def made() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
        cols = zip(*out, strict=True) if out else ((),) * len(kinds)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _PARTIAL.split(", ")])
        out.clear()
        return batch

    for host, salt, salts, key, url, title, text in _rows(batches):
        new = group is None or (host, salt) != group[:2]
        if new or block.total >= ALIGNED_PAGES:
            close(new)
            names = set()
            if len(out) > 200:
                yield made()
            if new:
                group, last, site = (host, salt, salts is not None), None, site_terms(host)
        if key == last:
            continue
        last = key
        # A page that was fetched again would make its body look like furniture; its copies count once in a block.
        name = page_name(url, text)
        if text and name not in names:
            names.add(name)
            block.align_page(page_lines(text), tokens, own_terms(url, title, site), site)
    close(True)
    yield made()


_MERGED = "host string, of long, pattern string, pages long, place double, free boolean, hash long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host, of the wrappers of its salts, which come sorted by host and salt and are 2 * HOT at most."""
    out: list[tuple] = []
    whole, of = Wrapper(), None

    def made() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
        cols = zip(*out, strict=True) if out else ((),) * len(kinds)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _MERGED.split(", ")])
        out.clear()
        return batch

    def close() -> None:
        if of is not None:
            out.append((of, whole.total, "", whole.total, 0.0, False, None))
            out.extend((of, whole.total, _PATTERN.join(p), n, at, f, pattern_hash(p) if _OPEN.isdisjoint(p) else None) for p, n, at, f in zip(whole.patterns, whole.pages, whole.place, whole.free, strict=True))

    for host, _, total, patterns, pages, places, free in _rows(batches):
        if host != of:
            close()
            whole, of = Wrapper(), host
            if len(out) > 20_000:
                yield made()
        one = Wrapper()
        one.total = total
        for p, n, at, f in zip(patterns, pages, places, free, strict=True):
            one.add(tuple(p.split(_PATTERN)), at, n, f)
        whole.merge(one) if whole.total else None
        whole = whole if whole.total else one
    close()
    yield made()


_SHARED: dict[int, Wrapper] = {}


def _shared_wrapper(broadcast) -> Wrapper:
    """The shared patterns, parsed once in a worker process, which Spark uses for task after task."""
    key = hash(tuple(broadcast.value))
    if key not in _SHARED:
        _SHARED.clear()
        w = _SHARED[key] = Wrapper()
        for p in broadcast.value:
            w.add(tuple(p.split(_PATTERN)), free=True)
    return _SHARED[key]


def _label(shared_patterns, lines_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _shared_wrapper(shared_patterns)
        tokens = Tokens()
        group, last, site = None, None, frozenset()
        labels = Labels(Wrapper(), shared, tokens)
        for batch in batches:
            keys, out = [], []
            for host, salt, patterns, key, tag, url, title, status, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, salt) != group:
                    group, last, site = (host, salt), None, site_terms(host)
                    wrapper = Wrapper()
                    for at, p, n, free in sorted(tuple(x.values()) for x in patterns or ()):
                        wrapper.add(tuple(p.split(_PATTERN)), at, n, free)
                    labels = Labels(wrapper, shared, tokens)
                if patterns is not None or key == last:
                    continue
                last = key
                names, parts = own_terms(url, title, site), page_lines(text)
                body = None
                if lines_too:
                    bad, body, mark, seen = labels.page(parts, names, site)
                else:
                    bad, mark, seen = labels.residue(parts, names, site)
                where = None if mark is None else pattern_hash((str(page_name(url, text)),))
                keys.append(key)
                out.append((host, tag, bad, mark, seen, where, bool(status and status >= 400), body))
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
            cols = zip(*out, strict=True) if out else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("_k").type), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["_k", "host", "tag", "residue", "mark", "seen", "place", "failed", "lines"])

    return run


#: Patterns that all hosts share at most, see HOSTS: a check, not a cut, as more than this are an error.
MOST_SHARED = 250_000


#: Addresses that must give the same message before it counts as residue without a detector; half of them failed: the fewer.
REPEATS, FAILED_REPEATS = 3, 2

#: Part of the pages with a line of the wrapper that must have nothing else, for the line to be a message in place of a body.
ALONE = 0.8


def page_labels(tables: list[DataFrame], key: str = "page_id", url: str = "url", title: str = "title", text: str = "text", status: str = "status", lines: bool = True) -> DataFrame:
    """(key, tag, residue, lines) for each page with a text: the number of its table, whether it is residue (problem 5), and the
    numbers from 1 of its body's lines (problem 6; none if it is residue), or null with ``lines`` off.

    Rows of one key count once. Pages whose text is null or empty, or whose key is null, give no row. A page without a url belongs
    to no host: only what the hosts share is known of it. Titles may be null; a table without a status column has none.

    Pages are shuffled by host to be aligned and again, together with their host's wrapper, to be labelled. A host with over a
    HOT-th of all pages is salted into parts of half that size; which hosts those are is broadcast (HOT at most). The parts' wrappers
    are aligned with each other. The driver gets the shared patterns, whose number the thresholds bound. The labels are stored: pages
    that say the same on several addresses of a host are counted over all of them.
    """
    pages = None
    for i, t in enumerate(tables):
        state = F.col(status).cast("int") if status in t.columns else F.lit(None).cast("int")
        own = t.select(F.col(key).alias("_k"), F.lit(i).alias("tag"), F.col(url).alias("_url"), F.col(title).alias("_title"), state.alias("_status"), F.col(text).alias("_text"))
        pages = own if pages is None else pages.unionByName(own)
    pages = pages.filter(F.col("_k").isNotNull() & (F.length("_text") > 0)).withColumn("host", F.coalesce(host_of(F.col("_url")), F.lit("")))

    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).scalar()
    hot = cut(counts.filter(F.col("n") * HOT >= total).select("host", F.ceil(F.col("n") / F.greatest(total / (2 * HOT), F.lit(PART_PAGES))).cast("int").alias("salts")))
    salted = pages.join(F.broadcast(hot), "host", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_k"), F.col("salts"))).cast("int"))

    spread = salted.select("host", "salt", "salts", "_k", "_url", "_title", "_text").repartition("host", "salt").sortWithinPartitions("host", "salt", "_k")
    partial = cut(spread.mapInArrow(_infer, _PARTIAL))
    parts = partial.filter(F.col("total").isNotNull()).drop("lost").repartition("host").sortWithinPartitions("host", "salt")
    lost = partial.select("host", F.explode("lost").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("more"))
    merged = parts.mapInArrow(_merge, _MERGED).join(lost, ["host", "hash"], "left")
    items = cut(merged.select("host", "of", "pattern", F.least(F.col("of"), F.col("pages") + F.coalesce("more", F.lit(0))).alias("pages"), "place", "free"))

    sep = _PATTERN
    own_name = F.col("pattern").contains(OWN) & ~F.col("pattern").contains(MIXED)
    marked = F.col("pattern").rlike(f"(^|{sep})[:>›»/|：→]({sep}|$)")
    named = own_name & ~F.col("pattern").startswith(OWN) & marked & (F.col("pages") >= OWN_SHARE * F.col("of"))
    least = F.when(F.col("pattern").endswith(f"{sep}."), SENTENCE_PAGES).otherwise(PAGES)
    plain = ~own_name & (F.col("pages") >= least) & (F.col("pages") >= SHARE * F.col("of")) & F.col("pattern").rlike(f"(^|{sep})\\p{{L}}") & (marked | ~F.col("pattern").contains(MIXED))
    wrappers = items.filter((F.col("pattern") != "") & (F.col("pages") >= PAGES) & (F.col("host") != "")).filter(named | plain)

    large = items.filter((F.col("pattern") == "") & (F.col("of") >= LARGE_HOST) & (F.col("host") != "")).count()
    common = wrappers.filter(F.col("of") >= LARGE_HOST).groupBy("pattern").agg(F.count(F.lit(1)).alias("hosts")).filter(F.col("hosts") >= max(HOSTS, HOST_SHARE * large))
    shared = sorted(r.pattern for r in common.select("pattern").limit(MOST_SHARED + 1).collect())
    if len(shared) > MOST_SHARED:
        raise ValueError(f"over {MOST_SHARED} shared line patterns")

    kind = "array<struct<place:double,pattern:string,pages:long,free:boolean>>"
    own = wrappers.groupBy("host").agg(F.collect_list(F.struct("place", "pattern", "pages", "free")).alias("patterns")).join(F.broadcast(hot), "host", "left")
    heads = own.select("host", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)).alias("salt"), "patterns")
    both = salted.select("host", "salt", F.lit(None).cast(kind).alias("patterns"), "_k", "tag", "_url", "_title", "_status", "_text").unionByName(heads, allowMissingColumns=True)
    sorted_rows = both.repartition("host", "salt").sortWithinPartitions("host", "salt", F.asc_nulls_first("_k"))
    key_kind = pages.schema["_k"].dataType.simpleString()
    made = f"_k {key_kind}, host string, tag int, residue boolean, mark long, seen long, place long, failed boolean, lines array<int>"
    labels = cut(sorted_rows.mapInArrow(_label(salted.sparkSession.sparkContext.broadcast(shared), lines), made))

    # What several addresses say, each of them nothing of what it names, is a message in place of a body. A line of a host's wrapper is
    # counted over the host, anything else over all hosts. A message that a third of all pages give is summed before it moves.
    scope = F.when(F.col("seen") > 0, F.col("host")).otherwise("").alias("scope")
    asked = labels.filter(F.col("mark").isNotNull() & (F.col("host") != "")).withColumn("scope", scope)
    said = asked.groupBy("scope", "mark", "host", "place").agg(F.max("failed").alias("failed"), F.max("seen").alias("seen"))
    said = said.groupBy("scope", "mark").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("f"), F.max("seen").alias("seen"))
    needed = F.when(2 * F.col("f") >= F.col("n"), FAILED_REPEATS).otherwise(REPEATS)
    often = said.filter((F.col("n") >= needed) & (F.col("n") >= ALONE * F.col("seen"))).select("scope", "mark", F.col("n").alias("_often"))
    marked_pages = asked.agg(F.count(F.lit(1)).alias("t")).scalar()
    left = skew_safe_join(asked, often.withColumnRenamed("_often", "_weight"), ["scope", "mark"], "_weight", marked_pages)
    bad = left.select("_k", F.lit(True).alias("_often"))
    found = asked.join(bad, "_k", "left").withColumn("residue", F.coalesce("_often", F.lit(False)))
    done = labels.filter(F.col("mark").isNull() | (F.col("host") == "")).select("_k", "tag", "residue", "lines")
    empty = F.array().cast("array<int>")
    judged = found.select("_k", "tag", "residue", F.when(F.col("residue") & F.col("lines").isNotNull(), empty).otherwise(F.col("lines")).alias("lines"))
    return done.unionByName(judged).withColumnRenamed("_k", key)


def residue_pages(pages: DataFrame, **columns) -> DataFrame:
    """Problem 5: keys of the pages that are residue."""
    return page_labels([pages], lines=False, **columns).filter("residue").select(columns.get("key", "page_id"))


def body_lines(tables: list[DataFrame], **columns) -> DataFrame:
    """Problem 6: (key, line_no) of the lines of the main bodies."""
    return page_labels(tables, **columns).select(columns.get("key", "page_id"), F.explode("lines").alias("line_no"))
