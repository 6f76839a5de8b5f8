"""Problem 5: pages whose text is template residue, filler, an error message or a notice that scripts are required.

Method: the address slug, the title and the body terms are compared, and the site's own lines (host evidence, see wrappers) are set
aside. What is left is flagged in two ways, both for short texts that say nothing of what address or title name: if detectors for
placeholders, filler, errors and script notices find it, or if several addresses of the host say the same, in whatever words and language
(fewer addresses are enough where their status is a failure). This module holds the detectors and the verdict on one page; wrappers
counts what addresses say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = r"[a-z_][\w.\- ]{0,40}"

#: Unfilled fields of template languages.
PLACEHOLDER = re.compile(
    "|".join(
        (
            r"\{\{.{0,60}?\}\}", r"\{%.{0,60}?%\}", r"\{\$?" + _NAME + r"\}", r"\$\{[^}\n]{0,60}\}", r"#\{[^}\n]{0,60}\}", r"<%.{0,60}?%>", r"<!--#.{0,60}?-->", r"<\?.{0,60}?\?>",
            r"\[\[[^\]\n]{0,60}\]\]", r"@@" + _NAME + r"@@", r"__" + _NAME + r"__", r"%%?" + _NAME + r"%%?", r"\[(?:insert|your|enter|add)\b[^\]\n]{0,60}\]", r"\$[A-Z][A-Z_]{2,}\b", r"&lt;%.{0,60}?%&gt;",
        )
    ),
    re.I,
)

#: What failed programs print instead of a value.
_UNSET = re.compile(r"^\W*(?:undefined|null|none|nan|n/a|nil|tbd\b.{0,40}|todo\b.{0,40}|fixme\b.{0,40}|\[object \w+\]|array\(\d*\)|#(?:ref|name|value|n/a)[!?]?|\(?(?:\w+ ){0,3}(?:to follow|coming soon|goes here|placeholder)\)?)\W*$", re.I)

#: Words of the usual Latin filler (fixed values).
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum ante primis faucibus orci luctus ultrices posuere cubilia curae lectus "
    "viverra turpis porta purus erat semper risus quam mauris vitae morbi pellentesque habitant tristique senectus netus malesuada fames ac egestas fusce donec vivamus integer "
    "aenean phasellus praesent suspendisse nunc felis massa tellus justo augue arcu urna libero sapien metus odio ligula eget nec vel at a".split()
)

_FILLER = re.compile(
    r"\b(?:(?:your|sample|dummy|example|placeholder|some|add|insert|enter|type|write) (?:text|content|copy|title|paragraph|description|heading|headline|caption|subtitle)s?(?: (?:goes |is |in )?here)?|text goes here|"
    r"blindtext|platzhalter(?:text)?|hier (?:steht|kommt|folgt|können sie)\b.{0,40}\btext|ihr text|(?:votre|saisissez|insérez|ici votre) texte|texte (?:ici|d.exemple|factice)|"
    r"(?:su|tu|aquí va(?: su| el)?|inserte) texto|texto (?:aquí|de (?:ejemplo|prueba|relleno))|lorem ipsum|placeholder paragraph|replace (?:it|this) with your(?: own)?(?: words?| text)?|click here to edit(?: this text)?|edit this text)\b",
    re.I,
)

_WORDS = re.compile(r"[^\W\d_]+")

#: Notices that scripts are required. A notice about comments alone belongs to the comments.
_SCRIPT = re.compile(
    r"javascript|\bscripts?\b|noscript|\bskripte?\b|browser (?:is )?not supported|(?:enable|turn on|allow|activate) (?:cookies|scripts?)|cookies (?:must be|are) (?:on|enabled|required|disabled)|"
    r"(?:checking|verifying) your browser|(?:prove|verify|confirm) (?:that )?you are (?:a )?human",
    re.I,
)
_COMMENTS = re.compile(r"comment|kommentar|coment", re.I)

#: Error messages, at the start of a short line or as the whole of it.
_ERROR = re.compile(
    r"^\W*(?:http[ /]*)?(?:error|fehler|erreur)?\W*[345]\d\d\b(?!\s*(?:%|percent))(?=\W*$|\W+(?:not|page|error|forbidden|bad|internal|gateway|service|gone|unauthori[sz]ed|too|request|method|moved|found|proxy|this|that|seite|página|no|erreur|fehler|access|temporar)\b)|"
    r"\b(?:page|file|document|resource|url|site|address|content|account|article|seite|datei|página|recurso|page web)\b.{0,60}?(?:not (?:be )?found|(?:could|can) ?not be (?:found|displayed|loaded|reached)|no longer (?:exists|available)|does ?n.t exist|does not exist|has been (?:moved|removed|deleted|suspended)|was (?:not found|moved|removed|deleted)|is (?:gone|missing|unavailable)|nicht gefunden|existiert nicht|nicht (?:mehr )?(?:verfügbar|vorhanden)|introuvable|n.existe (?:pas|plus)|no (?:existe|encontrad[oa]|se (?:ha )?encontr)|no (?:está )?disponible)|"
    r"^\W*(?:not found|forbidden|unauthori[sz]ed|access (?:is )?denied|permission denied|bad (?:gateway|request)|gateway time-?out|service (?:temporarily )?unavailable|(?:internal )?server error|internal error|too many requests|request time-?out|connection (?:was )?(?:reset|refused|timed out)|zugriff verweigert|accès refusé|acceso denegado|page introuvable|seite nicht gefunden|error interno|interner (?:server)?fehler|erreur interne)\b|"
    r"\b(?:fatal|parse|syntax|runtime|database|uncaught|unhandled|server) (?:error|exception)\b|\berror (?:establishing|connecting|code|id|number|while|in)\b|^\W*(?:warning|notice|exception|traceback|error)\W+(?:undefined|uncaught|unhandled|invalid|unexpected|most recent)\b|"
    r"\bstack trace\b|^\W*at \w[\w.$]* ?\((?:line|[\w./]+:)? ?\d+|you don.t have permission|(?:something|etwas|algo|quelque chose) (?:went wrong|(?:ist )?schief|(?:ha )?(?:ido|salido) mal|s.est mal)|an error (?:has )?occurred|ein fehler (?:ist )?aufgetreten|fehler aufgetreten|une erreur (?:est survenue|s.est produite)|(?:se ha producido|ha ocurrido|ocurrió) un error|"
    r"^\W*the connection (?:was|has been|to)\b.{0,40}(?:reset|refused|timed? ?out|closed)|\b(?:was|were) not found on this server|nothing (?:matched|was found)|(?:please )?try again later|maintenance mode|under maintenance|wartungsarbeiten",
    re.I,
)

#: What goes with such a message and says nothing of itself.
_AROUND = re.compile(
    r"^\W*(?:error|request|reference|incident|trace|ray|event|session|support|transaction|fehler|código|code)[ -]*(?:code|id|no|number|nummer|nr)?\W*[\w.:-]*\d[\w.:-]*\W*$|^\W*(?:web ?server|apache|nginx|iis|server|proxy|php|version|openresty)\b.{0,40}\d|contact (?:the |your |our )?(?:site |system )?(?:administrator|support|webmaster|owner)|"
    r"^\W*(?:re)?load(?:ing)?(?: (?:the|this) page)?\W*$|^\W*loading\b|^\W*(?:retry|try again|learn how|learn more|go back|back|return)\b.{0,40}$|(?:back|return|go) to (?:the )?(?:home ?page|start|previous page|main page)|^\W*(?:zurück|retour|volver)\b.{0,40}$|check (?:the |your )?(?:address|url|spelling|connection)|refresh (?:the|this) page|if the problem persists|cookies must\b",
    re.I,
)

#: Of these a text in ASCII must have one for _AROUND to find anything, or one of the second with a digit.
_LEADS = ("contact ", "load", "try", "learn", "back", "return", "go to ", "retour", "volver", "check ", "refresh ", "problem", "cookies")
_NUMBERED = ("error", "request", "reference", "incident", "trace", "ray", "event", "session", "support", "transaction", "fehler", "code", "server", "apache", "nginx", "iis", "proxy", "php", "version", "openresty")
_DIGIT = re.compile("[0-9]")


def around(text: str) -> bool:
    """Whether _AROUND finds anything in a text."""
    if text.isascii():
        low = text.lower()
        if not any(x in low for x in _LEADS) and not (_DIGIT.search(low) and any(x in low for x in _NUMBERED)):
            return False
    return bool(_AROUND.search(text))


def placeholder_line(line: str) -> bool:
    """Whether a line is a template's fields and little else."""
    if _UNSET.match(line):
        return True
    if not marked_text(line) or not PLACEHOLDER.search(line):
        return False
    return len(_WORDS.findall(PLACEHOLDER.sub(" ", line))) <= 7


#: One text with a letter in it again and again, and nothing else.
_COPIES = re.compile(r"^(?=.*[^\W\d_])(\S.{1,80}?\S)(?:\W{0,3}\1)+\W*$")


def copies(line: str) -> bool:
    return len(line) <= 160 and line.find(line[:3], 3) > 0 and bool(_COPIES.match(line))


def filler_line(line: str) -> bool:
    """Whether a line is text that only fills space: the Latin filler, a phrase for it, or few words again and again."""
    words = [w.lower() for w in _WORDS.findall(line)]
    if len(words) < 2:
        return words[:1] in (["lorem"], ["ipsum"]) or bool(_FILLER.search(line))
    if len(words) >= 4 and sum(w in LATIN for w in words) >= 0.7 * len(words):
        return True
    if len(words) >= 3 and len(set(words)) <= 0.4 * len(words):
        return True
    rest = _FILLER.sub(" ", line)
    return rest != line and len(_WORDS.findall(rest)) <= 0.35 * len(words)


def error_line(line: str) -> bool:
    return len(line) <= 160 and bool(_ERROR.search(line))


def script_line(line: str) -> bool:
    return len(line) <= 160 and bool(_SCRIPT.search(line)) and not _COMMENTS.search(line)


def marked_text(line: str) -> bool:
    """Whether a text has a mark of which each placeholder has one."""
    return "_" in line or "[" in line or "{" in line or "<" in line or "%" in line or "$" in line or "#" in line or "@" in line


#: Words of which a line must have one for a detector to look at it: each alternative of the patterns above needs one of them, or one of
#: each of two of the sets below, or is seen by ``hinted`` itself.
HINTS = frozenset(
    "error errors fehler erreur exception forbidden unauthorized unauthorised denied permission gateway unavailable timeout timed reset refused requests request verweigert refusé denegado introuvable "
    "n'existe doesn't wrong schief mal occurred aufgetreten survenue produite producido ocurrido ocurrió warning traceback trace matched try maintenance wartungsarbeiten interno interner interne allowed "
    "javascript script scripts noscript skript skripte browser human blindtext platzhalter platzhaltertext lorem ipsum placeholder undefined null none nan n nil array tbd todo fixme follow soon replace cookies".split()
)
_GONE = frozenset(
    "found gefunden existiert verfügbar vorhanden existe encontrado encontrada encontró encontra disponible moved removed deleted suspended gone missing exist exists longer displayed loaded reached available".split()
)
_SUBJECT = frozenset("page file document resource url site address content account article seite datei página recurso not nothing pages files documents".split())
_FILLED = frozenset("text texts texto texte content contents copy title titles paragraph paragraphs description descriptions heading headings headline headlines caption captions subtitle subtitles words".split())
_FILLING = frozenset("your sample dummy example some add insert enter type write edit goes here su tu aquí inserte votre saisissez insérez ici ihr hier exemple d'exemple factice ejemplo prueba relleno own".split())

#: All words that the detectors look for in a line's words: a line is looked through once, and then what it has of these.
_TOLD = HINTS | _GONE | _SUBJECT | _FILLED | _FILLING | LATIN


def hinted(line: str, words) -> bool:
    """Whether a detector can find anything in a line of these words."""
    if not HINTS.isdisjoint(words) or not _GONE.isdisjoint(words) and not _SUBJECT.isdisjoint(words):
        return True
    if not _FILLED.isdisjoint(words) and not _FILLING.isdisjoint(words):
        return True
    return line[:1].isdigit() or line[:3] in ("at ", "At ") and "(" in line or marked_text(line)


_BLANKED = dict.fromkeys(map(ord, ".,;:!?()[]\"«»„“”…。、"), " ")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])")

#: Words of a sentence up to which it can be a message, and the part of a long line's words that messages make up where it is one.
MESSAGE_WORDS, MESSAGE_PART = 40, 0.8


def _any(line: str) -> bool:
    return placeholder_line(line) or filler_line(line) or bool(_ERROR.search(line)) or bool(_SCRIPT.search(line)) and not _COMMENTS.search(line)


def _sentences(line: str) -> Iterator[str]:
    at = 0
    for gap in _SENTENCE.finditer(line):
        yield line[at:gap.start()]
        at = gap.end()
    yield line[at:]


def long_message(line: str, total: int) -> bool:
    """Whether a long line of ``total`` words is sentences that the detectors find, or that go with such, and little else."""
    other = (1 - MESSAGE_PART) * total
    asked = []
    for part in _sentences(line):
        words = part.lower().translate(_BLANKED).split()
        if len(words) <= MESSAGE_WORDS and hinted(part, words):
            asked.append((part, len(words)))  # the detectors cost most and come last
        elif not around(part):
            other -= len(words)
            if other < 0:
                return False
    sure = False
    for part, words in asked:
        if _any(part):
            sure = True
        elif not around(part):
            other -= words
            if other < 0:
                return False
    return sure


def residue_line(line: str, tokens: tuple[str, ...] = ()) -> bool:
    """Whether any detector finds a line. ``tokens`` are its words in lower case, if the caller has them."""
    if len(line) > 160:
        words = tokens or line.lower().translate(_BLANKED).split()
        distinct = set(words)
        told = distinct & _TOLD
        repeated = len(distinct) <= 0.5 * len(words)
        if repeated and tokens:  # in which all numbers are one
            own = line.lower().translate(_BLANKED).split()
            repeated = len(set(own)) <= 0.5 * len(own)
        latin = len(LATIN & told)
        if latin and len(words) - len(distinct) + latin <= 0.3 * len(words):
            latin = 0  # each other word comes once at least
        if (repeated or latin and sum(map(LATIN.__contains__, words)) > 0.3 * len(words)) and filler_line(line):
            return True
        return hinted(line, told) and long_message(line, len(words))
    if copies(line):
        return True
    told = _TOLD.intersection(tokens)
    if tokens and not hinted(line, told):  # then only words again and again, or the Latin ones, can make it one
        return (2 * len(set(tokens)) <= len(tokens) or not LATIN.isdisjoint(told) and 3 * sum(map(LATIN.__contains__, tokens)) >= len(tokens)) and filler_line(line)
    return placeholder_line(line) or filler_line(line) or error_line(line) or script_line(line)


def around_line(line: str) -> bool:
    return len(line) <= 120 and around(line)


#: Words of its own that a page may hold beside residue and count as one without a body.
FREE_WORDS = 6


_DENSE = re.compile("[぀-鿿]")

#: Words of its own from which a text says something, whatever others say.
LOW_WORDS = 40


def informative(text: str, own: frozenset[str]) -> bool:
    """Whether a text is long, or says anything of what the address or title names."""
    words = _WORDS.findall(text.lower())
    dense = 0 if text.isascii() else len(_DENSE.findall(text)) // 2
    return len(words) + dense > LOW_WORDS or not own.isdisjoint(words)


def verdict(residue: list[str], rest: list[str], own: frozenset[str]) -> bool:
    """Whether a page is residue: ``residue`` its lines that the detectors found, ``rest`` those that neither they nor the site's
    wrapper explain, ``own`` the terms of its address and title.

    The rest of such a page is a few words; a sentence on what the address or title names is a body.
    """
    if not residue:
        return False
    words = 0
    for line in rest:
        if around_line(line):
            continue
        here = [w.lower() for w in _WORDS.findall(line)]
        if len(here) == 0 and sum(c.isalnum() for c in line) > 12:
            return False
        if own.intersection(here) and len(here) > 4:
            return False
        words += len([w for w in here if w not in own]) + sum("぀" <= c <= "鿿" for c in line) // 3
    return words <= FREE_WORDS
