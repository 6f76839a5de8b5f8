"""Problem 4: text that looks the same in different characters, brought to one form.

Method: compatibility normalization, deletion of ignorable characters, then for every token the lattice of all letters that look like
its own is searched with Viterbi for the path of the best character bigrams of one script. The bigrams are counted over the whole
collection, in tokens that their own letters prove to be of one script.

What looks the same: letters that the common fonts draw with one and the same shape, in the scripts listed below; full-width and other
compatibility forms, ligatures, any kind of space, hyphens of one width, apostrophes of one curve; ignorable characters. What can be seen
and is left out: superscripts, circled and other set-apart forms, fractions, letters that differ by a dot or a stroke (a dotless i), dashes
of another length, straight quotes against curly ones, digits against letters (0 and O, 1 and l), and look-alikes of rarer scripts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from .common import cut, one_per

#: Letters that look like a Latin one, by script (fixed values; those that fonts draw alike).
LOOKALIKE = {
    "cyrillic": {
        "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "у",
        "A": "А", "B": "В", "C": "С", "E": "Е", "G": "Ԍ", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "Q": "Ԛ", "S": "Ѕ", "T": "Т", "V": "Ѵ", "W": "Ԝ", "X": "Х", "Y": "Ү",
    },
    "greek": {
        "a": "α", "i": "ι", "o": "ο", "p": "ρ", "u": "υ", "v": "ν", "y": "γ",
        "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ",
    },
    "armenian": {"h": "հ", "n": "ո", "o": "օ", "q": "զ", "u": "ս", "S": "Տ", "L": "Լ", "U": "Ս", "O": "Օ"},
    "cherokee": {"A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Z": "Ꮓ"},
    "coptic": {"c": "ⲥ", "o": "ⲟ", "p": "ⲣ", "C": "Ⲥ", "O": "Ⲟ", "P": "Ⲣ"},
    "lisu": {
        "A": "ꓮ", "B": "ꓐ", "C": "ꓚ", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "ꓧ", "I": "ꓲ", "J": "ꓙ", "K": "ꓗ", "L": "ꓡ", "M": "ꓟ", "N": "ꓠ", "O": "ꓳ", "P": "ꓑ", "R": "ꓣ", "S": "ꓢ",
        "T": "ꓔ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "ꓫ", "Y": "ꓬ", "Z": "ꓜ",
    },
    "phonetic": {"a": "ɑ", "g": "ɡ"},
}

#: Marks of one shape: hyphens of the common hyphen's width, the apostrophe letter (fixed values).
MARKS = (("‐", "-"), ("ʼ", "’"))

#: Compatibility forms that can be told from the plain character, by the tag of their decomposition.
SET_APART = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>", "<small>")

#: Log-odds against a change of script inside a token, so that a path of one script wins wherever there is one.
SWITCH = 12.0

#: Parts of a form's records, so that the copies of one form lie in many tasks.
SALTS = 8

#: Tokens whose form a worker keeps.
KEPT = 200_000

_CLASS = {}
for _script, _pairs in LOOKALIKE.items():
    for _latin, _other in _pairs.items():
        _CLASS[_other] = _latin
        _CLASS[_latin] = _latin
_MEMBERS: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _c, _latin in _CLASS.items():
    _MEMBERS[_latin].append(("latin" if _c == _latin else next(s for s, p in LOOKALIKE.items() if p.get(_latin) == _c), _c))
for _v in _MEMBERS.values():
    _v.sort()

_OTHERS = {c: script for script in ("cherokee", "coptic", "lisu", "phonetic") for c in LOOKALIKE[script].values()}

_IGNORED = re.compile(
    "[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\ufff0-\\ufffb"
    "\\U0001bca0-\\U0001bca3\\U0001d173-\\U0001d17a\\U000e0000-\\U000e0fff]+"
)
_KEPT_APART = frozenset(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.decomposition(c).startswith(SET_APART))
_APART = re.compile("([" + "".join(sorted(_KEPT_APART)) + "]+)")
_RUN = re.compile(r"([^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*)")


def script_of(c: str) -> str:
    """Script of a letter, as far as the look-alikes need it."""
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "latin"
    if 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
        return "greek"
    if 0x400 <= n < 0x530:
        return "cyrillic"
    if 0x530 <= n < 0x590:
        return "armenian"
    return _OTHERS.get(c, "other")


def _compatible(text: str) -> str:
    """Compatibility decomposition of all but what is set apart."""
    if _KEPT_APART.isdisjoint(text):
        return unicodedata.normalize("NFKD", text)
    parts = _APART.split(text)
    parts[::2] = [unicodedata.normalize("NFKD", x) for x in parts[::2]]
    return "".join(parts)


def plain_form(text: str) -> str:
    """Compatibility form, decomposed, without ignorable characters; any run of white space is one space or one line feed."""
    if text.isascii():
        form = text
    else:
        form = _IGNORED.sub("", _compatible(_IGNORED.sub("", text)))
        for mark, plain in MARKS:
            if mark in form:
                form = form.replace(mark, plain)
    if "\r" in form:
        form = form.replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join([" ".join(line.split()) for line in form.split("\n")]).strip()


def _symbol(c: str) -> str:
    """A letter in the bigram model: itself if it has look-alikes, else its script. So the model is at most some hundred symbols."""
    return c if c in _CLASS else script_of(c)


def count_bigrams(tokens: dict[str, int], counts: Counter) -> None:
    """Adds the bigrams of the tokens that hold a letter of their own script alone, and no letter of another."""
    for token, n in tokens.items():
        letters = [c for c in token if not "\u0300" <= c <= "\u036f"]
        scripts = {script_of(c) for c in letters}
        if len(scripts) == 1 and any(c not in _CLASS for c in letters):
            before = "^"
            for c in letters:
                s = _symbol(c)
                counts[before + "\t" + s] += n
                before = s


class Forms:
    """The one form of texts under a bigram model."""

    def __init__(self, counts: dict[str, int]) -> None:
        totals: Counter = Counter()
        symbols = set()
        for pair, n in counts.items():
            a, b = pair.split("\t")
            totals[a] += n
            symbols.add(b)
        self.size = len(symbols) + 1
        self.totals = totals
        self.score = {tuple(pair.split("\t")): math.log((n + 0.5) / (totals[pair.split("\t")[0]] + 0.5 * self.size)) for pair, n in counts.items()}
        # Of the letters that look alike those that some token proves to be in use, and the Latin one: the same for all that are written.
        self.members = {latin: [(script, c) for script, c in held if c == latin or c in symbols] for latin, held in _MEMBERS.items()}
        self.seen: set[str] = set()
        self.changed: dict[str, str] = {}  # of the tokens seen those whose form is another

    def step(self, a: str, b: str) -> float:
        s = self.score.get((a, b))
        if s is None:
            s = self.score[a, b] = math.log(0.5 / (self.totals[a] + 0.5 * self.size))
        return s

    def token(self, token: str) -> str:
        """The best path through the token's lattice. It hangs only on which look-alikes there are, not on which were written; ties
        go to the first script by name. Marks stay with their letters."""
        paths: list[tuple[float, str, str, str]] = [(0.0, "^", "", "")]  # score, last symbol, script, text
        score = self.score
        for c in token:
            if "\u0300" <= c <= "\u036f":
                paths = [(s, a, script, t + c) for s, a, script, t in paths]
                continue
            if c in _CLASS:
                choices = self.members[_CLASS[c]]
            else:
                script = script_of(c)
                choices = ((script, c),)
            new = []
            for script, letter in choices:
                b = letter if letter in _CLASS else script
                best, chosen = -math.inf, ""
                for s, a, before, t in paths:
                    value = score.get((a, b))
                    value = s + (self.step(a, b) if value is None else value) - (SWITCH if before and before != script else 0.0)
                    if value > best:
                        best, chosen = value, t
                new.append((best, b, script, chosen + letter))
            paths = new
        return max(paths, key=lambda p: p[0])[3]

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        form = plain_form(text)
        tokens = set(_RUN.findall(form))
        if not tokens <= self.seen:
            if len(self.seen) > KEPT:
                self.seen.clear()
                self.changed.clear()
            for t in tokens - self.seen:
                best = self.token(t)
                if best != t:
                    self.changed[t] = best
                self.seen.add(t)
        if not self.changed.keys().isdisjoint(tokens):
            parts = _RUN.split(form)
            parts[1::2] = [self.changed.get(t, t) for t in parts[1::2]]
            form = "".join(parts)
        return form if form.isascii() else unicodedata.normalize("NFC", form)


_FORMS: dict[frozenset, Forms] = {}


def _forms_of(model: dict[str, int]) -> Forms:
    """One for each model in a worker process, which Spark uses for task after task."""
    name = frozenset(model.items())
    if name not in _FORMS:
        _FORMS.clear()
        _FORMS[name] = Forms(model)
    return _FORMS[name]


def bigram_counts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, n) over all rows. Each task counts in memory: the pairs are bounded by the square of the model's symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        tokens: Counter = Counter()
        for batch in batches:
            for column in batch.columns:
                for text in column.to_pylist():
                    if text:
                        tokens.update(_RUN.findall(text if text.isascii() else plain_form(text)))
                if len(tokens) > KEPT:
                    count_bigrams(tokens, counts)
                    tokens.clear()
        count_bigrams(tokens, counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

    return docs.select(*columns).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def one_form(docs: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The kept columns and, for each of ``columns``, its one form under the same name; null stays null.

    Two texts get equal forms exactly if they look the same: equal after compatibility normalization, without ignorable characters,
    with any white space as one blank or line feed, and letter by letter equal or look-alike. Case, accents, punctuation and words
    stay as they are. The driver gets the bigram model, whose size the alphabet bounds whatever the collection.
    """
    model = {r.pair: r.n for r in bigram_counts(docs, columns).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _forms_of(model)
        for batch in batches:
            done = [pa.array([forms.text(t) for t in c.to_pylist()], pa.string()) for c in batch.columns[len(keep) :]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *done], names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep, *columns).schema)
    return docs.select(*keep, *columns).mapInArrow(run, schema)


def lookalike_classes(docs: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body", latest: str = "imported_at") -> DataFrame:
    """(key, class_a, class_b, stored): each distinct record with a body once, two hashes of its one form and one of its stored form.
    A null title counts as empty; null and empty bodies and null keys give no row. The hashes are stored: forms are made once."""
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(title), F.lit("")).alias("_title"), F.col(body).alias("_body"), F.col(latest).alias("_at"))
    own = one_per(spread(rows), "_k", "_at").filter(F.length("_body") > 0)
    own = own.select("_k", F.xxhash64("_title", "_body").alias("stored"), "_title", "_body")
    forms = one_form(own, ["_title", "_body"], ["_k", "stored"])
    return cut(forms.select(F.col("_k").alias(key), F.xxhash64("_title", "_body").alias("class_a"), F.xxhash64(F.lit(7), "_body", "_title").alias("class_b"), "stored"))


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of records that look the same and differ in a stored character, the smaller key first.

    Only classes with two stored forms or more are looked at. First their forms meet, once for each pair of forms of a class, then each
    pair of forms meets the records of both: every row of a join is one of the result or half of one, never a pair that is dropped, and
    the records of a class of many copies are spread by form and by SALTS.
    """
    rows = lookalike_classes(docs, key, **columns)
    same = ["class_a", "class_b"]
    mixed = rows.groupBy(*same).agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter(F.col("lo") != F.col("hi"))
    few = cut(rows.join(mixed.select(*same), same, "left_semi"))
    forms = few.select(*same, "stored").distinct()
    meet = forms.withColumnRenamed("stored", "_sa").join(forms.withColumnRenamed("stored", "_sb"), same).filter(F.col("_sa") < F.col("_sb"))
    salts = meet.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = few.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    left = salts.join(salted.withColumnRenamed("stored", "_sa"), [*same, "_sa", "_salt"]).select(*same, "_sb", F.col(key).alias("_one"))
    pairs = left.join(few.withColumnRenamed("stored", "_sb"), [*same, "_sb"]).select("_one", F.col(key).alias("_other"))
    return pairs.select(F.least("_one", "_other").alias("doc_id_a"), F.greatest("_one", "_other").alias("doc_id_b"))
