import random
from collections import Counter, defaultdict

import pytest

from lumetext.llm import common, lookalikes, residue, splitting, tokens, wrappers

# Problem 4

SPOILT = [
    ("Path of the river", "Pаth оf thе rіvеr"), ("Path of the river", "Ｐａｔｈ　ｏｆ ｔｈｅ ｒｉｖｅｒ"), ("café crème", "café crème"), ("find a ﬁle", "find a file"), ("soft hyphen", "so­ft hy​phen﻿"),
    ("no break", "no break"), ("Ένα", "Ένα"), ("НОС", "HOC"), ("line\nbreak", "line \r\nbreak "),
]
DIFFERENT = [("Path", "path"), ("café", "cafe"), ("end.", "end!"), ("red boat", "red boot"), ("ab", "a b"), ("1l", "ll"), ("O0", "OO"), ("10 m²", "10 m2"), ("①", "1"), ("½", "1⁄2"), ("info", "ınfo"), ("a-b", "a–b"), ("it's", "it’s")]


@pytest.fixture(scope="module")
def forms():
    counts = Counter()
    lookalikes.count_bigrams(Counter("the river path of nothing boat crème файл дорога мир Привет нос λόγος ένα θάλασσα".split()), counts)
    return lookalikes.Forms(counts)


@pytest.mark.parametrize("a, b", SPOILT)
def test_same_looks_have_one_form(forms, a, b):
    assert forms.text(a) == forms.text(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_what_can_be_seen_stays(forms, a, b):
    assert forms.text(a) != forms.text(b)


def test_forms_are_stable_and_prefer_one_script(forms):
    assert forms.text("rіvеr") == "river" and forms.text("дорога") == "дорога" and forms.text("дopoгa") == "дорога"
    for a, b in SPOILT:
        assert forms.text(forms.text(b)) == forms.text(b)
    assert forms.text(None) is None and forms.text("") == "" and forms.text("​") == ""
    rng = random.Random(1)
    for _ in range(300):
        token = "".join(rng.choice("aceopxyABCEHKMOPTXжλqu") for _ in range(rng.randint(1, 8)))
        other = "".join(rng.choice([m for _, m in lookalikes._MEMBERS[lookalikes._CLASS[c]]]) if c in lookalikes._CLASS else c for c in token)
        assert forms.token(token) == forms.token(other)


def test_copies_of_two_forms_meet_once_each(spark):
    """A class of many copies: as many rows as pairs, and no copy of a form with another of the same."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(f"a{i}", "T", "same river", at) for i in range(60)] + [(f"b{i}", "T", "same rivеr", at) for i in range(40)] + [(f"c{i}", "T", "ѕame river", at) for i in range(3)]
    got = [tuple(r) for r in lookalikes.lookalike_pairs(spark.createDataFrame(rows, "doc_id string, title string, body string, imported_at timestamp")).collect()]
    assert len(got) == len(set(got)) == 60 * 40 + 100 * 3 and all(a < b and a[0] != b[0] for a, b in got)


def test_pairs_equal_brute_force(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    texts = [x for pair in SPOILT for x in pair] + [x for pair in DIFFERENT for x in pair]
    rows = [(f"d{i}", "T" if i % 2 else None, t) for i, t in enumerate(texts)] + [("e1", "", "same"), ("e2", None, "same"), ("e3", "Т", "same​"), ("e4", "T", "same"), ("e5", "T", None), ("e6", "T", ""), (None, "T", "same")]
    rows += [rows[0]]
    df = spark.createDataFrame([(*r, at, "x", 5) for r in rows], "doc_id string, title string, body string, imported_at timestamp, class_a string, _k int")
    got = sorted(map(tuple, lookalikes.lookalike_pairs(df).collect()))
    counts = Counter()
    lookalikes.count_bigrams(Counter(t for r in rows for x in r[1:] if x for t in lookalikes._RUN.findall(lookalikes.plain_form(x))), counts)
    f = lookalikes.Forms(counts)
    distinct = {r[0]: (r[1] or "", r[2]) for r in rows if r[0] and r[2]}
    want = sorted((a, b) for a in distinct for b in distinct if a.encode() < b.encode() and distinct[a] != distinct[b] and [f.text(x) for x in distinct[a]] == [f.text(x) for x in distinct[b]])
    assert got == want and ("e3", "e4") in got and ("e1", "e2") not in got
    assert lookalikes.lookalike_pairs(df.limit(0)).count() == 0


# Problems 5 and 6


@pytest.mark.parametrize(
    "line",
    [
        "{{ page_title }}", "Posted by ${author.name}", "Dear [[user]],", "Welcome to <%= site %>, your source for <%= x %>", "__body__", "%headline%", "@@title@@", "undefined", "[object Object]", "Lorem ipsum dolor sit amet, consectetur.",
        "asdf asdf asdf qwer qwer", "Your text goes here.", "404 Not Found", "Error code 1020", "502 Bad Gateway", "Page not found", "Die angeforderte Seite wurde nicht gefunden.", "Cette page est introuvable.", "La página solicitada no existe.",
        "Please enable JavaScript to continue.", "You need to enable scripts to run this app.", "TODO: write this section", "Access denied", "Blindtext Blindtext Blindtext",
    ],
)
def test_residue_lines(line):
    assert residue.residue_line(line) and residue.residue_line(line, wrappers.tokens_of(line))


@pytest.mark.parametrize("line", ["The proof sheet still showed lorem ipsum in one column when the border was named.", "Please enable JavaScript to view the comments.", "In 1984 the catalogue was closed.", "The harbour lies between two hills.", "About 404 people lived on fish here."])
def test_lines_of_a_body(line):
    assert not residue.residue_line(line)


def site_pages():
    rng = random.Random(6)
    words = "harbour hill lantern river glacier bridge archive schema signal ledger".split()
    rows, body, bad = [], set(), set()
    for i in range(40):
        name = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) + "n"
        said = [f"{name.capitalize()} was {rng.choice(words)} number {rng.randint(1, 999)} of the {rng.choice(words)} {rng.choice('abcdefgh') * 3}, and {' '.join(rng.choice(words) for _ in range(rng.randint(12, 30)))}." for _ in range(3)]
        lines = ["Skip to content", "Home | Shop | Maps | Help", f"Home > Shop > {name.capitalize()}", f"By {rng.choice('ABCD')}en {rng.choice('XYZ')}aro", *said, f"Share this page ({rng.randint(0, 99)} times)", "Rivers", "Hills", "Boats", "Copyright 2020 Testsite"]
        if i % 8 == 0:
            lines = [*lines[:3], "404 Not Found", f"Request id: {i}-77", *lines[-4:]]
            bad.add(i)
        else:
            body |= {(i, n) for n in (5, 6, 7)}
        rows.append((i, f"https://testsite.example/p/{name}.html", f"{name.capitalize()} - Testsite", "\r\n".join(lines)))
    return rows, body, bad


def test_wrappers_leave_the_bodies(spark):
    rows, body, bad = site_pages()
    more = [(100, None, None, None), (101, "http://x.test", "", ""), (102, None, "T", "One sentence of a page without an address, long enough to be one."), (None, "http://x.test/", "t", "no key"), rows[3], (103, "http://lone.test/a", None, "{{ title }}\n{{ body }}")]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows + more], "page_id long, url string, title string, text string, lines string, tag string")
    got = {(r.page_id, r.line_no) for r in wrappers.body_lines([df]).collect()}
    assert got == body | {(102, 1)}
    assert {r.page_id for r in wrappers.residue_pages(df).collect()} == bad | {103}
    two = wrappers.body_lines([df.filter("page_id < 20"), df.filter("page_id >= 20")]).collect()
    assert {(r.page_id, r.line_no) for r in two} == got
    assert wrappers.body_lines([df.limit(0)]).count() == 0 and wrappers.residue_pages(df.limit(0)).count() == 0


def items_of(w):
    return {p: (n, f) for p, n, f in zip(w.patterns, w.pages, w.free)}


def test_union_free_alignment():
    w = wrappers.Wrapper()
    pages = [["menu", "by ann smith", "one body", "footer", "footer"], ["menu", "ad", "by bob jones", "other words here", "footer"], ["menu", "by cid moss", "footer"]]
    for lines in pages:
        w.align([wrappers.tokens_of(x) for x in lines])
    items = items_of(w)
    assert items[("menu",)] == (3, False) and items[("footer",)] == (3, True) and items[("ad",)] == (1, False)
    assert items[("by", wrappers.SLOT, wrappers.SLOT)] == (3, False)
    place = dict(zip(w.patterns, w.place))
    # What only some pages have lies between its neighbours.
    assert place[("menu",)] < place[("ad",)] < place[("by", wrappers.SLOT, wrappers.SLOT)] < place[("one", "body")] < place[("footer",)]
    assert wrappers.unify(("a", "b"), ("c", "d")) is None and wrappers.unify(("tags", ":", "x"), ("tags", ":", "y")) == ("tags", ":", wrappers.SLOT)
    assert wrappers.unify(("what", "is", wrappers.OWN), ("what", "is", "it")) == ("what", "is", wrappers.MIXED)


def test_order_decides_where_a_group_is_not_repeated():
    assert wrappers.in_order([1, 5, 2, 3, 3, 9]) == [True, False, True, False, True, True] and wrappers.in_order([]) == []
    w = wrappers.Wrapper()
    for _ in range(4):
        w.align([wrappers.tokens_of(x) for x in ("the top menu here", "about this fine place", "bottom line of all pages")])
    labels = wrappers.Labels(w, wrappers.Wrapper(), wrappers.Tokens())
    none = frozenset()
    assert labels.page(["the top menu here", "Some words of the body stand here.", "about this fine place", "bottom line of all pages"], none, none)[1] == [2]
    # The first line stands where the wrapper never has it, and the last one comes again where it never did.
    assert labels.page(["bottom line of all pages", "the top menu here", "about this fine place", "bottom line of all pages"], none, none)[1] == [1]
    for _ in range(2):
        w.align([wrappers.tokens_of(x) for x in ("bottom line of all pages", "the top menu here", "bottom line of all pages")])
    assert wrappers.Labels(w, wrappers.Wrapper(), wrappers.Tokens()).page(["bottom line of all pages", "the top menu here", "about this fine place", "bottom line of all pages"], none, none)[1] == []


def test_wrappers_of_parts_are_aligned():
    """Parts merge by alignment: slots of one unite with those of the other, order stays, pages add up."""
    a, b = wrappers.Wrapper(), wrappers.Wrapper()
    for x in ("ann lee", "bob lee"):
        a.align([wrappers.tokens_of(y) for y in ("menu", f"by {x} today", "footer")])
    for x in ("cid moss", "dan moss"):
        b.align([wrappers.tokens_of(y) for y in ("menu", "extra", f"by {x} today", "footer")])
    a.merge(b)
    items = items_of(a)
    assert items[("by", wrappers.SLOT, wrappers.SLOT, "today")] == (4, False) and items[("menu",)] == (4, False) and items[("extra",)] == (2, False) and a.total == 4
    place = dict(zip(a.patterns, a.place))
    assert place[("menu",)] < place[("extra",)] < place[("by", wrappers.SLOT, wrappers.SLOT, "today")] < place[("footer",)]


def test_lost_lines_are_counted(spark, monkeypatch):
    """A line on an eighth of a host's pages, unevenly spread over its blocks, has all its pages."""
    monkeypatch.setattr(wrappers, "ALIGNED_PAGES", 32)
    got = []
    monkeypatch.setattr(wrappers, "cut", lambda df: got.append(df) or common.cut(df))
    rows = [(i, f"http://h.example/p/{i}", None, f"Menu\nOwn words number {i} and {'abcdefgh'[i % 8] * 3} {'xyz'[i % 3] * 4} here\n" + ("A rare notice of this site\n" if i < 28 or i in (40, 80, 110, 111) else "") + "Foot") for i in range(128)]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, text string")
    wrappers.page_labels([df]).count()
    items = next(x for x in got if "free" in x.columns and "place" in x.columns and "pattern" in x.columns)
    counts = {r.pattern.replace(wrappers._PATTERN, " "): r.pages for r in items.collect()}
    assert counts["a rare notice of this site"] == 32 and counts["menu"] == 128 and counts["foot"] == 128


MESSAGES = {
    "it": "Pagina non trovata. La risorsa richiesta non esiste piu su questo sito.", "pt": "Página não encontrada. O endereço pedido já não existe neste servidor.",
    "ru": "Страница не найдена. Запрошенный адрес больше не существует на этом сервере.", "zh": "您访问的页面不存在或已被删除",
}


@pytest.mark.parametrize("lang", list(MESSAGES))
@pytest.mark.parametrize("share", [8, 3])
def test_messages_in_languages_that_no_list_holds(spark, lang, share):
    """Addresses that all say the same, and nothing of what they name, in few or many of a host's pages."""
    rows, body, bad = site_pages()
    made, said = [], set()
    for i, u, t, x in rows:
        lines = x.split("\r\n")
        if i not in bad and i % share == 1:
            said.add(i)
            lines = [*lines[:4], MESSAGES[lang], *lines[7:]]
        made.append((i, u, t, "\n".join(lines), 200))
    df = spark.createDataFrame(made, "page_id long, url string, title string, text string, status int")
    assert {r.page_id for r in wrappers.residue_pages(df).collect()} == bad | said
    lines = {(r.page_id, r.line_no) for r in wrappers.body_lines([df]).collect()}
    assert lines == {x for x in body if x[0] not in said}


def test_status_needs_fewer_addresses_and_copies_of_a_page_count_once(spark):
    rows, body, bad = site_pages()
    text = MESSAGES["it"]
    extra = [(200 + i, f"http://few.example/a/kadelin{'abcdef'[i]}or", None, text if i < 2 else " ".join(f"{w} near {w[::-1]}{'abcdef'[i]}" for w in "harbour hill lantern river glacier bridge archive schema signal ledger meadow station kettle".split()) + ".", 404 if i < 2 else 200) for i in range(6)]
    again = [(300 + i, "http://copy.example/a/molverin", None, MESSAGES["pt"], 200) for i in range(5)]
    df = spark.createDataFrame([(*r, 200) for r in rows] + extra + again, "page_id long, url string, title string, text string, status int")
    assert {r.page_id for r in wrappers.residue_pages(df).collect()} == bad | {200, 201}


@pytest.mark.parametrize(
    "line, yes",
    [
        ("The requested URL /some/long/path/to/a/document/index.html was not found on this server. If you entered the address yourself, please check the spelling and go back to the previous page or to the home page.", True),
        ("This application needs JavaScript to work and your browser has it turned off at the moment, so that nothing can be shown here; please enable JavaScript in the settings of the browser and load the page again.", True),
        ("The archive of the harbour was kept in a stone house by the river. In 1904 an error in the ledger was found by the clerk. The document was then moved to the town hall, where the visitors of the museum can see it today.", False),
        ("TBDTBDTBD", True), ("Example headlineExample headline", True), ("Example headline", True), ("bonbon bar", False), ("The river ran by the river house.", False),
    ],
)
def test_long_messages_and_copies(line, yes):
    assert residue.residue_line(line) is yes and residue.residue_line(line, wrappers.tokens_of(line)) is yes


def test_every_hint_lets_its_pattern_through():
    """Messages of each kind get past the cheap look at their words."""
    for line in ("405 Method Not Allowed", "at foo.bar(main.js:12)", "Replace this with your own", "Ce document n'existe plus", "504 Gateway Time-out", "Something went wrong", "Algo ha salido mal", "429 Too Many Requests", "Unauthorised", "Try again later", "Site under maintenance", "410 Gone"):
        assert residue.residue_line(line, wrappers.tokens_of(line)), line


def test_own_lists_stay_and_notices_of_any_length_go(spark):
    """An ingredients list that no other page has is body; a notice on a host of few pages is none, however long."""
    cookie = "This site uses cookies and similar means to make your visit as pleasant as it can be and to see which of its pages are read; by going on to the next page you accept that these are stored on your machine until you remove them, as our policy says."
    text = "\n".join(["Bread of the hills", "Flour", "Water", "Salt", "Knead all of it well and leave the dough alone for a night.", cookie])
    df = spark.createDataFrame([(1, "http://cook.example/bread-hills", "Bread", text)], "page_id long, url string, title string, text string")
    assert len(cookie) > wrappers.LONG and {r.line_no for r in wrappers.body_lines([df]).collect()} == {1, 2, 3, 4, 5}


def test_long_notices_are_furniture_whatever_begins_them(spark):
    rows, body, bad = site_pages()
    dense = "この場所は本文ではありません" * 14
    links = " ".join(c * 50 for c in "abcd")
    dated = "%d %s the reading room of this site is closed to all visitors because of works on the roof, and every letter is answered as soon as the clerks have come back to their desks on the upper floor of the house"
    months = "January February March April May June".split()
    rows = [(i, u, t, "\r\n".join([x, dense, links, dated % (i + 1, "of 2020"), f"{months[i % 6]}"])) for i, u, t, x in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, text string")
    got = {(r.page_id, r.line_no) for r in wrappers.body_lines([df]).collect()}
    assert len(dense) > wrappers.LONG and {x for x in got if x[1] <= 7} == body
    late = {(i, x.split("\r\n")[n - 1][:12]) for i, n in got for j, _, _, x in rows if i == j and n > 7}
    assert not {x for _, x in late} & {dense[:12], links[:12]} and not any("of 2020" in x for _, x in late)


def test_salted_hosts_give_the_same(spark, monkeypatch):
    rows, body, bad = site_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, title string, text string")
    monkeypatch.setattr(wrappers, "HOT", 4)
    monkeypatch.setattr(wrappers, "PART_PAGES", 5)  # the host is hot: eight parts of five pages
    assert {r.page_id for r in wrappers.residue_pages(df).collect()} == bad
    assert {(r.page_id, r.line_no) for r in wrappers.body_lines([df]).collect()} == body


# Problem 8

TEXTS = [None, "", " ", "Hello world", "don't  stop\n\n\n now", "<|endoftext|>", "naïve café 😀👍🏽", "aaaaaaaaaaaa" * 50, "=" * 5000, "x" * 3000 + " " * 3000, "\x00\x1c  　tab\tq", "日本語の文章。", "1234567 12.5%", "ab" * 4000, "word " * 30_000]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    rng = random.Random(7)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 900), rng.randint(0x3040, 0x30FF), 10, 32])) for _ in range(rng.randint(0, 200))) for _ in range(100)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(0, None, [1])], "doc_id long, text string, ids array<int>")
    out = tokens.token_ids(df)
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.ids == (lib.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])
    back = {r.doc_id: r.text for r in tokens.token_texts(out).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in rows}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_long_words_equal_the_library():
    """Words that are contracted in windows: runs, near runs, letters at random, tokens in a row."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    e = tokens.WordEncoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(17)
    made = ["".join(rng.choices(rng.choice(["ab", "aeiou", "=-", "abcdefgh", "thein", "th e".replace(" ", ""), "xyz", "日本語", "é a".replace(" ", "")]), k=rng.randint(60, 900))) for _ in range(150)]
    made += ["a" * n + "b" * m + "a" * n for n in (100, 151, 333) for m in (1, 2, 3)] + ["".join(rng.choices(["internation", "alization", "the", "river", "a", "aa", "aaaa"], k=200)) for _ in range(20)]
    for word, ids in zip(made, e._contract(made), strict=True):
        assert ids == lib.encode(word, add_special_tokens=False).ids, word[:60]


def test_unbroken_texts_take_seconds():
    import time

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    word = "".join(random.Random(18).choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    e = tokens.WordEncoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    began = time.process_time()
    (ids,) = e._contract([word])
    assert time.process_time() - began < 60 and ids == lib.encode(word, add_special_tokens=False).ids


def test_encoder_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    e = tokens.WordEncoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    for part in ({"a", "b", "c", "d"}, {"e", "f", "a"}, {" the", "q" * 100}):
        assert part <= set(e.learn(part))
    e.forget_long()
    assert all(len(w) <= tokens.KEPT_CHARS for w in e.known)


# Problem 10


def test_pieces(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma,", "delta.", "epsilon!", "zeta", "eta;", "theta\n", "iota.\n\n", "日本語、", "κάππα", "naïve"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 60, 300, 2000)] + ["x" * 2000, "zq" * 700 + ". " + "Text. " * 200, "😀" * 300, "日本語の文章。" * 200, "\n" * 500, "a\n\n\nb " * 300, None, "", " " * 900]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(90, texts[3], None), (91, texts[3], "unlisted"), (92, texts[3], "free"), (93, texts[2], "whole")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, piece int, _s string")
    limits = spark.createDataFrame([("s", 40, 6), ("s", 60, 9), ("free", None, 3), ("whole", 50, None), (None, 5, 1), ("zero", 0, 0)], "source string, max_tokens int, overlap_tokens int")
    got = defaultdict(list)
    for r in splitting.split_oversized(docs, limits).collect():
        got[r.doc_id].append(r)
    encode = tokens.library_encoding(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken").encode_ordinary
    wanted = {i for i, t, s in rows if t and (s == "s" and len(encode(t)) > 40 or s == "whole" and len(encode(t)) > 50)}
    assert set(got) == wanted
    by_id = {i: t for i, t, _ in rows}
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r.piece_no)
        text = by_id[i]
        assert [r.piece_no for r in pieces] == list(range(1, len(pieces) + 1))
        assert pieces[0].start == 0 and pieces[-1].end == len(text)
        for r in pieces:
            assert r.piece == text[r.start : r.end] and r.n_tokens == len(encode(r.piece)) <= (50 if i == 93 else 40)
        for a, b in zip(pieces, pieces[1:]):
            assert a.start < b.start <= a.end < b.end and len(encode(text[b.start : a.end])) <= (0 if i == 93 else 6)
    assert splitting.split_oversized(docs.limit(0), limits).count() == 0 and splitting.split_oversized(docs, limits.limit(0)).count() == 0


def test_cuts_fall_on_sentences_where_they_can():
    s = splitting.Splitter(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    text = " ".join("This is sentence number %d of a plain text." % i for i in range(60))
    pieces = s.split(text, 64, 0)
    assert all(text[b - 1] == "." for _, b, _ in pieces) and len(pieces) >= 8
    sizes = [n for _, _, n in pieces]
    assert max(sizes) - min(sizes) <= 24


def test_unbroken_texts_share_as_many_tokens():
    s = splitting.Splitter(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    rng = random.Random(11)
    letters, encoded = "".join(rng.choices("abcdefghijklmnop", k=3000)), "".join(rng.choices("ABCDEFghijklmn0123456789+/", k=3000))
    texts = {"ha" * 3000: 16, "=" * 40000: 16, letters: 16, encoded: 16, "x" * 9000: 16, "internationalization" * 300: 16, "日本語文章" * 400: 13, "😀" * 900: 13, " ".join([letters[:1500], "end", letters[1500:]]): 16}
    for text, least in texts.items():
        for most, overlap in ((128, 16), (400, 64)):
            pieces = s.split(text, most, overlap)
            assert len(pieces) > 1 and "".join(text[b[1] if b else 0 : c[1]] for b, c in zip([None, *pieces], pieces)) == text
            assert all(n == len(s.encode(text[a:b])) <= most for a, b, n in pieces)
            for (_, end, _), (start, _, _) in zip(pieces, pieces[1:]):
                assert overlap - 16 + least <= len(s.encode(text[start:end])) <= overlap, (text[:20], most, overlap)


def test_dynamic_programme_is_optimal():
    import itertools

    import numpy as np

    rng = random.Random(9)
    for _ in range(400):
        n = rng.randint(3, 9)
        before = np.concatenate(([0], np.cumsum([rng.randint(1, 9) for _ in range(n)])))
        cost = np.array([0.0, *[rng.choice([0, 0.3, 1, 4, 10]) for _ in range(n - 1)], 0.0])
        most = rng.randint(10, 16)
        overlap = rng.randint(0, most // 2)

        def price(ends, before=before, cost=cost, most=most, overlap=overlap, n=n):
            pieces = max(1, -(-(int(before[n]) - overlap) // max(1, most - overlap)))
            even = (int(before[n]) + (pieces - 1) * overlap) / pieces
            total, start = 0.0, 0
            for j in ends:
                size = before[j] - max(before[start] - overlap, 0)
                if size > most:
                    return np.inf
                total += splitting.UNEVEN * ((size - even) / most) ** 2 + (cost[j] + 0.01 if j != n else 0)
                start = j
            return total

        best = min(price((*c, n)) for k in range(n) for c in itertools.combinations(range(1, n), k))
        found = splitting.Splitter.cuts(before, cost, most, overlap)
        assert price(found) == pytest.approx(best) if found else best == np.inf


def test_dynamic_programme_is_optimal_over_many_boundaries():
    """Against the plain recursion over all pairs of boundaries."""
    import numpy as np

    rng = random.Random(19)
    for _ in range(300):
        n = rng.randint(20, 25)
        before = np.concatenate(([0], np.cumsum([rng.randint(1, 9) for _ in range(n)])))
        cost = np.array([0.0, *[rng.choice([0, 0.3, 1, 4, 10, 60]) for _ in range(n - 1)], 0.0])
        most = rng.randint(10, 40)
        overlap = rng.randint(0, most // 2)
        pieces = max(1, -(-(int(before[n]) - overlap) // max(1, most - overlap)))
        even = (int(before[n]) + (pieces - 1) * overlap) / pieces

        def piece(i, j, before=before, cost=cost, most=most, overlap=overlap, even=even, n=n):
            size = before[j] - max(before[i] - overlap, 0)
            return splitting.UNEVEN * ((size - even) / most) ** 2 + (cost[j] + 0.01 if j != n else 0) if size <= most else np.inf

        best = [0.0] + [np.inf] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + piece(i, j) for i in range(j))
        found = splitting.Splitter.cuts(before, cost, most, overlap)
        total = sum(piece(i, j) for i, j in zip([0, *found], found))
        assert total == pytest.approx(best[n]) if found else best[n] == np.inf


def test_lines_that_share_only_the_own_name_are_not_unified(monkeypatch):
    compared, unify = [], wrappers.unify
    monkeypatch.setattr(wrappers, "unify", lambda p, t: compared.append((p, t)) or unify(p, t))
    w = wrappers.Wrapper()
    w.align([(wrappers.OWN, *(chr(97 + i) + x for x in "xyz")) for i in range(20)])
    assert len(w.patterns) == 20 and not compared
    w.align([(wrappers.OWN, "ax", "ay", "new")])
    assert len(w.patterns) == 20 and w.patterns[0] == (wrappers.OWN, "ax", "ay", wrappers.SLOT) and len(compared) == 1


def test_short_lines_have_the_tokens_of_the_pattern():
    def plain(line):
        found = wrappers._TOKEN.findall(line.lower())
        found = ["0" if t[0].isdigit() else t for t in found] if wrappers._DIGIT.search(line) else found
        words = [k for k, t in enumerate(found) if t[0].isalnum()]
        a, b = (words[0], words[-1] + 1) if words else (0, 0)
        return (*found[a:b], *(["."] if b - a >= 5 and b < len(found) and found[b] in wrappers._END else []))

    rng = random.Random(5)
    parts = ["word", "Émile", "İx", "straße", "a1", "1,5", "2.", "12:30", "٣", "²", "don't", "_", "日本", "•", "-", "¿", "*", ",", ".", ":", "...", "'", "|", "\t", " ", "0", "00", "K"]
    for _ in range(5000):
        line = rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9))).strip()[:160]
        assert wrappers.tokens_of(line) == plain(line), line


def test_pages_are_aligned_as_their_masked_lines():
    rng = random.Random(6)
    site, tokens = frozenset(("rivers",)), wrappers.Tokens()
    a, b = wrappers.Wrapper(), wrappers.Wrapper()
    for _ in range(60):
        own = frozenset(rng.sample(["alpha", "beta", "gamma", "delta"], rng.randint(0, 2)))
        lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "rivers", "menu", "top", "5", ":", "by"]) for _ in range(rng.randint(1, 4))) for _ in range(12)] + [""]
        a.align_page(lines, tokens, own, site)
        b.align([m for x in lines if (m := wrappers.masked(wrappers.tokens_of(x), own, site))])
    assert (a.patterns, a.pages, a.place, a.free, a.total) == (b.patterns, b.pages, b.place, b.free, b.total)


@pytest.mark.parametrize("line", ["Error code: 0x12", "Apache/2.4 Server", "Please contact our system administrator", "Reloading this page", "Go to the homepage", "zurück zur Seite", "Check your spelling", "Refresh the page", "If the problem persists", "Cookies must be on", "Learn more", "REQUEST ID 77-ab", "volver", "Code 5"])
def test_what_goes_with_messages_is_found_behind_the_cheap_look(line):
    assert residue.around(line) and residue._AROUND.search(line)
