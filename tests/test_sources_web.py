import struct

import pytest
from pyspark.sql import functions as F

from lumetext.functions import web
from lumetext.operators import crawl
from lumetext.sources import corpus as src

# Addresses


@pytest.mark.parametrize(
    "text, canonical",
    [
        ("HTTP://Example.COM:80/a/../b/./c//d/?q=1#f", "http://example.com/b/c/d/?q=1"), ("https://x.test", "https://x.test/"), ("https://x.test:443/", "https://x.test/"), ("http://x.test:8080", "http://x.test:8080/"),
        ("http://x.test/../..", "http://x.test/"), ("ftp://x.test/", None), ("http://x.test:99999/", None), ("http://x.test:/", None), ("http:///a", None), ("no address", None), ("http://user@x.test/", "http://user@x.test/"), ("http://x.test?a=b", "http://x.test/?a=b"), ("http://[::1]/", None),
    ],
)
def test_addresses(spark, text, canonical):
    url = web.parse_url(text)
    assert (str(url) if url else None) == canonical
    assert spark.createDataFrame([(text,)], "u string").select(web.canonical_column(F.col("u")).alias("c")).first().c == canonical


@pytest.mark.parametrize(
    "ref, target",
    [("x.html", "http://h.test/a/x.html"), ("/x", "http://h.test/x"), ("//k.test/y", "http://k.test/y"), ("../z", "http://h.test/z"), ("https://k.test", "https://k.test/"), ("#top", None), ("mailto:me@x", None), ("  ", None), ("?q=1", "http://h.test/a/?q=1"), ("a/b:c", "http://h.test/a/a/b:c")],
)
def test_resolve(ref, target):
    got = web.resolve_url(web.parse_url("http://h.test/a/b?k=1"), ref)
    assert (str(got) if got else None) == target


def test_hosts_and_escapes(spark):
    assert spark.createDataFrame([("HTTP://A.b:8080/x",)], "u string").select(web.host_column(F.col("u")).alias("h")).first().h == "a.b"
    assert web.url_decode("a+b%20%zz%C3%A9") == "a b %zzé" and web.url_encode("a b~é/") == "a+b~%C3%A9%2F"
    assert web.html_escape("<a href='x'>&") == "&lt;a href=&#39;x&#39;&gt;&amp;"


# HTML


def test_html():
    page = web.parse_html("<html><TITLE>A &amp; B</title><!-- no > --><script>var a = '<b>';</SCRIPT ><p>One<br>two &#233;&#x1F600; &bogus; &lt;<a class=k HREF='x&amp;y'>go</a><a data-href=\"n\" href=/z>z</a><a>none</a><style>p{}</style>end")
    assert page.title == "A & B"
    assert page.text == "A & B One two é😀 &bogus; <goznone end"
    assert page.links == ["x&y", "n"]  # an attribute whose name ends with -href comes first
    assert web.parse_html("text <p never closed").text == "text"
    assert web.parse_html("").text == "" and web.parse_html("a<!-- open").text == "a"


def test_html_frames(spark):
    rows = spark.createDataFrame([("http://h.test/a", "<title>T</title><a href='b'>x</a>"), ("http://h.test/c", None)], "url string, html string")
    parsed = web.parsed_html(rows).collect()
    assert parsed[0].title == "T" and parsed[0].links == ["b"] and parsed[1].text is None
    assert [tuple(r) for r in web.resolved_links(web.parsed_html(rows)).collect()] == [("http://h.test/a", "http://h.test/b")]


# Robots rules


ROBOTS = """
User-agent: *
Disallow: /private/   # comment
Allow: /private/public
Disallow: /*.pdf$
Crawl-delay: 1.5

User-agent: Bot
User-agent: other
Disallow: /bot

User-agent: empty
Disallow:
"""


def test_robots():
    r = web.parse_robots(ROBOTS, "somebody")
    assert not r.allows("/private/x") and r.allows("/private/public.html") and not r.allows("/a.pdf") and r.allows("/a.pdf.html") and r.allows("/")
    assert r.delay_ms == 1500 and r.wait(2000) == 2000 and r.wait(100) == 1500
    named = web.parse_robots(ROBOTS, "botany")
    assert not named.allows("/bot/x") and named.allows("/private/x") and named.delay_ms is None
    assert not web.parse_robots(ROBOTS, "empty").allows("/private/x")  # a group without a rule falls back
    assert web.Robots((("/a", False), ("/a", True))).allows("/ab")


# Collections


@pytest.fixture
def folder(tmp_path):
    texts = {"a": "title: First: one\r\n\r\n  body line\r\n\r\nlast\r\n\r\n", "b": "title:\n\n\n", "c": "name: x\n\nbody", "d": "  \n\n", "e": "title: Only", "f": "no header"}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "g.md").write_text("title: G\n\nx")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "h.txt").write_text("title: H\n\nx")
    return tmp_path


def test_directory(spark, folder):
    rows = {r.doc_id: (r.title, r.body) for r in src.open_corpus(spark, str(folder)).collect()}
    assert rows == {"a": ("First: one", "  body line\n\nlast"), "b": ("", ""), "e": ("Only", "")}


def test_packed_file(spark, folder, tmp_path):
    docs = src.read_directory(spark, str(folder))
    path = str(tmp_path / "all.corpus")
    assert src.write_packed(docs, path) == 3
    assert sorted(map(tuple, src.open_corpus(spark, path).collect())) == sorted(map(tuple, docs.collect()))
    raw = open(path, "rb").read()
    for bad in (raw[:10], b"XXXX" + raw[4:], raw[:4] + struct.pack("<I", 9) + raw[8:], raw[:-3], raw + b"!"):
        (tmp_path / "bad.corpus").write_bytes(bad)
        with pytest.raises(src.CorpusError):
            src.packed_table(str(tmp_path / "bad.corpus"))
    with pytest.raises(src.CorpusError):
        src.open_corpus(spark, str(tmp_path / "none"))


def test_dumps(spark, tmp_path):
    (tmp_path / "wiki.json").write_text('{"index":{"_id":1}}\n{"title":"A  b","text":"x\\n y","opening_text":"x"}\n{"index":{}}\n{"title":"Empty","text":" "}\n{"title":5,"text":"n"}\n{"title":"C","text":"caf\\u00e9"}\n')
    rows = [tuple(r) for r in src.read_wikipedia(spark, str(tmp_path / "wiki.json")).orderBy("doc_id").collect()]
    assert rows[0] == ("doc_00000001", "A b", "x y") and rows[-1][1:] == ("C", "café")
    assert [r.title for r in src.read_wikipedia(spark, str(tmp_path / "wiki.json"), abstracts=True).collect()] == ["A b"]
    assert src.read_wikipedia(spark, str(tmp_path / "wiki.json"), limit=1).count() == 1
    (tmp_path / "beir.jsonl").write_text('{"_id":"d1","title":"T","text":"x"}\n{"_id":"","title":"T"}\n{"_id":"d2","title":"","text":" "}\n{"_id":"d10","text":"y","metadata":{"a":1}}\n')
    assert [r.doc_id for r in src.read_beir(spark, str(tmp_path / "beir.jsonl")).orderBy("doc_id").collect()] == ["d1", "d10"]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nq1\td3\tx\nq1\td1\t2\n")
    assert [tuple(r) for r in src.read_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "d1", 2)]
    (tmp_path / "log.txt").write_text(" one \n\n two\n")
    assert [r.query for r in src.read_queries(spark, str(tmp_path / "log.txt")).orderBy("query_ord").collect()] == ["one", "two"]
    (tmp_path / "links.tsv").write_text("a\tb\tc\r\nnone\nd\te\n")
    assert sorted(map(tuple, src.read_links(spark, str(tmp_path / "links.tsv")).collect())) == [("a", "b\tc"), ("d", "e")]


def test_json_field(spark):
    lines = ['{"title": "a\\n\\u00e9", "n": 3, "deep": {"title": "no"}}', '{"deep": {"title": "no"}}', "broken", '{"title": null}']
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(src.json_field(F.col("l"), "title").alias("t"), src.json_field(F.col("l"), "n").alias("n")).collect()
    assert [r.t for r in got] == ["a\né", None, None, None] and got[0].n is None


def test_ranks_and_merges(spark, tmp_path):
    ranks = spark.createDataFrame([("a\tb", 0.1), ("c", 1 / 3)], "page string, score double")
    src.write_ranks(ranks, str(tmp_path / "r"))
    assert sorted(map(tuple, src.read_ranks(spark, str(tmp_path / "r")).collect())) == [("a\tb", 0.1), ("c", 1 / 3)]
    (tmp_path / "bad").write_text("a\t-1\n")
    with pytest.raises(Exception, match="bad rank line"):
        src.read_ranks(spark, str(tmp_path / "bad")).collect()
    both = src.merge_crawls({"x": ranks, "y": ranks}, ("page",))
    assert sorted(r.page for r in both.collect()) == ["x_a\tb", "x_c", "y_a\tb", "y_c"]
    out = spark.createDataFrame([("d", 1234.5, "a\nb")], "doc_id string, score double, snippet string")
    assert src.result_lines(out, tsv=True).first().line == "d\t1234.5000\ta b"


# Crawls


def test_mirror_crawl(spark, tmp_path):
    host = tmp_path / "h.test"
    (host / "sub").mkdir(parents=True)
    (host / "index.html").write_text("<title>Home</title><a href='a.html'>a</a><a href='/sub/'>s</a><a href='secret/x'>no</a><a href='http://k.test/'>k</a>")
    (host / "a.html").write_text("<title>A</title><a href='/'>home</a><a href='copy.html'>c</a><a href='gone'>g</a>")
    (host / "copy.html").write_text("<title>A</title><a href='/'>home</a><a href='copy.html'>c</a><a href='gone'>g</a>")
    (host / "sub" / "index.html").write_text("plain")
    (host / "robots.txt").write_text("User-agent: *\nDisallow: /secret")
    seed = web.parse_url("http://h.test/")
    got = crawl.crawl(seed, crawl.mirror_fetcher(str(tmp_path)))
    assert [(p[0], p[1], p[2]) for p in got.pages] == [("doc_0001", "http://h.test/", 200), ("doc_0002", "http://h.test/a.html", 200), ("doc_0003", "http://h.test/sub/", 200), (None, "http://h.test/gone", 404)]
    pages, edges = crawl.crawl_tables(spark, got)
    assert sorted(map(tuple, edges.collect())) == [("doc_0001", "doc_0002"), ("doc_0001", "doc_0003"), ("doc_0002", "doc_0001")]
    assert [tuple(r) for r in crawl.crawl_corpus(pages).orderBy("doc_id").collect()][2] == ("doc_0003", "http://h.test/sub/", "plain")
    assert len(crawl.crawl(seed, crawl.mirror_fetcher(str(tmp_path)), max_depth=0).pages) == 1
    assert len(crawl.crawl(seed, crawl.mirror_fetcher(str(tmp_path)), max_pages=2).pages) == 2
    assert len(crawl.crawl(seed, crawl.mirror_fetcher(str(tmp_path)), max_per_host=1).pages) == 1


def test_stored_graph_levels_and_dedup(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    levels = crawl.frontier_levels(spark.createDataFrame([("a",)], "url string"), edges, 2)
    assert sorted(map(tuple, levels.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    pages = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None)], "page_id int, text string")
    assert sorted(r.page_id for r in crawl.first_bodies(pages).collect()) == [1, 2, 4]


def test_concurrent_crawls_equal_sequential_ones(tmp_path):
    """Several hosts at a time, in the frontier's order; each fetch waits by its host's rules."""
    for i in range(4):
        host = tmp_path / f"h{i}.test"
        host.mkdir()
        links = "".join(f"<a href='http://h{j}.test/{p}'>x</a>" for j in range(4) for p in ("", "a.html", "b.html"))
        for name in ("index.html", "a.html", "b.html"):
            (host / name).write_text(f"<title>{i}{name}</title>{links}")
        (host / "robots.txt").write_text(f"User-agent: *\nCrawl-delay: {i}\nDisallow: /b" if i else "")
    seed = web.parse_url("http://h0.test/")
    waits = []
    runs = [crawl.crawl(seed, crawl.mirror_fetcher(str(tmp_path)), same_host=False, concurrency=n, pause=lambda host, rules: waits.append((host, rules.wait(10)))) for n in (1, 3, 16)]
    assert runs[0].pages == runs[1].pages == runs[2].pages and runs[0].links == runs[1].links == runs[2].links
    assert len(runs[0].pages) == 9 and ("h3.test", 3000) in waits and ("h0.test", 10) in waits and not any(p[1].endswith("b.html") and "h0" not in p[1] for p in runs[0].pages)


def test_wide_dumps_lose_nothing(spark, tmp_path):
    """Every article of a dump of wide lines in several files and splits, numbered in their order."""
    rows = spark.range(12_000).repartitionByRange(3, "id").sortWithinPartitions("id").selectExpr("to_json(struct(concat('T', id) AS title, concat(id, ' ', repeat(sha2(cast(id AS string), 256), 10)) AS text))")
    rows.write.text(str(tmp_path / "dump"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = src.read_wikipedia(spark, str(tmp_path / "dump")).select("doc_id", "title", F.length("body").alias("n")).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.doc_id, r.title) for r in got] == [(f"doc_{i + 1:08d}", f"T{i}") for i in range(12_000)] and all(r.n > 640 for r in got)


def test_folders_are_replaced_and_clusters_need_a_shared_one(spark, tmp_path):
    from types import SimpleNamespace

    from lumetext import storage

    for place, n in (("old", 1), ("old.new", 2)):
        spark.range(n).write.parquet(str(tmp_path / place / "docs"))
    storage.replace_folder(spark, str(tmp_path / "old.new"), str(tmp_path / "old"), ("docs", "none"))
    assert spark.read.parquet(str(tmp_path / "old" / "docs")).count() == 2 and not storage.exists(spark, str(tmp_path / "old.new")) and storage.names_in(spark, str(tmp_path / "old")) == ["docs"]
    storage.write_text(spark, str(tmp_path / "t"), "é")
    storage.write_text(spark, str(tmp_path / "t"), "ü")
    assert storage.read_text(spark, str(tmp_path / "t")) == "ü" and storage.read_text(spark, str(tmp_path / "u")) is None
    for master, alone in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)):
        assert storage.one_machine(SimpleNamespace(sparkContext=SimpleNamespace(master=master))) is alone


def test_spread_goes_by_partitions(spark, tmp_path):
    from lumetext.storage import spread

    spark.range(10, numPartitions=1).write.parquet(str(tmp_path / "one"))
    spark.range(100, numPartitions=9).write.parquet(str(tmp_path / "nine"))
    assert spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=9)
    assert spread(many) is many
