import io
import json
import sys

import pytest

from lumetext import cli
from lumetext.searcher import Prompt, Searcher, Service


@pytest.fixture(scope="module")
def site(tmp_path_factory):
    folder = tmp_path_factory.mktemp("site")
    for name, title, body in (("p1", "Harbour", "A red boat in the harbour."), ("p2", "Boats", "Boat by boat, all of them red."), ("p3", "Hills", "Green hills.")):
        (folder / f"{name}.txt").write_text(f"title: {title}\n\n{body}\n")
    (folder / "urls.tsv").write_text("p1\thttp://a.test/\np2\thttp://a.test/x\np3\thttp://b.test/\n")
    (folder / "links.tsv").write_text("p2\tp1\np3\tp1\np1\tp3\n")
    return str(folder)


def run(capsys, *argv):
    code = cli.main(list(map(str, argv)))
    out = capsys.readouterr()
    return code, out.out.splitlines()


def test_every_command_is_there():
    names = """docs show tokenize normalize terms stopword stem-info stem analyze index-stats index-terms postings tf positions lex parse and or andnot phrase match lengths wiki-import corpus-write bench query repl
    index-update pagerank edit-distance snippet suggest complete url url-resolve robots html-text html-links crawl-delay crawl pool-sum index-write index-build beir-import serve evaluate index-size tfidf bm25 top analyze-doc stem-step""".split()
    assert sorted(names) == sorted(cli.COMMANDS) and len(names) == 52


@pytest.mark.parametrize(
    "argv, lines",
    [
        (("tokenize", "café au lait"), ["0 0 café", "1 6 au", "2 9 lait"]), (("normalize", "Œuvre"), ["oeuvre"]), (("terms", "--drop-stopwords", "The cat sat!"), ["1 4 cat", "2 8 sat"]), (("stopword", "The"), ["yes"]),
        (("stem", "relational"), ["relat"]), (("stem-step", "1a", "ponies"), ["poni"]), (("analyze", "Running dogs"), ["0 0 run", "1 8 dog"]), (("lex", 'a AND "b c"'), ["term a", "and", "phrase b c"]),
        (("parse", "a OR b c"), ["(or (term a) (and (term b) (term c)))"]), (("edit-distance", "kitten", "sitting"), ["3"]), (("url", "HTTP://A.test/x/../y"), ["http://a.test/y"]), (("url-resolve", "http://a.test/x/", "../z"), ["http://a.test/z"]),
        (("stem-info", "hop"), ["pattern cvc", "measure 1", "vowel true", "double false", "cvc true"]), (("pool-sum", 2, 4), ["14"]),
    ],
)
def test_commands(capsys, spark, argv, lines):
    assert run(capsys, *argv) == (0, lines)


def test_errors(capsys, spark, site):
    assert run(capsys, "url", "nothing")[0] == 1
    assert run(capsys, "parse", "(a")[0] == 1
    assert run(capsys, "postings", site, "red-boat")[0] == 1
    assert run(capsys, "nonsense")[0] == 2
    assert run(capsys, "docs")[0] == 2
    assert run(capsys, "docs", "/nowhere")[0] == 1


def test_index_commands(capsys, spark, site, tmp_path):
    ix = str(tmp_path / "ix")
    assert run(capsys, "docs", site) == (0, ["p1", "p2", "p3"])
    assert run(capsys, "show", site, "p3") == (0, ["id: p3", "title: Hills", "", "Green hills."])
    stats = run(capsys, "index-stats", site)
    assert run(capsys, "index-write", site, ix) == stats and run(capsys, "index-build", site, str(tmp_path / "iy")) == stats
    for source in (site, ix):
        assert run(capsys, "tf", source, "boats") == (0, ["p1 1", "p2 3"])
        assert run(capsys, "positions", source, "boat") == (0, ["p1 3", "p2 0 1 3"])
        assert run(capsys, "and", source, "red", "harbour") == (0, ["p1"])
        assert run(capsys, "match", source, "NOT red") == (0, ["p3"])
        assert run(capsys, "phrase", source, "red boat") == (0, ["p1"])
        assert run(capsys, "top", "--bm25", source, 1, "boat")[1][0].startswith("p2 ")
        assert run(capsys, "query", "--pagerank", 1, source, "red") != run(capsys, "query", source, "red")
        assert run(capsys, "query", "--tsv", "--limit", 1, source, "hill")[1][0].startswith("p3\t")
        assert run(capsys, "complete", source, "h")[1] == ["harbour 1", "hill 1"]
    assert run(capsys, "lengths", site)[1][-1].startswith("average ")
    size = run(capsys, "index-size", site)[1]
    assert size[0].startswith("plain ") and size[3].startswith("ratio ")
    assert run(capsys, "corpus-write", site, tmp_path / "c.corpus") == (0, ["3 documents"])
    assert run(capsys, "docs", tmp_path / "c.corpus") == (0, ["p1", "p2", "p3"])
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "p1.txt").write_text("title: Harbour\n\nA red boat in the harbour.\n")
    (tmp_path / "new" / "p4.txt").write_text("title: New\n\nA new page\n")
    assert run(capsys, "index-update", tmp_path / "new", ix) == (0, ["added 1", "updated 0", "removed 2", "unchanged 1"])
    assert run(capsys, "docs", ix) == (0, ["p1", "p4"])


def test_pagerank_and_bench(capsys, spark, site, tmp_path):
    rows = run(capsys, "pagerank", "--out", tmp_path / "ranks", f"{site}/links.tsv")[1]
    assert [r.split()[0] for r in rows] == ["p1", "p3", "p2"]
    assert [r.split()[0] for r in run(capsys, "pagerank", "--sites", f"{site}/urls.tsv", f"{site}/links.tsv")[1]] == ["p1", "p3"]
    (tmp_path / "log").write_text("red\n(\nhill\n")
    assert run(capsys, "bench", "query", "--stable", "--repeats", 1, site, tmp_path / "log") == (0, ["queries 3", "rejected 1", "results 3"])
    assert run(capsys, "bench", "build", "--stable", site)[1][0] == "documents 3"
    (tmp_path / "q.jsonl").write_text('{"_id":"q1","text":"red boats"}\n{"_id":"q2","text":"hills"}\n')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\tp1\t1\n")
    got = run(capsys, "evaluate", site, tmp_path / "q.jsonl", tmp_path / "qrels.tsv")[1]
    assert got[:2] == ["queries 1", "unjudged 1"] and got[4] == "recall@100 1.0000"


def test_prompt(spark, site):
    p = Prompt(Searcher(spark, site))
    assert p.answer("  \n") == [] and p.answer("hill")[0].startswith("1. p3  ")
    assert p.answer(":limit 1") == [] and len(p.answer("red")) == 1
    assert p.answer(":limit x") == ["limit must be a non-negative integer"]
    assert p.answer(":scorer tfidf") == [] and p.answer(":snippet on") == [] and p.answer("hill")[1] == "   [Hills] Green [hills]."
    assert p.answer(":pagerank-graph home") == [] and p.answer(":pagerank 0.5") == []
    assert p.answer(":settings") == ["limit 1", "scorer tfidf", "snippet on", "pagerank 0.5", "pagerank-graph home", "pagerank-max-words 0"]
    assert p.answer(":complete ha") == ["harbour 1"] and p.answer(":nope") == ["unknown command: :nope"]
    assert p.answer("harbuor")[0] == "did you mean: harbour" and p.answer("(")[0].startswith("error: ")
    assert p.answer(":quit") == [] and p.done


def test_service(capsys, spark, site, monkeypatch):
    s = Service(Searcher(spark, site))
    status, kind, body = s.respond("GET", "/api/search?q=red%20harbour&limit=1")
    found = json.loads(body)
    assert status == 200 and kind == "application/json" and found["results"][0] | {"score": 0} == {"id": "p1", "score": 0, "title": "Harbour", "url": "http://a.test/", "snippet": "[Harbour] A [red] boat in the [harbour]."}
    assert json.loads(s.respond("GET", "/api/search?q=harbuor")[2])["suggestion"] == "harbour"
    assert json.loads(s.respond("GET", "/api/complete?q=HA&limit=3")[2]) == {"prefix": "ha", "completions": [{"term": "harbour", "documents": 1}]}
    assert json.loads(s.respond("GET", "/api/complete?q=")[2])["completions"] == []
    for bad in ("limit=0", "limit=101", "limit=x", "pagerank=-1", "pagerank=nan", "graph=none", "max_words=10000"):
        assert s.respond("GET", f"/api/search?q=a&{bad}")[0] == 400
    assert s.respond("GET", "/api/search?q=(")[0] == 400 and s.respond("GET", "/none")[0] == 404 and s.respond("POST", "/")[0] == 405
    page = s.respond("GET", "/search?q=%3Cred%3E")[2]
    assert "&lt;red&gt;" in page and "<red>" not in page
    monkeypatch.setattr(sys, "stdin", io.StringIO("GET /api/complete?q=hi HTTP/1.1\r\n\r\n"))
    assert cli.main(["serve", "--stdin", site]) == 0
    assert capsys.readouterr().out.startswith("HTTP/1.1 200 OK\r\n")
