import json
import threading
import urllib.request

import pytest
from lodeleaf import Config, Engine
from lodeleaf.cli import config_of, parser, split_list
from lodeleaf.operators.answer import NOTHING, ChatGenerator, Citation, ExtractiveGenerator, TreeReasoner, chosen_numbers
from lodeleaf.plans.engine import history_turns
from lodeleaf.server import config_from_environment, handle, make_server
from lodeleaf.sources import audit_log, files


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("kb")
    f = d / "files"
    f.mkdir()
    (f / "disk.txt").write_text("Error E1002 means that the disk is full. Remove old caches.\n" * 3)
    (f / "net.txt").write_text("Error E2007 means that the network is down. Call the desk.\n" * 3)
    (f / "guide.md").write_text("# Guide\nintro\n## Install\nRun the installer C3001 now.\n## Remove\nRun the remover C3002.\n")
    (f / "page.html").write_text("<html><head><title>Leave &amp; pay</title></head><body><p>Leave rules</p><script>x=1</script></body></html>")
    (f / "bad.bin").write_bytes(b"x")
    (f / "blank.txt").write_text(" \n")
    e = Engine(spark, Config(store_path=str(d / "store"), audit_path=str(d / "audit.jsonl"), chunk_size=100, chunk_overlap=10))
    first = {r["path"].rsplit("/", 1)[-1]: r for r in e.index_paths([str(f), str(f / "nope")], "team", ["finance"])}
    return e, f, first


def test_indexing(kb):
    e, f, first = kb
    assert [first[n]["status"] for n in ("disk.txt", "guide.md", "page.html", "blank.txt", "nope")] == ["indexed", "indexed", "indexed", "empty", "missing"]
    assert first["bad.bin"]["status"].startswith("error: unsupported") and "doc_id" not in first["bad.bin"]
    assert e.store.get_tree(first["guide.md"]["doc_id"]).count() == 3 and e.store.stats()["documents"] == 4
    assert {d["title"] for d in e.documents()} == {"disk.txt", "net.txt", "guide.md", "Leave & pay"} and e.documents()[0]["tags"] == ["finance"]


def test_answers_cite_and_respect_labels(kb):
    e, _, _ = kb
    a = e.ask("What is E1002", ["team"], 2)
    assert a.citations[0].title == "disk.txt" and "[1]" in a.text and len(a.audit_hash) == 64
    assert "# What is E1002" in a.to_markdown() and a.to_dict()["citations"][0]["span"][0] == 0
    hidden = e.ask("What is E1002", ["hr"])
    assert not hidden.citations and hidden.text == NOTHING and hidden.trace["top_sections"] == []
    assert not e.ask("E1002", []).citations and not e.ask("E1002", None, None, ["other"]).citations
    ok, _ = e.audit_verify()
    s = e.audit_stats()
    assert ok and s["queries"] == 4 and s["total_hits"] == 2 and s["acl_distribution"] == {"team": 1, "hr": 1}


def test_modes_and_reasoning(kb, spark):
    e, _, _ = kb
    for change in ({"hybrid": False}, {"hybrid_mode": "weighted"}, {"mmr_lambda": 0.9}, {"structure_aware": False, "mmr_lambda": 0.0}):
        other = Engine(spark, e.config.but(**change), store=e.store, audit=e.audit)
        assert other.retrieve("E2007 network", top_k=3)[0][0].title == "net.txt"
    seen = []
    reply = {"choices": [{"message": {"content": "```json\n[1]\n```"}}]}
    r = Engine(spark, e.config, store=e.store, audit=e.audit, reasoner=TreeReasoner("http://x", api_key="k", send=lambda *a: (seen.append(a), reply)[1]))
    cited, trace = r.retrieve("C3002 remover", reasoning=True)
    assert trace["reasoning"]["used"] and seen[0][2] == {"Authorization": "Bearer k"}
    cited, trace = e.retrieve("C3002", reasoning=True, history=[{"content": "remover"}], domain_terms=["x"])  # nothing listens there
    assert not trace["reasoning"]["used"] and trace["query_effective"] == "C3002 remover x" and cited


def test_changes_and_erasure(kb, spark):
    e, f, first = kb
    p = f / "disk.txt"
    original = p.read_text()
    assert e.index_document(str(p))["status"] == "skipped" and e.index_document(str(p), force=True)["status"] == "updated"
    p.write_text("Now about E9999.")
    assert e.index_document(str(p))["status"] == "updated" and e.index_document(str(p))["status"] == "skipped"
    p.write_text(original)
    assert e.index_document(str(p))["status"] == "updated"
    p.write_text("")
    assert e.index_document(str(p))["status"] == "empty"
    assert e.store.chunks.filter(f"doc_id = '{first['disk.txt']['doc_id']}'").count() == 0
    store = f.parent / "store"
    before = {str(p.parent) for p in store.rglob("*.parquet")}
    gone = first["net.txt"]["doc_id"]
    assert e.store.chunks.filter(f"doc_id = '{gone}'").count() > 0
    e.forget_document(str(f / "net.txt"))
    assert e.store.stored_hash(gone) is None
    assert all(e.store.table(t).filter(f"doc_id = '{gone}'").count() == 0 for t in ("documents", "chunks", "sections"))
    assert not [r for r in spark.read.option("recursiveFileLookup", True).parquet(str(store / "documents"), str(store / "chunks")).select("doc_id").distinct().collect() if r[0] == gone]
    assert e.store.vacuum() == 0 and len(list((store / "manifests").glob("*.json"))) == 1 and before


def test_a_change_rewrites_one_bucket(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for i in range(12):
        (tmp_path / "f" / f"{i}.txt").write_text(f"text {i} " * 5)
    e = Engine(spark, Config(store_path=str(tmp_path / "s"), audit_path=str(tmp_path / "a.jsonl")))
    e.index_paths([str(tmp_path / "f")])
    old = e.store._manifest()[1]["tables"]["chunks"]
    (tmp_path / "f" / "3.txt").write_text("changed")
    stale = Engine(spark, e.config)
    e.index_document(str(tmp_path / "f" / "3.txt"))
    new = e.store._manifest()[1]["tables"]["chunks"]
    assert len(old) > 3 and old.keys() == new.keys() and sum(old[k] != new[k] for k in old) == 1
    assert stale.store.chunks.filter("text = 'changed'").select("tokens").first()[0] == ["changed"]
    # a manifest whose writer died is passed over; its number isn't taken again
    number = e.store.version()
    (tmp_path / "s" / "manifests" / f"{number + 1:012d}.json").write_text('{"tab')
    assert e.store.version() == number and e.store.chunks.count() == 12
    (tmp_path / "f" / "4.txt").write_text("changed too")
    e.index_document(str(tmp_path / "f" / "4.txt"))
    assert e.store.version() == number + 2 and e.store.chunks.filter("text like 'changed%'").count() == 2
    assert e.store.vacuum() > 0 and e.store.chunks.count() == 12


def test_evaluate(kb, spark):
    e, _, _ = kb
    q = spark.createDataFrame([(0, "C3001 installer", ["guide.md"]), (1, "zzz", ["nothing"])], "query_id long, query string, relevant array<string>")
    r = e.evaluate(q, 3)
    assert r["cases"] == 2 and r["recall@3"] == 0.5 and r["details"][1]["first_rank"] is None


def test_mismatched_vectors_are_refused(kb, spark):
    e, _, _ = kb
    with pytest.raises(ValueError):
        Engine(spark, e.config.but(embedding_dim=64), store=e.store, audit=e.audit).retrieve("x")


def test_audit_chain(spark, tmp_path):
    log = audit_log.AuditLog(str(tmp_path / "a.jsonl"))
    assert log.verify(spark) == (True, "whole, 0 entries") and len(log) == 0
    log.append_all([{"type": "query", "n": i, "x": 1e-05, "ü": "中"} for i in range(4)])
    head = log.append({"type": "other"})
    good = (tmp_path / "a.jsonl").read_text().splitlines()
    assert log.verify(spark, head)[0] and len(log) == 5
    for lines, line in (([good[0], good[1].replace('"n":1', '"n":7'), *good[2:]], 2), ([good[0], good[2]], 2), ([good[0], "", "{bad", good[1]], 3), (["[]"], 1)):
        (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
        ok, message = log.verify(spark)
        assert not ok and message.startswith(f"line {line}:")
    (tmp_path / "a.jsonl").write_text("\n".join(good[:3]) + "\n\n")
    assert log.verify(spark)[0] and not log.verify(spark, head)[0]


def test_verification_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit_log, "PART", 3)
    log = audit_log.AuditLog(str(tmp_path / "a.jsonl"))
    for i in range(4):
        log.append_all([{"type": "query", "n": 4 * i + k, "pad": "x" * 40_000} for k in range(4)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        lines = log.lines(spark)
        assert lines.rdd.getNumPartitions() > 1 and sorted(r.line for r in lines.collect()) == list(range(1, 17)) and log.verify(spark) == (True, "whole, 16 entries")
        good = (tmp_path / "a.jsonl").read_text().splitlines()
        (tmp_path / "a.jsonl").write_text("\n".join(good[:6] + good[7:]) + "\n")  # at the start of a part
        assert log.verify(spark)[1].startswith("line 7: does not follow")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_extract():
    assert files.extract_html("<p>a  b</p><!-- c --><style>s</style>")[0] == "a bs"
    assert files.extract_html("<p>a</p><script>s</script>", True)[0] == "a"
    assert files.decode(b"a\xff\r\nb\rc") == "a\nb\nc"
    with pytest.raises(RuntimeError, match="pypdf"):
        files.extract("x.pdf", b"")


def test_pdf_pages_with_a_stand_in_reader(monkeypatch):
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.extract_text = lambda: text

    reader = types.SimpleNamespace(PdfReader=lambda stream: types.SimpleNamespace(pages=[Page("first"), Page(None), Page("third page")]))
    monkeypatch.setitem(sys.modules, "pypdf", reader)
    text, title, pages = files.extract("/a/x.PDF", b"%PDF")
    assert (text, title, pages) == ("first\n\nthird page", "x.PDF", [(1, 0), (2, 6), (3, 7)]) and text[7:12] == "third"


def test_generators():
    c = Citation("d:0", "d", 0.5, "Alpha one. Beta two! Gamma.", 1, 0, 9, "/p", "T", "public")
    assert ExtractiveGenerator().generate("beta gamma", [c]) == "Beta two! Gamma. [1]" and ExtractiveGenerator().generate("x", []) == NOTHING
    sent = []
    g = ChatGenerator("http://h/v1/", send=lambda *a: (sent.append(a), {"choices": [{"message": {"content": " hi "}}]})[1])
    assert g.generate("q", [c]) == "hi" and sent[0][0] == "http://h/v1/chat/completions" and sent[0][2] == {} and sent[0][1]["temperature"] == 0.2
    assert "Beta two!" in ChatGenerator("http://127.0.0.1:9", timeout=0.2).generate("beta", [c])
    assert chosen_numbers("x [1, 3, 9, true] y", 3) == [0, 2] and chosen_numbers("none", 3) == []
    assert history_turns([{"query": "a"}, ("b", 1), "c"]) == [["a"], ["b", "1"], ["c"]]


def test_command_line(kb, capsys, tmp_path):
    from lodeleaf.cli import run

    args = parser().parse_args(["--top-k", "7", "query", "what", "--min-score", "0.1"])
    assert config_of(args).top_k == 7 and config_of(args).min_score == 0.1 and split_list(" a, ,b") == ["a", "b"]
    e, f, _ = kb
    for line, out in ((["stats"], "documents"), (["docs"], "team"), (["audit-verify"], "PASS"), (["audit-stats"], "queries"), (["query", "C3001", "--acl", "team", "--json"], "citations")):
        assert run(parser().parse_args(line), e) == 0 and out in capsys.readouterr().out
    assert run(parser().parse_args(["index", str(f), "--acl", "a,b"]), e) == 2
    assert run(parser().parse_args(["query", "C3001 installer", "--acl", "team"]), e) == 0 and "In sections: Guide" in capsys.readouterr().out
    assert run(parser().parse_args(["query", "C3001", "--acl", "team", "--md", "--out", str(tmp_path / "o.md")]), e) == 0 and "Citations" in (tmp_path / "o.md").read_text()


def test_http(kb, monkeypatch):
    e, _, _ = kb
    assert handle(e, "GET", "/health", {}) == (200, {"status": "ok"}) and handle(e, "GET", "/no", {})[0] == 404
    assert handle(e, "POST", "/query", {})[0] == 422 and handle(e, "POST", "/index", {"paths": [], "acl": "a,b"})[0] == 422
    with make_server(e, port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/query", json.dumps({"query": "C3002", "acl": "team"}).encode(), method="POST")
        with urllib.request.urlopen(request, timeout=120) as r:
            assert json.load(r)["citations"]
        server.shutdown()
    monkeypatch.setenv("LODELEAF_LLM_MODEL", "m")
    assert config_from_environment(Config()).llm_model == "m"


def test_stream(spark, tmp_path):
    from lodeleaf.streaming.incremental import index_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("streamed text")
    e = Engine(spark, Config(store_path=str(tmp_path / "store"), audit_path=str(tmp_path / "a.jsonl")))
    for want in (1, 2):
        index_stream(e, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(120)
        assert e.store.stats()["documents"] == want
        (tmp_path / "in" / "b.txt").write_text("more")
