import json
import threading
from http.server import ThreadingHTTPServer
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

import pytest

from nameloom import cli
from nameloom.operators import embedders
from nameloom.sources import index_store, jsonl
from nameloom.streaming.resolve import exact_stream, resolve_stream

LINES = ['{"entity_id": "A", "scientific_name": "Foo bar", "standard_name_cn": "福", "aliases": ["x"]}', '{"entity_id": "B", "scientific_name": "Foo baz", "standard_name_cn": "巴", "aliases": ["y"], "former_names": ["old y"]}']


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    (folder / "e.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    cli.main(["build", "--entities", str(folder / "e.jsonl"), "--index", str(folder / "index")], spark)
    return folder


def test_command_line(spark, index, capsys):
    cli.main(["query", "--index", str(index / "index"), "F. bar", "--format", "json"], spark)
    assert json.loads(capsys.readouterr().out)[0]["results"][0]["source"] == "expanded_exact"
    cli.main(["report", "--entities", str(index / "e.jsonl"), "--index", str(index / "index"), "--output", str(index / "r")], spark)
    assert json.loads(capsys.readouterr().out)["top1_hits"] == 3
    cli.main(["merge", "--base", str(index / "e.jsonl"), "--candidates", str(index / "e.jsonl"), "--output", str(index / "m")], spark)
    assert spark.read.json(str(index / "m")).count() == 2
    cli.main(["report", "--entities", str(index / "e.jsonl"), "--index", str(index / "index"), "--output", str(index / "r2"), "--document", str(index / "doc" / "r.json")], spark)
    document = json.loads((index / "doc" / "r.json").read_text())
    assert document["summary"]["misses"] == [] and [c["actual_top1"]["entity_id"] for c in document["cases"]] == ["A", "B", "B"] and document["cases"][2]["expected"]["scientific_name"] == "Foo baz"
    capsys.readouterr()
    cli.main(["eval", "--index", str(index / "index"), "--query", "F. bar", "--format", "json", "--top-k", "1"], spark)
    assert json.loads(capsys.readouterr().out)[0]["results"][0]["source"] == "embedding"  # vectors alone, not the cascade


def test_evaluation_command(spark, index, capsys):
    (index / "q.jsonl").write_text('{"query": "福", "target_entity_id": "A", "target_name": "福", "split": "entity"}\n{"query": "old y", "target_entity_id": "B", "target_name": "巴"}\n', encoding="utf-8")
    args = ["evaluate", "--entities", str(index / "e.jsonl"), "--queries", str(index / "q.jsonl"), "--output", str(index / "eval.json"), "--candidate-mode", "all-names", "--backends", "auto", "char-ngram-sparse"]
    cli.main(args, spark)
    report = json.loads((index / "eval.json").read_text())
    assert [r["model"] for r in report] == ["char-ngram-blake2b", "char-ngram-sparse"] and list(report[0]["summary"]) == ["all", "entity", "unknown"]
    for r in report:
        assert r["summary"]["all"]["top1_accuracy"] == 1.0 and [d["rank"] for d in r["details"]] == [1, 1] and r["details"][1]["top_results"][0]["matched_text"] == "old y"
    assert "top1=1.0000" in capsys.readouterr().out


def test_alias_json_and_triplets(spark, index, tmp_path):
    cli.main(["aliases", "--index", str(index / "index"), "--output", str(tmp_path / "a.json")], spark)
    found = json.loads((tmp_path / "a.json").read_text(encoding="utf-8"))
    assert list(found) == sorted(found) and found["old y"] == {"entity_ids": ["B"], "matched_names": ["old y"]}
    assert {r["norm"] for r in index_store.load_alias_json(spark, str(tmp_path / "a.json")).collect()} == set(found)
    (tmp_path / "t.jsonl").write_text('{"anchor": "a", "positive": "p", "hard_negative": ""}\n')
    assert [tuple(r) for r in jsonl.read_triplets(spark, str(tmp_path / "t.jsonl")).collect()] == [("a", "p", None, None)]
    (tmp_path / "t.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no training rows"):
        jsonl.read_triplets(spark, str(tmp_path / "t.jsonl"))
    (tmp_path / "t.jsonl").write_text('{"anchor": "a"}\n\n{"anchor": \n')
    with pytest.raises(ValueError, match="t.jsonl, line 3"):
        jsonl.read_jsonl(spark, str(tmp_path / "t.jsonl"), jsonl.TRIPLET).select("anchor").count()


def test_backends(monkeypatch):
    assert embedders.choose("auto") == "char-ngram-blake2b" and embedders.choose("char-ngram-md5") == "char-ngram-md5"
    with pytest.raises(ImportError):
        embedders.choose("sentence-transformers")
    with pytest.raises(ValueError):
        embedders.choose("what")
    assert embedders.resolve_model("m") == "m" and embedders.resolve_model() == embedders.BASE_MODEL
    monkeypatch.setattr(embedders, "transformer", lambda model: embedders.DENSE["char-ngram-blake2b"])
    name = embedders.choose("auto", "m")
    assert name == "sentence-transformers:m" and embedders.DENSE.pop(name)


def test_static_files(tmp_path):
    web = tmp_path / "web"
    web.mkdir()
    (web / "index.html").write_text("x")
    (tmp_path / "secret").write_text("s")
    assert cli.static_file(web, "/") == (200, web / "index.html") and cli.static_file(web, "/%2e%2e/secret") == (403, None)
    assert cli.static_file(web, "/none") == (404, None) and cli.static_file(None, "/") == (404, None)


def test_http(spark, index):
    server = ThreadingHTTPServer(("127.0.0.1", 0), cli.handler(spark, index_store.load(spark, str(index / "index")), 0.82))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}/api"
    found = json.loads(urlopen(f"{at}/search?q={quote(' OLD  y ')}&top_k=x").read())
    assert [r["entity_id"] for r in found["results"]] == ["B"] and json.loads(urlopen(f"{at}/status").read())["entities"] == 2
    with pytest.raises(HTTPError) as e:
        urlopen(f"{at}/search?q=%20")
    assert e.value.code == 400
    server.shutdown()


def test_stream(spark, index, tmp_path):
    loaded = index_store.load(spark, str(index / "index"))
    spark.createDataFrame([(1, "X "), (2, "f. BAZ"), (3, "nothing like it")], "qid long, query string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, query string").json(str(tmp_path / "in"))
    got = []
    resolve_stream(stream, loaded, lambda df, n: got.extend(df.collect()), str(tmp_path / "check"), top_k=1).awaitTermination(120)
    assert {(r["qid"], r["entity_id"], r["source"]) for r in got if r["qid"] < 3} == {(1, "A", "exact"), (2, "B", "expanded_exact")} and len(got) == 3
    q = exact_stream(stream, loaded).writeStream.format("memory").queryName("exact").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert [r["entity_id"] for r in spark.sql("SELECT entity_id FROM exact").collect()] == ["A"]
