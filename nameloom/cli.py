"""Command line: build an index, resolve queries, evaluate backends, build training data, crawl fetched pages, merge catalogues, serve.

    python -m nameloom.cli build --entities entities.jsonl --index index
    python -m nameloom.cli query --index index "E. coli" --top-k 5 --format table
    python -m nameloom.cli eval --index index --query "E. colli"
    python -m nameloom.cli evaluate --entities entities.jsonl --queries queries.jsonl --candidate-mode all-names --output evaluation.json
    python -m nameloom.cli report --entities entities.jsonl --index index --output report --document report.json
    python -m nameloom.cli crawl --pages pages.parquet --start-url http://... --output candidates
    python -m nameloom.cli aliases --index index --output aliases.json
    python -m nameloom.cli training --entities entities.jsonl --triplets out1 --queries out2
    python -m nameloom.cli merge --base entities.jsonl --candidates new.jsonl --output merged
    python -m nameloom.cli serve --index index --port 8000
"""

from __future__ import annotations

import argparse
import json
import mimetypes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameloom.functions.text import float_parameter, int_parameter
from nameloom.operators import cascade, catalogue, embedders, evaluation, training
from nameloom.schema import EVAL_COLUMNS, RESULT_COLUMNS
from nameloom.sources import index_store, jsonl
from nameloom.sources.shared import written

#: Queries of ``eval`` if none are given: words that are names, parts of names and misspelled names.
PROBES = ("酿酒酵母", "乳杆菌", "Bacilus subtilis", "B. cereus", "链球")


def payloads(spark: SparkSession, index: cascade.Index, texts: list[str], top_k: int, threshold: float, find=cascade.retrieve) -> list[dict]:
    """One {message, results} per text, in order."""
    rows = find(spark.createDataFrame(list(enumerate(texts)), "qid long, query string"), index, top_k, threshold).collect()
    out: list[dict] = [{"message": "", "results": []} for _ in texts]
    for r in sorted(rows, key=lambda r: (r["qid"], r["pos"])):
        out[r["qid"]]["message"] = r["message"]
        out[r["qid"]]["results"].append({c: r[c] for c in RESULT_COLUMNS})
    return out


def show(found: list[dict], form: str) -> str:
    if form == "json":
        return json.dumps(found, ensure_ascii=False, indent=2)
    lines = []
    for p in found:
        lines.append(p["message"])
        for r in p["results"]:
            flags = [n for n in ("low_confidence", "ambiguous") if r[n]]
            lines.append(f"{r['entity_id']}\t{r['standard_name_cn'] or ''}\t{r['scientific_name'] or ''}\t{r['matched_name']}\t{r['source']}\t{r['score']:.4f}\t{' '.join(flags)}")
    return "\n".join(lines)


def asked_numbers(spark: SparkSession, asked: dict, threshold: float) -> tuple[int, float]:
    """top_k and threshold of a request, by the rules of ``int_parameter`` and ``float_parameter``."""
    row = spark.createDataFrame([(asked.get("top_k"), asked.get("threshold"))], "k string, t string")
    return tuple(row.select(int_parameter(F.col("k"), cascade.TOP_K), float_parameter(F.col("t"), threshold)).first())


def static_file(root: Path | None, path: str) -> tuple[int, Path | None]:
    """(200, file) under ``root``, else 403 for what lies outside it, 404 for what is not there."""
    if root is None:
        return 404, None
    wanted = (root / (unquote(path).lstrip("/") or "index.html")).resolve()
    if not wanted.is_relative_to(root.resolve()):
        return 403, None
    return (200, wanted) if wanted.is_file() else (404, None)


def evaluation_report(spark: SparkSession, entities, asked, names: list[str], mode: str, top_k: int) -> list[dict]:
    """One {model, candidate_mode, summary, details} per backend; the queries are a stated, small set."""
    out = []
    for name in names:
        metrics, details = evaluation.evaluate(entities, asked, name, mode, top_k)
        summary = {r["bucket"]: {k: v for k, v in r.asDict().items() if k != "bucket"} for r in metrics.orderBy("bucket").collect()}
        rows = [{k: v for k, v in r.asDict(recursive=True).items() if k != "ent_ord"} for r in details.orderBy("ent_ord").collect()]
        out.append({"model": name, "candidate_mode": mode, "summary": summary, "details": rows})
    return out


def write_document(path: str, document) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, ensure_ascii=False, indent=2), encoding="utf-8")


def handler(spark: SparkSession, index: cascade.Index, threshold: float, web: Path | None = None):
    status = cascade.index_status(index).first().asDict() | {"threshold": threshold}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            parts = urlsplit(self.path)
            asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
            try:
                if parts.path == "/api/status":
                    self.answer(200, status)
                elif parts.path != "/api/search":
                    code, file = static_file(web, parts.path)
                    if file is None:
                        self.answer(code, {"error": "forbidden" if code == 403 else "not found"})
                    else:
                        self.send(code, file.read_bytes(), mimetypes.guess_type(file.name)[0] or "application/octet-stream")
                elif not asked.get("q", "").strip():
                    self.answer(400, {"error": "q is empty"})
                else:
                    self.answer(200, payloads(spark, index, [asked["q"].strip()], *asked_numbers(spark, asked, threshold))[0])
            except Exception as e:  # an answer, not a dropped connection
                self.answer(500, {"error": str(e)[:500]})

        def answer(self, code: int, body: dict) -> None:
            self.send(code, json.dumps(body, ensure_ascii=False).encode(), "application/json; charset=utf-8")

        def send(self, code: int, raw: bytes, kind: str) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args) -> None:
            pass

    return Handler


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nameloom")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *needed: [c := sub.add_parser(name), *[c.add_argument(f"--{n}", required=True) for n in needed]][0]
    build = add("build", "entities", "index")
    build.add_argument("--backend", default="auto", help=f"auto, char-ngram, {embedders.TRANSFORMER} or one of {', '.join(cascade.BACKENDS)}")
    build.add_argument("--model")
    for name, k in (("query", 5), ("eval", 3)):
        c = add(name, "index")
        c.add_argument("text", nargs="*") if name == "query" else c.add_argument("--query", action="append", dest="text")
        c.add_argument("--top-k", type=int, default=k)
        c.add_argument("--threshold", type=float, default=cascade.THRESHOLD)
        c.add_argument("--format", choices=("table", "json"), default="table")
    e = add("evaluate", "entities", "queries", "output")
    e.add_argument("--backends", nargs="+", default=["auto"])
    e.add_argument("--candidate-mode", choices=("canonical", "all-names"), default="canonical")
    e.add_argument("--top-k", type=int, default=evaluation.EVAL_TOP_K)
    r = add("report", "entities", "index", "output")
    r.add_argument("--document", help="also one JSON file with summary, misses and cases")
    c = add("crawl", "pages", "start-url", "output")
    c.add_argument("--max-pages", type=int, default=20)
    add("aliases", "index", "output")
    t = add("training", "entities", "triplets", "queries")
    for name, kind, value in (("entity-ratio", float, 0.2), ("alias-ratio", float, 0.4), ("max-pairs", int, 8), ("max-queries", int, 4), ("seed", int, 13)):
        t.add_argument(f"--{name}", type=kind, default=value)
    add("merge", "base", "candidates", "output")
    s = add("serve", "index")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    s.add_argument("--threshold", type=float, default=cascade.THRESHOLD)
    s.add_argument("--web", help="folder of static files")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("nameloom").getOrCreate()
    if a.command == "build":
        index = cascade.build_index(jsonl.read_entities(spark, a.entities), embedders.choose(a.backend, a.model))
        index_store.save(index, a.index)
        print(json.dumps(cascade.index_status(index_store.load(spark, a.index)).first().asDict()))
    elif a.command in ("query", "eval"):
        index = index_store.load(spark, a.index)
        texts = list(a.text or PROBES)
        find = cascade.retrieve if a.command == "query" else cascade.retrieve_by_vectors
        print(show(payloads(spark, index, texts, a.top_k, a.threshold, find), a.format))
    elif a.command == "evaluate":
        fields = T.StructType([T.StructField(n, T.StringType()) for n in EVAL_COLUMNS])
        asked = jsonl.read_jsonl(spark, a.queries, fields)
        report = evaluation_report(spark, jsonl.read_entities(spark, a.entities), asked, [embedders.choose(b) for b in a.backends], a.candidate_mode, a.top_k)
        write_document(a.output, report)
        for r in report:
            print(r["model"])
            for bucket, m in r["summary"].items():
                print(f"  {bucket}: top1={m['top1_accuracy']:.4f} top3={m['top3_recall']:.4f} mrr={m['mrr']:.4f} n={m['count']}")
    elif a.command == "crawl":
        pages = spark.read.parquet(a.pages) if a.pages.rstrip("/").endswith(".parquet") else jsonl.read_bare(spark, a.pages)
        pages = pages if "page_id" in pages.columns else pages.withColumn("page_id", F.xxhash64("url"))
        jsonl.write_jsonl(catalogue.crawl(pages, a.start_url, a.max_pages), a.output, "ord")
    elif a.command == "aliases":
        index_store.save_alias_json(index_store.load(spark, a.index).aliases, a.output)
    elif a.command == "report":
        entities = jsonl.read_entities(spark, a.entities)
        report = cascade.recall_report(entities, index_store.load(spark, a.index))
        report = written(report, "recall-report")
        cases = cascade.recall_cases(report)
        jsonl.write_jsonl(cases.drop("ent_ord", "pos"), a.output)
        summary = cascade.recall_summary(report).first().asDict()
        if a.document:
            rows = [{k: v for k, v in r.asDict(recursive=True).items() if k not in ("ent_ord", "pos")} for r in cases.orderBy("ent_ord", "pos").collect()]
            write_document(a.document, {"summary": summary | {"misses": [r for r in rows if not r["hit_top1"]]}, "cases": rows})
        print(json.dumps(summary))
    elif a.command == "training":
        split = training.split_entities(jsonl.read_entities(spark, a.entities), a.entity_ratio, a.seed)
        train, held = split.where("not is_eval"), split.where("is_eval")
        out = training.alias_holdouts(train, a.alias_ratio, a.seed)
        jsonl.write_jsonl(training.training_triplets(train, out, a.max_pairs).drop("ent_ord", "name_ord"), a.triplets)
        jsonl.write_jsonl(training.evaluation_queries(train, held, out, a.max_queries), a.queries)
    elif a.command == "merge":
        base, new = (jsonl.read_entities(spark, x).withColumnRenamed("ent_ord", "ord") for x in (a.base, a.candidates))
        jsonl.write_jsonl(catalogue.merge(base, new).withColumn("at", F.struct("is_new", "ord")).drop("is_new", "ord"), a.output, "at")
    else:
        ThreadingHTTPServer((a.host, a.port), handler(spark, index_store.load(spark, a.index), a.threshold, Path(a.web) if a.web else None)).serve_forever()


if __name__ == "__main__":
    main()
