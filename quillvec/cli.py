"""``python -m quillvec.cli``: import a data set, query, describe, evaluate and serve an index, keep an adapter config."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillvec")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("import-existing-index", help="build an index and a record snapshot from JSON lines or NPZ")
    a.add_argument("dataset")
    a.add_argument("path")
    a.add_argument("--format", default="auto")
    a.add_argument("--bits", type=int, default=3)
    a.add_argument("--shard-size", type=int, default=100_000)
    a.add_argument("--no-normalize", action="store_true")
    a.add_argument("--value-range", type=float, default=1.0)
    a = sub.add_parser("query")
    a.add_argument("path")
    a.add_argument("--vector", required=True, help="a JSON list")
    a.add_argument("--top-k", type=int, default=5)
    a.add_argument("--filters", help="a JSON object")
    a.add_argument("--mode", default="auto")
    a = sub.add_parser("describe-index")
    a.add_argument("path")
    a = sub.add_parser("benchmark", help="recall and reciprocal rank of query cases")
    a.add_argument("path")
    a.add_argument("cases")
    a.add_argument("--top-k", type=int, default=10)
    a.add_argument("--output")
    for name, told in (("serve", "answer requests over HTTP"), ("mcp", "answer tool calls on standard input and output")):
        a = sub.add_parser(name, help=told)
        a.add_argument("path")
        if name == "serve":
            a.add_argument("--host", default="127.0.0.1")
            a.add_argument("--port", type=int, default=8080)
            a.add_argument("--origin", action="append", default=[], help="an origin that browsers may call from")
    a = sub.add_parser("adapt", help="show, set or remove the adapter config of an index")
    a.add_argument("action", choices=["auto", "set", "show", "remove"])
    a.add_argument("path")
    a.add_argument("--backend")
    a.add_argument("--option", action="append", default=[], help="name=value")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> object:
    from quillvec.operators import evaluate, hydrate
    from quillvec.operators.index import VectorIndex
    from quillvec.service import Service
    from quillvec.sources import datasets

    if args.command == "import-existing-index":
        data = datasets.read_dataset(spark, args.dataset, args.format)
        index = datasets.build_sidecar(spark, data, args.path, args.bits, shard_size=args.shard_size, normalize=not args.no_normalize, value_range=args.value_range)
        return {"index_size": len(index), "path": args.path}
    if args.command == "query":
        index, records = datasets.open_sidecar(spark, args.path)
        hits = index.search(json.loads(args.vector), args.top_k, args.mode, json.loads(args.filters) if args.filters else None)
        rows = hits if records is None else hydrate.hydrate(hits, records)
        return [r.asDict() for r in rows.orderBy("rank").collect()]
    if args.command == "describe-index":
        index, records = datasets.open_sidecar(spark, args.path)
        return Service(index, records).describe()
    if args.command in ("serve", "mcp"):
        from quillvec import server

        index, records = datasets.open_sidecar(spark, args.path)
        service = Service(index, records, path=args.path)
        if args.command == "mcp":
            return server.serve_tools(service)
        return server.http_server(service, args.host, args.port, tuple(args.origin)).serve_forever()
    index = VectorIndex.open(spark, args.path)
    cases = datasets.read_cases(spark, args.cases)
    asked = cases.select("query_id", "query_vector").toPandas()
    search = lambda: index.search_batch(asked["query_vector"].tolist(), args.top_k, query_ids=asked["query_id"].tolist())
    hits, seconds = evaluate.timed(search)
    report = evaluate.report(hits, cases, seconds)
    if args.output:
        evaluate.write_artifact(report, args.output)
    return report.first().asDict()


def adapt(args: argparse.Namespace) -> object:
    import os

    from quillvec.sources import backends

    at = os.path.join(args.path, "adapter.json")
    if args.action == "remove":
        if os.path.exists(at):
            os.remove(at)
        return {"removed": at}
    if args.action == "show":
        with open(at) as f:
            return json.load(f)
    backend = backends.detect_environment() if args.action == "auto" else args.backend
    config = {"backend": backend, "options": dict(o.split("=", 1) for o in args.option)}
    backends.save_config(config, at)
    return config


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    out = adapt(args) if args.command == "adapt" else run(args, SparkSession.builder.appName("quillvec").getOrCreate())
    if out is not None:
        print(json.dumps(out, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
