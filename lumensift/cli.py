"""Command line: init, open, info, stats, compact, delete, add, add-dir, import, parse-log, delete-doc, list, search, count, terms, similarity, serve, version."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .operators import search as s
from .sources.files import import_json, read_files
from .sources.logs import read_logs
from .sources.storage import Store

VERSION = "1.0.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumensift")
    p.add_argument("--index", default="./index")
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--verbose", "-v", action="store_true")
    p.add_argument("--analyzer", choices=("standard", "ram"), default="standard")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("version", "init", "open", "info", "stats", "compact", "delete"):
        sub.add_parser(name)
    add = sub.add_parser("add")
    add.add_argument("path")
    add.add_argument("-r", "--recursive", action="store_true")
    for name in ("add-dir", "import"):
        sub.add_parser(name).add_argument("path")
    log = sub.add_parser("parse-log")
    log.add_argument("path")
    log.add_argument("--log-format", default="auto")
    sub.add_parser("delete-doc").add_argument("id", type=int)
    sub.add_parser("list").add_argument("-n", type=int, default=100)
    q = sub.add_parser("search")
    q.add_argument("query")
    q.add_argument("--from", dest="start", type=int, default=0)
    q.add_argument("--size", "-n", type=int, default=s.DEFAULT_SIZE)
    q.add_argument("-o", "--output", choices=("text", "json"), default="text")
    q.add_argument("--agg")
    q.add_argument("--group")
    sub.add_parser("count").add_argument("query")
    t = sub.add_parser("terms")
    t.add_argument("-p", "--prefix", default="")
    t.add_argument("-n", type=int, default=100)
    sub.add_parser("similarity").add_argument("name", nargs="?", default="bm25", choices=("bm25", "bm25l", "tfidf"))
    sub.add_parser("serve").add_argument("--port", type=int, default=8080)
    return p


def run(argv: list[str], spark: SparkSession | None = None) -> tuple[int, str]:
    """Exit code and output."""
    a = parser().parse_args(argv)
    if a.command == "version":
        return 0, f"lumensift {VERSION}"
    spark = spark or SparkSession.builder.appName("lumensift").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.index)
    try:
        return 0, _run(a, spark, store)
    except (ValueError, LookupError, OSError) as e:
        return 1, f"error: {e}"
    except AnalysisException as e:  # such as an input path that doesn't exist
        return 1, f"error: {str(e).splitlines()[0]}"


def _run(a, spark, store: Store) -> str:
    as_json = a.format == "json" or getattr(a, "output", "text") == "json"
    show = lambda d: json.dumps(d, ensure_ascii=False) if as_json else "\n".join(f"{k}: {v}" for k, v in d.items())
    if a.command == "init":
        store.create()
        return show({"created": store.path})
    if a.command in ("open", "info"):
        return show(store.info())
    if a.command == "delete":
        store.drop()
        return show({"deleted": store.path})
    if a.command == "compact":
        return show({"compacted": store.commit()})
    if a.command in ("add", "add-dir", "import", "parse-log"):
        store.create()
        skipped = 0
        if a.command == "import":
            docs = import_json(spark, a.path)
        elif a.command == "parse-log":
            docs = read_logs(spark, a.path, a.log_format)
            skipped = docs.where("NOT parsed").count()
            docs = docs.where("parsed").drop("parsed")
        else:
            docs = read_files(spark, a.path, a.command == "add-dir" or a.recursive)
        added = store.add(docs)
        store.commit()
        return show({"added": added, "skipped": skipped})
    if a.command == "delete-doc":
        store.delete([a.id])
        store.commit()
        return show({"deleted": a.id})
    index = store.index()
    if a.command == "stats":
        r = index.stats().first()
        return show(r.asDict() | {"first_terms": [x["term"] for x in index.terms(limit=10).collect()]})
    if a.command == "list":
        rows = [r.asDict() for r in s.listing(index, a.n).collect()]
        return json.dumps(rows, ensure_ascii=False) if as_json else "\n".join(f"[{r['doc_id']}] {r['summary']}" for r in rows)
    if a.command == "terms":
        rows = [r["term"] for r in index.terms(a.prefix, a.n).collect()]
        return show({"total": index.stats().first()["num_terms"], "shown": len(rows), "terms": rows})
    if a.command == "count":
        return show({"count": s.count(index, a.query).first()["count"]})
    if a.command == "similarity":
        return show({"similarity": index.with_similarity(a.name).similarity.name})
    if a.command == "serve":
        from .api import serve

        serve(store, a.port).serve_forever()
    rows = s.search(index, a.query, a.start, a.size).collect()  # one page
    out = {"results": [{"doc_id": r["doc_id"], "score": round(r["score"], 4), "summary": r["summary"], "highlight": r["highlight"].asDict() if r["highlight"] else None} for r in rows], "total": len(rows), "from": a.start, "size": a.size}
    if a.agg:
        out["count"] = s.aggregations(index, a.query, a.agg, None, a.start, a.size).first()["count"]
    if a.group:
        out["buckets"] = [r.asDict() for r in s.aggregations(index, a.query, None, a.group, a.start, a.size).collect()]
    if as_json:
        return json.dumps(out, ensure_ascii=False)
    lines = [f"[{i}] DocID={r['doc_id']} Score={r['score']:.4f} {r['summary']}" for i, r in enumerate(out["results"], a.start + 1)]
    return "\n".join(lines + [f"count: {out['count']}"] * ("count" in out) + [f"{b['key']}: {b['count']}" for b in out.get("buckets", [])])


def main() -> None:
    code, text = run(sys.argv[1:])
    print(text)
    sys.exit(code)


if __name__ == "__main__":
    main()
