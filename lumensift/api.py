"""HTTP-style facade over a stored index: each function takes parameters as text and returns (status, payload)."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import functions as F

from .operators import search as s
from .operators.index import Index
from .plans.parser import ParseError
from .sources.documents import float_field, present, text_field
from .sources.storage import Store


def _whole(text: str | None, default: int, low: int, high: int) -> int:
    value = default if text in (None, "") else int(text)
    if not low <= value <= high:
        raise ValueError(f"{value} is out of range")
    return value


class Api:
    def __init__(self, store: Store):
        self.store = store
        self.index: Index = store.index().cache()

    def search(self, p: dict[str, str]) -> tuple[int, dict]:
        try:
            start, size = _whole(p.get("from"), 0, 0, 1 << 31), _whole(p.get("size"), s.DEFAULT_SIZE, 1, s.MAX_SIZE)
            fields = s.field_list(p.get("fields", ""))
            q = p.get("q", "")
            if not q.strip():
                return 400, {"error": "q is needed"}
            s.as_query(self.index, q)
            rows = [json.loads(x) for x in s.search(self.index, q, start, size, s.flag(p.get("include_doc")), fields).toJSON().collect()]  # one page
            out = {"total": len(rows), "total_returned": len(rows), "from": start, "size": size, "results": rows}
            if p.get("agg") or p.get("group"):
                out["aggregations"] = {}
                if p.get("agg"):
                    out["aggregations"]["count"] = s.aggregations(self.index, q, p["agg"], None, start, size).first()["count"]
                if p.get("group"):
                    buckets = s.aggregations(self.index, q, None, p["group"], start, size).collect()  # at most a page of rows
                    out["aggregations"]["buckets"] = [{"key": r["key"], "count": r["count"]} for r in buckets]
            return 200, out
        except (ParseError, ValueError) as e:
            return 400, {"error": str(e)}
        except LookupError as e:
            return 500, {"error": str(e)}

    def doc(self, doc_id: str) -> tuple[int, dict]:
        try:
            row = self.index.get(int(doc_id)).select(F.to_json(F.struct("doc_id", "ext_id", "boost", "fields"))).first()
        except ValueError:
            return 400, {"error": "the id must be a whole number"}
        return (200, json.loads(row[0])) if row else (404, {"error": "no such document"})

    def stats(self) -> tuple[int, dict]:
        return 200, self.index.stats().first().asDict()

    def add(self, body: dict) -> tuple[int, dict]:
        fields = body.get("fields")
        if not isinstance(fields, dict):
            return 400, {"error": "fields is needed"}
        spark = self.store.spark
        made = [text_field(k, F.lit(v)) if isinstance(v, str) else float_field(k, F.lit(float(v))) for k, v in fields.items() if isinstance(v, (str, int, float)) and not isinstance(v, bool)]
        self.store.add(spark.range(1).select(F.lit(body.get("id")).cast("string").alias("ext_id"), present(*made).alias("fields")))
        self._reload()
        return 200, {"id": self.store.manifest()["last_id"]}

    def delete(self, doc_id: str) -> tuple[int, dict]:
        try:
            n = int(doc_id)
        except ValueError:
            return 400, {"error": "the id must be a whole number"}
        if not self.index.exists(n):
            return 404, {"error": "no such document"}
        self.store.delete([n])
        self._reload()
        return 200, {"deleted": n}

    def _reload(self) -> None:
        self.store.commit()
        self.index.close()
        self.index = self.store.index().cache()

    def handle(self, method: str, url: str, body: bytes = b"") -> tuple[int, dict]:
        parts = urlsplit(url)
        p = dict(parse_qsl(parts.query))
        path = parts.path
        if method == "GET" and path == "/":
            return 200, {"name": "lumensift", "endpoints": ["GET /search", "GET /doc/<id>", "GET /stats", "POST /add", "DELETE /delete?id="]}
        if method == "GET" and path == "/search":
            return self.search(p)
        if method == "GET" and path.startswith("/doc/"):
            return self.doc(path[5:])
        if method == "GET" and path == "/stats":
            return self.stats()
        if method == "POST" and path == "/add":
            try:
                return self.add(json.loads(body))
            except (json.JSONDecodeError, AttributeError):
                return 400, {"error": "the body must be a JSON object"}
        if method == "DELETE" and path == "/delete":
            return self.delete(p.get("id", ""))
        return 404, {"error": "no such endpoint"}


def serve(store: Store, port: int = 8080) -> ThreadingHTTPServer:
    api = Api(store)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, payload = (204, {}) if self.command == "OPTIONS" else api.handle(self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            for k, v in (("Origin", "*"), ("Methods", "GET, POST, DELETE, OPTIONS"), ("Headers", "Content-Type")):
                self.send_header(f"Access-Control-Allow-{k}", v)
            self.end_headers()
            self.wfile.write(b"" if status == 204 else json.dumps(payload, ensure_ascii=False).encode())

        do_GET = do_POST = do_DELETE = do_OPTIONS = _answer

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
