"""``python -m docloom.server --tables DIR``: the answers of ``operators.services`` over HTTP, as JSON.

GET /templates, /coverage/CODE, /mappings/PATH, /violations, /health; POST /review with a
bearer token (from the environment variable DOCLOOM_TOKEN). A review is answered and handed to
``decide``; by default it is appended to the table of decisions, which a batch job applies.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import services

MOST_BODY = 1 << 16  # bytes of a review


class Application:
    """The tables, and an answer (status, value) for each request."""

    def __init__(self, spark: SparkSession, tables: str, secret: str | None, decide: Callable[[dict], None] | None = None):
        self.spark, self.folder, self.secret = spark, tables.rstrip("/"), secret
        self.decide = decide or self._append

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _append(self, decision: dict) -> None:
        self.spark.createDataFrame([tuple(decision.values())], "mapping_id long, approve boolean, confidence double, notes string").write.mode("append").parquet(f"{self.folder}/decisions.parquet")

    def get(self, path: str, query: dict[str, str]) -> tuple[int, object]:
        head, _, rest = path.strip("/").partition("/")
        rows = lambda df: [r.asDict(recursive=True) for r in df.limit(services.MOST_LIMIT).collect()]
        try:
            if head == "templates" and not rest and "after" in query:  # by cursor: empty for the first page
                x = services.templates_of(self.table("mapping"), query.get("standard"), float(query.get("min_confidence", 0)))
                page, following = services.page_after(x, services.BY_CONFIDENCE, int(query.get("limit", services.LIMIT)), query["after"])
                return 200, {"items": [r.asDict(recursive=True) for r in page], "next": following}
            if head == "templates" and not rest:
                return 200, rows(services.templates(self.table("mapping"), query.get("standard"), float(query.get("min_confidence", 0)), int(query.get("limit", services.LIMIT)), int(query.get("offset", 0))))
            if head == "coverage" and rest:
                return 200, services.coverage(self.table("mapping"), rest).first().asDict()
            if head == "mappings" and rest:
                found = rows(services.mappings_of(self.table("mapping"), rest))
                return (200, found) if found else (404, f"no mappings of {rest}")
            if head == "violations" and not rest:
                try:
                    found = self.table("template_violations")
                except Exception:  # there is no such table
                    found = None
                return 200, rows(services.violations(found, self.spark, query.get("severity")))
            if head == "health" and not rest:
                m = self.table("mapping").agg(F.count(F.lit(1)).alias("total_mappings"), F.count_if(F.col("confidence").isNull()).alias("null_confidence"))
                return 200, {"status": "ok", **m.first().asDict()}
        except services.QueryError as e:
            return 404, str(e)
        except ValueError as e:
            return 422, str(e)
        return 404, f"nothing at {path}"

    def post(self, path: str, body: bytes, token: str | None) -> tuple[int, object]:
        if path.strip("/") != "review":
            return 404, f"nothing at {path}"
        try:
            services.allowed(token, self.secret)
            x = json.loads(body)
            decision = {"mapping_id": int(x["mapping_id"]), "approve": bool(x["approved"]), "confidence": None if x.get("confidence_override") is None else float(x["confidence_override"]), "notes": x.get("notes")}
        except PermissionError as e:
            return 401, str(e)
        except (ValueError, KeyError, TypeError) as e:
            return 422, f"bad review: {e}"
        row = self.table("mapping").filter(F.col("id") == decision["mapping_id"]).select("confidence").first()
        if row is None:
            return 404, f"no mapping {decision['mapping_id']}"
        self.decide(decision)
        if not decision["approve"]:
            return 200, {"mapping_id": decision["mapping_id"], "action": "rejected", "new_confidence": None, "new_match_reason": None}
        new = decision["confidence"] if decision["confidence"] is not None else max(row.confidence or 0.0, 0.8)
        return 200, {"mapping_id": decision["mapping_id"], "action": "approved", "new_confidence": new, "new_match_reason": "expert_reviewed"}


def serve(app: Application, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't running yet; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, value: object) -> None:
            data = json.dumps(value if status == 200 else {"detail": value}, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            self._answer(*app.get(unquote(url.path), {k: v[-1] for k, v in parse_qs(url.query).items()}))

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY:
                return self._answer(413, "too long")
            token = (self.headers.get("Authorization") or "").removeprefix("Bearer ")
            self._answer(*app.post(urlsplit(self.path).path, self.rfile.read(size), token))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    p = argparse.ArgumentParser(prog="docloom.server")
    p.add_argument("--tables", required=True)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    args = p.parse_args()
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    serve(Application(spark, args.tables, os.environ.get("DOCLOOM_TOKEN")), args.host, args.port).serve_forever()


if __name__ == "__main__":
    main()
