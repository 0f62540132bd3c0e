"""Two status routes over the standard library's server: ``GET /`` and ``GET /health``."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from papyrine import __version__


def status() -> dict:
    return {"status": "running", "project": "papyrine", "version": __version__}


def health(spark: SparkSession | None) -> dict:
    """Healthy if the session answers a query."""
    try:
        ok = spark is not None and spark.sql("select 1").first()[0] == 1
    except Exception:
        ok = False
    return {"status": "healthy" if ok else "unhealthy"}


def server(spark: SparkSession | None, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = {"/": status, "/health": lambda: health(spark)}.get(self.path)
            body = json.dumps(found() if found else {"detail": "not found"}).encode()
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
