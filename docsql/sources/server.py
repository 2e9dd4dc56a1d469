"""A small HTTP endpoint: GET or POST /sql and /sql/explain, with the statement as `sql`, in a JSON body or as the body."""

from __future__ import annotations

import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from urllib.parse import parse_qs, urlsplit


def _error(e: Exception) -> str:
    return json.dumps({"error": type(e).__name__, "reason": str(e)})


def make_server(engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """format=csv gives CSV, with separator, quote, newLine, flat, showHeader, _id and _score; else the JSON envelope. Local by default."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self._answer("")

        def do_POST(self) -> None:
            self._answer(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode())

        def _answer(self, body: str) -> None:
            url = urlsplit(self.path)
            given = {k: v[-1] for k, v in parse_qs(url.query).items()}
            try:
                text = json.loads(body).get("sql") if body.lstrip().startswith("{") else body or given.get("sql", "")
                if url.path == "/sql/explain":
                    kind, parts = "text/plain", iter([engine.explain(text)])
                elif url.path != "/sql":
                    return self._send(404, "text/plain", iter(["no such path"]))
                elif given.get("format") == "csv":
                    end = given.get("newLine", "\n")
                    lines = engine.csv_parts(text, separator=given.get("separator", ","), quote=given.get("quote", '"'), flat=given.get("flat") == "true", show_header=given.get("showHeader", "true") == "true", with_id=given.get("_id") == "true", with_score=given.get("_score") == "true")
                    kind, parts = "text/csv", (end * (n > 0) + line for n, line in enumerate(lines))
                else:
                    kind, parts = "application/json", engine.json_parts(text)
                first = next(parts, "")
            except (ValueError, LookupError, TypeError, AttributeError) as e:
                return self._send(400, "application/json", iter([_error(e)]))
            except Exception as e:  # Spark's own errors
                return self._send(500, "application/json", iter([_error(e)]))
            self._send(200, kind, chain([first], parts))

        def _send(self, code: int, kind: str, parts: Iterator[str]) -> None:
            """The answer goes out piece by piece; the connection's end is its end."""
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Connection", "close")
            self.end_headers()
            for part in parts:
                self.wfile.write(part.encode())

        def log_message(self, *args) -> None: ...

    return ThreadingHTTPServer((host, port), Handler)
