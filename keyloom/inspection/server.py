"""The inspection API over HTTP, with JSON bodies, and its client."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .inspect import Inspect


def handler(inspect: Inspect, prefix: str = "") -> type[BaseHTTPRequestHandler]:
    """Answers POST <prefix>/tables, /indexes, /entryFields and /query."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            if "application/json" not in self.headers.get("Content-Type", ""):
                return self._say(406, {"error": "the content type must be application/json"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                what = self.path.removeprefix(prefix).strip("/")
                if what == "tables":
                    out = inspect.tables()
                elif what == "indexes":
                    out = inspect.indexes(body["table"])
                elif what == "entryFields":
                    out = inspect.entry_fields(body["table"])
                elif what == "query":
                    out = inspect.query(body["table"], body.get("index") or "primary", body.get("indexSelector"), body.get("filter"), body.get("limit") or 0, body.get("after"))
                else:
                    return self._say(404, {"error": "not found"})
            except Exception as e:
                return self._say(500, {"error": str(e.args[0]) if e.args else str(e)})
            self._say(200, out)

        def do_GET(self):  # noqa: N802
            self._say(405, {"error": "use POST"})

        def _say(self, status: int, out) -> None:
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return Handler


def serve(inspect: Inspect, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, bound but not yet running: call its serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(inspect))


class Client:
    def __init__(self, url: str, headers: dict[str, str] | None = None, timeout: float = 15):
        self.url, self.headers, self.timeout = url.rstrip("/"), headers or {}, timeout

    def _ask(self, what: str, **body):
        request = urllib.request.Request(f"{self.url}/{what}", json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            raise RuntimeError(json.load(e)["error"]) from e

    def tables(self) -> list[str]:
        return self._ask("tables")

    def indexes(self, table: str) -> list[str]:
        return self._ask("indexes", table=table)

    def entry_fields(self, table: str) -> dict[str, str]:
        return self._ask("entryFields", table=table)

    def query(self, table: str, index: str = "primary", selector: dict | None = None, filter: dict | None = None, limit: int = 0, after: dict | None = None) -> list[dict]:
        return self._ask("query", table=table, index=index, indexSelector=selector, filter=filter, limit=limit, after=after)
