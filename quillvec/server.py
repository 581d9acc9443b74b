"""The service over HTTP, and as a tool server on standard input and output, with the standard library alone."""

from __future__ import annotations

import json
import sys
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, Any

from quillvec.errors import EngineError
from quillvec.service import Service

MOST_BYTES = 64 << 20
PROTOCOL = "2024-11-05"


class _Handler(BaseHTTPRequestHandler):
    service: Service
    origins: tuple[str, ...] = ()
    lock: threading.Lock

    def log_message(self, *_: Any) -> None:
        """Requests are counted by the service's metrics."""

    def _answer(self, status: int, body: Any) -> None:
        data = b"" if body is None else json.dumps(body, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.send_header("X-Request-Id", self.headers.get("X-Request-Id") or uuid.uuid4().hex[:8])
        origin = self.headers.get("Origin")
        if origin and (origin in self.origins or "*" in self.origins):
            self.send_header("Access-Control-Allow-Origin", origin)
            self.send_header("Access-Control-Allow-Headers", "Content-Type, X-Request-Id")
            self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
        self.end_headers()
        self.wfile.write(data)

    def do_OPTIONS(self) -> None:
        self._answer(204, None)

    def do_GET(self) -> None:
        s = self.service
        routes = {"/": s.describe, "/index": s.describe, "/health": s.health, "/metrics": s.metrics}
        self._run(routes, lambda f: f())

    def do_POST(self) -> None:
        s = self.service
        routes = {"/query": s.query, "/query/batch": s.query_batch, "/ingest": s.ingest, "/ingest-text": s.ingest_text}
        length = int(self.headers.get("Content-Length") or 0)
        if length > MOST_BYTES:
            self.close_connection = True
            return self._answer(413, {"detail": "the request is too large"})
        try:
            payload = json.loads(self.rfile.read(length))
        except ValueError:
            return self._answer(400, {"detail": "the request isn't JSON"})
        self._run(routes, lambda f: f(payload))

    def _run(self, routes: dict, call) -> None:
        f = routes.get(self.path.partition("?")[0].rstrip("/") or "/")
        if f is None:
            return self._answer(404, {"detail": "no such path"})
        try:
            self._answer(200, call(f))
        except (EngineError, ValueError) as e:
            self._answer(400, {"detail": str(e)})
        except Exception as e:
            self._answer(500, {"detail": type(e).__name__})


def http_server(service: Service, host: str = "127.0.0.1", port: int = 8080, origins: tuple[str, ...] = ()) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; errors of a request are answered with status 400."""
    return ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"service": service, "origins": tuple(origins)}))


_NUMBERS = {"type": "array", "items": {"type": "number"}}
TOOLS = [
    {"name": "query", "description": "The chunks nearest to a vector or a text, with their scores.", "inputSchema": {"type": "object", "properties": {"query_vector": _NUMBERS, "query_text": {"type": "string"}, "top_k": {"type": "integer"}, "filters": {"type": "object"}}}},
    {"name": "describe", "description": "Size and configuration of the index.", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "ingest", "description": "Adds records; those without id, text or embedding are passed over.", "inputSchema": {"type": "object", "properties": {"records": {"type": "array", "items": {"type": "object"}}}, "required": ["records"]}},
]


def call_tool(service: Service, name: str, arguments: dict) -> Any:
    if name == "query":
        return service.query(arguments)
    if name == "describe":
        return service.describe()
    if name == "ingest":
        given = arguments.get("records") or []
        good = [r for r in given if isinstance(r, dict) and r.get("chunk_id") and r.get("text") and r.get("embedding")]
        if not good:
            raise ValueError("no valid record to ingest")
        return {**service.ingest({"records": good}), "skipped": len(given) - len(good)}
    raise ValueError(f"unknown tool: {name}")


def answer(service: Service, message: dict) -> dict | None:
    """The reply to one JSON-RPC message; a notification has none."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        reply["result"] = {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillvec", "version": "1"}}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": TOOLS}
    elif method == "tools/call":
        try:
            text, failed = json.dumps(call_tool(service, params.get("name", ""), params.get("arguments") or {}), default=str), False
        except (EngineError, ValueError) as e:
            text, failed = f"Error: {e}", True
        reply["result"] = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        reply["error"] = {"code": -32601, "message": f"no method {method}"}
    return reply


def serve_tools(service: Service, source: IO[str] = sys.stdin, target: IO[str] = sys.stdout) -> None:
    """Answer JSON-RPC messages, one a line, until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            reply = answer(service, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        if reply is not None:
            target.write(json.dumps(reply) + "\n")
            target.flush()
