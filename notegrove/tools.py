"""Tools over line-delimited JSON-RPC, and the same answers by HTTP path."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, unquote_plus, urlsplit

from .engine import VaultEngine, json_rows

TOOLS = {
    "search": lambda e, a: json_rows(e.search(a["query"], int(a.get("limit", 20)), a.get("tag"))),
    "get_note": lambda e, a: {k: json_rows(v) for k, v in (e.note(a["note"]) or {}).items()} or None,
    "backlinks": lambda e, a: json_rows(e.backlinks(a["note"])),
    "graph_neighbors": lambda e, a: json_rows(e.neighbours(a["note"], int(a.get("depth", 1)))),
    "unresolved_links": lambda e, a: json_rows(e.unresolved()),
    "stats": lambda e, a: json_rows(e.stats())[0],
    "graph_rag": lambda e, a: e.graph_rag(a["seeds"], int(a.get("hops", 3)), int(a.get("paths", 15)))["markdown"],
    "generate_moc": lambda e, a: e.moc(a.get("topic")),
}


def _schema(required: dict[str, str], optional: dict[str, str] | None = None) -> dict:
    kinds = {"strings": {"type": "array", "items": {"type": "string"}}}
    fields = {n: kinds.get(k, {"type": k}) for n, k in (required | (optional or {})).items()}
    return {"type": "object", "properties": fields, "required": list(required)}


SCHEMAS = {
    "search": ("Notes by words, the best first", _schema({"query": "string"}, {"limit": "integer", "tag": "string"})),
    "get_note": ("A note with its sections and links", _schema({"note": "string"})),
    "backlinks": ("Links to a note", _schema({"note": "string"})),
    "graph_neighbors": ("Notes within some links of a note", _schema({"note": "string"}, {"depth": "integer"})),
    "unresolved_links": ("Links to notes that don't exist", _schema({})),
    "stats": ("Counts of notes, links and tags", _schema({})),
    "graph_rag": ("Context for some notes: paths, a tree, and the notes on them", _schema({"seeds": "strings"}, {"hops": "integer", "paths": "integer"})),
    "generate_moc": ("Maps of content for one topic or all", _schema({}, {"topic": "string"})),
}


def call(engine: VaultEngine, message: str) -> str | None:
    """The answer to one JSON-RPC message; None for notifications."""
    number = None
    try:
        request = json.loads(message)
        number, method, params = request.get("id"), request["method"], request.get("params") or {}
    except (ValueError, KeyError, AttributeError):
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32700, "message": "parse error"}})
    if method.startswith("notifications/"):
        return None
    if method == "initialize":
        result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "notegrove", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": what, "inputSchema": schema} for n, (what, schema) in SCHEMAS.items()]}
    elif method == "tools/call":
        try:
            answer = TOOLS[params["name"]](engine, params.get("arguments") or {})
            result = {"content": [{"type": "text", "text": answer if isinstance(answer, str) else json.dumps(answer)}]}
        except Exception as e:  # the protocol answers any failure of a tool
            return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32000, "message": str(e)[:500]}})
    else:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method}"}})
    return json.dumps({"jsonrpc": "2.0", "id": number, "result": result})


def http(engine: VaultEngine, url: str) -> tuple[int, str]:
    """Status and JSON of the API's paths."""
    parts = urlsplit(url)
    arg = {k: unquote_plus(v[0]) for k, v in parse_qs(parts.query).items()}
    if parts.path == "/api/graph":
        return 200, engine.d3()
    routes = {
        "/api/stats": ("stats", arg), "/api/backlinks": ("backlinks", {"note": arg.get("note", "")}),
        "/api/note": ("get_note", {"note": arg.get("id", arg.get("note", ""))}), "/api/search": ("search", {"query": arg.get("q", ""), "limit": 20}),
    }
    if parts.path not in routes:
        return 404, json.dumps({"error": "not found"})
    name, args = routes[parts.path]
    return 200, json.dumps(TOOLS[name](engine, args))


def serve(engine: VaultEngine, port: int = 8080, host: str = "127.0.0.1"):
    """An HTTP server for the API's paths, to be started by serve_forever()."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802  the base class's name
            try:
                status, body = http(engine, self.path)
            except Exception as e:  # a failed query is an answer too
                status, body = 500, json.dumps({"error": str(e)[:500]})
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
