"""A language server over one vault: open documents, completion, definition, hover, and findings of the link lint."""

from __future__ import annotations

import json
from typing import BinaryIO

from pyspark.sql import functions as F

from .engine import VaultEngine, json_rows
from .functions.security import path_of, uri_of
from .operators import catalogue, diagnostics, markdown

#: Document changes come whole; completion starts after these characters.
CAPABILITIES = {"textDocumentSync": 1, "completionProvider": {"triggerCharacters": ["[", "#"]}, "definitionProvider": True, "hoverProvider": True}
SEVERITY = {"error": 1, "warning": 2}


def read_message(source: BinaryIO) -> dict | None:
    """The next message; None at the end of the input."""
    size = None
    while (line := source.readline()) not in (b"\r\n", b"\n"):
        if not line:
            return None
        name, _, value = line.decode("ascii", "replace").partition(":")
        if name.strip().lower() == "content-length":
            size = int(value)
    return json.loads(source.read(size or 0))


def write_message(sink: BinaryIO, message: dict) -> None:
    body = json.dumps({"jsonrpc": "2.0"} | message).encode()
    sink.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    sink.flush()


def link_at(line: str, character: int) -> tuple[str, str | None] | None:
    """Note and heading of the link that a place in a line is in."""
    start = line.rfind("[[", 0, character + 2)
    end = line.find("]]", start)
    if start < 0 or end < character - 1:
        return None
    found = markdown.wikilinks(line[start : end + 2])
    return (found[0][1], found[0][2]) if found else None


class Server:
    def __init__(self, engine: VaultEngine, root: str = ""):
        self.engine, self.root, self.open = engine, root, {}

    def line(self, params: dict) -> tuple[str, int]:
        at = params["position"]
        lines = self.open.get(params["textDocument"]["uri"], "").split("\n")
        return (lines[at["line"]] if at["line"] < len(lines) else ""), at["character"]

    def findings(self, uri: str) -> list[dict]:
        """What the lint says of an open document as it stands, against the vault's other notes."""
        path = path_of(uri).removeprefix(self.root).lstrip("/")
        spark = self.engine.spark
        own = markdown.tables(markdown.parse(spark.createDataFrame([(path, self.open[uri])], "path string, content string")))
        rows = json_rows(diagnostics.lint(catalogue.upserted(self.engine.tables, own)).filter(F.col("doc_id") == path))
        place = lambda r: {"start": {"line": r["line"] - 1, "character": 0}, "end": {"line": r["line"] - 1, "character": r["col_end"]}}
        return [{"range": place(r), "severity": SEVERITY[r["severity"]], "code": r["code"], "source": "notegrove", "message": f"{r['title']}: {r['target']}"} for r in rows]

    def answer(self, method: str, params: dict):
        if method == "initialize":
            self.root = path_of(params.get("rootUri") or self.root)
            return {"capabilities": CAPABILITIES, "serverInfo": {"name": "notegrove"}}
        if method == "textDocument/completion":
            line, character = self.line(params)
            return [{"label": r["label"], "insertText": r["insert"]} for r in json_rows(self.engine.completion(line[:character]))]
        if method in ("textDocument/definition", "textDocument/hover"):
            if (asked := link_at(*self.line(params))) is None:
                return None
            if method.endswith("hover"):
                text = self.engine.hover(*asked)
                return {"contents": {"kind": "markdown", "value": text}} if text is not None else None
            if (found := self.engine.definition(*asked)) is None:
                return None
            spot = {"line": found["line"], "character": 0}
            return {"uri": uri_of(f"{self.root.rstrip('/')}/{found['path']}"), "range": {"start": spot, "end": spot}}
        return None

    def handle(self, message: dict) -> list[dict]:
        """The messages that one message is answered with."""
        method, params, number = message.get("method", ""), message.get("params") or {}, message.get("id")
        if method in ("textDocument/didOpen", "textDocument/didChange"):
            document = params["textDocument"]
            self.open[document["uri"]] = document["text"] if method.endswith("Open") else params["contentChanges"][-1]["text"]
            return [{"method": "textDocument/publishDiagnostics", "params": {"uri": document["uri"], "diagnostics": self.findings(document["uri"])}}]
        if method == "textDocument/didClose":
            self.open.pop(params["textDocument"]["uri"], None)
            return []
        if number is None:
            return []
        try:
            return [{"id": number, "result": self.answer(method, params)}]
        except Exception as e:  # the protocol answers any failure
            return [{"id": number, "error": {"code": -32603, "message": str(e)[:500]}}]


def language_server(engine: VaultEngine, source: BinaryIO, sink: BinaryIO) -> int:
    """Serve until the client says exit or goes away; 0 after a shutdown request."""
    server, asked = Server(engine), False
    while (message := read_message(source)) is not None and message.get("method") != "exit":
        asked |= message.get("method") == "shutdown"
        for out in server.handle(message):
            write_message(sink, out)
    return int(not asked)
