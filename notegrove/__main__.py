"""Command line: python -m notegrove VAULT COMMAND [ARGS]."""

from __future__ import annotations

import argparse
import json
import sys

from .engine import VaultEngine, json_rows
from .index import SavedVault, save_embeddings
from .lsp import language_server
from .operators import diagnostics
from .session import session
from .sources import vault
from .streaming import watch
from .tools import call, serve


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="notegrove")
    p.add_argument("vault")
    p.add_argument("command", choices=["index", "search", "note", "backlinks", "stats", "orphans", "wanted", "path", "check", "graph-rag", "moc", "similar", "tools", "graph-stats", "topology-train", "serve", "watch", "lsp"])
    p.add_argument("args", nargs="*")
    p.add_argument("--out", help="moc: folder for the pages; topology-train: folder for the vectors")
    p.add_argument("--index", help="folder of the saved tables: index and watch bring it up to date, the rest reads it")
    p.add_argument("--full", action="store_true", help="index: every file, changed or not")
    p.add_argument("--events", help="watch: folder of JSON lines with path, kind and ts")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--tag")
    p.add_argument("--strict", action="store_true")
    a = p.parse_args(argv)
    spark = session(master="local[*]")
    if a.index and a.command in ("index", "watch"):
        kept = SavedVault(spark, a.index)
        if a.command == "watch":
            actions = watch.settled(vault.file_events(spark, a.events))
            watch.sync(actions.filter(vault.is_watched()), kept.applier(a.vault), f"{a.index}/checkpoint").awaitTermination()
            return 0
        print(json.dumps({r["action"]: r["count"] for r in kept.refresh(a.vault, a.full).groupBy("action").count().collect()}))
        return 0
    e = VaultEngine.saved(spark, a.index) if a.index else VaultEngine.open(spark, a.vault)
    if a.command == "index":
        answer = json_rows(e.stats())[0]
    elif a.command == "graph-stats":
        answer = e.graph_stats()
    elif a.command == "topology-train":
        save_embeddings(e.topology(), "node2vec", a.out)
        answer = {"saved": a.out}
    elif a.command == "serve":
        serve(e, a.port).serve_forever()
    elif a.command == "lsp":
        return language_server(e, sys.stdin.buffer, sys.stdout.buffer)
    elif a.command == "search":
        answer = json_rows(e.search(a.args[0], a.limit, a.tag))
    elif a.command == "note":
        answer = {k: json_rows(v) for k, v in (e.note(a.args[0]) or {}).items()}
    elif a.command == "check":
        found = e.check(a.strict)
        print(json.dumps(json_rows(found)))
        return diagnostics.exit_code(found, a.strict)
    elif a.command == "path":
        answer = e.path(*a.args[:2])
    elif a.command == "graph-rag":
        print(e.graph_rag(a.args)["markdown"])
        return 0
    elif a.command == "moc":
        answer = e.moc(a.args[0] if a.args else None, a.out)
    elif a.command == "tools":
        for line in sys.stdin:
            if (out := call(e, line)) is not None:
                print(out, flush=True)
        return 0
    else:
        answer = json_rows({"backlinks": lambda: e.backlinks(a.args[0]), "stats": e.stats, "orphans": e.orphans, "wanted": e.wanted, "similar": lambda: e.similar(a.args[0], a.limit)}[a.command]())
    print(json.dumps(answer))
    return 0


if __name__ == "__main__":
    sys.exit(main())
