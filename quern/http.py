"""The search page over HTTP: GET /?q=..."""

from __future__ import annotations

from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .plans.build import Index

_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>Search</title></head><body>
<form><input name="q" value="{query}" autofocus><button>Search</button></form>
{results}</body></html>"""


def render(query: str, rows: list[dict] | None) -> str:
    if rows is None:
        results = ""
    elif not rows:
        results = f"<p>No results for {escape(query)}</p>"
    else:
        items = "".join(f'<li><a href="{escape(r["url"], quote=True)}">{escape(r["url"])}</a> (document {r["doc_id"]}, score {r["score"]:.6f})</li>' for r in rows)
        results = f"<p>{len(rows)} results</p><ol>{items}</ol>"
    return _PAGE.format(query=escape(query, quote=True), results=results)


def respond(index: Index, target: str) -> tuple[int, str]:
    parts = urlsplit(target)
    if parts.path != "/":
        return 404, render("", None)
    query = (parse_qs(parts.query).get("q") or [""])[0].strip()
    if not query:
        return 200, render("", None)
    return 200, render(query, [r.asDict() for r in index.search(query).orderBy("rank").collect()])


def serve(index: Index, port: int = 5000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, page = respond(index, self.path)
            body = page.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
