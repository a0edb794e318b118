"""A small HTML front: form, result pages, documents.  Spark answers; this only lays out at most a page of rows."""

from __future__ import annotations

from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from math import exp, log
from urllib.parse import parse_qs, quote_plus, urlsplit

from pyspark.sql import DataFrame

from corploom.operators import search
from corploom.operators.index import Index

FORM = '<form action="/search"><input name="q" value="{q}" size="60"><button>Search</button></form>'


def home() -> str:
    return FORM.format(q="")


def results(ix: Index, q: str, page: str = "1", corpus: DataFrame | None = None) -> str:
    """The result page; a page that isn't a number raises ValueError, a blank query gets a message.

    With the corpus (docid, text) each result shows the sentences that have most of the query's words.
    """
    if not q.strip():
        return FORM.format(q="") + "<p>Empty query.</p>"
    p = search.page_of(search.find(ix, q.strip()), int(page))
    said = {} if corpus is None else {r["docid"]: r["snippet"] for r in search.snippets(corpus, q, [r["docid"] for r in p.rows]).collect()}
    item = lambda r: f'<li><a href="/doc/{r["docnum"]}">{escape(r["title"] or "")}</a> <small>{escape(r["docid"] or "")}</small>'
    items = "".join(item(r) + (f"<p>{escape(said[r['docid']])}</p>" if said.get(r["docid"]) else "") + "</li>" for r in p.rows)
    link = lambda n, text: f'<a href="/search?q={quote_plus(q)}&page={n}">{text}</a> '
    nav = (link(p.page - 1, "previous") if p.page > 1 else "") + (link(p.page + 1, "next") if p.page < p.pages else "")
    return FORM.format(q=escape(q)) + f"<p>{p.first}-{p.last} of {p.total}</p><ol start={p.first}>{items}</ol>{nav}"


def document(ix: Index, corpus: DataFrame, docnum: int) -> str | None:
    r = search.document(docnum, ix.forward, corpus).first()
    if r is None:
        return None
    return f"<h1>{escape(r['title'] or '')}</h1><p>{escape(r['docid'] or '')}</p><blockquote>{escape(r['snippet'] or '')}</blockquote><pre>{escape(r['text'] or '')}</pre>"


def plot_ranks(points: DataFrame, fit: dict, path: str) -> bool:
    """Ranks against document frequencies on logarithmic axes with the fitted line, as an image; False where no plotting library is installed."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    rows = points.orderBy("rank").collect()  # as many as the caller's bound on ranks
    axes = Figure().add_subplot()
    axes.loglog([r["rank"] for r in rows], [r["df"] for r in rows], ".")
    if rows and fit["slope"] is not None:
        axes.loglog([r["rank"] for r in rows], [exp(fit["intercept"] + fit["slope"] * log(r["rank"])) for r in rows])
    axes.figure.savefig(path)
    return True


def serve(ix: Index, corpus: DataFrame, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            args = {k: v[0] for k, v in parse_qs(url.query).items()}
            try:
                if url.path == "/":
                    status, body = 200, home()
                elif url.path == "/search":
                    status, body = 200, results(ix, args.get("q", ""), args.get("page", "1"), corpus)
                elif url.path.startswith("/doc/") and url.path[5:].isdigit() and (found := document(ix, corpus, int(url.path[5:]))):
                    status, body = 200, found
                else:
                    status, body = 404, "Not found"
            except ValueError as e:
                status, body = 500, escape(str(e))
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
