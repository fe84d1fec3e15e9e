"""A small HTTP service and a command line over a stored index."""

from __future__ import annotations

import argparse
import html
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from quarrylight.operators.rank import query_term_stats
from quarrylight.plans.build import Index, build_index, open_index
from quarrylight.plans.search import SearchRequest, search
from quarrylight.sources.collection import read_tsv

PAGE = """<!doctype html><meta charset="utf-8"><title>Search</title>
<form onsubmit="go(event)"><input id="q" autofocus><select id="k"><option>5<option selected>10<option>20<option>30<option>50<option>100</select>
<label><input type="checkbox" id="all"> all words</label><button>Search</button></form><ol id="out"></ol>
<script>
const plain = s => { const d = document.createElement("div"); d.textContent = s; return d.innerHTML.replaceAll("&lt;b&gt;", "<b>").replaceAll("&lt;/b&gt;", "</b>") };
async function go(e) {
  e.preventDefault();
  const body = JSON.stringify({query: q.value, topk: +k.value, conjunctive: all.checked});
  const found = await (await fetch("/search", {method: "POST", body})).json();
  out.innerHTML = (found.results || []).map(r => `<li>${r.docID} (${r.score.toFixed(4)})<br>${r.snippets.map(plain).join("<br>")}`).join("");
}
</script>"""


def handler(index: Index) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Headers", "Content-Type")
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self) -> None:
            self._send(200, "")

        def do_GET(self) -> None:
            if self.path in ("/", "/index.html"):
                self._send(200, PAGE, "text/html")
            else:
                self._send(404, json.dumps({"error": "not found"}))

        def do_POST(self) -> None:
            if self.path != "/search":
                self._send(404, json.dumps({"error": "not found"}))
                return
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                query = str(asked.get("query") or "").strip()
                if not query:
                    self._send(400, json.dumps({"error": "empty query"}))
                    return
                self._send(200, json.dumps(search(index, SearchRequest(query, int(asked.get("topk", 10)), bool(asked.get("conjunctive", False)))), ensure_ascii=False))
            except Exception as e:  # the service goes on after a bad request
                self._send(500, json.dumps({"error": html.escape(str(e))[:500]}))

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve(index: Index, port: int = 8080) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("", port), handler(index))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarrylight")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index a file of tab-separated id and text")
    build.add_argument("collection")
    build.add_argument("index")
    build.add_argument("--block", type=int, default=128)
    build.add_argument("--max-docs", type=int)
    ask = commands.add_parser("search")
    ask.add_argument("index")
    ask.add_argument("terms", nargs="*")
    ask.add_argument("-k", type=int, default=10)
    ask.add_argument("--all", "-and", action="store_true", help="every term must occur")
    ask.add_argument("-v", nargs="?", const="", metavar="term", help="show how many documents each term has; a term after it belongs to the query")
    ask.add_argument("--raw", action="store_true", help="terms match as they stand")
    ask.add_argument("--k1", type=float, default=SearchRequest.k1)
    ask.add_argument("--b", type=float, default=SearchRequest.b)
    run = commands.add_parser("serve")
    run.add_argument("index")
    run.add_argument("--port", type=int, default=8080)
    a = parser.parse_args(args)
    if a.command == "search":
        a.terms += [a.v] if a.v else []
        if not a.terms:
            parser.error("no terms")
    spark = SparkSession.builder.appName("quarrylight").getOrCreate()
    if a.command == "build":
        build_index(spark, read_tsv(spark, a.collection, a.max_docs).select("doc_id", "text"), a.index, a.block)
        return
    index = open_index(spark, a.index)
    if a.command == "serve":
        serve(index, a.port).serve_forever()
    request = SearchRequest(" ".join(a.terms), a.k, a.all, not a.raw, a.k1, a.b)
    if a.v is not None:
        for r in query_term_stats(index.lexicon, request.terms()).collect():
            print(f"df[{r['term']}]={r['ft']}" if r["ft"] else f"{r['term']} is not in the lexicon")
    for n, r in enumerate(search(index, request)["results"], 1):
        print(f"{n:2}. doc={r['docID']} score={r['score']:.4f}")
        for s in r["snippets"]:
            print(f"    {s}")


if __name__ == "__main__":
    main()
