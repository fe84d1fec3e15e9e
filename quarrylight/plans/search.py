"""Searching a stored index, with snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scoring import K1, B
from quarrylight.operators import rank as ranking
from quarrylight.operators import snippets as snip
from quarrylight.plans.build import Index


@dataclass(frozen=True)
class SearchRequest:
    """A query and how to answer it. ``normalize`` cleans the terms as the index does; else they match as they stand."""

    query: str
    topk: int = 10
    conjunctive: bool = False
    normalize: bool = True
    k1: float = K1
    b: float = B

    def terms(self) -> list[str]:
        words = self.query.split()
        if not self.normalize:
            return words
        cleaned = (re.sub("[^A-Za-z0-9]", "", w).lower() for w in words)
        return [t for t in cleaned if t]


def hits(index: Index, request: SearchRequest) -> DataFrame:
    """(rank, doc_id, score)."""
    mode = ranking.AND if request.conjunctive else ranking.OR
    return ranking.rank(index.postings, index.lexicon, request.terms(), index.stats, mode, request.topk, request.k1, request.b)


def with_snippets(index: Index, found: DataFrame, words: list[str], windowsz: int = 50, per: int = 2) -> DataFrame:
    """(rank, doc_id, score, pos, snippet) of ranked hits, whose passages alone are read for snippets."""
    texts = index.passages.join(F.broadcast(found.select("doc_id")), "doc_id", "left_semi")  # at most k rows
    return found.join(snip.snippets(texts, words, windowsz, per), "doc_id", "left").select("rank", "doc_id", "score", "pos", "snippet")


def search(index: Index, request: SearchRequest, windowsz: int = 50, per: int = 2) -> dict:
    """{"query", "results": [{"docID", "score", "snippets"}], "count"}, best first."""
    rows = with_snippets(index, hits(index, request), snip.query_words(request.query), windowsz, per).collect()  # k * per rows
    results: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (r["rank"], r["pos"] or 0)):
        hit = results.setdefault(r["doc_id"], {"docID": r["doc_id"], "score": r["score"], "snippets": []})
        if r["snippet"] is not None:
            hit["snippets"].append(r["snippet"])
    return {"query": request.query, "results": list(results.values()), "count": len(results)}
