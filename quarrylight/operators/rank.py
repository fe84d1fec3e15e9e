"""Ranked retrieval over postings rows that carry their document's length."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.scoring import K1, B, Statistics, contribution
from quarrylight.storage import written

OR, AND = "or", "and"
#: Rows of query terms up to which they are broadcast, and the parts of a hot term beyond it.
MOST_ASKED, SALTS = 1 << 18, 64
#: Distinct terms of a batch up to which they are handed to the scan as a list; beyond it a join picks the rows.
MOST_LISTED = 1 << 14
#: Documents of a query's rarest term up to which AND skips to them, how many times as many the most frequent one must have, and
#: the ranges of ids that the scan is given.
SKIP_FROM, SKIP_TIMES, SKIP_RANGES = 4096, 128, 16


def _multiplicity(terms: list[str]) -> Column:
    """How often the row's term is in the query."""
    counts = Counter(terms)
    out = F.lit(None).cast("bigint")
    for t, n in counts.items():
        out = F.when(F.col("term") == t, F.lit(n).cast("bigint")).otherwise(out)
    return out


def matching(post: DataFrame, terms: list[str], mode: str = OR) -> DataFrame:
    """(doc_id) of documents with any, or all, of the terms; no terms match nothing."""
    docs = post.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count("*").alias("n"))  # a row per term and document
    return docs.where(F.col("n") == len(set(terms))).select("doc_id") if mode == AND else docs.select("doc_id")


def query_term_stats(lexicon: DataFrame, terms: list[str]) -> DataFrame:
    """(term, ft) of the query's distinct terms; 0 where the lexicon has none."""
    wanted = lexicon.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
    found = lexicon.where(F.col("term").isin(terms)).select("term", "ft")
    return wanted.join(found, "term", "left").select("term", F.coalesce("ft", F.lit(0)).cast("bigint").alias("ft"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(rank, doc_id, score): score to six places descending, then doc_id; shown to four. ``k`` under 1 gives no rows."""
    best = scored.withColumn("r6", F.round("score", 6)).orderBy(F.desc("r6"), "doc_id").limit(max(k, 0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("r6"), "doc_id"))  # at most k rows
    return best.select(rank.cast("int").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


def skip_ranges(ids: list[int], most: int = SKIP_RANGES) -> list[tuple[int, int]]:
    """Ranges that hold the ids, cut at the widest gaps between them."""
    ids = sorted(ids)
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: most - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def skipped_to(rows: DataFrame, rarest: str) -> DataFrame:
    """The rows of documents that have the rarest term, few enough to be listed. Ranges of their ids reach the scan, which passes
    over the row groups and pages of the other terms that hold none."""
    ids = [r["doc_id"] for r in rows.where(F.col("term") == rarest).select("doc_id").collect()]  # SKIP_FROM at most
    inside = F.lit(False)
    for low, high in skip_ranges(ids):
        inside = inside | F.col("doc_id").between(low, high)
    return rows.where(inside).where(F.col("doc_id").isin(ids))


def rank(post: DataFrame, lexicon: DataFrame, terms: list[str], stats: Statistics, mode: str = OR, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(rank, doc_id, score) of a bag of terms. A term given twice counts twice; AND asks for every distinct one.

    Only the rows of the query's terms are read, which the stored index has next to each other. The terms' frequencies come
    from the lexicon, a row per term. AND with a term that is rare beside another reads only where its documents are.
    """
    found = {r["term"]: r["ft"] for r in lexicon.where(F.col("term").isin(terms)).select("term", "ft").collect()} if terms else {}
    if not found or mode == AND and len(found) < len(set(terms)):
        return post.limit(0).select(F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score"))
    ft = F.lit(None).cast("bigint")
    for t, n in found.items():
        ft = F.when(F.col("term") == t, F.lit(n)).otherwise(ft)
    rows = post.where(F.col("term").isin(list(found)))
    rarest = min(found, key=lambda t: (found[t], t))
    if mode == AND and found[rarest] <= SKIP_FROM and max(found.values()) >= SKIP_TIMES * found[rarest]:
        rows = skipped_to(rows, rarest)
    part = contribution(F.col("tf"), ft, stats, k1, b) * _multiplicity(terms)
    scored = rows.groupBy("doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    if mode == AND:
        scored = scored.where(F.col("matched") == len(found))
    return top_k(scored, k)


def rank_batch(post: DataFrame, lexicon: DataFrame, queries: DataFrame, stats: Statistics, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, doc_id, score) for many queries at once: ``queries`` has query_id, terms (an array), k, conjunctive.

    Null terms or an empty array, and ``k`` under 1 or null, give no hits; a null ``conjunctive`` is OR. Postings meet the
    queries by term, are added up by query and document before anything is ordered, and each query keeps its k best, in each
    task first.
    """
    asked = queries.where("k > 0 and size(terms) > 0").select("query_id", F.coalesce("conjunctive", F.lit(False)).alias("conjunctive"), "k", F.explode("terms").alias("term"))
    bag = asked.groupBy("query_id", "conjunctive", "k", "term").agg(F.count("*").alias("times"))
    asked_for = queries.select("query_id", F.size(F.array_distinct("terms")).alias("distinct_terms"))
    known = written(bag.join(lexicon.select("term", "ft"), "term"), "asked")
    asked_rows, most = known.agg(F.count("*"), F.coalesce(F.max("k"), F.lit(0))).first()
    rows = post.select("term", "doc_id", "tf", *([stats.length] if stats.length else []))
    listed = [r["term"] for r in known.select("term").distinct().limit(MOST_LISTED + 1).collect()]
    if len(listed) <= MOST_LISTED:  # the scan then reads the row groups of these terms only
        rows = rows.where(F.col("term").isin(listed))
    if asked_rows <= MOST_ASKED:
        hits = rows.join(F.broadcast(known), "term")
    else:  # a term with a thousandth of all postings is hot; under a thousand are, and their query rows are repeated by salt
        hot = lexicon.where(F.col("ft") * 1000 > post.count()).select("term")
        often, seldom = (known.join(F.broadcast(hot), "term", how) for how in ("left_semi", "left_anti"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = rows.join(F.broadcast(hot), "term", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        by_hot = salted.join(often.withColumn("salt", salts), ["term", "salt"]).drop("salt")
        hits = by_hot.unionByName(rows.join(F.broadcast(hot), "term", "left_anti").join(seldom, "term"))
    part = contribution(F.col("tf"), F.col("ft"), stats, k1, b) * F.col("times")
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"), F.first("k").alias("k"), F.first("conjunctive").alias("conjunctive"))
    kept = scored.join(asked_for, "query_id").where(~F.col("conjunctive") | (F.col("matched") == F.col("distinct_terms")))
    order = Window.partitionBy("query_id").orderBy(F.desc("r6"), "doc_id")
    # with the greatest k as a literal, each task keeps that many of a query before anything is shuffled by query
    best = kept.withColumn("r6", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    ranked = best.where(F.col("rank") <= F.col("k"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.round("score", 4).alias("score"))
