"""How characteristic a term is of its document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.postings import document_terms
from quarrylight.storage import written

#: Most bytes of term statistics that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def lengths_in_force(doc_stats: DataFrame) -> DataFrame:
    """(doc_id, len) of the row with the latest ``counted_at``, where that ``len`` is over 0; at one time the greater counts."""
    latest = doc_stats.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("counted_at", "len"))["len"].alias("len"))
    return latest.where("len > 0").select("doc_id", F.col("len").cast("double").alias("len"))


def term_weights(postings: DataFrame, doc_stats: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, term, tf, ft, cf, residual, weight) for each term of each document with a length in force.

    ``residual`` is tf times the residual inverse document frequency: log2(N/ft) less what a Poisson model expects of a term
    with cf occurrences, -log2(1 - exp(-cf/N)). ``weight`` is the BM25 weight of the term with the document's length.

    Documents without a length that is over 0, and records that don't count (see ``countable``), have no rows. Empty
    tables: no rows. Rows shuffle once, by document; the pairs are written and read for the statistics and the weights.
    """
    lengths = lengths_in_force(doc_stats)
    pairs = written(document_terms(postings, "doc_id").join(lengths, "doc_id"), "document-terms")
    n, mean = lengths.agg(F.count("*"), F.avg("len")).first()
    stats = written(pairs.groupBy("term").agg(F.count("*").alias("ft"), F.sum("tf").alias("cf")), "term-stats")
    held = stats.agg(F.coalesce(F.sum(F.octet_length("term") + 48), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        joined = pairs.join(F.broadcast(stats), "term")
    else:
        # a term with a thousandth of all pairs is hot: under a thousand of them are broadcast, so no task gets one whole
        least = (stats.agg(F.sum("ft")).first()[0] or 0) // 1000
        hot = stats.where(F.col("ft") > least)
        rest = pairs.join(F.broadcast(hot.select("term")), "term", "left_anti").join(stats.where(F.col("ft") <= least), "term")
        joined = pairs.join(F.broadcast(hot), "term").unionByName(rest)
    n, mean = float(n), float(mean or 1.0)
    ft, tf = F.col("ft"), F.col("tf")
    idf = F.log((F.lit(n) - ft + 0.5) / (ft + 0.5) + 1.0)
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.lit(mean))
    residual = F.log2(F.lit(n) / ft) + F.log2(1.0 - F.exp(-F.col("cf") / F.lit(n)))
    return joined.select("doc_id", "term", "tf", "ft", "cf", (tf * residual).alias("residual"), (idf * (tf * (k1 + 1)) / (tf + norm)).alias("weight"))


def top_terms(weights: DataFrame, by: str = "weight", least_ft: int = 2) -> DataFrame:
    """(doc_id, term, ``by``): each document's term of greatest ``by`` among those in ``least_ft`` documents; ties to the smaller term."""
    best = F.min(F.struct((-F.col(by)).alias("w"), F.col("term").alias("term")))
    return weights.where(F.col("ft") >= least_ft).groupBy("doc_id").agg(best.alias("best")).select("doc_id", F.col("best.term").alias("term"), (-F.col("best.w")).alias(by))
