"""Counted records: the clean, distinct part of a postings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.analysis import clean_term

NAME = ["shard_no", "run_no", "rec_no"]


def countable(postings: DataFrame) -> DataFrame:
    """Rows with ``freq`` >= 1 whose cleaned term is not empty, repeats still in.

    Rows with a null in the record's name or document belong to no record and are left out. Other columns are dropped, so
    that clashing names in ``postings`` do no harm.
    """
    return (
        postings.where("freq >= 1 and term is not null and doc_id is not null and shard_no is not null and run_no is not null and rec_no is not null")
        .select(*NAME, clean_term(F.col("term")).alias("term"), "doc_id", "freq")
        .where("term <> ''")
    )


def document_terms(postings: DataFrame, *by: str) -> DataFrame:
    """(doc_id, term, tf): ``freq`` summed over the counted records of a document and term, each record once.

    ``by``, some of doc_id and term, places the rows: one shuffle serves the removal of repeats and the sum, since repeats
    share term and document.
    """
    return (
        countable(postings)
        .repartition(*by)
        .groupBy("doc_id", "term", *NAME)
        .agg(F.max("freq").alias("freq"))
        .groupBy("doc_id", "term")
        .agg(F.sum(F.col("freq").cast("bigint")).alias("tf"))
    )
