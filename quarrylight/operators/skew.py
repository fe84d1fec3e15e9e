"""Per-key results over keys of very uneven size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.postings import NAME, countable
from quarrylight.storage import written

_STATE = "part int, seq bigint, opens boolean, shard_no int, term string, records bigint, docs bigint, first_doc bigint, last_doc bigint"


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Where a sorted column's value differs from the row before; ``before`` is the last row of the previous batch."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    if before is not None:
        out[0] = column[0].as_py() != before
    return out


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per key and batch of a sorted partition: its records and documents that the rows before it don't have."""
    before: dict = {}
    seq = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        new_key = _changes(col["shard_no"], before.get("shard_no")) | _changes(col["term"], before.get("term"))
        new_doc = new_key | _changes(col["doc_id"], before.get("doc_id"))
        new_rec = new_doc | _changes(col["run_no"], before.get("run_no")) | _changes(col["rec_no"], before.get("rec_no"))
        starts = new_key.copy()
        starts[0] = True
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], batch.num_rows) - 1
        n = len(at)
        opens = np.zeros(n, dtype=bool)
        opens[0] = not before
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(n, dtype=np.int32)),
                pa.array(np.arange(seq, seq + n)),
                pa.array(opens),
                col["shard_no"].take(pa.array(at)),
                col["term"].take(pa.array(at)),
                pa.array(np.add.reduceat(new_rec.astype(np.int64), at)),
                pa.array(np.add.reduceat(new_doc.astype(np.int64), at)),
                col["doc_id"].take(pa.array(at)),
                col["doc_id"].take(pa.array(ends)),
            ],
            names=["part", "seq", "opens", "shard_no", "term", "records", "docs", "first_doc", "last_doc"],
        )
        seq += n
        before = {k: v[batch.num_rows - 1].as_py() for k, v in col.items()}


def balanced_key_counts(postings: DataFrame) -> DataFrame:
    """(shard_no, term, postings, ft): counted records and distinct documents of each shard and term.

    Rows are range-partitioned on the key followed by document and record, with the cut points taken from sampled
    quantiles, so a key with any share of the rows spreads over as many partitions as its size asks for. Equal names have
    equal sort keys and meet in one partition. Each partition is reduced to states in one ordered pass; a key cut by a
    partition boundary has one state on either side, and a document on both sides is then counted once.

    Null shard, document or record name: no counted record, left out. Empty input: no rows. Repeats count once.
    """
    order = ["shard_no", "term", "doc_id", "run_no", "rec_no"]
    states = (
        countable(postings)
        .select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_partial_states, _STATE)
        .withColumn("part", F.spark_partition_id())
    )
    earlier = Window.partitionBy("shard_no", "term").orderBy("part", "seq")
    again = F.col("opens") & (F.lag("last_doc").over(earlier) == F.col("first_doc"))
    return (
        states.withColumn("again", F.coalesce(again, F.lit(False)).cast("bigint"))
        .groupBy("shard_no", "term")
        .agg(F.sum("records").alias("postings"), F.sum(F.col("docs") - F.col("again")).alias("ft"))
    )


def heavy_keys(postings: DataFrame, parts: int = 50) -> DataFrame:
    """(shard_no, term) of the terms with at least one in ``parts`` of the counted records of their shard."""
    counts = written(balanced_key_counts(postings).select("shard_no", "term", "postings"), "key-counts")
    totals = counts.groupBy("shard_no").agg(F.sum("postings").alias("total"))
    return counts.join(totals, "shard_no").where(F.col("postings") * parts >= F.col("total")).select("shard_no", "term")


def lexicon_counts(postings: DataFrame, lexicon: DataFrame) -> DataFrame:
    """What ``lexicon.postings`` should hold, beside what its latest row per shard and term holds (null where there is none)."""
    latest = (
        lexicon.where("term is not null and shard_no is not null")
        .groupBy("shard_no", "term")
        .agg(F.max(F.struct("built_at", "postings"))["postings"].alias("lexicon_postings"))
    )
    return balanced_key_counts(postings).join(latest, ["shard_no", "term"], "left").select("shard_no", "term", "postings", "ft", "lexicon_postings")
