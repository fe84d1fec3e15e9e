"""Occurrences and record counts of every distinct term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.postings import countable, document_terms
from quarrylight.storage import written

#: Identifiers in one count array, and rows whose terms are encoded and counted together.
RANGE, BLOCK = 1 << 14, 1 << 20
_COUNTS = "range_no bigint, first bigint, occurrences array<bigint>, records array<bigint>"


def term_dictionary(terms: DataFrame) -> DataFrame:
    """(term, id): every distinct term with an integer from 0 without gaps.

    Terms are numbered within their hash partition; the partitions' sizes, one row each, give where each begins.
    """
    place = F.monotonically_increasing_id()
    numbered = written(terms.select("term").distinct().withColumn("place", place), "dictionary")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, n = {}, 0
    for p in sorted(sizes):
        starts[p] = n
        n += sizes[p]
    offsets = terms.sparkSession.createDataFrame(list(starts.items()), "part bigint, start bigint")  # a row per task
    return numbered.withColumn("part", part).join(F.broadcast(offsets), "part").select("term", (F.col("start") + within).alias("id"))


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of (term, tf) rows, a row per document and term: its terms, and the two count arrays over their codes."""

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        terms = rows.column(0).chunk(0).dictionary_encode()
        codes = terms.indices.to_numpy()
        occurrences = np.zeros(len(terms.dictionary), dtype=np.int64)
        np.add.at(occurrences, codes, rows.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([terms.dictionary, pa.array(occurrences), pa.array(np.bincount(codes, minlength=len(occurrences)))], names=["term", "occurrences", "records"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= BLOCK:
            yield counted(held)
            held, size = [], 0
    if held:
        yield counted(held)


def _count_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of encoded rows and identifier range, the two count arrays between the least and greatest identifier."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, occ, rec = (batch.column(i).to_numpy() for i in range(3))
        order = np.argsort(ids, kind="stable")
        ids, occ, rec = ids[order], occ[order], rec[order]
        ranges = ids // RANGE
        at = np.flatnonzero(np.diff(ranges, prepend=-1))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for lo, hi in zip(at, np.append(at[1:], len(ids)), strict=True):
            first = ids[lo]
            size = int(ids[hi - 1] - first) + 1
            counts = [np.zeros(size, dtype=np.int64) for _ in range(2)]
            np.add.at(counts[0], ids[lo:hi] - first, occ[lo:hi])
            np.add.at(counts[1], ids[lo:hi] - first, rec[lo:hi])
            for into, value in zip(out, (int(ranges[lo]), int(first), *counts), strict=True):
                into.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64()))],
            names=["range_no", "first", "occurrences", "records"],
        )


def _sum_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the arrays of the ranges that a sorted partition holds; two arrays of one range are in memory at a time."""
    now, totals = -1, np.zeros((2, RANGE), dtype=np.int64)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(totals[1])
        return pa.RecordBatch.from_arrays([pa.array(at + now * RANGE), pa.array(totals[0, at]), pa.array(totals[1, at])], names=["id", "occurrences", "records"])

    for batch in batches:
        firsts, occs, recs = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
        for i, r in enumerate(batch.column(0).to_numpy()):
            if r != now:
                if now >= 0:
                    yield done()
                now = int(r)
                totals[:] = 0
            lo = int(firsts[i]) - now * RANGE
            for row, arrays in enumerate((occs, recs)):
                x = arrays[i].values.to_numpy()
                totals[row, lo : lo + len(x)] += x
    if now >= 0:
        yield done()


def term_counts(postings: DataFrame) -> DataFrame:
    """(term, occurrences, records): summed ``freq`` and number of documents of every cleaned term.

    Rows shuffle once, by term and document, so that no term is one task's. Each block's rows are encoded with codes of its own
    and added into its two count arrays; the codes are then replaced by the identifiers of a global dictionary, built from
    the blocks' terms, and the arrays are summed by identifier range.

    Null terms, documents or record names, empty terms and ``freq`` that is null or under 1 don't count; repeats count
    once. Empty table: no rows. Other columns are dropped.
    """
    pairs = document_terms(postings, "term", "doc_id").select("term", "tf")
    blocks = written(pairs.mapInArrow(_block_counts, "term string, occurrences bigint, records bigint"), "term-blocks")
    dictionary = term_dictionary(blocks)
    encoded = blocks.join(dictionary, "term").select("id", "occurrences", "records")
    sums = (
        encoded.mapInArrow(_count_arrays, _COUNTS)
        .repartition("range_no")
        .sortWithinPartitions("range_no")
        .mapInArrow(_sum_arrays, "id bigint, occurrences bigint, records bigint")
    )
    return sums.join(dictionary, "id").select("term", "occurrences", "records")


def document_count(postings: DataFrame) -> int:
    """Documents with a counted record."""
    return countable(postings).select("doc_id").distinct().count()


def marked_terms(postings: DataFrame, least: int = 3, most: float = 0.25) -> DataFrame:
    """``term_counts`` with ``mark``: "rare" under ``least`` records, "common" over the share ``most`` of all documents, else null."""
    n = document_count(postings)
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") > most * n, "common")
    return term_counts(postings).withColumn("mark", mark)
