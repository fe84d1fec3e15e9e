"""The inverted index as tables: postings, lexicon, blocks, document lengths and the passage store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import varbyte
from quarrylight.functions.analysis import terms
from quarrylight.operators.prefix import running_total
from quarrylight.storage import written

#: Postings of a block.
BLOCK = 128
#: Blocks of a term whose places are added up in one task.
STRETCH = 1 << 16


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def occurrences(docs: DataFrame) -> DataFrame:
    """(term, doc_id), a row per token that is not empty after cleaning."""
    # a plain explode would analyse each text a second time, to see beforehand whether it has terms
    return docs.select("doc_id", F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null")


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf). Documents given twice add up."""
    return occurrences(docs).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def sized_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl): postings with their row's length in terms. Of a document given twice, ``dl`` is that of its
    longest row; see ``repeated_lengths``. The texts are shuffled by document, not their terms."""
    # the length is a column before the terms are exploded: beside the explode it would be computed for every token
    sized = docs.repartition("doc_id").select("doc_id", terms(F.col("text")).alias("terms")).select("doc_id", F.size("terms").cast("bigint").alias("dl"), "terms")
    exploded = sized.select("doc_id", "dl", F.explode_outer("terms").alias("term")).where("term is not null")
    return exploded.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def repeated_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl_): the lengths of all rows together of the documents that have several."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    rows = docs.join(repeated, "doc_id", "left_semi")
    return document_lengths(rows).groupBy("doc_id").agg(F.sum("dl").alias("dl_"))


def document_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl): tokens after cleaning, by document id; no shuffle."""
    return docs.select("doc_id", F.size(terms(F.col("text"))).cast("bigint").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(n_docs, total_len, avgdl), one row."""
    total = document_lengths(docs).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_len"))
    return total.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.round(F.col("total_len") / F.col("n_docs"), 6)).otherwise(F.lit(0.0)))


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("ft"))


def lexicon(post: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, start_slot, end_slot, first_block, num_blocks, ft), slots and blocks counted over all terms in byte order."""
    counts = document_frequencies(post).withColumn("num_blocks", F.ceil(F.col("ft") / block).cast("bigint"))
    placed = running_total(counts, ["term"], start_slot=F.col("ft"), first_block=F.col("num_blocks"))
    return placed.select("term", "start_slot", (F.col("start_slot") + F.col("ft")).alias("end_slot"), "first_block", "num_blocks", "ft")


_CHUNK = "part bigint, term string, seq bigint, n bigint, first_doc bigint, last_doc bigint, docids binary, freqs binary, id_ bigint, bytes_ bigint, slots_ bigint"
_CHUNK_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]
_PAYLOAD = "term string, block_no bigint, n bigint, first_doc bigint, last_doc bigint, docids binary, freqs binary"


def _cut_bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The variable-byte forms of runs of values that end before ``ends``, one binary value each."""
    data, size = varbyte.encode(values)
    cut = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], ends))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cut), pa.py_buffer(data)])


def _chunks(block: int):  # noqa: ANN202
    """Blocks of a stream of postings in order of term and document. Where the order starts anew, as at the next file, a new
    part begins; only a part's first term can go on from another part, and its last term into another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 20
        none = np.zeros(0, dtype=np.int64)
        # the rows of the last term that don't fill a block yet, and how many blocks it has filled
        held_term, held_docs, held_freqs, seq, last = None, none, none, 0, None

        done = np.zeros(3, dtype=np.int64)  # blocks, bytes and postings that the part has so far
        done_part, seen = part, None

        def summary() -> pa.RecordBatch:
            """A row without a term that tells of a whole part: its ends, and what it has in all and of the terms at its ends."""
            told = json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in seen.items()}).encode()
            empty = [pa.nulls(1, t) for t in (pa.string(), *[pa.int64()] * 4)]
            return pa.RecordBatch.from_arrays([pa.array([done_part]), *empty, pa.array([told]), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * 3], names=_CHUNK_NAMES)

        def look(term: pa.Array, docs: np.ndarray, each: np.ndarray) -> None:
            nonlocal seen
            first, last = term[0].as_py(), term[len(term) - 1].as_py()
            if seen is None:
                seen = {"first": first, "doc": int(docs[0]), "head": np.zeros(3, dtype=np.int64), "tail": np.zeros(3, dtype=np.int64), "all": np.zeros(3, dtype=np.int64), "last": last}
            if seen["last"] != last:
                seen["last"], seen["tail"] = last, np.zeros(3, dtype=np.int64)
            for name, of in (("head", seen["first"]), ("tail", last)):
                seen[name] = seen[name] + each[:, pc.equal(term, of).to_numpy(zero_copy_only=False)].sum(axis=1)
            seen["all"] = seen["all"] + each.sum(axis=1)

        def packed(term: pa.Array, parts: np.ndarray, numbers: np.ndarray, docs: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal done, done_part, seen
            ends = np.append(starts[1:], len(docs))
            gaps = np.diff(docs, prepend=0)
            gaps[starts] = docs[starts]
            ids, tfs = _cut_bytes(gaps, ends), _cut_bytes(freqs, ends)
            size = pc.add(pc.binary_length(ids), pc.binary_length(tfs)).to_numpy(zero_copy_only=False).astype(np.int64)
            each = np.stack([np.ones(len(ends), dtype=np.int64), size, ends - starts])
            before = np.cumsum(each, axis=1) - each
            begin = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1))
            base = np.repeat(-before[:, begin], np.diff(np.append(begin, len(parts))), axis=1)
            if parts[0] == done_part:
                base[:, : begin[1] if len(begin) > 1 else len(parts)] += done[:, None]
            before = before + base
            for lo, hi in zip(begin, np.append(begin[1:], len(parts)), strict=True):
                if parts[lo] != done_part:
                    if seen is not None:
                        yield summary()
                    done_part, seen = int(parts[lo]), None
                look(term[lo:hi], docs[starts[lo:hi]], each[:, lo:hi])
            done = before[:, -1] + each[:, -1]
            cols = [pa.array(parts), term, pa.array(numbers), pa.array(ends - starts), pa.array(docs[starts]), pa.array(docs[ends - 1]), ids, tfs, *map(pa.array, before)]
            yield pa.RecordBatch.from_arrays(cols, names=_CHUNK_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            k = len(held_docs)
            names = pa.concat_arrays([pa.array([held_term] * k, pa.string()), batch.column(0)])
            docs, freqs = np.concatenate((held_docs, batch.column(1).to_numpy())), np.concatenate((held_freqs, batch.column(2).to_numpy()))
            n = len(docs)
            new, falls = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
            new[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            falls[1:] = pc.less(names[1:], names[:-1]).to_numpy(zero_copy_only=False) | ~new[1:] & (docs[1:] <= docs[:-1])
            goes_on = held_term is not None and names[0].as_py() == held_term and (k > 0 or docs[0] > last)
            falls[0] = held_term is not None and not k and not goes_on and (names[0].as_py().encode(), docs[0]) <= (held_term.encode(), last)
            starts = np.flatnonzero(new | falls)
            parts = part + np.cumsum(falls)
            place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            first_seq = np.zeros(n, dtype=np.int64)
            if goes_on:
                first_seq[: starts[1] if len(starts) > 1 else n] = seq
            at = np.flatnonzero(place % block == 0)
            # what the last block lacks may come with the next batch
            full = n - at[-1] == block
            out = at if full else at[:-1]
            if len(out):
                upto = n if full else at[-1]
                yield from packed(names.take(pa.array(out)), parts[out], first_seq[out] + place[out] // block, docs[:upto], freqs[:upto], out)
            rest = n if full else at[-1]
            held_term, held_docs, held_freqs, last, part = names[n - 1].as_py(), docs[rest:], freqs[rest:], docs[-1], int(parts[-1])
            seq = int(first_seq[-1] + place[-1] // block) + int(full)
        if len(held_docs):
            yield from packed(pa.array([held_term]), np.array([part]), np.array([seq]), held_docs, held_freqs, np.zeros(1, dtype=np.int64))
        if seen is not None:
            yield summary()

    return work


def ordered_blocks(post: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block_no, n, first_doc, last_doc, docids, freqs, block_id, byte_offset, start_slot): blocks of each term's postings,
    with the gaps between documents, the first absolute, and the frequencies as variable-byte integers; and their places
    one after another in term order.

    ``post`` is (term, doc_id, tf) sorted over its partitions, or files, as ``repartitionByRange`` and a sort within them
    leave it; it is encoded in one pass without a shuffle. Terms that lie in several parts, under two for each, are cut into
    blocks again; what is before each part is known from a few rows per part.
    """
    spark = post.sparkSession
    stored = written(post.select("term", "doc_id", _long("tf").alias("tf")).mapInArrow(_chunks(block), _CHUNK), "chunks")
    chunks = stored.where("term is not null")
    told = [json.loads(r["docids"]) | {"part": r["part"]} for r in stored.where("term is null").select("part", "docids").collect()]  # a row per part
    parts = sorted(told, key=lambda p: (p["first"].encode(), p["doc"]))
    cut = sorted({b["first"].encode() for a, b in zip(parts, parts[1:], strict=False) if a["last"] == b["first"]})
    names = F.broadcast(spark.createDataFrame([(t.decode(),) for t in cut], "term string"))
    rest = chunks.join(names, "term", "left_anti") if cut else chunks
    # of a part only the first and the last term can be cut, so what is left of it lies in a row
    segments, before, starts = [], dict.fromkeys(cut, 0), []
    for p in parts:
        ends = {p["first"].encode(): np.array(p["head"]), p["last"].encode(): np.array(p["tail"])}
        own = {t: v for t, v in ends.items() if t in before}
        left = np.array(p["all"]) - sum(own.values(), np.zeros(3, dtype=np.int64))
        skipped = own.get(p["first"].encode(), np.zeros(3, dtype=np.int64))
        if left[0]:
            segments.append(((p["first"].encode(), p["doc"], 1), p["part"], skipped, left))
        for t, v in own.items():
            starts.append((p["part"], t.decode(), before[t]))
            before[t] += int(v[2])
    again = None
    if cut:
        begin = F.broadcast(spark.createDataFrame(starts, "part bigint, term string, before bigint"))
        moved = chunks.join(begin, ["part", "term"]).select("term", (F.col("before") + F.col("seq") * block).alias("block_no"), "docids", "freqs")
        placed = moved.mapInArrow(_decoded, _DECODED).withColumn("rank", F.col("block_no") + F.col("place"))
        number = F.floor(F.col("rank") / block).cast("bigint")
        entries = F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("entries")  # a block is bounded
        again = written(placed.groupBy("term", number.alias("block_no")).agg(entries).mapInArrow(_payloads, _PAYLOAD).withColumn("stretch", F.floor(F.col("block_no") / STRETCH).cast("bigint")), "cut-blocks")
        size = F.octet_length("docids") + F.octet_length("freqs")
        totals = again.groupBy("term", "stretch").agg(F.count("*").alias("blocks"), F.sum(size).alias("size"), F.sum("n").alias("n"))
        # before the part that begins with other terms, and after the one that ends with this
        segments += [((r["term"].encode(), -1, r["stretch"]), r["term"], None, np.array([r["blocks"], r["size"], r["n"]])) for r in totals.collect()]  # a row per STRETCH blocks
    at, of_part, of_stretch = np.zeros(3, dtype=np.int64), [], []
    for (_, _, stretch), what, skipped, size in sorted(segments, key=lambda x: x[0]):
        if skipped is not None:
            of_part.append((what, *map(int, at - skipped)))
        else:
            of_stretch.append((what, stretch, *map(int, at)))
        at = at + size
    places = "id0 bigint, bytes0 bigint, slots0 bigint"
    whole = rest.join(F.broadcast(spark.createDataFrame(of_part, f"part bigint, {places}")), "part")
    columns = ["term", "block_no", "n", "first_doc", "last_doc", "docids", "freqs"]
    out = whole.withColumnRenamed("seq", "block_no").select(*columns, *[(F.col(x) + F.col(y)).alias(z) for x, y, z in (("id0", "id_", "block_id"), ("bytes0", "bytes_", "byte_offset"), ("slots0", "slots_", "start_slot"))])
    if again is None:
        return out
    placed = again.join(F.broadcast(spark.createDataFrame(of_stretch, f"term string, stretch bigint, {places}")), ["term", "stretch"])
    earlier = Window.partitionBy("term", "stretch").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)  # STRETCH rows at most
    run = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    cut_out = placed.select(*columns, (F.col("id0") + run(F.lit(1))).alias("block_id"), (F.col("bytes0") + run(F.octet_length("docids") + F.octet_length("freqs"))).alias("byte_offset"), (F.col("slots0") + run(F.col("n"))).alias("start_slot"))
    return out.unionByName(cut_out)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        entries = batch.column("entries").flatten()
        docs, freqs = entries.field("doc_id").to_numpy(), entries.field("tf").to_numpy()
        sizes = np.diff(batch.column("entries").offsets.to_numpy())
        ends = np.cumsum(sizes)
        gaps = np.diff(docs, prepend=0)
        gaps[ends - sizes] = docs[ends - sizes]
        cols = [batch.column("term"), batch.column("block_no"), pa.array(sizes.astype(np.int64)), pa.array(docs[ends - sizes]), pa.array(docs[ends - 1])]
        yield pa.RecordBatch.from_arrays([*cols, _cut_bytes(gaps, ends), _cut_bytes(freqs, ends)], names=["term", "block_no", "n", "first_doc", "last_doc", "docids", "freqs"])


def blocks(encoded: DataFrame) -> DataFrame:
    """(term, block_no, n, first_doc, last_doc, docid_bytes, freq_bytes) of encoded blocks."""
    return encoded.select("term", "block_no", "n", "first_doc", "last_doc", *[_long(F.octet_length(c)).alias(b) for c, b in (("docids", "docid_bytes"), ("freqs", "freq_bytes"))])


def lexicon_of(placed: DataFrame) -> DataFrame:
    """The lexicon of placed blocks, with the same columns as ``lexicon``."""
    per = placed.groupBy("term").agg(F.min("start_slot").alias("start_slot"), F.min("block_id").alias("first_block"), F.count("*").alias("num_blocks"), F.sum("n").alias("ft"))
    return per.select("term", "start_slot", (F.col("start_slot") + F.col("ft")).alias("end_slot"), "first_block", "num_blocks", "ft")


def block_skip_candidates(block_table: DataFrame, target: int) -> DataFrame:
    """(term, block_no, last_doc) of blocks that may hold ``target`` or a later document."""
    return block_table.where(F.col("last_doc") >= target).select("term", "block_no", "last_doc")


_DECODED = "term string, block_no bigint, place bigint, doc_id bigint, tf bigint, gap bigint"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All postings of a batch of blocks, decoded together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        gaps, of = _values(batch.column("docids"))
        freqs, _ = _values(batch.column("freqs"))
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        total = np.cumsum(gaps)
        before = np.repeat(total[starts] - gaps[starts], np.diff(np.append(starts, len(of))))
        at = pa.array(of)
        cols = [batch.column("term").take(at), batch.column("block_no").take(at), pa.array(np.arange(len(of)) - starts[np.searchsorted(starts, np.arange(len(of)), side="right") - 1]), pa.array(total - before), pa.array(freqs), pa.array(gaps)]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "block_no", "place", "doc_id", "tf", "gap"])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row) of a column of variable-byte runs."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    return varbyte.decode(data), row[data < 128]


def decoded_blocks(encoded: DataFrame) -> DataFrame:
    """(term, block_no, doc_id, tf, gap) of encoded blocks."""
    return encoded.select("term", "block_no", "docids", "freqs").mapInArrow(_decoded, _DECODED).drop("place")


def passage_store(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where("text is not null")


def passage_offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, byte_start, byte_end) of the texts laid one after another by id."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    placed = running_total(sized, ["doc_id"], byte_start=F.col("size"))
    return placed.select("doc_id", "byte_start", (F.col("byte_start") + F.col("size")).alias("byte_end"))


def passage_lookup(docs: DataFrame, ids: list[int]) -> DataFrame:
    """(pos, doc_id, text) in the order asked; an unknown id has an empty text."""
    wanted = docs.sparkSession.createDataFrame(list(enumerate(ids)), "pos bigint, doc_id bigint")
    found = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text")
    return wanted.join(found, "doc_id", "left").select("pos", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


_EXAMINED = "term string, block_id bigint, block_no bigint, first_doc bigint, last_doc bigint, byte_offset bigint, bytes bigint, n bigint, decoded bigint, falls boolean, strays boolean"


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block what its payload decodes to: postings, whether ids fail to rise, and whether its first or last id is another."""
    for batch in batches:
        if not batch.num_rows:
            continue
        gaps, of = _values(batch.column("docids"))
        _, freq_of = _values(batch.column("freqs"))
        m = batch.num_rows
        held, freqs = np.bincount(of, minlength=m), np.bincount(freq_of, minlength=m)
        starts = np.cumsum(held) - held
        inner = np.ones(len(gaps), dtype=bool)
        inner[starts[held > 0]] = False
        falls = np.bincount(of[inner], weights=gaps[inner] <= 0, minlength=m) > 0
        last = np.zeros(m, dtype=np.int64)
        np.add.at(last, of, gaps)
        first = np.zeros(m, dtype=np.int64)
        first[held > 0] = gaps[starts[held > 0]]
        strays = (last != batch.column("last_doc").to_numpy()) | (first != batch.column("first_doc").to_numpy()) | (held != freqs)
        size = pc.add(pc.binary_length(batch.column("docids")), pc.binary_length(batch.column("freqs"))).cast(pa.int64())
        cols = [batch.column(c) for c in ("term", "block_id", "block_no", "first_doc", "last_doc", "byte_offset")]
        yield pa.RecordBatch.from_arrays([*cols, size, batch.column("n"), pa.array(held), pa.array(falls), pa.array(strays)], names=[c.split()[0] for c in _EXAMINED.split(", ")])


def selfcheck(placed: DataFrame, lex: DataFrame) -> DataFrame:
    """(check_name, violations): seven invariants of a stored index, each counted over all terms and blocks.

    The payloads are decoded once. Neighbouring blocks meet by block id, of which each is one, so no term's blocks come
    together in one task.
    """
    seen = written(placed.mapInArrow(_examined, _EXAMINED), "examined")
    per_term = seen.groupBy("term").agg(F.count("*").alias("blocks"), F.sum("decoded").alias("decoded"), F.max("block_no").alias("last"), F.min("block_id").alias("first"))
    both = lex.join(per_term, "term", "full")
    after = seen.select((F.col("block_id") - 1).alias("block_id"), F.col("term").alias("next_term"), F.col("first_doc").alias("next_first"), F.col("byte_offset").alias("next_offset"))
    met = seen.join(after, "block_id", "left")

    def count(bad: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("bigint")), F.lit(0))

    ends = lex.agg(F.coalesce(F.sum("ft"), F.lit(0)).alias("slots"), F.coalesce(F.max("end_slot"), F.lit(0)).alias("end"))
    terms_ = both.agg(
        count(F.col("ft").isNull() | F.col("blocks").isNull()).alias("a_every_term_has_blocks"),
        count((F.col("blocks") != F.col("num_blocks")) | (F.col("last") != F.col("num_blocks") - 1) | (F.col("first") != F.col("first_block"))).alias("c_block_numbers_in_range"),
        count(F.col("decoded") != F.col("ft")).alias("g_counts_match_ft"),
    )
    apart = F.col("next_offset").isNotNull() & (F.col("byte_offset") + F.col("bytes") != F.col("next_offset"))
    within = met.agg(
        count(apart).alias("offsets"),
        count(F.col("falls")).alias("d_ids_rise_within_blocks"),
        count(F.col("next_term").isNotNull() & (F.col("next_term") == F.col("term")) & (F.col("next_first") <= F.col("last_doc"))).alias("e_ids_rise_across_blocks"),
        count(F.col("strays") | (F.col("n") != F.col("decoded"))).alias("f_last_ids_match"),
    )
    one = F.lit(1).alias("one_")
    row = terms_.select("*", one).join(within.select("*", one), "one_").join(ends.select((F.col("slots") != F.col("end")).cast("bigint").alias("slots"), one), "one_")
    row = row.withColumn("b_slots_and_bytes_add_up", F.col("slots") + F.col("offsets"))
    names = ["a_every_term_has_blocks", "b_slots_and_bytes_add_up", "c_block_numbers_in_range", "d_ids_rise_within_blocks", "e_ids_rise_across_blocks", "f_last_ids_match", "g_counts_match_ft"]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).cast("bigint").alias("violations")) for n in names])).alias("r")).select("r.*")


def index_stats(docs: DataFrame, block_table: DataFrame) -> DataFrame:
    """(n_docs, n_terms, n_postings, n_blocks, docid_bytes, freq_bytes, text_bytes), one row."""
    zero = F.lit(0)
    text = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length("text")), zero).cast("bigint").alias("text_bytes"))
    held = block_table.agg(
        F.sum((F.col("block_no") == 0).cast("bigint")).alias("n_terms"),
        F.sum("n").alias("n_postings"),
        F.count("*").alias("n_blocks"),
        F.sum("docid_bytes").alias("docid_bytes"),
        F.sum("freq_bytes").alias("freq_bytes"),
    )
    one = F.lit(1).alias("one_")
    joined = text.select("*", one).join(held.select("*", one), "one_")
    return joined.select("n_docs", *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("n_terms", "n_postings", "n_blocks", "docid_bytes", "freq_bytes")], "text_bytes")


def top_terms(post: DataFrame, n: int = 50) -> DataFrame:
    return document_frequencies(post).orderBy(F.desc("ft"), "term").limit(n)


def sampled_terms(post: DataFrame, n: int = 50) -> DataFrame:
    """A repeatable sample of terms, by hash."""
    return document_frequencies(post).orderBy(F.md5("term"), "term").limit(n)


def inspect_postings(post: DataFrame, n: int = 50, term: str | None = None) -> DataFrame:
    """The first ``n`` postings in term and document order, of one term if it is given."""
    some = post if term is None else post.where(F.col("term") == term)
    return some.select("term", "doc_id", "tf").orderBy("term", "doc_id").limit(n)
