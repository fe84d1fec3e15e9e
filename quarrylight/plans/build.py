"""Building and opening a stored index."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.scoring import Statistics
from quarrylight.operators import index
from quarrylight.storage import written
from quarrylight.tables import spread

_PARTS = {
    "postings": ["term", "doc_id", "tf", "dl"],
    "blocks": ["term", "block_no", "n", "first_doc", "last_doc", "docids", "freqs", "block_id", "byte_offset"],
    "lexicon": ["term", "start_slot", "end_slot", "first_block", "num_blocks", "ft"],
    "passages": ["doc_id", "text"],
    "stats": ["n_docs", "total_len", "avgdl", "n_blocks", "block_size"],
}


@dataclass(frozen=True)
class Index:
    """The tables of a stored index and its corpus statistics."""

    postings: DataFrame
    blocks: DataFrame
    lexicon: DataFrame
    passages: DataFrame
    stats: Statistics
    block: int


def build_index(spark: SparkSession, docs: DataFrame, path: str, block: int = index.BLOCK) -> Index:
    """Writes the index of (doc_id, text) under ``path``, in place of what is there, and opens it.

    Each posting carries its document's length, so that ranking needs no join with a table of lengths. Postings, blocks and
    lexicon are sorted by term over range partitions, so a query reads only the row groups of its terms; blocks are encoded
    in one pass over the sorted postings. Documents given twice add up, in frequencies and in length, and count once; their
    passage is the one that is greatest in byte order. A null text has no terms.
    """
    docs = spread(docs.select("doc_id", "text"))
    again = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    repeated = written(index.repeated_lengths(docs), "repeated") if again else None

    def passages() -> None:
        rows = docs
        if again:
            rows = docs.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(docs.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/passages")

    def postings() -> int:
        # texts are analysed once; sampling for the ranges then reads the counts
        counted = written(index.sized_postings(docs), "counted")
        if again:
            counted = counted.join(repeated, "doc_id", "left").withColumn("dl", F.coalesce("dl_", "dl")).select("term", "doc_id", "tf", "dl")
        counted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        stored = spark.read.schema(counted.schema).parquet(f"{path}/postings")
        placed = index.ordered_blocks(stored, block)
        total: list[int] = []
        with ThreadPoolExecutor(3) as pool:
            done = [
                pool.submit(placed.write.mode("overwrite").parquet, f"{path}/blocks"),
                pool.submit(lambda: total.append(stored.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0])),
                pool.submit(lambda: index.lexicon_of(placed).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")),
            ]
            for d in done:
                d.result()
        return total[0]

    with ThreadPoolExecutor(2) as pool:  # the two halves share no stage, and neither fills all cores all the time
        texts, counts = pool.submit(passages), pool.submit(postings)
        texts.result()
        total = counts.result()
    n = spark.read.parquet(f"{path}/passages").count()
    blocks = spark.read.parquet(f"{path}/blocks").count()
    stats = [(n, total, total / n if n else 0.0, blocks, block)]
    spark.createDataFrame(stats, "n_docs bigint, total_len bigint, avgdl double, n_blocks bigint, block_size bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """Opens a stored index; a missing part or column is an error, and so are more or fewer blocks than were written."""
    parts = {}
    with ThreadPoolExecutor(len(_PARTS)) as pool:  # each reads the footers of its files
        opened = dict(zip(_PARTS, pool.map(lambda name: spark.read.parquet(f"{path}/{name}"), _PARTS), strict=True))
    for name, columns in _PARTS.items():
        parts[name] = opened[name]
        if missing := [c for c in columns if c not in parts[name].columns]:
            raise ValueError(f"{name} of the index at {path} lacks {missing}")
    row = parts["stats"].first()
    if parts["blocks"].count() != row["n_blocks"]:  # from the files' footers
        raise ValueError(f"blocks of the index at {path} are not the {row['n_blocks']} that were written")
    return Index(parts["postings"], parts["blocks"], parts["lexicon"], parts["passages"], Statistics(row["n_docs"], row["avgdl"]), row["block_size"])
