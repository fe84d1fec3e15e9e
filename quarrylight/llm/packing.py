"""Filling containers of fixed capacity with documents, sized in tokens."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.ranks import ranked
from quarrylight.llm.tokens import PATTERN, TOKENIZER, token_counter
from quarrylight.storage import written


#: Most profiles, and the greatest capacity: the plan, which is made on the driver and broadcast, has a few steps for each size
#: up to the capacity and not more, whatever the number of documents.
MOST_PROFILES, MOST_CAPACITY = 1000, 1 << 20


class OpenBins:
    """A segment tree over remaining capacities that holds how many bins are open at each."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.leaves, dtype=np.int64)

    def add(self, remaining: int, n: int) -> None:
        at = self.leaves + remaining
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity of ``size`` or more with an open bin; -1 if there is none."""
        at = self.leaves + size
        if self.count[at]:
            return size
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over ``counts`` items of each size, as steps (size, first item, items, first bin, items per bin).

    Items of one size are alike, and so are bins with the same room left. The tightest bin, once it has taken an item, stays
    the tightest while it has room for another of that size; so all bins with the same room take their items in one step.
    The steps are those of placing the items one by one, but their number depends on the capacity, not on the items.
    """
    tree, bins, opened = OpenBins(capacity), [deque() for _ in range(capacity + 1)], 0
    steps: list[tuple[int, int, int, int, int]] = []

    def put(room: int, first: int, n: int) -> None:
        if room:
            bins[room].append((first, n))
            tree.add(room, n)

    for size in range(capacity, 0, -1):
        left, item = counts.get(size, 0), 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            else:
                first, n = bins[room].popleft()
                tree.add(room, -n)
            each = room // size
            full = min(n, left // each)
            if full:
                steps.append((size, item, full * each, first, each))
                put(room - each * size, first, full)
                item, left = item + full * each, left - full * each
            if left and full < n:  # fewer than a bin takes
                steps.append((size, item, left, first + full, left))
                put(room - left * size, first + full, 1)
                item, left, full = item + left, 0, full + 1
            if full < n:
                put(room, first + full, n - full)
                bins[room].rotate(1)
    return np.array(steps, dtype=np.int64).reshape(-1, 5)


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens), written so that texts are encoded once."""
    count = token_counter(documents.sparkSession, tokenizer, pattern)
    return written(documents.select("doc_id", count(F.col("text")).alias("tokens")), "token-sizes")


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(profile, capacity, doc_id, piece_no, first_token, n_tokens, container) of every document for every profile.

    A document over the capacity is cut into pieces that fill a container each, and a rest; no other is cut. Containers are
    numbered from 0 within a profile. The numbers of pieces by size, at most capacity many, go to the driver, which plans
    the packing; each piece then finds its container from its size and its place among the pieces of that size. Over
    ``MOST_PROFILES`` profiles or a capacity over ``MOST_CAPACITY`` are an error.

    Documents without tokens take no room: one piece, container null. Repeated rows are packed one by one. Rows of
    ``capacities`` without a profile or with a capacity under 1 are left out; an empty table on either side gives no rows.
    """
    spark = sizes.sparkSession
    profiles = [(r["profile"], r["capacity"]) for r in capacities.where("profile is not null and capacity > 0").select("profile", F.col("capacity").cast("bigint").alias("capacity")).distinct().limit(MOST_PROFILES + 1).collect()]
    if len(profiles) > MOST_PROFILES or any(c > MOST_CAPACITY for _, c in profiles):
        raise ValueError(f"more than {MOST_PROFILES} container profiles, or a capacity over {MOST_CAPACITY}")
    if not profiles:
        sizes, profiles = sizes.limit(0), [("", 1)]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("capacity")) for p, c in profiles]))
    tokens, capacity = F.col("tokens"), F.col("capacity")
    pieces = (
        sizes.select("doc_id", "tokens", each.alias("to"))
        .select("doc_id", "tokens", "to.*")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(tokens / capacity) - 1, F.lit(0)).cast("bigint"))))
        .withColumn("first_token", F.col("piece_no") * capacity)
        .withColumn("n_tokens", F.least(capacity, tokens - F.col("first_token")))
        .drop("tokens")
    )
    by_size = pieces.where("n_tokens > 0").groupBy("profile", "capacity", "n_tokens").agg(F.count("*").alias("n"))
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in by_size.collect():
        counts.setdefault((r["profile"], r["capacity"]), {})[r["n_tokens"]] = r["n"]
    plans = {k: best_fit_decreasing(v, k[1]) for k, v in counts.items()}
    keys = {k: s[:, 0] << 44 | s[:, 1] for k, s in plans.items()}
    ordered = {k: np.argsort(v) for k, v in keys.items()}
    plan = spark.sparkContext.broadcast({k: (keys[k][o], plans[k][o]) for k, o in ordered.items()})

    @F.pandas_udf("bigint")
    def container(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for profile, capacity, size, rank in batches:
            out = np.empty(len(size), dtype=np.int64)
            for key, at in profile.groupby([profile, capacity]).indices.items():
                starts, steps = plan.value[key]
                item = rank.to_numpy()[at]
                step = steps[np.searchsorted(starts, size.to_numpy()[at] << 44 | item, side="right") - 1]
                out[at] = step[:, 3] + (item - step[:, 1]) // step[:, 4]
            yield pd.Series(out)

    columns = ["profile", "capacity", "doc_id", "piece_no", "first_token", "n_tokens"]
    placed = ranked(pieces.where("n_tokens > 0"), ["profile", "capacity", "n_tokens"], F.xxhash64("doc_id", "piece_no"))
    placed = placed.select(*columns, container("profile", "capacity", "n_tokens", "rank").alias("container"))
    return placed.unionByName(pieces.where("n_tokens = 0").select(*columns, F.lit(None).cast("bigint").alias("container")))


def fill_report(packed: DataFrame) -> DataFrame:
    """(profile, capacity, documents, containers, tokens, fill): the share of the containers' room that is used."""
    per = packed.where("container is not null").groupBy("profile", "capacity", "container").agg(F.sum("n_tokens").alias("n"), F.sum((F.col("piece_no") == 0).cast("bigint")).alias("d"))
    total = per.groupBy("profile", "capacity").agg(F.sum("d").alias("documents"), F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return total.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
