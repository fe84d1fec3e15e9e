"""Drawing documents from several sources to target shares of the tokens."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.ranks import ranked

#: The remaining budget, in tokens, that is left to the dynamic program.
DP_BUDGET = 1 << 16
SEED = 42


def source_key(source: Column) -> Column:
    """One spelling of a source: lower case, no outer spaces, ``_`` for ``-`` and space."""
    return F.translate(F.lower(F.trim(source)), "- ", "__")


def fit_exactly(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each size, of ``counts`` at hand, sum to ``budget`` or as near below it as can be.

    Bounded knapsack over sums up to ``budget``: ``last[v]`` is the size that first made the sum v, so that a sum is taken
    apart by going back size by size. It stops once the budget itself is made.
    """
    last = np.zeros(budget + 1, dtype=np.int64)
    made = np.zeros(budget + 1, dtype=bool)
    made[0] = True
    for size in sorted((s for s in counts if 0 < s <= budget), reverse=True):
        front = made.copy()
        for _ in range(min(counts[size], budget // size)):
            new = np.zeros_like(made)
            new[size:] = front[:-size]
            new &= ~made
            if not new.any():
                break
            last[new] = size
            made |= new
            front = new
        if made[budget]:
            break
    at, used = int(np.flatnonzero(made)[-1]), {}
    while at:
        used[int(last[at])] = used.get(int(last[at]), 0) + 1
        at -= int(last[at])
    return used


def quotas(counts: dict[int, int], budget: int, repeats: int, dp_budget: int = DP_BUDGET) -> tuple[int, dict[int, int]]:
    """(whole passes, documents by length for the last pass) that come nearest to ``budget`` from below.

    The last pass takes the same share of every length, then single documents from the longest down while over
    ``dp_budget`` is left, then what the dynamic program says.
    """
    own = sum(s * n for s, n in counts.items())
    if not own or budget <= 0 or repeats <= 0:
        return 0, {}
    passes = min(repeats, budget // own)
    rest = budget - passes * own
    if passes == repeats or not rest:
        return passes, {}
    share = {s: n * rest // own for s, n in counts.items() if s}
    rest -= sum(s * n for s, n in share.items())
    for s in sorted(share, reverse=True):
        if rest <= dp_budget:
            break
        more = min(counts[s] - share[s], max(0, rest - dp_budget) // s + 1, rest // s)
        share[s] += more
        rest -= more * s
    for s, n in fit_exactly({s: counts[s] - n for s, n in share.items()}, min(rest, max(dp_budget, 1))).items():
        share[s] += n
    return passes, {s: n for s, n in share.items() if n}


def _plan(sized: DataFrame, targets: DataFrame, total: int | None, most_sources: int) -> list[dict]:
    """Per target: budget, passes and quotas. Only counts by source and token length reach the driver."""
    rows = targets.where("source is not null and target_share is not null").select("source", source_key(F.col("source")).alias("key"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).distinct().limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} target sources")
    own: dict[str, dict[int, int]] = {r["key"]: {} for r in rows}
    names = sized.sparkSession.createDataFrame([(k,) for k in own], "key string")
    for r in sized.join(F.broadcast(names), "key").groupBy("key", "tokens").agg(F.count("*").alias("n")).collect():
        own[r["key"]][r["tokens"]] = r["n"]
    size = {k: sum(s * n for s, n in v.items()) for k, v in own.items()}
    whole = sum(size.values())
    plan = []
    for r in rows:
        budget = math.floor(r["target_share"] * (whole if total is None else total))
        passes, last = quotas(own[r["key"]], budget, r["max_repeats"])
        plan.append(r.asDict() | {"own": size[r["key"]], "docs": sum(own[r["key"]].values()), "budget": budget, "passes": passes, "quotas": last, "wanted": r["target_share"] * whole})
    return plan


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, most_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Two tables: (source, doc_id, tokens, uses) of the documents drawn, and the report by source.

    ``sized`` has doc_id, source and tokens. Each source gets floor(target_share * total) tokens, ``total`` being the tokens
    of all sources in ``targets`` unless it is given. A source is drawn in whole passes, ``max_repeats`` at most, and a last
    pass that takes of each token length as many documents as its budget was fitted with, in a seeded order.

    Documents whose source is null or has no target are not drawn. A source of which everything the cap allows was drawn, and
    which is still under its target share of the tokens of all sources, is marked ``short``; so is one without documents. Null shares or sources among the targets are left out, a null cap is
    1. Repeated rows count one by one; empty tables give an empty mix.
    """
    spark = sized.sparkSession
    keyed = sized.where("source is not null").select("doc_id", source_key(F.col("source")).alias("key"), "tokens")
    plan = _plan(keyed, targets, total, most_sources)
    passes = F.broadcast(spark.createDataFrame([(p["key"], p["source"], p["passes"]) for p in plan], "key string, source string, passes bigint"))
    last = spark.createDataFrame([(p["key"], s, n) for p in plan for s, n in p["quotas"].items()], "key string, tokens bigint, quota bigint")
    order = F.xxhash64("doc_id", F.lit(seed))
    drawn = ranked(keyed.join(passes, "key"), ["key", "tokens"], order).join(last, ["key", "tokens"], "left")
    uses = F.col("passes") + (F.coalesce("quota", F.lit(0)) > F.col("rank")).cast("bigint")
    drawn = drawn.select("source", "doc_id", "tokens", uses.alias("uses")).where("uses > 0")
    known = spark.createDataFrame(
        [(p["source"], p["docs"], p["own"], float(p["target_share"]), p["max_repeats"], p["budget"], float(p["wanted"])) for p in plan],
        "source string, documents bigint, own_tokens bigint, target_share double, max_repeats int, budget bigint, wanted double",
    )
    reached = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    zero = F.lit(0).cast("bigint")
    report = known.join(reached, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", zero)).withColumn("most_uses", F.coalesce("most_uses", zero))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # a row per source, of which there are ``most_sources`` at most
    # short: what was drawn is all that the cap allows, and is less than the share asked for
    all_drawn = F.col("mixed_tokens") >= F.col("max_repeats") * F.col("own_tokens")
    report = report.withColumn("short", all_drawn & (F.col("mixed_tokens") < F.col("wanted"))).drop("wanted")
    report = report.withColumn("reached_share", F.round(F.col("mixed_tokens") / F.greatest(whole, F.lit(1)), 6))
    return drawn, report
