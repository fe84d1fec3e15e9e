"""Every query of the training-data operators against its SQL, or for rows."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from quarrylight.llm import catalog, tokens
from tests.conftest import compare_with_sql
from tests.llm.test_operators import one_by_one


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, small, name):
    assert compare_with_sql(spark, small, catalog.QUERIES[name], catalog.SQL[name])


@pytest.fixture(scope="module")
def sizes(spark, small):
    encoder = tokens._encoding(open(tokens.TOKENIZER, "rb").read(), tokens.PATTERN)
    return {r["doc_id"]: (r["source"], len(encoder.encode_ordinary(r["text"] or ""))) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_packed_tables(spark, small, sizes):
    """Every document is in containers of every profile, whole or in full pieces, as placing them one by one packs them."""
    found = catalog.p7_packed(spark, small).collect()
    fills = {r["profile"]: r for r in catalog.p7_fill(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pack_sizes.parquet").collect():
        profile, capacity = r["profile"], r["capacity"]
        mine = [x for x in found if x["profile"] == profile]
        whole, fill = Counter(), Counter()
        for x in mine:
            whole[x["doc_id"]] += x["n_tokens"]
            fill[x["container"]] += x["n_tokens"]
        assert whole == Counter({d: n for d, (_, n) in sizes.items()})
        fill.pop(None, None)
        pieces = [n for _, t in sizes.values() for n in [capacity] * (t // capacity) + ([t % capacity] if t % capacity else [])]
        assert sorted(capacity - n for n in fill.values()) == one_by_one(pieces, capacity)
        assert fills[profile]["containers"] == len(fill) and fills[profile]["fill"] == pytest.approx(sum(pieces) / len(fill) / capacity, abs=1e-6)


def test_mixed_tables(spark, small, sizes):
    """Budgets are met to less than a document unless a source is short; no document is used more often than its source allows."""
    drawn, report = catalog.p8_mix(spark, small).collect(), {r["source"]: r for r in catalog.p8_report(spark, small).collect()}
    own, largest = Counter(), Counter()
    for source, n in sizes.values():
        key = (source or "").strip().lower().replace("-", "_").replace(" ", "_")
        own[key] += n
        largest[key] = max(largest[key], n)
    targets = spark.read.parquet(f"{small}/mix_targets.parquet").collect()
    total = sum(own[t["source"]] for t in targets)
    mixed = Counter()
    for x in drawn:
        assert x["tokens"] == sizes[x["doc_id"]][1] and x["uses"] <= report[x["source"]]["max_repeats"]
        mixed[x["source"]] += x["tokens"] * x["uses"]
    for t in targets:
        r = report[t["source"]]
        short = t["max_repeats"] * own[t["source"]] < t["target_share"] * total
        assert r["short"] == short and r["mixed_tokens"] == mixed[t["source"]]
        budget = math.floor(t["target_share"] * total)
        assert mixed[t["source"]] == t["max_repeats"] * own[t["source"]] if short else budget - largest[t["source"]] < mixed[t["source"]] <= budget, t["source"]
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1, abs=1e-4)


def test_statistics_of_tables(spark, small):
    """Counts by plain Python; what is found is what the statistics say."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in catalog.p9_statistics(spark, small).collect()}
    assert set(found) == set(texts)
    for d, r in found.items():
        words = (texts[d] or "").split()
        assert r["words"] == len(words) and r["mean_word_length"] == pytest.approx(sum(map(len, words)) / max(1, len(words)), abs=1e-6)
    assert {r["doc_id"] for r in catalog.p9_found(spark, small).collect()} == {d for d, r in found.items() if r["is_prose"] is False}
